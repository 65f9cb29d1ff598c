"""Queries over the driver's tables, and the SQL that checks them.

The SQL takes expected values straight from the source columns: it never parses
the letters again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as L
from ..operators import audit as A
from ..operators import extraction as X
from ..operators import results as R
from ..sources.dossier import letter_lines, letterhead_lines, line_words, orders_with_names, text_lines
from ..sources.profiles import mark_table
from ..sources.shared import kept
from . import batch as B
from . import file_queries


def _batch(spark: SparkSession, sf_dir: str) -> B.Batch:
    return B.run(letter_lines(spark, sf_dir), "jrp")


def _stored(spark: SparkSession, sf_dir: str) -> B.Batch:
    """For queries that read the batch's choice several times."""
    return _batch(spark, sf_dir).stored()


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slice_reference_amount(spark, sf_dir):
    found = R.merged_labels(X.extract_pairs(letter_lines(spark, sf_dir).where("page_no = 1")))
    tsi = F.element_at("found", F.lit("Total Sum Insured"))
    return found.select("doc_id", F.element_at("found", F.lit("Ref No")).alias("ref_no"), L.currency(tsi).alias("currency"), L.amount(tsi).alias("sum_insured"))


def w1_pairs(spark, sf_dir):
    return X.extract_pairs(letter_lines(spark, sf_dir)).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "label", "value")


def w2_sections(spark, sf_dir):
    s = _batch(spark, sf_dir).sections
    text = F.array_join(F.transform(F.map_entries("x.found"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return s.select("doc_id", F.posexplode("sections").alias("section_no", "x")).select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("x.kind").alias("kind"), text.alias("found"))


def w6_choice(spark, sf_dir):
    return _batch(spark, sf_dir).chosen.select("doc_id", "ok", "reason", "note", "kind", F.col("total").cast("long").alias("total"), F.col("other").cast("long").alias("other"))


def f14_projection(spark, sf_dir):
    b = _batch(spark, sf_dir)
    return b.results.select("doc_id", F.posexplode("values").alias("col_no", "value")).select("doc_id", F.col("col_no").cast("long").alias("col_no"), "value").where("value <> ''")


def f15_shapes(spark, sf_dir):
    return _batch(spark, sf_dir).results.select("doc_id", F.array_join("shape", "|").alias("shape"), F.array_join(F.map_keys("extra"), "|").alias("extra"), F.size("missing").cast("long").alias("n_missing"))


def a4_groups(spark, sf_dir):
    return _stored(spark, sf_dir).groups.select(F.col("group_no").cast("long").alias("group_no"), "kind", "shape", "n_rows", "caption")


def b6_cells(spark, sf_dir):
    return _stored(spark, sf_dir).cells.groupBy("header").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def o9_preview(spark, sf_dir):
    rows = R.preview(_stored(spark, sf_dir).cells)
    return rows.select(*(F.col(c).cast("long").alias(c) for c in ("group_no", "row_no", "col_no")), "header", "value")


def k2_widths(spark, sf_dir):
    return R.widths(_stored(spark, sf_dir).cells).select(F.col("col_no").cast("long").alias("col_no"), F.col("width").cast("long").alias("width"))


def a5_duplicate_claims(spark, sf_dir):
    b = _stored(spark, sf_dir)
    return R.duplicate_claims(b.results, b.profile)


def a3_reasons(spark, sf_dir):
    return R.reasons(_batch(spark, sf_dir).chosen).select("reason", "n", "first_doc")


def a3_skipped_files(spark, sf_dir):
    return R.skipped_files(_stored(spark, sf_dir).chosen)


def b4_notes(spark, sf_dir):
    t = _stored(spark, sf_dir).notes
    return t.select(F.col("note_no").cast("long").alias("note_no"), "level", "text", "n_details")


def b4_note_details(spark, sf_dir):
    t = _stored(spark, sf_dir).note_details
    return t.select(F.col("note_no").cast("long").alias("note_no"), "place", "detail")


def w6_letterheads(spark, sf_dir):
    """Letters of the second profile: bullets, nested amounts, shares, the
    letterhead as addressee and the reference after the title."""
    b = B.run(letterhead_lines(spark, sf_dir), "kmdastur")
    value = lambda label: F.element_at("found", F.lit(label))
    labels = {"reference": "Definite Loss Advice", "letterhead": "Kop Surat", "sum_insured": "Total Sum Insured", "expense": "Expense", "indemnity": "Indemnity", "loss": "Loss", "share": "Your Share"}
    return b.chosen.select("doc_id", "reason", F.col("total").cast("long").alias("total"), *(value(v).alias(k) for k, v in labels.items()))


def a2_summary(spark, sf_dir):
    b = _stored(spark, sf_dir)
    return R.summary(b.chosen, b.groups)


def a6_extra_labels(spark, sf_dir):
    return R.extra_labels(_batch(spark, sf_dir).results)


def j1_missing_labels(spark, sf_dir):
    return R.missing_labels(_batch(spark, sf_dir).results)


def p12_detection(spark, sf_dir):
    d = R.detected(X.document_labels(letter_lines(spark, sf_dir), True), mark_table(spark))
    return d.groupBy(F.coalesce("profile", F.lit("")).alias("profile")).agg(F.count("*").alias("files"))


def j4_audit(spark, sf_dir):
    """All cells of the extracted tables against the source columns, in which
    some values were altered, some files left out and some added."""
    sheet = _stored(spark, sf_dir).cells.where("header <> 'Sumber PDF'").select(F.col("doc_id").alias("name"), "header", "value")
    k = F.col("o_orderkey")
    claim = F.when(k % 17 == 0, F.concat(F.lit("Z"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    values = {
        "Ref No": k.cast("string"), "Claim No": claim, "Reinsurer": F.when(k % 5 == 0, "PT Reasuransi Lain").otherwise("PT Asuransi Astra Buana"),
        "Risk Cover": F.when(k % 9 != 4, F.col("o_orderpriority")), "Currency": F.lit("IDR"), "Total Sum Insured": F.format_number("o_totalprice", 2),
        "Date of Loss": F.date_format("o_orderdate", "dd/MM/yyyy"), "Appointed Adjuster": F.col("o_orderstatus"), "Remarks": F.concat_ws(" ", "c_mktsegment", F.lit("continued"), "n_name"),
    }
    want = orders_with_names(spark, sf_dir).where(k % 10 != 1).select(k.alias("name"), F.inline(F.array(*(F.struct(F.lit(h).alias("header"), v.alias("value")) for h, v in values.items())))).where("value is not null")
    return R.audit_cells(want, sheet).groupBy("header", "state").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def _audit_lines(spark, sf_dir):
    """Letters with a label that only the audit takes."""
    lines = letter_lines(spark, sf_dir)
    return lines.withColumn("text", F.when(F.col("text") == "not a pair", "x1 2 3-4 : 5").otherwise(F.col("text")))


def _audited(spark, sf_dir):
    """Letters, and the batch's cells as a sheet: some claims altered, some files
    left out, some of others put in."""
    lines = _audit_lines(spark, sf_dir)
    b = B.run(lines, "jrp").stored()
    k = F.col("doc_id")
    value = F.when((F.col("header") == "Claim No") & (k % 17 == 0), F.concat(F.lit("Z"), "value")).otherwise(F.col("value"))
    sheet = b.cells.where(k % 10 != 1).select(k.cast("string").alias("name"), "col_no", "header", value.alias("value"))
    others = b.chosen.where(~F.col("ok") & (k % 10 == 5)).select(k.cast("string").alias("name"), F.lit(0).alias("col_no"), F.lit("Ref No").alias("header"), k.cast("string").alias("value"))
    # The amounts of the ratio test, which these letters lack.
    amount = lambda place, header, value: F.struct(F.lit(place).alias("col_no"), F.lit(header).alias("header"), value.alias("value"))
    amounts = F.array(amount(30, "Definite Claim Amount", F.lit("1,600")), amount(31, "Your Share on Nett Loss", (k % 50).cast("string")))
    more = b.results.where(k % 10 == 2).select(k.cast("string").alias("name"), F.inline(amounts))
    return lines, sheet.unionByName(others).unionByName(more)


def w7_audit_pairs(spark, sf_dir):
    return X.extract_pairs(_audit_lines(spark, sf_dir), plain=True).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "label", "value")


def w8_audit_advice(spark, sf_dir):
    found = A.advice(_audit_lines(spark, sf_dir))
    return found.select("name", F.array_join(F.map_keys("found"), "|").alias("labels"), F.element_at("found", F.lit("Claim No")).alias("claim"))


def f22_expected(spark, sf_dir):
    lines, sheet = _audited(spark, sf_dir)
    return A.compared(A.advice(lines), sheet).select("name", F.col("col_no").cast("long").alias("col_no"), "header", "want", "got")


def a9_differences(spark, sf_dir):
    lines, sheet = _audited(spark, sf_dir)
    t = A.differences(A.compared(A.advice(lines), sheet))
    return t.select("header", "n", F.col("header_no").cast("long").alias("header_no"), F.col("place").cast("long").alias("place"), "name", "want", "got")


def o8_first_names(spark, sf_dir):
    """The first ten names that are missing or extra, and the first eight odd ratios."""
    lines, sheet = _audited(spark, sf_dir)
    found = kept(A.advice(lines).select("name"))
    lists = {"missing": A.first_names(A.missing(found, sheet)), "extra": A.first_names(A.extra(found, sheet)), "odd": A.first_names(A.ratios(sheet).where("odd"), 8)}
    parts = [t.select(F.lit(state).alias("state"), "name") for state, t in lists.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def b11_verdict(spark, sf_dir):
    lines, sheet = _audited(spark, sf_dir)
    return A.verdict(A.advice(lines), sheet)


def _ratios(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    r = li.select("l_orderkey", "l_linenumber", L.ratio(F.concat(F.lit("IDR "), (F.col("l_discount") * 100).cast("int").cast("string")), F.concat(F.lit("IDR "), F.format_number("l_quantity", 2))).alias("pct")).where("pct is not null")
    return r.groupBy("pct").agg(F.count("*").alias("n"), F.max(R.odd_ratio(F.col("pct")).cast("int")).cast("long").alias("odd"), F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))


def a10_ratios(spark, sf_dir):
    return _ratios(spark, sf_dir).orderBy(F.desc("n"), "first").drop("first")


def o7_top_ratios(spark, sf_dir):
    """The commonest, of equally common ones those seen first."""
    return _ratios(spark, sf_dir).orderBy(F.desc("n"), "first").select("pct", "n").limit(6)


def s4_banding(spark, sf_dir):
    return R.banded(line_words(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def f20_bands(spark, sf_dir):
    return R.banded_by_rounding(line_words(spark, sf_dir)).select("doc_id", "band", "text")


def s7_scanned_pages(spark, sf_dir):
    lines = text_lines(spark, sf_dir).withColumn("page_no", F.floor(F.col("line_no") / 2).cast("long"))
    # A sheet has two lines a page, and a last page that may have none.
    pages = lines.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2))).alias("page_no"))
    return R.scanned_pages(lines, pages=pages).select("doc_id", "page_no", "chars")


def p1_line_tests(spark, sf_dir):
    t = text_lines(spark, sf_dir).select("doc_id", L.clean(F.col("text")).alias("line")).where("line <> ''")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(L.is_junk(F.col("line"))).alias("junk"), F.count_if(L.is_pair(F.col("line"))).alias("pairs"), F.count_if(F.col("line").rlike(L.CLOSE)).alias("closes"), F.max(F.length("line")).cast("long").alias("longest"))


def p15_headings(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", L.headings(F.split(F.coalesce("text", F.lit("")), "\n")).alias("h"))
    return d.select("doc_id", F.size("h").cast("long").alias("n"), F.md5(F.array_join("h", "|").cast("binary")).alias("heads_md5"))


def f_takes(spark, sf_dir):
    """Every extractor over amounts as letters print them."""
    o = _read(spark, sf_dir, "orders")
    n, k = F.format_number("o_totalprice", 2), F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("Sum IDR ("), n, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("10% of USD "), n, F.lit(" / EUR 7"))).when(k % 4 == 2, n).otherwise(F.lit("none"))
    return o.select("o_orderkey", L.currency(t).alias("currency"), L.amount(t).alias("amount"), L.first_number(t).alias("first_number"), L.last_number(t).alias("last_number"), L.without_money(t).alias("text_only"), L.strip_currency(t).alias("stripped"))


def o12_difference(spark, sf_dir):
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    urgent = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return c.select(F.col("c_custkey").alias("custkey")).exceptAll(urgent.select(F.col("o_custkey").alias("custkey")).distinct())


def o15_dedupe(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("users"))


QUERIES = {f.__name__: f for f in (slice_reference_amount, w1_pairs, w2_sections, w6_choice, f14_projection, f15_shapes, a4_groups, b6_cells, o9_preview, k2_widths, a5_duplicate_claims, a3_reasons, a3_skipped_files, b4_notes, b4_note_details, w6_letterheads, w7_audit_pairs, w8_audit_advice, f22_expected, a9_differences, o8_first_names, b11_verdict, a2_summary, a6_extra_labels, j1_missing_labels, p12_detection, j4_audit, a10_ratios, o7_top_ratios, s4_banding, f20_bands, s7_scanned_pages, p1_line_tests, p15_headings, f_takes, o12_difference, o15_dedupe)}

_D = """WITH d AS (
  SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS claim, o_orderpriority AS pr, o_orderstatus AS st, format('{:,.2f}', o_totalprice) AS amt,
    strftime(o_orderdate, '%d/%m/%Y') AS dt, c_mktsegment || ' continued ' || n_name AS remarks,
    CASE WHEN o_orderkey % 5 = 0 THEN 'PT Reasuransi Lain' ELSE 'PT Asuransi Astra Buana' END AS who,
    o_orderkey % 5 <> 0 AS ok, o_orderkey % 7 = 1 AS merged, o_orderkey % 11 = 2 AS split, o_orderkey % 9 <> 4 AS cover
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
v AS (
  SELECT *, concat_ws('|', 'Appointed Adjuster', 'Claim No', 'Date of Loss', 'Ref No', 'Reinsurer', 'Remarks', CASE WHEN cover THEN 'Risk Cover' END, CASE WHEN merged THEN 'Surveyor' END, 'Total Sum Insured') AS shape,
    8 + CAST(cover AS INT) + CAST(merged AS INT) AS width FROM d),
g AS (SELECT shape, count(*) AS n_rows, any_value(width) AS width, min(k) AS first_doc, row_number() OVER (ORDER BY count(*) DESC, any_value(width) DESC, min(k)) AS group_no FROM v WHERE ok GROUP BY shape),
cell AS (
  SELECT k, shape, x.c AS col_no, x.h AS header, x.v AS value FROM (
    SELECT k, shape, unnest([{'c': 0, 'h': 'Ref No', 'v': CAST(k AS VARCHAR)}, {'c': 1, 'h': 'Claim No', 'v': claim}, {'c': 4, 'h': 'Reinsurer', 'v': who}, {'c': 10, 'h': 'Risk Cover', 'v': CASE WHEN cover THEN pr END},
      {'c': 12, 'h': 'Currency', 'v': 'IDR'}, {'c': 13, 'h': 'Total Sum Insured', 'v': amt}, {'c': 14, 'h': 'Date of Loss', 'v': dt}, {'c': 17, 'h': 'Appointed Adjuster', 'v': st}, {'c': 23, 'h': 'Remarks', 'v': remarks},
      {'c': 24, 'h': 'Surveyor', 'v': CASE WHEN merged THEN pr END}, {'c': 24 + CAST(merged AS INT), 'h': 'Sumber PDF', 'v': CAST(k AS VARCHAR)}]) AS x FROM v WHERE ok) WHERE x.v IS NOT NULL)
"""
_NOTES = """, claims AS (SELECT claim, k, count(*) OVER (PARTITION BY claim) AS n FROM d WHERE ok),
note AS (SELECT 1 AS note_no, group_no AS place, 'Table ' || group_no || ': ' || n_rows || ' rows, ' || width || ' parameters' AS detail FROM g WHERE (SELECT count(*) FROM g) > 1
  UNION ALL SELECT 2, k, claim || ': ' || k FROM claims WHERE n > 1
  UNION ALL SELECT 3, 0, 'Surveyor' WHERE EXISTS (SELECT 1 FROM d WHERE ok AND merged)
  UNION ALL SELECT 4, k, k || ' - 2 advice; skipped: ?' FROM d WHERE ok AND split
  UNION ALL SELECT 6, k, k || ' - without: ' || concat_ws(', ', 'Class of Business', 'Address', 'Policy No.', 'Insured Name', 'Insurance Period', 'Serial No', 'Engine No', CASE WHEN NOT cover THEN 'Risk Cover' END, 'Insured Interest', 'Place of Loss', 'Cause of Loss', 'Nett Amount', 'Your Share on Nett Loss', 'Description of Loss') FROM d WHERE ok)
"""
_AUDIT = """, amounts AS (SELECT k, unnest([{'c': 30, 'h': 'Definite Claim Amount', 'v': '1,600'}, {'c': 31, 'h': 'Your Share on Nett Loss', 'v': CAST(k % 50 AS VARCHAR)}]) AS x FROM d WHERE ok AND k % 10 = 2),
compared AS (
  SELECT CAST(k AS VARCHAR) AS name, CAST(col_no AS BIGINT) AS col_no, header, CASE WHEN header = 'Surveyor' THEN '' ELSE value END AS want, CASE WHEN header = 'Claim No' AND k % 17 = 0 THEN 'Z' ELSE '' END || value AS got
  FROM cell WHERE k % 10 <> 1 AND header <> 'Sumber PDF'
  UNION ALL SELECT CAST(k AS VARCHAR), x.c, x.h, '', x.v FROM amounts),
ratio AS (SELECT CAST(k AS VARCHAR) AS name, k % 50 = 0 OR CAST(k % 50 AS INT) * 625 % 100 <> 0 AS odd FROM d WHERE ok AND k % 10 = 2)
"""
_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
c AS (SELECT doc_id, line_no, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS line FROM l)
"""
_WORDS = """WITH RECURSIVE w AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 500 AS DOUBLE) AS x, l_linenumber * 4 + l_quantity / 10 AS y, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS word FROM lineitem)
"""
_TAKES = """WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS m, format('{:,.2f}', o_totalprice) AS n FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN 'IDR' WHEN 1 THEN 'USD' ELSE '' END AS currency, CASE m WHEN 3 THEN '' ELSE n END AS amount,
  CASE m WHEN 1 THEN '10' WHEN 3 THEN '' ELSE n END AS first_number, CASE m WHEN 1 THEN '7' WHEN 3 THEN '' ELSE n END AS last_number,
  CASE m WHEN 0 THEN 'Sum' WHEN 1 THEN '10% of' WHEN 2 THEN n ELSE 'none' END AS text_only,
  CASE m WHEN 0 THEN 'Sum  (' || n || ')' WHEN 1 THEN '10' WHEN 2 THEN n ELSE 'none' END AS stripped FROM t"""

ORACLE_SQL = {
    "slice_reference_amount": _D + "SELECT k AS doc_id, CAST(k AS VARCHAR) AS ref_no, 'IDR' AS currency, amt AS sum_insured FROM d",
    "w1_pairs": _D
    + """SELECT k AS doc_id, x.p AS page_no, x.l AS label, x.v AS value FROM (SELECT k, unnest([{'p': 1::BIGINT, 'l': 'Ref No', 'v': CAST(k AS VARCHAR)}, {'p': 1, 'l': 'Claim No', 'v': claim}, {'p': 1, 'l': 'Reinsurer', 'v': who},
  {'p': 1, 'l': 'Risk Cover', 'v': CASE WHEN cover THEN pr END}, {'p': 1, 'l': 'Appointed Adjuster', 'v': st}, {'p': 1, 'l': 'Total Sum Insured', 'v': 'IDR ' || amt}, {'p': 1, 'l': 'Date of Loss', 'v': dt}, {'p': 1, 'l': 'Remarks', 'v': remarks},
  {'p': 2, 'l': 'Surveyor', 'v': CASE WHEN merged THEN pr END}, {'p': 3, 'l': 'Claim No', 'v': CASE WHEN split THEN 'X' || claim END}, {'p': 3, 'l': 'Risk Cover', 'v': CASE WHEN split THEN 'other' END},
  {'p': 3, 'l': 'Appointed Adjuster', 'v': CASE WHEN split THEN 'other' END}, {'p': 4, 'l': 'Ref No', 'v': CASE WHEN k % 13 = 3 THEN '0' END}]) AS x FROM d) WHERE x.v IS NOT NULL""",
    "w2_sections": _D
    + """SELECT k AS doc_id, CAST(0 AS BIGINT) AS section_no, 'DLA' AS kind, concat_ws('|', 'Ref No=' || k, 'Claim No=' || claim, 'Reinsurer=' || who, CASE WHEN cover THEN 'Risk Cover=' || pr END, 'Appointed Adjuster=' || st, 'Total Sum Insured=IDR ' || amt, 'Date of Loss=' || dt, 'Remarks=' || remarks, CASE WHEN merged THEN 'Surveyor=' || pr END) AS found FROM d
  UNION ALL SELECT k, 1, '?', 'Claim No=X' || claim || '|Risk Cover=other|Appointed Adjuster=other' FROM d WHERE split""",
    "w6_choice": _D
    + """SELECT k AS doc_id, ok, CASE WHEN ok THEN '' ELSE CASE WHEN split THEN 'advice' ELSE 'DLA' END || ' addressed to others: ' || who END AS reason, CASE WHEN ok AND split THEN '2 advice; skipped: ?' ELSE '' END AS note,
  CASE WHEN ok THEN 'DLA' ELSE '' END AS kind, CAST(1 + CAST(split AS INT) AS BIGINT) AS total, CAST(CASE WHEN ok THEN CAST(split AS INT) ELSE 1 + CAST(split AS INT) END AS BIGINT) AS other FROM d""",
    "f14_projection": _D + "SELECT k AS doc_id, CAST(col_no AS BIGINT) AS col_no, value FROM cell WHERE header NOT IN ('Surveyor', 'Sumber PDF')",
    "f15_shapes": _D + "SELECT k AS doc_id, shape, CASE WHEN merged THEN 'Surveyor' ELSE '' END AS extra, CAST(15 + CAST(NOT cover AS INT) AS BIGINT) AS n_missing FROM v WHERE ok",
    "a4_groups": _D + "SELECT group_no, 'DLA' AS kind, shape, n_rows, n_rows || ' DLA - ' || width || ' parameter' AS caption FROM g",
    "b6_cells": _D + "SELECT header, count(*) AS n, min(value) AS least, max(value) AS most FROM cell GROUP BY header",
    "o9_preview": _D + "SELECT group_no, r AS row_no, CAST(col_no AS BIGINT) AS col_no, header, value FROM (SELECT group_no, k, row_number() OVER (PARTITION BY group_no ORDER BY k) AS r FROM v JOIN g USING (shape) WHERE ok) JOIN cell USING (k) WHERE r <= 5",
    "k2_widths": _D + "SELECT CAST(col_no AS BIGINT) AS col_no, CAST(greatest(10, least(52, greatest(max(length(value)), max(length(header))) + 2)) AS BIGINT) AS width FROM cell GROUP BY col_no",
    "a5_duplicate_claims": _D + "SELECT claim, n, k AS doc_id FROM (SELECT claim, k, count(*) OVER (PARTITION BY claim) AS n FROM d WHERE ok) WHERE n > 1",
    "a3_reasons": _D + "SELECT CASE WHEN split THEN 'advice' ELSE 'DLA' END || ' addressed to others: ' || who AS reason, count(*) AS n, min(k) AS first_doc FROM d WHERE NOT ok GROUP BY 1",
    "a3_skipped_files": _D + """, r AS (SELECT k, CASE WHEN split THEN 'advice' ELSE 'DLA' END || ' addressed to others: ' || who AS reason FROM d WHERE NOT ok)
SELECT reason, count(*) OVER w AS n, min(k) OVER w AS first_doc, k AS doc_id FROM r WINDOW w AS (PARTITION BY reason)""",
    "b4_notes": _D + _NOTES + """
SELECT CAST(note_no AS BIGINT) AS note_no, CASE WHEN note_no = 2 THEN 'warn' ELSE 'info' END AS level, count(*) AS n_details,
  CASE note_no WHEN 1 THEN 'The result is split into ' || count(*) || ' tables.' WHEN 2 THEN count(DISTINCT split_part(detail, ':', 1)) || ' claims occur more than once (' || count(*) || ' rows); all are kept.'
    WHEN 3 THEN count(*) || ' labels outside the profile JRP are columns too.' WHEN 4 THEN count(*) || ' files hold more than one notice; ours was taken.' ELSE count(*) || ' files lack some labels.' END AS text
FROM note GROUP BY note_no""",
    "b4_note_details": _D + _NOTES + "SELECT CAST(note_no AS BIGINT) AS note_no, CAST(place AS BIGINT) AS place, detail FROM note",
    "w6_letterheads": """WITH d AS (SELECT o_orderkey AS k, format('{:,.2f}', o_totalprice) AS amt, o_orderkey % 8 = 3 AND o_orderkey % 6 <> 1 AS again, o_orderkey % 6 AS h FROM orders),
t AS (SELECT *, h > 1 AND NOT again AS ok FROM d)
SELECT k AS doc_id, CASE WHEN again THEN '2 DLA addressed to us' WHEN h = 0 THEN 'no letterhead names the addressee' WHEN h = 1 THEN 'DLA addressed to others: PT Reasuransi Lain' ELSE '' END AS reason, CAST(1 + CAST(again AS INT) AS BIGINT) AS total,
  CASE WHEN ok AND k % 4 <> 0 THEN 'R-' || k END AS reference, CASE WHEN ok THEN 'PT Asuransi Astra' END AS letterhead, CASE WHEN ok THEN 'IDR ' || amt END AS sum_insured, CASE WHEN ok THEN 'IDR ' || k END AS expense,
  CASE WHEN ok THEN 'IDR ' || k END AS indemnity, CASE WHEN ok THEN '' END AS loss, CASE WHEN ok THEN 'USD ' || k END AS share FROM t""",
    "w7_audit_pairs": _D
    + """SELECT k AS doc_id, x.p AS page_no, x.l AS label, x.v AS value FROM (SELECT k, unnest([{'p': 1::BIGINT, 'l': 'Ref No', 'v': CAST(k AS VARCHAR)}, {'p': 1, 'l': 'Claim No', 'v': claim}, {'p': 1, 'l': 'Reinsurer', 'v': who},
  {'p': 1, 'l': 'Risk Cover', 'v': CASE WHEN cover THEN pr END}, {'p': 1, 'l': 'Appointed Adjuster', 'v': st}, {'p': 1, 'l': 'Total Sum Insured', 'v': 'IDR ' || amt}, {'p': 1, 'l': 'Date of Loss', 'v': dt}, {'p': 1, 'l': 'Remarks', 'v': remarks},
  {'p': 1, 'l': '%s', 'v': CASE WHEN k %% 3 = 0 THEN '5' END}, {'p': 2, 'l': 'Surveyor', 'v': CASE WHEN merged THEN pr END}, {'p': 3, 'l': 'Claim No', 'v': CASE WHEN split THEN 'X' || claim END}, {'p': 3, 'l': 'Risk Cover', 'v': CASE WHEN split THEN 'other' END},
  {'p': 3, 'l': 'Appointed Adjuster', 'v': CASE WHEN split THEN 'other' END}, {'p': 4, 'l': 'Ref No', 'v': CASE WHEN k %% 13 = 3 THEN '0' END}]) AS x FROM d) WHERE x.v IS NOT NULL"""
    % "x1 2 3-4",
    "w8_audit_advice": _D + "SELECT CAST(k AS VARCHAR) AS name, claim, concat_ws('|', 'Ref No', 'Claim No', 'Reinsurer', CASE WHEN cover THEN 'Risk Cover' END, 'Appointed Adjuster', CASE WHEN k % 3 = 0 THEN 'x1 2 3-4' END, 'Total Sum Insured', 'Date of Loss', 'Remarks') AS labels FROM d WHERE ok",
    "f22_expected": _D + _AUDIT + "SELECT name, col_no, header, want, got FROM compared",
    "a9_differences": _D + _AUDIT + """, x AS (SELECT * FROM compared WHERE want <> got), h AS (SELECT header, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min((name, col_no))) AS header_no FROM x GROUP BY header)
SELECT * FROM (SELECT header, n, header_no, row_number() OVER (PARTITION BY header ORDER BY name, col_no) AS place, name, want, got FROM x JOIN h USING (header)) WHERE place <= 3""",
    "o8_first_names": _D + _AUDIT + """SELECT * FROM (SELECT 'missing' AS state, CAST(k AS VARCHAR) AS name FROM d WHERE ok AND k % 10 = 1 ORDER BY name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'extra' AS state, CAST(k AS VARCHAR) AS name FROM d WHERE NOT ok AND k % 10 = 5 ORDER BY name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'odd' AS state, name FROM ratio WHERE odd ORDER BY name LIMIT 8)""",
    "b11_verdict": _D + _AUDIT + """, n AS (SELECT (SELECT count(*) FROM d WHERE ok) AS letters, (SELECT count(*) FROM d WHERE ok AND k % 10 <> 1 OR NOT ok AND k % 10 = 5) AS rows_, (SELECT count(*) FROM d WHERE ok AND k % 10 = 1) AS missing, (SELECT count(*) FROM d WHERE NOT ok AND k % 10 = 5) AS extra,
  (SELECT count(*) FROM compared) AS compared, (SELECT count(*) FROM compared WHERE want <> got) AS differing, (SELECT count(*) FROM ratio WHERE odd) AS odd)
SELECT *, missing + extra + differing + odd = 0 AS clean FROM n""",
    "a2_summary": _D
    + """SELECT count(*) AS files, count(*) FILTER (WHERE ok) AS done, count(*) FILTER (WHERE NOT ok) AS skipped, CAST(sum(1 + CAST(split AS INT)) AS BIGINT) AS notices, count(*) FILTER (WHERE ok) AS ours,
  CAST(sum(CASE WHEN ok THEN CAST(split AS INT) ELSE 1 + CAST(split AS INT) END) AS BIGINT) AS others, count(*) FILTER (WHERE ok AND split) AS noted, (SELECT count(*) FROM g) AS tables, (SELECT CAST(sum(n_rows) AS BIGINT) FROM g) AS n_rows FROM d""",
    "a6_extra_labels": _D + "SELECT 'Surveyor' AS label, count(*) AS files FROM d WHERE ok AND merged HAVING count(*) > 0",
    "j1_missing_labels": _D
    + """SELECT label, CAST(n AS BIGINT) AS files FROM (
  SELECT unnest(['Class of Business', 'Address', 'Policy No.', 'Insured Name', 'Insurance Period', 'Serial No', 'Engine No', 'Insured Interest', 'Place of Loss', 'Cause of Loss', 'Nett Amount', 'Your Share on Nett Loss', 'Description of Loss']) AS label, (SELECT count(*) FROM d WHERE ok) AS n
  UNION ALL SELECT 'Risk Cover', (SELECT count(*) FROM d WHERE ok AND NOT cover)) WHERE n > 0""",
    "p12_detection": _D + "SELECT CASE WHEN cover OR split THEN 'jrp' ELSE '' END AS profile, count(*) AS files FROM d GROUP BY 1",
    "j4_audit": _D
    + """, w AS (SELECT k, unnest(['Ref No', 'Claim No', 'Reinsurer', 'Risk Cover', 'Currency', 'Total Sum Insured', 'Date of Loss', 'Appointed Adjuster', 'Remarks', 'Surveyor']) AS header, cover, merged, k % 10 <> 1 AS planned, ok AS mine, k % 17 = 0 AS altered FROM d),
u AS (SELECT *, planned AND header <> 'Surveyor' AND (cover OR header <> 'Risk Cover') AS wanted, mine AND (cover OR header <> 'Risk Cover') AND (merged OR header <> 'Surveyor') AS got FROM w),
s AS (SELECT header, k, CASE WHEN wanted AND NOT got THEN 'missing' WHEN got AND NOT wanted THEN 'extra' WHEN got AND header = 'Claim No' AND altered THEN 'diff' WHEN got THEN 'same' END AS state FROM u)
SELECT header, state, count(*) AS n, min(k) AS first_name FROM s WHERE state IS NOT NULL GROUP BY header, state""",
    "a10_ratios": """WITH r AS (SELECT round(CAST(CAST(trunc(l_discount * 100) AS INT) AS DOUBLE) / l_quantity * 100, 4) AS pct FROM lineitem WHERE l_quantity <> 0)
SELECT pct, count(*) AS n, CAST(max(CAST(pct <= 0 OR pct > 100 OR abs(pct * 100 - round(pct * 100)) > 1e-6 AS INT)) AS BIGINT) AS odd FROM r GROUP BY pct""",
    "o7_top_ratios": """WITH r AS (SELECT l_orderkey, l_linenumber, round(CAST(CAST(trunc(l_discount * 100) AS INT) AS DOUBLE) / l_quantity * 100, 4) AS pct FROM lineitem WHERE l_quantity <> 0)
SELECT pct, count(*) AS n FROM r GROUP BY pct ORDER BY n DESC, min((l_orderkey, l_linenumber)) LIMIT 6""",
    "s4_banding": _WORDS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, word) AS i FROM w),
b AS (SELECT doc_id, i, x, word, y AS anchor, CAST(1 AS BIGINT) AS line_no FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, o.x, o.word, CASE WHEN abs(o.y - b.anchor) > 3 THEN o.y ELSE b.anchor END, b.line_no + CAST(abs(o.y - b.anchor) > 3 AS INT) FROM b JOIN o ON o.doc_id = b.doc_id AND o.i = b.i + 1)
SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY x, word) AS text FROM b GROUP BY doc_id, line_no""",
    "f20_bands": _WORDS + "SELECT doc_id, CAST(round_even(y / 3, 0) AS BIGINT) AS band, string_agg(word, ' ' ORDER BY x, word) AS text FROM w GROUP BY 1, 2",
    "s7_scanned_pages": _LINES
    + """, p AS (SELECT doc_id, unnest(range(0, count(*) // 2 + 1)) AS page_no FROM c GROUP BY doc_id)
SELECT p.doc_id, p.page_no, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS chars FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.line_no // 2 = p.page_no GROUP BY 1, 2 HAVING coalesce(sum(length(line)), 0) < 120""",
    "p1_line_tests": _LINES
    + """SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '^[A-Z]{40,}$') OR regexp_matches(line, '^\\s*,?\\s*\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}\\s*$') OR regexp_matches(line, '(?i)page \\d+ of \\d+|for and on behalf of')) AS junk,
  count(*) FILTER (WHERE regexp_matches(line, '^[A-Za-z][A-Za-z0-9 ./&''%()\\-]{1,38}?\\s*:\\s*.*$')) AS pairs, count(*) FILTER (WHERE regexp_matches(line, '^[A-Z][A-Za-z .]{2,24},\\s+(?:\\d{1,2}\\s+\\w+\\s+\\d{4}|\\w+\\s+\\d{1,2},\\s+\\d{4})\\s*$')) AS closes,
  max(length(line)) AS longest FROM c WHERE line <> '' GROUP BY doc_id""",
    "p15_headings": _LINES
    + """, h AS (SELECT doc_id, regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i
  FROM l JOIN c USING (doc_id, line_no) WHERE c.line <> '')
SELECT d.doc_id, count(h.line) AS n, md5(coalesce(string_agg(h.line, '|' ORDER BY h.i), '')) AS heads_md5 FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id AND h.i <= 6 GROUP BY d.doc_id""",
    "f_takes": _TAKES,
    "o12_difference": "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "o15_dedupe": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
}

QUERIES |= file_queries.QUERIES
ORACLE_SQL |= file_queries.oracle_sql(_D, _NOTES)
