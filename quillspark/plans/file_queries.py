"""Queries over files, their names and their errors, tables in one sheet, and many
names or profiles; and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import naming as N
from ..operators import results as R
from ..sources import files
from ..sources.dossier import archives, damaged_letters, letter_lines, packed, uploads
from ..sources.profiles import mark_table
from ..sources.shared import new_folder
from ..sources.workbook import report_json
from ..streaming import expiry
from . import batch as B


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def j7_names_in_documents(spark, sf_dir):
    """Every ending of a customer's name that a document contains."""
    c = _read(spark, sf_dir, "customer")
    names = c.select(F.right("c_name", F.lit(4)).alias("name")).union(c.select(F.right("c_name", F.lit(3))))
    return M.names_found(_read(spark, sf_dir, "documents").select("doc_id", "text"), names)


def j7_addressees(spark, sf_dir):
    """Per order, how many short names of customers its addressee contains, and which are the first and the last."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("PT CUSTOMER#"), F.col("o_custkey").cast("string"), F.lit(" & Co")).alias("text"))
    names = _read(spark, sf_dir, "customer").select(F.concat(F.lit("Customer#"), F.col("c_custkey").cast("string")).alias("name"))
    return M.names_found(o, names).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def _marks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels of orders from their items, and a set of marks for each part; four
    parts share their rarest mark."""
    text = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    li, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    labels = F.array(text("P", F.floor(F.col("l_partkey") / 4)), text("S", F.col("l_suppkey") % 25), text("Q", (F.col("l_quantity") % 7).cast("int")))
    third = F.when(F.col("p_partkey") % 3 == 0, text("Q", F.col("p_partkey") % 7))
    marks = F.array_compact(F.array(text("P", F.floor(F.col("p_partkey") / 4)), text("S", F.col("p_size") % 25), third))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.explode(labels).alias("label")), part.select(F.col("p_partkey").alias("profile"), F.explode(marks).alias("mark"))


def j8_contained(spark, sf_dir):
    return M.contained(*_marks(spark, sf_dir))


def j8_sole_profile(spark, sf_dir):
    t = M.sole_profile(*_marks(spark, sf_dir))
    return t.select("doc_id", "n_profiles", F.coalesce(F.col("profile").cast("string"), F.lit("")).alias("profile"))


def s10_admission(spark, sf_dir):
    """Places, running bytes, overwriting and limits of all uploads."""
    return files.admission(uploads(spark, sf_dir))


def s9_names(spark, sf_dir):
    """The name that each upload gets where all of them are unpacked into one folder."""
    return N.unique_names(uploads(spark, sf_dir).select("seq", "name")).select("seq", "name", "own")


def s9_archives(spark, sf_dir):
    """What archives made of the documents hold, with the names of their one folder."""
    t = files.unpacked(archives(spark, sf_dir))
    return t.select("archive", F.col("seq").alias("member_no"), "name", "size", F.md5("content").alias("content_md5"))


def s10_listing(spark, sf_dir):
    """All files of a request in order: uploads that overwrite, members that are renamed."""
    return files.listing(uploads(spark, sf_dir), packed(spark, sf_dir), most=1 << 40).select("place", "seq", F.col("at").alias("member_no"), "name", "read_seq")


def o17_first_detection(spark, sf_dir):
    """The first letter that exactly one profile fits; in the first half of the order one mark is missing."""
    half = _read(spark, sf_dir, "orders").agg(F.floor(F.max("o_orderkey") / 2)).first()[0]
    early = (F.col("doc_id") < F.lit(half)) & F.col("text").startswith("Ref No")
    lines = letter_lines(spark, sf_dir).withColumn("text", F.when(early, F.concat(F.lit("Reference"), F.substring("text", 7, 1000))).otherwise(F.col("text")))
    hit = B.first_detection(lines, mark_table(spark))
    return spark.createDataFrame([hit] if hit else [], "doc_id long, profile string")


def _stored(spark, sf_dir) -> B.Batch:
    return B.run(letter_lines(spark, sf_dir), "jrp").stored()


def b6_tables(spark, sf_dir):
    """Every row of every table as one object, with its table's schema."""
    t = _stored(spark, sf_dir).tables
    return t.join(R.table_schemas(t), "group_no").select(F.col("group_no").cast("long").alias("group_no"), "doc_id", F.to_json("row").alias("row"), "schema")


def o16_sheet(spark, sf_dir):
    """All cells of the sheet in which the tables are stacked."""
    return _stored(spark, sf_dir).sheet


def k4_report(spark, sf_dir):
    return report_json(_stored(spark, sf_dir)).select(F.substring("section", 3, 20).alias("section"), "place", "json")


def _damaged(spark, sf_dir) -> B.Batch:
    printed, recognised, names, errors = damaged_letters(spark, sf_dir)
    return B.run(files.with_recognised(printed, recognised), "jrp", names, errors)


def s8_lines(spark, sf_dir):
    """Lines of the letters some of whose pages were recognised, by page."""
    printed, recognised, _, _ = damaged_letters(spark, sf_dir)
    t = files.with_recognised(printed, recognised)
    return t.groupBy("doc_id", F.col("page_no").cast("long").alias("page_no"), "from_ocr").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


def b5_file_errors(spark, sf_dir):
    """The choice of each file where some can't be opened, have no text or were recognised."""
    return _damaged(spark, sf_dir).chosen.select("doc_id", "ok", "reason", "note", "kind", F.col("total").cast("long").alias("total"), F.col("other").cast("long").alias("other"), "from_ocr")


def p13_views(spark, sf_dir):
    return R.views(_damaged(spark, sf_dir).chosen)


def a3_error_reasons(spark, sf_dir):
    return R.reasons(_damaged(spark, sf_dir).chosen).select("reason", "n", "first_doc")


def b4_recognised_notes(spark, sf_dir):
    return _damaged(spark, sf_dir).stored().notes.select(F.col("note_no").cast("long").alias("note_no"), "level", "text", "n_details")


def b2_detected_batch(spark, sf_dir):
    """A batch under an unknown key: the detected profile, its files and notices."""
    b = B.run(letter_lines(spark, sf_dir), "nobody")
    return b.chosen.agg(F.lit(b.profile.key).alias("profile"), F.count("*").alias("files"), F.count_if("ok").alias("done"), F.sum("total").alias("notices"))


def b3_rejected(spark, sf_dir):
    """Whether a batch is rejected: the letters as they are, and all of them addressed to another."""
    lines = letter_lines(spark, sf_dir)
    other = lines.withColumn("text", F.when(F.col("text").startswith("Reinsurer"), "Reinsurer : PT Reasuransi Lain").otherwise(F.col("text")))
    one = lambda name, t: R.rejection(B.run(t, "jrp").chosen).select(F.lit(name).alias("batch"), "files", "done", "rejected")
    return one("ours", lines).unionAll(one("another's", other))


def b9_expiry(spark, sf_dir):
    """What events that aren't purchases can still read of their user's last purchase, as a stream; results live fifteen hours."""
    # A stream reads folders; as a pattern the path may also name one file.
    events = spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("makes"))
    at = new_folder(spark)
    expiry.written(expiry.reads(rows, 900), f"{at}/rows", f"{at}/state")
    return spark.read.schema(expiry.READS).parquet(f"{at}/rows").select("key", "event_id", F.coalesce(F.unix_micros("made_at"), F.lit(-1)).alias("made_at"), "live")


QUERIES = {f.__name__: f for f in (j7_names_in_documents, j7_addressees, j8_contained, j8_sole_profile, s10_admission, s10_listing, s9_names, s9_archives, o17_first_detection, b6_tables, o16_sheet, k4_report, s8_lines, b5_file_errors, p13_views, a3_error_reasons, b4_recognised_notes, b2_detected_batch, b3_rejected, b9_expiry)}


_UPLOADS = """WITH RECURSIVE u AS (SELECT event_id AS seq, 'scan ' || user_id || CASE event_id % 7 WHEN 0 THEN ' (2)' WHEN 1 THEN ' (3)' WHEN 2 THEN ' (2) (2)' WHEN 3 THEN ' (12)' ELSE '' END || CASE event_type WHEN 'error' THEN '.txt' WHEN 'click' THEN '.ZIP' ELSE '.pdf' END AS name,
  CAST(floor(value * 1000) AS BIGINT) + CASE WHEN event_id % 997 = 0 THEN 16 * 1048576 ELSE 0 END AS size FROM events)
"""
_MARKS = """WITH l AS (SELECT DISTINCT l_orderkey AS doc_id, unnest(['P' || l_partkey // 4, 'S' || l_suppkey % 25, 'Q' || CAST(l_quantity AS INT) % 7]) AS label FROM lineitem),
m AS (SELECT DISTINCT p_partkey AS profile, unnest(['P' || p_partkey // 4, 'S' || p_size % 25] || CASE WHEN p_partkey % 3 = 0 THEN ['Q' || p_partkey % 7] ELSE [] END) AS mark FROM part),
c AS (SELECT doc_id, m.profile FROM m JOIN l ON l.label = m.mark JOIN (SELECT profile, count(*) AS n FROM m GROUP BY profile) s ON s.profile = m.profile GROUP BY doc_id, m.profile HAVING count(*) = any_value(n))
"""


def oracle_sql(letters: str, notes: str) -> dict[str, str]:
    """letters, notes: the SQL that the letters' own queries begin with."""
    broken = "o_orderkey % 5 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 31 <> 0 AND o_orderkey % 23 <> 0 AS ok"
    damaged = letters.replace("o_orderkey % 5 <> 0 AS ok", broken)
    choice = damaged + """, e AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'can''t be opened: broken at ' || k WHEN k % 31 = 0 THEN 'recognition failed: engine stopped' WHEN k % 23 = 0 THEN 'no text that can be read'
  WHEN NOT ok THEN CASE WHEN split THEN 'advice' ELSE 'DLA' END || ' addressed to others: ' || who ELSE '' END AS reason, k % 19 <> 0 AND k % 31 <> 0 AND k % 23 <> 0 AS fine FROM d)
"""
    said = """CASE note_no WHEN 1 THEN 'The result is split into ' || count(*) || ' tables.' WHEN 2 THEN count(DISTINCT split_part(detail, ':', 1)) || ' claims occur more than once (' || count(*) || ' rows); all are kept.'
    WHEN 3 THEN count(*) || ' labels outside the profile JRP are columns too.' WHEN 4 THEN count(*) || ' files hold more than one notice; ours was taken.' WHEN 5 THEN count(*) || ' files without text were read by recognition.' ELSE count(*) || ' files lack some labels.' END"""
    places = letters + """, h AS (SELECT *, CAST((SELECT count(*) > 1 FROM g) AS INT) AS captioned FROM g),
s AS (SELECT *, CAST(coalesce(sum(captioned + 3 + n_rows) OVER (ORDER BY group_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 1 AS start FROM h),
w AS (SELECT shape, col_no, header, row_number() OVER (PARTITION BY shape ORDER BY col_no) AS place FROM (SELECT DISTINCT shape, col_no, header FROM cell)),
r AS (SELECT k, shape, row_number() OVER (PARTITION BY shape ORDER BY k) AS row_no FROM v WHERE ok)
"""
    report = letters + notes + f""", r AS (SELECT k, CASE WHEN split THEN 'advice' ELSE 'DLA' END || ' addressed to others: ' || who AS reason FROM d WHERE NOT ok),
t AS (SELECT group_no, v.k, row_number() OVER (PARTITION BY group_no ORDER BY v.k) AS row_no FROM v JOIN g USING (shape) WHERE ok),
p AS (SELECT group_no, string_agg('{{"row_no":' || row_no || ',"col_no":' || col_no || ',"header":"' || header || '","value":"' || value || '"}}', ',' ORDER BY row_no, col_no) AS preview FROM t JOIN cell USING (k) WHERE row_no <= 5 GROUP BY group_no)
SELECT 'summary' AS section, CAST(0 AS BIGINT) AS place, '{{"company":"JRP","files":' || count(*) || ',"done":' || count(*) FILTER (WHERE ok) || ',"skipped":' || count(*) FILTER (WHERE NOT ok) || ',"notices":' || CAST(sum(1 + CAST(split AS INT)) AS BIGINT) || ',"ours":' || count(*) FILTER (WHERE ok) || ',"others":'
    || CAST(sum(CASE WHEN ok THEN CAST(split AS INT) ELSE 1 + CAST(split AS INT) END) AS BIGINT) || ',"noted":' || count(*) FILTER (WHERE ok AND split) || ',"tables":' || (SELECT count(*) FROM g) || ',"n_rows":' || (SELECT CAST(sum(n_rows) AS BIGINT) FROM g) || '}}' AS json FROM d
UNION ALL SELECT 'group', group_no, '{{"caption":"' || n_rows || ' DLA - ' || width || ' parameter","rows":' || n_rows || ',"preview":[' || preview || ']}}' FROM g JOIN p USING (group_no)
UNION ALL SELECT 'note', note_no, '{{"level":"' || CASE WHEN note_no = 2 THEN 'warn' ELSE 'info' END || '","text":"' || {said} || '"}}' FROM note GROUP BY note_no
UNION ALL SELECT 'note detail', place, '{{"note_no":' || note_no || ',"detail":"' || detail || '"}}' FROM note
UNION ALL SELECT 'skipped', k, '{{"reason":"' || reason || '","n":' || count(*) OVER (PARTITION BY reason) || ',"doc_id":' || k || '}}' FROM r"""
    return {
        "j7_names_in_documents": "SELECT doc_id, name FROM documents JOIN (SELECT lower(right(c_name, 4)) AS name FROM customer UNION SELECT lower(right(c_name, 3)) FROM customer) ON contains(lower(text), name)",
        "j7_addressees": """WITH n AS (SELECT 'customer#' || c_custkey AS name FROM customer), t AS (SELECT DISTINCT o_custkey, 'pt customer#' || o_custkey || ' & co' AS text FROM orders),
h AS (SELECT o_custkey, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM t JOIN n ON contains(text, name) GROUP BY o_custkey)
SELECT o_orderkey AS doc_id, n, first_name, last_name FROM orders JOIN h USING (o_custkey)""",
        "j8_contained": _MARKS + "SELECT doc_id, profile FROM c",
        "j8_sole_profile": _MARKS + "SELECT doc_id, count(*) AS n_profiles, CASE WHEN count(*) = 1 THEN CAST(min(profile) AS VARCHAR) ELSE '' END AS profile FROM c GROUP BY doc_id",
        "s10_admission": _UPLOADS + """, a AS (SELECT *, lower(right(name, 3)) AS kind FROM u WHERE lower(right(name, 4)) IN ('.pdf', '.zip')),
t AS (SELECT *, row_number() OVER (ORDER BY seq) AS place, CAST(sum(size) OVER (ORDER BY seq) AS BIGINT) AS total, max(seq) OVER (PARTITION BY name) AS last FROM a)
SELECT seq, name, size, kind, place, total, CASE WHEN kind = 'pdf' THEN last ELSE seq END AS read_seq,
  CASE WHEN kind = 'pdf' AND size > 15 * 1048576 THEN 'file too large' WHEN kind = 'zip' AND size > 200 * 1048576 THEN 'archive too large' WHEN total > 400 * 1048576 THEN 'batch too large' END AS error FROM t""",
        "s9_names": _UPLOADS + """, f AS (SELECT seq, name, regexp_extract(name, '^(.*)(\\.[A-Za-z]+)$', 1) AS stem, regexp_extract(name, '(\\.[A-Za-z]+)$', 1) AS ext FROM u),
q AS (SELECT *, regexp_replace(stem, '( \\([0-9]+\\))+$', '') || ext AS root FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq) AS i FROM q),
s AS (SELECT root, seq, name, i, name AS own, [name] AS taken FROM o WHERE i = 1
  UNION ALL SELECT root, seq, name, i, own, list_append(taken, own) FROM (SELECT o.root, o.seq, o.name, o.i, s.taken, CASE WHEN NOT list_contains(s.taken, o.name) THEN o.name
    ELSE list_filter(list_transform(range(2, len(s.taken) + 3), lambda n: o.stem || ' (' || n || ')' || o.ext), lambda x: NOT list_contains(s.taken, x))[1] END AS own FROM s JOIN o ON o.root = s.root AND o.i = s.i + 1))
SELECT seq, name, own FROM s""",
        "s9_archives": """WITH RECURSIVE m AS (SELECT doc_id, printf('archive-%012d.zip', doc_id // 20) AS archive, source || CASE doc_id % 5 WHEN 1 THEN ' (2)' WHEN 2 THEN ' (3)' ELSE '' END AS stem, encode(coalesce(text, '')) AS raw, coalesce(text, '') AS text FROM documents WHERE doc_id % 17 <> 3 AND doc_id % 11 <> 4),
o AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY doc_id) - 1 AS member_no, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, regexp_replace(stem, ' \\([0-9]+\\)$', '') AS root FROM (SELECT m.*, regexp_replace(stem, ' \\([0-9]+\\)$', '') AS source FROM m)),
s AS (SELECT root, i, archive, member_no, doc_id, stem || '.pdf' AS own, [stem || '.pdf'] AS taken FROM o WHERE i = 1
  UNION ALL SELECT root, i, archive, member_no, doc_id, own, list_append(taken, own) FROM (SELECT o.root, o.i, o.archive, o.member_no, o.doc_id, s.taken, CASE WHEN NOT list_contains(s.taken, o.stem || '.pdf') THEN o.stem || '.pdf'
    ELSE list_filter(list_transform(range(2, len(s.taken) + 3), lambda n: o.stem || ' (' || n || ').pdf'), lambda x: NOT list_contains(s.taken, x))[1] END AS own FROM s JOIN o ON o.root = s.root AND o.i = s.i + 1))
SELECT s.archive, CAST(s.member_no AS BIGINT) AS member_no, own AS name, CAST(octet_length(raw) AS BIGINT) AS size, md5(text) AS content_md5 FROM s JOIN m USING (doc_id)""",
        "s10_listing": _UPLOADS + """, f AS (SELECT seq, CAST(0 AS BIGINT) AS member_no, name, true AS fixed FROM u WHERE lower(right(name, 4)) = '.pdf'
  UNION ALL SELECT event_id, x.member_no, 'scan ' || user_id || x.b || '.pdf', false FROM (SELECT event_id, user_id, unnest([{'member_no': 0::BIGINT, 'b': ''}, {'member_no': 1, 'b': CASE WHEN event_id % 2 = 0 THEN ' (2)' ELSE '' END}]) AS x FROM events WHERE event_type = 'click')),
q AS (SELECT *, left(name, length(name) - 4) AS stem, regexp_replace(left(name, length(name) - 4), '( \\([0-9]+\\))+$', '') AS root FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq, member_no) AS i FROM q),
s AS (SELECT root, i, seq, member_no, fixed, name AS own, [name] AS taken FROM o WHERE i = 1
  UNION ALL SELECT root, i, seq, member_no, fixed, own, list_append(taken, own) FROM (SELECT o.root, o.i, o.seq, o.member_no, o.fixed, s.taken, CASE WHEN o.fixed OR NOT list_contains(s.taken, o.name) THEN o.name
    ELSE list_filter(list_transform(range(2, len(s.taken) + 3), lambda n: o.stem || ' (' || n || ').pdf'), lambda x: NOT list_contains(s.taken, x))[1] END AS own FROM s JOIN o ON o.root = s.root AND o.i = s.i + 1))
SELECT row_number() OVER (ORDER BY seq, member_no) AS place, seq, member_no, own AS name, CAST(greatest(seq, coalesce(max(CASE WHEN fixed THEN seq END) OVER (PARTITION BY own), seq)) AS BIGINT) AS read_seq FROM s""",
        "o17_first_detection": letters + "SELECT min(k) AS doc_id, 'jrp' AS profile FROM d WHERE k >= (SELECT max(o_orderkey) // 2 FROM orders) AND (cover OR split) HAVING min(k) IS NOT NULL",
        "b6_tables": letters + """, t AS (SELECT k, any_value(shape) AS shape, '{' || string_agg('"' || printf('%03d', col_no) || ' ' || header || '":"' || value || '"', ',' ORDER BY col_no) || '}' AS row,
  'OBJECT<' || string_agg('`' || printf('%03d', col_no) || ' ' || header || '`: STRING', ', ' ORDER BY col_no) || '>' AS schema FROM cell GROUP BY k)
SELECT group_no, k AS doc_id, row, schema FROM t JOIN g USING (shape)""",
        "o16_sheet": places + """SELECT start AS sheet_row, CAST(1 AS BIGINT) AS col_no, 'Tabel ' || group_no || ' - ' || n_rows || ' DLA - ' || width || ' parameter' AS value FROM s WHERE captioned = 1
UNION ALL SELECT start + captioned, place, header FROM s JOIN w USING (shape)
UNION ALL SELECT start + captioned + row_no, place, value FROM cell JOIN r USING (k, shape) JOIN w USING (shape, col_no) JOIN s USING (shape)""",
        "k4_report": report,
        "s8_lines": letters + """, p AS (SELECT k, x.p AS page_no, x.n AS n, x.c AS chars FROM (SELECT d.*, unnest([{'p': 1::BIGINT, 'n': 9 + CAST(cover AS INT) + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 2 ELSE 0 END,
    'c': 23 + length('Ref No : ' || k) + length('Claim No :' || claim) + length('Reinsurer : ' || who) + CASE WHEN cover THEN length('Risk Cover : ' || pr) ELSE 0 END + length('Appointed Adjuster : ' || st) + CASE WHEN k % 3 = 0 THEN 21 ELSE 0 END
      + length('Total Sum Insured : IDR  ' || amt) + length('Date of Loss : ' || dt) + length('Remarks : ' || remarks) - 1 + CASE WHEN k % 4 = 2 THEN 36 ELSE 0 END},
    {'p': 2, 'n': CAST(merged AS INT), 'c': length('Surveyor : ' || pr)}, {'p': 3, 'n': CASE WHEN split THEN 3 ELSE 0 END, 'c': length('Claim No : X' || claim) + 44}, {'p': 4, 'n': CASE WHEN k % 13 = 3 THEN 2 ELSE 0 END, 'c': 20}]) AS x FROM d WHERE k % 19 <> 0) WHERE x.n > 0)
SELECT k AS doc_id, page_no, k % 29 = 0 AND page_no = 1 AS from_ocr, CAST(n AS BIGINT) AS lines, CAST(CASE WHEN k % 23 = 0 THEN 2 * n ELSE chars END AS BIGINT) AS chars FROM p""",
        "b5_file_errors": choice + """SELECT k AS doc_id, ok, reason, CASE WHEN ok AND split THEN '2 advice; skipped: ?' ELSE '' END AS note, CASE WHEN ok THEN 'DLA' ELSE '' END AS kind, CAST(CASE WHEN fine THEN 1 + CAST(split AS INT) ELSE 0 END AS BIGINT) AS total,
  CAST(CASE WHEN NOT fine THEN 0 WHEN ok THEN CAST(split AS INT) ELSE 1 + CAST(split AS INT) END AS BIGINT) AS other, fine AND k % 29 = 0 AS from_ocr FROM e""",
        "p13_views": damaged + "SELECT 'done' AS view, k AS doc_id FROM d WHERE ok UNION ALL SELECT 'skipped', k FROM d WHERE NOT ok UNION ALL SELECT 'scanned', k FROM d WHERE ok AND k % 29 = 0 UNION ALL SELECT 'noted', k FROM d WHERE ok AND split",
        "a3_error_reasons": choice + "SELECT reason, count(*) AS n, min(k) AS first_doc FROM e WHERE NOT ok GROUP BY reason",
        "b4_recognised_notes": damaged + notes + f""", every AS (SELECT * FROM note UNION ALL SELECT 5, k, CAST(k AS VARCHAR) FROM d WHERE ok AND k % 29 = 0)
SELECT CAST(note_no AS BIGINT) AS note_no, CASE WHEN note_no IN (2, 5) THEN 'warn' ELSE 'info' END AS level, {said} AS text, count(*) AS n_details FROM every GROUP BY note_no""",
        "b2_detected_batch": letters + "SELECT 'jrp' AS profile, count(*) AS files, count(*) FILTER (WHERE ok) AS done, CAST(sum(1 + CAST(split AS INT)) AS BIGINT) AS notices FROM d",
        "b3_rejected": letters + "SELECT 'ours' AS batch, count(*) AS files, count(*) FILTER (WHERE ok) AS done, '' AS rejected FROM d UNION ALL SELECT 'another''s', count(*), 0, 'no file could be read' FROM d",
        "b9_expiry": """WITH m AS (SELECT user_id AS key, event_id, ts, event_type = 'purchase' AS makes, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS made FROM events),
l AS (SELECT *, coalesce(ts <= made + INTERVAL 900 MINUTE, false) AS live FROM m WHERE NOT makes)
SELECT key, event_id, CASE WHEN live THEN epoch_us(made) ELSE -1 END AS made_at, live FROM l""",
    }
