"""Letters made from the orders table: one document per order, so that what is
extracted can be held against the source columns."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orders_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read("nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


def letter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, line_no, text. By the order's key some letters have a
    foreign addressee, a second page, a contradicting page, a page to skip, junk,
    a close with text after it, or lack a label."""
    k = F.col("o_orderkey")
    line = lambda page, text, when=None: F.struct(F.lit(page).alias("page_no"), (F.concat(*text) if when is None else F.when(when, F.concat(*text))).alias("text"))
    s = lambda name: F.col(name).cast("string")
    lit = F.lit
    lines = [
        line(1, [lit("  DEFINITE LOSS ADVICE ")]),
        line(1, [lit("Ref No : "), s("o_orderkey")]),
        line(1, [lit("Claim No :"), s("o_custkey")]),
        line(1, [lit("Reinsurer : "), F.when(k % 5 == 0, "PT Reasuransi Lain").otherwise("PT Asuransi Astra Buana")]),
        line(1, [lit("Risk Cover : "), s("o_orderpriority")], k % 9 != 4),
        line(1, [lit("Appointed Adjuster : "), s("o_orderstatus")]),
        line(1, [lit("page 1 of 2")], k % 3 == 0),
        line(1, [lit("not a pair")], k % 3 == 0),
        line(1, [lit("Total Sum Insured : IDR  "), F.format_number("o_totalprice", 2)]),
        line(1, [lit("Date of Loss : "), F.date_format("o_orderdate", "dd/MM/yyyy")]),
        line(1, [lit("Remarks : "), s("c_mktsegment")]),
        line(1, [lit("continued "), s("n_name")]),
        line(1, [lit("Jakarta, 12 March 2024")], k % 4 == 2),
        line(1, [lit("Ignored : text")], k % 4 == 2),
        line(2, [lit("Surveyor : "), s("o_orderpriority")], k % 7 == 1),
        line(3, [lit("Claim No : X"), s("o_custkey")], k % 11 == 2),
        line(3, [lit("Risk Cover : other")], k % 11 == 2),
        line(3, [lit("Appointed Adjuster : other")], k % 11 == 2),
        line(4, [lit("DEBIT NOTE")], k % 13 == 3),
        line(4, [lit("Ref No : 0")], k % 13 == 3),
    ]
    rows = orders_with_names(spark, sf_dir).select(k.alias("doc_id"), F.posexplode(F.filter(F.array(*lines), lambda x: x["text"].isNotNull())).alias("line_no", "x"))
    return rows.select("doc_id", "x.page_no", "line_no", "x.text")


def letterhead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, line_no, text of letters whose addressee is named by the
    letterhead. By the order's key some have none or a foreign one, a footer in
    place of the reference, or a second notice to us."""
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    first = [
        F.when(k % 6 == 1, "PT Reasuransi Lain").when(k % 6 > 1, "PT Asuransi Astra"),
        F.lit("Definite Loss Advice"),
        F.when(k % 4 == 0, "page 1 of 2").otherwise(text("R-", k)),
        F.lit("Name of Reinsured : N"),
        text("Interest Insured : ", F.col("o_orderpriority")),
        text("Total Sum Insured : IDR ", F.format_number("o_totalprice", 2)),
        text(": Expense IDR ", k),
        text("Loss : Indemnity IDR ", k),
        text("Your Share 2,5% of 10% : USD ", k),
    ]
    again = (k % 8 == 3) & (k % 6 != 1)
    second = [F.when(again, x) for x in ("PT Asuransi Astra", "Definite Loss Advice", "Name of Reinsured : M")]
    lines = [F.struct(F.lit(page).alias("page_no"), x.alias("text")) for page, part in ((1, first), (2, second)) for x in part]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    rows = o.select(k.alias("doc_id"), F.posexplode(F.filter(F.array(*lines), lambda x: x["text"].isNotNull())).alias("line_no", "x"))
    return rows.select("doc_id", "x.page_no", "line_no", "x.text")


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, x, y, word: words with coordinates, from line items."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y = (F.col("l_linenumber") * 4 + F.col("l_quantity") / 10).cast("double")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_partkey") % 500).cast("double").alias("x"), y.alias("y"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("word"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text of the documents table."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))


def damaged_letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Printed lines, recognised lines, all files and errors of the letters of
    letter_lines. By the order's key some can't be opened and have no lines, the
    recognition of some failed, some have blank lines only, and of some the first page
    is an image whose lines were recognised."""
    k = F.col("doc_id")
    lines = letter_lines(spark, sf_dir).where(k % 19 != 0).withColumn("text", F.when(k % 23 == 0, " \t").otherwise(F.col("text")))
    image = (k % 29 == 0) & (F.col("page_no") == 1)
    printed = lines.where(~image | (F.col("line_no") == 0)).withColumn("text", F.when(image & (k % 23 != 0), "scan").otherwise(F.col("text")))
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    failed = [F.when(k % 31 == 0, F.struct(F.lit("recognise").alias("stage"), F.lit("engine stopped").alias("message"))), F.when(k % 19 == 0, F.struct(F.lit("open").alias("stage"), F.concat(F.lit("broken at "), k).alias("message")))]
    errors = files.select("doc_id", F.inline(F.array_compact(F.array(*failed))))
    return printed, lines.where(image), files, errors


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, name, size: files as they arrive, from events. Names repeat, some have a
    number, some are of other kinds; sizes are a few hundred kilobytes and sometimes too large."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    behind = F.when(k % 7 == 0, " (2)").when(k % 7 == 1, " (3)").when(k % 7 == 2, " (2) (2)").when(k % 7 == 3, " (12)").otherwise("")
    kind = F.when(F.col("event_type") == "error", ".txt").when(F.col("event_type") == "click", ".ZIP").otherwise(".pdf")
    size = F.floor(F.col("value") * 1000).cast("long") + F.when(k % 997 == 0, 16 << 20).otherwise(0)
    return e.select(k.alias("seq"), F.concat(F.lit("scan "), user, behind, kind).alias("name"), size.alias("size"))


#: Documents of one archive.
PER_ARCHIVE = 20


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: ZIP archives of the documents table, twenty documents each, in
    the order of their ids. Members lie in folders by language and are named by source,
    so names repeat within and between archives; some are hidden or of another kind."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    k = F.col("doc_id")
    behind = F.when(k % 5 == 1, " (2)").when(k % 5 == 2, " (3)").otherwise("")
    name = F.concat(F.col("lang"), F.lit("/"), F.when(k % 17 == 3, ".").otherwise(""), F.col("source"), behind, F.when(k % 11 == 4, ".txt").otherwise(".pdf"))
    rows = d.select(F.format_string("archive-%012d.zip", F.floor(k / PER_ARCHIVE)).alias("path"), "doc_id", name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in frame.sort_values("doc_id").itertuples():
                z.writestr(zipfile.ZipInfo(row.name), row.content)
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [out.getvalue()]})

    return rows.groupBy("path").applyInPandas(pack, "path string, content binary")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, at, name: members of the archives among the uploads, two each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'")
    names = F.array(F.concat(F.lit("scan "), F.col("user_id").cast("string"), F.lit(".pdf")), F.concat(F.lit("scan "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, " (2)").otherwise(""), F.lit(".pdf")))
    return e.select(F.col("event_id").alias("seq"), F.posexplode(names).alias("at", "name"))
