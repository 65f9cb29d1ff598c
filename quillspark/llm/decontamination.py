"""Benchmark decontamination by size-partitioned MinHash containment search.

A text's shingles are its runs of five lower-cased words; a text with fewer
words is one shingle, one without words has none. An item of n shingles is
found in a document that has at least 80 % of them. So of any n - ceil(0.8 n) + 1
of its shingles one is in the document, and the smallest hashes of an item, its
MinHash, are those that are looked for: no contained item is missed. How many
that is depends on the item's size class, and a document is only searched for
classes that it is large enough to contain. Documents with a hit are verified
by the exact texts of all shingles.

All of it is DataFrame functions. A benchmark of at most `inline_hashes` MinHash
values goes into the plan as a value of that bound, and no document is moved;
beyond it, hashes of documents and items are joined.

Null or empty texts have no shingles, contain nothing and are in nothing. Items
or documents with null ids are reported with a null id. Repeated rows are
reported once. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text, pinned

WIDTH = 5
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _runs(w: Column, of_run, short) -> Column:
    n = F.size(w)
    return F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), of_run)).when(n > 0, F.array(short)).otherwise(F.slice(F.array(short), 1, 0))


def hashes(w: Column) -> Column:
    """A hash of each shingle, repeats included, from an array of words."""
    return _runs(w, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH))), F.xxhash64(F.concat_ws(" ", w)))


def shingles(w: Column) -> Column:
    """The distinct shingles as texts."""
    return F.array_distinct(_runs(w, lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(WIDTH))), F.concat_ws(" ", w)))


def item_table(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """item_id, n (distinct shingles), needed, size_class, minhash, shingles."""
    t = pinned(items, "w", words(F.col("text"))).where(F.size("w") > 0)
    t = t.select("item_id", shingles(F.col("w")).alias("shingles"), F.array_sort(F.array_distinct(hashes(F.col("w")))).alias("h")).distinct()
    t = t.withColumn("n", F.size("shingles")).withColumn("needed", F.ceil(F.col("n") * F.lit(str(threshold)).cast("decimal(6,5)")).cast("int"))
    return t.select("item_id", "n", "needed", F.floor(F.log2("n")).cast("int").alias("size_class"), F.expr("slice(h, 1, n - needed + 1)").alias("minhash"), "shingles")


def contained_items(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, inline_hashes: int = 4096, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_shingles, n_common, containment of each document and
    item of which the document has at least the threshold's share."""
    items = item_table(id_text(benchmark, item_col, text_col).withColumnRenamed("doc_id", "item_id"), threshold)
    total = items.agg(F.coalesce(F.sum(F.size("minhash")), F.lit(0))).first()[0]
    docs = pinned(id_text(docs, id_col, text_col), "w", words(F.col("text"))).where(F.size("w") > 0)
    docs = pinned(docs.select("doc_id", "w"), "h", hashes(F.col("w")))
    if total <= inline_hashes:
        rows = items.select(F.struct("item_id", "n", "needed", "size_class", "minhash", "shingles").alias("i")).agg(F.collect_list("i").alias("items"), F.array_distinct(F.flatten(F.collect_list("i.minhash"))).alias("wanted"))
        held = pinned(docs, "hit", F.array_intersect("h", rows.select("wanted").scalar())).where(F.size("hit") > 0)
        held = pinned(held, "s", shingles(F.col("w"))).withColumn("items", rows.select("items").scalar())
        possible = lambda i: (F.pow(F.lit(2), i["size_class"]) * threshold <= F.size("h")) & F.arrays_overlap(i["minhash"], F.col("hit"))
        overlap = lambda i: F.struct(i["item_id"].alias("item_id"), i["n"].alias("n"), i["needed"].alias("needed"), F.size(F.array_intersect(i["shingles"], F.col("s"))).alias("common"))
        found = held.select("doc_id", F.inline(F.transform(F.filter("items", possible), overlap)))
    else:
        wanted = items.select("item_id", "size_class", F.explode("minhash").alias("hash"))
        probes = docs.select("doc_id", F.size("h").alias("m"), F.explode(F.array_distinct("h")).alias("hash"))
        pairs = probes.join(wanted, "hash").where(F.pow(F.lit(2), F.col("size_class")) * threshold <= F.col("m")).select("doc_id", "item_id").distinct()
        own = pinned(docs.select("doc_id", "w"), "s", shingles(F.col("w"))).drop("w")
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        pairs = pairs.select(F.col("doc_id").alias("d"), F.col("item_id").alias("b"))
        found = own.join(pairs, same("doc_id", "d")).join(items, same("item_id", "b")).select("doc_id", "item_id", "n", "needed", F.size(F.array_intersect("shingles", "s")).alias("common"))
    found = found.where(F.col("common") >= F.col("needed")).distinct()
    return found.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("common").cast("long").alias("n_common"), (F.col("common") / F.col("n")).alias("containment"))


def op10_minhash_containment(spark, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SHINGLES = """
{0}_w AS (SELECT {1}, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {2}),
{0}_s AS (SELECT DISTINCT {1}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {0}_w)"""

ORACLE_SQL = (
    "WITH"
    + _SHINGLES.format("d", "doc_id", "documents")
    + ","
    + _SHINGLES.format("b", "item_id", "benchmark")
    + """,
b_n AS (SELECT item_id, count(*) AS n FROM b_s GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_common, count(*) / n AS containment
FROM d_s JOIN b_s USING (s) JOIN b_n USING (item_id)
GROUP BY doc_id, item_id, n HAVING 5 * count(*) >= 4 * n"""
)
