"""Ranked lexical search by pipelined term partitioning.

Items ask, documents are ranked by a sum of integer contributions of the item's terms.

1. Every task inverts its documents in blocks: a row for each block and term holds
   the places in the block and the counts of those documents that have the term,
   and one row holds the block's ids and lengths. Only terms that items ask for
   get rows; lengths count all terms. Counts of documents and lengths add up to N, L
   and each term's document frequency.
2. Terms are dealt to a few owners, rarest first. Item bundles then go through the
   owners' stages: in each, bundles and the owner's rows are cogrouped by block, every
   item adds the contributions of the owner's terms to its sparse accumulators
   (places and sums), and the bundles are written for the next stage.
3. Between stages, the tenth best sum of an item so far, over all blocks, bounds
   its final selection from below; the largest contributions that its later
   terms can add bound each document from above. Accumulators that cannot reach the
   tenth best are dropped, and no new ones are opened once a document without any
   term so far cannot either. Only a strictly smaller bound drops, so results are
   exact, ties included.
4. The last stage gives each block's ten best, and a ranking per item selects.

A block is at most a few thousand documents, so neither a frequent term nor a
large group of copies makes a large group; bundles grow with blocks times items.
Items ask in sets of bounded text, each against all documents; texts of items are
told apart by their 128-bit hash, and equal ones ask once.

Null and empty texts have no terms: such a document is never returned and counts
neither in N nor L, such an item has no rows. Equal scores rank by ascending id,
null ids last. Repeated rows of documents are documents of their own; each row of
items has its own ranks, also where an id repeats. Texts are read whole. Empty tables
give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, id_text, stored, text_slices

#: Every byte that isn't part of a term as a space, A-Z in lower case.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096
#: Bytes of item texts that ask at a time.
ASK_BYTES = 16 << 20
#: Shares of all additions that the owners before the last one have, rarest terms first.
OWNERS = (0.02, 0.12, 0.4)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def damped(length, n: int, total: int):
    """m of documents with these lengths."""
    return 10 + 90 * length * n // total


def inverted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows of a block and term (block, term, docs, tfs, most, least: the largest count
    and the smallest length), and one of each block (block, ids, tfs: its lengths)."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = [("block", pa.int64()), ("term", pa.int32()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("most", pa.int32()), ("least", pa.int32()), ("ids", pa.list_(pa.int64()))]

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, block = words.value.get, TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1), BLOCK_BYTES):
                raw = raw.tobytes()
                for first in range(a, b, BLOCK_ROWS):
                    last = min(b, first + BLOCK_ROWS)
                    lengths, held, sizes = np.zeros(last - first, np.int32), [], np.zeros(last - first, np.int64)
                    for k in range(first, last):
                        own = terms_of(raw[offsets[k - a] : offsets[k - a + 1]])
                        found = [t for t in map(get, own) if t is not None]
                        lengths[k - first], sizes[k - first] = len(own), len(found)
                        held.append(np.array(found, np.int64))
                    key, tf = np.unique(np.concatenate(held) * (last - first) + np.repeat(np.arange(last - first), sizes), return_counts=True)
                    term, doc = key // (last - first), key % (last - first)
                    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                    ends = pa.array(np.append(begin, len(term)).astype(np.int32))
                    most = np.maximum.reduceat(tf, begin) if len(term) else begin
                    least = np.minimum.reduceat(lengths[doc], begin) if len(term) else begin
                    n = len(begin)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block)), pa.array(term[begin].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(doc.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32)), pa.nulls(n, kinds[6][1])],
                        [k for k, _ in kinds],
                    )
                    ids = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), batch.column(0)[first:last])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, kinds[2][1]), pa.array([lengths.tolist()], kinds[3][1]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), ids], [k for k, _ in kinds])
                    block += 1

    return docs.select("doc_id", "text").mapInArrow(invert, "block long, term int, docs array<int>, tfs array<int>, most int, least int, ids array<long>")


BUNDLE = pa.schema([("block", pa.int64()), ("item", pa.int32()), ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
BUNDLE_SQL = "block long, item int, docs array<int>, scores array<long>, ids array<long>, lengths array<int>"


def bundles(rows: list[tuple]) -> pa.Table:
    """A table of (block, item, docs, scores, ids, lengths), arrays as numpy or None."""
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(BUNDLE)], schema=BUNDLE)


def best_places(scores: np.ndarray, ids: list, most: int) -> np.ndarray:
    """The highest scores' places, of equal ones the smallest ids' (null last)."""
    if len(scores) > most:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return np.array(sorted(some, key=lambda k: (-scores[k], ids[k] is None, ids[k] or 0))[:most], np.int64)


class Stage:
    """What one owner's stage needs to know: terms and weights, who asks for them, and the bounds."""

    def __init__(self, asks: dict[int, list[int]], weights: dict[int, int], n: int, total: int, bound: dict[int, int], after: dict[int, int], last: bool, most: int):
        self.asks, self.weights, self.n, self.total, self.bound, self.after, self.last, self.most = asks, weights, n, total, bound, after, last, most
        self.before = dict(after)
        for term, items in asks.items():
            for item in items:
                self.before[item] = self.before.get(item, 0) + weights[term][1]

    def add(self, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's bundles after this owner's terms."""
        block, sums, ids, lengths = key[0].as_py(), {}, None, None
        for item, docs, scores, i, n in zip(*(left.column(k) for k in range(1, 6))):
            if item.as_py() is None:
                ids, lengths = i, n.values.to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                sums[item.as_py()] = (docs.values.to_numpy(zero_copy_only=False), scores.values.to_numpy(zero_copy_only=False))
        m = damped(lengths, self.n, self.total)
        dense: dict[int, np.ndarray] = {}
        for item, (docs, scores) in sums.items():
            dense[item] = np.zeros(len(m), np.int64)
            dense[item][docs] = scores
        for term, docs, tfs in zip(right.column("term").to_pylist(), right.column("docs"), right.column("tfs")):
            docs, tf = docs.values.to_numpy(zero_copy_only=False), tfs.values.to_numpy(zero_copy_only=False).astype(np.int64)
            worth = self.weights[term][0] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
            for item in self.asks[term]:
                if item not in dense:
                    if self.before[item] < self.bound.get(item, 0):
                        continue
                    dense[item] = np.zeros(len(m), np.int64)
                dense[item][docs] += worth
        rows = [] if self.last else [(block, None, None, None, ids.as_py(), lengths)]
        names = ids.as_py() if self.last else None
        for item, score in dense.items():
            least = max(1, self.bound.get(item, 0) - self.after.get(item, 0))
            keep = score >= least
            if item in sums and self.before.get(item, 0) < self.bound.get(item, 0):
                old = np.zeros(len(m), bool)
                old[sums[item][0]] = True
                keep &= old
            docs = np.flatnonzero(keep)
            if not len(docs):
                continue
            if self.last:
                docs = docs[best_places(score[docs], [names[k] for k in docs], self.most)]
                rows.append((block, item, None, score[docs], [names[k] for k in docs], None))
            else:
                rows.append((block, item, docs.astype(np.int32), score[docs], None, None))
        return bundles(rows)


def adder(stage):
    """The cogrouped function of a broadcast stage."""

    def add(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return stage.value.add(key, left, right)

    return add


def bounds(table: DataFrame, most: int) -> dict[int, int]:
    """Of each item with `most` accumulators or more, the sum of the one at that rank."""
    top = table.where("item is not null").select("item", F.explode(F.slice(F.sort_array("scores", asc=False), 1, most)).alias("score"))
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= most)
    return {r.item: r.score for r in ranked.where(F.col("r") == most).select("item", "score").collect()}


def asked(docs: DataFrame, texts: list[tuple[str, bytes]], most: int) -> DataFrame | None:
    """key, doc_id, score: candidates that hold the `most` best of each key's text."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    wants = [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)}) for _, text in texts]
    if not vocabulary:
        return None
    index = stored(inverted(docs, vocabulary))
    blocks = index.where("term is null")
    n, total = blocks.agg(F.sum(F.size(F.filter("tfs", lambda x: x > 0))), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not n:
        discard(index)
        return None
    # A row a term, and terms are those of one set of items: bounded.
    ceiling = F.expr(f"1000000000L * most div (1000L * most + 8L * (10L + (90L * least * {n}L) div {total}L))")
    known = {r.term: (r.df, r.top) for r in index.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(ceiling).alias("top")).collect()}
    weights = {t: (w := weight(n, df), w * top) for t, (df, top) in known.items()}
    askers: dict[int, list[int]] = defaultdict(list)
    for item, own in enumerate(wants):
        for t in own:
            if t in known:
                askers[t].append(item)
    order = sorted(askers, key=lambda t: (known[t][0], t))
    work = np.cumsum([known[t][0] * len(askers[t]) for t in order])
    cuts = [0, *(int(np.searchsorted(work, share * work[-1], "right")) for share in OWNERS), len(order)] if order else [0]
    owners = [order[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    table = blocks.select("block", F.lit(None).cast("int").alias("item"), F.lit(None).cast("array<int>").alias("docs"), F.lit(None).cast("array<long>").alias("scores"), "ids", F.col("tfs").alias("lengths"))
    postings, old, bound = index.where("term is not null").select("block", "term", "docs", "tfs"), [], {}
    for k, owner in enumerate(owners):
        after: Counter = Counter()
        for later in owners[k + 1 :]:
            for t in later:
                for item in askers[t]:
                    after[item] += weights[t][1]
        stage = spark.sparkContext.broadcast(Stage({t: askers[t] for t in owner}, {t: weights[t] for t in owner}, n, total, bound, dict(after), k == len(owners) - 1, most))
        own = spark.createDataFrame([(t,) for t in owner], "term int")
        rows = postings.join(own, "term", "left_semi").select(F.col("block").alias("part"), "term", "docs", "tfs")
        passed = table.groupBy("block").cogroup(rows.groupBy("part")).applyInArrow(adder(stage), BUNDLE_SQL)
        table = stored(passed)
        old = [*old, table]
        if k < len(owners) - 1:
            bound = bounds(table, most)
            discard(*old[:-1])
            old = old[-1:]
    discard(index, *old[:-1])
    if not owners:
        return None
    keys = spark.createDataFrame([(k, key) for k, (key, _) in enumerate(texts)], "item int, key string")
    return table.where("item is not null").select("item", F.explode(F.arrays_zip("ids", "scores")).alias("x")).join(keys, "item").select("key", F.col("x.ids").alias("doc_id"), F.col("x.scores").alias("score"))


def ranked(docs: DataFrame, items: DataFrame, *, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of each row of items."""
    spark, docs = docs.sparkSession, id_text(docs, id_col, text_col)
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    named = items.where("text is not null").withColumn("key", F.md5(F.col("text").cast("binary")))
    texts = stored(named.groupBy("key").agg(F.any_value("text").alias("text")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = 1 + size // ASK_BYTES
    found = None
    for k in range(sets):
        own = texts.where(F.pmod(F.xxhash64("key"), F.lit(sets)) == k).collect()
        part = asked(docs, sorted((r.key, r.text.encode()) for r in own), most)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return named.select("item_id", "key").join(top, "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_pipelined_terms(spark, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""WITH t AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS t FROM documents) GROUP BY doc_id, t),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM n),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(cn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY t),
m AS (SELECT doc_id, 10 + (90 * n * cn) // cl AS m FROM n, c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
