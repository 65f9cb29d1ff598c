"""Vector code compression: product codes whose nearest entries are found with
slice-and-intersect bitmasks.

A vector of integers is cut into equal parts; each part is named by the nearest
entry of its place's codebook of at most 64 entries. The search for it:

1. Slice: for every coordinate the entries are sorted by it, and a prefix mask, a
   uint64 with a bit an entry, is kept for each place of that order. The entries
   within a radius of a value are a range of the order, their mask is the XOR of
   the prefix masks at its two ends.
2. Intersect: the masks of all coordinates are ANDed. What is left are exactly
   the entries in the box of that radius around the part.
3. The initial radius is a codebook's usual distance between neighbouring
   entries. A part with an empty box doubles its radius; a part whose best
   candidate is further away than its radius looks once more with that distance
   as the radius. Then every entry that is as near lies in the box, so the result
   is exact, ties included.

Codebooks start as the parts of the vectors with the smallest ids. Each round
assigns every part and moves each entry to its parts' mean, rounded down; tasks
add their parts up, and only these sums are shuffled. A codebook's size depends on
the dimension alone, so it is sent to the tasks whole.

Rows whose vector is null, or holds a null or a component that isn't finite, are
left out, as are those whose length isn't that of the kept vector with the smallest
id or can't be cut into equal parts. Integers beyond 2^26 on either side count as 2^26.
Rows with a null id are kept; they come last among the smallest ids, and
rows of one id are taken in the order of their integers. Repeated rows each get
their result. Of an empty table, or one without a kept row, the result is empty.
With fewer kept rows than entries the codebook has that many. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Integers are kept within this, so that squared distances fit 64 bits.
BOUND = 1 << 26
#: Parts that one numpy pass compares.
ROWS = 1 << 13


class SliceIndex:
    """The entries of one codebook (at most 64 rows of integers) for exact nearest search."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        k, self.width = self.entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.values = [self.entries[order[:, j], j] for j in range(self.width)]
        bits = np.uint64(1) << order.astype(np.uint64)
        self.masks = [np.concatenate([[np.uint64(0)], np.bitwise_or.accumulate(bits[:, j])]) for j in range(self.width)]
        self.radius = 1
        if k > 1:
            apart = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2)
            apart = np.where(np.eye(k, dtype=bool), apart.max(), apart).min(1)
            self.radius = max(1, int(np.ceil(np.sqrt(np.median(apart)))))

    def box(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each part the mask of the entries that no coordinate is further from than its radius."""
        out = np.full(len(parts), ~np.uint64(0))
        for j in range(self.width):
            high = np.searchsorted(self.values[j], parts[:, j] + radius, "right")
            low = np.searchsorted(self.values[j], parts[:, j] - radius, "left")
            out &= self.masks[j][high] ^ self.masks[j][low]
        return out

    def best(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of each part's candidates (lowest index of ties), and its squared distance; masks have a bit at least."""
        row, entry = np.nonzero(np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        far = ((parts[row] - self.entries[entry]) ** 2).sum(1)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(far, begin)
        hit = np.flatnonzero(far == np.repeat(least, np.diff(np.append(begin, len(row)))))
        hit = hit[np.concatenate([[True], row[hit[1:]] != row[hit[:-1]]])]
        return entry[hit], least

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of each part."""
        index, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        open_, radius = np.arange(len(parts)), np.full(len(parts), self.radius, np.int64)
        while len(open_):
            masks = self.box(parts[open_], radius)
            held = masks != 0
            wider = 2 * radius
            if held.any():
                some = open_[held]
                index[some], far[some] = self.best(parts[some], masks[held])
                wider[held] = np.ceil(np.sqrt(far[some].astype(np.float64))).astype(np.int64) + 1
            done = held & (far[open_] <= radius * radius)
            open_, radius = open_[~done], wider[~done]
        return index, far


def quantised(column: pa.Array, scale: int, parts: int, width: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of an Arrow list column that are kept, and the integers of each."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    fits = (lengths > 0) & (lengths % parts == 0) if width is None else lengths == width
    rows, found = [], []
    for n in np.unique(lengths[fits]):
        own = np.flatnonzero(fits & (lengths == n))
        x = flat[starts[own][:, None] + np.arange(n)]
        finite = np.isfinite(x).all(1)
        rows.append(own[finite])
        found.append(np.clip(np.floor(scale * x[finite]), -BOUND, BOUND).astype(np.int64))
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), found


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))


def first_codebooks(vectors: DataFrame, scale: int, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the kept vectors with the smallest ids, as [part, entry, place]. vectors: id, vector."""

    def smallest(width: int | None, most: int) -> list:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = quantised(batch.column(1), scale, parts, width)
                at = 0
                for x in found:
                    ids = batch.column(0).take(pa.array(rows[at : at + len(x)]))
                    at += len(x)
                    yield pa.RecordBatch.from_arrays([ids, as_lists(x)], ["id", "x"])

        kept = vectors.select("id", "vector").mapInArrow(scan, "id long, x array<long>")
        return kept.orderBy(F.asc_nulls_last("id"), "x").limit(most).collect()

    rows = smallest(None, entries)
    if rows and len({len(r.x) for r in rows}) > 1:
        rows = smallest(len(rows[0].x), entries)
    if not rows:
        return None
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def moved(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks after one round: each entry at the mean of its parts, rounded down; an entry without parts stays."""
    parts, k, width = books.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [SliceIndex(b) for b in books]
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for x in quantised(batch.column(0), scale, parts, parts * width)[1]:
                for a in range(0, len(x), ROWS):
                    for p in range(parts):
                        own = x[a : a + ROWS, p * width : (p + 1) * width]
                        index, _ = indexes[p].nearest(own)
                        count[p] += np.bincount(index, minlength=k)
                        order = np.argsort(index, kind="stable")
                        begin = np.flatnonzero(np.concatenate([[True], np.diff(index[order]) != 0]))
                        total[p, index[order][begin]] += np.add.reduceat(own[order], begin, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width)), pa.array(np.repeat(e, width)), pa.array(np.tile(np.arange(width), len(p))), pa.array(np.repeat(count[p, e], width)), pa.array(total[p, e].ravel())], ["p", "e", "j", "n", "s"])

    out = books.copy()
    for r in vectors.select("vector").mapInArrow(scan, "p long, e long, j long, n long, s long").groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r.p, r.e, r.j] = r.s // r.n
    return out


def columns(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))


def fitted(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray | None:
    """Codebooks [part, entry, place] of the table, None if no row is kept."""
    if not 0 < entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries, a bit each")
    vectors = columns(df, id_col, vector_col, None)
    books = first_codebooks(vectors, scale, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = moved(vectors, books, scale)
    return books


def encoded(df: DataFrame, books: np.ndarray, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, scale: int = 256) -> DataFrame:
    """id, label, code (a byte a part) and error (summed squared distance) of each kept row."""
    vectors = columns(df, id_col, vector_col, label_col)
    parts, _, width = books.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [SliceIndex(b) for b in books]
        for batch in batches:
            rows, found = quantised(batch.column(2), scale, parts, parts * width)
            for x in found:
                for a in range(0, len(x), ROWS):
                    some = x[a : a + ROWS]
                    near = [indexes[p].nearest(some[:, p * width : (p + 1) * width]) for p in range(parts)]
                    code = np.stack([i for i, _ in near], 1).astype(np.uint8)
                    ends = pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32))
                    at = pa.array(rows[a : a + ROWS])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.Array.from_buffers(pa.binary(), len(code), [None, ends.buffers()[1], pa.py_buffer(code.tobytes())]), pa.array(sum(far for _, far in near))], ["id", "label", "code", "error"])

    return vectors.mapInArrow(scan, f"id long, label {vectors.schema['label'].dataType.simpleString()}, code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """id, x: the integers that codes (id, code) stand for."""
    parts = len(books)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(np.concatenate([books[p][code[:, p]] for p in range(parts)], 1))], ["id", "x"])

    return codes.select("id", "code").mapInArrow(scan, "id long, x array<long>")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded_with_errors(df: DataFrame, label_col: str = "label", **options) -> DataFrame:
    """vec_id, code in hex, error, label_error (errors of equal labels added up, nulls together), codebooks_sha256."""
    books = fitted(df, **options)
    if books is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = {k: v for k, v in options.items() if k in ("id_col", "vector_col", "scale")}
    codes = stored(encoded(df, books, label_col=label_col, **kept))
    # A row a label: read back, its size is known, and Spark sends it to all tasks or splits a hot label.
    totals = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "same")
    rows = codes.join(totals, codes["label"].eqNullSafe(totals["same"]))
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op11_slice_intersect_codes(spark, sf_dir: str) -> DataFrame:
    return coded_with_errors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _near(n: int) -> str:
    """SQL of the n-th assignment: n (vec_id, p, e, d)."""
    return f"""f{n} AS (SELECT vec_id, c.p, e, CAST(sum((v - b) * (v - b)) AS BIGINT) AS d FROM c JOIN b{n} ON c.p = b{n}.p AND c.j = b{n}.j GROUP BY vec_id, c.p, e),
n{n} AS (SELECT vec_id, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS r FROM f{n}) WHERE r = 1)"""


def _move(n: int) -> str:
    """SQL of the codebook after the n-th assignment."""
    mean = "CAST(sum(v) AS BIGINT) // count(*) - CAST(CAST(sum(v) AS BIGINT) % count(*) < 0 AS BIGINT)"
    return f"""m{n} AS (SELECT n.p, n.e, c.j, {mean} AS b FROM n{n} n JOIN c ON c.vec_id = n.vec_id AND c.p = n.p GROUP BY n.p, n.e, c.j),
b{n + 1} AS (SELECT b.p, b.e, b.j, coalesce(m.b, b.b) AS b FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"""


ORACLE_SQL = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i, len(x) // 16 AS w FROM k),
c AS (SELECT vec_id, i // w AS p, i % w AS j, v FROM u),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k),
b0 AS (SELECT p, e, j, v AS b FROM c JOIN o USING (vec_id) WHERE e < 64),
{_near(0)}, {_move(0)}, {_near(1)}, {_move(1)}, {_near(2)},
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM k JOIN r USING (vec_id) GROUP BY label)
SELECT r.vec_id, code, error, label_error, (SELECT sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY p, e, j)) FROM b2) AS codebooks_sha256
FROM r JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label"""
