"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0 to n - 1 in the order of id (nulls first), size and
crc32 of the text. A Feistel network permutes the numbers of the least even number
of bits that n - 1 fits in; a number that lands at n or beyond is permuted again
until it lies below n, so the walk is a permutation of 0 to n - 1. Place x is slot
x div shards of shard x mod shards. So the shuffle is fixed by n, the seed and the
order, shards differ by one row at most, slots have no gap, and both directions
are computed: `place` gives shard and slot of a row number, `row_at` the number of
the row in a slot, without any table.

Only ids, sizes, checksums and a place in the input move, not texts: one range
shuffle on the whole key, whose last part differs between any two rows, so an
id or a text that a third of all rows have is spread like the others. Each range
numbers its own rows; the offsets are one number a range.

Equal rows are interchangeable and each get a place of their own; copies of a text
may be in different shards, as the law is about rows only. A null text has no bytes
and the checksum of none; null ids are numbered first. Other columns are ignored.
An empty table gives an empty result. More shards than rows leave some empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text, stored

ROUNDS = 6
#: Odd multipliers of the round function, below 2^31 so that products stay below 2^63.
FIRST, SECOND = 0x5BD1E995, 0x27D4EB2F


def round_keys(seed: int) -> list[int]:
    return [zlib.crc32(f"{seed}:{k}".encode()) for k in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of half a number of the permuted domain."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def mixed_half(r: np.ndarray, key: int, half: int) -> np.ndarray:
    low = np.int64(0xFFFFFFFF)
    v = ((r + key) & low) * FIRST & low
    v ^= v >> 15
    v = v * SECOND & low
    return (v ^ (v >> 13)) & np.int64((1 << half) - 1)


def permuted(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    left, right = x >> half, x & np.int64((1 << half) - 1)
    for key in keys:
        left, right = right, left ^ mixed_half(right, key, half)
    return (left << half) | right


def restored(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    left, right = x >> half, x & np.int64((1 << half) - 1)
    for key in reversed(keys):
        left, right = right ^ mixed_half(left, key, half), left
    return (left << half) | right


def walked(x: np.ndarray, n: int, seed: int, step=permuted) -> np.ndarray:
    """Each number's place among n; with step=restored, each place's number."""
    half, keys = half_bits(n), round_keys(seed)
    out = step(np.asarray(x, np.int64), half, keys)
    while len(over := np.flatnonzero(out >= n)):
        out[over] = step(out[over], half, keys)
    return out


def place(rows: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of the rows with these global numbers."""
    x = walked(rows, n, seed)
    return x % shards, x // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Global numbers of the rows in these slots."""
    return walked(np.asarray(slot, np.int64) * shards + shard, n, seed, restored)


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, dict[int, int], int]:
    """rows with part and at (its number among the rows of that part), the offset
    of each part, and the number of all rows. Parts are ranges of the order."""
    schema = rows.schema
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], [*schema.names, "part", "at"])
            at += n

    table = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, f"{kind}, part int, at long"))
    offsets, n = {}, 0
    for r in table.groupBy("part").count().orderBy("part").collect():
        offsets[r.part] = n
        n += r["count"]
    return table, offsets, n


def sharded(docs: DataFrame, shards: int, *, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text plus 16), text_crc32, row_no, shard and slot of each row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = id_text(docs, id_col, text_col).select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("input"))
    # Written before it is ranged: the ranges' sample doesn't read texts again, and a row's place in the input is fixed.
    table, offsets, n = numbered(stored(keys), "doc_id", "size", "text_crc32", "input")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(max(offsets, default=0) + 1, np.int64)
        first[list(offsets)] = list(offsets.values())
        for batch in batches:
            row = first[batch.column(3).to_numpy()] + batch.column(4).to_numpy()
            shard, slot = place(row, n, shards, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(row), pa.array(shard.astype(np.int32)), pa.array(slot)], ["doc_id", "size", "text_crc32", "row_no", "shard", "slot"])

    return table.select("doc_id", "size", "text_crc32", "part", "at").mapInArrow(put, "doc_id long, size long, text_crc32 long, row_no long, shard int, slot long")


def op12_feistel_shards(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    rows = sharded(documents(spark, sf_dir), shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def _rounds(keys: list[int]) -> str:
    """SQL: the permuted number y of each number x of the domain."""
    steps = ["r0 AS (SELECT x, x >> h AS l, x & ((1::BIGINT << h) - 1) AS r, h FROM (SELECT h, unnest(range(0::BIGINT, 1::BIGINT << (2 * h))) AS x FROM half))"]
    for k, key in enumerate(keys):
        steps.append(f"""r{k + 1} AS (SELECT x, r AS l, xor(l, xor(v, v >> 13) & ((1::BIGINT << h) - 1)) AS r, h FROM (SELECT x, l, r, h, (xor(v, v >> 15) * {SECOND}) & 4294967295 AS v
  FROM (SELECT x, l, r, h, (((r + {key}) & 4294967295) * {FIRST}) & 4294967295 AS v FROM r{k})))""")
    return ",\n".join(steps) + f",\np AS (SELECT x, (l << h) | r AS y FROM r{len(keys)})"


# The checksum's table comes from its polynomial: eight steps of a shift and, for an odd number, an XOR.
ORACLE_SQL = f"""WITH RECURSIVE z AS (SELECT b, CAST(b AS BIGINT) AS c, 0 AS s FROM range(256) AS t(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM z WHERE s < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM z WHERE s = 8),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, CAST(len(b) + 16 AS BIGINT) AS size, CAST(xor(list_reduce(b, lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)]), 4294967295::BIGINT), 4294967295) AS BIGINT) AS text_crc32 FROM raw, tab),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM d),
half AS (SELECT min(h) AS h FROM range(1::BIGINT, 32::BIGINT) AS t(h) WHERE 1::BIGINT << (2 * h) >= (SELECT count(*) FROM d)),
{_rounds(round_keys(0))},
w AS (SELECT row_no, y FROM o JOIN p ON p.x = o.row_no UNION ALL SELECT w.row_no, p.y FROM w JOIN p ON p.x = w.y WHERE w.y >= (SELECT count(*) FROM d))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % 40 AS INT) AS shard, CAST(y // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, row_no
FROM o JOIN w USING (row_no) WHERE y < (SELECT count(*) FROM d)"""
