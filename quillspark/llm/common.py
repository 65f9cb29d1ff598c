"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles at a time, unless one document is longer.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one of our own where it is unset in a local session; on a cluster
    that would be a folder that executors don't share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there,
    and losing an executor doesn't lose the work."""
    path = f"{shared_dir(df.sparkSession)}/quill-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table._stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so extra columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pinned(df: DataFrame, name: str, value) -> DataFrame:
    """Add a column whose expression is computed once a row. A plain column
    would be put in place of each later mention of it, also inside functions
    that run per array element; a generator's output isn't."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def crc_bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string or binary column into runs of rows of about limit
    bytes: first row, last row + 1, their bytes, and their offsets in these
    bytes. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: Odd multipliers of the mixing steps (fixed values).
MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(29))
    x = x * MIX_2
    return x ^ (x >> np.uint64(32))


class Membership:
    """A Bloom filter of a fixed number of bits over 64-bit keys. It only saves
    work: a wrong yes is sorted out by the join that follows."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits) * 8)

    @staticmethod
    def slots(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        a = mixed(keys.astype(np.uint64))
        return (a % np.uint64(size)).astype(np.int64), (mixed(a + MIX_1) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: DataFrame, size: int = 1 << 25, width: int = 1 << 16) -> Membership:
        """keys: one long column. size bits (4 MB at the default), whatever the
        number of keys; each task sends a bitmap, and bitmaps are joined on the
        executors in chunks."""
        name = keys.columns[0]

        def bitmap(batches):
            bits = np.zeros(size, bool)
            for b in batches:
                for s in cls.slots(b.column(0).to_numpy(zero_copy_only=False), size):
                    bits[s] = True
            packed = np.packbits(bits)
            rows = [(k // width, packed[k : k + width].tobytes()) for k in range(0, len(packed), width) if packed[k : k + width].any()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "bits"])

        def either(key, table):
            out = np.zeros(width, np.uint8)
            for blob in table.column("bits").to_pylist():
                part = np.frombuffer(blob, np.uint8)
                out[: len(part)] |= part
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

        out = np.zeros(max(width, size // 8), np.uint8)
        for r in keys.select(name).mapInArrow(bitmap, "chunk int, bits binary").groupBy("chunk").applyInArrow(either, "chunk int, bits binary").collect():
            out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.bits, np.uint8)
        return cls(out[: size // 8])

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.slots(keys, int(self.size))
        bit = lambda s: (self.bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)
