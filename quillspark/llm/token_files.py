"""Token ids in shard files, each with a minimal perfect hash index.

A shard file holds, little-endian:

    8 bytes   b"QTOKENS2"
    6 x u64   bytes per id, records, ids, keys, levels of the hash, blocks of the hash
    levels    per level: u64 slots, u64 first block
    blocks    64 bytes each: u64 set bits in all blocks before, then 448 slots' bits
    entries   per key, in the order of the hash: u32 fingerprint, u32 first record, u32 records
    offsets   records + 1 times u64: where each record's ids begin
    ids       the raw payload, in ascending key order

The hash gives each key of a shard its own entry number with a few bits per key
and no stored keys; the fingerprint tells a foreign key apart but for one case
in 2^32. A lookup reads ranges of the file: the head, one block per probed level
(two on average), one entry, its offsets and its ids. Neighbouring ranges of
many keys are read at once, so a scan of all keys is one pass over the file.

Null or empty texts have the end id alone. Rows with a null key are written under
the least 64-bit number, so before all others, and are found by a null key (a key of
that very number is one with them). Rows of the same key stand one after another,
ordered by their ids, in as many shards as they need, and a key gives all of
them. An empty table makes no file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_1, documents, id_text, mixed, shared_dir, shuffles, stored
from .token_ids import Encoder, default_path

MAGIC = b"QTOKENS2"
HEAD = struct.Struct("<8s6Q")
ENTRY = np.dtype([("fingerprint", "<u4"), ("record", "<u4"), ("records", "<u4")])
BLOCK, SLOTS = 64, 448
#: Stands for a null key in files.
NO_KEY = -(1 << 63)


def slots_of(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(keys.view(np.uint64) + MIX_1 * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


def hash_blocks(keys: np.ndarray, gamma: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of different keys: at each level the keys that have
    a slot to themselves set its bit, the others go on to the next; a key's
    number is the count of bits before its own. Levels (slots, first block), blocks."""
    levels, parts, at = [], [], 0
    while len(keys):
        size = max(8, int(gamma * len(keys)))
        slots = slots_of(keys, len(levels), size)
        n = np.bincount(slots, minlength=size)
        bits = np.packbits(np.pad(n == 1, (0, -size % SLOTS))).reshape(-1, SLOTS // 8)
        levels.append((size, at))
        parts.append(bits)
        at += len(bits)
        keys = keys[n[slots] > 1]
    bits = np.concatenate(parts) if parts else np.zeros((0, SLOTS // 8), np.uint8)
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    before = (np.cumsum(ones) - ones).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.array(levels, "<u8").reshape(-1, 2), np.concatenate([before, bits], 1)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(~keys.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


class Ranges:
    """Reads of a file: ranges with gaps under `gap` bytes are read together, in parts of about `most`."""

    def __init__(self, file, gap: int = 1 << 14, most: int = 1 << 23):
        self.file, self.gap, self.most, self.bytes_read = file, gap, most, 0

    def __call__(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self.file.read_at(size, at)

    def runs(self, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """For ascending ranges: first, last + 1, the first's place, bytes of each run of ranges."""
        end, k = at + size, 0
        while k < len(at):
            last = k + 1
            while last < len(at) and at[last] - end[last - 1] <= self.gap and end[last] - at[k] <= self.most:
                last += 1
            yield k, last, int(at[k]), self(int(at[k]), int(end[k:last].max() - at[k]))
            k = last

    def rows(self, number: np.ndarray, first: int, size: int) -> np.ndarray:
        """The rows with these numbers of a table of rows of `size` bytes, as bytes."""
        want, back = np.unique(number, return_inverse=True)
        out = np.empty((len(want), size), np.uint8)
        at = first + want * size
        for k, last, begin, raw in self.runs(at, np.full(len(at), size)):
            out[k:last] = np.frombuffer(raw, np.uint8)[(at[k:last] - begin)[:, None] + np.arange(size)]
        return out[back]


def shard_bytes(keys: np.ndarray, records: list[bytes], kind: np.dtype) -> list[bytes]:
    """A shard of records in ascending key order, as the parts of its file."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    levels, blocks = hash_blocks(distinct)
    entries = np.zeros(len(distinct), ENTRY)
    place = numbers(distinct, levels, lambda wanted: blocks[wanted])
    entries["fingerprint"][place] = fingerprints(distinct)
    entries["record"][place], entries["records"][place] = first, count
    offsets = np.concatenate([[0], np.cumsum([len(r) // kind.itemsize for r in records])]).astype("<u8")
    head = HEAD.pack(MAGIC, kind.itemsize, len(records), int(offsets[-1]), len(distinct), len(levels), len(blocks))
    return [head, levels.tobytes(), blocks.tobytes(), entries.tobytes(), offsets.tobytes(), *records]


def numbers(keys: np.ndarray, levels: np.ndarray, blocks_at, some: int = 1 << 14) -> np.ndarray:
    """Each key's number; -1 for keys that surely aren't indexed. blocks_at gives the blocks of some numbers."""
    out = np.full(len(keys), -1, np.int64)
    for at in range(0, len(keys), some):
        left = np.arange(at, min(len(keys), at + some))
        for level, (size, first) in enumerate(levels.tolist()):
            if not len(left):
                break
            slot = slots_of(keys[left], level, size)
            block = blocks_at(first + slot // SLOTS)
            bits, place = np.unpackbits(block[:, 8:], axis=1), slot % SLOTS
            hit = bits[np.arange(len(left)), place] == 1
            before = np.cumsum(bits, 1, dtype=np.int16)[np.arange(len(left)), place] - 1
            out[left[hit]] = (block[:, :8].copy().view("<u8")[:, 0].astype(np.int64) + before)[hit]
            left = left[~hit]
    return out


class Shard:
    """Keyed access to a shard file that can be read by ranges."""

    def __init__(self, file):
        self.read = Ranges(file)
        magic, self.width, self.n_records, self.n_ids, self.n_keys, n_levels, n_blocks = HEAD.unpack(self.read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.levels = np.frombuffer(self.read(HEAD.size, 16 * n_levels), "<u8").reshape(-1, 2).astype(np.int64)
        self.blocks = HEAD.size + 16 * n_levels
        self.entries = self.blocks + BLOCK * n_blocks
        self.offsets = self.entries + ENTRY.itemsize * self.n_keys
        self.payload = self.offsets + 8 * (self.n_records + 1)

    def records(self, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each of some different keys that is there, each of its records:
        place of the key, start, ids; in the order of the file."""
        place = numbers(keys, self.levels, lambda wanted: self.read.rows(wanted, self.blocks, BLOCK))
        known = np.flatnonzero(place >= 0)
        if not len(known):
            return
        entry = self.read.rows(place[known], self.entries, ENTRY.itemsize).view(ENTRY)[:, 0]
        own = entry["fingerprint"] == fingerprints(keys[known])
        known, entry = known[own], entry[own]
        order = np.argsort(entry["record"], kind="stable")
        known, entry = known[order], entry[order]
        n = entry["records"].astype(np.int64)
        record = np.repeat(entry["record"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        of = np.repeat(known, n)
        if not len(record):
            return
        low = self.read.rows(record, self.offsets, 8).view("<u8")[:, 0].astype(np.int64)
        high = self.read.rows(record + 1, self.offsets, 8).view("<u8")[:, 0].astype(np.int64)
        for k, last, begin, raw in self.read.runs(self.payload + low * self.width, (high - low) * self.width):
            ids = np.frombuffer(raw, f"<u{self.width}")
            first = (begin - self.payload) // self.width
            for r in range(k, last):
                yield int(of[r]), int(low[r]), ids[low[r] - first : high[r] - first]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, shard_ids: int = 1 << 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards in ascending key order and return their manifest: part (of
    the key range), shard (in the part), file, first_key, last_key, n_records,
    n_ids. A shard holds at least one record and closes at shard_ids ids.

    Each attempt of a task writes files of its own name; the manifest names
    those of the attempts that counted, so a lost executor or a repeated task
    leaves at most files that nothing reads. folder: a URI that pyarrow's
    filesystems can write to from the executors.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for batch in batches:
            place = np.searchsorted(bounds, batch.column(0).to_numpy()).astype(np.int32)
            for a, b, ids, begin in encoder.ended(batch.column(1), end_id):
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((begin * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(place[a:b]), batch.column(0)[a:b], column], ["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        Encoder.forget()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        keys: list[int] = []
        records: list[bytes] = []
        held, made, part = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, records, held, made
            name = f"{part:06d}-{made:04d}-{uuid.uuid4().hex}.qtok"
            with store.open_output_stream(f"{root}/{name}") as f:
                for piece in shard_bytes(np.array(keys, np.int64), records, kind):
                    f.write(piece)
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": made, "file": name, "first_key": keys[0], "last_key": keys[-1], "n_records": len(keys), "n_ids": held}], schema=arrow)
            keys, records, held, made = [], [], 0, made + 1
            return row

        arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), *((n, pa.int64()) for n in ("first_key", "last_key", "n_records", "n_ids"))])
        for batch in batches:
            for own, key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if keys and (held >= shard_ids or own != part):
                    yield close()
                part = own
                keys.append(key)
                records.append(ids)
                held += len(ids) // kind.itemsize
        if keys:
            yield close()

    parts = shuffles(docs.sparkSession)
    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_KEY)))
    kind = Encoder.at(tokenizer).type
    # Part borders from the keys alone: a range shuffle's own sampling would encode the texts.
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10000)).first()[0]
    bounds = np.array(cuts or [], np.int64)
    ids = rows.mapInArrow(encode, "part int, doc_id long, ids binary").repartitionById(parts + 1, "part").sortWithinPartitions("part", "doc_id", "ids")
    return stored(ids.mapInArrow(write, "part int, shard int, file string, first_key long, last_key long, n_records long, n_ids long"))


def read_token_files(keys: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """Look up keys (one long column): doc_id, start, n_tokens, ids (little-endian
    unsigned 32-bit) of each record. Keys that aren't there give no row, and
    repeated keys are looked up once.

    Keys and manifest rows are dealt by the parts of the key range and sorted
    together, so a task meets a shard before the keys that may be in it. The
    driver only sees one row per part, of which there are as many as shuffle
    partitions at the time of writing."""
    result = "doc_id long, start long, n_tokens long, ids binary"
    parts = sorted(manifest.groupBy("part").agg(F.min("first_key").alias("low"), F.sum("n_ids").alias("n")).collect(), key=lambda r: r.part)
    if not parts:
        return keys.sparkSession.createDataFrame([], result)
    base = {r.part: sum(x.n for x in parts[:k]) for k, r in enumerate(parts)}
    names = [r.part for r in parts]
    name = keys.columns[0]
    wanted = keys.select(F.coalesce(F.col(name).cast("long"), F.lit(NO_KEY)).alias("doc_id")).distinct()
    wanted = wanted.mapInArrow(_part_of([r.low for r in parts], names), "part int, doc_id long")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("part", F.col("first_key").alias("doc_id"), "file", "last_key", "shard", before.alias("before"))
    rows = wanted.select("part", "doc_id", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("last_key"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("before")).unionByName(shards)
    rows = rows.repartitionById(max(names) + 1, "part").sortWithinPartitions("part", "doc_id", F.col("shard").asc_nulls_last())

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        near: list[tuple] = []  # shards that may hold what follows: file, last key, start
        asked: list[int] = []

        def found(row, last, first) -> Iterator[pa.RecordBatch]:
            with store.open_input_file(f"{root}/{row}") as f:
                own = np.array([k for k in asked if k <= last], np.int64)
                held, n = [], 0
                for k, start, ids in Shard(f).records(own):
                    held.append((int(own[k]), first + start, len(ids), ids.astype("<u4").tobytes()))
                    n += len(ids)
                    if n > 1 << 20:
                        yield table(held)
                        held, n = [], 0
                if held:
                    yield table(held)

        def table(held) -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for part, key, file, last, _, start in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    asked.append(key)
                    if len(asked) < 1 << 16:
                        continue
                if asked:
                    for row in near:
                        yield from found(*row)
                    asked = []
                if file is not None:
                    near = [*(x for x in near if x[1] >= key), (file, last, base[part] + start)]
        if asked:
            for row in near:
                yield from found(*row)

    key = F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")).alias("doc_id")
    return rows.mapInArrow(look_up, result).select(key, "start", "n_tokens", "ids")


def _part_of(low: list[int], names: list[int]):
    def scan(batches):
        first, part = np.array(low[1:], np.int64), np.array(names, np.int32)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part[np.searchsorted(first, b.column(0).to_numpy(), "right")]), b.column(0)], ["part", "doc_id"])

    return scan


def op8_mph_token_files(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1)
    manifest = write_token_files(docs, folder, default_path())
    return read_token_files(docs.select("doc_id"), folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
