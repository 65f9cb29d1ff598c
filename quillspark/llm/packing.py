"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids are cut
into full windows and a rest; the rest goes to the open window that it fits
best. When it fits none, the fullest window is emitted: the head of the rest
fills it up, and what remains is placed again. The windows that are open when
a partition ends, at most `open_windows` of them, are merged by the same rule in
ever fewer tasks. So memory per task is bounded by the number of open windows.

Null or empty texts have the end id alone. A null doc_id stays null. Repeated
rows are packed as often as they occur. An empty table gives no rows. Columns
other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text, stored
from .token_ids import Encoder, default_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"

#: Sequence ids are a task's number times this, plus a count.
TASK_STRIDE = 1 << 36


class Windows:
    """At most `most` open windows of `size` places, kept in the order of their
    free places; an item is a number of ids with what the caller knows of it."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, length: int) -> tuple[int, int] | None:
        """The window and the offset for so many ids: the best fit, or a new
        window while fewer than `most` are open; None if there is neither."""
        k = bisect_left(self.free, (length, -1))
        if k < len(self.free):
            free, window = self.free.pop(k)
        elif len(self.free) < self.most:
            free, window = self.size, self.made
            self.made += 1
            self.held[window] = []
        else:
            return None
        if free > length:
            insort(self.free, (free - length, window))
        return window, self.size - free

    def fullest(self) -> tuple[int, int]:
        """Its window and free places; it is open no longer."""
        free, window = self.free.pop(0)
        return window, free


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, size: int = 2048, open_windows: int = 64, fan_in: int = 16, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids the ids."""
    schema = PIECES + (", ids binary" if keep_ids else "")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        wide = np.dtype("<u4")
        base = TaskContext.get().partitionId() * TASK_STRIDE
        windows, full = Windows(size, open_windows), 0
        done: list[tuple] = []

        def piece(doc, ids, start, length, sequence, offset):
            part = ids[start : start + length].astype(wide)
            return (doc, start, length, zlib.crc32(part), len(ids), sequence, offset, *([part.tobytes()] if keep_ids else []))

        def out(rows: list[tuple], opened: bool) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(x, pa.int64()) for x in columns[:7]] + [pa.array([opened] * len(rows))]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.binary()) for x in columns[7:]], names)

        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, last, flat, begin in encoder.ended(batch.column(1), end_id):
                for doc, low, high in zip(docs[first:last], begin[:-1].tolist(), begin[1:].tolist()):
                    ids, at, n = flat[low:high], 0, high - low
                    while n - at >= size:
                        done.append(piece(doc, ids, at, size, base + 2 * full, 0))
                        full, at = full + 1, at + size
                    while at < n:
                        if spot := windows.place(n - at):
                            window, offset = spot
                            windows.held[window].append(piece(doc, ids, at, n - at, base + 2 * window + 1, offset))
                            if offset + n - at == size:
                                done += windows.held.pop(window)
                            break
                        window, free = windows.fullest()
                        done += windows.held.pop(window)
                        done.append(piece(doc, ids, at, free, base + 2 * window + 1, size - free))
                        at += free
                    if len(done) >= 4000:
                        yield out(done, False)
                        done = []
        if done:
            yield out(done, False)
        if rest := [p for held in windows.held.values() for p in held]:
            yield out(rest, True)

    pieces = stored(id_text(docs, id_col, text_col).mapInArrow(packed, schema))
    parts = [pieces.where(~F.col("open"))]
    left = pieces.where("open")
    tasks = left.select(F.floor(F.col("sequence_id") / TASK_STRIDE).alias("t")).agg(F.max("t")).first()[0]
    tasks = 0 if tasks is None else tasks + 1
    level = 1
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        left = stored(merged(left, size, open_windows, fan_in, level))
        parts.append(left.where(~F.col("open")))
        left, level = left.where("open"), level + 1
    parts.append(left)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.drop("open")


def merged(left: DataFrame, size: int, open_windows: int, fan_in: int, level: int) -> DataFrame:
    """Join the open windows of fan_in tasks: whole windows are placed best-fit
    into windows, and at most open_windows stay open."""
    schema = left.schema

    def merge(key, table):
        group, base = key[0].as_py(), key[0].as_py() * TASK_STRIDE + (level << 30)
        rows = sorted(table.drop_columns(["grp"]).to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        old: dict[int, list[dict]] = {}
        for r in rows:
            old.setdefault(r["sequence_id"], []).append(r)
        windows, full = Windows(size, open_windows), set()
        for held in sorted(old.values(), key=lambda h: -sum(r["length"] for r in h)):
            length = sum(r["length"] for r in held)
            while not (spot := windows.place(length)):
                full.add(windows.fullest()[0])
            window, offset = spot
            for r in held:
                windows.held[window].append(r | {"sequence_id": base + 2 * window, "offset": offset + r["offset"]})
            if offset + length == size:
                full.add(window)
        out = [r | {"open": w not in full} for w, held in windows.held.items() for r in held]
        return pa.Table.from_pylist(out, schema=table.drop_columns(["grp"]).schema)

    group = F.floor(F.col("sequence_id") / (TASK_STRIDE * fan_in)).cast("long")
    return left.withColumn("grp", group).groupBy("grp").applyInArrow(merge, schema)


def op7_bounded_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_path())
