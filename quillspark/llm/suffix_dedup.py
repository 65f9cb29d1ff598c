"""Removal of repeated byte strings by a multi-document suffix order that is
built column by column.

A byte goes if some string of `length` bytes that covers it also starts
anywhere else, in the same text or another.

1. Anchors. Of all 64-byte strings inside a window of 200 bytes the one with the
   smallest hash (the leftmost of equal ones) is the window's anchor. Equal
   windows have equal anchors at equal places, so a repeat only needs to be looked
   for among segments around equal anchors. A segment is the run of bytes
   whose windows share one anchor, about 270 bytes. Anchors that occur once go.
2. Where all segments of an anchor are equal, all of their windows are repeats.
3. Other segments are dealt into buckets by anchor. In a bucket each different
   segment is a document of 25-byte symbols (once for each of 25 phases, so
   every window of 200 bytes is a run of 8 symbols). The collection's suffix
   order grows by columns: each round takes one symbol of every document,
   from the last to the first, finds the place of the longer suffixes from
   the counts of symbols before the shorter ones, inserts them, and sets the
   common prefixes of the neighbours. What the rounds keep (the symbol of each
   place, which is the Burrows-Wheeler transform seen from its last column, its
   link and its common prefix) lies in scratch files of the task that
   each round reads and writes from end to end. A suffix with a common prefix of 8 symbols
   with a neighbour starts a repeat.
4. An anchor with more than `most_segments` different segments isn't given to one
   task: its windows are counted by their hashes in the cluster, which is exact
   as well but for 128-bit hashes.

Texts are told apart by md5, so repeated rows share their result. Null texts are
empty; texts under 200 bytes, empty ones among them, keep all. A null doc_id
changes nothing. All columns are passed on in one struct, so names can't clash.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_1, MIX_2, Membership, documents, mixed, stored, text_slices
from .hashing import powers, prefix_sums

LENGTH, GRAM, UNIT = 200, 64, 25
#: Places within a pass fit in so many bits of the key that is minimised.
PLACE_BITS = 24
#: A pass takes about a hundred bytes of memory for each of its own. Short texts share
#: passes of SHARED_BYTES, which stay in the processor's cache.
PASS_BYTES = 1 << 20
SHARED_BYTES = 1 << 18


def anchors(raw: np.ndarray, offsets: np.ndarray):
    """Anchor place, first and last window start, anchor hash, and a hash of the
    segment with the anchor's place in it, of every run of windows with one
    anchor, in place order."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, back = prefix_sums(raw), powers(n + 1)[1]
    h = mixed((sums[GRAM:] - sums[: n + 1 - GRAM]) * back[: n + 1 - GRAM])
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w = LENGTH - GRAM + 1
    pad = -len(key) % w
    grid = np.concatenate([key, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    last = n - LENGTH + 1
    place = (np.minimum(behind[:last], ahead[w - 1 : w - 1 + last]) & low).astype(np.int64)
    start = np.arange(last)
    doc = np.searchsorted(offsets, start, "right") - 1
    fits = start + LENGTH <= offsets[doc + 1]
    start, place, doc = start[fits], place[fits], doc[fits]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    a, j0, j1 = place[at], start[at], start[np.append(at[1:], len(start)) - 1]
    segment = mixed((sums[j1 + LENGTH] - sums[j0]) * back[j0] + (j1 - j0).astype(np.uint64) * MIX_1 + (a - j0).astype(np.uint64) * MIX_2)
    return a, j0, j1, h[a], segment


def passes(column: pa.Array):
    """Rows of an Arrow text column in passes of SHARED_BYTES; a text longer than
    PASS_BYTES in overlapping parts. Gives: row numbers, place of the first byte in
    its text, bytes, offsets."""
    for a, b, raw, offsets in text_slices(column, SHARED_BYTES):
        if len(raw) <= PASS_BYTES:
            yield np.arange(a, b), 0, raw, offsets
        else:
            for at in range(0, max(1, len(raw) - LENGTH + 1), PASS_BYTES - LENGTH):
                part = raw[at : at + PASS_BYTES - 1]
                yield np.array([a]), at, part, np.array([0, len(part)])


class Copies:
    """Skips a task's third and later copies of a text: two show that it repeats."""

    def __init__(self, most: int = 1_000_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def keys(self, column: pa.Array) -> tuple[list[bytes], np.ndarray]:
        keys = [hashlib.md5(x.as_buffer()).digest() if x.is_valid else hashlib.md5(b"").digest() for x in column]
        if len(self.seen) > self.most:
            self.seen.clear()
        live = np.zeros(len(keys), bool)
        for k, key in enumerate(keys):
            n = self.seen.get(key, 0)
            live[k] = n < 2
            self.seen[key] = n + 1
        return keys, live


def anchor_rows(texts: DataFrame) -> DataFrame:
    """h, s: anchor and segment hashes."""

    def scan(batches):
        copies = Copies()
        for batch in batches:
            _, live = copies.keys(batch.column(0))
            for rows, _, raw, offsets in passes(batch.column(0)):
                _, j0, _, h, s = anchors(raw, offsets)
                keep = live[rows[np.searchsorted(offsets, j0, "right") - 1]] if len(j0) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(s[keep].view(np.int64))], ["h", "s"])

    return texts.mapInArrow(scan, "h long, s long")


def segment_rows(texts: DataFrame, alive, several) -> DataFrame:
    """key (md5 of the text), h, s, start, size of each segment whose anchor may
    occur again; with its bytes, once a task, if its anchor may have different
    segments. Equal segments that overlap (in runs and periodic texts) are one
    row with their number and their reach."""

    def scan(batches):
        alive_, several_ = alive.value, several.value
        copies, sent = Copies(), set()
        for batch in batches:
            keys, live = copies.keys(batch.column(0))
            for rows, first, raw, offsets in passes(batch.column(0)):
                _, j0, j1, h, s = anchors(raw, offsets)
                if not len(j0):
                    continue
                doc = np.searchsorted(offsets, j0, "right") - 1
                keep = live[rows[doc]] & alive_.has(h)
                j0, j1, h, s, doc = j0[keep], j1[keep], h[keep], s[keep], doc[keep]
                if not len(j0):
                    continue
                order = np.lexsort((j0, s, h, doc))
                j0, j1, h, s, doc = j0[order], j1[order], h[order], s[order], doc[order]
                new = np.ones(len(j0), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (j0[1:] > j1[:-1] + LENGTH)
                at = np.flatnonzero(new)
                n, end = np.diff(np.append(at, len(j0))), j1[np.append(at[1:], len(j0)) - 1] + LENGTH
                j0, j1, h, s, doc = j0[at], j1[at], h[at], s[at], doc[at]
                need = several_.has(h)
                segments = []
                for k in range(len(j0)):
                    name = (int(h[k]), int(s[k]))
                    if need[k] and name not in sent:
                        sent.add(name)
                        segments.append(raw[j0[k] : j1[k] + LENGTH].tobytes())
                    else:
                        segments.append(None)
                if len(sent) > 1_000_000:
                    sent.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[r] for r in rows[doc]], pa.binary()), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(j0 - offsets[doc] + first), pa.array(j1 - j0 + LENGTH), pa.array(n), pa.array(end - j0), pa.array(segments, pa.binary())],
                    ["key", "h", "s", "start", "size", "n", "reach", "segment"],
                )

    return texts.mapInArrow(scan, "key binary, h long, s long, start long, size long, n long, reach long, segment binary")


class Column:
    """A scratch file of one task that holds an array; it is read and written
    from end to end, and goes with the task."""

    def __init__(self, kind):
        self.kind, self.file = np.dtype(kind), tempfile.TemporaryFile()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(np.ascontiguousarray(values, self.kind).data)


def symbol_numbers(rows: np.ndarray) -> np.ndarray:
    """A number for each different row of bytes: rows are sorted by a hash and
    held against the first of theirs; should two differ, by their bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for column in wide.view(np.uint64).T:
        h = mixed(h * MIX_1 + column)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if (rows[first[number]] != rows).any():
        number = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    return number.astype(np.int64)


def repeated_starts(segments: list[bytes], unit: int = UNIT, length: int = LENGTH) -> list[np.ndarray]:
    """For each of some byte strings, which of its places start a string of
    `length` bytes that starts at another place of these strings too."""
    goal = length // unit
    docs, owner, phase = [], [], []
    for k, s in enumerate(segments):
        for p in range(min(unit, len(s))):
            n = (len(s) - p) // unit
            if n >= goal:
                docs.append(np.frombuffer(s, np.uint8, n * unit, p).reshape(n, unit))
                owner.append(k)
                phase.append(p)
    out = [np.zeros(max(0, len(s) - length + 1), bool) for s in segments]
    if not docs:
        return out
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    symbols = symbol_numbers(np.concatenate(docs))
    d = len(docs)
    rank = np.arange(d)  # of each document's suffix so far; at first the empty ones
    columns = {"sym": Column("<u4"), "rest": Column("<u4"), "doc": Column("<u4"), "unit": Column("<u4"), "lcp": Column("u1")}
    for c in columns.values():
        c.write(np.zeros(0))
    for j in range(int(size.max())):
        sym, rest, doc, place, lcp = (c.read() for c in columns.values())
        live = np.flatnonzero(size > j)
        c = symbols[first[live] + size[live] - 1 - j]
        wanted = (c << 32) | rank[live]
        order = np.argsort(wanted, kind="stable")
        wanted, live, c = wanted[order], live[order], c[order]
        # Suffixes that start with smaller symbols, or with c before the rank of what follows.
        at = np.searchsorted((sym.astype(np.int64) << 32) | rest, wanted) + np.arange(len(live))
        total = len(sym) + len(live)
        new = np.zeros(total, bool)
        new[at] = True
        moved = np.concatenate([np.arange(d), d + np.flatnonzero(~new)])

        def insert(old, values, kind):
            both = np.empty(total, kind)
            both[new], both[~new] = values, old
            return both

        sym, doc = insert(sym, c, np.uint32), insert(doc, live, np.uint32)
        rest = insert(moved[rest], moved[rank[live]], np.int64)
        place = insert(place, size[live] - 1 - j, np.uint32)
        lcp = insert(lcp, 0, np.uint8)
        rank = moved[rank]
        rank[live] = d + at
        # Only neighbours of new places have new common prefixes.
        todo = np.unique(np.concatenate([at, at + 1]))
        todo = todo[(todo > 0) & (todo < total)]
        common = np.zeros(len(todo), np.uint8)
        k, x, y = np.arange(len(todo)), todo - 1, todo
        for step in range(1, goal + 1):
            same = sym[x] == sym[y]
            k, x, y = k[same], rest[x[same]] - d, rest[y[same]] - d
            common[k] = step
            more = (x >= 0) & (y >= 0)
            k, x, y = k[more], x[more], y[more]
            if not len(k):
                break
        lcp[todo] = common
        for column, values in zip(columns.values(), (sym, rest, doc, place, lcp)):
            column.write(values)
    _, _, doc, place, lcp = (c.read() for c in columns.values())
    hit = lcp >= goal
    hit = np.flatnonzero(hit | np.append(hit[1:], False))
    for k, u in zip(doc[hit].tolist(), place[hit].tolist()):
        out[owner[k]][phase[k] + u * unit] = True
    return out


def spans_of(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The bytes covered by strings of `length` at the given ascending places."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


SPANS = "array<struct<a:long,b:long>>"


def bucket_spans(segments: DataFrame, bucket_size: int) -> DataFrame:
    """h, s, spans of the segments (h, s, segment), by the column-wise order."""
    kind = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

    def build(table):
        rows = table.sort_by([("h", "ascending"), ("s", "ascending")]).to_pylist()
        found = []
        at = 0
        while at < len(rows):  # an anchor's segments stay together
            end = min(len(rows), at + bucket_size)
            while end < len(rows) and rows[end]["h"] == rows[end - 1]["h"]:
                end += 1
            part = rows[at:end]
            for r, hit in zip(part, repeated_starts([r["segment"] for r in part])):
                found.append({"h": r["h"], "s": r["s"], "spans": [{"a": a, "b": b} for a, b in spans_of(np.flatnonzero(hit))]})
            at = end
        return pa.Table.from_pylist(found, schema=kind)

    return segments.select("bucket", "h", "s", "segment").groupBy("bucket").applyInArrow(build, f"h long, s long, spans {SPANS}")


def window_spans(segments: DataFrame) -> DataFrame:
    """The same for anchors of very many segments: windows are counted by hash."""

    def windows(batches):
        for batch in batches:
            rows = []
            for h, s, seg in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [{"h": h, "s": s, "place": k, "w": hashlib.md5(seg[k : k + LENGTH]).digest()} for k in range(len(seg) - LENGTH + 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("h", pa.int64()), ("s", pa.int64()), ("place", pa.int64()), ("w", pa.binary())]))

    rows = segments.select("h", "s", "segment").mapInArrow(windows, "h long, s long, place long, w binary")
    twice = rows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    span = F.struct(F.col("place").alias("a"), (F.col("place") + LENGTH).alias("b"))
    return rows.join(twice, "w").groupBy("h", "s").agg(F.collect_list(span).alias("spans"))


def repeated_spans(docs: DataFrame, text_col: str = "text", *, bucket_size: int = 2000, most_segments: int = 20_000) -> DataFrame:
    """key (md5 of a text), spans: byte ranges, which may overlap, that repeat."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= LENGTH)
    seen = anchor_rows(texts).groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    twice = stored(seen.where("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("several")))
    alive = context.broadcast(Membership.of(twice.select("h")))
    several = context.broadcast(Membership.of(twice.where("several").select("h")))
    rows = stored(segment_rows(texts, alive, several))
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("reach")).alias("b")))
    alike = rows.select("key", "h", "start", "reach").join(twice.where("not several").select("h"), "h").select("key", whole.alias("spans"))

    differing = twice.where("several").select("h")
    bytes_of = rows.where("segment is not null").groupBy("h", "s").agg(F.any_value("segment").alias("segment")).join(differing, "h")
    times = stored(rows.groupBy("h", "s").agg(F.sum("n").alias("times")).join(differing, "h"))
    per_anchor = times.groupBy("h").agg(F.count("*").alias("segments"))
    segments = stored(bytes_of.join(per_anchor, "h"))
    usual = segments.where(F.col("segments") <= most_segments)
    buckets = max(1, -(-usual.count() // bucket_size))
    by_order = bucket_spans(usual.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))), bucket_size)
    by_count = window_spans(segments.where(F.col("segments") > most_segments))
    found = times.join(stored(by_order.unionByName(by_count)), ["h", "s"], "left").where("times > 1 or size(spans) > 0").select("h", "s", F.when(F.col("times") == 1, F.col("spans")).alias("spans"))
    moved = F.transform("spans", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
    differ = rows.select("key", "h", "s", "start", "reach").join(found, ["h", "s"]).select("key", F.coalesce(moved, whole).alias("spans"))
    return alike.unionByName(differ).select("key", F.inline("spans")).distinct().groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def key_number(key: str):
    """The first 8 bytes of a key as a long."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def without_spans(raws: pa.Array, spans: pa.Array, characters: bool = False) -> pa.StructArray:
    """n_bytes, n_removed, n_spans and kept of each text. characters: what the spans
    leave of a cut character goes as well. About a megabyte of text is handled
    at a time, and spans don't become Python objects."""
    none = np.zeros(0, np.int64)
    sizes, gone, runs, left, kept = [none], [none], [none], [none], [np.zeros(0, np.uint8)]
    for i, j, raw, offsets in text_slices(raws):
        part = spans.slice(i, j - i)
        doc = np.repeat(np.arange(j - i), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = part.flatten()
        start, end = (offsets[doc] + flat.field(x).to_numpy(zero_copy_only=False) for x in ("a", "b"))
        order = np.argsort(start, kind="stable")
        start, end, doc = start[order], np.maximum.accumulate(end[order]), doc[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        start, end, doc = start[at], end[np.append(at, len(end))[1:] - 1], doc[at]
        edge = np.zeros(len(raw) + 1, np.int8)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        rest = raw[np.cumsum(edge[:-1], dtype=np.int8) == 0]
        sizes.append(np.diff(offsets))
        gone.append(np.bincount(doc, end - start, j - i).astype(np.int64))
        runs.append(np.bincount(doc, minlength=j - i))
        left.append(sizes[-1] - gone[-1])
        if characters and len(rest) and rest.max() > 127:
            texts = [x.tobytes() for x in np.split(rest, np.cumsum(left[-1])[:-1])]
            texts = [x.decode("utf-8", "ignore").encode() if n else x for x, n in zip(texts, gone[-1].tolist())]
            rest, left[-1] = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, j - i)
        kept.append(rest)
    large = pa.types.is_large_binary(raws.type)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(left))]).astype(np.int64 if large else np.int32)
    kept = pa.Array.from_buffers(raws.type, len(raws), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(kept))])
    return pa.StructArray.from_arrays([*(pa.array(np.concatenate(x)) for x in (sizes, gone, runs)), kept], ["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, text_col: str = "text", *, characters: bool = False, **options) -> DataFrame:
    """row (all columns of docs), n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (the remaining bytes; with characters those that are whole
    characters) of each row. Only texts that may lose bytes are moved between
    executors, and only these pass through Python, once and without their rows."""
    spans = stored(repeated_spans(docs, text_col, **options))
    filter_ = docs.sparkSession.sparkContext.broadcast(Membership.of(spans.select(key_number("key").alias("k"))))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(raw)).alias("key"))

    @F.arrow_udf("boolean")
    def may_lose(number: pa.Array) -> pa.Array:
        return pa.array(filter_.value.has(number.to_numpy(zero_copy_only=False)), pa.bool_())

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(raw: pa.Array, spans: pa.Array) -> pa.Array:
        return without_spans(raw, spans, characters)

    some = may_lose(key_number("key"))
    raw = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).cast("binary")
    nothing = F.lit(0).cast("long")
    touched = keyed.where(some).join(spans, "key", "left").select("row", cut(raw, "spans").alias("cut")).select("row", "cut.*")
    whole = keyed.where(~some).select("row", F.octet_length(raw).cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), raw.alias("kept"))
    return whole.unionByName(touched)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
