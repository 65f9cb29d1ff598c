"""Chroma audio fingerprints: find and align recordings.

A recording is cut into overlapping frames; the power spectrum of each is folded
into twelve pitch classes. Sixteen filters compare sums over rectangles of this
image, read from its integral image; each gives two bits, and the thirty-two
bits of a place are one integer. Equal integers of two recordings vote for the
offset between them; at the offset with most votes the share of wrong bits tells
whether they are the same.

Every query is compared with every recording. The queries' integers are the index
that tasks get, in blocks of bounded size, and recordings pass by it: all votes
of a pair meet in one task, so nothing but aligned pairs leaves it, and no
integer or partner is left out. Queries with equal integers are one entry of
the index with several ids, equal recordings of a batch are read once; align()
still gives each pair. Families of copies make more pairs than rows, so
best_alignments() gives one row per recording: the number of queries that it is
aligned with, and the best of them; tasks add up what they find before anything
is shuffled. Runs of one integer (silence, steady tones) vote once.

Samples are unsigned 8-bit mono PCM. Null, empty or short recordings, under one
filter's width of frames, have no integers and align with nothing. Rows with a
null id aren't indexed. Rows of the same id count as one recording, the longest.
Other columns are ignored. Of offsets with equal votes, and of queries aligned
equally well, see align() and best_alignments() for which one is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

RATE, FRAME, HOP = 11025, 256, 32
CLASSES, WIDTH = 12, 6


def chroma_fold(rate: int = RATE, frame: int = FRAME, low: float = 60.0, high: float = 5000.0) -> np.ndarray:
    """bins x classes: to which pitch class each bin of the spectrum counts."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(f), CLASSES), np.float32)
    for k, x in enumerate(f):
        if low <= x <= high:
            out[k, int(round(CLASSES * np.log2(x / 440.0))) % CLASSES] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """kind, first class, classes, frames of the sixteen filters: four shapes
    (halves in class, halves in time, quarters, middle against the rest) at four places."""
    return [(kind, (3 * place + kind) % (CLASSES - 5), 4 + 2 * (place % 2), WIDTH - 2 * (kind == 1 and place % 2)) for kind in range(4) for place in range(4)]


def chroma(samples: np.ndarray) -> np.ndarray:
    """frames x classes, each frame scaled to length 1."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, CLASSES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    out = np.empty((n, CLASSES), np.float32)
    for k in range(0, n, 4096):
        x = (frames[k : k + 4096].astype(np.float32) - 128) * _WINDOW
        s = np.fft.rfft(x, axis=1)
        out[k : k + 4096] = (s.real**2 + s.imag**2).astype(np.float32) @ _FOLD
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


_WINDOW = np.hanning(FRAME).astype(np.float32)
_FOLD = chroma_fold()
_FILTERS = filters()
#: Of a filter's logarithm, where its two bits change.
STEPS = (-0.25, 0.0, 0.25)


def integers(samples: np.ndarray) -> np.ndarray:
    """The packed integers of a recording."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t0, t1, c0, c1):
        return total[t1 : t1 + n, c1] - total[t0 : t0 + n, c1] - total[t1 : t1 + n, c0] + total[t0 : t0 + n, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in _FILTERS:
        whole = area(0, w, c, c + h)
        if kind == 0:
            a = area(0, w, c, c + h // 2)
        elif kind == 1:
            a = area(0, w // 2, c, c + h)
        elif kind == 2:
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
        else:
            a = area(w // 3, 2 * w // 3, c, c + h)
            whole = whole + a  # a third against two thirds
        value = np.log((1 + a) / (1 + whole - a))
        level = np.searchsorted(STEPS, value).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbours differ in one bit
    return out


def fingerprints(recordings: DataFrame, id_col: str = "doc_id", pcm_col: str = "pcm") -> DataFrame:
    """doc_id, n, ints (little-endian unsigned 32-bit) of each recording."""

    def scan(batches):
        for batch in batches:
            ints = [integers(np.frombuffer(x.as_buffer(), np.uint8)) if x.is_valid else np.zeros(0, np.uint32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ints], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ints], pa.binary())], ["doc_id", "n", "ints"])

    rows = recordings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pcm_col).cast("binary").alias("pcm")).where("doc_id is not null")
    longest = F.max(F.struct("n", "ints")).alias("x")
    return rows.mapInArrow(scan, "doc_id long, n long, ints binary").groupBy("doc_id").agg(longest).select("doc_id", "x.n", "x.ints")


def places(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """number in the list, integer, place: the first place of each run of an integer."""
    at = [np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64) for v in prints]
    size = np.fromiter(map(len, at), np.int64, len(at))
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return np.repeat(np.arange(len(at)), size), joined([v[k] for v, k in zip(prints, at)], np.uint32), joined(at, np.int64)


def spread(size: np.ndarray, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For entries of these sizes the entry and the place in it of each element, limit elements at a time."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    for k in range(0, total, limit or max(1, total)):
        at = np.arange(k, min(total, k + (limit or total)))
        entry = np.searchsorted(ends, at, "right")
        yield entry, at - (ends - size)[entry]


def one_spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return next(spread(size), (np.zeros(0, np.int64), np.zeros(0, np.int64)))


class Prints:
    """Distinct fingerprints one after another, each with the ids that have it."""

    def __init__(self, prints: list[np.ndarray], ids: list[list[int]]):
        self.size = np.fromiter(map(len, prints), np.int64, len(prints))
        self.first = np.cumsum(self.size) - self.size
        self.ints = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        self.n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.ids = np.fromiter((i for x in ids for i in x), np.int64, int(self.n_ids.sum()))


class Index(Prints):
    """Where each integer occurs in the queries of a block."""

    def __init__(self, prints: list[np.ndarray], ids: list[list[int]]):
        super().__init__(prints, ids)
        query, value, at = places(prints)
        order = np.argsort(value, kind="stable")
        self.value, self.start, self.n = np.unique(value[order], return_index=True, return_counts=True)
        self.query, self.at = query[order].astype(np.int32), at[order].astype(np.int32)

    def votes(self, recordings: list[np.ndarray], least: int, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
        """recording, query, shift, votes at the shift with most votes (of equal
        ones the nearest to 0) of each pair with that many; about limit hits at a time."""
        number, value, at = places(recordings)
        if not len(value) or not len(self.value):
            return
        k = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        hit = self.value[k] == value
        number, at, k = number[hit], at[hit], k[hit]
        before = np.concatenate([[0], np.cumsum(self.n[k])])
        ends = np.flatnonzero(np.concatenate([number[1:] != number[:-1], [True]])) + 1 if len(number) else []
        low = 0
        for i, high in enumerate(ends):
            if i + 1 < len(ends) and before[ends[i + 1]] - before[low] <= limit:
                continue
            entry, place = one_spread(self.n[k[low:high]])
            own = self.start[k[low:high]][entry] + place
            shift = at[low:high][entry] - self.at[own]
            near, span = int(shift.min()), int(shift.max() - shift.min()) + 1
            key = ((number[low:high][entry] - number[low]) * len(self.size) + self.query[own]) * span + (shift - near)
            key.sort()
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([cut, [len(key)]]))
            key, n = key[cut][n >= least], n[n >= least]
            pair, shift = key // span, key % span + near
            order = np.lexsort((-shift, np.abs(shift), -n, pair))
            pair, shift, n = pair[order], shift[order], n[order]
            best = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
            pair = pair[best]
            yield number[low] + pair // len(self.size), pair % len(self.size), shift[best], n[best]
            low = high


def wrong_bits(mine: Prints, own: np.ndarray, theirs: Prints, other: np.ndarray, shift: np.ndarray, overlap: np.ndarray, limit: int = 1 << 21) -> np.ndarray:
    """Bits that differ where the recordings lie over the queries."""
    out = np.zeros(len(own), np.int64)
    a, b = mine.first[own] + np.maximum(0, -shift), theirs.first[other] + np.maximum(0, shift)
    for entry, place in spread(overlap, limit):
        out += np.bincount(entry, weights=np.bitwise_count(mine.ints[a[entry] + place] ^ theirs.ints[b[entry] + place]), minlength=len(own)).astype(np.int64)
    return out


#: Integers of the queries that one block's index holds, about.
BLOCK = 1 << 20


PAIR = ["query_id", "doc_id", "shift", "votes", "overlap", "bit_errors"]


def align(prints: DataFrame, queries: DataFrame, *, best_only: bool = False, least_votes: int = 2, least_overlap: int = 6, most_wrong: float = 0.2, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, shift (place in the recording less place in the query),
    votes, overlap (integers), bit_errors, error_rate of all aligned recordings.
    With best_only, of what one task finds for a recording at a time only the
    best one, with the number found as links."""
    spark = prints.sparkSession
    names = PAIR + (["links"] if best_only else [])
    schema = ", ".join(f"{x} long" for x in names)

    def against(shared):
        def scan(batches):
            index = shared.value
            for batch in batches:
                same: dict[bytes, list[int]] = {}
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    same.setdefault(raw, []).append(doc)
                recordings = [np.frombuffer(raw, "<u4") for raw in same]
                theirs = Prints(recordings, list(same.values()))
                for other, own, shift, votes in index.votes(recordings, least_votes):
                    overlap = np.minimum(index.size[own] - np.maximum(0, -shift), theirs.size[other] - np.maximum(0, shift))
                    keep = overlap >= least_overlap
                    other, own, shift, votes, overlap = (x[keep] for x in (other, own, shift, votes, overlap))
                    wrong = wrong_bits(index, own, theirs, other, shift, overlap)
                    keep = wrong <= most_wrong * 32 * overlap
                    other, own, *rest = (x[keep] for x in (other, own, shift, votes, overlap, wrong))
                    for entry, place in spread(theirs.n_ids[other] * index.n_ids[own], 1 << 18):
                        per = index.n_ids[own[entry]]
                        query = index.ids[index.first_id[own[entry]] + place % per]
                        doc = theirs.ids[theirs.first_id[other[entry]] + place // per]
                        apart = query != doc
                        columns = [x[apart].astype(np.int64) for x in (query, doc, *(x[entry] for x in rest))]
                        if best_only:
                            order = np.lexsort((columns[0], -columns[3], columns[5] / columns[4], columns[1]))
                            columns = [x[order] for x in columns]
                            at = np.flatnonzero(np.concatenate([[True], columns[1][1:] != columns[1][:-1]])) if len(order) else order
                            columns = [x[at] for x in columns] + [np.diff(np.append(at, len(order)))]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

        return scan

    total = queries.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block)
    wanted = queries.where("n > 0").withColumn("block", F.pmod(F.xxhash64("ints"), F.lit(max(1, blocks))))
    parts = []
    for k in range(blocks):
        rows = wanted.where(F.col("block") == k).groupBy("ints").agg(F.collect_list("doc_id").alias("ids")).toArrow()
        shared = spark.sparkContext.broadcast(Index([np.frombuffer(x, "<u4") for x in rows.column("ints").to_pylist()], rows.column("ids").to_pylist()))
        found = prints.select("doc_id", "ints").where("n > 0").mapInArrow(against(shared), schema)
        if blocks > 1:  # one block's index at a time
            found = stored(found)
            shared.destroy()
        parts.append(found)
    out = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return out.withColumn("error_rate", F.col("bit_errors") / (32 * F.col("overlap")))


def best_alignments(prints: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Of each recording of prints: doc_id, n_integers, n_links (queries that it
    is aligned with, itself left out), and of the one with the smallest share of
    wrong bits (then most votes, then smallest id) query_id, shift, votes,
    overlap, bit_errors, error_rate; nulls if there's none."""
    best = F.min(F.struct("error_rate", (-F.col("votes")).alias("v"), *(x for x in PAIR if x != "doc_id"))).alias("b")
    found = align(prints, queries, best_only=True, **options).groupBy("doc_id").agg(F.sum("links").alias("n_links"), best)
    rows = prints.select("doc_id", F.col("n").alias("n_integers")).join(found, "doc_id", "left")
    return rows.select("doc_id", "n_integers", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *(F.col(f"b.{x}") for x in (*PAIR, "error_rate") if x != "doc_id"))


def op1_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The bytes of each document's text are its recording's samples; ids
    divisible by 100 are the queries. One row per document."""
    recordings = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("pcm"))
    prints = stored(fingerprints(recordings))
    return best_alignments(prints, prints.where(F.col("doc_id") % 100 == 0))
