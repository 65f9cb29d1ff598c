"""Subword lattice likelihood.

A text is read as its lower-cased words, each after a space mark, and one end.
The pieces of an existing subword vocabulary, weighted by log probabilities,
span a lattice over each word; the forward recursion in log space adds up all
segmentations, so a text's score is its marginal probability and not that of
one best cut. A word seen more than once in the training texts has one more
edge, from its first place to its last. Pieces never cross words, so words can be
looked up once.

The vocabulary's own scores (ranks of merges, read as a Zipf law) are where the
weights start; rounds of expectation maximisation over the counted words of the
training texts move them. What a round sends is one vector as long as the
vocabulary. Whole-word edges have the training share of their word less a
discount; the mass that discounts and rarer words leave goes to the pieces, and
these are fitted to just that mass. So all texts' probabilities add up to 1.

Null and empty texts have the end alone. A null doc_id counts as the text ''
where training texts are told from held-out ones. Repeated rows count and are
scored as often as they occur. With no training text at all, the weights stay
those of the vocabulary and no token is known. Texts are read whole, whatever
their length. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, documents, id_text, stored

#: Bytes that part words (fixed by the contract): what bytes.split() takes as white space.
SPACE = 0x20


def read_pieces(model: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as lower-cased bytes, with a leading space
    for the word mark, and their starting log probabilities. Each single byte is
    a piece, so every word has a path."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    weight: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for k in range(sp.get_piece_size()):
        if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k):
            continue
        piece = sp.id_to_piece(k).replace("▁", " ").encode().lower()
        if SPACE in piece[1:]:
            continue
        weight[piece] = weight.get(piece, 0.0) + 1.0 / (10.0 - sp.get_score(k))
    pieces = list(weight)
    p = np.array(list(weight.values()))
    p[p == 0] = p[p > 0].min()
    return pieces, np.log(p / p.sum())


class Lattice:
    """All pieces in a batch of words, found by walking a trie of the
    vocabulary from all positions at once."""

    def __init__(self, pieces: list[bytes]):
        used = sorted({b for p in pieces for b in p})
        self.code = np.zeros(256, np.int32)
        self.code[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = k
        self.next = np.zeros((len(children), len(used)), np.int32)
        for node, kids in enumerate(children):
            for b, nxt in kids.items():
                self.next[node, self.code[b]] = nxt
        self.piece = np.array(ends, np.int32)
        self.longest = max(map(len, pieces))

    def edges(self, words: list[bytes]):
        """Positions of the batch (each word has len + 2: its mark, its bytes,
        its end), and edges from, to, piece, with both word-relative ends."""
        raw = b"".join(b" " + w + b"\0" for w in words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        last = first + size - 1  # the place after a word's final byte
        code = self.code[np.frombuffer(raw, np.uint8)]
        stop = np.repeat(last, size)
        at = np.flatnonzero(np.arange(len(raw)) < stop)
        start, node = at, np.zeros(len(at), np.int32)
        found = []
        for _ in range(self.longest):
            node = self.next[node, code[at]]
            alive = node > 0
            start, at, node = start[alive], at[alive] + 1, node[alive]
            hit = self.piece[node] >= 0
            found.append((start[hit], at[hit], self.piece[node[hit]]))
            more = at < stop[start]
            start, at, node = start[more], at[more], node[more]
            if not len(at):
                break
        a, b, piece = (np.concatenate([f[k] for f in found]) for k in range(3))
        return first, last, len(raw), a, b, piece

    @staticmethod
    def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        return order, np.concatenate([[0], np.flatnonzero(np.diff(sorted_key)) + 1, [len(key)]])

    def forward(self, words: list[bytes], logp: np.ndarray, counts: np.ndarray | None = None):
        """The log probability of each word; with counts also the expected
        number of each piece."""
        if not words:
            return np.zeros(0), np.zeros(len(logp))
        first, last, size, a, b, piece = self.edges(words)
        begin = np.repeat(first, last - first + 1)
        lp = logp[piece]
        alpha = np.full(size, -np.inf)
        alpha[first] = 0.0
        order, cut = self._runs((b - begin[a]) * 64 + (b - a))
        for k in range(len(cut) - 1):  # ends in ascending order; within one, each word once
            e = order[cut[k] : cut[k + 1]]
            alpha[b[e]] = np.logaddexp(alpha[b[e]], alpha[a[e]] + lp[e])
        total = alpha[last]
        if counts is None:
            return total, None
        beta = np.full(size, -np.inf)
        beta[last] = 0.0
        end = np.repeat(last, last - first + 1)
        order, cut = self._runs((end[a] - a) * 64 + (b - a))
        for k in range(len(cut) - 1):
            e = order[cut[k] : cut[k + 1]]
            beta[a[e]] = np.logaddexp(beta[a[e]], beta[b[e]] + lp[e])
        weight = np.repeat(counts, last - first + 1)[a]
        post = np.exp(alpha[a] + lp + beta[b] - np.repeat(total, last - first + 1)[a]) * weight
        return total, np.bincount(piece, weights=post, minlength=len(logp))


def by_length(words: list[bytes], limit: int = 4000) -> Iterator[np.ndarray]:
    """Indexes of words in batches of like lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for k in range(0, len(order), limit):
        yield order[k : k + limit]


_lattices: dict[int, Lattice] = {}


def lattice_of(pieces: list[bytes]) -> Lattice:
    key = hash(tuple(pieces))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(pieces)
    return _lattices[key]


def tokens(text: str | None) -> list[bytes]:
    """Words: A-Z lower-cased, cut at the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """word, c over all texts; each task adds up what it reads first."""

    def count(batches):
        from collections import Counter

        seen: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_weights(counts: DataFrame, pieces: list[bytes], start: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Expectation maximisation over words with weights (word, c). The starting
    weights count as a tenth of an occurrence a piece on average."""
    logp = start
    for _ in range(rounds):

        def expected(batches, logp=logp):
            lattice = lattice_of(pieces)
            total = np.zeros(len(logp))
            for batch in batches:
                words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for k in by_length(words):
                    total += lattice.forward([words[i] for i in k], logp, c[k])[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

        n = 0.1 * np.exp(start) * len(start)
        for r in counts.mapInArrow(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            n[r.piece] += r.n
        logp = np.log(n / n.sum())
    return logp


def lattice_scores(docs: DataFrame, train: DataFrame, model: str, *, head: int = 300_000, rounds: int = 3, discount: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    The most frequent words (those with a higher count than the word at place
    `head`, so at most that many) and their counts go to every task: a table of
    that bound. The other words of each text, with their pieces' log probability,
    are joined with their counts, which gives their part of base_score and, with
    the edge of each word seen more than once, of score: `head` moves work only.
    """
    spark = docs.sparkSession
    docs, train = id_text(docs, id_col, text_col), id_text(train, id_col, text_col)
    pieces, start = read_pieces(model)
    counts = stored(word_counts(train))
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n_all, v_all = n_words + ends, distinct + (ends > 0)
    below = math.log10(n_all + 0.5 * (v_all + 1))
    at_head = counts.select("c").orderBy(F.desc("c")).limit(head + 1).agg(F.min("c"), F.count("*")).first()
    cut = max(1, at_head[0]) if at_head[1] > head else 1
    top = counts.where(F.col("c") > cut).toArrow()
    top_words, top_counts = top.column("word").combine_chunks(), top.column("c").to_numpy()
    base_of_top = np.log10(top_counts + 0.5)
    edge_of_top = np.log((top_counts - discount) / max(1, n_all))
    end = ends / n_all if n_all else 0.5
    more, repeats = counts.where("c > 1").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rest = math.log(max(1e-12, 1 - end - (more - discount * repeats) / max(1, n_all)))
    weighed = counts.select("word", F.when(F.col("c") > 1, F.lit(discount)).otherwise(F.col("c")).cast("double").alias("c"))
    logp = fit_weights(weighed, pieces, start, rounds) if n_words else start
    shared = spark.sparkContext.broadcast((top_words, base_of_top, edge_of_top, pieces, logp))

    def score(batches):
        top_words, base_of_top, edge_of_top, pieces, logp = shared.value
        lattice = lattice_of(pieces)
        row = TaskContext.get().partitionId() << 36
        number: dict[bytes, int] = {}
        words: list[bytes] = []
        marginal = base = np.zeros(0)

        def restart():
            nonlocal number, words, marginal, base
            words = top_words.to_pylist()
            number = dict(zip(words, range(len(words))))
            base = base_of_top
            marginal = np.full(len(words), np.nan)

        restart()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = texts[at : at + 256]
                if len(words) > 3 * head + 500_000:
                    restart()
                split = [tokens(t.as_py()) for t in part]
                for t in {w for x in split for w in x if w not in number}:
                    number[t] = len(words)
                    words.append(t)
                grown = len(words) - len(marginal)
                marginal = np.concatenate([marginal, np.full(grown, np.nan)])
                base = np.concatenate([base, np.full(grown, np.nan)])
                size = np.fromiter(map(len, split), np.int64, len(split))
                doc = np.repeat(np.arange(len(split)), size)
                idx = np.fromiter((number[w] for x in split for w in x), np.int64, int(size.sum()))
                new = np.unique(idx[np.isnan(marginal[idx])])
                new_words = [words[i] for i in new]
                for k in by_length(new_words):
                    marginal[new[k]] = lattice.forward([new_words[i] for i in k], logp)[0] + rest
                own = new[new < len(edge_of_top)]
                marginal[own] = np.logaddexp(marginal[own], edge_of_top[own])
                b = base[idx]
                tail = np.isnan(b)
                total = np.bincount(doc[~tail], weights=marginal[idx[~tail]], minlength=len(split)).astype(float) + math.log(end)
                known = np.bincount(doc[~tail], minlength=len(split))
                sums = np.bincount(doc[~tail], weights=b[~tail], minlength=len(split)).astype(float)
                pair, tf = np.unique(doc[tail] * len(words) + idx[tail], return_counts=True)
                per_doc = np.bincount(pair // max(1, len(words)), minlength=len(split)) if len(pair) else np.zeros(len(split), np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(split))),
                        pa.array(ids[at : at + 256], pa.int64()),
                        pa.array(size + 1),
                        pa.array(known.astype(np.int64)),
                        pa.array(sums),
                        pa.array(total),
                        pa.ListArray.from_arrays(offsets, pa.array([words[i] for i in pair % max(1, len(words))], pa.binary())),
                        pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(marginal[pair % max(1, len(words))])),
                    ],
                    ["row", "doc_id", "n_tokens", "known", "sums", "total", "words", "tf", "pieces"],
                )
                row += len(split)

    scored = stored(docs.mapInArrow(score, "row long, doc_id long, n_tokens long, known long, sums double, total double, words array<binary>, tf array<int>, pieces array<double>"))
    tail = scored.select("row", F.explode(F.arrays_zip("words", "tf", "pieces")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.tf").alias("tf"), F.col("w.pieces").alias("pieces"))
    edge = F.log((F.col("c") - discount) / max(1, n_all))
    either = F.greatest(edge, "pieces") + F.log1p(F.exp(-F.abs(edge - F.col("pieces"))))
    added = (
        tail.join(counts, "word", "left")
        .select("row", "tf", "pieces", F.coalesce("c", F.lit(0)).alias("c"))
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("tail_sums"),
            F.sum(F.col("tf") * F.when(F.col("c") > 1, either).otherwise(F.col("pieces"))).alias("tail_total"),
        )
    )
    zero = F.lit(0)
    return (
        scored.drop("words", "tf", "pieces")
        .join(added, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("tail_known", zero) + (1 if ends else 0)).cast("long").alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("sums") + F.coalesce("tail_sums", F.lit(0.0)) + math.log10(ends + 0.5) - F.col("n_tokens") * below).alias("base_score"),
            ((F.col("total") + F.coalesce("tail_total", F.lit(0.0))) / math.log(10)).alias("score"),
        )
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_bucket("doc_id", 5) == 1
    scores = lattice_scores(docs, docs.where(~held_out), default_model())
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
