"""Toxicity by a bidirectional gated recurrent network with attention.

A word's inputs are the learned vector of the word, if at least three training
documents have it, the mean of the learned vectors of its byte n-grams (hashed
to a fixed table), and a score of how much oftener toxic documents have the
word. While training, that score comes from the other folds of the documents, so
the network learns how far to trust it; and now and then a known word is trained
as an unknown one, so the n-grams learn to do without. All inputs are live in
every batch; without the score (`word_score=False`) the network still learns,
with fewer labels less well. A recurrent pass in each direction
reads a window, attention weighs its places, and the pooled state gives the
window's logit. A document is scored on all its overlapping windows and gets
the largest. Everything is numpy.

Training is one task, on all windows of at most `most` labelled documents of
each kind (those with the smallest hashes of their ids); the driver gets the
weights. A toxic document
need not be toxic everywhere, so after a first phase only its highest windows
are trained as toxic. A fifth of the documents is kept aside; it straightens
the scores.

Null, empty and white texts are scored as one empty window. Labels that are
null are left out; the larger of repeated labels counts. Without labels of both
kinds every score is the share of label 1, or 0.5.

Rows with a null id are scored, but no label finds them. Repeated rows are scored
each and, if their id is labelled, trained each, up to twice `most` rows in all. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_1, crc_bucket, documents, id_text, mixed, stored
from .hashing import powers, prefix_sums

GRAM_ROWS = 1 << 13
GRAMS = (3, 5)
EDGE = bytes(set(range(33, 127)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz"))
WINDOW, STRIDE = 64, 32
FOLDS = 4
#: The n-grams of so many different words are looked at together in training.
WORDS_AT_ONCE = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_inputs(words: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row in the word table, 0 for unknown ones; its n-grams as
    (word, row) pairs. Marks at a word's ends don't count."""
    bare = [w.strip(EDGE) or w for w in words]
    marked = [b"<" + w + b">" for w in bare]
    raw = np.frombuffer(b"".join(marked), np.uint8)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    sums, back = prefix_sums(raw), powers(len(raw) + 1)[1]
    of = np.repeat(np.arange(len(words)), size)
    word, row = [], []
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(raw)) + n <= end[of])
        word.append(of[at])
        row.append((mixed((sums[at + n] - sums[at]) * back[at] + np.uint64(n * int(MIX_1) % 2**64)) % np.uint64(GRAM_ROWS)).astype(np.int64))
    own = np.fromiter((known.get(w, 0) for w in bare), np.int64, len(bare))
    return own, np.concatenate(word), np.concatenate(row)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights and passes. places: [windows, WINDOW] numbers of words, -1 where a window has no more."""

    def __init__(self, known: dict[bytes, int], seed: int = 11, d: int = 8, hidden: int = 8, attention: int = 8):
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.hidden = h = hidden
        self.known, self.slope, self.shift = known, 1.0, 0.0
        self.lean = np.zeros(len(known) + 1, np.float32)
        self.w = {
            "word": f(len(known) + 1, d, k=0.1), "gram": f(GRAM_ROWS, d, k=0.3), "in": f(2 * d + 1, 6 * h, k=0.4), "in0": np.zeros(6 * h, np.float32),
            "fore": f(h, 3 * h, k=0.3), "back": f(h, 3 * h, k=0.3), "att": f(2 * h, attention, k=0.4), "att0": np.zeros(attention, np.float32),
            "attv": f(attention, k=0.5), "out": f(2 * h, k=0.5), "out0": np.full(1, -1.0, np.float32),
        }

    def inputs(self, words: list[bytes]):
        own, word, row = word_inputs(words, self.known)
        return own, word, row, self.lean[own]

    def project(self, inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The gates' inputs of each word, its features, and its n-grams' number."""
        own, word, row, lean = inputs
        n = np.maximum(np.bincount(word, minlength=len(own)), 1).astype(np.float32)
        gram = self.w["gram"]
        mean = np.stack([np.bincount(word, weights=gram[row, k], minlength=len(own)) for k in range(gram.shape[1])], 1).astype(np.float32) / n[:, None]
        features = np.concatenate([self.w["word"][own], mean, lean[:, None]], 1)
        return features @ self.w["in"] + self.w["in0"], features, n

    def _pass(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """x: [time, windows, 3 hidden]; the states of each time."""
        h3 = self.hidden
        h = np.zeros((x.shape[1], h3), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h3), np.float32)
        for t in range(x.shape[0]):
            a = h @ u
            zr = 1 / (1 + np.exp(-(x[t, :, : 2 * h3] + a[:, : 2 * h3])))
            z, r = zr[:, :h3], zr[:, h3:]
            n = np.tanh(x[t, :, 2 * h3 :] + r * a[:, 2 * h3 :])
            new = (n + z * (h - n)) * mask[t]
            if keep is not None:
                keep.append((h, a, z, r, n))
            out[t] = h = new
        return out

    def forward(self, projected: np.ndarray, places: np.ndarray, keep: dict | None = None) -> np.ndarray:
        h = self.hidden
        mask = (places.T >= 0).astype(np.float32)[:, :, None]
        x = projected[np.maximum(places.T, 0)]
        k1, k2 = ([], []) if keep is not None else (None, None)
        fore = self._pass(x[:, :, : 3 * h], mask, self.w["fore"], k1)
        back = self._pass(x[::-1, :, 3 * h :], mask[::-1], self.w["back"], k2)[::-1]
        states = np.concatenate([fore, back], 2)
        e = np.tanh(states @ self.w["att"] + self.w["att0"])
        s = e @ self.w["attv"] + (mask[:, :, 0] - 1) * 1e4
        s = np.exp(s - s.max(0))
        a = s / s.sum(0)
        a = a * mask[:, :, 0]
        pooled = np.einsum("tb,tbk->bk", a, states)
        if keep is not None:
            keep |= {"mask": mask, "k1": k1, "k2": k2, "states": states, "e": e, "a": a, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["out0"][0]

    def _pass_back(self, keep: list, mask: np.ndarray, d_out: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h3 = self.hidden
        dx = np.empty((len(keep), d_out.shape[1], 3 * h3), np.float32)
        du, dh = np.zeros_like(u), np.zeros_like(d_out[0])
        for t in range(len(keep) - 1, -1, -1):
            h, a, z, r, n = keep[t]
            g = (dh + d_out[t]) * mask[t]
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (h - n) * z * (1 - z)
            dr = dn * a[:, 2 * h3 :] * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], 1)
            da = np.concatenate([dz, dr, dn * r], 1)
            du += h.T @ da
            dh = g * z + da @ u.T
        return dx, du

    def gradients(self, inputs, places: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, h = self.w, self.hidden
        own, word, row, _ = inputs
        projected, features, n = self.project(inputs)
        k: dict = {}
        logit = self.forward(projected, places, k)
        p = sigmoid(logit)
        total = max(weight.sum(), 1e-6)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / total)
        d = (weight * (p - y) / total).astype(np.float32)
        g = {"out": d @ k["pooled"], "out0": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * w["out"]
        d_states = k["a"][:, :, None] * d_pooled
        d_a = np.einsum("bk,tbk->tb", d_pooled, k["states"])
        d_s = k["a"] * (d_a - (k["a"] * d_a).sum(0))
        g["attv"] = np.einsum("tb,tbk->k", d_s, k["e"])
        d_e = d_s[:, :, None] * w["attv"] * (1 - k["e"] ** 2)
        g["att"] = np.tensordot(k["states"], d_e, ((0, 1), (0, 1)))
        g["att0"] = d_e.sum((0, 1))
        d_states = d_states + d_e @ w["att"].T
        dx1, g["fore"] = self._pass_back(k["k1"], k["mask"], d_states[:, :, :h], w["fore"])
        dx2, g["back"] = self._pass_back(k["k2"], k["mask"][::-1], d_states[::-1, :, h:], w["back"])
        dx = np.concatenate([dx1, dx2[::-1]], 2)
        here = places.T >= 0
        dp = np.zeros_like(projected)
        np.add.at(dp, places.T[here], dx[here])
        g["in"], g["in0"] = features.T @ dp, dp.sum(0)
        df = dp @ w["in"].T
        half = w["word"].shape[1]
        g["word"] = np.zeros_like(w["word"])
        np.add.at(g["word"], own, df[:, :half])
        g["gram"] = np.zeros_like(w["gram"])
        np.add.at(g["gram"], row, (df[:, half : 2 * half] / n[:, None])[word])
        return loss, g


class Constant:
    """The score where there's nothing to learn from."""

    def __init__(self, share: float):
        self.share = share


def windows_of(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """First places of the windows over n words: each overlaps the next."""
    return np.arange(0, max(1, n - (window - stride)), stride)


def train(docs: Iterable[tuple[int, bool, list[bytes]]], *, steps: int = 300, batch: int = 256, rate: float = 0.02, decay: float = 3.0, dropped: float = 0.1, unknown: float = 0.5, least_docs: int = 3, word_score: bool = True, seed: int = 3) -> Network | Constant:
    """docs: label, whether it is kept aside, and words. Adam on batches of
    windows, half of them toxic; then a logistic fit of the largest logits of
    the documents kept aside, which puts the share of toxic ones right."""
    number: dict[bytes, int] = {}
    places, of, labels, kept_aside = [], [], [], []
    for label, apart, words in docs:
        at = windows_of(len(words))
        row = np.full(len(words) + WINDOW, -1, np.int32)
        row[: len(words)] = [number.setdefault(x, len(number)) for x in words]
        places.append(row[at[:, None] + np.arange(WINDOW)])
        of.append(np.full(len(at), len(labels), np.int32))
        labels.append(label)
        kept_aside.append(apart)
    labels, aside = np.array(labels, np.int64), np.array(kept_aside, bool)
    if not len(labels) or aside.all() or labels[~aside].min() == labels[~aside].max():
        return Constant(float(labels.mean()) if len(labels) else 0.5)
    places, of = np.concatenate(places), np.concatenate(of)
    words = list(number)
    bare = {w: k for k, w in enumerate(dict.fromkeys(w.strip(EDGE) or w for w in words))}
    as_bare = np.fromiter((bare[w.strip(EDGE) or w] for w in words), np.int64, len(words))
    held = [np.unique(as_bare[part[part >= 0]]) for part in np.split(places, np.flatnonzero(np.diff(of)) + 1)]
    pair_word, pair_doc = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
    often = np.bincount(pair_word[~aside[pair_doc]], minlength=len(bare)) >= max(least_docs, (~aside).sum() // 500)
    net, rng = Network({w: k + 1 for k, w in enumerate(w for w, i in bare.items() if often[i])}, seed), np.random.default_rng(seed)
    fold = np.where(aside, FOLDS, np.cumsum(~aside) % FOLDS)
    leans = np.zeros((FOLDS + 1, len(net.known) + 1), np.float32)
    row_of = np.fromiter((net.known.get(w, 0) for w in bare), np.int64, len(bare))
    for k in range(FOLDS + 1 if word_score else 0):
        others = ~aside & (fold != k)
        part = others[pair_doc]
        leans[k] = leaning(row_of[pair_word[part]], labels[pair_doc[part]], len(net.known) + 1, labels[others])
    net.lean = leans[FOLDS]
    if words:
        own, row, n_grams = [], [], []
        for k in range(0, len(words), WORDS_AT_ONCE):
            some, word, grams, _ = net.inputs(words[k : k + WORDS_AT_ONCE])
            own.append(some)
            row.append(grams[np.argsort(word, kind="stable")].astype(np.int32))
            n_grams.append(np.bincount(word, minlength=len(some)))
        own, row, first = np.concatenate(own), np.concatenate(row), np.concatenate([[0], np.cumsum(np.concatenate(n_grams))])

    def inputs_of(numbers: np.ndarray, hidden: float = 0.0):
        """Inputs of words, whose numbers hold the fold of their document."""
        if not words:
            return net.inputs([b""])
        numbers, of_fold = numbers // (FOLDS + 1), numbers % (FOLDS + 1)
        n = first[numbers + 1] - first[numbers]
        take = np.repeat(first[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen = own[numbers] * (rng.random(len(numbers)) >= hidden) if hidden else own[numbers]
        return seen, np.repeat(np.arange(len(numbers)), n), row[take], leans[of_fold, own[numbers]]

    held = pair_word = pair_doc = None
    places = np.where(places >= 0, places * np.int32(FOLDS + 1) + fold[of][:, None].astype(np.int32), np.int32(-1))
    y = labels[of].astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    positive = np.flatnonzero((y == 1) & ~aside[of])
    negative = np.flatnonzero((y == 0) & ~aside[of])
    live = positive
    for step in range(steps):
        if step >= steps // 4 and (step - steps // 4) % max(1, steps // 8) == 0:
            z = logits(net, places[positive], inputs_of)
            best = np.full(len(labels), -np.inf)
            np.maximum.at(best, of[positive], z)
            live = positive[z >= np.minimum(best[of[positive]], 2.0)]
        pick = np.concatenate([rng.choice(live, batch // 2), rng.choice(negative, batch // 2)])
        p = places[pick]
        p[rng.random(p.shape) < dropped] = -1  # words left out at random, against learning by heart
        p = np.take_along_axis(p, np.argsort(p < 0, 1, kind="stable"), 1)
        used = np.unique(p[p >= 0])
        if not len(used):
            continue
        local = np.where(p >= 0, np.searchsorted(used, np.maximum(p, 0)), -1)
        _, g = net.gradients(inputs_of(used, unknown), local, y[pick], np.ones(len(pick), np.float32))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1.0, (step + 1) / 20) * (0.1 + 0.9 * (1 - step / steps))
        for k, v in net.w.items():
            gk = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            m, s = moment[k]
            m += 0.1 * (gk - m)
            s += 0.01 * (gk * gk - s)
            v -= lr * ((m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-8) + (decay * v if k in ("word", "gram") else 0.0))
    z = np.full(len(labels), -np.inf)
    apart = np.flatnonzero(aside[of])
    if 0 < labels[aside].sum() < aside.sum():
        np.maximum.at(z, of[apart], logits(net, places[apart], inputs_of))
        net.slope, net.shift = straightened(z[aside], labels[aside])
    return net


def leaning(words: np.ndarray, toxic: np.ndarray, size: int, labels: np.ndarray) -> np.ndarray:
    """How far the toxic documents that have a word exceed their share, in
    standard deviations, on a logarithmic scale. Row 0 has no word."""
    n = np.bincount(words, minlength=size).astype(float)
    a = np.bincount(words, weights=toxic, minlength=size)
    share = labels.mean() if len(labels) else 0.0
    z = (a - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9) + 0.25)
    out = np.clip(np.sign(z) * np.log1p(np.abs(z)), -4, 4)
    out[0] = 0
    return out.astype(np.float32)


def straightened(z: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels on logits, by Newton steps, with a little shrinking."""
    x = np.stack([np.clip(z, -15, 15), np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.05])
        step = np.linalg.solve(h, x.T @ (p - y) + np.array([0.5, 0.05]) * (w - [1.0, 0.0]))
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.05)), float(w[1])


def logits(net: Network, places: np.ndarray, inputs_of) -> np.ndarray:
    out = []
    for k in range(0, len(places), 1024):
        p = places[k : k + 1024]
        used = np.unique(p[p >= 0])
        if not len(used):
            used = np.zeros(1, np.int64)
        out.append(net.forward(net.project(inputs_of(used))[0], np.where(p >= 0, np.searchsorted(used, np.maximum(p, 0)), -1)))
    return np.concatenate(out)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 2500, **options) -> Network | Constant:
    labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    kinds = [labels.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    few = F.broadcast(stored(kinds[0].unionByName(kinds[1])))
    sample = id_text(docs).join(few, "doc_id").orderBy("doc_id", "text").limit(2 * most)

    def learn(batches):
        aside = lambda doc: crc32(str(doc).encode()[::-1]) % 5 == 4
        parts = (b.slice(k, 100) for b in batches for k in range(0, b.num_rows, 100))
        rows = (r for part in parts for r in part.to_pylist())
        net = train(((r["label"], aside(r["doc_id"]), words_of(r["text"])) for r in rows), **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    # limit() leaves one partition, so one task learns and the driver gets the weights only.
    made = sample.mapInArrow(learn, "net binary").first()
    return pickle.loads(made.net) if made else Constant(0.5)


SCORES = "struct<score:double,n_windows:long,worst_word:long>"


def score_rows(docs: DataFrame, net: Network | Constant, *, keep: int = 200_000, text_col: str = "text") -> DataFrame:
    """row (all columns of docs in one struct), score, n_windows and the worst
    window's first word, of each row. Only texts go to Python, once, and three
    numbers a row come back; `keep` bounds a task's table of words."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    if isinstance(net, Constant):
        return rows.select("row", F.lit(net.share).alias("score"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("worst_word"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf(SCORES)
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net: Network = shared.value
        number: dict[bytes, int] = {}
        table, made = np.zeros((0, 6 * net.hidden), np.float32), 0
        for texts in batches:
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.combine_chunks()
            at, found = 0, []
            while at < len(texts):
                split, n = [], 0
                while at + len(split) < len(texts) and n < 60_000:
                    split.append(words_of(texts[at + len(split)].as_py()))
                    n += len(split[-1])
                if len(number) > keep:
                    number, table, made = {}, table[:0], 0
                new = list({w for x in split for w in x if w not in number})
                if new:
                    number.update(zip(new, range(made, made + len(new))))
                    if made + len(new) > len(table):
                        table = np.concatenate([table, np.zeros((max(len(new), len(table) // 2), table.shape[1]), np.float32)])
                    table[made : made + len(new)] = net.project(net.inputs(new))[0]
                    made += len(new)
                first, doc, places = [], [], []
                for k, x in enumerate(split):
                    idx = np.full(len(x) + WINDOW, -1, np.int32)
                    idx[: len(x)] = np.fromiter(map(number.__getitem__, x), np.int32, len(x))
                    w = windows_of(len(x))
                    places.append(idx[w[:, None] + np.arange(WINDOW)])
                    first.append(w)
                    doc.append(np.full(len(w), k))
                doc, first, places = np.concatenate(doc), np.concatenate(first), np.concatenate(places)
                full = table if len(table) else np.zeros((1, table.shape[1]), np.float32)
                z = np.concatenate([net.forward(full, places[k : k + 1024]) for k in range(0, len(places), 1024)])
                order = np.lexsort((first, -z, doc))
                top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
                found.append((sigmoid(net.slope * z[top].astype(float) + net.shift), np.bincount(doc, minlength=len(split)), first[top]))
                at += len(split)
            columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0), *[np.zeros(0, np.int64)] * 2]
            yield pa.StructArray.from_arrays([pa.array(x) for x in columns], ["score", "n_windows", "worst_word"])

    return rows.select("row", scores("text").alias("s")).select("row", "s.score", "s.n_windows", "s.worst_word")


def score_toxicity(docs: DataFrame, net: Network | Constant, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, score, n_windows, worst_word of each row."""
    return score_rows(id_text(docs, id_col, text_col), net, **options).select(F.col("row.doc_id").alias("doc_id"), "score", "n_windows", "worst_word")


def op4_gru_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_bucket("doc_id", 5) == 0
    net = fit_toxicity(docs, labels.where(~held_out))
    return score_toxicity(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
