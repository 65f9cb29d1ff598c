"""Quality by a sparse ensemble of rules.

Boosted trees over statistics of the texts are cut into their paths: each path
is a conjunction of comparisons. A logistic model with an L1 penalty weighs the
rules and drops most of them; what is left is compiled into one Spark column
expression over the statistics, so scoring is an ordinary projection.

Statistics come from whole texts. The model is fitted on at most `sample`
labelled rows, those with the smallest hashes of their ids: that bound is what
the driver holds. Null and empty texts have statistics of 0 and get a score.
Labels that are null are left out; the larger of repeated labels counts. Without
labels of both kinds the score is the share of label 1, or 0.5.

Rows with a null id are scored, but no label finds them. Repeated rows are scored
each; an id with several texts is fitted with each, up to `sample` rows in all. Of ids
with equal hashes the smaller is taken into the sample first, a score of just 0.5
counts as label 1. An empty table gives an empty result. Texts are measured whole,
whatever their length. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, documents, id_text, stored, text_slices
from .hashing import words_of

STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "mark", "bang", "bar", "wide", "line_words", "distinct_words", "top_word", "repeated_lines")

_KIND = {
    "upper": np.isin(np.arange(256), list(range(65, 91))),
    "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)]),
    "digit": np.isin(np.arange(256), list(range(48, 58))),
    "symbol": np.isin(np.arange(256), list(b"#$%&*<>{}[]\\/@^~_=+`")),
    "mark": np.isin(np.arange(256), list(b".,;:?'\"()-")),
    "bang": np.isin(np.arange(256), list(b"!")),
    "bar": np.isin(np.arange(256), list(b"|")),
    "wide": np.isin(np.arange(256), list(range(128, 256))),
    "line": np.isin(np.arange(256), list(b"\n")),
}


def per_run(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(flag)])
    return (s[offsets[1:]] - s[offsets[:-1]]).astype(float)


def statistics_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per document."""
    n_docs = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    count = {k: per_run(v[raw], offsets) for k, v in _KIND.items()}
    doc, start, end, h = words_of(raw, offsets)
    words = np.bincount(doc, minlength=n_docs).astype(float)
    word_bytes = np.bincount(doc, weights=end - start, minlength=n_docs)
    order = np.lexsort((h, doc))
    d, w = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    distinct = np.bincount(d[new], minlength=n_docs)
    runs = np.diff(np.append(np.flatnonzero(new), len(d)))
    top = np.zeros(n_docs)
    np.maximum.at(top, d[new], runs)
    repeated = np.zeros(n_docs)
    for k in np.flatnonzero(count["line"] > 0):
        lines = [x for x in raw[offsets[k] : offsets[k + 1]].tobytes().split(b"\n") if x.strip()]
        repeated[k] = 1 - len(set(lines)) / max(1, len(lines))
    bytes_, letters, w1 = np.maximum(size, 1), np.maximum(count["letter"], 1), np.maximum(words, 1)
    columns = [np.log1p(size), np.log1p(words), word_bytes / w1, count["upper"] / letters, count["digit"] / bytes_, count["symbol"] / bytes_, count["mark"] / bytes_, count["bang"] / bytes_, count["bar"] / bytes_, count["wide"] / bytes_, words / (count["line"] + 1), distinct / w1, top / w1, repeated]
    return np.stack(columns, 1)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each row."""

    def measure(batches):
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                x = statistics_of(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["doc_id", *STATISTICS])

    return id_text(docs, id_col, text_col).mapInArrow(measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Comparisons that must all hold: statistic, whether it must be at most the
    bound (else above it), bound."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, bound in self.parts:
            out &= (x[:, k] <= bound) if below else (x[:, k] > bound)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, below, bound in self.parts:
            c = F.col(STATISTICS[k])
            out = out & ((c <= bound) if below else (c > bound))
        return out


def tree_rules(x: np.ndarray, residual: np.ndarray, depth: int, bins: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree over binned statistics: the paths to its nodes but the
    root, and its fitted values."""
    rules: list[Rule] = []
    fitted = np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple, level: int) -> None:
        if path:
            rules.append(Rule(path))
        fitted[rows] = residual[rows].mean()
        if level == depth or len(rows) < 2 * least:
            return
        best = (1e-9, None, None)
        r = residual[rows]
        for k in range(x.shape[1]):
            bounds = np.unique(np.quantile(x[rows, k], np.arange(1, bins) / bins))
            slot = np.searchsorted(bounds, x[rows, k], "left")
            n = np.cumsum(np.bincount(slot, minlength=len(bounds) + 1))[:-1]
            s = np.cumsum(np.bincount(slot, weights=r, minlength=len(bounds) + 1))[:-1]
            ok = (n >= least) & (len(r) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(r) - n, 1) - r.sum() ** 2 / len(r), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, float(bounds[gain.argmax()]))
        if best[1] is not None:
            _, k, bound = best
            low = x[rows, k] <= bound
            grow(rows[low], (*path, (k, True, bound)), level + 1)
            grow(rows[~low], (*path, (k, False, bound)), level + 1)

    grow(np.arange(len(x)), (), 0)
    return rules, fitted


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and L1-penalised weights by accelerated proximal gradient."""
    n, m = z.shape
    scale = np.maximum(z.std(0), 1e-6)
    middle = z.mean(0)
    a = (z - middle) / scale
    step = 4.0 / max(1e-9, np.linalg.norm(a, 2) ** 2 / n + 1)
    w, w0, v, v0, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(a @ v + v0))) - y
        u = v - step * (a.T @ g) / n
        new = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        new0 = v0 - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v0 = new + (t - 1) / t2 * (new - w), new0 + (t - 1) / t2 * (new0 - w0)
        w, w0, t = new, new0, t2
    w = w / scale
    return float(w0 - middle @ w), w


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, Rule]]

    def score(self) -> Column:
        """The probability of label 1, over the statistics' columns."""
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 24, least: int = 10, penalty: float = 0.004, seed: int = 5) -> RuleModel:
    if not len(y):
        return RuleModel(0.0, [])
    share = y.mean()
    if share in (0.0, 1.0):
        return RuleModel(float(np.log((share + 1e-3) / (1 - share + 1e-3))), [])
    rng, rules = np.random.default_rng(seed), {}
    f = np.full(len(y), np.log(share / (1 - share)))
    least = max(2, min(least, len(y) // 20))
    for _ in range(trees):
        rows = rng.choice(len(y), max(20, len(y) // 2), replace=True)
        p = 1 / (1 + np.exp(-f))
        found, _ = tree_rules(x[rows], (y - p)[rows] / np.maximum((p * (1 - p))[rows].mean(), 1e-3), depth, bins, least)
        rules |= dict.fromkeys(found)
        leaves = [r for r in found if not any(set(r.parts) < set(o.parts) for o in found)]
        for r in leaves:
            at = r.holds(x)
            if at.any():
                f[at] += rate * np.clip((y - p)[at].sum() / ((p * (1 - p))[at].sum() + 1.0), -4, 4)
    z = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    if not z.shape[1]:
        return RuleModel(float(np.log(share / (1 - share))), [])
    w0, w = lasso_logistic(z, y.astype(float), penalty)
    return RuleModel(w0, [(float(w[k]), r) for k, r in enumerate(rules) if abs(w[k]) > 1e-4])


def labelled_ids(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most `sample` labelled ids with their label: those with the smallest
    hashes. A table of that bound, so it can be broadcast."""
    few = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000) -> RuleModel:
    few = F.broadcast(stored(labelled_ids(labels, label, sample)))
    rows = with_statistics(id_text(docs).join(few, "doc_id", "left_semi"))
    got = rows.join(few, "doc_id").orderBy("doc_id", *STATISTICS).limit(sample).toPandas()
    return fit_rules(got[list(STATISTICS)].to_numpy(), got["label"].to_numpy())


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    return with_statistics(docs).select("doc_id", model.score().alias("score"))


def op9_rule_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_bucket("doc_id", 3) == 1
    model = fit_quality(docs, labels.where(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
