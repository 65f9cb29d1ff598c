"""Vector codes, shards and ranked search against brute force, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lexical_search, sharding, vector_codes

from .cases import awkward, empty, long_text

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error of rows (vec_id, vector, label), and the codebooks."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(cut(x, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(x, p)[1] for p in range(parts)] for _, x, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(x, p) for (_, x, _), f in zip(kept, found) if f[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], Counter()
    for i, x, label in kept:
        n = [near(x, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((repr((i, code, error, by_label[label], digest)) for i, code, error, label in out))


def some_vectors(n=300, width=32, seed=3):
    r = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in r.normal(0, 0.2, width)], int(r.integers(0, 4)) if i % 5 else None) for i in r.permutation(n)]


def test_codes_equal_brute_force_with_awkward_rows(spark):
    rows = some_vectors()
    rows += [(1000, None, 1), (1001, [None] + [0.5] * 31, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 1), (None, [0.25] * 32, None), (7, [0.0] * 32, 2), (7, [0.0] * 32, 2), (1004, [5.0] * 32, 9)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).withColumn("id", F.lit(2))
    got = vector_codes.coded_with_errors(df).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == brute_codes(rows)


def test_codes_of_few_odd_and_no_rows(spark):
    few = some_vectors(5, 16)
    odd = few + [(90, [1.0] * 7, 1), (91, [], 1), (92, [1.0] * 32, 1)]
    got = vector_codes.coded_with_errors(spark.createDataFrame(odd, VECTORS)).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == brute_codes(few)
    assert {r.error for r in got} == {0}  # each is an entry of its own
    none = vector_codes.coded_with_errors(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.coded_with_errors(spark.createDataFrame([], VECTORS)).collect() == []
    huge = vector_codes.coded_with_errors(spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1)], VECTORS)).collect()
    assert [r.error for r in huge] == [0, 0]


def test_equal_vectors_and_one_label(spark):
    rows = [(k, [0.5] * 16, 1) for k in range(200)] + [(k, [0.5] * 15 + [k / 100], 1) for k in range(200, 260)]
    got = vector_codes.coded_with_errors(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == brute_codes(rows)


@pytest.mark.parametrize("entries", [1, 2, 64])
def test_slice_index_is_exact(entries):
    r = np.random.default_rng(entries)
    books = r.integers(-50, 50, (entries, 4))
    parts = np.concatenate([r.integers(-60, 60, (2000, 4)), books, r.integers(-(10**6), 10**6, (50, 4))])
    index, far = vector_codes.SliceIndex(books).nearest(parts)
    d = ((parts[:, None, :] - books[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (far == d.min(1)).all()
    box = vector_codes.SliceIndex(books).box(parts, np.full(len(parts), 9))
    inside = (np.abs(parts[:, None, :] - books[None]) <= 9).all(2)
    assert (((box[:, None] >> np.arange(entries, dtype=np.uint64)) & np.uint64(1)).astype(bool) == inside).all()


def test_codes_decode_to_their_entries(spark):
    df = spark.createDataFrame(some_vectors(100, 16), VECTORS)
    books = vector_codes.fitted(df)
    codes = {r.id: r.code for r in vector_codes.encoded(df, books).collect()}
    for r in vector_codes.decoded(vector_codes.encoded(df, books), books).collect():
        assert r.x == [int(c) for p, k in enumerate(codes[r.id]) for c in books[p][k]]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097])
def test_walk_is_a_permutation_with_an_inverse(n):
    rows = np.arange(n)
    placed = sharding.walked(rows, n, 7)
    assert sorted(placed) == list(rows)
    shard, slot = sharding.place(rows, n, 3, 7)
    assert (sharding.row_at(shard, slot, n, 3, 7) == rows).all()
    if n > 100:
        assert np.abs(np.corrcoef(rows, placed)[0, 1]) < 0.2
        assert (sharding.walked(rows, n, 8) != placed).any()


def checked_shards(rows, texts, shards):
    """Row numbers follow the order, places follow the numbers, counts differ by one, slots have no gap."""
    n = len(rows)
    want = sorted(((d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts))
    got = sorted(rows, key=lambda r: r.row_no)
    assert [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got] == want
    assert [r.row_no for r in got] == list(range(n))
    x = [int(v) for v in sharding.walked(np.arange(n), n, 0)]
    assert [(r.shard, r.slot) for r in got] == [(v % shards, v // shards) for v in x]
    counts = Counter(r.shard for r in rows)
    sizes = [counts[k] for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))


def test_shards_of_awkward_rows(spark):
    docs = awkward(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    checked_shards(sharding.sharded(docs.repartition(3), 5).collect(), texts, 5)
    checked_shards(sharding.sharded(docs, 40).collect(), texts, 40)
    assert sharding.sharded(empty(spark), 4).collect() == []


def test_shards_do_not_depend_on_partitions_and_spread_a_hot_id(spark):
    rows = [(1, "same")] * 700 + [(k, f"text {k}") for k in range(900)] + [(None, None)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sharding.sharded(docs.repartition(7), 13).collect()
    checked_shards(one, rows, 13)
    assert sorted(map(repr, one)) == sorted(map(repr, sharding.sharded(docs.coalesce(1), 13).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    table, offsets, n = sharding.numbered(docs.repartition(4).withColumn("i", F.monotonically_increasing_id()), "doc_id", "i")
    assert n == len(rows) and max(r["count"] for r in table.groupBy("part").count().collect()) < n / 2 and len(offsets) == 4
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(docs, items, most=10):
    counts = [(d, Counter(brute_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(m for _, _, m in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        own = set(brute_terms(text))
        scores = []
        for d, c, length in counts:
            m = 10 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for rank, (s, null, d) in enumerate(sorted(scores)[:most], 1):
            out.append((item, rank, None if null else d, -s))
    return sorted(map(repr, out))


def ranking(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 16)
    base = long_text(200, 5).split()
    docs = [(k, " ".join(base[(k * 7) % 150 : (k * 7) % 150 + 5 + k % 40]) + f" rare{k % 9}") for k in range(120)]
    docs += [(500 + k, "copy of the SAME text, rare3") for k in range(40)] + [(900, "x " * 3000 + "rare1 rare2"), (901, "Ünï-CODE ünï")]
    items = [(1, "rare1 rare2 the"), (2, " ".join(base[:60])), (3, "same text copy"), (4, "nowhere"), (5, "Ünï"), (6, "x"), (7, " ".join(base[100:130]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert ranking(lexical_search.ranked(df, spark.createDataFrame(items, "item_id long, text string"))) == brute_ranking(docs, items)


def test_search_drops_what_cannot_win_and_nothing_else(spark, monkeypatch):
    """Bounds close accumulators after the first owners; the result stays that without bounds."""
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 8)
    docs = [(k, "common filler words here " + " ".join(f"special{j}" for j in range(k % 15))) for k in range(200)]
    items = [(1, "special13 special12 special1 common filler"), (2, "common words")]
    df, its = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_ranking(docs, items)
    assert ranking(lexical_search.ranked(df, its)) == want
    calls = []
    real = lexical_search.bounds
    monkeypatch.setattr(lexical_search, "bounds", lambda t, m: calls.append(real(t, m)) or {})
    assert ranking(lexical_search.ranked(df, its)) == want
    assert any(calls)


def test_search_of_awkward_rows_and_sets_of_items(spark, monkeypatch):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "one two"), (1, "one two"), (1, "quick here"), (None, "x one"), (2, None), (3, ""), (4, " \n"), (5, long_text(300))]
    its = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 as doc_id", "2 as score", "3 as rank", "4 as key")
    want = brute_ranking(rows, items)
    assert ranking(lexical_search.ranked(docs, its)) == want
    monkeypatch.setattr(lexical_search, "ASK_BYTES", 40)
    assert ranking(lexical_search.ranked(docs, its)) == want


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked(empty(spark), items).collect() == []
    assert lexical_search.ranked(awkward(spark), items.limit(0)).collect() == []
    wordless = spark.createDataFrame([(1, None), (2, " -- ")], "doc_id long, text string")
    assert lexical_search.ranked(wordless, items).collect() == []
    assert lexical_search.ranked(awkward(spark), spark.createDataFrame([(1, None)], "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]
