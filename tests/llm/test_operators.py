"""The other operators against brute force, and on awkward rows."""

import hashlib
import itertools
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import decontamination, fingerprints, lattice, ngram_join, preferences, rules, suffix_dedup, toxicity

from .cases import awkward, empty, long_text


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies():
    """A chain, a family around one text, border cases and passages that many share."""
    base = long_text(120, 3).split()
    rows, shared = [], long_text(60, 5)
    for k in range(12):  # neighbours are near copies, ends aren't
        rows.append((100 + k, " ".join([f"c{i}x{max(0, k - i // 10)}" for i in range(120)])))
    for k in range(30):
        w = list(base)
        w[(7 * k) % 120] = f"edit{k}"
        rows.append((200 + k, " ".join(w)))
    for k in range(30):
        rows.append((300 + k, f"{shared} {long_text(40, 1000 + k)}"))
    rows += [(400, "a b c d"), (401, "A B C D"), (402, "a b c d e"), (403, ""), (404, None), (405, " \t\n"), (406, "a b c d e f"), (407, "x y")]
    return rows


def test_jaccard_components_match_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_awkward_rows(spark):
    got = ngram_join.jaccard_components(awkward(spark)).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 6 and by[5].component_id == 4 and by[1].n_shingles == 0 and by[2].component_id == 2
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def brute_removal(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        dead = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                dead[i : i + length] = True
        out.append((len(r), int(dead.sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~dead].tobytes()).hexdigest()))
    return out


def repeat_rows():
    a, b = long_text(400, 11), long_text(400, 12)
    rows = [long_text(150, 20 + k) for k in range(6)]
    rows += [rows[0], f"{rows[1]} tail", a[:700], "z" + a[300:900], a[500:1200] + b[:199], "q" + b[:200], b[1:230], "=" * 900, "ab" * 300, "abc" * 70, "x" * 100 + "abc" * 67 + "y", "é" * 150 + a[:350], None, "", "x" * 199]
    return rows


@pytest.mark.parametrize("options", [{}, {"bucket_size": 3}, {"most_segments": 0}])
def test_repeats_match_brute_force(spark, options):
    texts = repeat_rows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(docs, **options).collect()}
    assert [got[k] for k in range(len(texts))] == brute_removal(texts)


def test_repeats_in_parts_of_a_long_text(spark, monkeypatch):
    texts = [long_text(800, 31), long_text(800, 31)[2000:3500], long_text(100, 32)]
    raws = [t.encode() for t in texts]
    for raw in raws:
        whole = suffix_dedup.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        windows = {(int(a), j) for a, j0, j1 in zip(*whole[:3]) for j in range(j0, j1 + 1)}
        parts, at, size = set(), 0, 1000
        for at in range(0, max(1, len(raw) - 199), size - 199):
            part = np.frombuffer(raw[at : at + size], np.uint8)
            found = suffix_dedup.anchors(part, np.array([0, len(part)]))
            parts |= {(int(a) + at, j + at) for a, j0, j1 in zip(*found[:3]) for j in range(j0, j1 + 1)}
        assert parts == windows


def test_column_order_finds_repeated_starts():
    r = np.random.default_rng(4)
    core = r.integers(0, 4, 320, dtype=np.uint8).tobytes()
    segments = [core, b"\7" + core[:250], core[60:], r.integers(0, 4, 400, dtype=np.uint8).tobytes(), core[:210] + b"\5\5"]
    seen = Counter(s[i : i + 200] for s in segments for i in range(len(s) - 199))
    for s, hit in zip(segments, suffix_dedup.repeated_starts(segments)):
        assert hit.tolist() == [seen[s[i : i + 200]] > 1 for i in range(len(s) - 199)]


def test_a_long_run_is_few_segments(spark):
    docs = spark.createDataFrame([("=" * 100_000,), ("abcdefg" * 9000,)], "text string")
    seen = suffix_dedup.Membership(np.full(1 << 22, 255, np.uint8))
    context = spark.sparkContext
    rows = suffix_dedup.segment_rows(docs, context.broadcast(seen), context.broadcast(seen)).collect()
    assert len(rows) < 40 and max(r.reach for r in rows) == 100_000
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).orderBy("n_bytes").collect()] == [(63_000, 1), (100_000, 1)]


def test_symbols_are_told_apart_by_their_bytes(monkeypatch):
    rows = np.random.default_rng(1).integers(0, 2, (200, 3), dtype=np.uint8)
    want = len(np.unique(rows, axis=0))
    assert len(set(suffix_dedup.symbol_numbers(rows))) == want
    monkeypatch.setattr(suffix_dedup, "mixed", lambda x: x * np.uint64(0))
    assert len(set(suffix_dedup.symbol_numbers(rows))) == want


def test_bytes_without_spans():
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abé漢 "), r.integers(0, 60))).encode() for _ in range(400)]
    spans = [[{"a": a, "b": a + 1 + int(r.integers(0, len(t) - a))} for a in r.integers(0, len(t), r.integers(0, 5)).tolist()] if t and k % 5 else None for k, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for part, characters in itertools.product((slice(0, 400), slice(7, 300), slice(5, 5)), (False, True)):
        got = suffix_dedup.without_spans(pa.array(texts, pa.binary())[part], pa.array(spans, kind)[part], characters).to_pylist()
        for row, raw, found in zip(got, texts[part], spans[part], strict=True):
            dead = np.zeros(len(raw), bool)
            for x in found or []:
                dead[x["a"] : x["b"]] = True
            kept = bytes(b for b, gone in zip(raw, dead) if not gone)
            runs = int((np.diff(np.concatenate([[0], dead])) > 0).sum())
            assert row == {"n_bytes": len(raw), "n_removed": int(dead.sum()), "n_spans": runs, "kept": kept.decode("utf-8", "ignore").encode() if characters and runs else kept}


def test_a_long_text_takes_little_memory():
    raw = np.random.default_rng(5).integers(97, 123, 6_000_000, dtype=np.uint8)
    column = pa.array([raw.tobytes()], pa.binary())
    tracemalloc.start()
    windows = 0
    for _, _, part, offsets in suffix_dedup.passes(column):
        _, j0, j1, _, _ = suffix_dedup.anchors(part, offsets)
        windows += int((j1 - j0 + 1).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == len(raw) - 199 and peak < 250_000_000, peak


def test_training_takes_little_memory_and_words_in_parts_give_the_same(monkeypatch):
    r = np.random.default_rng(8)
    docs = [(k % 2, k % 5 == 4, [b"%x" % x for x in r.integers(2**31, 2**47, 300).tolist()] + [b"common", b"bad" if k % 2 else b"good"]) for k in range(400)]
    tracemalloc.start()
    net = toxicity.train(docs, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 1 << 30, raising=False)
    whole = toxicity.train(docs, steps=2)
    assert all((net.w[k] == whole.w[k]).all() for k in net.w) and (net.lean == whole.lean).all()
    assert peak < 120_000_000, peak


def test_repeats_awkward_rows(spark):
    got = suffix_dedup.remove_repeats(awkward(spark)).collect()
    assert len(got) == 12 and all(r.row["grp"] == "x" for r in got)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def brute_containment(docs, items):
    out = set()
    for d, t in docs:
        s = shingle_set(t)
        for i, x in items:
            n = shingle_set(x)
            if n and 5 * len(n & s) >= 4 * len(n):
                out.add((d, i, len(n), len(n & s)))
    return out


@pytest.mark.parametrize("inline", [4096, 0])
def test_containment_matches_brute_force(spark, inline):
    items = [(k, long_text(n, 50 + k)) for k, n in enumerate((3, 5, 9, 20, 40, 41, 80))] + [(90, None), (91, "")]
    docs = [(k, long_text(100 + k, 80 + k)) for k in range(10)]
    for k, x in items[:7]:
        w = x.split()
        docs.append((20 + k, f"{long_text(50, k)} {x} {long_text(30, k + 5)}"))
        docs.append((40 + k, f"{long_text(50, k)} {' '.join(w[: len(w) // 2])} changed {' '.join(w[len(w) // 2 + 1 :])}"))
    docs += [(60, None), (61, " "), (62, items[0][1].upper())]
    got = decontamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), inline_hashes=inline)
    assert {tuple(r)[:4] for r in got.collect()} == brute_containment(docs, items)


def test_containment_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one two", 5), (None, long_text(60, 7), 6), (3, None, 7)], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(awkward(spark), items).collect()}
    assert got == {(4, 1), (5, 1), (9, None)}
    assert decontamination.contained_items(empty(spark), items).count() == 0
    assert decontamination.contained_items(awkward(spark), empty(spark).selectExpr("doc_id as item_id", "text")).count() == 0


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_preferences_match_brute_force(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no é")
    cases = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [u, a, u, b], [u, a]), (4, [], [u]), (5, None, None), (6, [(None, None)], [("", "")]), (7, [u, a, a], [b, a, u])]
    got = preferences.format_preferences(spark.createDataFrame(cases, f"pair_id long, chosen {preferences.TURNS}, rejected {preferences.TURNS}")).collect()
    for r in got:
        _, x, y = cases[r.pair_id - 1]
        x, y = [[(p or "", q or "") for p, q in (z or [])] for z in (x, y)]
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (k, render(x[:k]), render(x[k:]), render(y[k:]))
        for side, mask, turns in ((r.chosen, r.chosen_mask, x[k:]), (r.rejected, r.rejected_mask, y[k:])):
            assert [side[m.start : m.end] for m in mask] == [f"{t}<|end|>" for role, t in turns if role == "assistant"]


def test_partner_pairs_take_repeated_and_null_turns(spark):
    rows = [(0, 0, "user", "q"), (0, 0, "user", "q"), (0, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "user", "q"), (4, None, "user", "alone")]
    pairs = {r.pair_id: r for r in preferences.partner_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(pairs) == {0, 1, 4}
    assert [tuple(t) for t in pairs[0].rejected] == [("user", "q"), ("", "x")] and pairs[4].rejected == []


def all_segmentations(word, weight):
    total = {0: 1.0}
    for end in range(1, len(word) + 1):
        total[end] = sum(total[s] * weight.get(word[s:end], 0.0) for s in range(end))
    return total[len(word)]


def test_lattice_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab", b"bc", b"abc"]
    p = np.random.default_rng(2).random(len(pieces))
    p /= p.sum()
    found, counts = lattice.Lattice(pieces).forward([b"abc", b"a", b"bcbcab", b"\xff\x00z"], np.log(p), np.ones(4))
    weight = dict(zip(pieces, p))
    for w, x in zip([b" abc", b" a", b" bcbcab", b" \xff\x00z"], found):
        assert np.isclose(np.exp(x), all_segmentations(w, weight))
    assert counts.sum() > 4


@pytest.mark.parametrize("head", [3, 100_000])
def test_lattice_base_score_matches_brute_force(spark, head):
    docs = awkward(spark)
    train = docs.where("doc_id is null or doc_id % 2 = 0")
    counts = Counter(w for r in train.collect() for w in words(r.text))
    ends = train.count()
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = lattice.lattice_scores(docs, train, lattice.default_model(), head=head, rounds=1).collect()
    assert len(got) == 12
    want = Counter()
    for r in docs.collect():
        w = words(r.text)
        base = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        want[r.doc_id, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lattice.lattice_scores(empty(spark), empty(spark), lattice.default_model(), rounds=1).count() == 0


def test_lattice_score_is_the_same_for_any_head(spark):
    rows = [(k, " ".join(f"word{j}" for j in range(1, 40) for _ in range(1 + 20 // j) if (j + k) % 3)) for k in range(12)] + [(12, "word1 word39 neverseen neverseen once"), (13, ""), (None, "word2 once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.where("doc_id % 2 = 0 or doc_id is null")
    few, many = ({r.doc_id: r for r in lattice.lattice_scores(docs, train, lattice.default_model(), head=head, rounds=1).collect()} for head in (3, 100_000))
    assert few.keys() == many.keys() and len(few) == 15
    for k in few:
        assert np.isclose(few[k].score, many[k].score, rtol=1e-9) and np.isclose(few[k].base_score, many[k].base_score, rtol=1e-9)


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    net = toxicity.Network({b"aa": 1, b"bb": 2})
    net.lean = r.random(3).astype(np.float32)
    inputs = net.inputs([b"aa", b"bb", b"cc"])
    places = np.array([[0, 1, 2, 1, -1], [2, 2, -1, -1, -1], [-1] * 5])
    y, weight = np.array([1.0, 0.0, 1.0], np.float32), np.array([1.0, 2.0, 0.5], np.float32)
    _, g = net.gradients(inputs, places, y, weight)
    for key in ("fore", "back", "in", "att", "attv", "out", "word"):
        at = np.unravel_index(np.abs(g[key]).argmax(), g[key].shape)
        old, step = net.w[key][at], 1e-2
        net.w[key][at] = old + step
        up = net.gradients(inputs, places, y, weight)[0]
        net.w[key][at] = old - step
        down = net.gradients(inputs, places, y, weight)[0]
        net.w[key][at] = old
        assert np.isclose((up - down) / (2 * step), g[key][at], rtol=0.05, atol=1e-4), key


def test_windows_overlap_and_cover():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        at = toxicity.windows_of(n)
        assert at[0] == 0 and at[-1] + toxicity.WINDOW >= n and (np.diff(at) < toxicity.WINDOW).all()


def plain_logit(net, words):
    """One window, place by place."""
    w, h, s = net.w, net.hidden, toxicity.sigmoid
    x = net.project(net.inputs(words))[0].astype(float)
    states = [np.zeros(2 * h) for _ in words]
    for u, part, order in ((w["fore"], 0, range(len(words))), (w["back"], 1, range(len(words) - 1, -1, -1))):
        state = np.zeros(h)
        for t in order:
            g, a = x[t, 3 * h * part : 3 * h * (part + 1)], state @ u
            z, r = s(g[:h] + a[:h]), s(g[h : 2 * h] + a[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * a[2 * h :])
            states[t][h * part : h * (part + 1)] = state
    score = np.array([np.tanh(v @ w["att"] + w["att0"]) @ w["attv"] for v in states])
    weight = np.exp(score) / np.exp(score).sum()
    return float(sum(k * v for k, v in zip(weight, states)) @ w["out"] + w["out0"][0])


def test_network_matches_a_plain_loop(spark):
    net = toxicity.Network({b"seven": 1, b"lazy": 2})
    net.lean, net.slope, net.shift = np.array([0, 1.5, -1], np.float32), 0.8, -0.1
    texts = [long_text(n, n) for n in (1, 5, 64, 65, 200)] + [None, "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(docs, net).collect():
        w = words(texts[r.doc_id])
        z = [plain_logit(net, w[a : a + toxicity.WINDOW]) if w else net.w["out0"][0] for a in toxicity.windows_of(len(w))]
        assert r.n_windows == len(z) and np.isclose(r.score, toxicity.sigmoid(0.8 * max(z) - 0.1), atol=1e-5)
        assert r.worst_word == toxicity.STRIDE * int(np.argmax(z))


@pytest.mark.parametrize("word_score,least", [(True, 0.9), (False, 0.9)])
def test_toxicity_held_out(spark, word_score, least):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    aside = "crc32(cast(doc_id as string)) % 5 = 0"
    net = toxicity.fit_toxicity(docs, labels.where(f"not ({aside})"), word_score=word_score)
    held = [(r.score, r.toxic) for r in toxicity.score_toxicity(docs.where(aside), net).join(labels, "doc_id").collect()]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > least
    assert np.mean(np.array(good) >= 0.5) < 0.03


def test_toxicity_awkward_rows(spark):
    rows = [(k, f"{long_text(30, k)} {'grimwit ' * (k % 2)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    net = toxicity.fit_toxicity(docs, labels, steps=40)
    got = toxicity.score_rows(awkward(spark), net).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got) and all(r.row["grp"] == "x" for r in got)
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(awkward(spark), none).collect()} == {0.5}
    assert toxicity.score_toxicity(empty(spark), net).count() == 0


def test_rules_held_out_and_awkward_rows(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = rules.fit_quality(docs, labels.where("doc_id % 3 <> 1"))
    scores = {r.doc_id: r.score for r in rules.score_quality(docs, model).collect()}
    held = [(scores[r.doc_id] >= 0.5) == (r.quality == 1) for r in labels.where("doc_id % 3 = 1").collect()]
    assert np.mean(held) > 0.97 and len(model.rules) < 100
    got = rules.score_quality(awkward(spark), model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert rules.score_quality(empty(spark), rules.fit_quality(docs, labels.where("false"))).count() == 0


def test_fingerprints_align_shifted_and_noisy_copies(spark):
    r = np.random.default_rng(9)
    tone = lambda s, n: (128 + 60 * np.sin(np.cumsum(0.05 + 0.4 * np.repeat(np.random.default_rng(s).random(n // 400 + 1), 400)[:n])) + 8 * np.random.default_rng(s + 99).standard_normal(n)).clip(0, 255).astype(np.uint8)
    song = tone(1, 12_000)
    noisy = (song.astype(int) + r.integers(-2, 3, len(song))).clip(0, 255).astype(np.uint8)
    rows = [(0, song), (1, noisy), (2, np.concatenate([tone(5, 320 * 5), song])), (3, tone(7, 12_000)), (4, np.zeros(0, np.uint8)), (5, np.full(3000, 128, np.uint8)), (6, None), (None, song)]
    prints = fingerprints.fingerprints(spark.createDataFrame([(k, None if x is None else bytearray(x.tobytes())) for k, x in rows], "doc_id long, pcm binary"))
    found = {}
    for one in (1, 2, 3):
        pair = prints.where(f"doc_id in (0, {one}, 4, 5, 6)")
        for x in fingerprints.align(pair, pair.where("doc_id = 0")).collect():
            found[x.doc_id] = x["shift"]
    assert found == {1: 0, 2: 320 * 5 // fingerprints.HOP}
    assert fingerprints.align(prints.where("false"), prints.where("false")).count() == 0


def brute_alignments(prints, queries, least_votes=2, least_overlap=6, most_wrong=0.2):
    runs = {d: [(int(v[k]), k) for k in range(len(v)) if k == 0 or v[k] != v[k - 1]] for d, v in prints.items()}
    where = {d: {} for d in prints}
    for d, run in runs.items():
        for v, k in run:
            where[d].setdefault(v, []).append(k)
    found = {}
    for q in queries:
        for d in prints:
            votes = Counter(k - own for v, own in runs[q] for k in where[d].get(v, ()))
            if d == q or not votes:
                continue
            n, _, shift = max((n, -abs(s), s) for s, n in votes.items())
            a, b = prints[q][max(0, -shift) :], prints[d][max(0, shift) :]
            overlap = min(len(a), len(b))
            wrong = int(np.bitwise_count(a[:overlap] ^ b[:overlap]).sum())
            if n >= least_votes and overlap >= least_overlap and wrong <= most_wrong * 32 * overlap:
                found[q, d] = (shift, n, overlap, wrong)
    return found


def alignments(df):
    rows = df.collect()
    found = {(r.query_id, r.doc_id): (r["shift"], r.votes, r.overlap, r.bit_errors) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("block", [200, fingerprints.BLOCK])
def test_fingerprints_find_all_members_of_families(spark, block):
    r = np.random.default_rng(4)
    songs = [r.integers(0, 256, 4000).astype(np.uint8) for _ in range(3)]
    rows = [(10 * s + k, song if k < 4 else np.concatenate([r.integers(0, 256, 320).astype(np.uint8), song[: 3000 + 100 * k]])) for s, song in enumerate(songs) for k in range(7)]
    prints = fingerprints.fingerprints(spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in rows], "doc_id long, pcm binary"))
    found = alignments(fingerprints.align(prints, prints.where("doc_id in (3, 12, 13, 25)"), block=block))
    assert found == brute_alignments({k: fingerprints.integers(x) for k, x in rows}, [3, 12, 13, 25])
    assert {d for q, d in found if q == 3} == {0, 1, 2, 4, 5, 6}
    assert {d for q, d in found if q == 12} == {10, 11, 13, 14, 15, 16}


def best_of(found, docs):
    out = {}
    for d in docs:
        own = [(wrong / (32 * n), -votes, q, shift, n, wrong) for (q, x), (shift, votes, n, wrong) in found.items() if x == d]
        rate, votes, *rest = min(own, default=(None, None, None, None, None, None))
        out[d] = (len(own), *rest, votes and -votes, rate)
    return out


def test_fingerprints_match_brute_force_on_a_table(spark):
    """Every link and the best one, of a whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    prints = {r.doc_id: fingerprints.integers(np.frombuffer((r.text or "").encode(), np.uint8)) for r in rows}
    want = brute_alignments(prints, [d for d in prints if d % 100 == 0])
    table = fingerprints.fingerprints(spark.createDataFrame([(r.doc_id, bytearray((r.text or "").encode())) for r in rows], "doc_id long, pcm binary"))
    assert alignments(fingerprints.align(table, table.where("doc_id % 100 = 0"))) == want
    got = fingerprints.op1_chroma_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_links, r.query_id, r["shift"], r.overlap, r.bit_errors, r.votes, r.error_rate) for r in got} == best_of(want, prints)


def test_fingerprints_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "cast(text as binary) as pcm", "1 as votes", "2 as query_id")
    prints = fingerprints.fingerprints(docs)
    got = {r.doc_id: r for r in fingerprints.best_alignments(prints, prints.where("doc_id in (6, 2)")).collect()}
    assert set(got) == set(range(1, 11)) and (got[7].n_links, got[7].query_id, got[7].bit_errors) == (1, 6, 0) and got[1].n_links == 0
    none = fingerprints.fingerprints(empty(spark).selectExpr("doc_id", "cast(text as binary) as pcm"))
    assert fingerprints.best_alignments(none, none).count() == 0


def plain_statistics(text):
    """STATISTICS of one text, by plain counting."""
    raw = (text or "").encode()
    count = lambda bytes_: sum(raw.count(bytes([b])) for b in bytes_)
    w = [x.lower() for x in raw.translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ") if x]
    letters = count([*range(65, 91), *range(97, 123), *range(128, 256)])
    times, lines = Counter(w), [x for x in raw.split(b"\n") if x.strip()]
    n, k = max(1, len(raw)), max(1, len(w))
    return [
        np.log1p(len(raw)), np.log1p(len(w)), sum(map(len, w)) / k, count(range(65, 91)) / max(1, letters), count(range(48, 58)) / n, count(b"#$%&*<>{}[]\\/@^~_=+`") / n, count(b".,;:?'\"()-") / n, count(b"!") / n, count(b"|") / n, count(range(128, 256)) / n,
        len(w) / (raw.count(b"\n") + 1), len(times) / k, max(times.values(), default=0) / k, 1 - len(set(lines)) / max(1, len(lines)) if b"\n" in raw else 0.0,
    ]


def test_statistics_and_rule_scores_equal_plain_counts(spark):
    """Every statistic of every text, and the compiled column's score from them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n\t\n"), (-4, "One LINE\none line\n\nOne LINE!"), (-5, "\x1c|#é漢字 ABC 123"), (None, long_text(2000)), (-4, "x")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    plain = [(r.doc_id, plain_statistics(r.text)) for r in docs.collect()]
    sort = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *np.round(r[1], 6)))
    got = sort([(r.doc_id, [r[s] for s in rules.STATISTICS]) for r in rules.with_statistics(docs.repartition(5)).collect()])
    assert [d for d, _ in got] == [d for d, _ in sort(plain)]
    np.testing.assert_allclose([x for _, x in got], [x for _, x in sort(plain)], atol=1e-9)
    base = "/root/testdata/sf0.01"
    model = rules.fit_quality(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet").where("doc_id % 3 <> 1"))

    def score(x):
        z = model.intercept + sum(w for w, rule in model.rules if all(x[k] <= bound if below else x[k] > bound for k, below, bound in rule.parts))
        return 1 / (1 + np.exp(-z))

    scored = sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in rules.score_quality(docs, model).collect())
    want = sorted((d is not None, d or 0, score(x)) for d, x in got)
    assert [r[:2] for r in scored] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2] for r in scored], [r[2] for r in want], atol=1e-9)
