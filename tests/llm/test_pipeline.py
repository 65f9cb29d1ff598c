"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from quillspark.llm.common import stored

from .cases import SCHEMA, long_text
from .test_operators import brute_components, brute_containment

BAD = ["zorkfool", "grimwit", "vilebrat"]


def tables(spark, folder):
    rows, labels = [], []
    for k in range(240):
        text = long_text(90 + k % 40, 500 + k)
        toxic = k % 4 == 0
        if toxic:
            w = text.split()
            for i in range(5, len(w), 15):
                w[i] = BAD[(k + i) % 3]
            text = " ".join(w)
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, int(toxic)))
    item = long_text(30, 9001)
    passage = long_text(70, 9002)
    rows += [(1000 + k, rows[k][1], "en", "s", 1) for k in (1, 2, 3)]
    rows += [(1100 + k, f"{long_text(60, 700 + k)} {passage} {long_text(60, 800 + k)}", "en", "s", 1) for k in range(3)]
    rows += [(1200, f"{long_text(40, 901)} {item} {long_text(40, 902)}", "en", "s", 1), (1201, None, "en", "s", 0), (1202, "", "en", "s", 0), (None, long_text(80, 903), None, None, None)]
    rows += [rows[5], (7, long_text(66, 777), "en", "s", 1), (None, rows[9][1], None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(1, item)]


def test_stages_match_brute_force(spark, tmp_path):
    base = str(tmp_path)
    items = tables(spark, base)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stored(stage(spark, docs, base))
        after = out.collect()
        ids = lambda rows: Counter(r.doc_id for r in rows)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            toxic = {r.doc_id for r in before if any(b in (r.text or "") for b in BAD)}
            gone = set(ids(before)) - set(ids(after))
            assert len(gone & toxic) > 0.8 * len(toxic) and len(gone - toxic) <= 4
        elif name == "ngram_join":
            rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in before}, key=lambda x: (*x[:2], x[2] or ""))
            group = brute_components([(k, t) for k, (_, _, t) in enumerate(rows)])
            assert ids(after) == Counter(None if none else d for k, (none, d, _) in enumerate(rows) if group[k][1] == k)
            assert ids(after)[7] == 2 and ids(after)[None] == 1
        elif name == "suffix_dedup":
            seen = Counter(b[i : i + 200] for b in ((r.text or "").encode() for r in before) for i in range(len(b) - 199))
            want = Counter()
            for r in before:
                raw = (r.text or "").encode()
                dead = set()
                for i in range(len(raw) - 199):
                    if seen[raw[i : i + 200]] > 1:
                        dead.update(range(i, i + 200))
                want[r.doc_id, bytes(x for i, x in enumerate(raw) if i not in dead)] += 1
            assert Counter((r.doc_id, (r.text or "").encode()) for r in after) == want
            assert ids(after) == ids(before) and sum(len(r.text or "") for r in after) < sum(len(r.text or "") for r in before)
        elif name == "decontamination":
            found = {d for d, *_ in brute_containment([(r.doc_id, r.text) for r in before], items)}
            assert found == {1200} and ids(after) == Counter({d: n for d, n in ids(before).items() if d not in found})
        else:
            assert {r.doc_id for r in after} == set(ids(before)) and max(r.offset + r.length for r in after) <= 2048
        docs = out


def python_nodes(plan):
    """The most Python workers that a task of a plan has at once."""
    tasks = [0]

    def below(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return below(node.initialPlan())
        n = max([below(node.children().apply(k)) for k in range(node.children().size())], default=0)
        n += any(x in name for x in ("Arrow", "Python", "Pandas"))
        tasks.append(n)
        return 0 if "Exchange" in name else n

    below(plan)
    return max(tasks)


def test_removal_takes_one_python_worker_a_task(spark):
    """And cuts at whole characters, of changed texts only. Tables above the size that
    is broadcast are moved, so they are here."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    core = "".join(chr(0xE0 + k * 7 % 90) for k in range(150))
    texts = [f"a{core}é", core[1:], f"{core[:120]}漢{long_text(50, 921)}", "é", None, long_text(60, 922)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    out = corpus_pipeline.suffix_dedup(spark, docs, "")
    seen = Counter(b[i : i + 200] for b in ((t or "").encode() for t in texts) for i in range(len(b) - 199))
    want = {}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        dead = {x for i in range(len(raw) - 199) if seen[raw[i : i + 200]] > 1 for x in range(i, i + 200)}
        want[k] = bytes(b for i, b in enumerate(raw) if i not in dead).decode("utf-8", "ignore") if dead else t
    assert {r.doc_id: r.text for r in out.collect()} == want and sum(want[k] != t for k, t in enumerate(texts)) == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert python_nodes(corpus_pipeline.suffix_dedup(spark, docs, "")._jdf.queryExecution().executedPlan()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_stages_of_an_empty_table_and_clashing_names(spark, tmp_path):
    base = str(tmp_path)
    tables(spark, base)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    more = docs.limit(30).selectExpr("*", "1 as grp", "2 as label", "3 as score", "4 as item_id", "5 as n", "'x' as row")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.where("false"), base).collect() == [], name
        assert stage(spark, more, base).columns == more.columns, name
    assert corpus_pipeline.packing(spark, docs.where("false"), base).collect() == []


def test_decontamination_is_by_row(spark, tmp_path):
    """A row without an id that holds an item goes, a row that shares its id with one stays."""
    base = str(tmp_path)
    (_, item), = tables(spark, base)
    held = f"{long_text(50, 911)} {item} {long_text(30, 912)}"
    rows = [(1, held), (1, long_text(75, 913)), (None, held), (None, long_text(60, 914)), (2, None), (2, ""), (3, item), (3, item)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    after = corpus_pipeline.decontamination(spark, docs, base).collect()
    want = [(d, t) for k, (d, t) in enumerate(rows) if not brute_containment([(k, t)], [(1, item)])]
    assert len(want) == 4 and Counter((r.doc_id, r.text) for r in after) == Counter(want)
