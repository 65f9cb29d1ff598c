"""What grows with the tables is read once and stays out of the driver: plans of the queries of round 4."""

import os

from quillspark.operators import extraction as X
from quillspark.operators import results as R
from quillspark.plans import batch as B
from quillspark.plans import queries as Q
from quillspark.sources.dossier import letter_lines
from quillspark.sources.profiles import mark_table

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_gathered_once_a_page(spark):
    """No window and one gathering of lines: windows and three aggregations of lines were most of a page's time."""
    plan = plan_of(X.page_table(letter_lines(spark, SMALL)))
    assert "Window" not in plan and plan.count("partial_collect_list") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_a_long_page(spark):
    """Each of many labels twice: the later value, the earlier place."""
    n = 900
    rows = [(1, 1, k, f"L{'abcdefghij'[k % 10]}{k % n} : {k}") for k in range(2 * n)]
    got = X.extract_pairs(spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, text string")).orderBy("pos").collect()
    labels = [(k, t.split(" : ")[0]) for _, _, k, t in rows]
    last = {label: str(k) for k, label in labels}
    assert [(x.label, x.value) for x in got] == [(label, last[label]) for label in dict.fromkeys(label for _, label in labels)]


def test_marks_are_not_sent_to_the_driver(spark):
    for name in ("j8_contained", "j8_sole_profile"):
        assert "BroadcastExchange" not in plan_of(Q.QUERIES[name](spark, SMALL))


def test_archives_are_opened_once(spark):
    assert "InPandas" not in plan_of(Q.QUERIES["s9_archives"](spark, SMALL))


def test_detection_orders_few_ids_at_a_time(spark, monkeypatch):
    """A range of the order was found by ordering as many ids as it has files."""
    lines = letter_lines(spark, SMALL)
    asked, limit = [], type(lines).limit
    monkeypatch.setattr(type(lines), "limit", lambda t, n: (asked.append(n), limit(t, n))[1])
    assert B.first_detection(lines.where("doc_id > 200 and text not like 'Ref No%' or doc_id > 900"), mark_table(spark), first=64) is not None
    assert max(asked) <= R.FEW_MARKS + 1


def test_detection_reads_letters_once(spark):
    assert plan_of(Q.QUERIES["p12_detection"](spark, SMALL)).count("orders.parquet") == 1


def test_many_marks_go_through_the_index(spark, monkeypatch):
    labels = X.document_labels(letter_lines(spark, SMALL), True)
    few = sorted(map(tuple, R.detected(labels, mark_table(spark)).collect()), key=str)
    monkeypatch.setattr(R, "FEW_MARKS", 1)
    assert sorted(map(tuple, R.detected(labels, mark_table(spark)).collect()), key=str) == few


def test_letters_of_the_audit_are_read_without_the_batch(spark):
    """The batch was run and stored for a sheet that these queries don't look at."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    plans = [plan_of(Q.QUERIES[name](spark, SMALL)) for name in ("w7_audit_pairs", "w8_audit_advice")]
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before and all(p.count("orders.parquet") == 1 for p in plans)


def test_differences_are_found_once(spark):
    assert "orders.parquet" not in plan_of(Q.QUERIES["a9_differences"](spark, SMALL))


def test_first_names_read_letters_once(spark):
    assert "orders.parquet" not in plan_of(Q.QUERIES["o8_first_names"](spark, SMALL))
