import sys
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import letters as L
from quillspark.operators import audit as A
from quillspark.operators import extraction as X
from quillspark.operators import results as R
from quillspark.plans import batch as B
from quillspark.plans import queries as Q
from quillspark.sources import files, workbook
from quillspark.sources.dossier import letter_lines
from quillspark.sources.profiles import PROFILES, by_key, column_table, profile_table

TAKES = [
    ("Rp1.000", "", "1.000", "1.000", "Rp1.000"),
    ("Rp 1.000,50", "RP", "1.000,50", "1.000,50", ""),
    ("IDR (1,234.50)", "IDR", "1,234.50", "1,234.50", ""),
    ("IDR -5", "IDR", "5", "5", ""),
    ("Corp 12", "", "12", "12", "Corp 12"),
    ("10% of IDR 1,000.00.", "IDR", "1,000.00", "1,000.00", "10% of"),
    ("usd 5", "USD", "5", "5", ""),
    ("no money", "", "", "", "no money"),
    ("Sum IDR 5 / USD 6", "IDR", "5", "6", "Sum"),
    ("", "", "", "", ""),
    (None, "", "", "", ""),
]


def test_takes(spark):
    t = spark.createDataFrame([(k, x[0]) for k, x in enumerate(TAKES)], "k int, t string")
    got = t.select("k", *(f(F.col("t")) for f in (L.currency, L.amount, L.last_number, L.without_money))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [x[1:] for x in TAKES]


LABELS = [("Ref No : A/1", "Ref No", "A/1"), ("at 10:30", "at 10", "30"), ("X: y", None, None), ("Your Share 10% of 100% : IDR 5", "Your Share 10% of 100%", "IDR 5"), ("Your Share 12,5% of 100% : IDR 5", "Your Share", "IDR 5"), ("a" * 39 + " : v", "a" * 39, "v"), ("a" * 40 + ": v", None, None), ("Note:", "Note", ""), ("Ref No :  b", "Ref No", "b")]


def test_label_lines(spark):
    for k, (text, label, value) in enumerate(LABELS):
        lines = spark.createDataFrame([(k, 1, 0, text)], "doc_id int, page_no int, line_no int, text string")
        got = [(r.label, r.value) for r in X.extract_pairs(lines).collect()]
        assert got == ([(label, value)] if label else []), text


# A page's lines, the pairs without and with amounts after bullets (None: the same).
PAGES = [
    ([], [], None),
    (["go on", "Ref No : A"], [("Ref No", "A")], None),
    (["Ref No : A", "go on", "more  text"], [("Ref No", "A go on more text")], None),
    (["Ref No : A", "", "more text"], [("Ref No", "A")], None),
    (["Ref No : A", "page 1 of 2", "more text"], [("Ref No", "A")], None),
    (["Ref No : A", "12/03/2024", "more"], [("Ref No", "A")], None),
    (["Ref No : A", "Q" * 45, "more"], [("Ref No", "A")], None),
    (["Ref No : A", "Claim No :", "7"], [("Ref No", "A"), ("Claim No", "7")], None),
    (["Ref No : A", "x1 2 3-4 : v", "more"], [("Ref No", "A")], None),
    (["Ref No : A", "Claim No : B", "Ref No : C", "on"], [("Ref No", "C on"), ("Claim No", "B")], None),
    (["Ref No : A", "Jakarta, 12 March 2024", "Claim No : B"], [("Ref No", "A")], None),
    (["Jakarta, 12 March 2024", "Claim No : B"], [], None),
    (["Your Share 2,5% of 10% : IDR 1", "net"], [("Your Share", "IDR 1 net")], None),
    (["Loss : x", "Expense IDR 5"], [("Loss", "x Expense IDR 5")], [("Loss", "x"), ("Expense", "IDR 5")]),
    (["Loss : x", ": Indemnity : IDR (7)", "on"], [("Loss", "x : Indemnity : IDR (7) on")], [("Loss", "x"), ("Indemnity", "IDR (7)")]),
    (["Loss : Expense IDR 9", "on"], [("Loss", "Expense IDR 9 on")], [("Expense", "IDR 9"), ("Loss", "on")]),
    (["Expense IDR 5", "Expense IDR 6"], [], [("Expense", "IDR 5")]),
    (["Expense : IDR 5", "Loss : Expense IDR 6"], [("Expense", "IDR 5"), ("Loss", "Expense IDR 6")], [("Expense", "IDR 5"), ("Loss", "")]),
    (["Expense IDR 5", "Expense : z"], [("Expense", "z")], [("Expense", "z")]),
]


@pytest.mark.parametrize("bulleted", [False, True])
def test_pages_and_their_pairs(spark, bulleted):
    lines = spark.createDataFrame([(k, 1, i, t) for k, p in enumerate(PAGES) for i, t in enumerate(p[0])], "doc_id int, page_no int, line_no int, text string")
    got: dict = {}
    for x in X.extract_pairs(lines, bulleted).orderBy("doc_id", "pos").collect():
        got.setdefault(x.doc_id, []).append((x.label, x.value))
    want = {k: (p[2] if bulleted and p[2] is not None else p[1]) for k, p in enumerate(PAGES)}
    assert got == {k: v for k, v in want.items() if v}


def test_headings_keep_inner_white_space(spark):
    """A title printed with two blanks isn't found; edges don't matter."""
    text = [(1, "\u00a0 Definite Loss Advice\t"), (2, "Definite  Loss Advice")]
    lines = spark.createDataFrame([(d, 1, k, t) for d, x in text for k, t in enumerate(["", x, "Reinsurer : Asuransi Astra"])], "doc_id int, page_no int, line_no int, text string")
    b = B.run(lines, "jrp")
    assert {r.doc_id: r.kind for r in b.chosen.collect()} == {1: "DLA", 2: "?"}
    assert B.run(lines.where("false"), "jrp").rejected() != ""


def test_audit_of_nothing(spark):
    """Empty letters, an empty sheet, both; values of null; equal counts in order of appearance."""
    lines = spark.createDataFrame([(1, 1, 0, "Preliminary Loss Advice"), (1, 1, 1, "Reinsurer : Asuransi Astra"), (1, 1, 2, "Nett Amount : usd (5)")], "doc_id int, page_no int, line_no int, text string")
    sheet = spark.createDataFrame([("1", 0, "Reinsurer", "x"), ("1", 1, "Currency", None), ("1", 2, "Definite Claim Amount", " 5 "), ("1", 3, "Sumber PDF", "1")], "name string, col_no int, header string, value string")
    found = A.advice(lines)
    count = lambda f, s: tuple(A.verdict(f, s).first())
    assert count(found, sheet) == (1, 1, 0, 0, 3, 2, 0, False)
    assert count(found, sheet.where("false")) == (1, 0, 1, 0, 0, 0, 0, False)
    assert count(A.advice(lines.where("false")), sheet) == (0, 1, 0, 1, 0, 0, 0, False)
    assert count(A.advice(lines.where("false")), sheet.where("false")) == (0, 0, 0, 0, 0, 0, 0, True)
    got = [(r.header, r.n, r.want, r.got) for r in A.differences(A.compared(found, sheet)).orderBy("header_no", "place").collect()]
    assert got == [("Reinsurer", 1, "Asuransi Astra", "x"), ("Currency", 1, "USD", "")]


def test_letterhead_profile(spark):
    """Title on the third line: the letterhead names us, the next line is the reference."""
    text = ["PT Asuransi Astra", "to whom", "DEFINITE LOSS ADVICE", "R-77", "Name of Reinsured : N", "Interest Insured : I", "Total Sum Insured : IDR 5 / USD 6", "Expense IDR 9"]
    lines = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(text)], "doc_id int, page_no int, line_no int, text string")
    b = B.run(lines)
    assert b.profile.key == "kmdastur"
    r = b.results.collect()[0]
    found = dict(r.found)
    assert found["Kop Surat"] == "PT Asuransi Astra" and found["Definite Loss Advice"] == "R-77" and found["Expense"] == "IDR 9"
    assert r["values"][0] == "R-77" and r["values"][11] == "5" and dict(r.extra) == {}
    assert by_key("askrindo") is None and len(PROFILES[0].columns) == 24
    assert column_table(spark, PROFILES[0]).count() == 24 and profile_table(spark).count() == 2


def test_batch_without_profile_is_rejected(spark):
    lines = spark.createDataFrame([(1, 1, 0, "nothing")], "doc_id int, page_no int, line_no int, text string")
    with pytest.raises(ValueError):
        B.run(lines)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    base = "/root/testdata/sf0.001"
    for t in ("orders", "customer", "nation", "lineitem", "events", "documents", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, base).toPandas(), db.sql(Q.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    flat = lambda d: sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert flat(got) == flat(want)


def test_workbook_round_trip(spark, tmp_path):
    b = B.run(letter_lines(spark, "/root/testdata/sf0.001").where("doc_id <= 40"), "jrp")
    captions = {r.group_no: f"Tabel {r.group_no}: {r.caption}" for r in b.groups.collect()}
    path = str(tmp_path / "report.xlsx")
    workbook.write_workbook(b.cells, captions, path)
    back = workbook.read_workbook(spark, path)
    name = F.regexp_extract("name", "\\d+", 0)
    want = b.cells.where("header <> 'Currency'").select(F.col("doc_id").cast("string").alias("name"), "header", "value")
    states = R.audit_cells(want, back.where("header <> 'Currency'").withColumn("name", name)).groupBy("state").count().collect()
    assert [(r.state) for r in states] == ["same"]
    assert B.pivoted(b, 1).count() == b.groups.where("group_no = 1").first().n_rows
    report = [tuple(r) for r in workbook.report_json(b).orderBy("section", "place").collect()]
    assert "JRP" in report[0][2] and [r[0][0] for r in report] == sorted(r[0][0] for r in report)
    groups, skipped = b.groups.count(), b.chosen.where("not ok").count()
    assert sum(r[0] == "2 group" for r in report) == groups and sum(r[0] == "5 skipped" for r in report) == skipped
    assert workbook.output_name(b) == "JRP.xlsx" and workbook.output_name(b, "may") == "may.xlsx" and b.rejected() == ""


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("x/a.pdf", "y/a.pdf", "a (2).pdf", ".hidden.pdf", "note.txt", "b.PDF"):
            z.writestr(n, b"%PDF" + n.encode())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = files.unpacked(files.listed(spark, str(tmp_path), "*.zip", content=True)).orderBy("archive", "seq").collect()
    assert [r.name for r in got] == ["a.pdf", "a (2).pdf", "a (2) (2).pdf", "b.PDF", None] and got[-1].error == "not an archive"
    rows = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate([("a.pdf", 5), ("b.txt", 5), ("c.PDF", 16 << 20), ("d.zip", 1)])], "seq int, name string, size long")
    assert [(r.name, r.error) for r in files.accepted(rows).orderBy("seq").collect()] == [("a.pdf", None), ("c.PDF", "file too large"), ("d.zip", None)]


def test_entry_imports_without_the_training_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("quillspark.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillspark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert "w1_pairs" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streamed_pages(spark, tmp_path):
    from quillspark.streaming.letters import write_pairs

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, ["Ref No : A", "more"]), (2, 1, ["x"])], "doc_id long, page_no int, lines array<string>").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, page_no int, lines array<string>").parquet(source)
    write_pairs(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [(r.label, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("Ref No", "A more")]
