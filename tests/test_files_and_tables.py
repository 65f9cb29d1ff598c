"""Running totals, names, matching, detection, tables, file errors and expiry against plain loops."""

import random
import re
import zipfile
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit as A
from quillspark.operators import extraction as X
from quillspark.operators import matching as M
from quillspark.operators import results as R
from quillspark.operators.naming import unique_names
from quillspark.operators.scan import running
from quillspark.plans import batch as B
from quillspark.sources import files
from quillspark.sources.dossier import letter_lines
from quillspark.sources.profiles import PROFILES, by_key, mark_table
from quillspark.streaming import expiry

LINES = "doc_id long, page_no int, line_no int, text string"


# Running totals

def test_running_totals_with_ties_nulls_and_a_frequent_key(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + [None, "a", "b"]), r.choice([None, *range(40)]), r.randint(0, 9), k) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, v int, i int").repartition(5)
    got = {x.i: (x.total, x.n) for x in running(df, "o", {"total": F.col("v"), "n": F.lit(1)}, ("k",), ("i",), parts=7).collect()}
    want, seen = {}, {}
    for k, o, v, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[3])):
        t, n = seen.get(k, (0, 0))
        seen[k] = want[i] = (t + v, n + 1)
    assert got == want
    assert running(df.where("false"), "o", {"n": F.lit(1)}).collect() == []
    one = running(df.select("o", "i"), "o", {"n": F.lit(1)}, ties=("i",), parts=1).collect()
    assert sorted(x.n for x in one) == list(range(1, 601))


# Names

def brute_names(rows):
    have, out = set(), {}
    for seq, name, fixed in sorted(rows, key=lambda x: x[0]):
        if name is None:
            out[seq] = None
            continue
        p, n, own = PurePosixPath(name), 2, name
        while not fixed and own in have:
            own, n = f"{p.stem} ({n}){p.suffix}", n + 1
        have.add(own)
        out[seq] = own
    return out


def random_names(seed, groups, fixed):
    r, rows, seq = random.Random(seed), [], 0
    behind = ["", "", "", " (2)", " (3)", " (4)", " (2) (2)", " (2) (3)", " (02)", " (1)", " (99999999999999999999)"]
    for g in range(groups):
        for _ in range(r.randint(1, 22)):
            seq += r.randint(1, 3)
            rows.append((seq, f"g{g}{r.choice('ab')}{r.choice(behind)}{r.choice(['.pdf', '.PDF'])}", r.random() < fixed))
    return rows


@pytest.mark.parametrize("seed,fixed", [(1, 0.0), (2, 0.2)])
def test_names_equal_a_loop(spark, seed, fixed):
    rows = random_names(seed, 40, fixed) + [(10**6, None, False), (10**6 + 1, "no extension", False), (10**6 + 2, "no extension", False)]
    df = spark.createDataFrame(rows, "seq long, name string, fixed boolean").repartition(3).withColumn("place", F.lit("x"))
    assert {x.seq: x.own for x in unique_names(df).collect()} == brute_names(rows)


def test_one_frequent_name_and_names_that_wait_for_each_other(spark):
    rows = [(k, "scan.pdf", False) for k in range(300)] + [(1000 + k, f"scan ({k}).pdf", False) for k in range(2, 60)] + [(2000 + k, "scan.pdf", False) for k in range(50)]
    rows += [(5 * k + 10_000, "b" + " (2)" * (k % 6) + ".pdf", False) for k in range(60)]
    assert {x.seq: x.own for x in unique_names(spark.createDataFrame(rows, "seq long, name string, fixed boolean")).collect()} == brute_names(rows)
    assert unique_names(spark.createDataFrame([], "seq long, name string")).collect() == []


def brute_admission(rows, most=None):
    place = total = 0
    out, kinds = [], {".pdf": 15 << 20, ".zip": 200 << 20}
    for seq, name, size in sorted(rows):
        end = name[-4:].lower()
        if end not in kinds:
            continue
        place, total = place + 1, total + (size or 0)
        read = max(s for s, n, _ in rows if n == name) if end == ".pdf" else seq
        error = ("file" if end == ".pdf" else "archive") + " too large" if (size or 0) > kinds[end] else "batch too large" if total > 400 << 20 else None
        out.append((seq, name, place, total, read, error))
    return out


def test_admission_and_limits(spark):
    r = random.Random(4)
    rows = [(k, f"{r.choice('abcd')}{r.choice(['.pdf', '.PDF', '.zip', '.txt', ''])}", r.choice([None, 5, 10**6, 4 * 10**6, 16 << 20])) for k in range(400)]
    df = spark.createDataFrame(rows, "seq long, name string, size long").repartition(4)
    got = [(x.seq, x.name, x.place, x.total, x.read_seq, x.error) for x in files.admission(df).orderBy("seq").collect()]
    assert got == brute_admission(rows)
    assert [x.seq for x in files.accepted(df).orderBy("seq").collect()] == [x[0] for x in got[:250]]
    assert files.admission(df.where("false")).collect() == []


def test_listing_of_uploads_and_members(spark):
    """Members are renamed, uploads overwrite and stay listed twice."""
    uploads = spark.createDataFrame([(1, "a.pdf", 1), (2, "z.zip", 1), (3, "a.pdf", 1), (4, "a (2).pdf", 1), (5, "y.zip", 1)], "seq long, name string, size long")
    inside = spark.createDataFrame([(2, 0, "a.pdf"), (2, 1, "b.pdf"), (5, 0, "a.pdf"), (5, 1, "b.pdf"), (5, 2, None)], "seq long, at int, name string")
    got = [(x.place, x.name, x.read_seq) for x in files.listing(uploads, inside).orderBy("place").collect()]
    assert got == [(1, "a.pdf", 3), (2, "a (2).pdf", 4), (3, "b.pdf", 2), (4, "a.pdf", 3), (5, "a (2).pdf", 4), (6, "a (3).pdf", 5), (7, "b (2).pdf", 5)]
    assert files.listing(uploads, inside, most=2).count() == 2


def test_members_of_archives_share_a_folder(spark, tmp_path):
    for name, members in {"a": ["x/a.pdf", "b.pdf"], "b": ["a.pdf", "a (2).pdf"]}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m in members:
                z.writestr(m, m.encode())
    got = files.unpacked(files.listed(spark, str(tmp_path), "*.zip", content=True)).orderBy("archive", "seq").collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("a.pdf", b"x/a.pdf"), ("b.pdf", b"b.pdf"), ("a (2).pdf", b"a.pdf"), ("a (2) (2).pdf", b"a (2).pdf")]


# Matching

def test_names_found_whole_and_in_parts(spark):
    texts = [(1, "Attn PT Astra Buana and astra"), (2, None), (3, ""), (4, "x" * 50_000 + "BUANA"), (4, "buana"), (5, "İstanbul ß")]
    names = ["astra", "ASTRA", "buana", "an", None, "nowhere", "t as", "ß"]
    t, n = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(x,) for x in names], "name string")
    want = sorted((d, x) for d, s in texts for x in {y.lower() for y in names if y} if x in (s or "").lower())
    for size in (1 << 20, 6):
        assert sorted(map(tuple, M.names_found(t, n, size).collect())) == want
    blank = M.names_found(t, n.union(spark.createDataFrame([("",)], "name string"))).where("name = ''")
    assert blank.count() == len(texts)
    assert M.names_found(t, n.where("false")).collect() == [] and M.names_found(t.where("false"), n).collect() == []


def test_contained_sets_equal_a_loop(spark):
    r = random.Random(6)
    labels = [(d, r.choice(["hot", None, *"abcdefgh"])) for d in range(60) for _ in range(6)] + [(d, "hot") for d in range(60)]
    marks = [(p, m) for p in range(80) for m in r.sample(["hot", *"abcdefghz"], r.randint(1, 3))] + [(90, "hot"), (91, None), (91, "hot"), (92, "hot"), (92, "hot")]
    have, need = {}, {}
    for d, x in labels:
        have.setdefault(d, set()).add(x)
    for p, m in marks:
        need.setdefault(p, set()).add(m)
    want = sorted((d, p) for d in have for p in need if None not in need[p] and need[p] <= have[d])
    left, right = spark.createDataFrame(labels, "doc_id long, label string").repartition(3), spark.createDataFrame(marks, "profile long, mark string")
    assert sorted(map(tuple, M.contained(left, right).collect())) == want
    sole = {x.doc_id: (x.n_profiles, x.profile) for x in M.sole_profile(left, right).collect()}
    assert sole == {d: (n, next(p for e, p in want if e == d) if n == 1 else None) for d in have if (n := sum(e == d for e, _ in want))}
    assert M.contained(left.where("false"), right).collect() == [] and M.contained(left, right.where("false")).collect() == []
    both = M.sole_profile(left.where("doc_id < 3"), right.where("false").select(F.col("profile").cast("string"), "mark"), ("any",))
    assert sorted((x.doc_id, x.profile) for x in both.collect()) == [(0, "any"), (1, "any"), (2, "any")]


# Detection

def test_detection_stops_at_the_first_hit(spark):
    """Letters of later ranges are not parsed: their text would raise an error."""
    lines = letter_lines(spark, "/root/testdata/sf0.001")
    blank = lines.withColumn("text", F.when(F.col("doc_id") < 100, "").otherwise(F.col("text")))
    trap = blank.withColumn("text", F.when(F.col("doc_id") > 600, F.raise_error(F.lit("read too far"))).otherwise(F.col("text")))
    marks = mark_table(spark)
    assert B.first_detection(trap, marks, first=4, growth=5) == (100, "jrp")
    with pytest.raises(Exception, match="read too far"):
        B.first_detection(trap.where("doc_id > 599"), marks, first=64)
    errors = spark.createDataFrame([(100, "open", "x")], "doc_id long, stage string, message string")
    assert B.first_detection(blank, marks, errors, first=4, growth=5) == (101, "jrp")
    assert B.first_detection(lines.where("false"), marks) is None
    assert B.first_detection(blank.where("doc_id < 100"), marks) is None
    assert B.detect(lines).key == "jrp"


# Lines and pages

PAIR, SHARE, CLOSE = (re.compile(p) for p in (r"^([A-Za-z][A-Za-z0-9 ./&'%()\-]{1,38}?)\s*:\s*(.*)$", r"(?i)^([A-Za-z][A-Za-z ./&'\-]{1,38}?)\s+[\d.,]+%\s+of\s+[\d.,]+%\s*:\s*(.*)$", r"^[A-Z][A-Za-z .]{2,24},\s+(?:\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},\s+\d{4})\s*$"))
JUNK = re.compile(r"^[A-Z]{40,}$|^\s*,?\s*\d{1,2}[/-]\d{1,2}[/-]\d{4}\s*$|(?i:page \d+ of \d+|for and on behalf of)")


def plain_kind(text):
    line = " ".join((text or "").split())
    if not line or JUNK.search(line):
        return "reset", None, None
    if m := PAIR.match(line):
        label = m[1].strip()
        letters = sum(c.isalpha() for c in label)
        solid = len(label.replace(" ", ""))
        return ("pair", label, m[2].strip()) if letters >= 2 and letters * 10 >= solid * 4 else ("reset", None, None)
    if m := SHARE.match(line):
        return "share", m[1].strip(), m[2].strip()
    return ("close" if CLOSE.match(line) else "cont"), None, None


def test_guarded_line_tests_equal_the_plain_patterns(spark):
    r = random.Random(9)
    bits = ["Ref No", "X", "a", ":", " : ", "  ", "\t", " ", "10%", " of ", "100%", "2,5%", "Jakarta", ", ", "12 March 2024", "March 12, 2024", "12/03/2024", "1-1-2024", ",", "Page 1 OF 2", "FOR AND ON BEHALF OF", "Q" * 41, "é", "-", "(x)", "IDR 5", " ", "9", " "]
    lines = ["".join(r.choice(bits) for _ in range(r.randint(0, 6))) for _ in range(3000)]
    lines += [None, "", "X : y", "X: y", "Xy:z", "a" * 39 + ": v", "a" * 39 + " : v", "a" * 40 + ": v", "A :: b", ": b", "a b :", "12/12/2024", ", 12/12/2024", "Jakarta,  12 March 2024 "]
    df = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(lines)], LINES)
    got = {x.line_no: (x.kind, x.label, x.value) for x in X.classified(df).collect()}
    assert got == {k: plain_kind(t) for k, t in enumerate(lines)}


def test_bands_equal_a_loop(spark):
    r = random.Random(3)
    rows = [(d, 1, float(r.randint(0, 9)), round(r.random() * 40, r.choice([0, 1, 3])), f"w{k}") for d in range(20) for k in range(r.randint(1, 40))]
    want = {}
    for d in range(20):
        anchor, no = None, 0
        for _, _, x, y, w in sorted((q for q in rows if q[0] == d), key=lambda q: q[3]):
            if anchor is None or abs(y - anchor) > 3.0:
                anchor, no = y, no + 1
            want.setdefault((d, no), []).append((x, w))
    want = {k: " ".join(w for _, w in sorted(v)) for k, v in want.items()}
    df = spark.createDataFrame(rows, "doc_id long, page_no int, x double, y double, word string").repartition(4)
    assert {(t.doc_id, t.line_no): t.text for t in R.banded(df).collect()} == want
    assert R.banded(df.where("false")).collect() == []
    assert [t.line_no for t in R.banded(spark.createDataFrame([(1, 1, 0.0, None, "w")], df.schema)).collect()] == [0]


# Errors, tables, sheet

def test_errors_come_before_text_and_choice(spark):
    text = ["Definite Loss Advice", "Reinsurer : Asuransi Astra", "Claim No : 7"]
    lines = spark.createDataFrame([(d, 1, k, t) for d in (1, 2, 3, 4, 5) for k, t in enumerate(text if d < 4 else [" ", "\t"])], LINES)
    recognised = spark.createDataFrame([(2, 1, 0, "Definite Loss Advice"), (2, 1, 1, "Reinsurer : Asuransi Astra"), (2, 1, 2, "Claim No : 8"), (5, 1, 0, None)], LINES)
    errors = spark.createDataFrame([(3, "recognise", "x"), (3, "open", None), (4, "recognise", "y"), (7, "open", "gone")], "doc_id long, stage string, message string")
    names = spark.createDataFrame([(d,) for d in range(1, 7)], "doc_id long")
    b = B.run(files.with_recognised(lines, recognised), "jrp", names, errors)
    got = {r.doc_id: (r.ok, r.reason, r.from_ocr, r.total) for r in b.chosen.collect()}
    assert got == {1: (True, "", False, 1), 2: (True, "", True, 1), 3: (False, "can't be opened: ", False, 0), 4: (False, "recognition failed: y", False, 0), 5: (False, "no text that can be read", False, 0), 6: (False, "no text that can be read", False, 0), 7: (False, "can't be opened: gone", False, 0)}
    assert {r.doc_id for r in R.scanned(b.results).collect()} == {2} and [(r.note_no, r.level) for r in b.notes.where("note_no = 5").collect()] == [(5, "warn")]
    assert sorted((r.view, r.doc_id) for r in R.views(b.chosen).where("view <> 'skipped'").collect()) == [("done", 1), ("done", 2), ("scanned", 2)]
    none = B.run(lines.where("false"), "jrp", names.where("false"), errors.where("false"))
    assert none.chosen.collect() == [] and R.rejection(none.chosen).first().rejected != "" and none.notes.collect() == [] and none.sheet.collect() == [] and none.tables.collect() == []


def test_claims_count_only_where_the_profile_has_them(spark):
    text = ["PT Asuransi Astra", "Definite Loss Advice", "Name of Reinsured : N", "Interest Insured : I", "Claim No : 7"]
    b = B.run(spark.createDataFrame([(d, 1, k, t) for d in (1, 2) for k, t in enumerate(text)], LINES), "kmdastur")
    assert b.chosen.where("ok").count() == 2 and R.duplicate_claims(b.results, b.profile).collect() == []
    assert {r.note_no for r in b.notes.collect()} == {3, 6}


def test_tables_of_different_columns_and_their_sheet(spark):
    """Rows as objects with each table's schema; captions, headers, rows and gaps in one sheet."""
    letters = {1: ["Claim No : 1", "Zeta : z", "Alpha : a"], 2: ["Claim No : 2", "Alpha : b", "Zeta : y"], 3: ["Claim No : 3", "Total Sum Insured : IDR 5"]}
    head = ["Definite Loss Advice", "Reinsurer : Asuransi Astra"]
    lines = spark.createDataFrame([(d, 1, k, t) for d, x in letters.items() for k, t in enumerate(head + x)], LINES)
    b = B.run(lines, "jrp").stored()
    groups = b.groups.orderBy("group_no").collect()
    assert [(g.n_rows, g.width, g.extras, g.caption) for g in groups] == [(2, 4, ["Zeta", "Alpha"], "2 DLA - 4 parameter"), (1, 4, [], "1 DLA - 4 parameter")]
    grid = {}
    for r in b.sheet.collect():
        grid.setdefault(r.sheet_row, {})[r.col_no] = r.value
    want = {
        1: ["Tabel 1 - 2 DLA - 4 parameter"], 2: ["Claim No", "Reinsurer", "Zeta", "Alpha", "Sumber PDF"], 3: ["1", "Asuransi Astra", "z", "a", "1"], 4: ["2", "Asuransi Astra", "y", "b", "2"],
        7: ["Tabel 2 - 1 DLA - 4 parameter"], 8: ["Claim No", "Reinsurer", "Currency", "Total Sum Insured", "Sumber PDF"], 9: ["3", "Asuransi Astra", "IDR", "5", "3"],
    }
    assert grid == {k: dict(enumerate(v, 1)) for k, v in want.items()}
    one = B.run(lines.where("doc_id = 3"), "jrp")
    assert min(r.sheet_row for r in one.sheet.collect()) == 1 and {r.value for r in one.sheet.where("sheet_row = 1").collect()} == set(want[8])
    table = R.typed_table(b.tables, 1)
    assert [c.split(" ", 1)[1] for c in table.columns[1:]] == want[2] and [list(r)[1:] for r in table.orderBy("doc_id").collect()] == [want[3], want[4]]
    assert R.typed_table(b.tables, 9).columns == ["doc_id"]


def test_odd_headers_and_values_in_tables(spark):
    rows = spark.createDataFrame([(1, 1, 0, 'say "x" `y`', 'a"b'), (1, 1, 1, "ünï, z: <q>", None), (1, 2, 0, 'say "x" `y`', "\\n"), (1, 2, 1, "ünï, z: <q>", "v")], "group_no int, doc_id long, col_no int, header string, value string")
    table = R.typed_table(R.table_rows(rows), 1)
    assert [c[4:] for c in table.columns[1:]] == ['say "x" `y`', "ünï, z: <q>"]
    assert [list(r)[1:] for r in table.orderBy("doc_id").collect()] == [['a"b', ""], ["\\n", "v"]]


def test_audit_takes_the_last_of_rows_with_one_name(spark):
    lines = spark.createDataFrame([(1, 1, 0, "Definite Loss Advice"), (1, 1, 1, "Reinsurer : Asuransi Astra")], LINES)
    sheet = spark.createDataFrame([("1", 1, 0, "Reinsurer", "x"), ("1", 2, 0, "Reinsurer", "Asuransi Astra"), ("1", 2, 1, "Sumber PDF", "1")], "name string, row_no int, col_no int, header string, value string")
    v = A.verdict(A.advice(lines), sheet).first()
    assert (v.letters, v.rows_, v.compared, v.differing, v.clean) == (1, 1, 1, 0, True)
    ratio = spark.createDataFrame([("1", 1, 0, "Definite Claim Amount", "100"), ("1", 1, 1, "Definite Claim Amount", "5"), ("1", 1, 2, "Your Share on Nett Loss", "50")], sheet.schema)
    assert [r.pct for r in A.ratios(ratio).collect()] == [50.0]


def test_profiles_are_detected_by_their_marks(spark):
    labels = spark.createDataFrame([(k, {m: "" for p in ps for m in by_key(p).values("mark")} | {"x": ""}) for k, ps in enumerate([(), ("jrp",), ("kmdastur",), ("jrp", "kmdastur")])], "doc_id long, found map<string,string>")
    assert {r.doc_id: r.profile for r in R.detected(labels, mark_table(spark)).collect()} == {0: None, 1: "jrp", 2: "kmdastur", 3: None}
    assert len(PROFILES) == 3


# Expiry

def test_results_expire_and_reading_does_not_keep_them(spark, tmp_path):
    """Over several micro-batches the stream gives what the table gives."""
    r = random.Random(2)
    rows = [(r.randint(1, 4), k, 60.0 * k + r.random(), r.random() < 0.15) for k in range(200)]
    events = spark.createDataFrame(rows, "key long, event_id long, s double, makes boolean").select("key", "event_id", F.timestamp_seconds("s").alias("ts"), "makes")
    for part in range(4):
        events.where((F.col("event_id") >= 50 * part) & (F.col("event_id") < 50 * part + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    expiry.written(expiry.reads(stream, 15), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(x.key, x.event_id): (x.made_at, x.live) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(x.key, x.event_id): (x.made_at, x.live) for x in expiry.reads_at_once(events, 15).collect()}
    assert got == want and {live for _, live in got.values()} == {True, False}
    last, plain = {}, {}
    for key, k, s, makes in rows:
        if makes:
            last[key] = s
        else:
            plain[key, k] = key in last and s - last[key] <= 900
    assert {k: v[1] for k, v in want.items()} == plain
