"""From chosen notices to table cells, groups, notes and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import letters as L
from ..sources.profiles import Profile
from .extraction import merged
from .matching import sole_profile
from .scan import running


NOTHING_READ = "no file could be read"
#: Marks that are compared with each letter at once; more of them go through the index of matching.
FEW_MARKS = 256


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def file_results(chosen: DataFrame, profile: Profile) -> DataFrame:
    """Adds to each accepted notice: values (in field order), missing sources,
    extra labels with values, and the shape (sorted labels it has). The profile
    is configuration of a few dozen fields, so this is one projection per row."""
    found = F.col("found")
    value = lambda f: L.TAKES[f.take](F.element_at(found, F.lit(f.label)))
    t = chosen.where("ok")
    t = t.withColumn("values", F.array(*[F.when(F.map_contains_key(found, F.lit(f.label)), value(f)).otherwise("") for f in profile.columns]))
    t = t.withColumn("missing", F.filter(strings(f.label for f in profile.columns), lambda s: ~F.map_contains_key(found, s)))
    t = t.withColumn("extra", F.map_filter(found, lambda k, v: ~F.array_contains(strings(profile.known_labels), k) & (v != "")))
    sources = strings(dict.fromkeys(f.label for f in profile.columns))
    return t.withColumn("shape", F.array_sort(F.array_union(F.filter(sources, lambda s: F.map_contains_key(found, s)), F.map_keys("extra"))))


def grouped(results: DataFrame, profile: Profile) -> DataFrame:
    """kind, shape, n_rows, width, first_doc, extras, group_no, caption: a table for
    each kind and shape, larger ones first, then wider ones, then by first
    appearance. width counts the columns of fields and extra labels; extras are the
    labels outside the profile, in the order of the first file."""
    has = lambda f: F.array_contains("shape", f.label).cast("int")
    wide = results.withColumn("width", sum((has(f) for f in profile.columns), F.size("extra")))
    g = wide.groupBy("kind", F.array_join("shape", "|").alias("shape")).agg(F.count("*").alias("n_rows"), F.any_value("width").alias("width"), F.min("doc_id").alias("first_doc"), F.min_by(F.map_keys("extra"), "doc_id").alias("extras"))
    # Ranks by counting what is larger within ranges of the row count, so that many groups don't meet in one task.
    g = running(g.withColumn("less", -F.col("n_rows")).withColumn("narrow", -F.col("width")), "less", {"group_no": F.lit(1).cast("long")}, ties=("narrow", "first_doc")).drop("less", "narrow")
    return g.withColumn("group_no", F.col("group_no").cast("int")).withColumn("caption", F.format_string("%d %s - %d parameter", "n_rows", "kind", "width"))


def cells(results: DataFrame, profile: Profile, groups: DataFrame, source_header: str = "Sumber PDF") -> DataFrame:
    """group_no, doc_id, col_no, header, value: every table in long form. A field
    whose source the group's shape lacks has no cells; extras follow the fields in
    the order of the group's first file, and the source file is last."""
    shape = F.array_join("shape", "|")
    t = results.withColumn("shape_key", shape).join(groups.select("kind", F.col("shape").alias("shape_key"), "group_no", "extras"), ["kind", "shape_key"])
    own = [F.struct(F.lit(k).alias("col_no"), F.lit(f.header).alias("header"), F.when(F.array_contains("shape", f.label), F.get("values", F.lit(k))).alias("value")) for k, f in enumerate(profile.columns)]
    n = len(profile.columns)
    extra = F.transform("extras", lambda k, i: F.struct((i + n).alias("col_no"), k.alias("header"), F.element_at("extra", k).alias("value")))
    last = F.array(F.struct((F.size("extras") + n).alias("col_no"), F.lit(source_header).alias("header"), F.col("doc_id").cast("string").alias("value")))
    rows = t.select("group_no", "doc_id", F.inline(F.concat(F.filter(F.array(*own), lambda c: c["value"].isNotNull()), extra, last)))
    return rows


def table_rows(rows: DataFrame) -> DataFrame:
    """group_no, doc_id, row: each file's cells as one VARIANT object, so tables of
    different columns live in one. A key is the column's place and header, as headers
    repeat; a null value stays a null."""
    entry = F.struct(F.format_string("%03d %s", "col_no", "header").alias("key"), F.coalesce("value", F.lit("")).alias("value"))
    row = F.to_variant_object(F.map_from_entries(F.array_sort(F.collect_list(entry))))
    return rows.groupBy("group_no", "doc_id").agg(row.alias("row"))


def table_schemas(table: DataFrame) -> DataFrame:
    """group_no, schema: the columns that the rows of each group have, found by one aggregation."""
    return table.groupBy("group_no").agg(F.schema_of_variant_agg("row").alias("schema"))


def typed_table(table: DataFrame, group_no: int) -> DataFrame:
    """One group's rows with a column for each key of its schema, named as the key.
    The schema is one text, of a group's columns."""
    own = table.where(F.col("group_no") == group_no)
    found = own.agg(F.schema_of_variant_agg("row").alias("schema")).first().schema or ""
    keys = [k.replace("``", "`") for k in re.findall("[<,] ?`((?:[^`]|``)*)`: ", found)]  # each holds a space, so each is quoted
    # Through JSON, as a path can't name every key.
    row = F.from_json(F.to_json("row"), T.StructType([T.StructField(k, T.StringType()) for k in keys]))
    return own.select("doc_id", *(row.getField(k).alias(k) for k in keys))


GAP = 2


def sheet_places(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """sheet_row, col_no, value of all tables stacked in one sheet: a caption where
    there are several tables, the header, the rows, two blank rows. A table starts
    where the heights of those before it end; a row's place in its table is a running
    count, so neither a long table nor many tables meet in one task. Columns
    are numbered from 1 without gaps."""
    heights = groups.select("group_no", "caption", "n_rows").join(groups.agg((F.count("*") > 1).cast("int").alias("captioned")))
    height = F.col("captioned") + 1 + F.col("n_rows") + GAP
    starts = running(heights, "group_no", {"end": height}).select("group_no", "caption", "captioned", (F.col("end") - height + 1).alias("start"))
    files = rows.select("group_no", "doc_id").distinct()
    at = running(files, "doc_id", {"row_no": F.lit(1).cast("long")}, ("group_no",)).select("group_no", "doc_id", "row_no")
    heads = rows.groupBy("group_no", "col_no").agg(F.any_value("header").alias("header"))
    heads = heads.withColumn("column", F.row_number().over(Window.partitionBy("group_no").orderBy("col_no")).cast("long"))  # a row a column
    head_row = F.col("start") + F.col("captioned")
    caption = starts.where("captioned = 1").select(F.col("start").alias("sheet_row"), F.lit(1).cast("long").alias("col_no"), F.concat(F.lit("Tabel "), F.col("group_no"), F.lit(" - "), F.col("caption")).alias("value"))
    header = heads.join(starts, "group_no").select(head_row.alias("sheet_row"), F.col("column").alias("col_no"), F.col("header").alias("value"))
    body = rows.join(heads.select("group_no", "col_no", "column"), ["group_no", "col_no"]).join(at, ["group_no", "doc_id"]).join(starts.drop("caption"), "group_no")
    body = body.select((head_row + F.col("row_no")).alias("sheet_row"), F.col("column").alias("col_no"), F.coalesce("value", F.lit("")).alias("value"))
    return caption.unionByName(header).unionByName(body)


def preview(rows: DataFrame, most: int = 5) -> DataFrame:
    """The first documents of each group."""
    ranked = rows.select("group_no", "doc_id").distinct().withColumn("row_no", F.row_number().over(Window.partitionBy("group_no").orderBy("doc_id"))).where(F.col("row_no") <= most)
    return rows.join(ranked, ["group_no", "doc_id"])


def widths(rows: DataFrame) -> DataFrame:
    """Column widths: the longest text plus two, between 10 and 52."""
    longest = F.greatest(F.max(F.length("value")), F.max(F.length("header")))
    return rows.groupBy("col_no").agg(F.greatest(F.lit(10), F.least(F.lit(52), longest + 2)).alias("width"))


def duplicate_claims(results: DataFrame, profile: Profile, header: str = "Claim No") -> DataFrame:
    """claim, n, doc_id: the files of each claim that several files have. A row a
    file, so that no claim's files are held together. Claims are the values of the
    profile's first column with that header; a profile without one has none."""
    at = next((k for k, f in enumerate(profile.columns) if f.header == header), None)
    claim = F.lit(None).cast("string") if at is None else F.get("values", F.lit(at))
    t = results.select("doc_id", claim.alias("claim")).where("claim <> ''")
    several = t.groupBy("claim").agg(F.count("*").alias("n")).where("n > 1")
    return t.join(several, "claim").select("claim", "n", "doc_id")


def rejection(chosen: DataFrame) -> DataFrame:
    """One row: files, done, rejected (why the batch has no result, '' if it has one)."""
    t = chosen.agg(F.count("*").alias("files"), F.count_if("ok").alias("done"))
    return t.withColumn("rejected", F.when(F.col("done") == 0, NOTHING_READ).otherwise(""))


def reasons(chosen: DataFrame) -> DataFrame:
    """Why files were skipped, the commonest reason first, then the earliest."""
    return chosen.where("not ok").groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).orderBy(F.desc("n"), "first_doc")


def skipped_files(chosen: DataFrame) -> DataFrame:
    """reason, n, first_doc, doc_id: every skipped file with its reason's rank."""
    skipped = chosen.where("not ok")
    counts = skipped.groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return skipped.select("reason", "doc_id").join(counts, "reason").select("reason", "n", "first_doc", "doc_id")


def scanned(results: DataFrame) -> DataFrame:
    """The accepted files that were read by recognition, in part at least."""
    return results.where("from_ocr")


def views(chosen: DataFrame) -> DataFrame:
    """view, doc_id: the files of each view of a batch: done, skipped, scanned (done
    and read by recognition), noted (done, with other notices beside ours)."""
    has = {"done": F.col("ok"), "skipped": ~F.col("ok"), "scanned": F.col("ok") & F.col("from_ocr"), "noted": F.col("ok") & (F.col("note") != "")}
    return chosen.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in has.items())))).alias("view"), "doc_id")


def note_details(results: DataFrame, groups: DataFrame, profile: Profile) -> DataFrame:
    """note_no, key, place, detail: what the notes of a batch list, to be ordered
    by note, place and detail. Notes, in this order: 1 several tables, 2 claims of
    several files, 3 labels outside the profile, 4 files with other notices beside
    ours, 5 files read by recognition, 6 files without some label."""
    name = F.col("doc_id").cast("string")
    row = lambda no, key, place, detail: F.struct(F.lit(no).alias("note_no"), key.alias("key"), place.cast("long").alias("place"), detail.alias("detail"))
    extra = F.transform(F.map_keys("extra"), lambda k: row(3, k, F.lit(0), k))
    other = F.when(F.col("note") != "", F.array(row(4, name, F.col("doc_id"), F.concat(name, F.lit(" - "), "note"))))
    lacks = F.when(F.size("missing") > 0, F.array(row(6, name, F.col("doc_id"), F.concat(name, F.lit(" - without: "), F.array_join(F.array_distinct("missing"), ", ")))))
    none = F.slice(F.array(row(0, F.lit(""), F.lit(0), F.lit(""))), 1, 0)
    read = F.when(F.col("from_ocr"), F.array(row(5, name, F.col("doc_id"), name)))
    own = results.select(F.inline(F.concat(extra, F.coalesce(other, none), F.coalesce(read, none), F.coalesce(lacks, none)))).distinct()
    tables = groups.join(groups.agg(F.count("*").alias("tables"))).where("tables > 1")
    label = F.format_string("Table %d: %d rows, %d parameters", "group_no", "n_rows", "width")
    parts = [tables.select(F.inline(F.array(row(1, F.col("group_no").cast("string"), F.col("group_no"), label))))]
    parts.append(duplicate_claims(results, profile).select(F.inline(F.array(row(2, F.col("claim"), F.col("doc_id"), F.concat("claim", F.lit(": "), name))))))
    for part in parts:
        own = own.unionByName(part)
    return own


def notes(details: DataFrame, profile: Profile) -> DataFrame:
    """note_no, level (info or warn), text, n_details: the notes that a batch has."""
    t = details.groupBy("note_no").agg(F.count("*").alias("n_details"), F.count_distinct("key").alias("keys"))
    no = F.col("note_no")
    text = (
        F.when(no == 1, F.format_string("The result is split into %d tables.", "keys"))
        .when(no == 2, F.format_string("%d claims occur more than once (%d rows); all are kept.", "keys", "n_details"))
        .when(no == 3, F.format_string(f"%d labels outside the profile {profile.value('name')} are columns too.", "keys"))
        .when(no == 4, F.format_string("%d files hold more than one notice; ours was taken.", "keys"))
        .when(no == 5, F.format_string("%d files without text were read by recognition.", "keys"))
        .otherwise(F.format_string("%d files lack some labels.", "keys"))
    )
    return t.select("note_no", F.when(no.isin(2, 5), "warn").otherwise("info").alias("level"), text.alias("text"), "n_details")


def summary(chosen: DataFrame, groups: DataFrame) -> DataFrame:
    a = chosen.agg(F.count("*").alias("files"), F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("skipped"), F.sum("total").alias("notices"), F.count_if("ok").alias("ours"), F.sum("other").alias("others"), F.count_if(F.col("note") != "").alias("noted"))
    return a.join(groups.agg(F.count("*").alias("tables"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")))


def extra_labels(results: DataFrame) -> DataFrame:
    return results.select(F.explode(F.map_keys("extra")).alias("label")).groupBy("label").agg(F.count("*").alias("files")).orderBy("label")


def missing_labels(results: DataFrame) -> DataFrame:
    return results.select(F.explode(F.array_distinct("missing")).alias("label")).groupBy("label").agg(F.count("*").alias("files"))


def detected(labels: DataFrame, marks: DataFrame, without_marks: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the one profile all of whose marks (profile, mark) are among its
    labels (null with none or several). labels: a row a document, with doc_id and
    found (a map of its labels) or labels (an array of them). Few marks are tested
    row by row, so that letters are read once."""
    own = F.map_keys("found") if "found" in labels.columns else F.col("labels")
    few = marks.limit(FEW_MARKS + 1).collect()
    if len(few) <= FEW_MARKS:
        of: dict = {}
        for row in few:
            of.setdefault(row["profile"], set()).add(row["mark"])
        kind = marks.schema["profile"].dataType
        fits = [F.when(F.size(F.array_intersect(own, strings(sorted(m)))) == len(m), F.lit(p).cast(kind)) for p, m in of.items() if None not in m]
        fits += [F.when(F.size(own) > 0, F.lit(p).cast(kind)) for p in without_marks]
        hits = F.array_compact(F.array(*fits)) if fits else F.array().cast(T.ArrayType(kind))
        return labels.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.size(hits) == 1), F.get(hits, F.lit(0))).alias("profile"))
    rows = labels.select("doc_id", F.explode(own).alias("label"))
    return labels.select("doc_id").join(sole_profile(rows, marks, without_marks).select("doc_id", "profile"), "doc_id", "left")


def merged_labels(pairs: DataFrame) -> DataFrame:
    """All of a document's pages as one map: later pages replace values."""
    t = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "pos", "label", "value"))).alias("all"))
    entries = F.transform("all", lambda e: F.struct(e["label"].alias("label"), F.struct(e["page_no"], e["pos"]).alias("at"), F.lit(True).alias("sets"), e["value"].alias("value")))
    t = merged(t.select("doc_id", entries.alias("entries")))
    return t.select("doc_id", F.map_from_entries(F.transform("pairs", lambda e: F.struct(e["label"], e["value"]))).alias("found"))


def banded(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page_no, line_no, text: words in bands of y. A band's anchor is its
    first word; a word further than the tolerance from it opens the next. Words
    of a band are ordered by x, then by text. Words without y are line 0.

    Whether a height opens a band depends on the band before it, so a page's
    different heights are folded in order, and the fold only adds to its anchors where
    a band opens. Words then count the anchors up to their own height in one sort."""
    page = ["doc_id", "page_no"]
    heights = F.array_sort(F.collect_set(F.col("y").cast("double")))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("anchors"))

    def step(acc, y):
        opens = acc["anchor"].isNull() | (F.abs(y - acc["anchor"]) > tolerance)
        return F.when(opens, F.struct(y.alias("anchor"), F.concat(acc["anchors"], F.array(y)).alias("anchors"))).otherwise(acc)

    anchors = words.groupBy(*page).agg(F.aggregate(heights, start, step, lambda a: a["anchors"]).alias("a")).select(*page, F.explode("a").alias("y"))
    rows = words.select(*page, F.col("y").cast("double").alias("y"), "x", "word", F.lit(0).alias("opens")).unionByName(anchors.select(*page, "y", F.lit(None).cast(words.schema["x"].dataType).alias("x"), F.lit(None).cast("string").alias("word"), F.lit(1).alias("opens")))
    up_to = Window.partitionBy(*page).orderBy(F.asc_nulls_first("y"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line_no", F.sum("opens").over(up_to).cast("int")).where("opens = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word"))), lambda w: w["word"]), " ")
    return rows.groupBy(*page, "line_no").agg(text.alias("text"))


def banded_by_rounding(words: DataFrame, height: float = 3.0) -> DataFrame:
    """The audit's bands: y over height, rounded half to even."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word"))), lambda w: w["word"]), " ")
    return words.groupBy("doc_id", "page_no", F.bround(F.col("y") / height).cast("long").alias("band")).agg(text.alias("text"))


def scanned_pages(lines: DataFrame, fewest: int = 120, pages: DataFrame | None = None) -> DataFrame:
    """Pages whose lines, stripped, have fewer characters: likely images. pages
    (doc_id, page_no) names all there are: one without any line has 0 characters."""
    t = lines.select("doc_id", "page_no", F.length(L.clean(F.col("text"))).alias("c"))
    if pages is not None:
        t = t.unionByName(pages.select("doc_id", "page_no", F.lit(0).alias("c")))
    return t.groupBy("doc_id", "page_no").agg(F.sum("c").alias("chars")).where(F.col("chars") < fewest)


def audit_cells(expected: DataFrame, sheet: DataFrame) -> DataFrame:
    """name, header, state (missing, extra, diff, same) of expected and found
    cells, both with name, header, value."""
    e = expected.select("name", "header", F.btrim(F.coalesce("value", F.lit(""))).alias("want"))
    s = sheet.select("name", "header", F.btrim(F.coalesce("value", F.lit(""))).alias("got"))
    both = e.join(s, ["name", "header"], "full")
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("got") != F.col("want"), "diff").otherwise("same")
    return both.select("name", "header", "want", "got", state.alias("state"))


def odd_ratio(c: Column) -> Column:
    """Not above 0 and up to 100, or with more than two decimals."""
    return (c <= 0) | (c > 100) | (F.abs(c * 100 - F.round(c * 100)) > 1e-6)
