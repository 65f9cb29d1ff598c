"""From lines of letters to label : value pairs, sections and one notice a file.

Lines are rows (doc_id, page_no, line_no, text). Pairs are found by classifying
each line with column expressions and gathering each page's lines once; sections fold
a document's pages in order. Lines are dealt out by document once, and all that
follows stays there. A page's lines, and a document's pages, are held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import letters as L

PAGE = ["doc_id", "page_no"]
MAP = "map<string,string>"


def classified(lines: DataFrame, bulleted: Column | bool = False, plain: bool = False) -> DataFrame:
    """Lines with kind (reset, pair, share, bullet, close, cont), label, value and,
    for a pair whose value is a pair without colon, nested label and value. With
    plain, every label counts and shares and bullets aren't looked for."""
    bulleted = F.lit(bulleted) if isinstance(bulleted, bool) else bulleted
    t = lines.withColumn("line", L.clean(F.col("text"))).withColumn("bulleted", F.coalesce(bulleted, F.lit(False)))
    line = F.col("line")
    pair, label, value = L.pair_of_line(line, F.col("before"))
    t = t.withColumn("before", F.substring_index(line, ":", 1)).withColumn("pair", pair).withColumn("plabel", F.when(F.col("pair"), label)).withColumn("pvalue", F.when(F.col("pair"), value))
    kind = F.when((line == "") | L.is_junk_line(line), "reset").when(F.col("pair"), "pair").when(L.is_close_line(line), "close").otherwise("cont") if plain else (
        F.when((line == "") | L.is_junk_line(line), "reset")
        .when(F.col("pair") & L.is_label(F.col("plabel")), "pair")
        .when(F.col("pair"), "reset")
        .when(L.is_share_line(line), "share")
        .when(F.col("bulleted") & line.rlike(L.BULLET), "bullet")
        .when(L.is_close_line(line), "close")
        .otherwise("cont")
    )
    t = t.withColumn("kind", kind)
    pick = lambda k: F.when(F.col("kind") == "pair", F.col("plabel" if k == 0 else "pvalue")).when(F.col("kind") == "share", L.label_value(line, L.SHARE)[k]).when(F.col("kind") == "bullet", L.label_value(line, L.BULLET)[k])
    t = t.withColumn("label", pick(0)).withColumn("value", pick(1))
    nested = F.col("bulleted") & (F.col("kind") == "pair") & F.col("value").rlike(L.NESTED)
    inner = [F.when(nested, x) for x in L.label_value(F.col("value"), L.NESTED)]
    t = t.withColumn("nested_label", inner[0]).withColumn("nested_value", inner[1])
    t = t.withColumn("value", F.when(F.col("nested_label").isNotNull(), "").otherwise(F.col("value")))
    return t.drop("before", "pair", "plabel", "pvalue", "bulleted")


#: Begins the text of a run of lines; no clean line holds it, as it counts as white space.
RUN = "\x1e"


def page_pairs(lines: DataFrame, bulleted: Column | bool = False, plain: bool = False, heads: bool = False) -> DataFrame:
    """doc_id, page_no, pairs: a page's pairs (pos, label, value) in the order of their
    places; with heads also heads, the first lines that aren't blank, and from_ocr.

    A page's lines are gathered once and put in order. A run is a line that isn't a
    continuation with those that go on with it; the runs' texts come from one text that
    is cut where they begin, so that a page's work grows with its lines."""
    amounts = bulleted is not False
    t = classified(lines.withColumn("line_no", F.col("line_no").cast("int")), bulleted, plain)
    kind, line = F.col("kind"), F.col("line")
    paired = kind.isin("pair", "share", "bullet")
    # What a bullet says is fixed; other values go on in the lines after them.
    piece = F.when(kind == "cont", F.concat(F.lit(" "), line)).otherwise(F.concat(F.lit(RUN), F.when(paired, F.col("value")).otherwise("")))
    columns = [F.col("line_no"), (kind == "close").alias("close"), (kind != "cont").alias("starts"), F.when(paired, F.col("label")).alias("label"), piece.alias("piece")]
    if amounts:
        columns += [F.when(kind == "bullet", F.col("value")).alias("fixed"), F.when(paired, F.col("nested_label")).alias("nested_label"), F.col("nested_value")]
    if heads:
        columns.append(F.when(line != "", F.when(F.col("text") == line, line).otherwise(L.bare(F.col("text")))).alias("head"))
    ocr = [F.coalesce(F.max("from_ocr"), F.lit(False)).alias("from_ocr")] if heads else []
    t = t.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("all"), *ocr)
    stop = F.array_position(F.transform("all", lambda x: x["close"]), True)
    own = F.slice("all", F.lit(1), F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size("all")))
    more = [F.slice(F.filter(F.transform("all", lambda x: x["head"]), lambda h: h.isNotNull()), 1, L.HEADINGS).alias("heads"), F.col("from_ocr")] if heads else []
    t = t.select(*PAGE, *more, own.alias("own"))
    kept = ["heads", "from_ocr"] if heads else []
    parts = F.split(F.array_join(F.transform("own", lambda x: x["piece"]), ""), RUN)
    t = t.select(*PAGE, *kept, F.filter("own", lambda x: x["starts"]).alias("runs"), parts.alias("parts"))
    texts = F.slice("parts", F.lit(2), F.size("parts"))
    entry = lambda label, value, sets, at: F.struct(label.alias("label"), at.alias("at"), sets.alias("sets"), value.alias("value"))

    def found(x, text):
        at, whole = 2 * x["line_no"] + 1, F.btrim(text)
        if not amounts:
            return entry(x["label"], whole, F.lit(True), at)
        return F.array(entry(x["nested_label"], x["nested_value"], F.lit(False), at - 1), entry(x["label"], F.coalesce(x["fixed"], whole), x["fixed"].isNull(), at))

    entries = F.zip_with("runs", texts, found)
    entries = F.filter(F.flatten(entries) if amounts else entries, lambda e: e["label"].isNotNull())
    return merged(t.select(*PAGE, *kept, entries.alias("entries"))).select(*PAGE, "pairs", *kept)


def merged(t: DataFrame) -> DataFrame:
    """t, whose entries (label, at, sets, value) are in the order of at, with pairs:
    (pos, label, value), one of each label, in the order of its first place. The last
    entry that sets a label's value counts, of a label without one the first."""
    labels = F.transform("entries", lambda e: e["label"])
    several = F.size(F.array_distinct(labels)) < F.size("entries")
    t = t.withColumn("several", several)
    # The order of labels, and within one of places or of what counts: its entries lie side by side.
    firsts = F.sort_array(F.transform("entries", lambda e: F.struct(e["label"], e["at"])))
    counts = F.zip_with("entries", F.sequence(F.lit(1), F.greatest(F.size("entries"), F.lit(1))), lambda e, k: F.when(e["label"].isNotNull(), F.struct(e["label"].alias("label"), F.when(e["sets"], k).otherwise(-k).alias("rank"), e["value"].alias("value"))))
    t = t.withColumn("firsts", F.when(F.col("several"), firsts)).withColumn("lasts", F.when(F.col("several"), F.sort_array(F.filter(counts, lambda c: c.isNotNull()))))
    after = lambda c: F.slice(c, F.lit(2), F.size(c))
    before = lambda c: F.concat(F.slice(c, 1, 0), F.array(F.lit(None)), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))
    first = F.filter(F.zip_with("firsts", before("firsts"), lambda x, y: F.when(~x["label"].eqNullSafe(y["label"]), x)), lambda x: x.isNotNull())
    last = F.filter(F.zip_with("lasts", after("lasts"), lambda x, y: F.when(~x["label"].eqNullSafe(y["label"]), x)), lambda x: x.isNotNull())
    both = F.sort_array(F.zip_with(first, last, lambda f, l: F.struct(f["at"].alias("pos"), f["label"].alias("label"), l["value"].alias("value"))))
    alone = F.transform("entries", lambda e: F.struct(e["at"].alias("pos"), e["label"].alias("label"), e["value"].alias("value")))
    return t.withColumn("pairs", F.when(F.col("several"), both).otherwise(alone)).drop("entries", "several", "firsts", "lasts")


def extract_pairs(lines: DataFrame, bulleted: Column | bool = False, plain: bool = False) -> DataFrame:
    """doc_id, page_no, label, value, pos: each page's pairs. A later pair of a
    label replaces an earlier one; bullets only fill in; lines without a label
    go on with the one before; a page ends at the letter's close."""
    return page_pairs(lines.repartition("doc_id"), bulleted, plain).select(*PAGE, F.inline("pairs")).select(*PAGE, "label", "value", "pos")


def document_labels(lines: DataFrame, bulleted: Column | bool = False) -> DataFrame:
    """doc_id, labels: the different labels of the documents that have a pair."""
    t = page_pairs(lines.repartition("doc_id"), bulleted)
    return t.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("pairs", lambda e: e["label"])))).alias("labels")).where(F.size("labels") > 0)


def updated(old: Column, new: Column) -> Column:
    """A map updated by another: keys keep their places, new ones come last."""
    kept = F.transform_values(old, lambda k, v: F.coalesce(F.element_at(new, k), v))
    return F.map_concat(kept, F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)))


def with_default(old: Column, key: Column, value: Column) -> Column:
    use = value.isNotNull() & (value != "") & (key != "") & ~F.map_contains_key(old, key)
    return F.when(use, F.map_concat(old, F.create_map(key, value))).otherwise(old)


def page_table(lines: DataFrame, bulleted: Column | bool = False, plain: bool = False) -> DataFrame:
    """doc_id, page_no, heads (first lines that aren't blank), found (ordered map),
    from_ocr. Lines are dealt out by document once; all that follows stays there."""
    if "from_ocr" not in lines.columns:
        lines = lines.withColumn("from_ocr", F.lit(False))
    t = page_pairs(lines.repartition("doc_id"), bulleted, plain, heads=True)
    found = F.map_from_entries(F.transform("pairs", lambda e: F.struct(e["label"], e["value"])))
    return t.select(*PAGE, "heads", found.alias("found"), "from_ocr")


def contradicts(section: Column, page: Column, owner: Column) -> Column:
    """Another addressee, or at least two labels with other values."""
    other = F.map_contains_key(section, owner) & F.map_contains_key(page, owner) & (F.btrim(F.element_at(section, owner)) != F.btrim(F.element_at(page, owner)))
    clash = F.filter(F.map_entries(page), lambda e: F.map_contains_key(section, e["key"]) & (e["value"] != "") & (F.element_at(section, e["key"]) != "") & (F.btrim(e["value"]) != F.btrim(F.element_at(section, e["key"]))))
    return F.coalesce((owner != "") & other, F.lit(False)) | (F.size(clash) >= 2)


def sections(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, sections: array of (kind, found), has_text and from_ocr (of any page).
    Pages with a skip heading or without pairs are left out; one without title joins
    the section before it unless they contradict. profile is one row, so the join moves nothing."""
    p = pages.join(F.broadcast(profile.limit(1).select("skips", "titles", "addressee", "letterhead", F.col("reference").alias("reference_label"))))
    heads, titles = F.col("heads"), F.col("titles")
    skips = F.arrays_overlap(F.transform(heads, F.lower), F.col("skips"))
    p = p.withColumn("title", L.title_of(heads, titles))
    titled = F.coalesce(F.col("title") != "", F.lit(False))
    reference = F.when(titled & (F.col("reference_label") != ""), L.title_reference(heads, titles))
    p = p.withColumn("found", F.when(F.coalesce(reference, F.lit("")) != "", updated(F.col("found"), F.create_map(F.col("reference_label"), reference))).otherwise(F.col("found")))
    letterhead = F.when(titled & F.col("letterhead"), L.letterhead(heads, titles))
    p = p.withColumn("found", with_default(F.col("found"), F.col("addressee"), letterhead))
    start = F.array().cast(f"array<struct<kind:string,found:{MAP}>>")

    def step(done, page):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & page["title"].isNull() & ~contradicts(last["found"], page["found"], page["addressee"])
        merged = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["kind"].alias("kind"), updated(last["found"], page["found"]).alias("found"))))
        opened = F.concat(done, F.array(F.struct(L.initials(F.coalesce(page["title"], F.lit(""))).alias("kind"), page["found"].alias("found"))))
        return F.when(F.coalesce(joins, F.lit(False)), merged).otherwise(opened)

    # Map values can't be sorted by, so pages are put in order by number and place.
    page = F.when(~skips & (F.size("found") > 0), F.struct("page_no", "title", F.map_entries("found").alias("entries"), "addressee"))
    numbered = p.select("doc_id", page.alias("page"), (F.size("heads") > 0).alias("has_text"), "from_ocr")
    pages_ = F.transform(F.array_sort(F.collect_list("page")), lambda x: F.struct(x["page_no"].alias("page_no"), x["title"].alias("title"), F.map_from_entries(x["entries"]).alias("found"), x["addressee"].alias("addressee")))
    return numbered.groupBy("doc_id").agg(F.aggregate(pages_, start, step).alias("sections"), F.max("has_text").alias("has_text"), F.max("from_ocr").alias("from_ocr"))


#: What a file's error says, by the stage it came from, the earliest stage first.
STAGES = {"open": "can't be opened: ", "recognise": "recognition failed: "}


def with_files(found: DataFrame, files: DataFrame | None, errors: DataFrame | None) -> DataFrame:
    """found (of sections) with a row for every file, and its error (stage, message).

    files: doc_id of all files; one without any line has no text. errors: doc_id,
    stage (open or recognise), message. Of several errors of a file the one of
    the earliest stage counts, then the least message; a null message is ''."""
    kind = "struct<stage:string,message:string>"
    if errors is None:
        found = found.withColumn("error", F.lit(None).cast(kind))
    else:
        stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
        one = F.min(F.struct(stage.alias("at"), F.col("stage").alias("stage"), L.filled(F.col("message")).alias("message"))).alias("e")
        of = errors.groupBy("doc_id").agg(one).select("doc_id", F.struct("e.stage", "e.message").cast(kind).alias("error"))
        found = found.join(of, "doc_id", "full")
    if files is not None:
        found = found.join(files.select("doc_id").distinct(), "doc_id", "full")
    none = F.array().cast(f"array<struct<kind:string,found:{MAP}>>")
    return found.select("doc_id", F.coalesce("sections", none).alias("sections"), F.coalesce("has_text", F.lit(False)).alias("has_text"), F.coalesce("from_ocr", F.lit(False)).alias("from_ocr"), "error")


def choose(found: DataFrame, profile: DataFrame) -> DataFrame:
    """The one notice that is ours: doc_id, ok, reason, note, kind, found, total,
    other, from_ocr. found: of with_files. A file's error comes first, then a lack
    of text, then the choice; a file with either has no notices."""
    failed = F.col("error").isNotNull() | ~F.col("has_text")
    found = found.withColumn("sections", F.when(failed, F.slice("sections", 1, 0)).otherwise(F.col("sections")))
    t = found.join(F.broadcast(profile.limit(1).select("addressee", "names", "letterhead")))
    addressee = lambda s: F.btrim(F.coalesce(F.try_element_at(s["found"], F.col("addressee")), F.lit("?")))
    ours = lambda s: F.exists("names", lambda n: F.contains(F.lower(addressee(s)), n))
    s = F.col("sections")
    t = t.withColumn("total", F.size(s)).withColumn("mine", F.filter(s, ours)).withColumn("others", F.transform(F.filter(s, lambda x: ~ours(x)), addressee))
    kinds = F.array_distinct(F.transform(s, lambda x: x["kind"]))
    t = t.withColumn("what", F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("advice"))
    named = F.filter("others", lambda x: x != "?")
    anyone = (F.col("addressee") == "") | (F.size("names") == 0)
    one = F.when(anyone & (F.col("total") == 1), F.get(s, F.lit(0))).when(~anyone & (F.size("mine") == 1), F.get("mine", F.lit(0)))
    t = t.withColumn("one", one).withColumn("named", named)
    prefix = F.element_at(F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair)), F.col("error.stage"))
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(L.filled(prefix), F.col("error.message")))
        .when(~F.col("has_text"), "no text that can be read")
        .when(F.col("total") == 0, "no notice found")
        .when(F.col("one").isNotNull(), "")
        .when(anyone, F.concat(F.lit("several notices and no rule for the addressee: "), F.col("total")))
        .when((F.size("mine") == 0) & (F.size("named") == 0), F.when(F.col("letterhead"), "no letterhead names the addressee").otherwise(F.concat(F.lit("no line names the addressee: "), F.col("addressee"))))
        .when(F.size("mine") == 0, F.concat(F.col("what"), F.lit(" addressed to others: "), F.array_join("named", ", ")))
        .otherwise(F.concat(F.size("mine"), F.lit(" "), F.col("what"), F.lit(" addressed to us")))
    )
    note = F.when(F.col("one").isNotNull() & ~anyone & (F.size("others") > 0), F.concat(F.col("total"), F.lit(" "), F.col("what"), F.lit("; skipped: "), F.array_join("others", ", "))).otherwise("")
    other = F.when(anyone, 0).when(F.col("one").isNotNull(), F.size("others")).when((F.size("mine") == 0) & (F.size("named") > 0), F.col("total")).otherwise(0)
    return t.select("doc_id", F.col("one").isNotNull().alias("ok"), reason.alias("reason"), note.alias("note"), F.coalesce("one.kind", F.lit("")).alias("kind"), F.col("one.found").alias("found"), "total", other.alias("other"), (F.col("from_ocr") & ~failed).alias("from_ocr"))
