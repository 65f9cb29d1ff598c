"""Many names, and many profiles, against many letters.

Names are looked for as substrings: an automaton over all of them reads each text
once. Its names are collected and sent to the tasks only up to a size; a larger table
is split by the names' hash, and each part reads the texts in turn.

Profiles are sets of marks, and fit where a letter has all of them. An index holds
each profile under its rarest mark, so a letter meets only profiles whose rarest
mark it has; then its marks among theirs are counted. Frequent marks and profiles that
fit many letters are salted by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names in one automaton, which takes about a hundred bytes for each.
NAME_BYTES = 1 << 20
HITS_AT_ONCE = 1 << 16
SALTS = 16


def names_found(texts: DataFrame, names: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """doc_id, name: every name, in lower case, that a text contains without regard
    to case. texts: doc_id, text; names: name. A null text counts as '', a null
    name is never found, '' is found in every text. Equal names are one, a name
    that occurs several times in a text is one hit, a repeated row of texts has its
    own hits. Without names or texts there is no row."""
    spark = texts.sparkSession
    known = names.select(F.lower(F.col("name").cast("string")).alias("name")).where("name is not null").distinct()
    folded = texts.select("doc_id", F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    size, blank = known.agg(F.sum(F.octet_length("name")), F.count_if(F.col("name") == "")).first()
    kind = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, name string"
    found = folded.select("doc_id", F.lit("").alias("name")).where(F.lit(blank > 0))
    parts = -(-(size or 0) // name_bytes)
    for k in range(parts):
        own = [r.name for r in known.where((F.pmod(F.xxhash64("name"), F.lit(parts)) == k) & (F.col("name") != "")).collect()]
        if own:
            found = found.unionByName(folded.mapInArrow(searcher(spark, own), kind))
    return found


def searcher(spark, names: list[str]):
    """A function over batches (doc_id, text) that gives (doc_id, name)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, name in enumerate(names):
        automaton.add_word(name, k)
    automaton.make_automaton()
    sent = spark.sparkContext.broadcast((automaton, names))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, words = sent.value
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1)):
                own = {k for _, k in machine.iter(text.as_py())}
                rows += [row] * len(own)
                hits += own
                if len(hits) > HITS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([words[k] for k in hits])], ["doc_id", "name"])
                    rows, hits = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([words[k] for k in hits], pa.string())], ["doc_id", "name"])

    return search


def contained(labels: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, profile: each profile all of whose marks are among a document's
    labels. labels: doc_id, label; marks: profile, mark. Repeated labels and marks
    count once. A null label is none; a profile with a null mark fits nothing; ids
    and profiles are not null. Profiles without any mark are not in marks: see sole_profile.

    Marks grow with the profiles, and each is salted, which an estimate of their size
    doesn't see: no side of these joins is sent whole to the driver."""
    dealt = lambda t: t.hint("merge")
    have = labels.where("label is not null").select("doc_id", "label").distinct()
    marks = marks.select("profile", "mark").distinct()
    counts = marks.groupBy("profile").agg(F.count("*").alias("n"))
    seen = have.groupBy("label").agg(F.count("*").alias("times"))
    rarest = marks.join(dealt(seen), F.col("mark") == F.col("label")).groupBy("profile").agg(F.min(F.struct("times", "mark")).alias("r"), F.count("*").alias("known"))
    index = rarest.join(dealt(counts), "profile").where("known = n").select("profile", F.col("r.mark").alias("rare"), "n")
    salted = lambda t: t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = have.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    met = own.join(dealt(salted(index).withColumnRenamed("rare", "label")), ["label", "salt"]).select("doc_id", "salt", "profile", "n")
    more = met.where("n > 1").join(dealt(salted(marks)), ["profile", "salt"]).select("doc_id", "profile", "n", F.col("mark").alias("label"))
    full = more.join(dealt(have), ["doc_id", "label"]).groupBy("doc_id", "profile", "n").agg(F.count("*").alias("k")).where("k = n")
    return met.where("n = 1").select("doc_id", "profile").unionByName(full.select("doc_id", "profile"))


def sole_profile(labels: DataFrame, marks: DataFrame, without_marks: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_profiles, profile of the documents that some profile fits: how many
    fit, and which if it is exactly one. A profile without marks fits every document that has a label row."""
    hits = contained(labels, marks)
    for profile in without_marks:
        hits = hits.unionByName(labels.select("doc_id").distinct().withColumn("profile", F.lit(profile)))
    t = hits.groupBy("doc_id").agg(F.count("*").alias("n_profiles"), F.min("profile").alias("one"))
    return t.select("doc_id", "n_profiles", F.when(F.col("n_profiles") == 1, F.col("one")).alias("profile"))
