"""Names for files that share a folder: a taken name gets the smallest free number.

Files come in order. One whose name is taken becomes 'stem (2).ext', or (3), and so
on, whatever is free at its turn; a name that already reads 'stem (2).ext' may be
taken by an earlier 'stem.ext', and then gets a number of its own. That is a chain
of decisions in arrival order; here it is found for all names at once:

- Files of one name are ranked in their order (a running count). Without other names
  in the way the r-th renamed file gets number r + 1.
- A name 'stem (n).ext' that files have by themselves is a block of 'stem.ext' from its
  first file's turn on. If fewer than n - 1 - c renamed files of 'stem.ext' come before
  that turn, where c counts the skipped blocks below n, number n is skipped and
  the block's first file keeps its name; else n is used, and that file is renamed.
- c, and whether the first file of 'stem.ext' itself kept its name, depend on other
  blocks. Bounds on both are narrowed in rounds until every block is decided; a
  round decides at least the lowest open block of each name, and each round's table is
  written, so that the next one starts from there.
- Then a running count of skipped blocks shifts the numbers of the renamed files.

Files that overwrite (fixed) keep their name and block it for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .scan import running

#: A number as it is written behind a stem: from 2 on, without leading zeros.
NUMBERED = "^(?s)(.+) \\(([2-9]|[1-9][0-9]{1,16})\\)$"


def suffix_of(name: Column) -> Column:
    """The extension with its dot, '' without one."""
    return F.regexp_extract(name, "(?s)^.*[^.](\\.[^.]+)$", 1)


def stem_of(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix_of(name)))


def blocks_of(rows: DataFrame) -> DataFrame:
    """name, parent, n, at (turn of its first file), first (of one that isn't fixed), fixed_at:
    names that a number could give to a file of the table's name parent."""
    bases = rows.groupBy("name").agg(F.min("seq").alias("at"), F.min(F.when(~F.col("fixed"), F.col("seq"))).alias("first"), F.min(F.when(F.col("fixed"), F.col("seq"))).alias("fixed_at"))
    stem = stem_of(F.col("name"))
    numbered = bases.withColumn("n", F.regexp_extract(stem, NUMBERED, 2)).where("n <> ''").withColumn("n", F.col("n").cast("long"))
    numbered = numbered.withColumn("parent", F.concat(F.regexp_extract(stem, NUMBERED, 1), suffix_of(F.col("name"))))
    return numbered.join(rows.where("not fixed").select(F.col("name").alias("parent")).distinct(), "parent", "left_semi")


def keeps(skipped: Column, first: Column, fixed_at: Column) -> Column:
    """Whether the first file of a name keeps it."""
    return skipped & first.isNotNull() & (fixed_at.isNull() | (first < fixed_at))


def decided(blocks: DataFrame) -> DataFrame:
    """blocks (with before: files of parent up to the turn) and skipped: true where
    the number is skipped, so that the name is free at its own file's turn."""
    t = kept(blocks.withColumn("skipped", F.lit(None).cast("boolean")))
    while not t.where("skipped is null").isEmpty():
        # The parent's own first file: unknown as long as its block is open.
        parents = t.select(F.col("name").alias("parent"), keeps(F.col("skipped"), F.col("first"), F.col("fixed_at")).alias("kept"), F.lit(True).alias("is_block"))
        own = t.join(parents, "parent", "left").withColumn("kept", F.when(F.col("is_block"), F.col("kept")).otherwise(F.col("parent_kept")))
        most = F.when(F.col("kept"), F.greatest(F.col("before") - 1, F.lit(0))).otherwise(F.col("before"))
        least = F.when(F.col("kept") | F.col("kept").isNull(), F.greatest(F.col("before") - 1, F.lit(0))).otherwise(F.col("before"))
        lower = Window.partitionBy("parent").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        count = lambda c: F.coalesce(F.sum(c.cast("long")).over(lower), F.lit(0))
        own = own.withColumn("sure", count(F.coalesce("skipped", F.lit(False)))).withColumn("may", count(F.coalesce("skipped", F.lit(True))))
        found = F.when(F.col("may") < F.col("n") - 1 - most, True).when(F.col("sure") >= F.col("n") - 1 - least, False)
        t = kept(own.withColumn("skipped", F.coalesce("skipped", found)).select(t.columns))
    return t


def unique_names(rows: DataFrame) -> DataFrame:
    """rows (seq, name and other columns) with own: the name each file gets. seq is
    a number of its own for each row; rows with fixed true overwrite. Null names
    stay null. An empty table gives an empty one."""
    if "fixed" not in rows.columns:
        rows = rows.withColumn("fixed", F.lit(False))
    rows = rows.withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    key = rows.select("seq", "name", "fixed").where("name is not null")
    blocks = blocks_of(key)
    turns = key.where("not fixed").select(F.col("name").alias("base"), "seq", F.lit(1).alias("file"), F.lit(None).cast("string").alias("block"))
    turns = turns.unionByName(blocks.select(F.col("parent").alias("base"), F.col("at").alias("seq"), F.lit(0).alias("file"), F.col("name").alias("block")))
    ranked = kept(running(turns, "seq", {"rank": F.col("file").cast("long")}, ("base",)))
    fixed = key.where("fixed").groupBy("name").agg(F.min("seq").alias("held_at"))
    first = key.where("not fixed").groupBy("name").agg(F.min("seq").alias("first_seq"))
    free = first.join(fixed, "name", "left").select(F.col("name").alias("base"), (F.col("held_at").isNull() | (F.col("first_seq") < F.col("held_at"))).alias("parent_kept"))
    known = blocks.join(ranked.where("file = 0").select(F.col("block").alias("name"), F.col("rank").alias("before")), "name").join(free.withColumnRenamed("base", "parent"), "parent")
    known = decided(known)
    owners = free.join(known.select(F.col("name").alias("base"), F.col("skipped")), "base", "left").select("base", (F.col("parent_kept") & F.coalesce("skipped", F.lit(True))).alias("kept"))
    files = ranked.where("file = 1").join(owners, "base").select("base", "seq", (F.col("rank") - F.col("kept").cast("long")).alias("place"))
    # Skipped number i of a name counts for the files from place n - i on.
    skipped = known.where("skipped").withColumn("i", F.row_number().over(Window.partitionBy("parent").orderBy("n")))
    shifts = skipped.select(F.col("parent").alias("base"), (F.col("n") - F.col("i")).alias("place"))
    some = shifts.select("base").distinct()
    both = files.join(some, "base", "left_semi").select("base", "seq", "place", F.lit(0).cast("long").alias("skip")).unionByName(shifts.select("base", F.lit(None).cast("long").alias("seq"), "place", F.lit(1).cast("long").alias("skip")))
    # Skips come before the file of their place: they sort by an odd and an even number.
    both = both.withColumn("order", 2 * F.col("place") + 1 - F.col("skip"))
    moved = running(both, "order", {"shift": F.col("skip")}, ("base",)).where("seq is not null").select("seq", "place", "shift")
    numbers = moved.unionByName(files.join(some, "base", "left_anti").select("seq", "place", F.lit(0).cast("long").alias("shift")))
    named = rows.join(numbers.select("seq", F.when(F.col("place") > 0, F.col("place") + 1 + F.col("shift")).alias("__number")), "seq", "left")
    name, number = F.col("name"), F.col("__number")
    other = F.concat(stem_of(name), F.lit(" ("), number.cast("string"), F.lit(")"), suffix_of(name))
    return named.select(*rows.columns, F.coalesce(other, name).alias("own"))
