"""The audit: what letters say against what a workbook's cells hold.

It reads letters by simpler rules than the batch, so that the two check each
other. A sheet is rows (name, col_no, header, value); a name is a letter's doc_id
as text. Everything is kept as rows: nothing but counts and the few samples of a
report is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import letters as L
from . import extraction as X
from .results import odd_ratio, strings
from ..sources.shared import kept
from .scan import running

# The titles, the addressee's label and names, and of the headers
# that don't show a label's value as it is, the label and how it is taken.
TITLES = ("DEFINITE LOSS ADVICE", "PRELIMINARY LOSS ADVICE")
OWNER = "Reinsurer"
OWNER_NAMES = ("astra buana", "asuransi astra buana", "asuransi astra")
TAKEN = {
    "Insured Interest": ("Insured Interest", L.without_money),
    "Total Sum Insured": ("Total Sum Insured", L.currency_amount),
    "Definite Claim Amount": ("Nett Amount", L.currency_amount),
    "Your Share on Nett Loss": ("Your Share on Nett Loss", L.last_number),
}
MONEY = ("Total Sum Insured", "Definite Claim Amount", "Your Share on Nett Loss")
SOURCE = "Sumber PDF"


def advice(lines: DataFrame) -> DataFrame:
    """name, found: of each letter the pairs of its first page with a title in
    the first six lines that is addressed to us; letters without one are absent."""
    pages = X.page_table(lines, plain=True)
    head = F.upper(F.array_join(F.transform("heads", L.clean), " "))
    who = F.lower(L.filled(F.element_at("found", F.lit(OWNER))))
    ours = F.exists(strings(TITLES), lambda t: F.contains(head, t)) & F.exists(strings(OWNER_NAMES), lambda n: F.contains(who, n))
    # A condition within the aggregation: a filter would move below the reading of pages and repeat it.
    first = F.min_by(F.when(ours, F.col("found")), F.when(ours, F.col("page_no")))
    return pages.groupBy("doc_id").agg(first.alias("found")).where("found is not null").select(F.col("doc_id").cast("string").alias("name"), "found")


def expected_value(header: Column, following: Column, found: Column) -> Column:
    """What a cell should hold: a currency column that of the amount after it."""
    said = lambda label: L.filled(F.element_at(found, F.lit(label)))
    money = F.lit("")
    for h in MONEY:
        money = F.when(following == h, L.currency(said(TAKEN[h][0]))).otherwise(money)
    out = F.when(header == "Currency", money)
    for h, (label, how) in TAKEN.items():
        out = out.when(header == h, how(said(label)))
    return F.btrim(out.otherwise(L.filled(F.element_at(found, header))))


def last_rows(sheet: DataFrame) -> DataFrame:
    """The sheet with one row a name. Where sheets number their rows (row_no), a name
    that several rows have keeps the last one, as a later row replaces an earlier."""
    if "row_no" not in sheet.columns:
        return sheet
    last = sheet.groupBy("name").agg(F.max("row_no").alias("row_no"))
    return sheet.join(last, ["name", "row_no"], "left_semi").drop("row_no")


def matched(expected: DataFrame, sheet: DataFrame) -> DataFrame:
    """name, found, row (a table row: col_no, header, value), cells (with want and
    got): letters and rows side by side, null where one is absent. Of several rows
    of a name the last counts."""
    sheet = last_rows(sheet)
    row = F.array_sort(F.collect_list(F.struct("col_no", "header", L.filled(F.col("value")).alias("value"))))
    t = expected.join(sheet.groupBy("name").agg(row.alias("row")), "name", "full")
    following = lambda i: F.coalesce(F.get("row", i + 1)["header"], F.lit(""))
    cell = lambda c, i: F.struct(c["col_no"].alias("col_no"), c["header"].alias("header"), expected_value(c["header"], following(i), F.col("found")).alias("want"), F.btrim(c["value"]).alias("got"))
    cells = F.when(F.col("found").isNotNull(), F.filter(F.transform("row", cell), lambda c: c["header"] != SOURCE))
    return t.select("name", "found", "row", cells.alias("cells"))


def compared(expected: DataFrame, sheet: DataFrame) -> DataFrame:
    """name, col_no, header, want, got of each cell of letters in both."""
    return matched(expected, sheet).select("name", F.inline("cells"))


def differences(cells: DataFrame, samples: int = 3) -> DataFrame:
    """header, n, header_no, place, name, want, got: headers with most differences
    first (of equal ones the first seen), with their first few. The cells that differ
    are written once, so that letters and sheet are read once."""
    t = kept(cells.where("want <> got").select("header", "name", "col_no", "want", "got"))
    counts = t.groupBy("header").agg(F.count("*").alias("n"), F.min(F.struct("name", "col_no")).alias("first"))
    counts = running(counts.withColumn("less", -F.col("n")), "less", {"header_no": F.lit(1).cast("long")}, ties=("first",)).drop("less")
    few = t.withColumn("place", F.row_number().over(Window.partitionBy("header").orderBy("name", "col_no"))).where(F.col("place") <= samples)
    return few.join(counts, "header").select("header", "n", "header_no", "place", "name", "want", "got")


def missing(expected: DataFrame, sheet: DataFrame) -> DataFrame:
    """Names of letters to us that the sheet lacks."""
    return expected.select("name").join(sheet.select("name").distinct(), "name", "left_anti")


def extra(expected: DataFrame, sheet: DataFrame) -> DataFrame:
    """Names in the sheet of which there is no letter to us."""
    return sheet.select("name").distinct().join(expected.select("name"), "name", "left_anti")


def first_names(names: DataFrame, most: int = 10) -> DataFrame:
    return names.orderBy("name").limit(most)


def pair_ratio(row: Column) -> Column:
    """The share's percentage of the nett amount in a table row."""
    of = lambda h: F.get(F.filter(row, lambda c: c["header"] == h), F.lit(0))["value"]
    return L.ratio(of("Your Share on Nett Loss"), of("Definite Claim Amount"))


def ratios(sheet: DataFrame) -> DataFrame:
    """name, pct, odd of the rows that have both amounts."""
    key = [c for c in ("name", "row_no") if c in sheet.columns]
    # Of equal headers the first place counts; the ratio test looks at every row of the sheet.
    t = sheet.where(F.col("header").isin("Your Share on Nett Loss", "Definite Claim Amount")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "header", "value"))), lambda c: F.struct(c["header"].alias("header"), c["value"].alias("value"))).alias("row"))
    return t.select("name", pair_ratio(F.col("row")).alias("pct")).where("pct is not null").withColumn("odd", odd_ratio(F.col("pct")))


def verdict(expected: DataFrame, sheet: DataFrame) -> DataFrame:
    """One row: letters, rows_, missing, extra, compared, differing, odd, clean.
    Letters and sheet are read once."""
    t = matched(expected, sheet).withColumn("pct", pair_ratio(F.col("row")))
    letter, row = F.col("found").isNotNull(), F.col("row").isNotNull()
    total = lambda cells: F.coalesce(F.sum(F.size(cells).cast("long")), F.lit(0)).cast("long")
    cells = F.coalesce("cells", F.array().cast("array<struct<col_no:int,header:string,want:string,got:string>>"))
    out = t.agg(
        F.count_if(letter).alias("letters"), F.count_if(row).alias("rows_"), F.count_if(letter & ~row).alias("missing"), F.count_if(row & ~letter).alias("extra"),
        total(cells).alias("compared"), total(F.filter(cells, lambda c: c["want"] != c["got"])).alias("differing"), F.count_if(F.coalesce(odd_ratio(F.col("pct")), F.lit(False))).alias("odd"),
    )
    return out.withColumn("clean", F.expr("missing + extra + differing + odd = 0"))
