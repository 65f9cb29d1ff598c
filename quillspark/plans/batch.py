"""The batch: from lines of letters to notices, tables and reports."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import results as R
from ..sources.profiles import Profile, by_key, mark_table, profile_table
from ..sources.shared import kept

#: Files that detection looks at first, and how many times more each time after.
FIRST_FILES, GROWTH = 16, 8


@dataclass(frozen=True)
class Batch:
    """The lazy tables of one run."""

    profile: Profile
    pairs: DataFrame
    sections: DataFrame
    chosen: DataFrame
    once: bool = False

    def stored(self) -> Batch:
        """The same batch with its choice, and where they are asked for its results
        and groups, written once; tables, notes and reports are then made from
        these and don't read letters again."""
        return replace(self, chosen=kept(self.chosen), once=True)

    @cached_property
    def results(self) -> DataFrame:
        t = R.file_results(self.chosen, self.profile)
        return kept(t) if self.once else t

    @cached_property
    def groups(self) -> DataFrame:
        t = R.grouped(self.results, self.profile)
        return kept(t) if self.once else t

    @property
    def cells(self) -> DataFrame:
        return R.cells(self.results, self.profile, self.groups)

    @property
    def tables(self) -> DataFrame:
        return R.table_rows(self.cells)

    @property
    def sheet(self) -> DataFrame:
        """Reads cells and groups several times, so from tables that are written once."""
        b = self if self.once else self.stored()
        return R.sheet_places(b.cells, b.groups)

    @property
    def note_details(self) -> DataFrame:
        return R.note_details(self.results, self.groups, self.profile)

    @property
    def notes(self) -> DataFrame:
        return R.notes(self.note_details, self.profile)

    def rejected(self) -> str:
        """Why there is no result, '' if there is one. Looks for one accepted file."""
        return R.NOTHING_READ if self.chosen.where("ok").isEmpty() else ""


def first_detection(lines: DataFrame, marks: DataFrame, errors: DataFrame | None = None, first: int = FIRST_FILES, growth: int = GROWTH) -> tuple | None:
    """doc_id and profile of the first document, in the order of doc_id, that exactly
    one profile fits; None if there is none. Files with an error are passed over.

    Ranges of the order that grow are looked at in turn: finding where a range ends
    reads ids only, and letters beyond the range of the hit aren't parsed. A range ends
    at an id that about `size` others come before: the last of a few that are told by
    their hash, so that long ranges aren't put in order whole."""
    bad = None if errors is None else errors.select("doc_id").distinct()
    told = lambda t: t if bad is None else t.join(bad, "doc_id", "left_anti")
    done, size = None, first
    while True:
        part = lines.where("doc_id is not null") if done is None else lines.where(F.col("doc_id") > F.lit(done))
        some = min(size, FIRST_FILES)
        left = part.select("doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(size // some)) == 0)
        last, n = told(left.distinct()).orderBy("doc_id").limit(some).agg(F.max("doc_id"), F.count("*")).first()
        if n == some:
            part = part.where(F.col("doc_id") <= F.lit(last))
        labels = X.document_labels(told(part), True)
        hit = R.detected(labels, marks).where("profile is not null").orderBy("doc_id").first()
        if hit:
            return hit.doc_id, hit.profile
        if n < some:
            return None
        done, size = last, size * growth


def detect(lines: DataFrame, errors: DataFrame | None = None) -> Profile | None:
    """The profile of the first document that exactly one active profile matches."""
    hit = first_detection(lines, mark_table(lines.sparkSession), errors)
    return by_key(hit[1]) if hit else None


def run(lines: DataFrame, key: str | None = None, files: DataFrame | None = None, errors: DataFrame | None = None) -> Batch:
    """lines: doc_id, page_no, line_no, text, and from_ocr where some were recognised.
    files: doc_id of all files, if some have no lines; errors: doc_id, stage, message
    of those that couldn't be opened or recognised. An unknown or missing key means
    that the profile is detected; without one the batch is rejected."""
    profile = (by_key(key) if key else None) or detect(lines, errors)
    if profile is None:
        raise ValueError("no profile, or more than one, fits these letters")
    one = profile_table(lines.sparkSession, [profile])
    found = X.sections(X.page_table(lines, profile.bullets), one)
    chosen = X.choose(X.with_files(found, files, errors), one)
    return Batch(profile, X.extract_pairs(lines, profile.bullets), found, chosen)


def pivoted(batch: Batch, group_no: int) -> DataFrame:
    """One group as a wide table: a column per cell place, named by place because
    headers repeat. The columns are those of that group, found first."""
    rows = batch.cells.where(F.col("group_no") == group_no)
    places = [r.col_no for r in rows.select("col_no").distinct().orderBy("col_no").collect()]
    return rows.groupBy("doc_id").pivot("col_no", places).agg(F.first("value"))
