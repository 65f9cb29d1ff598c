"""Profiles: which labels of which company's letters become which columns.

Two small dimensions hold them as rows: rules (profile, rule, value) and columns
(profile, header, label, take). A profile is the rows of one key.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# The companies' own labels, titles and names, as their letters print
# them. Headings and names are compared in lower case.
RULES = (
    ("jrp", "name", "JRP"),
    ("jrp", "state", "in use"),
    ("jrp", "mark", "Ref No"),
    ("jrp", "mark", "Risk Cover"),
    ("jrp", "mark", "Appointed Adjuster"),
    ("jrp", "title", "definite loss advice"),
    ("jrp", "title", "preliminary loss advice"),
    ("jrp", "heading of a page to skip", "debit note"),
    ("jrp", "heading of a page to skip", "credit note"),
    ("jrp", "label left out", "Definite Claim Amount"),
    ("jrp", "label left out", "Deductible"),
    ("jrp", "addressee's label", "Reinsurer"),
    ("kmdastur", "name", "KMDastur"),
    ("kmdastur", "state", "in use"),
    ("kmdastur", "mark", "Name of Reinsured"),
    ("kmdastur", "mark", "Interest Insured"),
    ("kmdastur", "title", "definite loss advice"),
    ("kmdastur", "label left out", "Indemnity"),
    ("kmdastur", "label left out", "Deductible"),
    ("kmdastur", "label left out", "Kop Surat"),
    ("kmdastur", "label left out", "Definite Loss Amount Indemnity"),
    ("kmdastur", "label left out", "Definite Loss Amount Expense"),
    ("kmdastur", "label left out", "Expense"),
    ("kmdastur", "addressee's label", "Kop Surat"),
    ("kmdastur", "addressee may stand in", "the letterhead"),
    ("kmdastur", "label of the line after the title", "Definite Loss Advice"),
    ("kmdastur", "amounts may stand after", "bullets"),
    ("askrindo", "name", "Askrindo"),
    ("askrindo", "state", "draft"),
    ("askrindo", "mark", "No DLA"),
    ("askrindo", "mark", "Askrindo Share"),
    ("askrindo", "title", "definite loss advice"),
    ("askrindo", "label left out", "Loss Amount 100%"),
    ("askrindo", "label left out", "Deductible"),
    ("askrindo", "addressee's label", "Reinsurer"),
)
#: Names by which letters of every profile address us.
OUR_NAMES = ("astra buana", "asuransi astra buana", "asuransi astra")
# Of each column, in their order, the header, the label it is read from, and how it is taken.
COLUMNS = (
    ("jrp", "Ref No", "Ref No", "raw"),
    ("jrp", "Claim No", "Claim No", "raw"),
    ("jrp", "Class of Business", "Class of Business", "raw"),
    ("jrp", "Address", "Address", "raw"),
    ("jrp", "Reinsurer", "Reinsurer", "raw"),
    ("jrp", "Policy No.", "Policy No.", "raw"),
    ("jrp", "Insured Name", "Insured Name", "raw"),
    ("jrp", "Insurance Period", "Insurance Period", "raw"),
    ("jrp", "Serial No", "Serial No", "raw"),
    ("jrp", "Engine No", "Engine No", "raw"),
    ("jrp", "Risk Cover", "Risk Cover", "raw"),
    ("jrp", "Insured Interest", "Insured Interest", "text_only"),
    ("jrp", "Currency", "Total Sum Insured", "currency"),
    ("jrp", "Total Sum Insured", "Total Sum Insured", "amount"),
    ("jrp", "Date of Loss", "Date of Loss", "raw"),
    ("jrp", "Place of Loss", "Place of Loss", "raw"),
    ("jrp", "Cause of Loss", "Cause of Loss", "raw"),
    ("jrp", "Appointed Adjuster", "Appointed Adjuster", "raw"),
    ("jrp", "Currency", "Nett Amount", "currency"),
    ("jrp", "Definite Claim Amount", "Nett Amount", "amount"),
    ("jrp", "Currency", "Your Share on Nett Loss", "currency"),
    ("jrp", "Your Share on Nett Loss", "Your Share on Nett Loss", "last_amount"),
    ("jrp", "Description of Loss", "Description of Loss", "raw"),
    ("jrp", "Remarks", "Remarks", "raw"),
    ("kmdastur", "No. Reff DLA", "Definite Loss Advice", "raw"),
    ("kmdastur", "Our Reference", "Our Reference", "raw"),
    ("kmdastur", "Class of Business", "Class of Business", "raw"),
    ("kmdastur", "Type of Insurance", "Type of Insurance", "raw"),
    ("kmdastur", "Policy Number", "Policy Number", "raw"),
    ("kmdastur", "Your Reference", "Your Reference", "raw"),
    ("kmdastur", "Period of Insurance", "Period of Insurance", "raw"),
    ("kmdastur", "Name of Reinsured", "Name of Reinsured", "raw"),
    ("kmdastur", "Name of Insured", "Name of Insured", "raw"),
    ("kmdastur", "Interest Insured", "Interest Insured", "raw"),
    ("kmdastur", "Currency", "Total Sum Insured", "currency"),
    ("kmdastur", "Total Sum Insured", "Total Sum Insured", "strip_currency"),
    ("kmdastur", "Date of Loss", "Date of Loss", "raw"),
    ("kmdastur", "Cause of Loss", "Cause of Loss", "raw"),
    ("kmdastur", "Place of Loss", "Place of Loss", "raw"),
    ("kmdastur", "Description of Loss", "Description of Loss", "raw"),
    ("kmdastur", "Currency", "Nett Amount", "currency"),
    ("kmdastur", "Definite Loss Amount", "Nett Amount", "amount"),
    ("kmdastur", "Currency", "Your Share", "currency"),
    ("kmdastur", "Your Share", "Your Share", "last_amount"),
    ("kmdastur", "Remarks", "Remarks", "raw"),
    ("askrindo", "No DLA", "No DLA", "raw"),
    ("askrindo", "Class of Business", "Class of Business", "raw"),
    ("askrindo", "Type of Policy", "Type of Policy", "raw"),
    ("askrindo", "PLA No", "PLA No", "raw"),
    ("askrindo", "Reinsurer", "Reinsurer", "raw"),
    ("askrindo", "Policy No", "Policy No", "raw"),
    ("askrindo", "Insured Name", "Insured Name", "raw"),
    ("askrindo", "Insured Period", "Insured Period", "raw"),
    ("askrindo", "Currency", "Total Sum Insured", "currency"),
    ("askrindo", "Total Sum Insured", "Total Sum Insured", "amount"),
    ("askrindo", "Date of Loss", "Date of Loss", "raw"),
    ("askrindo", "Place of Loss", "Place of Loss", "raw"),
    ("askrindo", "Cause of Loss", "Cause of Loss", "raw"),
    ("askrindo", "Description of Loss", "Description of Loss", "raw"),
    ("askrindo", "Currency", "Net Amount", "currency"),
    ("askrindo", "Loss Amount 100%", "Net Amount", "amount"),
    ("askrindo", "Askrindo Share", "Askrindo Share", "raw"),
    ("askrindo", "Your Share", "Your Share", "raw"),
    ("askrindo", "Currency", "Your Share on Nett Loss", "currency"),
    ("askrindo", "Your Share on Nett Loss", "Your Share on Nett Loss", "last_amount"),
    ("askrindo", "Remarks", "Remarks", "raw"),
)


class Column(NamedTuple):
    header: str
    label: str
    take: str


@dataclass(frozen=True)
class Profile:
    """The rows of one key."""

    key: str

    def values(self, rule: str) -> tuple[str, ...]:
        return tuple(value for key, r, value in RULES if key == self.key and r == rule)

    def value(self, rule: str) -> str:
        return next(iter(self.values(rule)), "")

    @property
    def columns(self) -> tuple[Column, ...]:
        return tuple(Column(*row[1:]) for row in COLUMNS if row[0] == self.key)

    @property
    def bullets(self) -> bool:
        return bool(self.values("amounts may stand after"))

    @property
    def known_labels(self) -> tuple[str, ...]:
        """Labels that are no extra ones: those of columns and those left out."""
        return tuple(dict.fromkeys([c.label for c in self.columns] + list(self.values("label left out"))))


PROFILES = tuple(Profile(key) for key in dict.fromkeys(row[0] for row in RULES))


def in_use() -> tuple[Profile, ...]:
    return tuple(p for p in PROFILES if p.value("state") == "in use")


def by_key(key: str) -> Profile | None:
    """The profile in use of that key."""
    return next((p for p in in_use() if p.key == key), None)


def profile_table(spark: SparkSession, profiles: tuple[Profile, ...] | None = None) -> DataFrame:
    """A row a profile (those in use) with what reading its letters needs."""
    rows = [(p.key, list(p.values("title")), list(p.values("heading of a page to skip")), p.value("addressee's label"), list(OUR_NAMES), bool(p.values("addressee may stand in")), p.value("label of the line after the title")) for p in (in_use() if profiles is None else profiles)]
    return spark.createDataFrame(rows, "profile string, titles array<string>, skips array<string>, addressee string, names array<string>, letterhead boolean, reference string")


def mark_table(spark: SparkSession, profiles: tuple[Profile, ...] | None = None) -> DataFrame:
    """profile, mark of the profiles in use."""
    rows = [(p.key, m) for p in (in_use() if profiles is None else profiles) for m in p.values("mark")]
    return spark.createDataFrame(rows, "profile string, mark string")


def column_table(spark: SparkSession, profile: Profile) -> DataFrame:
    rows = [(profile.key, k, *c) for k, c in enumerate(profile.columns)]
    return spark.createDataFrame(rows, "profile string, col_no int, header string, label string, take string")
