"""Files of letters: listings, archives, and pages where a decoder is installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.naming import unique_names
from ..operators.scan import running
from .shared import kept

# Limits of a batch.
MOST_FILES = 250
MOST_PDF, MOST_ZIP, MOST_TOTAL, MOST_UNPACKED = 15 << 20, 200 << 20, 400 << 20, 600 << 20


def listed(spark: SparkSession, folder: str, pattern: str = "*.pdf", content: bool = False) -> DataFrame:
    """path, name, size (and content) of the files below a folder, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    columns = ["path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")]
    return files.select(*columns, *(["content"] if content else [])).orderBy("path")


def kind_of(name: Column) -> Column:
    """pdf, zip or null."""
    lowered = F.lower(name)
    return F.when(lowered.endswith(".pdf"), "pdf").when(lowered.endswith(".zip"), "zip")


def admission(files: DataFrame) -> DataFrame:
    """Of files (seq, name, size) those of the two kinds, with place (1, 2, ... in the
    order of seq), total (bytes up to and with this one), read_seq and error.

    A PDF of a repeated name overwrites the one before, and both stay listed: read_seq
    is the upload whose bytes the name holds in the end. error says which limit
    a file breaks by itself, or from which one on the request is too large; a request
    with an error is refused as a whole. seq is a number of its own for each row (rows
    that share one come in the order of name and size); null sizes count as 0."""
    t = files.select("seq", F.col("name"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), kind_of(F.col("name")).alias("kind")).where("kind is not null")
    t = running(t, "seq", {"place": F.lit(1).cast("long"), "total": F.col("size")}, ties=("name", "size"))
    last = t.where("kind = 'pdf'").groupBy("name").agg(F.max("seq").alias("last"))
    error = F.when((F.col("kind") == "pdf") & (F.col("size") > MOST_PDF), "file too large").when((F.col("kind") == "zip") & (F.col("size") > MOST_ZIP), "archive too large").when(F.col("total") > MOST_TOTAL, "batch too large")
    read = F.when(F.col("kind") == "pdf", F.col("last")).otherwise(F.col("seq"))
    return t.join(last, "name", "left").select("seq", "name", "size", "kind", "place", "total", read.alias("read_seq"), error.alias("error"))


def accepted(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Of files (seq, name, size): PDF and ZIP within their limits, the first
    `most`, with error for those over a limit. Arrival order is seq."""
    return admission(files).where(F.col("place") <= most).select("seq", "name", "size", "error")


def members(archives: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """archive, at, name, size, content, error of the PDFs inside archives (path,
    content), as they are named there without folders. Folders and dot-files are
    skipped; one member's bytes are held at a time beside its archive's."""
    columns = ["archive", "at", "name", "size", "content", "error"]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, raw in zip(frame["path"], frame["content"]):
                at = total = 0
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        for info in z.infolist():
                            name = info.filename.replace("\\", "/").rsplit("/", 1)[-1]
                            if info.is_dir() or name.startswith(".") or not name.lower().endswith(".pdf"):
                                continue
                            if at == most:
                                break
                            total += info.file_size
                            error = "file too large" if info.file_size > MOST_PDF else "archive too large" if total > MOST_UNPACKED else None
                            yield pd.DataFrame([(path, at, name, info.file_size, None if error else z.read(info), error)], columns=columns)
                            at += 1
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(path, 0, None, 0, None, "not an archive")], columns=columns)

    return archives.select("path", "content").mapInPandas(expand, "archive string, at long, name string, size long, content binary, error string")


def unpacked(archives: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """archive, seq, name, size, content, error: members of archives in one folder,
    archives in the order of their paths; a taken name gets the smallest free number.
    Names and places are read many times, so members are written once: archives are
    opened once, and what looks at names doesn't read contents."""
    rows = kept(members(archives, most))
    order = running(rows.select("archive").distinct().withColumn("crc", F.lit(0)), "crc", {"no": F.lit(1).cast("long")}, ties=("archive",)).select("archive", "no")
    placed = rows.join(order, "archive").withColumn("seq", F.col("no") * (most + 1) + F.col("at"))
    named = unique_names(kept(placed.select("seq", "name")))
    return placed.join(named.select("seq", "own"), "seq").select("archive", F.col("at").alias("seq"), F.col("own").alias("name"), "size", "content", "error")


def listing(uploads: DataFrame, inside: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """place, seq, at, name, read_seq: the batch's files in order, the first `most`.

    uploads: seq, name, size; inside (members of uploaded archives): seq (of the
    archive), at (0, 1, ... below 2^20), name. A PDF keeps its name, a member whose
    name is taken at its turn gets a number. read_seq is the upload whose bytes a name
    holds: that of the last PDF of this name, else the member's own archive."""
    direct = admission(uploads).where("kind = 'pdf'").select("seq", F.lit(0).cast("long").alias("at"), "name", "read_seq", F.lit(True).alias("fixed"))
    packed = inside.where("name is not null").select("seq", F.col("at").cast("long").alias("at"), "name", F.col("seq").alias("read_seq"), F.lit(False).alias("fixed"))
    rows = direct.unionByName(packed).withColumn("turn", F.col("seq") * (1 << 20) + F.col("at"))
    named = unique_names(rows.select(F.col("turn").alias("seq"), "name", "fixed")).select(F.col("seq").alias("turn"), "own")
    rows = rows.join(named, "turn")
    over = rows.where("fixed").groupBy("own").agg(F.max("seq").alias("over"))
    placed = running(rows.join(over, "own", "left"), "turn", {"place": F.lit(1).cast("long")})
    later = ~F.col("fixed") & (F.col("over") > F.col("seq"))
    return placed.where(F.col("place") <= most).select("place", "seq", "at", F.col("own").alias("name"), F.when(later, F.col("over")).otherwise(F.col("read_seq")).alias("read_seq"))


def pdf_words(files: DataFrame) -> DataFrame:
    """doc_id (the path), page_no, x, y, word, error of PDFs (path, content), where
    PyMuPDF is installed on the executors; a file that can't be read gives one row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for frame in batches:
            for path, raw in zip(frame["path"], frame["content"]):
                try:
                    with fitz.open(stream=raw, filetype="pdf") as pdf:
                        rows = [(path, n, w[0], w[1], w[4], None) for n, page in enumerate(pdf, 1) for w in page.get_text("words")]
                except Exception as e:  # any broken file is reported, not raised
                    rows = [(path, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["doc_id", "page_no", "x", "y", "word", "error"])

    return files.select("path", "content").mapInPandas(read, "doc_id string, page_no int, x double, y double, word string, error string")


def with_recognised(lines: DataFrame, recognised: DataFrame) -> DataFrame:
    """Lines (doc_id, page_no, line_no, text) with from_ocr: pages that were recognised
    from images have the recognised lines (of the same columns) in place of the
    printed ones. A page that recognised has no row of stays as printed; one that it
    gives only blank or null lines is recognised as blank."""
    pages = recognised.select("doc_id", "page_no").distinct()
    columns = ["doc_id", "page_no", "line_no", "text"]
    printed = lines.select(columns).join(pages, ["doc_id", "page_no"], "left_anti").withColumn("from_ocr", F.lit(False))
    return printed.unionByName(recognised.select(columns).withColumn("from_ocr", F.lit(True)))
