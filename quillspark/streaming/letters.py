"""Letters as they arrive: pairs of each page from a stream of whole pages.

Letters usually come as a batch; this is the same extraction for pages that come
as rows with all their lines, so no state is kept between rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.extraction import extract_pairs


def write_pairs(pages: DataFrame, folder: str, checkpoint: str, bulleted: bool = False):
    """pages: a stream with doc_id, page_no, lines array<string>. Each micro-batch's
    pairs are appended to a Parquet folder; a repeated batch replaces its own part."""

    def one(batch: DataFrame, batch_id: int) -> None:
        lines = batch.selectExpr("doc_id", "page_no", "posexplode(lines) as (line_no, text)")
        extract_pairs(lines, bulleted).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
