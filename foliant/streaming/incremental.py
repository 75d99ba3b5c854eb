"""Verification of pages as they arrive.

Each micro-batch of new pages runs the batch plan for the same terms and appends its hits. A page is
verified once, so no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import verify
from foliant.sources.corpus import token_rows


def arrays(docs: DataFrame) -> DataFrame:
    """(pdf_page, texts, norms) of documents (doc_id, text), as the batch corpus has them."""
    rows = docs.select(F.col("doc_id").alias("pdf_page"), token_rows(F.col("text")).alias("t"))
    body = F.filter("t", lambda x: x["body"])
    return rows.select("pdf_page", F.transform("t", lambda x: x["text"]).alias("texts"), F.transform(body, lambda x: F.lower(x["text"])).alias("norms"))


def verify_stream(docs: DataFrame, terms: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that appends the hits of each batch of a streaming table (doc_id, text) to Parquet files in out, in a folder for each batch, so a repeated batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        verify.hits(arrays(batch), terms).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
