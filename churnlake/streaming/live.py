"""Sentiment of messages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from churnlake.functions.text import clean_tweet
from churnlake.operators.sentiment import valence


def score_messages(stream: DataFrame, doc: str, text: str, lexicon: DataFrame, out: str, state: str,
                   available_now: bool = True, **rules) -> StreamingQuery:
    """Clean and score each micro-batch with the batch operators.

    A message's score depends on that message alone, so no state is kept. A batch
    writes to a folder of its own and replaces it when it is repeated after a
    failure; the stream's progress lives in ``state``.
    """

    def write(batch: DataFrame, number: int) -> None:
        cleaned = batch.select(doc, clean_tweet(F.col(text)).alias(text))
        valence(cleaned, doc, text, lexicon, **rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
