"""Unbounded input: first-wins duplicates, running counters and request scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harrow.functions.hashing import sha256
from harrow.functions.normalize import key_letters, service
from harrow.operators.chunks import LEAST_TOKENS, SPECIAL_TOKENS


def distinct_texts(stream: DataFrame, text: str, time: str | None = None, delay: str = "1 day", form: bool = True) -> DataFrame:
    """A stream without texts seen before; with a time column, what is remembered is bounded by ``delay``."""
    keyed = stream.withColumn("exact_text_hash", sha256(key_letters(text, form)))
    if time:
        return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["exact_text_hash"])
    return keyed.dropDuplicates(["exact_text_hash"])


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """How often each value has come so far."""
    return stream.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def scored_stream(stream: DataFrame, text: str, scorer: Callable[[Column], Column]) -> DataFrame:
    """Each request with its status and, if accepted, its probability of fake; texts of one window."""
    s = service(text)
    tokens = F.size(F.split(s["text"], " ")) + SPECIAL_TOKENS
    status = F.when((s["status"] == "ok") & (tokens < LEAST_TOKENS), "too_few_tokens").otherwise(s["status"])
    out = stream.withColumns({"status": status, "_text": s["text"]})
    return out.withColumn("fake_probability", F.when(F.col("status") == "ok", scorer(F.col("_text")))).drop("_text")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has come, appended to a table exactly once, then the end."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
