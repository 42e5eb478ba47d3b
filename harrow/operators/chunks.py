"""Token windows over long texts, scores of windows and their combination."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.measures import share
from harrow.functions.normalize import service

WINDOW, OVERLAP = 510, 50
LEAST_TOKENS, SPECIAL_TOKENS = 80, 2


def windows(count: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """The windows (chunk_index, start, end, token_count, effective_token_count) over ``count`` tokens."""
    step = size - overlap
    k = F.when(count <= size, 1).otherwise(F.ceil((count - overlap) / step)).cast("int")

    def window(i: Column) -> Column:
        start = i * step
        end = F.least(start + size, count)
        fresh = F.when(i == 0, end).otherwise(end - (start + overlap))  # the window before ended there
        return F.struct(i.alias("chunk_index"), start.alias("start"), end.alias("end"), (end - start).alias("token_count"), fresh.alias("effective_token_count"))

    return F.transform(F.sequence(F.lit(0), k - 1), window)


def _combined(sums: DataFrame, keys: list[str]) -> DataFrame:
    fake, real = (F.try_divide(F.col(c), F.col("fake") + F.col("real")) for c in ("fake", "real"))
    more = [c for c in sums.columns if c not in (*keys, "chunk_count", "total_token_count", "fake", "real")]
    out = sums.select(*keys, "chunk_count", "total_token_count", F.round(real, 6).alias("real_probability"), F.round(fake, 6).alias("fake_probability"), *more)
    label = (F.col("fake_probability") > F.col("real_probability")).cast("int")
    return out.withColumns({"label_id": label, "label": F.when(label == 1, "fake").when(label == 0, "real"), "confidence": F.greatest("real_probability", "fake_probability"), "is_chunked": F.col("chunk_count") > 1})


def _sums(probability: str, weight: str) -> list[Column]:
    p, w = F.col(probability), F.col(weight)
    return [F.sum(w).alias("total_token_count"), share(F.sum(p * w), F.sum(w)).alias("fake"), share(F.sum((1 - p) * w), F.sum(w)).alias("real")]


def combined(chunks: DataFrame, doc: str, probability: str = "fake_probability", weight: str = "effective_token_count") -> DataFrame:
    """Weighted mean of the windows' probabilities, renormalized, and the label: fake if strictly likelier."""
    return _combined(chunks.groupBy(doc).agg(F.count("*").alias("chunk_count"), *_sums(probability, weight)), [doc])


def scored_requests(df: DataFrame, doc: str, text: str, scorer: Callable[[Column], Column]) -> DataFrame:
    """What the service answers for each text: its status and, if accepted, label, probabilities and windows.

    ``scorer`` maps a column of window texts to the probability of fake; a refused
    text comes to it as one null, which has no score. White-space words stand for
    tokens. Texts are cleaned, cut and scored in one pass, and only windows' numbers
    are shuffled; rows of one id and status are one request.
    """
    cleaned = df.select(doc, service(text).alias("s")).select(doc, "s.text", "s.status")
    words = F.split("text", " ")
    tokens = F.size(words) + SPECIAL_TOKENS
    status = F.when((F.col("status") == "ok") & (tokens < LEAST_TOKENS), "too_few_tokens").otherwise(F.col("status"))
    gated = cleaned.select(doc, words.alias("words"), status.alias("status"))
    cut = gated.select(doc, "status", "words", F.explode_outer(F.when(F.col("status") == "ok", windows(F.size("words")))).alias("w"))
    part = F.when(F.col("w").isNotNull(), F.array_join(F.slice("words", F.col("w.start") + 1, F.col("w.token_count")), " "))
    scored = cut.select(doc, "status", "w.*", part.alias("chunk_text")).withColumn("fake_probability", scorer(F.col("chunk_text"))).drop("chunk_text")
    fields = ["chunk_index", "token_count", "effective_token_count", "fake_probability"]
    listed = F.array_sort(F.collect_list(F.when(F.col("chunk_index").isNotNull(), F.struct(*fields))))
    sums = scored.groupBy(doc, "status").agg(F.nullif(F.count("chunk_index"), F.lit(0)).alias("chunk_count"), *_sums("fake_probability", "effective_token_count"), listed.alias("chunks"))
    out = _combined(sums.withColumn("chunks", F.when(F.size("chunks") > 0, F.col("chunks"))), [doc, "status"])
    ok = F.col("status") == "ok"
    return out.withColumns({c: F.when(ok, F.col(c)) for c in out.columns if c not in (doc, "status")})


def batch_scorer(load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 16) -> Callable[[Column], Column]:
    """A scorer from a model that is loaded once in each worker and fed in batches."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            some = texts.dropna()
            values = some.tolist()
            found = pd.Series([p for at in range(0, len(values), batch) for p in model(values[at : at + batch])], index=some.index, dtype="float64")
            yield found.reindex(texts.index)

    return score
