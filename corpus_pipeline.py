"""From raw documents to packed sequences: toxicity, near duplicates, repeated passages, mix, packing.

Every stage works on all rows that its predecessor kept and all but the last return
the columns of ``documents``, further columns included, whatever their names. A
document's id may repeat after mixing, once for each copy that the mix takes.

An empty table passes every stage as one. Null texts count as empty ones and null ids
as ids; texts are read whole. What each stage makes of nulls, empty and very long
texts, ties and repeated rows stands in its docstring and, in full, in its operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import chosenpath, mixing, packing, suffix, toxicity
from harrow.llm.common import staged, table, with_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half, by a model fitted on the labels of ``docs``.

    Null and empty texts have the score of no words at all, equal texts equal scores;
    a score of exactly one half goes. Without labels for ``docs``, or with clean ones
    only, nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    low = toxicity.score_column(model)(F.col("text")) < 0.5
    return docs.where(low)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, nulls last, then of the smallest text hash.

    Null and empty texts, and those without a word, are near to nothing and stay;
    rows that repeat id and text become one.
    """
    return chosenpath.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur anywhere else; ``n_chars``, if there, is counted anew.

    No row goes: a null or short text stays (a null becomes empty), a text all of
    which repeats becomes empty. A character that a removed string cuts goes with it.
    """
    out = suffix.dedup(docs)
    return with_column(out, "n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    A null source is one of its own; a source without words has no target, and its
    documents go; rows of one id share their draw.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null or empty text is its end id alone; long texts are cut; each copy that the
    mix took is packed on its own, with its id.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages are not expressible in SQL; ``tests/llm`` holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
