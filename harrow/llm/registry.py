"""The training-data queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import chat, chosenpath, html, lattice, mixing, packing, suffix, tokenfiles, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix": suffix.op1_suffix,
    "op2_packing": packing.op2_packing,
    "op3_chat": chat.op3_chat,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_lattice": lattice.op5_lattice,
    "op6_chosen_path": chosenpath.op6_chosen_path,
    "op7_html": html.op7_html,
    "op8_mixing": mixing.op8_mixing,
    "op9_top_k": topk.op9_top_k,
    "op10_toxicity": toxicity.op10_toxicity,
}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline

SQL: dict[str, str] = {"op3_chat": chat.OP3_SQL, "op8_mixing": mixing.OP8_SQL, "op9_top_k": topk.OP9_SQL}
