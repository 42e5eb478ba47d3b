"""Required columns, column look-up, label domains, constant columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIFIED = (
    "record_id", "dataset_name", "task_name", "text_type", "title_raw", "content_raw", "text_raw", "text_basic", "text_destyled", "label_original", "label_standard",
    "source", "url", "published_date", "cleaning_flags", "duplicate_group_id", "split_role",
)
#: Rows that decide which column holds the text when no name does.
SAMPLE_ROWS = 2000


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """``df``, or a ``ValueError`` that lists what it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def normalized_name(name: str, joint: str = "") -> str:
    """A column name without marks and case, letters and digits only."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.replace("ı", "i")) if unicodedata.category(c) != "Mn").casefold()
    return re.sub(r"[^a-z0-9]+", joint, plain).strip(joint or None)


def find_column(columns: Iterable[str], candidates: Iterable[str], partial: bool = False) -> str | None:
    """The first column that a candidate names exactly; with ``partial``, else one that contains it."""
    names = {normalized_name(c): c for c in reversed(list(columns))}
    wanted = [normalized_name(c) for c in candidates]
    exact = next((names[w] for w in wanted if w in names), None)
    if exact or not partial:
        return exact
    return next((c for w in wanted for n, c in reversed(names.items()) if w in n), None)


def longest_text_column(df: DataFrame, excluded: Iterable[str] = ()) -> str | None:
    """The string column with the greatest mean length in a sample."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in set(excluded)]
    if not names:
        return None
    row = df.limit(SAMPLE_ROWS).agg(*[F.coalesce(F.avg(F.length(F.trim(c))), F.lit(0.0)).alias(c) for c in names]).first()
    return max(names, key=lambda c: row[c])


def detect_schema(df: DataFrame, families: dict[str, tuple[str, ...]], text_family: str = "text") -> dict[str, str | None]:
    """Which column plays each part; the longest text column if none is named for it."""
    found = {family: find_column(df.columns, names, partial=True) for family, names in families.items()}
    if not found.get(text_family):
        found[text_family] = longest_text_column(df, [c for c in found.values() if c])
    return found


def check_domain(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """``df``, or a ``ValueError`` with some of the values outside of ``allowed``."""
    odd = df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(column).distinct().limit(20).collect()
    if odd:
        raise ValueError(f"{column} holds {sorted(str(r[0]) for r in odd)}")
    return df


def with_constants(df: DataFrame, **values: object) -> DataFrame:
    """Columns of one value each."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def prefixed(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    """All columns but some renamed with a prefix."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in set(keep)})


def aligned_union(*frames: DataFrame) -> DataFrame:
    """All rows of frames whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def schema_audit(df: DataFrame, required: Iterable[str] = UNIFIED, id_col: str = "record_id") -> DataFrame:
    """(rows, distinct ids, repeated ids, empty texts) of a unified frame that has all its columns."""
    require_columns(df, required)
    return df.agg(
        F.count("*").alias("row_count"), F.count_distinct(id_col).alias("distinct_ids"), (F.count(id_col) - F.count_distinct(id_col)).alias("repeated_ids"),
        F.count_if(F.trim(F.coalesce("text_basic", F.lit(""))) == "").alias("empty_texts"), F.count_if(F.col("label_standard").isNull()).alias("null_labels"),
    )
