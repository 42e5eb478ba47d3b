"""Writers: tables, split families, reports for people, models."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.reports import metrics_table

#: Rows that a report for people may have.
REPORT_ROWS = 10_000


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, over what was there."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited files with a header, written by all executors; white space at the ends of texts stays."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _put(spark, path: str, data: bytes) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _few(df: DataFrame, rows: int):
    out = df.limit(rows + 1).toPandas()
    if len(out) > rows:
        raise ValueError(f"a report takes {rows} rows at most; write a table")
    return out


def write_report_csv(df: DataFrame, path: str, rows: int = REPORT_ROWS) -> None:
    """One small file with a byte order mark, for spreadsheets."""
    _put(df.sparkSession, path, _few(df, rows).to_csv(index=False).encode("utf-8-sig"))


def write_json(df: DataFrame, path: str) -> None:
    """A one-row frame as a JSON document."""
    row = df.select(F.to_json(F.struct("*")).alias("j")).first()
    _put(df.sparkSession, path, json.dumps(json.loads(row["j"]), ensure_ascii=False, indent=2).encode())


def write_metrics(row: DataFrame, path: str) -> None:
    """(metric, value) lines of a one-row frame."""
    write_report_csv(metrics_table(row), path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split."""
    write_table(df, path, [split])


def diff_page(df: DataFrame, title: str, rows: int = REPORT_ROWS) -> str:
    """A page of text differences: id, band, what went and what came, contexts."""
    lines = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{_html.escape(title)}</title><style>del{{background:#fdd}}ins{{background:#dfd}}</style></head><body><h1>{_html.escape(title)}</h1>"]
    for r in _few(df, rows).to_dict("records"):
        lines.append(f"<section><h2>{_html.escape(str(r['pair_id']))} ({_html.escape(str(r.get('edit_size_band', '')))})</h2>")
        lines += [f"<p><del>{_html.escape(x)}</del></p>" for x in r["removed"]] + [f"<p><ins>{_html.escape(x)}</ins></p>" for x in r["added"]] + [f"<p>{_html.escape(x)}</p>" for x in r["contexts"]]
        lines.append("</section>")
    return "\n".join([*lines, "</body></html>"])


def write_diff_page(df: DataFrame, path: str, title: str) -> None:
    _put(df.sparkSession, path, diff_page(df, title).encode())


def write_summary(df: DataFrame, path: str, title: str) -> None:
    """Plain text: a heading, then a small frame's rows."""
    _put(df.sparkSession, path, f"{title}\n{'=' * len(title)}\n\n{_few(df, REPORT_ROWS).to_string(index=False)}\n".encode())


def write_model(model, path: str) -> None:
    """A fitted model or pipeline, over what was there."""
    model.write().overwrite().save(path)
