"""Exact top-k by integer inner product, as a Voronoi kNN join.

A vector x is lifted by one coordinate sqrt(M - |x|^2), M the largest squared norm,
and a query by 0; then the k largest inner products are the k nearest lifted
vectors. Data and queries are assigned to the cells of a few pivots. From each
cell's radius and histogram of distances follows, for each query cell, a distance
within which k rows surely lie; a row goes to a query group only if the triangle
inequality allows it within that distance of one of the group's cells. Groups are
solved in blocks of queries against blocks of rows, and the blocks' lists merged.

Edge cases. A vector that is null, empty or holds a null or non-finite component
takes no part, nor does a null id; vectors are compared only with vectors of their
own length; repeated rows are rows of their own, as queries and as candidates, and
only a row itself is no candidate of its query; with fewer than k rows all are
returned; an empty table gives an empty result; other columns are ignored. Scores
are exact as long as they fit 64 bits.

Rows are copied to the query groups that may need them and dealt there over as many
blocks as the group's rows fill; the group's queries go to those blocks alone.
Where the bounds rule nothing out, that is every block: the work of brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.common import staged, table

K = 10
QUERY_MODULO = 100
FACTOR = 1024
#: Pivots for each vector length grow with the root of its rows between these; the driver sees them and their cells' summaries only.
LEAST_PIVOTS, MOST_PIVOTS = 32, 1024
#: Steps of a cell's histogram of distances.
STEPS = 64
QUERY_BLOCK, DATA_BLOCK = 2048, 8192
#: Slack for rounding in the distances, relative to the largest norm.
_EPS = 1e-9


def pivots_for(n: int) -> int:
    """How many pivots ``n`` rows get."""
    return max(LEAST_PIVOTS, min(MOST_PIVOTS, int(np.sqrt(n))))


def _lifted(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))
    return np.concatenate([x, extra[:, None]], axis=1)


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _assigned(frames: Iterator[pd.DataFrame], pivots: dict[int, np.ndarray], tops: dict[int, float]) -> Iterator[pd.DataFrame]:
    """Cell and histogram step of each row, as data and as a query."""
    for frame in frames:
        for dim in frame["dim"].unique():
            some = frame[frame["dim"] == dim]
            p, top = pivots[int(dim)], tops[int(dim)]
            x = _matrix(some["v"])
            width = 2.0 * np.sqrt(top) / STEPS + 1e-12
            for is_query in (False, True):
                rows = some[some["is_query"]] if is_query else some
                if len(rows):
                    far = _far(_lifted(x[some["is_query"].to_numpy()] if is_query else x, top, is_query), p)
                    cell = far.argmin(axis=1)
                    step = np.minimum((far[np.arange(len(far)), cell] / width).astype(np.int64), STEPS * 4)
                    yield pd.DataFrame({"key": rows["key"], "dim": rows["dim"], "query": is_query, "cell": cell, "step": step})


def query_groups(summary: pd.DataFrame, pivots: np.ndarray, top: float, k: int) -> tuple[list[list[int]], np.ndarray]:
    """Groups of query cells, and for each cell how far from its pivot a needed row may be."""
    width = 2.0 * np.sqrt(top) / STEPS + 1e-12
    slack = _EPS * (np.sqrt(top) + 1.0)
    between = _far(pivots, pivots)
    data, asked = summary[~summary["query"]], summary[summary["query"]]
    reach = np.full(len(pivots), -1.0)
    cells = sorted(asked["cell"].unique())
    for i in cells:
        radius = (asked.loc[asked["cell"] == i, "step"].max() + 1) * width
        bound = radius + between[i, data["cell"].to_numpy()] + (data["step"].to_numpy() + 1) * width
        order = np.argsort(bound)
        have = np.cumsum(data["n"].to_numpy()[order])
        enough = np.searchsorted(have, k + 1)  # its own row may be among them
        theta = bound[order[enough]] if enough < len(order) else np.inf
        reach[i] = theta + radius + slack
    groups: list[list[int]] = []
    size = 0
    counts = asked.groupby("cell")["n"].sum()
    left, at = set(cells), cells[0] if cells else None
    while left:  # a chain of near cells, cut where a block of queries is full
        n = int(counts[at])
        if not groups or size + n > QUERY_BLOCK:
            groups.append([])
            size = 0
        groups[-1].append(int(at))
        size += n
        left.discard(at)
        if left:
            at = min(left, key=lambda c: between[at, c])
    return groups, reach


def _needed(frames: Iterator[pd.DataFrame], plan: dict) -> Iterator[pd.DataFrame]:
    """The query groups that each row may matter to."""
    for frame in frames:
        for dim in frame["dim"].unique():
            some = frame[frame["dim"] == dim]
            pivots, top, groups, reach = plan[int(dim)]
            far = _far(_lifted(_matrix(some["v"]), top, False), pivots)
            near = far <= reach[None, :]
            wanted = [np.flatnonzero(row) for row in np.stack([near[:, g].any(axis=1) for g in groups], axis=1)] if groups else [[]] * len(some)
            yield pd.DataFrame({"key": some["key"], "dim": some["dim"], "groups": [list(map(int, g)) for g in wanted]})


def _solved(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of one block of rows for each of one block of queries."""
    asked = frame["asks"].to_numpy()
    q, d = frame[asked], frame[~asked]
    empty = pd.DataFrame({"qkey": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    if not len(q) or not len(d):
        return empty
    ids, keys = d["vec_id"].to_numpy(), d["key"].to_numpy()
    a, b = np.array(q["v"].tolist(), np.int64), np.array(d["v"].tolist(), np.int64)
    exact = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53
    if exact:
        a, b = a.astype(np.float64), b.astype(np.float64)
    out = []
    for at in range(0, len(q), 256):
        scores = (a[at : at + 256] @ b.T).astype(np.int64)
        qk = q["key"].to_numpy()[at : at + 256]
        take = min(len(d), k + 1)  # its own row may be among them
        floor = np.partition(scores, len(d) - take, axis=1)[:, len(d) - take]
        for r, (score, least) in enumerate(zip(scores, floor, strict=True)):
            c = np.flatnonzero((score >= least) & (keys != qk[r]))
            c = c[np.lexsort((ids[c], -score[c]))][:k]
            out.append(pd.DataFrame({"qkey": qk[r], "query_id": q["vec_id"].to_numpy()[at + r], "vec_id": ids[c], "score": score[c]}))
    return pd.concat(out) if out else empty


def top_k(vectors: DataFrame, k: int = K, modulo: int = QUERY_MODULO, factor: int = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id ``modulo`` divides."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.size(x) > 0
    fine = fine & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), fine.alias("fine")).where("fine and vec_id is not null")
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * factor).cast("long")).alias("v"))
    # The staged table fixes the keys, one of its own for each row.
    rows = staged(rows.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("key"), (F.pmod("vec_id", F.lit(modulo)) == 0).alias("is_query")), "scaled")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    facts = {r["dim"]: r for r in rows.groupBy("dim").agg(F.max(norm).alias("top"), F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(d, pivots_for(f["n"])) for d, f in facts.items()], "dim int, _most int"))
    first = Window.partitionBy("dim", "_deal").orderBy("_at")
    few = rows.select("dim", "v", F.xxhash64("vec_id", "v").alias("_at"), F.pmod(F.xxhash64("key"), F.lit(64)).alias("_deal")).join(wanted, "dim")
    few = few.withColumn("_r", F.row_number().over(first)).where("_r <= _most")
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("_at")))).where("_r <= _most")
    chosen: dict[int, list] = {}
    for r in few.select("dim", "v").distinct().collect():
        chosen.setdefault(r["dim"], []).append(r["v"])
    tops = {d: float(f["top"]) * (1 + 1e-12) for d, f in facts.items()}
    pivots = {d: _lifted(np.array(v, np.float64), tops[d], False) for d, v in chosen.items()}
    summary = rows.mapInPandas(lambda f: _assigned(f, pivots, tops), "key long, dim int, query boolean, cell int, step int")
    assigned = staged(summary, "cells")
    seen = assigned.groupBy("dim", "query", "cell", "step").agg(F.count("*").alias("n")).toPandas()
    plan = {d: (pivots[d], tops[d], *query_groups(seen[seen["dim"] == d], pivots[d], tops[d], k)) for d in pivots}

    homes = [(d, c, g, -(-int(seen.loc[(seen["dim"] == d) & seen["query"] & (seen["cell"] == c), "n"].sum()) // QUERY_BLOCK)) for d, p in plan.items() for g, cells in enumerate(p[2]) for c in cells]
    home = F.broadcast(spark.createDataFrame([h[:3] for h in homes], "dim int, cell int, g int"))  # as many rows as pivots, at most
    chunks: dict[tuple[int, int], int] = {}
    for d, _, g, n in homes:
        chunks[d, g] = max(n, chunks.get((d, g), 1))
    needed = staged(rows.mapInPandas(lambda f: _needed(f, plan), "key long, dim int, groups array<int>").where(F.size("groups") > 0), "needed")
    counts = needed.select("dim", F.explode("groups").alias("g")).groupBy("dim", "g").agg(F.count("*").alias("n")).collect()
    shape = [(r["dim"], r["g"], chunks[r["dim"], r["g"]], -(-r["n"] // DATA_BLOCK)) for r in counts]
    shape = F.broadcast(spark.createDataFrame(shape, "dim int, g int, chunks int, blocks int"))

    queries = assigned.where("query").join(home, ["dim", "cell"]).join(shape, ["dim", "g"])
    queries = queries.select("key", "g", "blocks", F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"))
    queries = rows.where("is_query").join(queries, "key")
    queries = queries.select("dim", "g", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "vec_id", "v", F.lit(True).alias("asks"))
    data = needed.select("key", "dim", F.explode("groups").alias("g")).join(shape, ["dim", "g"])
    data = data.select("key", "g", "chunks", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int").alias("block"))
    data = rows.join(data, "key").select("dim", "g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "key", "vec_id", "v", F.lit(False).alias("asks"))
    found = queries.unionByName(data).groupBy("dim", "g", "chunk", "block").applyInPandas(lambda f: _solved(f, k), "qkey long, query_id long, vec_id long, score long")
    best = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for each hundredth of ``embeddings``."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.r <> d.r
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
