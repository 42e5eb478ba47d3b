"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected at random to two blocks of eight
dimensions and each block is decoded to its nearest points of the E8 lattice; the
nearest combinations, own cell and neighbouring ones, are the vector's keys there.
Vectors of one label that share a key are compared exactly, by cosine in double
precision. Equal vectors are compared once, as a class. In a crowded cell the rows
within half the threshold's angle of one of them, its leader, are a core: any two
of a core link by the triangle inequality, so that they are counted together and
compared with none of their own; only rows outside of the cell's main core are
compared, block by block, with all of it. So a group of near copies costs what its
rim costs, no pair is lost to a cap and none is written out.

Edge cases. Null, empty, zero and non-finite vectors, and a null label, link with
nothing; vectors of different length never link; repeated rows link with each
other; a null id takes part but is no component's id; an empty table gives an
empty result; other columns are ignored.

Recall is measured against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.cells import by_cell, first_shared, pairs
from harrow.llm.common import attach, drop_staged, staged, table
from harrow.operators.components import components

COSINE = 0.98
TABLES = 10
#: Keys of a vector in a table: its own cell and the nearest neighbouring ones.
PROBES = 4
#: Cells against the projected difference of two vectors at the threshold.
SCALE = 0.52
#: Vectors of a cell that are compared at once; larger cells are searched for cores.
CROWD = 1024
_SEED = 20_011


def e8_nearest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest E8 points (doubled, hence integers) of each row, and their squared distances.

    E8 is D8 with D8 shifted by one half. In each of the two cosets the nearest
    point is a rounding, with its worst coordinate rounded the other way if the
    sum is odd; the next ones round other bad coordinates the other way.
    """
    found, far = [], []
    for shift in (0.0, 0.5):
        base = np.rint(x - shift)
        off = x - shift - base
        other = np.where(off >= 0, 1.0, -1.0)
        gain = 1.0 - 2.0 * np.abs(off)  # what rounding a coordinate the other way adds
        worst = np.argsort(gain, axis=1)
        rows = np.arange(len(x))
        odd = base.sum(axis=1) % 2 != 0
        d0 = (off**2).sum(axis=1)

        def turned(*which: int, base=base, other=other, worst=worst, gain=gain, rows=rows, d0=d0):
            p, d = base.copy(), d0.copy()
            for w in which:
                at = worst[:, w]
                p[rows, at] += other[rows, at]
                d = d + gain[rows, at]
            return p, d

        for even_turn, odd_turn in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,)), ((0, 3), (3,))):
            pe, de = turned(*even_turn)
            po, do = turned(*odd_turn)
            found.append(2 * (np.where(odd[:, None], po, pe) + shift))
            far.append(np.where(odd, do, de))
    points, distance = np.stack(found, axis=1), np.stack(far, axis=1)
    order = np.argsort(distance, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(points, order[:, :, None], axis=1).astype(np.int64), np.take_along_axis(distance, order, axis=1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def lattice_keys(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(rows, tables * probes) keys of unit vectors, ascending, so that two rows agree on their first common one."""
    rng = np.random.default_rng(_SEED + vectors.shape[1])
    out = []
    odd = rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(tables):
        plane = rng.standard_normal((vectors.shape[1], 16)) * scale
        shift = rng.random(16) * 2
        y = vectors @ plane + shift
        (p, dp), (q, dq) = e8_nearest(y[:, :8], 3), e8_nearest(y[:, 8:], 3)
        hp = (p.astype(np.uint64) * odd[:8]).sum(axis=2, dtype=np.uint64)
        hq = (q.astype(np.uint64) * odd[8:]).sum(axis=2, dtype=np.uint64)
        keys = _mixed(_mixed(hp)[:, :, None] * np.uint64(3) + hq[:, None, :] + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64)).reshape(len(vectors), 9)
        order = np.argsort((dp[:, :, None] + dq[:, None, :]).reshape(len(vectors), 9), axis=1, kind="stable")[:, :probes]
        out.append(np.take_along_axis(keys, order, axis=1))
    return np.sort(np.concatenate(out, axis=1).view(np.int64), axis=1) if out else np.zeros((len(vectors), 0), np.int64)


def _hashed(frames: Iterator[pd.DataFrame], tables: int, probes: int, scale: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for dim in frame["dim"].unique():
            some = frame[frame["dim"] == dim]
            x = np.array(some["vec"].tolist(), np.float64).reshape(len(some), dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"rep": some["rep"], "keys": list(lattice_keys(x, tables, probes, scale))})


_CELL = ["key", "label", "dim", "a", "b"]
_PAIRS = 1 << 14


def _links(frames: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Links within blocks of cells, each counted only in the first cell where the two meet."""
    for frame in by_cell(frames, _CELL):
        for _, part in frame.groupby("dim", sort=False):
            part = part.reset_index(drop=True)
            x = np.array(part["vec"].tolist(), np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys, key = np.array(part["keys"].tolist(), np.int64), part["key"].to_numpy()
            rep, weight, core = part["rep"].to_numpy(), part["weight"].to_numpy(), part["core"].to_numpy()
            counted = np.zeros(len(part), np.int64)
            parent = list(range(len(part)))

            def root(a: int, parent=parent) -> int:
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                return a

            for every_p, every_q in pairs(part, _CELL):
                for at in range(0, len(every_p), _PAIRS):
                    p, q = every_p[at : at + _PAIRS], every_q[at : at + _PAIRS]
                    apart = core[p] != core[q]  # links within a core are counted already
                    p, q = p[apart], q[apart]
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    p, q = p[near], q[near]
                    here = first_shared(keys, p, q) == key[p]
                    p, q = p[here], q[here]
                    np.add.at(counted, p, weight[q])
                    np.add.at(counted, q, weight[p])
                    for u, v in zip(p.tolist(), q.tolist(), strict=True):
                        ru, rv = root(u), root(v)
                        if ru != rv:
                            parent[max(ru, rv)] = min(ru, rv)
            keep = counted > 0
            if keep.any():
                roots = np.fromiter((root(a) for a in range(len(part))), np.int64, len(part))
                least = pd.Series(rep).groupby(roots).transform("min").to_numpy()
                yield pd.DataFrame({"rep": rep[keep], "links": counted[keep], "to": least[keep]})


def _cores(crowded: DataFrame, points: DataFrame, cosine: float) -> DataFrame:
    """(rep, core): rows of crowded cells within half the angle of ``cosine`` of a cell's leader, the smallest such leader.

    The leaders' table has one row for each crowded cell.
    """
    leaders = crowded.groupBy("cell").agg(F.min("rep").alias("leader"))
    leaders = leaders.join(points.select(F.col("rep").alias("leader"), F.col("vec").alias("centre")), "leader")
    pairs_ = attach(crowded.join(points.select("rep", "vec"), "rep"), leaders, "cell")

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    cos = dot("vec", "centre") / F.sqrt(dot("vec", "vec") * dot("centre", "centre"))
    half = float(np.sqrt((1.0 + cosine) / 2.0)) + 1e-9  # beyond what rounding could undo
    return pairs_.where(cos >= half).groupBy("rep").agg(F.min("leader").alias("core"))


def _dealt(crowded: DataFrame, cores: DataFrame, crowd: int) -> DataFrame:
    """(rep, cell, a, b, side) of crowded cells: the rows outside of a cell's main core among themselves and against it."""
    rows = crowded.join(cores, "rep", "left").withColumn("core", F.coalesce("core", "rep"))
    parts = rows.groupBy("cell", "core").agg(F.count("*").alias("c"))
    shape = parts.groupBy("cell").agg(F.max_by("core", "c").alias("main"), F.ceil(F.max("c") / crowd).cast("int").alias("inner"), F.ceil((F.sum("c") - F.max("c")) / crowd).cast("int").alias("outer"))
    rows = attach(rows, shape, "cell")
    inside = F.col("core") == F.col("main")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.greatest(F.when(inside, F.col("inner")).otherwise(F.col("outer")), F.lit(1))).cast("int")
    rows = rows.select("rep", "cell", "inner", "outer", inside.alias("inside"), own.alias("own"))

    def cell(a: Column, b: Column, side: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), side.alias("side"))

    none = F.array().cast("array<struct<a:int,b:int,side:int>>")
    outer = F.when(F.col("outer") > 0, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.array().cast("array<int>"))
    inner = F.sequence(F.lit(0), F.col("inner") - 1)
    across = F.transform(outer, lambda o: cell(F.least("own", o), F.greatest("own", o), F.when(F.col("own") == o, 0).when(F.col("own") < o, 1).otherwise(2)))
    to_main = F.transform(inner, lambda j: cell(F.col("own"), F.col("outer") + j, F.lit(1)))
    from_main = F.transform(outer, lambda o: cell(o, F.col("outer") + F.col("own"), F.lit(2)))
    every = F.when(F.col("inside"), F.coalesce(from_main, none)).otherwise(F.concat(across, to_main))
    return rows.select("rep", "cell", F.explode(every).alias("p")).select("rep", "cell", "p.a", "p.b", "p.side")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, crowd: int = CROWD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vec", lambda v: v != 0)
    able = F.col("vec").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True))
    # -0.0 and 0.0 are one value; classes are told apart by their vector, and the staged table fixes their numbers.
    marked = rows.withColumn("_class", F.when(able, F.struct("label", F.transform("vec", lambda v: v + F.lit(0.0)).alias("v"))))
    classes = staged(
        marked.where(F.col("_class").isNotNull()).groupBy("_class").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
        .select(F.monotonically_increasing_id().alias("rep"), "_class", "least", "weight", F.size("_class.v").alias("dim")),
        "vector-classes",
    )
    points = classes.select("rep", F.col("_class.label").alias("label"), F.col("_class.v").alias("vec"), "dim", "weight")
    keyed = points.select("rep", "vec", "dim").mapInPandas(lambda f: _hashed(f, tables, probes, scale), "rep long, keys array<long>")
    keyed = staged(keyed, "vector-keys")
    cells = keyed.select("rep", F.explode("keys").alias("key")).join(points.select("rep", "label", "dim"), "rep").select("rep", F.struct("key", "label", "dim").alias("cell"))
    full = staged(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "vector-cells")
    some = cells.join(full.where(F.col("n") <= crowd).select("cell"), "cell").select("rep", "cell", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"))
    cores, within = None, None
    if full.where(F.col("n") > crowd).limit(1).count():
        crowded = staged(attach(cells, full.where(F.col("n") > crowd), "cell").where("n is not null").select("rep", "cell"), "crowded-cells")
        cores = staged(_cores(crowded, points, cosine), "vector-cores")
        totals = cores.join(points.select("rep", "weight"), "rep")
        sums = totals.groupBy("core").agg(F.sum("weight").alias("total"))
        within = attach(totals, sums, "core").select("rep", (F.col("total") - F.col("weight")).alias("links"), F.col("core").alias("to")).where("links > 0")
        some = some.unionByName(_dealt(crowded, cores, crowd))
    full_rows = some.select("rep", "cell.key", "cell.label", "cell.dim", "a", "b", "side").join(keyed, "rep").join(points.select("rep", "vec", "weight"), "rep")
    full_rows = full_rows.join(cores, "rep", "left").withColumn("core", F.coalesce("core", "rep")) if cores is not None else full_rows.withColumn("core", F.col("rep"))
    found = staged(full_rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(lambda f: _links(f, cosine), "rep long, links long, to long"), "vector-links")
    drop_staged(keyed, full)
    if within is not None:
        found = staged(found.unionByName(within), "vector-links")
        drop_staged(crowded, cores)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("`to` <> rep").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = classes.select("rep", "_class", "least", "weight").join(linked, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("_class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = marked.select("vec_id", "_class").join(named, "_class", "left")
    component = F.coalesce("component_id", "vec_id")
    result = staged(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")), "near-vectors")
    drop_staged(classes, found, comp)
    return result


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all ``embeddings`` of equal label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs; the operator finds the links that share a cell.
BRUTE_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
"""
