"""Near-duplicate documents: an n-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; equal sets are one class. In each
of several runs the sets are split recursively: at a node, a set chooses each of
its tokens with a probability of 1 / (threshold * its size), by a hash that all
sets share, and goes on to a child for each token chosen. Two sets of at least the
threshold's similarity choose one common token or more on average at every level.
Nodes of few sets are compared by brute force; larger ones are split further, and
what is still crowded at the last level is compared block by block. The number of
runs follows from the target recall for pairs just at the threshold; more similar
ones are found with greater probability.

Within a node only pairs whose sizes and bit sketches allow the threshold are kept,
each in the first node that the two share; then the whole sets are compared. A node
returns for each set how many links it found and the smallest set it is connected
with there, so that a group of n copies costs n rows and not n^2 pairs.

Words are runs of letters and digits, lowered. Edge cases. A text of fewer than
five words is one shingle of all its words; a null text or one without words links
with nothing; documents of equal sets link whatever their ids; ids are whole
numbers, others are an error; a null id takes part
but names no component; repeated rows are documents of their own; texts are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.cells import by_cell, first_shared, padded, pairs
from harrow.llm.common import drop_staged, packed, staged, table, unpacked
from harrow.operators.components import components

WORDS = 5
THRESHOLD = 0.8
#: Of the pairs just at the threshold, the share to be found.
RECALL = 0.999
LEVELS = 3
#: Sets in a node that are compared at once, and sets in a block of a crowded node.
FEW, CROWD = 48, 512
#: Bits of the sketch, and how many standard deviations it may err.
SKETCH_WORDS, SIGMAS = 4, 5.0
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def runs_needed(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs after which a pair that shares one chosen token a level on average has met."""
    alive = 1.0
    for _ in range(levels):
        alive = 1.0 - math.exp(-alive)
    return math.ceil(math.log(1.0 - recall) / math.log(1.0 - alive))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word n-grams."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, _U)
    for i in range(min(words, len(h))):
        out = _mixed(out * _U(3) + h[i : i + n] + _U(i + 1))
    return np.unique(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One bit each of SKETCH_WORDS * 64 minwise hashes."""
    n = SKETCH_WORDS * 64
    seeds = _mixed(np.arange(1, n + 1, dtype=_U) * _ODD)
    least = np.full(n, 2**64 - 1, _U)
    for at in range(0, len(tokens), 512):  # a bounded matrix for texts of any length
        part = tokens[at : at + 512]
        h = (part[:, None] ^ seeds) * _ODD
        h ^= h >> _U(29)
        np.minimum(least, h.min(axis=0), out=least)
    bits = (_mixed(least) & _U(1)).astype(np.uint8)
    return np.packbits(bits).view(_U)


def chosen_paths(tokens: np.ndarray, runs: int, levels: int = LEVELS, threshold: float = THRESHOLD) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (parents, nodes) of a set in all runs."""
    limit = _U(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    nodes = _mixed(np.arange(1, runs + 1, dtype=_U) * _U(0xA0761D6478BD642F))
    out = []
    for level in range(levels):
        parents, children = [], []
        for at in range(0, len(tokens), 4096):
            part = tokens[at : at + 4096]
            h = (part[None, :] ^ nodes[:, None]) * _ODD
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            p, t = np.nonzero(h < limit)
            parents.append(nodes[p])
            children.append(_mixed(nodes[p] * _U(5) + part[t] + _U(level)))
        p, c = np.concatenate(parents), np.concatenate(children)
        out.append((p, c))
        nodes = np.unique(c)
        if not len(nodes):
            nodes = np.zeros(0, _U)
    return out


def _pathed(batches: Iterator[pa.RecordBatch], words: int, runs: int, levels: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Documents -> 128 bits of the set, size, sketch, and the nodes of each level with their parents."""
    for batch in batches:
        keys, sizes, sketches, parents, nodes, counts = [], [], [], [], [], []
        for text in batch.column(1).to_pylist():
            tokens = shingles(text, words)
            sizes.append(len(tokens))
            if not len(tokens):
                for column in (keys, sketches, parents, nodes, counts):
                    column.append(None)
                continue
            keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            sketches.append(sketch(tokens).tobytes())
            levels_ = chosen_paths(tokens, runs, levels, threshold)
            parents.append(np.concatenate([p for p, _ in levels_]).view(np.int64))
            nodes.append(np.concatenate([c for _, c in levels_]).view(np.int64))
            counts.append(np.repeat(np.arange(1, levels + 1, dtype=np.int32), [len(c) for _, c in levels_]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(parents, pa.list_(pa.int64())), pa.array(nodes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), batch.column(2)], ["_id", "set", "size", "sketch", "parents", "nodes", "levels", "_hash"])


_CELL = ["node", "a", "b"]


def _possible(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """The rows of each cell that have a pair to verify there."""
    bits = SKETCH_WORDS * 64
    share = (1.0 - threshold) / 2.0
    most = bits * share + SIGMAS * math.sqrt(bits * share * (1.0 - share))
    for frame in by_cell(frames, _CELL):
        sizes = frame["size"].to_numpy()
        marks = np.frombuffer(b"".join(frame["sketch"]), _U).reshape(len(frame), SKETCH_WORDS)
        lists, node = padded(frame["shared"]), frame["node"].to_numpy()
        needed = np.zeros(len(frame), bool)
        for p, q in pairs(frame, _CELL):
            keep = np.minimum(sizes[p], sizes[q]) >= threshold * np.maximum(sizes[p], sizes[q])
            p, q = p[keep], q[keep]
            keep = np.bitwise_count(marks[p] ^ marks[q]).sum(axis=1, dtype=np.int64) <= most
            p, q = p[keep], q[keep]
            for s in range(0, len(p), 1 << 15):
                x, y = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
                here = first_shared(lists, x, y) == node[x]
                needed[x[here]] = True
                needed[y[here]] = True
        out = frame.loc[needed, [*_CELL, "side", "rep", "shared"]]
        if len(out):
            yield out


def _verified(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links within cells, counted and joined up."""
    for frame in by_cell(frames, _CELL):
        sets = [np.frombuffer(x, _U) for x in frame["tokens"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        lists, node = padded(frame["shared"]), frame["node"].to_numpy()
        rep, weight = frame["rep"].to_numpy(), frame["weight"].to_numpy()
        counted = np.zeros(len(frame), np.int64)
        parent = list(range(len(frame)))

        def root(a: int, parent=parent) -> int:
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            return a

        for p, q in pairs(frame, _CELL):
            keep = np.minimum(sizes[p], sizes[q]) >= threshold * np.maximum(sizes[p], sizes[q])
            p, q = p[keep], q[keep]
            for s in range(0, len(p), 1 << 15):
                x, y = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
                here = first_shared(lists, x, y) == node[x]
                x, y = x[here], y[here]
                common = _common(sets, x, y)
                linked = common >= threshold * (sizes[x] + sizes[y] - common)
                x, y = x[linked], y[linked]
                np.add.at(counted, x, weight[y])
                np.add.at(counted, y, weight[x])
                for u, v in zip(x.tolist(), y.tolist(), strict=True):
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        parent[max(ru, rv)] = min(ru, rv)
        roots = np.fromiter((root(a) for a in range(len(frame))), np.int64, len(frame))
        least = pd.Series(rep).groupby(roots).transform("min").to_numpy()
        keep = counted > 0
        if keep.any():
            yield pd.DataFrame({"rep": rep[keep], "links": counted[keep], "to": least[keep]})


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs, a left set at a time."""
    out = np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(x[order])) + 1, [len(x)]]) if len(x) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = order[a:b]
        mine = sets[x[some[0]]]
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            other = np.concatenate([sets[j] for j in y[part]])
            i = np.searchsorted(mine, other)
            hit = mine[np.minimum(i, len(mine) - 1)] == other
            ends = np.cumsum([len(sets[j]) for j in y[part]])
            total = np.concatenate([[0], np.cumsum(hit)])
            out[part] = total[ends] - total[np.concatenate([[0], ends[:-1]])]
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["rep", "tokens"])


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS, few: int = FEW, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, component_id, n_links, kept, text_hash.

    ``kept`` marks the component's smallest (id, text hash), nulls last; rows that
    repeat both are marked alike.
    """
    runs = runs_needed(recall, levels)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    schema = "_id long, set binary, size long, sketch binary, parents array<long>, nodes array<long>, levels array<int>, _hash long"
    pathed = staged(rows.mapInArrow(lambda b: _pathed(b, words, runs, levels, threshold), schema), "paths")
    who = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_hash")
    sample = F.min_by(F.struct("size", "sketch", "parents", "nodes", "levels"), who)
    # Equal sets by 128 bits of them; the staged table fixes the classes' numbers.
    equal = pathed.where("set is not null").groupBy("set").agg(F.min(who).alias("who"), F.count("*").alias("weight"), sample.alias("x"))
    classes = staged(equal.select(F.monotonically_increasing_id().alias("rep"), "set", "who", "weight", "x.*"), "classes")
    steps = classes.select("rep", F.explode(F.arrays_zip("parents", "nodes", "levels")).alias("s")).select("rep", F.col("s.parents").alias("parent"), F.col("s.nodes").alias("node"), F.col("s.levels").alias("level"))
    cells = split = None
    done_with: list[DataFrame] = []
    for level in range(1, levels + 1):
        here = steps.where(F.col("level") == level)
        if split is not None:  # only what is in a large node goes on
            here = here.join(split.select(F.col("node").alias("parent")), "parent")
        here = staged(here.select("rep", "node").distinct(), "steps")
        sizes = staged(here.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        done_with += [here, sizes]
        last = level == levels
        done = here.join(sizes if last else sizes.where(F.col("n") <= few), "node").select("rep", "node", "n")
        cells = done if cells is None else cells.unionByName(done)
        split = sizes.where(F.col("n") > few).select("node")
    cells = staged(cells, "cells")
    shared = cells.groupBy("rep").agg(F.array_sort(F.collect_set("node")).alias("shared"))  # as many as a set has paths
    blocks = F.ceil(F.col("n") / crowd).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(5)), blocks).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"))))
    dealt = cells.select("rep", "node", own.alias("own"), pair.alias("pair"))
    side = F.when(F.col("pair.a") == F.col("pair.b"), 0).when(F.col("own") == F.col("pair.a"), 1).otherwise(2)
    dealt = dealt.select("rep", "node", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), side.alias("side"))
    lit = dealt.join(classes.select("rep", "size", "sketch"), "rep").join(shared, "rep")
    needed = lit.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(lambda f: _possible(f, threshold), "node long, a int, b int, side int, rep long, shared array<long>")
    needed = staged(needed, "possible")
    wanted = needed.select("rep").distinct().join(classes.select("rep", "who", "weight"), "rep")
    at = wanted.select("rep", F.col("who._id").alias("_who"), F.col("who._hash").alias("_of"))
    texts = rows.join(at, rows["_id"].eqNullSafe(at["_who"]) & (rows["_hash"] == at["_of"])).select("rep", "_text")
    sets = staged(texts.mapInArrow(lambda b: _sets(b, words), "rep long, tokens binary").groupBy("rep").agg(F.first("tokens").alias("tokens")), "sets")
    full = needed.join(sets, "rep").join(wanted.select("rep", "weight"), "rep")
    found = staged(full.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(lambda f: _verified(f, threshold), "rep long, links long, to long"), "links")
    drop_staged(*done_with, cells, needed, sets)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = classes.select("rep", "set", "who", "weight").join(linked, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = named.join(named.groupBy("component").agg(F.min("who").alias("head")), "component")
    named = named.select("set", F.col("who._id").alias("class_id"), "head", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = pathed.select("_id", "_hash", "set").join(named, "set", "left")
    alone = F.col("head").isNull()
    mine = F.col("_id").eqNullSafe(F.col("head._id")) & (F.col("_hash") == F.col("head._hash"))
    result = staged(
        out.select(
            F.col("_id").alias("doc_id"), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("_id")).otherwise(F.col("head._id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | F.coalesce(mine, F.lit(False))).alias("kept"), F.col("_hash").alias("text_hash"),
        ),
        "near-documents",
    )
    drop_staged(pathed, classes, found, comp)
    return result


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates."""
    found = near_duplicates(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash"), F.lit(True).alias("_is_gone")).distinct()
    rows = docs.select(packed(docs), F.col(f"`{id_col}`").cast("long").alias("_key"), F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"), _has_words(F.col(f"`{text_col}`")).alias("_able"))
    left = rows.join(gone, F.col("_key").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_gone_hash")), "left_anti")
    # Rows that repeat both id and text are one group too; texts without words are no copies of each other.
    able = left.where("_able").withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_hash").orderBy(F.xxhash64("_row")))).where("_n = 1").drop("_n")
    both = able.unionByName(left.where("not _able"))
    return both.select(*unpacked(both, docs.columns))


def _has_words(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[\\p{L}\\p{N}]")


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
