"""Near duplicates by SimHash bands and by character n-gram cosine."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from harrow.functions.hashing import bands, hamming, hex64, simhash_udf
from harrow.functions.measures import length_ratio, preview, similarity_band
from harrow.functions.normalize import folded
from harrow.operators.grams import FEW_CHARS, FEW_ROWS, Vocabulary, against_few, between_chunks
from harrow.staging import drop_staged, spread, staged

MOST_BITS, LEAST_RATIO = 5, 0.78
#: Open links that the driver settles by itself once no more are left.
FEW_LINKS = 200_000


def with_simhash(df: DataFrame, text: str, form: bool = True) -> DataFrame:
    """``df`` with ``simhash`` (bit pattern) and ``word_count``."""
    found = df.withColumn("_s", simhash_udf(folded(text, form)))
    return found.withColumns({"simhash": F.col("_s.simhash"), "word_count": F.col("_s.word_count")}).drop("_s")


def simhash_links(df: DataFrame, record: str, order: str, most: int = MOST_BITS, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """(earlier, later, hamming_distance, length_ratio) of rows that share a band and are near.

    Rows of equal hash and length are one class for the join, with their first row
    as its name, so that many equal texts do not meet in pairs; and rows meet only
    with those whose length is of their own step of ``least_ratio`` or the next.
    """
    rows = df.select(F.col(record).alias("id"), F.col(order).alias("at"), "simhash", "word_count")
    heads = rows.groupBy("simhash", "word_count").agg(F.min(F.struct("at", "id")).alias("h")).select("simhash", "word_count", "h.at", "h.id")
    inner = rows.join(heads.select("simhash", "word_count", F.col("at").alias("head_at"), F.col("id").alias("head")), ["simhash", "word_count"]).where("id <> head and word_count > 0")
    same = inner.select(F.col("head").alias("earlier"), F.col("id").alias("later"), F.lit(0).alias("hamming_distance"), F.lit(1.0).alias("length_ratio"))
    step = F.floor(F.log("word_count") / (-math.log(least_ratio) * (1 + 1e-9))).cast("int")
    keyed = heads.where("word_count > 0").select("*", F.explode(bands(F.col("simhash"))).alias("band"), step.alias("step"))
    a, b = keyed.alias("a"), keyed.withColumn("step", F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)]))).alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.step") == F.col("b.step")) & (F.struct("a.at", "a.id") < F.struct("b.at", "b.id")))
    near = pairs.select(F.col("a.id").alias("earlier"), F.col("b.id").alias("later"), hamming(F.col("a.simhash"), F.col("b.simhash")).alias("hamming_distance"), length_ratio(F.col("a.word_count"), F.col("b.word_count")).alias("length_ratio"))
    near = near.where((F.col("hamming_distance") <= most) & (F.col("length_ratio") >= least_ratio)).distinct()
    return near.unionByName(same)


def _settled(links: list[tuple]) -> list:
    """The covered ids of (earlier, later) links, settled one by one in row order."""
    after, waits, covered = defaultdict(list), Counter(), set()
    for earlier, later in links:
        after[earlier].append(later)
        waits[later] += 1
    ready = [x for x in after if not waits[x]]
    while ready:
        x = ready.pop()
        for later in after[x]:
            if x not in covered:
                covered.add(later)
            waits[later] -= 1
            if not waits[later]:
                ready.append(later)
    if any(waits.values()):
        raise ValueError("links must lead from earlier rows to later ones")
    return list(covered)


def greedy_representatives(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id, representative): rows that an earlier representative covers.

    In row order, a row is covered by the nearest earlier row that is itself not
    covered. Rows whose earlier neighbours are all settled are settled together, so
    that rounds follow the longest chain and not the number of rows; the driver
    settles the last ``few`` links. Nothing stays open.
    """
    links = staged(links, "links")
    open_, n, hits = links, links.count(), []
    while n > few:
        waiting = open_.select(F.col("later").alias("id")).distinct()
        free = open_.select(F.col("earlier").alias("id")).distinct().join(waiting, "id", "left_anti")
        hit = staged(open_.join(free.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct(), "covered")
        hits.append(hit)
        if len(hits) == 16:  # so that the plan stays small
            parts, hits = hits, [staged(reduce(DataFrame.unionByName, hits).coalesce(8), "covered")]
            drop_staged(*parts)
            hit = hits[0]
        rest = open_.join(hit.withColumnRenamed("id", "later"), "later", "left_anti").join(hit.withColumnRenamed("id", "earlier"), "earlier", "left_anti")
        after = staged(rest, "open")
        if open_ is not links:
            drop_staged(open_)
        open_, before, n = after, n, after.count()
        if n == before:
            raise ValueError("links must lead from earlier rows to later ones")
    last = [(x,) for x in _settled([(r["earlier"], r["later"]) for r in open_.select("earlier", "later").collect()])]
    dropped = reduce(DataFrame.unionByName, [*hits, links.sparkSession.createDataFrame(last, StructType([StructField("id", links.schema["later"].dataType)]))])
    covered = links.join(dropped.withColumnRenamed("id", "later"), "later", "left_semi").join(dropped.withColumnRenamed("id", "earlier"), "earlier", "left_anti")
    best = F.min_by(F.struct("earlier", "hamming_distance", "length_ratio"), F.struct("hamming_distance", -F.col("length_ratio"), "earlier"))
    return covered.groupBy(F.col("later").alias("id")).agg(best.alias("x")).select("id", F.col("x.earlier").alias("representative"), "x.hamming_distance", "x.length_ratio")


def simhash_duplicates(df: DataFrame, record: str, text: str, order: str, form: bool = True) -> DataFrame:
    """The near-duplicate report: each covered row with its representative."""
    rows = staged(with_simhash(df, text, form), "simhash")
    found = greedy_representatives(simhash_links(rows, record, order))
    mine = rows.select(F.col(record).alias("id"), "word_count", hex64(F.col("simhash")).alias("simhash64_hex"), preview(text).alias("text_preview"))
    head = rows.select(F.col(record).alias("representative"), F.col("word_count").alias("representative_word_count"), hex64(F.col("simhash")).alias("representative_simhash64_hex"))
    out = found.join(mine, "id").join(head, "representative")
    return out.select(F.col("id").alias("record_id"), F.col("representative").alias("representative_record_id"), "word_count", "representative_word_count", "hamming_distance", F.round("length_ratio", 5).alias("length_ratio"), "simhash64_hex", "representative_simhash64_hex", "text_preview")


def char_grams(text: Column, lengths: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams within words, each padded by one blank; a word shorter than n counts once."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)
        none = F.array().cast("array<string>")

        def of(n: int) -> Column:
            cut = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: padded.substr(i, F.lit(n)))
            return F.when(size > n, cut).when((size == n) | F.lit(n == lengths[0]), F.array(padded)).otherwise(none)

        per = [of(n) for n in lengths]
        return F.flatten(F.array(*per))

    return F.flatten(F.transform(words, grams))


def gram_weights(df: DataFrame, record: str, text: str, least_df: int = 2, most_terms: int | None = 75_000) -> DataFrame:
    """(id, gram, w): sublinear tf-idf weights, each text's of length 1."""
    terms = df.select(F.col(record).alias("id"), F.explode(char_grams(F.coalesce(F.col(text), F.lit("")))).alias("gram"))
    tf = terms.groupBy("id", "gram").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("n"))
    stats = tf.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where(F.col("df") >= least_df)
    if most_terms:
        stats = stats.orderBy(F.col("all").desc(), "gram").limit(most_terms)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = tf.join(stats, "gram").join(F.broadcast(total)).select("id", "gram", ((1 + F.log("tf")) * idf).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def _lowered(df: DataFrame, record: str, text: str, side: str) -> DataFrame:
    """(side, id, raw, t): ids as texts, and texts that are not empty; ``t`` in lower case with single blanks."""
    out = df.select(F.lit(side).alias("side"), F.col(record).cast("string").alias("id"), F.col(text).alias("raw")).where("raw <> ''")
    return out.withColumns({"t": F.regexp_replace(F.lower("raw"), r"(?U)\s+", " "), "n": F.length("raw"), "h": F.xxhash64("raw")})


def gram_pairs(df: DataFrame, record: str, text: str, other: DataFrame | None = None, threshold: float = 0.85, neighbours: int | None = None, least_ratio: float = 0.55, exact: bool = False, copies: bool = False) -> DataFrame:
    """(left, right, similarity, length_ratio, similarity_band, relation) of texts within ``df``, or between it and ``other``.

    Within a frame, and on the side of ``other``, equal texts are one, named by their
    least id; with ``copies`` a row of relation ``copy`` leads from that id to each other
    one, so that no link is lost. All pairs are given, or each left text's ``neighbours`` nearest.
    Between frames equal texts are left to the exact report unless ``exact``.
    """
    out = _gram_pairs(df, record, text, other, threshold, neighbours, least_ratio, exact, copies)
    return out.drop("_size")


def _gram_pairs(df: DataFrame, record: str, text: str, other: DataFrame | None, threshold: float, neighbours: int | None, least_ratio: float, exact: bool, copies: bool) -> DataFrame:
    """:func:`gram_pairs` with the left text's length, ``_size``."""
    mine = spread(_lowered(df, record, text, "L"))
    once = lambda x: x.groupBy("side", "raw").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("t").alias("t"), F.first("n").alias("n"), F.first("h").alias("h"))
    if other is None:
        classes = staged(once(mine).drop(*(() if copies else ("raw",))), "gram-classes")
        if copies:
            members = mine.join(classes.where("m > 1").select("raw", F.col("id").alias("l")), "raw").where("id <> l")
            members = staged(members.select("l", F.col("id").alias("r"), "n"), "gram-copies")
        texts = spread(classes.drop("raw"))
        pairs = between_chunks(texts, Vocabulary(texts), threshold, least_ratio, ("L",))
        drop_staged(classes)
    else:
        mine = staged(mine.drop("raw"), "gram-texts")  # dealt out once, not at each reading
        yours = staged(once(_lowered(other, record, text, "R")), "gram-references")
        every = mine.withColumn("m", F.lit(1)).select("t", F.col("m").cast("long")).unionByName(yours.select("t", "m"))
        words = Vocabulary(every)
        size = yours.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
        if size["rows"] <= FEW_ROWS and (size["n"] or 0) <= FEW_CHARS:
            few = [tuple(r) for r in yours.select("id", "t", "n", "h").collect()]
            pairs = against_few(mine, few, words, threshold, neighbours, least_ratio)
        else:
            both = mine.unionByName(yours.drop("raw", "m"))
            pairs = between_chunks(spread(both), words, threshold, least_ratio, ("L", "R"))
    if neighbours and other is None:  # both ends count it among their neighbours
        ends = pairs.unionByName(pairs.select(F.col("r").alias("l"), F.col("l").alias("r"), "similarity", F.col("nr").alias("nl"), F.col("nl").alias("nr"), "same"))
        near = ends.withColumn("_n", F.row_number().over(Window.partitionBy("l").orderBy(F.col("similarity").desc(), "r"))).where(F.col("_n") < neighbours)
        pairs = near.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), "similarity", F.least("nl", "nr").alias("nl"), F.greatest("nl", "nr").alias("nr"), "same").distinct()
    elif neighbours:
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("l").orderBy(F.col("similarity").desc(), "r"))).where(F.col("_n") <= neighbours)
    out = pairs.withColumn("length_ratio", length_ratio(F.col("nl"), F.col("nr"))).where(F.col("length_ratio") >= least_ratio)
    if not exact:
        out = out.where("not same")
    out = out.select("l", "r", "similarity", "length_ratio", F.lit("near").alias("relation"), F.col("nl").alias("_size"))
    if other is None and copies:
        out = out.unionByName(members.select("l", "r", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("length_ratio"), F.lit("copy").alias("relation"), F.col("n").alias("_size")))
    return out.select(F.col("l").alias("record_id_left"), F.col("r").alias("record_id_right"), F.round("similarity", 4).alias("similarity"), F.round("length_ratio", 4).alias("length_ratio"), similarity_band(F.col("similarity")).alias("similarity_band"), "relation", "_size")


def nearest_reference(df: DataFrame, record: str, text: str, references: DataFrame, short: int = 60, threshold: float = 0.85, short_threshold: float = 0.90, least_ratio: float = 0.55) -> DataFrame:
    """The nearest reference of each text if it is near enough; short texts must be nearer."""
    found = _gram_pairs(df, record, text, references, threshold, 1, least_ratio, exact=True, copies=False)
    # No relation: a reference that is the text itself is near as well.
    return found.where((F.col("_size") >= short) | (F.col("similarity") >= short_threshold)).drop("relation", "_size")
