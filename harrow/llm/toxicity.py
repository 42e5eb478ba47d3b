"""A toxicity classifier with counterfactual regularisation.

Logistic regression over the words that a text has and over their first letters
(inflecting languages have many forms of an insult), fitted on a bounded sample of
labelled rows. Identity terms in labelled texts are swapped for other terms of
their kind, beginnings included, and the squared change of the score is penalised,
so that naming a group does not by itself make a text toxic. Where labelled texts
name no group, a hash-chosen share of them is given a term first, its label
unchanged, so that the penalty has sentences to act on in any corpus and language.
Word statistics of the sample and the scores of all texts are computed in Spark;
the driver sees the vocabulary and the sample's word numbers only.

Edge cases. A null or empty text has the score of no words at all; labels that are
null are ignored, and contradicting ones of an id count as toxic; without any
labelled row, or with one class only, every score is that class's share (0 without
rows); a null id counts as the empty string; repeated rows are scored alike; texts
are read whole; other columns are carried or ignored, and a column named like the
score is replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import drop_staged, staged, table

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Words that a model knows, at most, and texts of the sample that a word must be in.
VOCABULARY, LEAST_TEXTS = 20_000, 8
#: Chi-squared with one degree of freedom at p = 1e-6: what a word must reach.
LEAST_CHI2 = 23.9
RIDGE, COUNTERFACTUAL = 1e-4, 10.0
STEPS = 1500
FOLDS = 5
#: Of the labelled texts without an identity term, one in so many is given one.
AUGMENT = 4
#: Terms that are swapped for each other, by kind and language; a word of two languages is of the first.
IDENTITY = (
    # English
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("immigrant", "refugee", "native"), ("immigrants", "refugees", "natives"), ("deaf", "blind", "disabled"), ("old", "young"),
    # German
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("weiblich", "männlich"), ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    ("muslimisch", "christlich", "jüdisch", "buddhistisch", "atheistisch"), ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten"), ("einwanderer", "flüchtlinge", "einheimische"), ("taub", "blinde", "behindert"), ("alte", "junge"),
    # French
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("féminin", "masculin"), ("lesbienne", "hétérosexuelle", "bisexuelle"),
    ("musulman", "chrétien", "juif", "bouddhiste", "athée"), ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques"), ("immigrés", "réfugiés", "autochtones"), ("sourd", "aveugle", "handicapé"), ("vieux", "jeunes"),
    # Spanish
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("femenino", "masculino"), ("lesbiana", "heterosexual", "bisexuales"),
    ("musulmán", "cristiano", "judío", "budista", "ateo"), ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos"), ("inmigrantes", "refugiados", "nativos"), ("sordo", "ciego", "discapacitado"), ("viejos", "jóvenes"),
)
Kinds = tuple[tuple[str, ...], ...]

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The words of a whole text, lowered."""
    return set(_WORD.findall((text or "").lower()))


#: Lengths of the word beginnings that are features beside the words; they end in "*".
STEMS = (4, 5, 6)


def _with_beginnings(words: set[str]) -> set[str]:
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


def features_of(text: str | None) -> set[str]:
    """The words of a text and their beginnings."""
    return _with_beginnings(words_of(text))


def swap_pairs(identity: Kinds = IDENTITY) -> list[tuple[str, str]]:
    """Each identity term with the next of its kind."""
    return [pair for kind in identity for pair in zip(kind, (*kind[1:], kind[0]), strict=True)]


def next_terms(identity: Kinds = IDENTITY) -> dict[str, str]:
    """What each identity term in a text is swapped for."""
    out: dict[str, str] = {}
    for a, b in swap_pairs(identity):
        out.setdefault(a, b)
    return out


def swapped(words: set[str], to: dict[str, str]) -> tuple[set[str], set[str]]:
    """(features lost, features gained) when each identity term among the words becomes the next of its kind."""
    before, after = _with_beginnings(words), _with_beginnings({to.get(w, w) for w in words})
    return before - after, after - before


def augmented(text: str | None, terms: list[str], one_in: int = AUGMENT) -> set[str]:
    """The words of a labelled text; without an identity term among them, some texts get one."""
    words = words_of(text)
    h = zlib.crc32((text or "").encode())
    if terms and one_in and h % one_in == 0 and not words & set(terms):
        words.add(terms[h // one_in % len(terms)])
    return words


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from fitting."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def _split(frames: Iterator[pd.DataFrame], identity: Kinds, one_in: int) -> Iterator[pd.DataFrame]:
    to = next_terms(identity)
    for frame in frames:
        words = [augmented(t, list(to), one_in) for t in frame["text"]]
        changes = [swapped(w, to) for w in words]
        yield pd.DataFrame({"toxic": frame["toxic"], "words": [sorted(_with_beginnings(w)) for w in words], "lost": [sorted(x) for x, _ in changes], "gained": [sorted(x) for _, x in changes]})


def _numbered(frames: Iterator[pd.DataFrame], number: dict[str, int]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        at = {c: [[number[w] for w in words if w in number] for words in frame[n]] for c, n in (("at", "words"), ("lost", "lost"), ("gained", "gained"))}
        yield pd.DataFrame({"toxic": frame["toxic"], **at})


class Model:
    """Weights of words and the bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known = weights.keys()

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights[w] for w in self._known & features_of(text)))
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -500.0, 500.0))))


def _swaps(number: dict[str, int], changes: list[tuple[list[int], list[int]]], identity: Kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, word, change): what changes in a text when each identity term becomes the next of its kind.

    What is not in the vocabulary has no weight, and so takes no part.
    """
    alone = [tuple([number[x] for x in sorted(side) if x in number] for side in swapped({a}, {a: b})) for a, b in swap_pairs(identity)]  # a sentence with one term alone
    rows, cols, values = [], [], []
    pair = 0
    for lost, gained in [*changes, *alone]:
        if len(lost) or len(gained):
            rows += [pair] * (len(lost) + len(gained))
            cols += [*lost, *gained]
            values += [-1.0] * len(lost) + [1.0] * len(gained)
            pair += 1
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(values)


def fit(texts: list[np.ndarray], toxic: np.ndarray, words: list[str], changes: list[tuple[list[int], list[int]]] | None = None, identity: Kinds = IDENTITY) -> Model:
    """Accelerated gradient descent on loss + ridge + penalised counterfactual changes.

    ``changes`` has the word numbers that each text loses and gains in its swap;
    without it they are taken from the texts' known words.
    """
    n, m = len(texts), len(words)
    share = float(toxic.mean()) if n else 0.0
    if not n or share in (0.0, 1.0):
        return Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    rows = np.repeat(np.arange(n), [len(t) for t in texts])
    cols = np.concatenate([np.asarray(t, np.int64) for t in texts]) if len(rows) else np.zeros(0, np.int64)
    number = {w: i for i, w in enumerate(words)}
    if changes is None:
        to = next_terms(identity)
        sides = (swapped({words[i] for i in t if not words[i].endswith("*")}, to) for t in texts)
        changes = [([number[x] for x in sorted(a) if x in number], [number[x] for x in sorted(b) if x in number]) for a, b in sides]
    pr, pc, pv = _swaps(number, changes, identity)
    pairs = int(pr.max()) + 1 if len(pr) else 0

    def curved(v: np.ndarray, c: float) -> tuple[np.ndarray, float]:
        """An upper bound of the loss's second derivative, applied to (v, c)."""
        z = (np.bincount(rows, weights=v[cols], minlength=n) + c) * (0.25 / n)
        out = np.bincount(cols, weights=z[rows], minlength=m) + RIDGE * v
        if pairs:
            change = np.bincount(pr, weights=pv * v[pc], minlength=pairs)
            out = out + COUNTERFACTUAL / pairs * np.bincount(pc, weights=pv * change[pr], minlength=m)
        return out, float(z.sum())

    v, c, top = np.random.default_rng(0).random(m), 1.0, 1.0
    for _ in range(40):  # power iteration: the greatest curvature bounds the step
        top = max(float(np.sqrt((v * v).sum() + c * c)), 1e-12)
        v, c = curved(v / top, c / top)
    rate = 1.0 / (1.1 * float(np.sqrt((v * v).sum() + c * c)) + 1e-9)
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    w1, b1 = w, b
    for step in range(STEPS):
        mix = step / (step + 3.0)
        yw, yb = w + mix * (w - w1), b + mix * (b - b1)
        z = yb + np.bincount(rows, weights=yw[cols], minlength=n)
        off = (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - toxic) / n
        gw = np.bincount(cols, weights=off[rows], minlength=m) + RIDGE * yw
        if pairs:
            change = np.bincount(pr, weights=pv * yw[pc], minlength=pairs)
            gw += COUNTERFACTUAL / pairs * np.bincount(pc, weights=pv * change[pr], minlength=m)
        w1, b1, w, b = w, b, yw - rate * gw, yb - rate * float(off.sum())
    return Model({x: float(v) for x, v in zip(words, w, strict=True) if v}, b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", identity: Kinds = IDENTITY, augment: int = AUGMENT) -> Model:
    """A model from the labelled rows that are not held out, of a hash-chosen ``rows`` of them at most.

    ``identity`` has the kinds of terms that must not change a score; one in
    ``augment`` labelled texts without such a term gets one (0 for none).
    """
    label = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null")
    label = label.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = label.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic")
    sample = staged(found.mapInPandas(lambda f: _split(f, identity, augment), "toxic int, words array<string>, lost array<string>, gained array<string>"), "labelled-words")
    total, bad = (int(x or 0) for x in sample.agg(F.count("*"), F.sum("toxic")).first())
    n, a = F.col("n").cast("double"), F.col("a").cast("double")
    lean = a * total - n * bad
    chi2 = lean * lean * total / (n * (total - n) * float(max(1, bad) * max(1, total - bad)) + 1e-9)
    terms = F.col("word").isin([t for kind in identity for t in kind])
    counted = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("a"))
    kept = counted.withColumn("chi2", chi2).where(((F.col("n") >= LEAST_TEXTS) & (F.col("chi2") >= LEAST_CHI2)) | terms)
    words = [r["word"] for r in kept.orderBy(F.col("chi2").desc(), "word").limit(VOCABULARY).select("word").collect()]
    number = {w: i for i, w in enumerate(words)}
    data = sample.mapInPandas(lambda f: _numbered(f, number), "toxic int, at array<int>, lost array<int>, gained array<int>").toPandas()
    drop_staged(sample)
    at, lost, gained = ([list(map(int, x)) for x in data[c]] for c in ("at", "lost", "gained"))
    order = sorted(range(len(data)), key=lambda i: (int(data["toxic"].iat[i]), at[i], lost[i], gained[i]))  # sums do not depend on the rows' order
    toxic = data["toxic"].to_numpy(np.float64)[order] if len(data) else np.zeros(0)
    return fit([np.asarray(at[i], np.int64) for i in order], toxic, words, [(lost[i], gained[i]) for i in order], identity)


def score_column(model: Model) -> Column:
    """A column function: text -> score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype="float64")

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score; a column of that name is replaced."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], score_column(model)(F.col(f"`{text_col}`")).alias(name))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of ``labels.toxic``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
