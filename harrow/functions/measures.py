"""Counts, ratios, bands, quality reasons, previews and contexts."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import constants as K
from harrow.functions.normalize import LETTERS, SLICE, WHITE, WORD, WORD_CHARACTERS, ColumnOrName, col, key_comparison, squeeze, strip, sub, text
from harrow.functions.structs import struct_of

WORD_PATTERNS = {
    "letters_digits": f"[{WORD_CHARACTERS}]+",
    "word": r"(?U)\b\w+\b",
    "letters": f"[{LETTERS}]+(?:['’-][{LETTERS}]+)*",
    "spaced": f"[^{WHITE}]+",
}


def word_count(c: ColumnOrName, kind: str = "spaced") -> Column:
    """Words by one of the definitions of ``WORD_PATTERNS``."""
    return F.regexp_count(text(c), F.lit(WORD_PATTERNS[kind]))


def letter_count(c: ColumnOrName) -> Column:
    return F.length(sub(text(c), r"[^\p{L}]", ""))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def alphabetic_ratio(c: ColumnOrName) -> Column:
    """Letters among the characters that are no white space."""
    return share(letter_count(c), F.length(sub(text(c), f"[{WHITE}]+", "")))


def unique_word_ratio(words: Column) -> Column:
    """Distinct words among all, case folded."""
    folded = F.transform(words, lambda w: F.lower(w))
    return share(F.size(F.array_distinct(folded)), F.size(folded))


@F.arrow_udf(struct_of("words int, distinct int"))
def counted_words(a: pa.Array) -> pa.Array:
    """Words of letters and digits, and the distinct ones among them, case folded; no list of them is made in the JVM."""
    found, out = re.compile(WORD).findall, ([], [])
    for i in range(0, len(a), SLICE):
        for x in a.slice(i, SLICE).to_pylist():
            words = found(x or "")
            out[0].append(len(words))
            out[1].append(len({w.lower() for w in set(words)}))
    return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in out], ["words", "distinct"])


def length_ratio(a: Column, b: Column) -> Column:
    """The smaller length over the greater; 0 if both are 0."""
    return share(F.least(a, b), F.greatest(a, b))


def text_metrics(c: ColumnOrName) -> Column:
    """Characters, meaningful tokens, letters, placeholders and their ratio."""
    value = strip(text(c))
    rest = sub(value, K.PLACEHOLDER, " ")
    tokens = F.regexp_count(rest, F.lit(f"[{LETTERS}]{{2,}}"))
    marks = F.regexp_count(value, F.lit(K.PLACEHOLDER))
    return F.struct(
        F.length(value).alias("text_character_count"), tokens.alias("meaningful_token_count"), letter_count(rest).alias("alphabetic_character_count"),
        marks.alias("placeholder_count"), F.round(share(marks, tokens + marks), 4).alias("placeholder_ratio"),
    )


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())


def low_information(c: ColumnOrName, key: str) -> Column:
    """Why a text says too little for its kind of data set."""
    value = strip(text(c))
    m = text_metrics(c)
    characters, tokens = K.QUALITY_THRESHOLDS[key]
    no = F.lit(False)
    return reasons(
        ("below_minimum_character_count", m["text_character_count"] < characters),
        ("too_few_meaningful_tokens", m["meaningful_token_count"] < tokens),
        ("placeholder_dominated", (m["placeholder_count"] > 0) & (m["placeholder_ratio"] >= 0.5)),
        ("generic_claim_phrase", key_comparison(value).isin(*K.GENERIC_PHRASES) if key in ("facturk", "fctr") else no),
        ("reference_or_link_only", reduce(lambda a, b: a | b, [value.rlike(p) for p in K.REFERENCE_ONLY]) if key == "mide22" else no),
        ("no_alphabetic_content", m["alphabetic_character_count"] == 0),
    )


def quality_rejections(c: ColumnOrName, words: Column, letters: Column, unique: Column, least: int = 80, most: int = 3000) -> Column:
    """Why an article is kept out of the pool; an empty one for that alone."""
    boilerplate = sum((F.when(text(c).rlike(p), 1).otherwise(0) for p in K.BOILERPLATE), F.lit(0))
    found = reasons(
        ("below_minimum_word_count", words < least),
        ("above_maximum_word_count", words > most),
        ("low_alphabetic_ratio", letters < 0.55),
        ("excessive_word_repetition", (words >= 100) & (unique < 0.08)),
        ("probable_webpage_boilerplate", boilerplate >= 3),
    )
    return F.when(text(c) == "", F.array(F.lit("empty_text"))).otherwise(found)


def claim_quality(c: ColumnOrName) -> Column:
    """(status, reasons, tokens) of a claim."""
    claim = text(c)
    tokens = F.regexp_count(claim, F.lit(f"[{LETTERS}]{{2,}}"))
    why = reasons(("below_20_characters", F.length(claim) < 20), ("fewer_than_3_tokens", tokens < 3), ("placeholder_only", claim.isin("<URL>", "<USER>", "<SOURCE>")))
    return F.struct(F.when(F.size(why) > 0, "review_required").otherwise("quality_candidate").alias("status"), F.array_join(why, ";").alias("reasons"), tokens.alias("tokens"))


def preview(c: ColumnOrName, limit: int = 300) -> Column:
    """The squeezed text, cut at ``limit`` with an ellipsis."""
    value = squeeze(text(c))
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.substring(value, 1, limit), F.lit("...")))


def match_context(c: ColumnOrName, pattern: str, around: int = 140) -> Column:
    """(match, context): the first match, and it with what is around it, ellipses where cut."""
    value = text(c)
    found = F.regexp_extract(value, f"({pattern})", 1)
    at = F.regexp_instr(value, F.lit(pattern))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + F.length(found) + around, F.length(value) + 1)
    part = squeeze(value.substr(start, end - start))
    context = F.concat(F.when(start > 1, F.lit("... ")).otherwise(""), part, F.when(end <= F.length(value), F.lit(" ...")).otherwise(""))
    return F.when(at > 0, F.struct(found.alias("match"), context.alias("context")))


def edit_context(c: ColumnOrName, start: Column, end: Column, around: int = 100) -> Column:
    """Text around a span (0-based, end exclusive), on one line."""
    first = F.greatest(start - around, F.lit(0))
    return F.replace(text(c).substr((first + 1).cast("int"), (end + around - first).cast("int")), F.lit("\n"), F.lit(" "))


def truncated(c: ColumnOrName, words: Column | int) -> Column:
    """The first words of a text, joined by spaces."""
    found = F.regexp_extract_all(text(c), F.lit(f"([^{WHITE}]+)"), F.lit(1))
    return F.array_join(F.slice(found, F.lit(1), words if isinstance(words, Column) else F.lit(words)), " ")


def same_start(a: ColumnOrName, b: ColumnOrName, characters: int = 120) -> Column:
    """Whether two texts agree on their first characters."""
    return F.substring(squeeze(text(a)), 1, characters) == F.substring(squeeze(text(b)), 1, characters)


def destyling_quality(before: ColumnOrName, masked: ColumnOrName, after: ColumnOrName) -> Column:
    """Placeholder counts, lengths and flags of a masked and de-styled text."""
    b, m, a = text(before), text(masked), text(after)
    ratio = F.round(share(F.length(a), F.length(b)), 4)
    names = ("URL", "EMAIL", "USER", "SOURCE", "ENGAGEMENT")
    return F.struct(
        *[F.regexp_count(a, F.lit(f"<{n}>")).alias(f"{n.lower()}_count") for n in names],
        F.length(b).alias("length_before"), F.length(a).alias("length_after"), ratio.alias("length_ratio"),
        ((ratio < 0.6) | (ratio > 1.4)).alias("suspicious_length"), a.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]").alias("has_control_character"),
        (b == a).alias("unchanged"), (m == a).alias("masked_equals_destyled"),
    )


def band(value: Column, *steps: tuple[float, str], below: str | None) -> Column:
    """The name of the first step that the value reaches."""
    out = None
    for least, name in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(below)


# The names of the bands.
SIMILARITY_BANDS = ((0.95, "very_high_95_plus"), (0.90, "very_high_90_95"))
CONFIDENCE_BANDS = ((0.99, "01 — %99 ve üzeri"), (0.95, "02 — %95–%99"), (0.90, "03 — %90–%95"), (0.80, "04 — %80–%90"), (0.70, "05 — %70–%80"), (0.60, "06 — %60–%70"))
TOKEN_BANDS = ((400, "06 — 400 ve üzeri"), (300, "05 — 300–399 token"), (250, "04 — 250–299 token"), (200, "03 — 200–249 token"), (150, "02 — 150–199 token"))
REVIEW_PRIORITIES = ((0.99, "1 — Çok yüksek öncelik"), (0.95, "2 — Yüksek öncelik"), (0.90, "3 — Orta öncelik"))
EDIT_SIZES = ((2, 0.01, "01 — Çok küçük değişiklik"), (6, 0.03, "02 — Küçük değişiklik"), (20, 0.10, "03 — Orta değişiklik"))


def similarity_band(value: Column) -> Column:
    return band(value, *SIMILARITY_BANDS, below="high_85_90")


def confidence_band(value: Column) -> Column:
    return band(value, *CONFIDENCE_BANDS, below="07 — %50–%60")


def token_band(value: Column) -> Column:
    return band(value, *TOKEN_BANDS, below="01 — 80–149 token")


def review_priority(confidence: Column) -> Column:
    return band(confidence, *REVIEW_PRIORITIES, below="4 — Düşük öncelik")


def edit_size_band(changed: Column, ratio: Column) -> Column:
    """By changed tokens or by their share, whichever is the smaller band."""
    out = F.when(changed == 0, "00 — Değişiklik yok")
    for most, share_, name in EDIT_SIZES:
        out = out.when((changed <= most) | (ratio <= share_), name)
    return out.otherwise("04 — Büyük değişiklik")


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities from scores."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    parts = [F.exp(x - top) for x in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def id_repair(c: ColumnOrName) -> Column:
    """Ids that became decimals, as integers again."""
    return sub(F.trim(col(c).cast("string")), r"^(\d+)\.0$", "$1")


def id_number(c: ColumnOrName) -> Column:
    """The digits at the end of an id, as a number."""
    return F.regexp_extract(text(c), r"(\d+)$", 1).try_cast("long")
