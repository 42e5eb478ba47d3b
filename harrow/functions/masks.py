"""Masking of addresses, sources and set phrases, with a count for every rule.

The order of the rules matters, and each count is taken on the text as the rules
before have left it. A rule is a projection of its own, so that neither a text nor
a count is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import constants as K
from harrow.functions.normalize import lines, visible

#: Kinds of data set whose claims are restyled.
RESTYLED = ("article_main", "facturk", "fctr")
USERS, URLS = r"(?U)(?:<USER>\s*){2,}", r"(?U)(?:<URL>\s*){2,}"


def mask_rules(key: str) -> list[tuple[str, str, str]]:
    """(counter, pattern, replacement) in order."""
    tweets = [("mention_masked", K.MENTION, "<USER>"), ("hashtag_normalized", K.HASHTAG, "$1"), ("engagement_masked", K.ENGAGEMENT, "<ENGAGEMENT>")]
    return [
        ("url_masked", K.URL, "<URL>"), ("email_masked", K.EMAIL, "<EMAIL>"), *(tweets if key == "mide22" else []),
        ("source_brand_masked", K.SOURCE_BRAND, "<SOURCE>"), ("agency_signature_removed", K.AGENCY_SIGNATURE, "\n"), ("agency_news_phrase_normalized", K.AGENCY_NEWS, "habere göre"),
        ("repeated_users_collapsed", USERS, "<USER> "), ("repeated_urls_collapsed", URLS, "<URL> "),
        *(("reporter_phrase_normalized", p, to) for p, to in K.REPORTER),
    ]


def restyle_rules(key: str) -> list[tuple[str, str, str]]:
    if key not in RESTYLED:
        return []
    return [
        *(("social_media_claim_normalized", p, to) for p, to in K.SOCIAL_CLAIM), *(("claim_statement_normalized", p, to) for p, to in K.CLAIM_STATEMENT),
        ("heading_removed", K.HEADING, "\n"), ("verification_phrase_normalized", K.VERIFICATION, "değerlendirme sonucu"),
    ]


MASK_COUNTERS = tuple(dict.fromkeys(name for name, _, _ in mask_rules("mide22")))
RESTYLE_COUNTERS = tuple(dict.fromkeys(name for name, _, _ in restyle_rules("fctr")))


#: What a text that a pattern matches has for certain, one of some strings.
CERTAIN = {
    K.EMAIL: ("@",), K.MENTION: ("@",), K.HASHTAG: ("#",), K.AGENCY_SIGNATURE: ("(AA)", "(DHA)", "(İHA)"), USERS: ("<USER>",), URLS: ("<URL>",),
}


def apply_rules(df: DataFrame, column: str, rules: list[tuple[str, str, str]], counters: tuple[str, ...]) -> DataFrame:
    """``column`` rewritten by ``rules``, with one count column for each of ``counters``.

    A text is searched once for each rule, and again only to rewrite what was found.
    """
    df = df.withColumns({name: F.lit(0) for name in counters})
    for name, pattern, to in rules:
        found = F.regexp_count(column, F.lit(pattern))
        if pattern in CERTAIN:
            found = F.when(reduce(Column.__or__, [F.contains(column, F.lit(x)) for x in CERTAIN[pattern]]), found).otherwise(0)
        rewritten = F.when(F.col("_found") > 0, F.regexp_replace(column, pattern, to)).otherwise(F.col(column))
        df = df.withColumn("_found", found).withColumns({name: F.col(name) + F.col("_found"), column: rewritten}).drop("_found")
    return df


def mask(df: DataFrame, source: str, key: str, into: str = "text_masked", form: bool = True) -> DataFrame:
    """``df`` with the masked text and its counters."""
    df = df.withColumn(into, visible(source, form, stripped=False))
    return apply_rules(df, into, mask_rules(key), MASK_COUNTERS).withColumn(into, lines(into))


def restyle(df: DataFrame, key: str, masked: str = "text_masked", into: str = "text_destyled") -> DataFrame:
    """``df`` with the de-styled text and its counters."""
    df = df.withColumn(into, F.col(masked))
    return apply_rules(df, into, restyle_rules(key), RESTYLE_COUNTERS).withColumn(into, lines(into))


def destyle(df: DataFrame, source: str, key: str, form: bool = True) -> DataFrame:
    """Masked and de-styled text, number of changes, lengths before and after."""
    out = restyle(mask(df, source, key, form=form), key)
    changes = sum((F.col(name) for name in (*MASK_COUNTERS, *RESTYLE_COUNTERS)), F.lit(0))
    return out.withColumns({"destyle_change_count": changes, "text_length_before": F.length(F.coalesce(F.col(source), F.lit(""))), "text_length_after": F.length("text_destyled")})
