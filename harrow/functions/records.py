"""Claims and news items out of raw reports, record ids, addresses."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import constants as K
from harrow.functions.normalize import ColumnOrName, col, key_ascii, squeeze, strip, sub, text, visible


def mapped(c: ColumnOrName, values: dict, default: Column | None = None) -> Column:
    """Look-up in a fixed mapping; null, or ``default``, if it is not there."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), col(c))
    return found if default is None else F.coalesce(found, default)


def mapped_or_fail(c: ColumnOrName, values: dict) -> Column:
    """As :func:`mapped`, but a value that is not there is an error."""
    message = F.concat(F.lit("unmapped value: "), F.coalesce(col(c).cast("string"), F.lit("null")))
    return F.coalesce(mapped(c, values), F.raise_error(message).cast("string"))


def shortened(c: Column, limit: int = 600) -> Column:
    """Whole sentences up to ``limit`` characters; the first is cut if it is longer."""
    sentences = F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(a: Column, s: Column) -> Column:
        n = a["n"] + F.length(s) + 1
        stop = a["full"] | ((a["n"] > 0) & (n > limit))
        joined = F.when(a["n"] == 0, s).otherwise(F.concat(a["t"], F.lit(" "), s))
        return F.struct(F.when(stop, a["t"]).otherwise(joined).alias("t"), F.when(stop, a["n"]).otherwise(n).alias("n"), (stop | (n >= limit)).alias("full"))

    chosen = F.aggregate(sentences, start, add, lambda a: strip(F.substring(a["t"], 1, limit)))
    return F.when(F.length(c) <= limit, c).otherwise(chosen)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; no Python function may be in ``f``."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def extracted_claim(c: ColumnOrName, form: bool = True) -> Column:
    """(claim, method) of a fact-check report: what is said before its findings."""

    def of_lines(x: Column) -> Column:
        first = F.try_element_at(x["found"], F.lit(1))
        two = (F.length(first) < 20) & (F.size(x["found"]) > 1)
        claim = F.when(two, F.concat_ws(" ", first, F.try_element_at(x["found"], F.lit(2)))).otherwise(first)
        for pattern, to in ((K.CLAIM_PREFIX, ""), (K.URL, "<URL>"), (K.MENTION, "<USER>"), (K.HASHTAG, "$1"), (K.CLAIM_BRAND, "<SOURCE>")):
            claim = sub(claim, pattern, to)
        method = F.concat(F.when(x["cut"] > 0, F.lit("before_report_heading")).otherwise("first_text_section"), F.when(two, F.lit("_first_two_lines")).otherwise("_first_line"))
        return (
            F.when(x["empty"], F.struct(F.lit("").alias("claim"), F.lit("empty_report").alias("method")))
            .when(F.size(x["found"]) == 0, F.struct(F.lit("").alias("claim"), F.lit("empty_claim_section").alias("method")))
            .otherwise(F.struct(squeeze(claim).alias("claim"), method.alias("method")))
        )

    def of_cut(x: Column) -> Column:
        section = F.when(x["cut"] > 0, strip(x["report"].substr(F.lit(1), (x["cut"] - 1).cast("int")))).otherwise(x["report"])
        found = F.filter(F.transform(F.split(section, "\n"), squeeze), lambda line: line != "")
        return let(F.struct(found.alias("found"), x["cut"].alias("cut"), (x["report"] == "").alias("empty")), of_lines)

    x = let(visible(c, form, newlines=True), lambda r: let(F.struct(r.alias("report"), F.regexp_instr(r, F.lit(K.REPORT_HEADING)).alias("cut")), of_cut))
    return F.struct(shortened(x["claim"]).alias("claim"), x["method"].alias("method"))  # outside, since Spark mixes up an aggregate within a lambda


def news_item(c: ColumnOrName, form: bool = True) -> Column:
    """A news file: title, body, agency named in its last line, texts, words, quality."""
    raw = strip(sub(text(c), r"\r\n|\r", "\n"))
    all_lines = F.transform(F.split(raw, "\n"), strip)
    filled = F.filter(F.transform(all_lines, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    first = F.try_element_at(filled, F.lit(1))
    title = F.coalesce(F.try_element_at(all_lines, first + 1), F.lit(""))
    body = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(all_lines, first + 2, F.greatest(F.size(all_lines) - first - 1, F.lit(0))))
    last = F.try_element_at(body, F.lit(-1))  # raw is stripped, so that the last line is not empty
    agency = mapped(key_ascii(sub(last, r"(?iU)^kaynak\s*:\s*", "")), K.SOURCE_ALIASES)
    kept = F.when(agency.isNotNull(), F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    content_raw, content = strip(F.array_join(body, "\n")), strip(F.array_join(kept, "\n"))
    full = squeeze(visible(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(content, F.lit(""))), form))
    words = F.regexp_count(full, F.lit(r"(?U)\b\w+\b"))
    return F.struct(
        title.alias("title_raw"), content_raw.alias("content_raw"), F.coalesce(agency, F.lit("unknown")).alias("source"), full.alias("text_basic"),
        F.length(full).alias("text_character_count"), words.alias("word_count"), F.when((F.length(full) < 50) | (words < 8), "review_required").otherwise("quality_candidate").alias("quality_status"),
        F.concat(F.lit("unicode_normalized;whitespace_normalized"), F.when(agency.isNotNull(), F.lit(";trailing_source_signature_removed")).otherwise("")).alias("cleaning_flags"),
    )


def domain(url: ColumnOrName) -> Column:
    """Host of an address, lowered, without www; ``unknown`` if there is none."""
    u = F.trim(text(url))
    host = F.try_parse_url(F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u)), F.lit("HOST"))
    return F.coalesce(F.nullif(sub(F.lower(host), r"^www\.", ""), F.lit("")), F.lit("unknown"))


def canonical_url(url: ColumnOrName) -> Column:
    """Host without www and path without a slash at its end; nothing else."""
    u = F.trim(text(url))
    full = F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = sub(F.lower(F.try_parse_url(full, F.lit("AUTHORITY"))), r"^www\.", "")
    path = sub(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(u == "", "").otherwise(F.coalesce(F.concat(host, path), sub(F.lower(F.translate(u, "Iİ", "ıi")), "/+$", "")))


def url_record_id(url: ColumnOrName, number: Column, prefix: str) -> Column:
    """prefix and the first 12 digits of the address's SHA-1, or the row number."""
    u = squeeze(text(url))
    return F.when(u != "", F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(u.cast("binary")), 1, 12))).otherwise(F.format_string(f"{prefix}_%06d", number))


def reference_text(summary: ColumnOrName, evidence: ColumnOrName) -> Column:
    """Summary and evidence under their headings, whichever there are."""
    s, e = squeeze(text(summary)), squeeze(text(evidence))
    return F.concat_ws("\n", F.when(s != "", F.concat(F.lit("Özet: "), s)), F.when(e != "", F.concat(F.lit("Kanıt: "), e)))


def parts_joined(*parts: Column) -> Column:
    """Distinct parts (case apart) in order, blank lines between them."""
    every = F.filter(F.array(*[squeeze(text(p)) for p in parts]), lambda x: x != "")
    seen = F.aggregate(every, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return F.array_join(seen, "\n\n")


def titled_text(title: ColumnOrName, body: ColumnOrName) -> Column:
    """Title and body on lines of their own, whichever there are."""
    return F.concat_ws("\n", F.nullif(squeeze(text(title)), F.lit("")), F.nullif(squeeze(text(body)), F.lit("")))


def is_false_label(c: ColumnOrName) -> Column:
    """Whether a label says false, with or without accents."""
    value = F.lower(F.trim(text(c)))
    return value.isin(*K.FALSE_LABELS) | F.translate(value, "ışğüöç", "isguoc").isin(*K.FALSE_LABELS)


def truth(c: ColumnOrName) -> Column:
    """A boolean that was written as text; null is false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*K.TRUE_TOKENS), F.lit(False))


def risk_view(label: ColumnOrName, other: str | None = None) -> Column:
    """fake and misleading are risky, real is real, the rest is ``other``."""
    return F.when(col(label).isin("fake", "misleading"), "risky").when(col(label) == "real", "real").otherwise(F.lit(other))


def label_number(c: ColumnOrName) -> Column:
    """0 for real, 1 for fake, from numbers, booleans or names; an error otherwise."""
    value = F.lower(F.trim(col(c).cast("string")))
    number = F.when(value.isin("0", "0.0", "real", "false", "gerçek", "gercek", "doğru", "dogru"), 0).when(value.isin("1", "1.0", "fake", "true", "sahte", "yanlış", "yanlis"), 1)
    return F.coalesce(number, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(value, F.lit("null")))).cast("int"))


def date_only(c: ColumnOrName) -> Column:
    """A lenient date as yyyy-MM-dd, null if it is none."""
    return F.date_format(F.try_to_timestamp(col(c)), "yyyy-MM-dd")


def year_of(c: ColumnOrName) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text(c), r"((?:19|20)\d{2})", 1), F.lit(""))
