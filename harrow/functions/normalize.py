"""Text normalizers. They differ in ways that change duplicate groups, so each is its own.

A null text counts as empty everywhere. Patterns are Unicode-aware. Compatibility
composition (NFKC) and decomposition have no built-in, so they are Arrow-batched
functions that pass texts through which already have the form; callers whose texts
are known to have it can leave them out with ``form=False``.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import constants as K

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnOrName) -> Column:
    """The text, empty if null."""
    return F.coalesce(col(c), F.lit(""))


def members(content: str) -> str:
    """The content of a character class, ``a-z`` a range, as Java tests it fastest.

    Java asks one predicate after the other for ranges and for characters above
    Latin-1, but looks single ones of Latin-1 up in a table. Others are asked for only
    where the character lies among them.
    """
    found = {chr(x) for a, b in re.findall(r"(?s)(.)(?:-(.))?", content) for x in range(ord(a), ord(b or a) + 1)}
    low, high = (sorted(c for c in found if (c > "\xff") == above) for above in (False, True))
    written = lambda chars: "".join(f"\\x{{{ord(c):X}}}" for c in chars)
    return written(low) + (f"[{written(high[:1])}-{written(high[-1:])}&&[{written(high)}]]" if high else "")


#: Unicode's white space as characters and as a character class's content.
WHITE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
WHITE = members(WHITE_CHARACTERS)
#: Letters of words, alone and with digits, as a character class's content.
LETTERS, WORD_CHARACTERS = members(K.TURKISH_LETTERS), members("0-9" + K.TURKISH_LETTERS)
#: The same words for Python.
WORD = f"[0-9{K.TURKISH_LETTERS}]+"


#: Texts of a batch that are Python's at once.
SLICE = 128


def in_slices(a: pa.Array, f: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``f`` of each text that is not null; few are Python's at once, the batch itself stays Arrow's."""
    parts = [pa.array([None if x is None else f(x) for x in a.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(a), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StringType())
def _nfkc(a: pa.Array) -> pa.Array:
    return in_slices(a, lambda x: x if unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x), pa.string())


@F.arrow_udf(T.StringType())
def _unmarked(a: pa.Array) -> pa.Array:
    return in_slices(a, lambda x: x if x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if unicodedata.category(ch) != "Mn"), pa.string())


@F.arrow_udf(T.StringType())
def _unescaped(a: pa.Array) -> pa.Array:
    return in_slices(a, lambda x: html.unescape(x) if "&" in x else x, pa.string())


def nfkc(c: ColumnOrName, form: bool = True) -> Column:
    """Compatibility composition; of a column given by name, plain ASCII has the form and stays in the JVM."""
    value = text(c)
    if not form:
        return value
    if not isinstance(c, str):  # an expression would be there four times
        return _nfkc(value)
    return F.coalesce(_nfkc(F.when(F.octet_length(value) != F.length(value), value)), value)


def unmarked(c: ColumnOrName) -> Column:
    """Letters without their marks."""
    return _unmarked(text(c))


def casefold(c: Column) -> Column:
    """Lower case with sharp s spelled out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(c, F.lit(WHITE_CHARACTERS))


def squeeze(c: Column) -> Column:
    return F.trim(sub(c, f"[{WHITE}](?:(?<! )[{WHITE}]*|(?<= )[{WHITE}]+)", " "))  # single spaces stay as they are


def only(c: Column, content: str) -> Column:
    """Runs of all but some characters, none of them white space, become one space; none at the ends."""
    return F.trim(sub(c, f"[^{members(content)}]+", " "))


def whitespace(c: ColumnOrName) -> Column:
    """Runs of white space become one space; none at the ends."""
    return squeeze(text(c))


def plain_spaces(c: ColumnOrName, form: bool = True) -> Column:
    """Hard spaces become spaces, zero-width characters go, NFKC, white space squeezed."""
    return squeeze(nfkc(sub(sub(text(c), " ", " "), "[​﻿]", ""), form))


def visible(c: ColumnOrName, form: bool = True, stripped: bool = True, newlines: bool = False) -> Column:
    """NFKC without format characters; optionally with Unix line ends."""
    out = sub(nfkc(c, form), r"\p{Cf}", "")
    out = sub(out, r"\r\n|\r", "\n") if newlines else out
    return strip(out) if stripped else out


def lines(c: ColumnOrName) -> Column:
    """Spaces squeezed within lines, none around line ends, at most one blank line."""
    return strip(sub(sub(sub(text(c), r"[ \t](?:(?<=\t)[ \t]*|[ \t]+)", " "), f"[{WHITE}]*\n[{WHITE}]*", "\n"), r"\n{3,}", "\n\n"))


def key_lower(c: ColumnOrName, form: bool = True) -> Column:
    """Duplicate key A: lower case, white space squeezed."""
    return squeeze(F.lower(nfkc(c, form)))


def key_numbers(c: ColumnOrName, form: bool = True) -> Column:
    """Duplicate key B: placeholders dropped, numbers alike, letters and digits only."""
    out = sub(F.lower(nfkc(c, form)), r"\p{Cf}", "")
    out = sub(sub(out, K.PLACEHOLDER, " "), K.NUMBER, " numtoken ")
    return only(out, f"0-9{K.TURKISH_LETTERS}")


def key_letters(c: ColumnOrName, form: bool = True, letters: str = "çğıöşüâîû<>", urls: bool = False) -> Column:
    """Duplicate key C: case folded, letters and digits only; optionally with one mark for every address."""
    out = sub(casefold(nfkc(c, form)), r"\p{Cf}", "")
    out = sub(out, K.URL, " <url> ") if urls else out
    return only(out, f"0-9a-z{letters}")


def key_claim(c: ColumnOrName, form: bool = True) -> Column:
    """Duplicate key D: addresses, mentions and brands dropped."""
    out = casefold(visible(c, form, newlines=True))
    for pattern in (K.URL, K.MENTION, K.CLAIM_BRAND):
        out = sub(out, pattern, " ")
    return only(out, f"0-9{K.TURKISH_LETTERS}")


def turkish_lower(c: ColumnOrName) -> Column:
    """Lower case with dotted and dotless i told apart."""
    return F.lower(F.translate(text(c), "Iİ", "ıi"))


def key_turkish(c: ColumnOrName, form: bool = True) -> Column:
    """Duplicate key E: Turkish lower case, claim prefix dropped, letters and digits only."""
    out = turkish_lower(nfkc(sub(sub(text(c), " ", " "), "[​﻿]", ""), form))
    out = sub(out, r"(?iU)^\s*iddia(?:\s*/\s*[^:]{1,60})?\s*:\s*", "")
    return only(out, "A-Za-zçğıöşü0-9")


def clean_claim(c: ColumnOrName, form: bool = True) -> Column:
    """A claim without its label and leading punctuation."""
    return strip(sub(sub(plain_spaces(c, form), K.CLAIM_LABEL, ""), r"(?U)^\s*[:\-–—]\s*", ""))


def key_cleaned_claim(c: ColumnOrName, form: bool = True) -> Column:
    """Duplicate key F: the cleaned claim, letters and digits only."""
    return only(F.lower(clean_claim(c, form)), "A-Za-zçğıöşü0-9")


def key_ascii(c: ColumnOrName) -> Column:
    """Letters without marks, case folded, ASCII letters and digits only."""
    return only(casefold(unmarked(c)), "a-z0-9")


def key_fact(c: ColumnOrName) -> Column:
    """A fact for containment tests: case folded, letters and digits only."""
    return only(casefold(text(c)), "0-9a-zçğıöşüâîû")


def key_comparison(c: ColumnOrName, form: bool = True) -> Column:
    """For phrase look-up: placeholders and all but word characters become spaces."""
    out = sub(F.lower(nfkc(c, form)), K.PLACEHOLDER, " ")
    return squeeze(sub(out, r"(?U)[^\wÇĞİÖŞÜçğıöşü]+", " "))


def folded(c: ColumnOrName, form: bool = True) -> Column:
    """Case folded, format characters dropped."""
    return sub(casefold(nfkc(c, form)), r"\p{Cf}", "")


def word_list(c: ColumnOrName, form: bool = True) -> Column:
    """The words of a text, case folded, format characters dropped."""
    return F.regexp_extract_all(folded(c, form), F.lit(f"([{WORD_CHARACTERS}]+)"), F.lit(1))


def key_words(c: ColumnOrName, form: bool = True) -> Column:
    """The words of a text joined by spaces."""
    return F.array_join(word_list(c, form), " ")


def article(c: ColumnOrName, form: bool = True) -> Column:
    """An article's text: entities, scripts, tags, addresses and white space settled."""
    out = _unescaped(visible(c, form)) if form else visible(c, form)
    out = sub(out, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    out = sub(out, r"<[^>]+>", " ")
    out = sub(sub(out, K.URL, " <URL> "), K.EMAIL, " <EMAIL> ")
    return squeeze(out)


#: Lengths that the service takes.
LEAST_REQUEST, MOST_REQUEST = 20, 100_000


def service(c: ColumnOrName) -> Column:
    """(text, status): a request's text, and ok or why it is refused."""
    out = squeeze(sub(sub(text(c), "[​-‍﻿]", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))
    status = (
        F.when(col(c).isNull(), "not_text").when(out == "", "empty").when(F.length(out) < LEAST_REQUEST, "too_short")
        .when(F.length(out) > MOST_REQUEST, "too_long").otherwise("ok")
    )
    return F.struct(out.alias("text"), status.alias("status"))


def page_text(c: ColumnOrName) -> Column:
    """Text of a page element: zero-width characters dropped, white space squeezed."""
    return squeeze(sub(text(c), "[​-‍﻿]", ""))
