"""Controlled edits of one fact in a text, and token differences, as Arrow-batched functions.

An edit is chosen by a generator seeded from the record id, so that a run can be
repeated anywhere and in any order.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable
from difflib import Match, SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import constants as K
from harrow.functions.normalize import ColumnOrName, casefold, text
from harrow.functions.structs import struct_of

# What an edit may change, and by how much.
PERCENT = ((r"(?i)\b(yüzde)\s+(\d{1,3}(?:[.,]\d+)?)", 2), (r"(?<!\w)%\s*(\d{1,3}(?:[.,]\d+)?)", 1), (r"\b(\d{1,3}(?:[.,]\d+)?)\s*%", 1))
MONEY = r"(?i)\b(\d+(?:[.,]\d+)?)\s*(bin|milyon|milyar)?\s*(TL|Türk lirası|lira|₺|dolar|euro|avro)\b"
DATE = r"(?i)\b([0-3]?\d)\s+(" + "|".join(K.MONTHS) + r")(?:\s+((?:19|20)\d{2}))?\b"
TIME = r"\b([01]?\d|2[0-3])[:.]([0-5]\d)\b"
YEAR = r"\b((?:19|20)\d{2})\b"
CITY = r"(?i)\b(" + "|".join(K.CITIES) + r")\b"
NUMBER = r"\b(\d{2,7})\b"
PERCENT_STEPS, FACTORS, DAY_STEPS, HOUR_STEPS, YEAR_STEPS = (-25, -15, -10, 10, 15, 25), (0.5, 2, 3, 5), (-10, -7, -3, 3, 7, 10), (2, 3, 5, 7), (-5, -3, -2, -1, 1, 2, 3, 5)
FIRST_YEAR, LAST_YEAR = 1900, 2026

EDIT_SCHEMA = "text string, edit_type string, original_fact string, modified_fact string, edit_context string"
Edit = tuple[str, str, str, str, str]


def format_number(value: float, like: str) -> str:
    """A number written like another: whole, or with one decimal and its decimal mark."""
    if "," not in like and "." not in like:
        return str(max(1, round(value)))
    out = f"{max(0.1, value):.1f}"
    return out.replace(".", ",") if "," in like else out


def _put(source: str, m: re.Match, group: int, new: str, kind: str, whole: bool = False, fact: str | None = None) -> Edit:
    start, end = m.span(group)
    changed = source[:start] + new + source[end:]
    a, b = m.span()
    before, after = (m[0], fact or changed[a : b + len(new) - (end - start)]) if whole else (m[group], new)
    return changed, kind, before, after, source[max(0, a - 100) : b + 100].replace("\n", " ")


def percentage(source: str, rng: random.Random) -> Edit | None:
    kinds = list(PERCENT)
    rng.shuffle(kinds)
    for pattern, group in kinds:
        m = re.search(pattern, source)
        if m:
            steps = list(PERCENT_STEPS)
            rng.shuffle(steps)
            value = float(m[group].replace(",", "."))
            fits = [value + s for s in steps if 0 <= value + s <= 100]
            if fits:
                return _put(source, m, group, format_number(fits[0], m[group]), "percentage_change")
    return None


def money(source: str, rng: random.Random) -> Edit | None:
    m = re.search(MONEY, source)
    return m and _put(source, m, 1, format_number(float(m[1].replace(",", ".")) * rng.choice(FACTORS), m[1]), "money_change", whole=True)


def date(source: str, rng: random.Random) -> Edit | None:
    m = re.search(DATE, source)
    return m and _put(source, m, 1, str((int(m[1]) - 1 + rng.choice(DAY_STEPS)) % 28 + 1), "date_change", whole=True)


def time(source: str, rng: random.Random) -> Edit | None:
    m = re.search(TIME, source)
    if not m:
        return None
    hour = f"{(int(m[1]) + rng.choice(HOUR_STEPS)) % 24:02d}"
    return _put(source, m, 1, hour, "time_change", whole=True, fact=f"{hour}:{m[2]}")


def year(source: str, rng: random.Random) -> Edit | None:
    found = list(re.finditer(YEAR, source))
    if not found:
        return None
    m = rng.choice(found)
    new = int(m[1]) + rng.choice(YEAR_STEPS)
    return _put(source, m, 1, str(new), "year_change") if FIRST_YEAR <= new <= LAST_YEAR else None


def city(source: str, rng: random.Random) -> Edit | None:
    found = list(re.finditer(CITY, source))
    if not found:
        return None
    m = rng.choice(found)
    return _put(source, m, 1, rng.choice([c for c in K.CITIES if c.casefold() != m[1].casefold()]), "location_change")


def number(source: str, rng: random.Random) -> Edit | None:
    found = [m for m in re.finditer(NUMBER, source) if not FIRST_YEAR <= int(m[1]) <= LAST_YEAR]
    if not found:
        return None
    m = rng.choice(found)
    new = max(1, round(int(m[1]) * rng.choice(FACTORS)))
    return _put(source, m, 1, str(new + 7 if new == int(m[1]) else new), "number_change")


#: In this order before they are shuffled.
EDITS: tuple[Callable[[str, random.Random], Edit | None], ...] = (percentage, money, date, time, city, year, number)


def counterfactual(source: str | None, record_id: str | None) -> Edit | None:
    """The first edit that succeeds, in an order that the record id seeds."""
    rng = random.Random(int.from_bytes(hashlib.blake2b(str(record_id).encode(), digest_size=8).digest(), "big"))
    kinds = list(EDITS)
    rng.shuffle(kinds)
    for kind in kinds:
        out = kind(source or "", rng)
        if out and out[0] != source:
            return out
    return None


@F.pandas_udf(struct_of(EDIT_SCHEMA))
def counterfactual_udf(source: pd.Series, record_id: pd.Series) -> pd.DataFrame:
    rows = [counterfactual(t, r) or (None,) * 5 for t, r in zip(source, record_id, strict=True)]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in EDIT_SCHEMA.split(", ")], dtype="object")


def is_sensitive(c: ColumnOrName) -> Column:
    """Whether a text names a topic that is not to be edited."""
    value = casefold(text(c))
    out = F.lit(False)
    for term in K.SENSITIVE_TERMS:
        out = out | F.contains(value, F.lit(term.casefold()))
    return out


def has_fact(c: ColumnOrName) -> Column:
    """Whether a text has a fact that some edit could change."""
    value = text(c)
    patterns = [*(p for p, _ in PERCENT), MONEY, DATE, TIME, YEAR, CITY, NUMBER]
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike("(?U)" + p)
    return out


DIFF_SCHEMA = "similarity double, changed_tokens int, removed_tokens int, added_tokens int, change_ratio double, operations array<string>, removed array<string>, added array<string>, contexts array<string>"
_TOKEN = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")
_TIGHT_LEFT, _TIGHT_RIGHT = ".,:;!?%)]}…", "([{"


def join_tokens(tokens: list[str]) -> str:
    """Tokens as text, without spaces where punctuation has none."""
    out = " ".join(tokens)
    for mark in _TIGHT_LEFT:
        out = out.replace(f" {mark}", mark)
    for mark in _TIGHT_RIGHT:
        out = out.replace(f"{mark} ", mark)
    return out.replace(" ’ ", "’").replace(" ' ", "'")


def tokens_of(source: str | None) -> list[str]:
    """Words and punctuation marks."""
    return _TOKEN.findall((source or "").replace("\r", " ").replace("\n", " "))


class TokenMatcher(SequenceMatcher):
    """``SequenceMatcher`` without junk, with the same blocks; where equal tokens would meet in too many pairs, by tables.

    ``SequenceMatcher`` visits each pair of equal tokens, which is quadratic in a long
    text. The tables number the windows of 1, 2, 4, ... tokens, so that windows of any
    length are equal where two numbers are, and the longest length that both sides share
    is found by bisection.
    """

    #: Pairs of equal tokens up to which they are visited.
    FEW = 50_000

    def __init__(self, a: list[str], b: list[str]) -> None:
        super().__init__(None, a, b, autojunk=False)
        self._met = np.concatenate(([0], np.cumsum([len(self.b2j.get(t, ())) for t in a], dtype=np.int64)))
        self._levels: list[np.ndarray] = []

    def _windows(self, size: int) -> tuple[np.ndarray, int]:
        """Numbers of the windows of 2^k tokens, the most that ``size`` holds, over both texts; and how far the second one starts."""
        if not self._levels:
            numbers: dict[str, int] = {}
            self._levels.append(np.array([numbers.setdefault(t, len(numbers)) for t in [*self.a, *self.b]], np.int64))
        k = size.bit_length() - 1
        while len(self._levels) <= k:
            last, half = self._levels[-1], 1 << (len(self._levels) - 1)
            self._levels.append(np.unique(last[:-half] * (len(self.a) + len(self.b)) + last[half:], return_inverse=True)[1].astype(np.int64))
        return self._levels[k], size - (1 << k)

    def _shared(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
        """The first starts of windows of ``size`` tokens that both ranges share."""
        numbers, step = self._windows(size)
        n, every = len(self.a), len(self.a) + len(self.b)
        of = lambda lo, hi: numbers[lo : hi - size + 1] * every + numbers[lo + step : hi - size + 1 + step]
        mine, theirs = of(alo, ahi), of(n + blo, n + bhi)
        both = np.isin(mine, theirs)
        i = int(both.argmax())
        return (alo + i, blo + int((theirs == mine[i]).argmax())) if both[i] else None

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if self._met[ahi] - self._met[alo] <= self.FEW:
            return super().find_longest_match(alo, ahi, blo, bhi)
        a, b = self.a, self.b
        most, head, tail = min(ahi - alo, bhi - blo), 0, 0
        while head < most and a[alo + head] == b[blo + head]:
            head += 1
        while tail < most and a[ahi - 1 - tail] == b[bhi - 1 - tail]:
            tail += 1
        low, high, step = max(head, tail), most + 1, 1  # shared, and more than is shared
        while low + step < high and self._shared(low + step, alo, ahi, blo, bhi):
            low, step = low + step, 2 * step
        high = min(high, low + step)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._shared(middle, alo, ahi, blo, bhi) else (low, middle)
        i, j = self._shared(low, alo, ahi, blo, bhi) if low else (alo, blo)
        return Match(i, j, low)


def difference(a: str | None, b: str | None, around: int = 8, contexts: int = 5) -> tuple:
    """Ratcliff-Obershelp similarity of two texts' tokens, and what differs."""
    x, y = tokens_of(a), tokens_of(b)
    match = TokenMatcher(x, y)
    changed = removed = added = 0
    kinds, gone, new, near = [], [], [], []
    for kind, i, j, k, m in match.get_opcodes():
        if kind == "equal":
            continue
        kinds.append(kind)
        changed += max(j - i, m - k)
        removed += j - i
        added += m - k
        if j > i:
            gone.append(join_tokens(x[i:j]))
        if m > k:
            new.append(join_tokens(y[k:m]))
        if len(near) < contexts:
            near.append(f"{join_tokens(x[max(0, i - around) : j + around])} → {join_tokens(y[max(0, k - around) : m + around])}")
    return match.ratio(), changed, removed, added, changed / max(len(x), len(y), 1), kinds, gone, new, near


@F.pandas_udf(struct_of(DIFF_SCHEMA))
def difference_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([difference(x, y) for x, y in zip(a, b, strict=True)], columns=[x.split()[0] for x in DIFF_SCHEMA.split(", ")])


def folded_difference(a: str | None, b: str | None) -> tuple[float, int]:
    """Similarity and number of changed tokens of two texts' words, case folded."""
    word = re.compile(f"[0-9{K.TURKISH_LETTERS}]+")
    match = TokenMatcher([t.casefold() for t in word.findall(a or "")], [t.casefold() for t in word.findall(b or "")])
    return match.ratio(), sum(max(j - i, m - k) for kind, i, j, k, m in match.get_opcodes() if kind != "equal")


@F.pandas_udf(struct_of("similarity double, changed int"))
def folded_difference_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([folded_difference(x, y) for x, y in zip(a, b, strict=True)], columns=["similarity", "changed"])
