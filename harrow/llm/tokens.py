"""Batch encoders over the public vocabulary files, with bounded caches per Python worker."""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and ids kept per worker; beyond that a cache starts afresh, so that memory stays bounded.
CACHE_WORDS, CACHE_IDS = 700_000, 4_000_000
#: Texts with one of these go through the whole tokenizer: characters that composition or lowering may
#: turn into others, and white space on which the splitters do not agree.
_ODD = r"[^\x00-\x{24F}]|[\x{130}\x{A0}\x{85}\x0b\x1c-\x1f]"
#: What the vocabulary file's pattern matches beside runs of letters: contractions, single digits, the rest.
_APART = r"('s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+|\p{N})"


#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _PRINTABLE else None for b in range(256)}
_BYTES.update({b: 256 + i for i, b in enumerate(b for b, c in _BYTES.items() if c is None)})


def public_path(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A tokenizer that takes the special tokens' strings in a text as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_bpe_encoder(json_path: str | None = None, rank_path: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids of the byte-level vocabulary.

    The rank file holds the same vocabulary as the JSON file and gives the same
    ids several times faster; a text that its pattern engine gives up on goes to
    the JSON file's tokenizer.
    """
    import base64

    import public_tokenizers
    import tiktoken

    json_path = json_path or public_path("byte_bpe_50k.json")
    with open(rank_path or public_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the engine's own panics are no Exception
            if not slow:
                slow.append(load_tokenizer(json_path))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


class WordEncoder:
    """Texts -> ids of a vocabulary that drops white space and merges within words.

    A batch is lowered, split and reduced to its distinct words by Arrow's kernels;
    only words that are new to the worker are encoded, and the ids are gathered.
    """

    def __init__(self, path: str | None = None):
        self.tokenizer = load_tokenizer(path or public_path("word_bpe_49k.json"))
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.n = self.used = 0
        self.length = np.zeros(1 << 16, np.int64)
        self.start = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def _keep(self, found: list[list[int]]) -> range:
        """Codes for some lists of ids."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, n = self.n, self.n + len(found)
        while n > len(self.length):
            self.length, self.start = np.resize(self.length, 2 * len(self.length)), np.resize(self.start, 2 * len(self.start))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + total] = list(chain.from_iterable(found))
        self.length[first:n] = sizes
        self.start[first:n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, self.used + total
        return range(first, n)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        if self.n > CACHE_WORDS or self.used > CACHE_IDS:
            self._reset()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        is_odd = pc.match_substring_regex(texts, _ODD)
        odd = np.flatnonzero(is_odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(is_odd, "", texts) if len(odd) else texts
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _APART, r" \1 "))
        words = split.flatten()
        filled = pc.not_equal(words, "")
        kept = filled.to_numpy(zero_copy_only=False)
        lists = split.offsets.to_numpy() - split.offsets[0].as_py()
        counts = np.diff(np.concatenate([[0], np.cumsum(kept)])[lists])
        coded = words.filter(filled).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        code, model = self.code, self.tokenizer.model
        new = [w for w in distinct if w not in code]
        if new:
            as_bytes = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_BYTES) for w in new]
            code.update(zip(new, self._keep([[t.id for t in model.tokenize(b)] for b in as_bytes]), strict=True))
        codes = np.fromiter(map(code.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        if len(odd):
            whole = self._keep([e.ids for e in self.tokenizer.encode_batch_fast([texts[int(i)].as_py() for i in odd], add_special_tokens=False)])
            codes = np.insert(codes, np.cumsum(counts)[odd], list(whole))
            counts[odd] = 1
        sizes = self.length[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.repeat(self.start[codes] - (ends - sizes), sizes) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[gather], np.diff(bounds)
