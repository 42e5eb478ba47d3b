"""Adaptive context-mixing range coder for token ids.

A block of ids is cut into lanes that are coded in lockstep, one id of each lane
per step, so that every step is a handful of array operations. The model is
shared by a block's lanes, starts empty and learns from each step in turn:

* order 0: frequencies of the ids so far, rebuilt on a fixed schedule;
* order 1: the id expected after the last one, with a confidence;
* order 2: the id expected after the last two, with a confidence.

The three are mixed linearly, with weights from the hit rates that each
confidence has had so far in the block. The interval of an id then drives a
48-bit range coder with 16-bit output words, carries being settled at the end.

Block: magic, then as little-endian unsigned 32-bit numbers the vocabulary size,
number of ids, lanes and crc32 of what follows; words per lane (u4 each), words
(u2 each), lane by lane. Blocks hold no state of each other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR1"
_HEAD = struct.Struct("<4sIIII")
#: Lanes of a large block, and ids in a lane of a small one.
LANES, LEAST_STEPS = 8192, 64
_T0 = 20  # order-0 frequencies add up to 1 << _T0
_SCALE = 24  # and a mix to 1 << _SCALE or a little less
_BITS2 = 18  # log2 of the order-2 contexts
_U = np.uint64


#: Confidence after a miss or a hit, at 2 * confidence + hit; 8 means that nothing is expected yet.
_NEXT = np.array([0, 1, 0, 2, 1, 3, 1, 4, 2, 5, 2, 6, 3, 7, 3, 7, 0, 0], np.int32)
#: Whether a miss at this confidence puts a new id in place.
_TAKES = np.array([True, False, *[False] * 14, True, True])


class _Context:
    """Expected ids and confidences of one order, and the hit rate of each confidence."""

    def __init__(self, size: int):
        self.state = np.full(size, (-1 << 4) | 8, np.int32)
        self.hits, self.all = np.full(9, 0.5), np.full(9, 2.0)
        self._weigh()

    def _weigh(self) -> None:
        self.weight = (self.hits / self.all * (1 << _SCALE)).astype(np.int32)
        self.weight[8] = 0

    def look(self, at: np.ndarray) -> None:
        self.at = at
        found = self.state[at]
        self.guess, self.conf = found >> 4, found & 15
        self.w = self.weight[self.conf]

    def learn(self, ids: np.ndarray) -> None:
        case = 2 * self.conf + (self.guess == ids)
        self.state[self.at] = (np.where(_TAKES[case], ids, self.guess) << 4) | _NEXT[case]
        n = np.bincount(case, minlength=18).reshape(9, 2)
        self.hits += n[:, 1]
        self.all += n.sum(axis=1)
        self._weigh()


class _Model:
    def __init__(self, vocabulary: int):
        assert 0 < vocabulary < 1 << (_T0 - 1)
        self.v, self.seen, self.next, self.step = vocabulary, 0, 0, 0
        self.count, self.recent = np.zeros(vocabulary, np.int64), []
        self.one, self.two = _Context(vocabulary + 1), _Context(1 << _BITS2)
        self._rebuild()

    def _rebuild(self) -> None:
        if self.recent:
            late = np.concatenate(self.recent)
            self.count += np.bincount(late, minlength=self.v)
            self.seen += len(late)
            self.recent = []
        spare = (1 << _T0) - self.v
        freq = 1 + self.count * spare // self.seen if self.seen else np.full(self.v, 1 + spare // self.v)
        freq[int(np.argmax(freq))] += (1 << _T0) - int(freq.sum())
        self.cum = np.zeros(self.v + 1, np.int32)
        np.cumsum(freq, out=self.cum[1:])
        self.freq = freq.astype(np.int32)
        self.of: np.ndarray | None = None

    def inverse(self) -> np.ndarray:
        """The id at each point of the order-0 scale."""
        if self.of is None:
            self.of = np.repeat(np.arange(self.v, dtype=np.uint16 if self.v < 1 << 16 else np.int32), self.freq)
        return self.of

    def predict(self, last: np.ndarray, before: np.ndarray):
        """Guesses and integer weights for lanes with these two last ids."""
        self.one.look(last)
        self.two.look((last.view(np.uint32) * np.uint32(0x2545F491) + before.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS2))
        w2 = self.two.w
        half = _SCALE // 2  # products stay within 32 bits
        w1 = (((1 << _SCALE) - w2) >> half) * (self.one.w >> half)
        a = np.maximum(np.int32(1), ((1 << _SCALE) - w1 - w2) >> _T0)
        return self.one.guess, self.two.guess, w1, w2, a, (a << _T0) + w1 + w2

    def interval(self, x: np.ndarray, g1: np.ndarray, g2: np.ndarray, w1: np.ndarray, w2: np.ndarray, a: np.ndarray):
        """Start and width of each lane's id on its lane's scale."""
        return a * self.cum[x] + w1 * (x > g1) + w2 * (x > g2), a * self.freq[x] + w1 * (x == g1) + w2 * (x == g2)

    def update(self, ids: np.ndarray) -> None:
        self.step += 1
        self.one.learn(ids)
        self.two.learn(ids)
        self.recent.append(ids)
        if self.step >= self.next:
            self._rebuild()
            self.next = self.step + min(64, max(1, self.step // 2))


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    steps = -(-n // lanes) if n else 0
    return (-(-n // steps) if n else 0), steps


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One self-contained block."""
    n = len(ids)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    assert n == 0 or (grid.min() >= 0 and grid.max() < vocabulary), "an id is out of the vocabulary"
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T) if n else grid.reshape(0, 0)
    model = _Model(vocabulary)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 48) - 1, _U)
    words = np.zeros((lanes, 2 * steps + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    last = before = np.full(lanes, vocabulary, np.int32)
    for t in range(steps):
        active = min(lanes, -(-(n - t) // steps))
        x = grid[t, :active]
        last, before = last[:active], before[:active]
        g1, g2, w1, w2, a, total = model.predict(last, before)
        c, f = model.interval(x, g1, g2, w1, w2, a)
        r = (rng[:active] / total).astype(_U)  # below 2^48 a double's quotient has the exact floor
        low[:active] += r * c.astype(_U)
        rng[:active] = r * f.astype(_U)
        for _ in range(2):
            small = np.flatnonzero(rng[:active] < _U(1 << 32))
            if not len(small):
                break
            words[small, used[small]] = (low[small] >> _U(32)).astype(np.uint32)
            used[small] += 1
            low[small] = (low[small] & _U(0xFFFFFFFF)) << _U(16)
            rng[small] <<= _U(16)
        model.update(x)
        last, before = x, last
    if lanes:
        words[np.arange(lanes), used] = ((low + _U(0xFFFFFFFF)) >> _U(32)).astype(np.uint32)  # a point within the last range
        used += 1
        for i in range(int(used.max()) - 1, 0, -1):
            words[:, i - 1] += words[:, i] >> 16
        words &= 0xFFFF
    body = used.astype("<u4").tobytes() + words[np.arange(words.shape[1]) < used[:, None]].astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, vocabulary, n, lanes, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ``ValueError`` if it is damaged."""
    magic, vocabulary, n, lanes, crc = _HEAD.unpack_from(block)
    body = block[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    if not n:
        return np.zeros(0, np.int32)
    steps = -(-n // lanes)
    used = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    flat = np.frombuffer(body, "<u2", offset=4 * lanes).astype(np.uint64)
    words = np.zeros((lanes, int(used.max()) + 5), _U)
    words[np.arange(words.shape[1]) < used[:, None]] = flat
    model = _Model(vocabulary)
    code = (words[:, 0] << _U(32)) | (words[:, 1] << _U(16)) | words[:, 2]
    rng, at = np.full(lanes, (1 << 48) - 1, _U), np.full(lanes, 3, np.int64)
    out = np.zeros((steps, lanes), np.int32)
    last = before = np.full(lanes, vocabulary, np.int32)
    limit = words.shape[1] - 1
    for t in range(steps):
        active = min(lanes, -(-(n - t) // steps))
        last, before = last[:active], before[:active]
        g1, g2, w1, w2, a, total = model.predict(last, before)
        cum, freq, of = model.cum, model.freq, model.inverse()
        r = (rng[:active] / total).astype(_U)  # below 2^48 a double's quotient has the exact floor
        v = np.minimum((code[:active] / r).astype(np.int32), total - 1)
        # Where the two guesses lie on this lane's scale; a missing guess has weight 0.
        s1, s2 = np.maximum(g1, 0), np.maximum(g2, 0)
        from1 = a * cum[s1] + w2 * (s1 > g2)
        from2 = a * cum[s2] + w1 * (s2 > g1)
        to1 = from1 + a * freq[s1] + w1 + w2 * (s1 == g2)
        to2 = from2 + a * freq[s2] + w2 + w1 * (s2 == g1)
        u = v - w1 * (v >= to1) - w2 * (v >= to2)
        x = of[np.minimum((u / a).astype(np.int32), (1 << _T0) - 1)].astype(np.int32)
        x = np.where((g1 >= 0) & (v >= from1) & (v < to1), g1, x)
        x = np.where((g2 >= 0) & (v >= from2) & (v < to2), g2, x)
        c, f = model.interval(x, g1, g2, w1, w2, a)
        code[:active] -= r * c.astype(_U)
        rng[:active] = r * f.astype(_U)
        for _ in range(2):
            small = np.flatnonzero(rng[:active] < _U(1 << 32))
            if not len(small):
                break
            code[small] = (code[small] << _U(16)) | words[small, np.minimum(at[small], limit)]
            at[small] += 1
            rng[small] <<= _U(16)
        model.update(x)
        out[t, :active] = x
        last, before = x, last
    return np.ascontiguousarray(out.T).reshape(-1)[:n]
