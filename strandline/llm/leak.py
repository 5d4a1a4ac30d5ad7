"""Held-out passages in a corpus (suffix arrays of corpus shards, searched by every passage suffix)."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.words import WORD, clean, coded_words, fold

#: Words of the shortest verbatim match that is looked at.
SEED = 4
#: Most words between matches that are chained, and most words that their places may shift by.
GAP, DRIFT = 25, 14
REGISTERS = 64
#: Words of a block of passages; the corpus is read twice for each block.
BLOCK_WORDS = 1_000_000
#: Words of a shard whose suffixes are sorted at once.
SHARD_WORDS = 1_500_000
#: Seeds whose registers travel in one row.
CELL_SEEDS = 64


class Passages:
    """Suffixes of a block of passages: word ids, the different seeds, and where each begins."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.items = [r[0] for r in rows]
        self.words: list[list[str]] = []
        self.spaced: list[np.ndarray] = []
        vocabulary: dict[str, int] = {}
        ids, item, at = [], [], []
        for k, (_, text) in enumerate(rows):
            text = clean(text)
            found = list(WORD.finditer(text))
            gaps = np.array([i for i, c in enumerate(text) if c.isspace() and i and not text[i - 1].isspace()], dtype=np.int64)
            words = [fold(m.group()) for m in found]
            self.words.append(words)
            self.spaced.append(np.searchsorted(gaps, [m.start() for m in found]))
            ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words] + [0] * SEED
            item += [k] * (len(words) + SEED)
            at += list(range(len(words) + SEED))
        self.vocabulary = vocabulary
        self.ids = np.array(ids + [0] * SEED, dtype=np.int64)
        self.item, self.at = np.array(item, dtype=np.int64), np.array(at, dtype=np.int64)
        self.salt = 0
        while True:  # until no two different seeds of these passages have one key
            keys, known = seed_keys(self.ids, self.salt)
            self.where = np.flatnonzero(known)
            self.keys, first, which = np.unique(keys[self.where], return_index=True, return_inverse=True)
            self.first = self.where[first]
            if all((self.ids[self.first[which] + k] == self.ids[self.where + k]).all() for k in range(SEED)):
                break
            self.salt += 1
        self.seed_of = np.full(len(self.ids), -1, dtype=np.int64)
        self.seed_of[self.where] = which
        self.bits = max(len(self.keys), 1).bit_length() + 6
        self.starts = np.searchsorted(self.item, np.arange(len(rows)))
        self.spaced_at = np.zeros(len(self.ids), dtype=np.int64)
        for start, s in zip(self.starts, self.spaced):
            self.spaced_at[start : start + len(s)] = s

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "filled"}

    def seeds(self, ids: np.ndarray) -> np.ndarray:
        """Which of the passages' seeds begins at each position, -1 where none. Keys are looked up, then the words compared."""
        if not len(self.keys) or len(ids) < SEED:
            return np.full(max(len(ids) - SEED + 1, 0), -1, dtype=np.int64)
        if "filled" not in self.__dict__:  # a set of key ends that tells most other keys at once
            self.filled = np.zeros(1 << self.bits, dtype=bool)
            self.filled[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        keys, known = seed_keys(ids, self.salt)
        out = np.full(len(keys), -1, dtype=np.int64)
        at = np.flatnonzero(known & self.filled[(keys >> np.uint64(64 - self.bits)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[i] == keys[at]
        for k in range(SEED):
            same &= self.ids[self.first[i] + k] == ids[at + k]
        out[at[same]] = i[same]
        return out


def seed_keys(ids: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of the ``SEED`` words from each position, and whether all of them are known (not 0)."""
    n = max(len(ids) - SEED + 1, 0)
    key, known = np.full(n, 0x9E3779B97F4A7C15 + salt, dtype=np.uint64), np.ones(n, dtype=bool)
    words = ids.astype(np.uint64)
    for k in range(SEED):
        key = (key ^ words[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        known &= ids[k : k + n] > 0
    return key * np.uint64(0x9E3779B97F4A7C15), known


def common_words(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, length: np.ndarray | int = 0) -> np.ndarray:
    """How many words from ``a`` in ``x`` and from ``b`` in ``y`` agree (0, which is between texts, never does), the first ``length`` known to."""
    length = np.zeros(len(a), dtype=np.int64) + length
    live = np.arange(len(a))
    while len(live):
        i, j = a[live] + length[live], b[live] + length[live]
        ok = (i < len(x)) & (j < len(y))
        live, i, j = live[ok], i[ok], j[ok]
        live = live[(x[i] == y[j]) & (y[j] > 0)]
        length[live] += 1
    return length


def suffix_array(ids: np.ndarray, at: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` in the order of all their words, and how many words each shares with the one before it.

    ``lead`` orders their first ``SEED`` words. Ties are parted by ever later words until no two suffixes are equal up to
    the end of a text or a word that no passage has; then by place.
    """
    order = np.lexsort((at, lead))
    at, tie = at[order], lead[order]
    start = np.append(True, tie[1:] != tie[:-1]) if len(at) else np.zeros(0, dtype=bool)
    depth, big = SEED, np.int64(ids.max(initial=0)) + 1
    while True:
        group = np.cumsum(start)
        same = ~start
        open_ = same | np.append(same[1:], False)  # suffixes still tied with another
        k = np.flatnonzero(open_)
        if not len(k):
            break
        one, two = (np.where(at[k] + depth + d < len(ids), ids[np.minimum(at[k] + depth + d, len(ids) - 1)], 0) for d in (0, 1))
        two = np.where(one > 0, two, 0)
        key = one * big + two
        turn = np.lexsort((at[k], key, group[k]))
        at[k], key = at[k[turn]], key[turn]
        part = np.append(True, (group[k][1:] != group[k][:-1]) | (key[1:] != key[:-1]))
        part |= key % big == 0  # ended: tied for ever, told apart by place
        start[k] = part
        depth += 2
    shared = np.zeros(len(at), dtype=np.int64)
    if len(at) > 1:
        near = np.flatnonzero(np.sort(lead)[1:] == np.sort(lead)[:-1]) + 1
        shared[near] = common_words(ids, at[near - 1], ids, at[near], SEED)
    return at, shared


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of ``values[lo:hi]`` for many ranges (none empty), from minima over powers of two."""
    tables, width = [values], 1
    longest = int((hi - lo).max(initial=1))
    while 2 * width <= longest:
        last = tables[-1]
        tables.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    out = np.empty(len(lo), dtype=values.dtype)
    level = np.frexp((hi - lo).astype(float))[1] - 1
    for k, t in enumerate(tables):
        i = np.flatnonzero(level == k)
        out[i] = np.minimum(t[lo[i]], t[hi[i] - (1 << k)])
    return out


def matches(ids: np.ndarray, p: Passages, rare_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches: positions in the passages and in the shard, and lengths.

    ``rare_at``: the passage suffixes that are searched, those that begin with a rare seed. The suffix array of the shard holds its
    suffixes that begin with one of their seeds (others share no ``SEED`` words with them) in full order. Every passage
    suffix finds its place by binary search; beside it lies the suffix that shares most words with it, and how many words
    the others share follows from those that neighbours in the array share. Matches are drawn out to the left too and given once.
    """
    none = np.empty(0, dtype=np.int64)
    test = p.where[rare_at[p.where]]
    if not len(test):
        return none, none, none
    wanted = np.zeros(len(p.keys) + 1, dtype=bool)
    wanted[p.seed_of[test]] = True
    which = p.seeds(ids)
    suffixes = np.flatnonzero(wanted[which])
    if not len(suffixes):
        return none, none, none
    suffixes, shared = suffix_array(ids, suffixes, which[suffixes])
    lead = which[suffixes]
    lo = np.searchsorted(lead, p.seed_of[test], side="left")
    hi = np.searchsorted(lead, p.seed_of[test], side="right")
    some = hi > lo
    test, lo, hi = test[some], lo[some], hi[some]
    # binary search of the first suffix in the array that is not below the passage's
    low, high = lo.copy(), hi.copy()
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            break
        mid = (low[live] + high[live]) // 2
        b, a = suffixes[mid], test[live]
        n = common_words(p.ids, a, ids, b, SEED)
        x = p.ids[np.minimum(a + n, len(p.ids) - 1)]
        y = np.where(b + n < len(ids), ids[np.minimum(b + n, len(ids) - 1)], 0)
        below = y < x
        low[live[below]] = mid[below] + 1
        high[live[~below]] = mid[~below]
    # words shared with the two suffixes beside the place, then with all that share a seed
    left, right = np.full(len(test), SEED, dtype=np.int64), np.full(len(test), SEED, dtype=np.int64)
    k = np.flatnonzero(low > lo)
    left[k] = common_words(p.ids, test[k], ids, suffixes[low[k] - 1], SEED)
    k = np.flatnonzero(low < hi)
    right[k] = common_words(p.ids, test[k], ids, suffixes[low[k]], SEED)
    n = hi - lo
    of = np.repeat(np.arange(len(test)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of]
    a, b, place = test[of], suffixes[j], low[of]
    length = np.where(j < place, left[of], right[of])
    far = np.flatnonzero((j < place - 1) | (j > place))
    if len(far):
        begin, end = np.where(j < place, j + 1, place + 1)[far], np.where(j < place, place, j + 1)[far]
        length[far] = np.minimum(length[far], _least(shared, begin, end))
    # a match whose words before agree too and begin with a searched suffix is part of that one's
    prior = (a > 0) & (b > 0) & (p.ids[a - 1] == ids[b - 1]) & (p.ids[a - 1] > 0)
    whole = ~(prior & rare_at[a - 1])
    a, b, length = a[whole], b[whole], length[whole]
    live = np.arange(len(a))
    while len(live):
        live = live[(a[live] > 0) & (b[live] > 0)]
        x, y = a[live] - 1, b[live] - 1
        live = live[(p.ids[x] == ids[y]) & (ids[y] > 0)]
        a[live] -= 1
        b[live] -= 1
        length[live] += 1
    _, one = np.unique(b * len(p.ids) + a, return_index=True)  # a match's length follows from its place
    return a[one], b[one], length[one]


@lru_cache(maxsize=1 << 18)
def alike(a: str, b: str) -> bool:
    """Equal, or the same word with characters changed."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2:
        return False
    # the ratio is at most that of the characters in common, which is cheap
    left = b
    for c in a:
        left = left.replace(c, "", 1)
    if 2 * (len(b) - len(left)) < 0.75 * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75


def drawn_out(passage: list[str], text: list[str], x: int, y: int, step: int) -> list[int]:
    """Passage words found from ``x`` and ``y`` on in the direction ``step`` while most of them agree; a word left out or put in shifts it by one."""
    found, missed, n, m = [], 0, len(passage), len(text)
    while 0 <= x < n and 0 <= y < m and missed < 3:
        missed += 1
        for dx, dy in ((0, 0), (0, step), (step, 0), (step, step), (0, 2 * step), (2 * step, 0)):
            i, j = x + dx, y + dy
            if 0 <= i < n and 0 <= j < m and alike(passage[i], text[j]) and (dx == dy == 0 or (0 <= i + step < n and 0 <= j + step < m and alike(passage[i + step], text[j + step]))):
                x, y, missed = i, j, 0
                found.append(i)
                break
        x, y = x + step, y + step
    return found


class WordShapes(dict):
    """Words numbered from 1 (0 stands between texts), with lengths and sets of characters."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = [""]
        self.size, self.chars = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def number(self, words: list[str]) -> np.ndarray:
        """The number of each word."""
        out = [self[w] for w in words]
        new = self.words[len(self.size) :]
        self.size = np.append(self.size, np.array([len(w) for w in new], dtype=np.int64))
        chars = np.zeros(len(new), dtype=np.uint64)
        for k, w in enumerate(new):
            m = 0
            for c in w:
                m |= 1 << (ord(c) & 63)
            chars[k] = m
        self.chars = np.append(self.chars, chars)
        return np.array(out, dtype=np.int64)

    def alike(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """:func:`alike` of words by number; pairs with too many characters that only one of them has are told without it."""
        out = (u == v) & (u > 0)
        size, other = self.size[u], self.size[v]
        k = np.flatnonzero(~out & (np.minimum(size, other) >= 4) & (np.abs(size - other) <= 2))
        size, other, a, b = size[k], other[k], self.chars[u[k]], self.chars[v[k]]
        common = np.minimum(size - np.bitwise_count(a & ~b), other - np.bitwise_count(b & ~a))
        k = k[8 * common >= 3 * (size + other)]
        out[k] = [alike(self.words[x], self.words[y]) for x, y in zip(u[k].tolist(), v[k].tolist())]
        return out


def reach(shapes: WordShapes, passages: np.ndarray, texts: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The last position that :func:`drawn_out` finds from each ``x`` and ``y``, for many at once (``x - step`` where none), and how many it finds."""
    x, y, best = x.copy(), y.copy(), x - step
    found, missed = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    live = np.arange(len(x))
    while len(live):
        live = live[(passages[x[live]] > 0) & (texts[y[live]] > 0)]
        missed[live] += 1
        rest = live
        for dx, dy in ((0, 0), (0, step), (step, 0), (step, step), (0, 2 * step), (2 * step, 0)):
            i, j = x[rest] + dx, y[rest] + dy
            ok = shapes.alike(passages[i], texts[j])
            if dx or dy:
                k = np.flatnonzero(ok)
                ok[k] = shapes.alike(passages[i[k] + step], texts[j[k] + step])
            got = rest[ok]
            x[got], y[got], best[got], missed[got] = i[ok], j[ok], i[ok], 0
            found[got] += 1
            rest = rest[~ok]
        x[live] += step
        y[live] += step
        live = live[missed[live] < 3]
    return best, found


def bands(pair: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, gap: int = GAP, drift: int = DRIFT) -> tuple[np.ndarray, np.ndarray]:
    """An order of the matches and where its bands begin; :func:`align` never chains matches of different bands.

    Matches of a band are of one pair; their diagonals have no step above ``drift`` and their passage words none above ``gap``.
    """
    slope = b - a
    order = np.lexsort((slope, pair))
    q, d = pair[order], slope[order]
    band = np.zeros(len(a), dtype=np.int64)
    band[order] = np.cumsum(np.append(False, (q[1:] != q[:-1]) | (d[1:] - d[:-1] > drift)))
    order = np.lexsort((a, band))
    q, x = band[order], a[order]
    wide = int((a + n).max()) + 1
    upto = np.maximum.accumulate(q * wide + x + n[order])[:-1] - q[:-1] * wide
    return order, np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (x[1:] - upto > gap)))


def align(passage: list[str], text: list[str], at: np.ndarray, to: np.ndarray, length: np.ndarray, gap: int = GAP, drift: int = DRIFT) -> tuple[int, int, np.ndarray]:
    """Best chain of matches, filled up and drawn out: the passage's span and which of its words are matched."""
    n = len(at)
    if n > 1:
        order = np.lexsort((to, at))
        at, to, length = at[order], to[order], length[order]
    score, back = length.astype(float), np.full(n, -1)
    for i in range(1, n):
        new = np.minimum(np.minimum(at[i] + length[i] - (at[:i] + length[:i]), to[i] + length[i] - (to[:i] + length[:i])), length[i])
        hop_p, hop_t = at[i] - (at[:i] + length[:i]), to[i] - (to[:i] + length[:i])
        ok = (new > 0) & (hop_p <= gap) & (hop_t <= gap + drift) & (np.abs((to[i] - at[i]) - (to[:i] - at[:i])) <= drift)
        if ok.any():
            total = np.where(ok, score[:i] + new - 0.1 * np.abs((to[i] - at[i]) - (to[:i] - at[:i])), -1)
            j = int(total.argmax())
            if total[j] > score[i]:
                score[i], back[i] = total[j], j
    i, chain = int(score.argmax()), []
    while i >= 0:
        chain.append(i)
        i = back[i]
    chain.reverse()
    hit = np.zeros(len(passage), dtype=bool)
    for c in chain:
        hit[at[c] : at[c] + length[c]] = True
    for c, d in zip(chain, chain[1:]):
        x, y = at[c] + length[c], to[c] + length[c]
        if at[d] - x == to[d] - y:
            for k in range(at[d] - x):
                hit[x + k] |= alike(passage[x + k], text[y + k])
        else:
            window = list(text[min(y, to[d]) : max(y, to[d])])
            for k in range(x, at[d]):
                w = next((v for v, t in enumerate(window) if alike(passage[k], t)), -1)
                if w >= 0:
                    hit[k] = True
                    window = window[w + 1 :]
    first, last = chain[0], chain[-1]
    before = drawn_out(passage, text, int(at[first]) - 1, int(to[first]) - 1, -1)
    after = drawn_out(passage, text, int(at[last] + length[last]), int(to[last] + length[last]), 1)
    hit[before + after] = True
    begin, end = before[-1] if before else int(at[first]), after[-1] + 1 if after else int(at[last] + length[last])
    return begin, end, hit


class Shard:
    """Texts of a shard as numbers of their different words, laid out with ``SEED`` places after each text."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words, self.codes, self.n = coded_words(texts)
        ends = np.cumsum(self.n)
        self.begins = ends - self.n
        self.starts = self.begins + SEED * np.arange(len(self.n))
        self.size = len(self.codes) + SEED * (len(self.n) + 1)
        self.place = np.arange(len(self.codes)) + SEED * np.repeat(np.arange(len(self.n)), self.n)

    def laid_out(self, number: np.ndarray) -> np.ndarray:
        """The numbers of the different words at the places of the texts, 0 between."""
        out = np.zeros(self.size, dtype=np.int64)
        if len(self.codes):
            out[self.place] = number[self.codes]
        return out

    def ids(self, p: Passages) -> np.ndarray:
        return self.laid_out(np.array([p.vocabulary.get(w, 0) for w in self.words], dtype=np.int64))

    def text(self, k: int) -> list[str]:
        return [self.words[c] for c in self.codes[self.begins[k] : self.begins[k] + self.n[k]].tolist()]

    def hashes(self) -> np.ndarray:
        """One number for each text's words in their order."""
        h = np.array([_hash64(w) for w in self.words], dtype=np.uint64)
        out = self.n.astype(np.uint64)
        if len(self.codes):
            at = np.arange(len(self.codes)) - np.repeat(self.begins, self.n)
            turn = np.cumprod(np.full(int(self.n.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
            some = np.flatnonzero(self.n)
            out[some] += np.add.reduceat(h[self.codes] * turn[at], self.begins[some])
        out = (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(29)


def _hash64(value: object) -> int:
    return xxhash.xxh3_64_intdigest(str(value))


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Tables of about ``SHARD_WORDS`` words."""
    held, size = [], 0
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            held.append(part)
            size += part.column(text).nbytes
            if size > 6 * SHARD_WORDS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _registers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register and rank of each hash."""
    above = hashes // np.uint64(REGISTERS)
    low = above & (~above + np.uint64(1))
    return (hashes % np.uint64(REGISTERS)).astype(np.int64), np.where(above > 0, np.log2(np.maximum(low, 1).astype(float)), 50).astype(np.uint8) + np.uint8(1)


def _distinct(regs: np.ndarray) -> np.ndarray:
    """Estimated number of different values behind each row of registers."""
    raw = 0.709 * REGISTERS**2 / (2.0 ** -regs.astype(float)).sum(axis=1)
    zeros = (regs == 0).sum(axis=1)
    return np.where((raw <= 2.5 * REGISTERS) & (zeros > 0), REGISTERS * np.log(REGISTERS / np.maximum(zeros, 1)), raw)


def seed_spread(df: DataFrame, text: str, group: str, p: Passages) -> tuple[np.ndarray, float]:
    """In how many different ``group`` values each seed of the passages occurs in the corpus, or in how many different
    texts where these are fewer, and how many there are.

    Counted over all rows with small mergeable registers (64 per seed and count), so versions in one group count once, and
    so do texts with the same words in many groups. Tasks send the registers of the seeds they met, ``CELL_SEEDS``
    seeds to a row; rows are merged by these, so with more passages more tasks merge, and the driver gets one number a seed.
    """
    width = 2 * REGISTERS
    every = len(p.keys)  # the last seed stands for all texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regs = np.zeros((every // CELL_SEEDS + 1) * CELL_SEEDS * width, dtype=np.uint8)
        for t in _shards(batches, 1):
            s = Shard(t.column(1).to_pylist())
            which = p.seeds(s.ids(p))
            at = np.flatnonzero(which >= 0)
            doc = np.searchsorted(s.starts, at, side="right") - 1
            of_group = np.array([_hash64(x) for x in t.column(0).to_pylist()], dtype=np.uint64)
            for first, h in ((0, of_group), (REGISTERS, s.hashes())):
                register, rank = _registers(h)
                np.maximum.at(regs, which[at] * width + first + register[doc], rank[doc])
                np.maximum.at(regs, every * width + first + register, rank)
        regs = regs.reshape(-1, CELL_SEEDS * width)
        met = np.flatnonzero(regs.any(axis=1))
        for a in range(0, len(met), 1000):
            part = met[a : a + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([regs[k].tobytes() for k in part], pa.binary())], names=["cell", "regs"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for b in batches:
            for row, x in zip(b.column(0).to_pylist(), b.column(1)):
                regs = np.frombuffer(x.as_py(), dtype=np.uint8)
                cells[row] = np.maximum(cells[row], regs) if row in cells else regs
        for row, regs in cells.items():
            n = _distinct(regs.reshape(-1, REGISTERS)).reshape(-1, 2).min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([n.tolist()], pa.list_(pa.float64()))], names=["cell", "n"])

    parts = df.select(group, text).mapInArrow(count, "cell long, regs binary").repartition("cell").mapInArrow(merge, "cell long, n array<double>")
    spread = np.zeros((every // CELL_SEEDS + 1) * CELL_SEEDS)
    for r in parts.toLocalIterator():  # a number for each seed of the block
        spread[r["cell"] * CELL_SEEDS : (r["cell"] + 1) * CELL_SEEDS] = r["n"]
    return spread[:every], float(spread[every])


def stock_runs(p: Passages, spread: np.ndarray, total: float, share: float, floor: float, times: float) -> np.ndarray:
    """Which passage positions begin a stock run: one in more than ``share`` of the rulings, more than ``floor``, and more
    than ``times`` as many as the rarest runs of its own passage (their twentieth part). So runs of a passage that as a whole is
    contained in very many rulings are no stock, but a formula within it is.
    """
    out = np.zeros(len(p.ids), dtype=bool)
    n = spread[p.seed_of[p.where]]
    out[p.where] = n > max(floor, share * total)
    for start, words in zip(p.starts, p.words):
        upto = start + max(len(words) - SEED + 1, 0)
        if out[start:upto].any():
            own = spread[p.seed_of[start:upto]]
            out[start:upto] &= own > times * np.quantile(own, 0.05)
    return out


def leak_candidates(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, group: str | None = None,
    stock_share: float = 0.01, stock_floor: float = 20, stock_times: float = 2, least_words: int = 1, least_matched: float = 0,
) -> DataFrame:
    """Aligned places of passages in texts: ``doc_id``, ``item_id``, ``n_words`` (span in the passage's words as parted
    by spaces), ``matched`` (share of the span's words found), ``rare`` (share of its rare seeds found), ``n_rare``,
    ``own`` (share found of its words that lie in no stock seed), ``n_own``, ``verbatim`` (words of the longest verbatim match). Every pair with a rare seed in common is
    aligned unless it can't span ``least_words`` with ``least_matched`` of them found; shorter spans are left out.

    See :func:`leaked_passages`.
    """
    rows = sorted((r[0], r[1] or "") for r in items.select(item_id, passage).where(F.col(item_id).isNotNull()).distinct().toLocalIterator())
    blocks, size = [[]], 0
    for r in rows:
        n = len(r[1].split())
        if size + n > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += n
    figures = [("n_words", T.LongType()), ("matched", T.DoubleType()), ("rare", T.DoubleType()), ("n_rare", T.LongType()), ("own", T.DoubleType()), ("n_own", T.LongType()), ("verbatim", T.LongType())]
    out = T.StructType([docs.schema[doc_id], items.schema[item_id], *[T.StructField(*f) for f in figures]])
    found = None
    for block in blocks:
        p = Passages(block)
        kind = "group_key"
        keyed = docs.select(F.col(doc_id), F.col(text), F.coalesce(F.col(group).cast("string"), F.concat(F.lit("doc "), F.col(doc_id).cast("string"))).alias(kind) if group else F.col(doc_id).cast("string").alias(kind))
        spread, total = seed_spread(keyed, text, kind, p)
        stock_at = stock_runs(p, spread, total, stock_share, stock_floor, stock_times)

        def search(batches: Iterator[pa.RecordBatch], p: Passages = p, stock_at: np.ndarray = stock_at) -> Iterator[pa.RecordBatch]:
            rare_at = np.zeros(len(p.ids), dtype=bool)
            rare_at[p.where] = ~stock_at[p.where]
            own_at = p.ids > 0  # words in no stock run
            for k in range(SEED):
                own_at[np.flatnonzero(stock_at) + k] = False
            shapes, numbers = WordShapes(), None
            for t in _shards(batches, 1):
                s = Shard(t.column(1).to_pylist())
                a, b, n = matches(s.ids(p), p, rare_at)
                if not len(a):
                    continue
                doc = np.searchsorted(s.starts, b, side="right") - 1
                item = p.item[a]
                pair = doc * len(p.items) + item
                order = np.argsort(pair, kind="stable")
                pair, a, b, n = (x[order] for x in (pair, a, b, n))
                at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                ends = np.append(at[1:], len(pair))
                # no alignment spans more than from the first to the last word found from any match of a band
                if numbers is None or len(shapes) > 2_000_000:
                    shapes = WordShapes()
                    numbers = np.append(np.concatenate([np.append(shapes.number(w), [0] * SEED) for w in p.words]), [0] * SEED).astype(np.int64)
                there = s.laid_out(shapes.number(s.words))
                by_band, first = bands(pair, a, b, n)
                before, n_before = reach(shapes, numbers, there, a - 1, b - 1, -1)
                after, n_after = reach(shapes, numbers, there, a + n, b + n, 1)
                begins, lasts = np.minimum.reduceat(before[by_band], first), np.maximum.reduceat(after[by_band], first)
                long = p.spaced_at[lasts] - p.spaced_at[begins] + 1 >= least_words
                # where a band is a single match, the share of words found is known too
                alone = np.flatnonzero(np.diff(np.append(first, len(a))) == 1)
                m = by_band[first[alone]]
                long[alone] &= (n_before + n + n_after)[m] / (after - before + 1)[m] >= least_matched
                long = pair[by_band[first[long]]]
                kept = np.isin(pair[at], long)
                at, ends = at[kept], ends[kept]
                hits = []
                for i, j in zip(at.tolist(), ends.tolist()):
                    d, k = divmod(int(pair[i]), len(p.items))
                    base = p.starts[k]
                    words = p.words[k]
                    begin, end, hit = align(words, s.text(d), a[i:j] - base, b[i:j] - s.starts[d], n[i:j])
                    spaced = p.spaced[k]
                    n_words = int(spaced[end - 1] - spaced[begin] + 1)
                    if n_words < least_words:
                        continue
                    in_span = np.flatnonzero(rare_at[base + begin : base + max(end - SEED + 1, begin)]) + begin
                    n_rare = sum(bool(hit[s : s + SEED].all()) for s in in_span)
                    own = hit[begin:end][own_at[base + begin : base + end]]
                    hits.append((d, k, n_words, float(hit[begin:end].mean()), n_rare / max(len(in_span), 1), n_rare, float(own.mean()) if len(own) else 0.0, int(own.sum()), int(n[i:j].max())))
                if hits:
                    cols = list(zip(*hits))
                    ids_out = t.column(0).combine_chunks().take(pa.array(cols[0]))
                    arrays = [pa.array(c, pa.int64() if isinstance(f[1], T.LongType) else pa.float64()) for c, f in zip(cols[2:], figures)]
                    yield pa.RecordBatch.from_arrays([ids_out.combine_chunks() if isinstance(ids_out, pa.ChunkedArray) else ids_out, pa.array([p.items[k] for k in cols[1]]), *arrays], names=out.names)

        part = docs.select(doc_id, text).mapInArrow(search, out)
        found = part if found is None else found.unionByName(part)
    return found


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, group: str | None = None,
    least_words: int = 29, least_matched: float = 0.8, least_rare: float = 0.45, least_seeds: int = 12, least_own: float = 0.83,
    stock_share: float = 0.01, stock_floor: float = 20, stock_times: float = 2,
) -> DataFrame:
    """Pairs of a text and a held-out passage that it contains, wholly or in part: distinct ``doc_id``, ``item_id`` with the
    figures of :func:`leak_candidates`.

    Texts and passages are compared by words, without case, accents, markup, layout and characters that were coded
    twice. A first pass over the corpus counts in how many different ``group`` values (rulings, not their versions)
    each run of four passage words occurs, or in how many different texts if fewer; :func:`stock_runs` tells from this which
    runs are stock. A second pass builds the suffix array of each shard, of the suffixes that begin with another run,
    places every passage suffix in it by binary search and gets the longest match of each with every text, see :func:`matches`. The matches of a
    pair, be it a single one, are then aligned: chained, filled up over altered words and drawn out at the ends. A pair counts where the
    aligned part spans ``least_words`` words of the passage (one below the stated 30, as an altered first or last word
    can't be seen), most of its words agree and so do its rare runs, or ``least_own`` of its words that are in no stock
    run, as few replaced words break many runs; this tells it from stock formulas and from other texts made after the
    same patterns, whose words between the formulas differ. A passage contained as a whole in very many rulings is found in all
    of them; a mere part of one that more than ``stock_share`` of the rulings have is a phrase that many rulings use.

    Null and empty texts or passages match nothing; rows without id give a null id. Repeated rows give one pair.
    Passages are held in blocks of bounded size, each block sent to all tasks, and the corpus is read once per pass
    and block; whole texts are read, and no text is ever shuffled.
    """
    c = leak_candidates(docs, items, doc_id, text, item_id, passage, group, stock_share, stock_floor, stock_times, least_words, least_matched)
    runs = (F.col("rare") >= least_rare) & (F.col("n_rare") >= least_seeds)
    words = (F.col("own") >= least_own) & (F.col("n_own") >= least_seeds + SEED - 1)  # as many as so many runs hold
    keep = c.where((F.col("n_words") >= least_words) & (F.col("matched") >= least_matched) & (runs | words))
    return keep.groupBy(doc_id, item_id).agg(F.max("n_words").alias("n_words"), F.max("matched").alias("matched"), F.max("rare").alias("rare"), F.max("n_rare").alias("n_rare"), F.max("verbatim").alias("verbatim"))


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str) -> DataFrame:
    """The corpus without the affected texts (rows without id stay)."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
