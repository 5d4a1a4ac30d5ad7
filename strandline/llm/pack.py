"""Filling fixed-capacity containers (configuration linear program over the length histogram)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandline.runtime import column_numpy, materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer of the vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one length whose ranks are counted in one task.
RANK_ROWS = 5_000_000


@dataclass
class Packing:
    """Container patterns: how many items of each length, and how often the pattern is used.

    ``lp_value``: containers of the fractional packing; ``lp_bound``: no packing has fewer; ``from_lp``: containers that
    hold a pattern of the linear program, the others were filled longest first.
    """

    patterns: list[dict[int, int]]
    times: list[int]
    lower_bound: int
    lp_value: float = 0.0
    lp_bound: float = 0.0
    from_lp: int = 0


class _Knapsack:
    """Best fill of every capacity by dynamic programming: the items whose prices add up to most."""

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, capacity: int) -> None:
        """``lengths`` fall, so that of equal fills the one with the longest item is taken."""
        self.lengths, self.prices = lengths, prices
        self.best = best = np.zeros(capacity + 1)
        self.pick = pick = np.full(capacity + 1, -1, dtype=np.int64)
        first = np.searchsorted(-lengths, -np.arange(capacity + 1)).tolist()
        for c in range(int(lengths[-1]), capacity + 1):
            k = first[c]
            gain = best[c - lengths[k:]] + prices[k:]
            i = int(gain.argmax())
            if gain[i] > best[c - 1]:
                best[c], pick[c] = gain[i], k + i
            else:
                best[c] = best[c - 1]

    def fill(self, room: int, first: int | None = None) -> dict[int, int]:
        """Counts by item of the best fill, or of the best that holds the item ``first``."""
        out: dict[int, int] = {}
        if first is not None:
            out[first] = 1
            room -= int(self.lengths[first])
        while room >= self.lengths[-1]:
            i = int(self.pick[room])
            if i < 0:
                room -= 1
                continue
            out[i] = out.get(i, 0) + 1
            room -= int(self.lengths[i])
        return out


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, step: float = 0.25, wide: int = 256) -> tuple[dict[tuple[tuple[int, int], ...], float], float, float, np.ndarray]:
    """Fractional packing by multiplicative weights: shares of patterns (item and count) that cover all counts on average,
    the value of the shares that cover each, a lower bound and the prices that give it.

    ``lengths`` fall, ``counts`` are what the patterns must cover. The weight of an item starts at its length and falls
    exponentially with the share of its count that is covered; weights are the prices (duals) of a knapsack solved by
    dynamic programming. The table gives the best pattern that holds each item; those within a factor of the best
    that narrows from round to round are taken for a step, at most ``wide``, the least covered items first, which raises no coverage by more than ``step`` over
    the rate. Prices over the best fill are a solution of the dual program, so each round gives a lower bound.
    """
    m = len(lengths)
    rate = 4.0 + np.log(m + 1)
    covered = np.zeros(m)
    shares: dict[tuple[tuple[int, int], ...], float] = {}
    best_bound, best_prices = 0.0, np.zeros(m)
    rng = np.random.default_rng(1)
    for r in range(rounds):
        prices = lengths * np.exp(-rate * (covered - covered.min()))
        table = _Knapsack(prices * (1 + 1e-4 * rng.random(m)) if r else prices, lengths, capacity)
        top = table.best[capacity]
        least = float(prices @ counts) / (top * (1.0001 if r else 1.0))
        if least > best_bound:
            best_bound, best_prices = least, prices / top
        value = table.prices + table.best[capacity - lengths]
        near = np.flatnonzero(value >= (1 - 0.05 * 0.05 ** (r / rounds)) * top)
        near = near[np.argsort(covered[near], kind="stable")][:wide]
        patterns = {tuple(sorted(table.fill(capacity, int(i)).items())) for i in near}
        gain = np.zeros(m)
        sizes = []
        for key in patterns:
            size = min(counts[i] / k for i, k in key)
            sizes.append(size)
            for i, k in key:
                gain[i] += size * k / counts[i]
        scale = step * 0.1 ** (r / rounds) / (rate * gain.max())
        for key, size in zip(patterns, sizes):
            shares[key] = shares.get(key, 0.0) + scale * size
        covered += scale * gain
    if covered.min() <= 0:  # items of no taken pattern: each alone fills up a container
        for i in np.flatnonzero(covered <= 0):
            key = ((int(i), int(capacity // lengths[i])),)
            shares[key] = float(counts[i]) / key[0][1] * max(float(np.median(covered[covered > 0])) if (covered > 0).any() else 1.0, 1e-9)
            covered[i] = shares[key] * key[0][1] / counts[i]
    size = lengths * counts
    mean = float(covered @ size / size.sum())
    shares = {key: x / mean for key, x in shares.items()}
    lacking = np.maximum(1 - covered / mean, 0) * counts  # covered by containers of one length each
    return shares, sum(shares.values()) + float((lacking / (capacity // lengths)).sum()), best_bound, best_prices


def plan_containers(histogram: dict[int, int], capacity: int, rounds: int = 120) -> Packing:
    """Patterns that hold all items of a histogram of lengths (1 to ``capacity``).

    The configuration LP (fewest containers, each pattern a variable, each length covered) is solved by
    :func:`configuration_lp`. Shares are rounded down to whole uses; what they leave of a use is rounded up as long as the items
    last, the patterns worth most at the dual prices and those of the longest items first. What is left over is a smaller program, solved and rounded the same way
    with half the rounds, until patterns take less than a fiftieth of it; only the remainder is filled longest first, each time with the
    longest that still fits.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if not left:
        return Packing([], [], 0)
    tokens = sum(n * c for n, c in left.items())
    bound = int(-(-tokens // capacity))
    patterns, times = [], []
    lp_value = lp_bound = 0.0

    def use(pattern: dict[int, int], m: int) -> int:
        m = min(m, *(left.get(n, 0) // k for n, k in pattern.items()))
        if m > 0:
            patterns.append(pattern), times.append(m)
            for n, k in pattern.items():
                left[n] -= k * m
        return m

    first = True
    while rounds > 0 and left:
        lengths = np.array(sorted(left, reverse=True), dtype=np.int64)
        shares, value, least, prices = configuration_lp(lengths, np.array([left[int(n)] for n in lengths], dtype=float), capacity, rounds)
        if first:
            lp_value, lp_bound = value, least
        total = sum(left.values())
        worth = {key: round(sum(prices[i] * k for i, k in key), 3) for key in shares}
        turn = [({int(lengths[i]): k for i, k in key}, shares[key]) for key in sorted(shares, key=lambda x: (-worth[x], x)) if worth[key] > 0.98]
        for pattern, x in turn:
            use(pattern, int(x))
        for pattern, _ in turn:
            use(pattern, 1)
        left = {n: c for n, c in left.items() if c > 0}
        if total - sum(left.values()) < max(total // 50, 1):
            break
        rounds = max(rounds // 2, 20) if not first or rounds > 20 else rounds
        first = False
    from_lp = sum(times)
    rest = np.array(sorted(left), dtype=np.int64)
    while len(rest):
        room, pattern, i = capacity, {}, len(rest) - 1
        while i >= 0:
            n = int(rest[i])
            k = min(left[n], room // n)
            if k:
                pattern[n] = k
                room -= n * k
            i = min(i - 1, int(np.searchsorted(rest, room, side="right")) - 1)
        use(pattern, min(left[n] // k for n, k in pattern.items()))
        rest = np.array([n for n in rest if left[n] > 0], dtype=np.int64)
    return Packing(patterns, times, max(bound, int(np.ceil(lp_bound - 1e-6))), lp_value, lp_bound, from_lp)


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """The tokenizer's function, read once for each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(df: DataFrame, item: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``item`` and ``n_tokens`` of its whole text (0 for null and empty texts)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for b in batches:
            n = [len(encode(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[item, "n_tokens"])

    return df.select(item, text).mapInArrow(kernel, T.StructType([df.schema[item], T.StructField("n_tokens", T.LongType())]))


def pack_texts(df: DataFrame, item: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Put texts into containers of ``capacity`` tokens with little room left over.

    Gives one row per piece: ``item``, ``piece`` (0, 1, ...), ``start`` (its first token), ``n_tokens`` and
    ``container`` (consecutive numbers from 0). Only a text longer than the capacity is cut: into whole containers
    and a rest that is packed like any other text. Null and empty texts take no room: one row with piece 0, 0 tokens
    and a null container. Every row is an item, also where ids repeat or are null. No rows give no rows.

    The histogram of lengths (at most ``capacity`` rows) goes to the driver, which plans patterns; a text's container
    follows from its rank among the texts of its length. Ranks are counted in shares of a length, as many as the
    number of texts asks for, so a length that a third of all texts have is counted in many tasks.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counted = materialize(token_counts(df, item, text, vocabulary), "tokens")
    parts = counted.select(F.col(item), F.floor(F.col("n_tokens") / capacity).alias("whole"), (F.col("n_tokens") % capacity).alias("rest"), "n_tokens")
    rows = parts.groupBy("rest").agg(F.count("*").alias("n"), F.sum("whole").alias("w")).collect()  # at most `capacity` rows
    histogram = {int(r["rest"]): int(r["n"]) for r in rows if r["rest"] > 0}
    total = sum(int(r["n"]) for r in rows)
    packing = plan_containers(histogram, capacity)
    salts = max(16, -(-total // RANK_ROWS))

    keys, bases, sizes = [], [], []
    used: dict[int, int] = {}
    base = 0
    for pattern, m in zip(packing.patterns, packing.times):
        for n, k in pattern.items():
            keys.append((n << 40) + used.get(n, 0)), bases.append(base), sizes.append(k)
            used[n] = used.get(n, 0) + k * m
        base += m
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable") if keys else np.array([], dtype=np.int64)
    keys_a, bases_a, sizes_a = (np.array(x, dtype=np.int64)[order] for x in (keys, bases, sizes))
    mixed = base

    salted = parts.withColumn("salt", F.pmod(F.xxhash64(item, "n_tokens", F.monotonically_increasing_id()), F.lit(salts)))
    salted = materialize(salted, "salted")  # the salt must stay the same in both passes
    sums = salted.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("whole").alias("w"))
    before = W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("rest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"), F.col("w"))
    per_rest = {int(r["rest"]): int(r["w"]) for r in rows}
    start, starts = mixed, {}
    for n in sorted(per_rest):
        starts[n] = start
        start += per_rest[n]
    offsets = offsets.withColumn("whole0", F.coalesce(F.sum("w").over(before), F.lit(0))).drop("w")
    within = W.partitionBy("rest", "salt").orderBy("n_tokens", item)
    ranked = (
        salted.join(offsets, ["rest", "salt"])
        .withColumn("rank", F.col("rank0") + F.row_number().over(within) - 1)
        .withColumn("whole_at", F.col("whole0") + F.coalesce(F.sum("whole").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(item, "whole", "rest", "rank", "whole_at")
    )
    first_whole = np.zeros(capacity, dtype=np.int64)
    for n, s in starts.items():
        first_whole[n] = s
    out = T.StructType([df.schema[item]] + [T.StructField(c, T.LongType()) for c in ("piece", "start", "n_tokens", "container")])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            whole, rest, rank, at = (np.asarray(column_numpy(t, c), dtype=np.int64) for c in ("whole", "rest", "rank", "whole_at"))
            n = np.maximum(whole + (rest > 0), 1)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            is_whole = piece < whole[row]
            container = first_whole[rest[row]] + at[row] + piece
            tail = ~is_whole & (rest[row] > 0)
            if tail.any():
                r = row[tail]
                i = np.searchsorted(keys_a, (rest[r] << 40) + rank[r], side="right") - 1
                container[tail] = bases_a[i] + ((rest[r] << 40) + rank[r] - keys_a[i]) // sizes_a[i]
            empty = ~is_whole & ~tail
            tokens = np.where(is_whole, capacity, rest[row])
            ids = t.column(item).combine_chunks().take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(piece), pa.array(piece * capacity), pa.array(tokens), pa.array(container, mask=empty)],
                names=out.names,
            )

    return ranked.mapInArrow(assign, out)
