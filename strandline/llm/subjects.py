"""Subject areas of texts (one-versus-rest linear classifiers on hashed word n-grams)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.words import WORD, clean, fold

BUCKETS = 1 << 18
#: Margin from which a sentence is clearly about a subject, and how far an unclear one may be moved.
CLEAR, REACH = 0.75, 2.0
#: Lines that begin a part of a ruling, and marks of a headnote.
BODY, ORDER = {"judgment", "urteil", "sentencia"}, {"order", "beschluss", "fallo"}
_END = re.compile(
    r'(?<=[^\W\d_]{2}[.!?])\s+|(?<=[\d\])"”»%][.!?])\s+(?!januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember)|(?<=[.!?]["”»])\s+|\n\s*\n\s*'
)
_LINE = re.compile(r"^[\W\d_]*([a-z]+)[\W\d_]*$", re.MULTILINE)


def sentences(text: str | None) -> tuple[list[str], list[int]]:
    """Sentences of a ruling and the part each lies in: 0 head, 1 body, 2 order."""
    out, part, now = [], [], 0
    for block in _END.split(clean(text)):
        if len(block) < 24:
            m = _LINE.match(block.strip())
            if m and m.group(1) in BODY | ORDER:  # a heading is no sentence
                now = 1 if m.group(1) in BODY else 2
                continue
        elif now == 0 and "\n" in block and any(w in BODY for w in block.split("\n")):
            now = 1
        if block and not block.isspace():
            out.append(block)
            part.append(now)
    return out, part


class WordHashes(dict):
    """Word to its hash; numbers are one word. What was looked up is kept, up to a bound."""

    def __init__(self, bound: int = 1_000_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = zlib.crc32(b"#" if word.isdigit() else fold(word).encode())
        return h


def features(texts: Sequence[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each sentence, and the number of buckets of each."""
    found = [WORD.findall(t) for t in texts]
    n = np.array([len(w) for w in found], dtype=np.int64)
    flat = [h for w in found for h in map(hashes.__getitem__, w)]
    h = np.array(flat, dtype=np.uint64)
    if not len(h):
        return np.empty(0, dtype=np.int64), n
    row = np.repeat(np.arange(len(n)), n)
    one = (h * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(BUCKETS)
    two = ((h[:-1] * np.uint64(0x85EBCA77) + h[1:] * np.uint64(0xC2B2AE3D)) >> np.uint64(9)) % np.uint64(BUCKETS)
    same = row[1:] == row[:-1]
    f = np.concatenate([one, two[same]]).astype(np.int64)
    r = np.concatenate([row, row[1:][same]])
    order = np.argsort(r, kind="stable")
    return f[order], np.maximum(2 * n - 1, 0)


@dataclass
class SubjectModel:
    """Weights of each bucket for each subject, and last for 'says something about the facts'."""

    codes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    limits: np.ndarray

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.weights.any(axis=1))
        return {"codes": self.codes, "used": used, "rows": self.weights[used], "bias": self.bias, "limits": self.limits}

    def __setstate__(self, state: dict) -> None:
        self.codes, self.bias, self.limits = state["codes"], state["bias"], state["limits"]
        self.weights = np.zeros((BUCKETS, len(self.bias)), dtype=np.float32)
        self.weights[state["used"]] = state["rows"]

    def scores(self, f: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-odds per sentence."""
        out = np.zeros((len(n), len(self.bias)), dtype=np.float32)
        some = np.flatnonzero(n)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            out[some] = np.add.reduceat(self.weights[f], starts, axis=0) / np.sqrt(n[some])[:, None]
        return out + self.bias


class _Sparse:
    """Sentences as sets of buckets; buckets in fewer than ``least`` texts are left out."""

    def __init__(self, f: np.ndarray, n: np.ndarray, text: np.ndarray, least: int) -> None:
        row = np.repeat(np.arange(len(n)), n)
        pair = np.unique(row * BUCKETS + f)
        row, f = pair // BUCKETS, pair % BUCKETS
        in_text = np.unique(f * (int(text.max(initial=0)) + 1) + text[row]) // (int(text.max(initial=0)) + 1)
        kept, count = np.unique(in_text, return_counts=True)
        self.buckets = kept[count >= least]
        at = np.searchsorted(self.buckets, f)
        ok = at < len(self.buckets)
        ok[ok] = self.buckets[at[ok]] == f[ok]
        self.n, self.row, self.col = len(n), row[ok], at[ok]
        self.row_at = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1])) if len(self.row) else np.empty(0, dtype=np.int64)
        order = np.argsort(self.col, kind="stable")
        self.by_col = self.row[order]
        col = self.col[order]
        self.col_at = np.flatnonzero(np.append(True, col[1:] != col[:-1])) if len(col) else np.empty(0, dtype=np.int64)
        self.cols = col[self.col_at]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each sentence's buckets."""
        out = np.zeros((self.n, weights.shape[1]), dtype=weights.dtype)
        if len(self.row_at):
            out[self.row[self.row_at]] = np.add.reduceat(weights[self.col], self.row_at, axis=0)
        return out

    def turned_times(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of the sentences that each bucket lies in."""
        out = np.zeros((len(self.buckets), values.shape[1]), dtype=values.dtype)
        if len(self.col_at):
            out[self.cols] = np.add.reduceat(values[self.by_col], self.col_at, axis=0)
        return out


def _kept_company(x: _Sparse, now: np.ndarray, text: np.ndarray, k: int, learn: np.ndarray, least: float = 0.35) -> np.ndarray:
    """Whether the other sentences of the texts that each bucket lies in are about the subject, for ``least`` of them at least.

    Words of a subject lie in texts about it; a phrase of the talk that was taken for one lies in texts about all of them.
    True where fewer than two texts tell.
    """
    texts = int(text.max(initial=0)) + 1
    told = np.zeros((texts, k), dtype=np.float32)
    some = now >= 0
    np.add.at(told, (text[some], now[some]), 1)
    seen = np.flatnonzero(learn[x.row])
    pair, at = np.unique(x.col[seen] * texts + text[x.row[seen]], return_inverse=True)
    rest = told[pair % texts]
    inside = np.flatnonzero(some[x.row[seen]])
    np.subtract.at(rest, (at[inside], now[x.row[seen[inside]]]), 1)  # not the sentences with the bucket itself
    size = rest.sum(axis=1, keepdims=True)
    share = np.zeros((len(x.buckets), k), dtype=np.float32)
    np.add.at(share, pair // texts, rest / np.maximum(size, 1))
    n = share.sum(axis=1, keepdims=True)
    return (share >= least * n) | (n < 2)


def _weak_labels(x: _Sparse, label: np.ndarray, text: np.ndarray, k: int, learn: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Weight of each subject for every sentence: one subject, or none (all zero).

    ``label``: subject of the example a sentence is from, -1 for body sentences of rulings, -2 for sentences of heads
    and orders, which are about none. Words and pairs that occur nearly only in texts of one subject speak for it: first
    by the examples' labels, then, round by round, by the sentences labelled so far. A sentence is about the
    subject that is spoken for clearly most; an example's sentence about its own or none. What words speak for is learned
    from the sentences in ``learn`` alone.
    """
    now = np.where(label >= 0, label, -1)
    texts = int(text.max(initial=0)) + 1
    for step in range(rounds):
        at = (now[x.row] >= 0) & learn[x.row]
        one = np.unique((x.col[at] * texts + text[x.row[at]]) * k + now[x.row[at]])
        count = np.zeros((len(x.buckets), k))
        np.add.at(count, (one // k // texts, one % k), 1)
        total = count.sum(axis=1, keepdims=True)
        size = np.bincount(one % k, minlength=k)
        even = count / np.maximum(size, 1) * size.mean()  # as if every subject had as many words
        other = np.zeros((len(x.buckets), 1))
        if step:  # what is also said without a subject is talk
            at = (now[x.row] < 0) & learn[x.row]
            np.add.at(other, (np.unique(x.col[at] * texts + text[x.row[at]]) // texts, 0), 1)
        pure = (even + 0.05) / (even.sum(axis=1, keepdims=True) + other + 0.05 * k)
        speaks = np.where((pure >= 0.5) & (total >= (2 if step == 0 else 3)), np.log(pure * k), 0)
        if step:
            speaks[~_kept_company(x, now, text, k, learn)] = 0
        z = x.times(speaks)
        order = np.sort(z, axis=1)
        clear = (order[:, -1] > 0) & (order[:, -1] - order[:, -2] >= 1.0) & (label != -2)
        now = np.where(clear, z.argmax(axis=1), -1)
        now[(label >= 0) & (now != label)] = -1
    y = np.zeros((x.n, k))
    y[np.flatnonzero(now >= 0), now[now >= 0]] = 1
    return y


def _fit(x: _Sparse, y: np.ndarray, rounds: int, decay: float = 1e-6, rate: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every column of ``y`` (full gradient, Adam)."""
    size = np.bincount(x.row, minlength=x.n).astype(np.float32)
    scale = (1 / np.sqrt(np.maximum(size, 1)))[:, None]
    y = y.astype(np.float32)
    k = y.shape[1]
    theta = np.zeros((len(x.buckets), k), dtype=np.float32)
    bias = np.log((y.sum(axis=0) + 1) / ((1 - y).sum(axis=0) + 1))
    m1, m2, b1, b2 = np.zeros_like(theta), np.zeros_like(theta), np.zeros(k), np.zeros(k)
    for t in range(1, rounds + 1):
        e = (1 / (1 + np.exp(-np.clip(x.times(theta) * scale + bias, -30, 30))) - y).astype(np.float32) / max(x.n, 1)
        g = x.turned_times(e * scale) + np.float32(decay) * theta
        gb = e.sum(axis=0)
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        theta -= (rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        bias = bias - 0.3 * rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros((BUCKETS, k), dtype=np.float32)
    weights[x.buckets] = theta
    return weights, bias.astype(np.float32)


def fit_subjects(examples: list[tuple[str, str]], unlabelled: list[str], rounds: int = 50, max_example_sentences: int = 100_000, max_ruling_sentences: int = 24_000) -> SubjectModel:
    """Classifiers from labelled texts and weakly labelled sentences of ``unlabelled`` rulings.

    Every sentence gets weak labels from the label of its example or the part of its ruling, see :func:`_weak_labels`;
    then a linear classifier is fitted for each subject, and one for being about any, and each subject's threshold is
    set where it parts best the sentences of rulings held back from the fit and from the words that made the labels. Examples and rulings are read until they have given
    ``max_example_sentences`` and ``max_ruling_sentences``, each for itself.
    """
    codes = sorted({c for _, c in examples})
    hashes = WordHashes()
    flat, label, text = [], [], []
    for t, code in examples:
        if len(flat) >= max_example_sentences:
            break
        s = sentences(t)[0]
        flat += s
        label += [codes.index(code)] * len(s)
        text += [(text[-1] + 1) if text else 0] * len(s)
    of_examples = len(flat)
    for t in unlabelled:
        if len(flat) - of_examples >= max_ruling_sentences:
            break
        s, part = sentences(t)
        flat += s
        label += [-1 if p == 1 else -2 for p in part]
        text += [(text[-1] + 1) if text else 0] * len(s)
    label_a, text_a = np.array(label, dtype=np.int64), np.array(text, dtype=np.int64)
    f, n = features(flat, hashes)
    held = (text_a % 5 == 4) & (label_a < 0)  # the few examples of a subject are all needed
    fit = ~held
    y = _weak_labels(_Sparse(f, n, text_a, 2), label_a, text_a, len(codes), fit)
    y = np.concatenate([y, y.sum(axis=1, keepdims=True)], axis=1)
    row = np.repeat(np.arange(len(n)), n)
    weights, bias = _fit(_Sparse(f[fit[row]], n[fit], text_a[fit], 2), y[fit], rounds)
    model = SubjectModel(codes, weights, bias, np.zeros(len(codes)))
    z = model.scores(f[held[row]], n[held])
    for k in range(len(codes)):
        pos = y[held, k] > 0.5
        cuts = np.linspace(-2.5, 1.5, 41)
        f1 = np.array([2 * (pos & (z[:, k] >= c)).sum() / max((z[:, k] >= c).sum() + pos.sum(), 1) for c in cuts])
        top = np.flatnonzero(f1 >= f1.max() - 2e-3)
        model.limits[k] = cuts[top[len(top) // 2]] if pos.any() else 0.0
    return model


def subject_counts(model: SubjectModel, texts: Sequence[str | None], hashes: WordHashes) -> np.ndarray:
    """For each text the number of body sentences about each subject, and last that of sentences about the facts."""
    out = np.zeros((len(texts), len(model.codes) + 1))
    if not model.codes:
        return out
    flat, doc = [], []
    for i, t in enumerate(texts):
        s, part = sentences(t)
        keep = [x for x, p in zip(s, part) if p == 1] or [x for x, p in zip(s, part) if p == 0]
        flat += keep
        doc += [i] * len(keep)
    if not flat:
        return out
    z = model.scores(*features(flat, hashes))
    d, k = np.array(doc), len(model.codes)
    margin = z[:, :-1] - model.limits
    best, top = margin.argmax(axis=1), margin.max(axis=1)
    facts = (top >= 0) | (z[:, -1] > 0)
    clear = facts & (top >= CLEAR)
    # an unclear sentence counts for a subject that another sentence of its text is clearly about, if there is any
    sure = np.zeros((len(texts), k), dtype=bool)
    sure[d[clear], best[clear]] = True
    unclear = facts & ~clear
    known = sure[d[unclear]]
    within = np.where(known, margin[unclear], -np.inf)
    best[unclear] = np.where(known.any(axis=1), within.argmax(axis=1), best[unclear])
    counted = facts.copy()
    counted[unclear] = ~known.any(axis=1) | (within.max(axis=1) >= top[unclear] - REACH)
    np.add.at(out, (d[counted], best[counted]), 1)
    np.add.at(out[:, -1], d[facts], 1)
    return out


def subject_areas(
    docs: DataFrame, examples: DataFrame, doc_id: str, text: str, example_text: str, label: str, group: str | None = None,
    share: float = 0.2, max_examples: int = 20_000, max_rulings: int = 1_000, max_example_sentences: int = 100_000, max_ruling_sentences: int = 24_000,
) -> DataFrame:
    """The subjects of each text: ``doc_id``, ``subject_code``, ``share`` (of its factual sentences), ``n_facts``.

    A subject is given where at least ``share`` of what the text says about the facts is about it. Sentences are
    scored by one linear classifier per subject over hashed words and word pairs, with a threshold per subject, and
    by one for being about any subject at all; a sentence beyond either counts for the subject it is furthest beyond.
    Shares count sentences of the body, so heads, party names and orders don't count.

    Classifiers are fitted on the driver on at most ``max_examples`` labelled texts and on the sentences of at most
    ``max_rulings`` rulings (those with the lowest hashes, one for each ``group`` value) with weak labels from the
    examples and the rulings' parts, see :func:`fit_subjects`, which reads at most ``max_example_sentences`` and
    ``max_ruling_sentences`` of them. Null labels and texts are left out of the fit, repeats
    count once, and wrong labels weigh little among many. Every text is classified whole. Null and empty texts, and
    texts without factual sentences, give no row; rows that repeat an id give the rows of each. Without any labelled
    example the result is empty. Languages are not told apart. No shuffle of texts.
    """
    labelled = examples.where(F.col(label).isNotNull() & F.col(example_text).isNotNull()).select(F.col(example_text).alias("t"), F.col(label).alias("c")).distinct()
    rows = [(r["t"], r["c"]) for r in labelled.orderBy(F.xxhash64("t"), "t", "c").limit(max_examples).collect()]
    some = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(group if group else doc_id).cast("string").alias("g"))
    chosen: dict[str, object] = {}
    for r in some.orderBy(F.xxhash64("id"), "id").limit(3 * max_rulings).collect():
        if len(chosen) < max_rulings:
            chosen.setdefault(r["g"], r["id"])
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen.values()], T.StructType([T.StructField("_id", docs.schema[doc_id].dataType)]))
    sample = docs.select(doc_id, text).join(F.broadcast(ids), F.col(doc_id) == F.col("_id"), "left_semi").orderBy(F.xxhash64(doc_id), doc_id, text).limit(max_rulings)  # at most max_rulings ids
    model = fit_subjects(rows, [r[1] for r in sample.collect()], max_example_sentences=max_example_sentences, max_ruling_sentences=max_ruling_sentences) if rows else SubjectModel([], np.zeros((BUCKETS, 1), dtype=np.float32), np.full(1, -1.0, dtype=np.float32), np.zeros(0))
    out = T.StructType([docs.schema[doc_id], T.StructField("subject_code", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("n_facts", T.LongType())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                b = whole.slice(a, 200)
                n = subject_counts(model, b.column(1).to_pylist(), hashes)
                part = n[:, :-1] / np.maximum(n[:, -1:], 1)
                i, k = np.nonzero((part >= share - 1e-9) & (n[:, :-1] > 0))
                if len(i):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array([model.codes[x] for x in k]), pa.array(part[i, k]), pa.array(n[i, -1].astype("int64"))], names=out.names)

    return docs.select(doc_id, text).mapInArrow(classify, out)
