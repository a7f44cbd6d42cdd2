"""Toxicity: a linear-chain conditional random field over tokens, aggregated to documents.

Token labels come from the document labels: a token of a toxic training document is toxic if it shows a
feature (the word, or a beginning of it) that toxic documents have far more often than others; every
token of the others is not. The field has two states, a weight for each feature and transitions; it is
fitted by gradient ascent on the likelihood of the token labels. Forward-backward gives each token's
marginal. Tokens without any feature share one emission, so a run of n of them is the n-th power of one
2 x 2 matrix, and a text costs as many steps as it has tokens with features. The marginals' sum, share
and maximum give the document's score by a logistic fit on the same rows; spans are runs of tokens of
marginal 0.5 or more, as code point offsets.

Only the model is fitted on a sample: at most ``most_toxic`` and ``most_clean`` training rows, the first by hash of
the id, and of each class no more than ``most_bytes`` of text. One task fits it, so that neither the driver holds
texts nor a lost executor loses the fit. Rows of the sample that are copies of each other share one row's weight.
Scoring reads all rows and whole texts.

Defined results: null and empty texts get the score of a text without features; without training rows of both
classes every score is the smoothed share of toxic rows; rows that repeat an id, or have none, are scored each by
its text; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.labelled import fold, training_ids
from docquarry.llm.textkeys import ALNUM, column, keyed, mix64, recorded, shingle_keys, slices
from docquarry.session import table

PREFIXES = (4, 5, 6, 7)


def word_features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace").lower()
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) >= k)]


@dataclass
class Crf:
    """weights: of features, for state 1; start and move: log-scores of states and transitions."""

    features: dict[str, int]
    weights: np.ndarray
    bias: float
    move: np.ndarray
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def prepare(self) -> None:
        """Powers of the matrix of a token without features, scaled; ``blank`` has 2^k of them at k."""
        self.step = np.exp(self.move)
        one = self.step * np.exp([0.0, self.bias])
        self.blank = []
        for _ in range(40):
            one = one / one.sum()
            self.blank.append(one)
            one = one @ one
        self.cache: dict[int, np.ndarray] = {}

    def run(self, n: int) -> np.ndarray:
        """The scaled product of n such matrices."""
        if n not in self.cache:
            out, k, m = np.eye(2), 0, n
            while m:
                if m & 1:
                    out = out @ self.blank[k]
                    out /= out.sum()
                m >>= 1
                k += 1
            if len(self.cache) > 4096:
                self.cache.clear()
            self.cache[n] = out
        return self.cache[n]

    def marginals(self, places: list[int], scores: list[float], n: int) -> list[float]:
        """P(state 1) of the tokens at ``places`` (ascending, of n), whose emission is ``scores``."""
        forward, alpha, last = [], np.array([1.0, math.exp(-4.0)]), -1
        for p, u in zip(places, scores, strict=True):
            if p > last + 1 or last >= 0:
                gap = p - last - 1
                if last < 0:
                    alpha = alpha * [1.0, math.exp(self.bias)]
                    gap -= 1
                alpha = alpha @ self.run(gap) @ self.step
            alpha = alpha * [1.0, math.exp(min(u, 50.0))]
            alpha = alpha / alpha.sum()
            forward.append(alpha)
            last = p
        out, beta, nxt = [0.0] * len(places), np.ones(2), n
        for i in range(len(places) - 1, -1, -1):
            p = places[i]
            gap = nxt - p - 1
            if nxt < n:
                beta = self.step @ (np.array([1.0, math.exp(min(scores[i + 1], 50.0))]) * beta)
            if gap:
                beta = self.run(gap) @ beta
            beta = beta / beta.sum()
            both = forward[i] * beta
            out[i] = float(both[1] / both.sum())
            nxt = p
        return out


def _segments(docs: list[tuple[list[list[int]], list[bool], float]], length: int = 256):
    """Token features and labels cut into padded rows: feature ids and their (row, column), labels, lengths and
    weights."""
    fid, row, col, ys, lens, weights = [], [], [], [], [], []
    for feats, labels, weight in docs:
        for a in range(0, len(feats), length):
            r = len(lens)
            part = feats[a : a + length]
            y = np.zeros(length, np.int8)
            for c, fs in enumerate(part):
                for f in fs:
                    fid.append(f)
                    row.append(r)
                    col.append(c)
                y[c] = labels[a + c]
            ys.append(y)
            lens.append(len(part))
            weights.append(weight)
    return np.array(fid, np.int64), np.array(row, np.int64), np.array(col, np.int64), np.array(ys).reshape(-1, length), np.array(lens, np.int64), np.array(weights)


def fit_field(docs: list[tuple[list[list[int]], list[bool], float]], names: dict[str, int], rounds: int = 40, rate: float = 0.3, ridge: float = 1e-4) -> Crf:
    """Adam on the weighted mean log-likelihood of the token labels, forward-backward over all rows at once."""
    fid, row, col, y, lens, weight = _segments(docs)
    n, length = y.shape
    real = np.arange(length) < lens[:, None]
    tokens = max(float((real * weight[:, None]).sum()), 1e-9)
    p = np.concatenate([np.zeros(len(names)), [-3.0], np.zeros(4)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    nf = len(names)
    seen = np.zeros((2, 2))
    pair = real[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & pair) * weight[:, None]).sum()
    for t in range(1, rounds + 1):
        u = np.bincount(col * n + row, p[fid], n * length).reshape(length, n) + p[nf]
        e = np.exp(np.clip(u, -30, 30)).astype(np.float32)  # a row for each place
        del u
        m00, m01, m10, m11 = (float(x) for x in np.exp(p[nf + 1 :]))
        # State 1 against state 0, forward; the same backward as ``b``.
        odds = np.empty((length, n), np.float32)
        odds[0] = math.exp(-4.0) * e[0]
        for i in range(1, length):
            before = odds[i - 1]
            odds[i] = np.clip(e[i] * ((m01 + before * m11) / (m00 + before * m10)), 1e-30, 1e30)
        b = np.ones(n)
        marginal = np.zeros((n, length), np.float32)
        moved = np.zeros((2, 2))
        for i in range(length - 1, -1, -1):
            both = odds[i] * b
            marginal[:, i] = both / (1 + both)
            if i:
                ahead, behind = e[i] * b, odds[i - 1].astype(np.float64)
                w = weight * real[:, i] / (m00 + m01 * ahead + behind * (m10 + m11 * ahead))
                moved += [[m00 * w.sum(), m01 * (w @ ahead)], [m10 * (w @ behind), m11 * (w @ (behind * ahead))]]
                b = np.where(real[:, i], (m10 + m11 * ahead) / (m00 + m01 * ahead), 1.0)
        diff = np.where(real, y - marginal, 0.0) * weight[:, None]
        grad = np.concatenate([np.bincount(fid, diff[row, col], nf), [diff.sum()], (seen - moved).ravel()]) / tokens * 100 - ridge * p
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) * (0.5 if t > rounds // 2 else 1.0)
        p[:nf] = np.clip(p[:nf], -10, 10)
        p[nf:] = np.clip(p[nf:], -12, 6)
    return Crf(names, p[:nf], float(p[nf]), p[nf + 1 :].reshape(2, 2))


def _doc_features(marginal: list[float], n_words: int) -> list[float]:
    s = sum(marginal)
    return [1.0, math.log1p(s), math.log(s / max(1, n_words) + 1e-4), max(marginal, default=0.0)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; column 0 is the constant."""
    b = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) / weight.sum() - keep * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / weight.sum() + np.diag(keep)
        b = b + np.clip(np.linalg.solve(h, g), -5, 5)
    return b


def candidates(toxic: list[tuple[list[bytes], float]], clean: list[tuple[list[bytes], float]], least: float = 24.0, times: float = 2.5) -> list[str]:
    """Features that toxic documents (words, weight) show far more often: ``times`` as often, with a likelihood
    ratio of the weighted document counts over ``least``."""
    nt, nc = (sum(w for _, w in docs) for docs in (toxic, clean))
    fewest = least / 2 / math.log((nt + nc) / nt)  # with less, even a feature of toxic documents alone stays below
    words: Counter[bytes] = Counter()
    for doc, weight in toxic:
        for w in set(doc):
            words[w] += weight
    bound: Counter[str] = Counter()  # from above: a feature's documents are no more than its words' documents
    for w, n in words.items():
        for f in word_features(w):
            bound[f] += n
    some = {f for f, n in bound.items() if n >= fewest}
    del bound, words
    a: Counter[str] = Counter()
    for doc, weight in toxic:
        for f in {f for w in set(doc) for f in word_features(w)} & some:
            a[f] += weight
    b: Counter[str] = Counter()
    for doc, weight in clean:
        for f in {f for w in set(doc) for f in word_features(w) if f in a}:
            b[f] += weight
    found = []
    for f, x in a.items():
        y = b[f]
        px, py, pq = x / nt, (y + 0.5) / (nc + 1), (x + y) / (nt + nc)
        if px > times * py:
            g2 = 2 * sum(o * math.log(o / e) for o, e in ((x, nt * pq), (y, nc * pq), (nt - x, nt * (1 - pq)), (nc - y, nc * (1 - pq))) if o > 0 and e > 0)
            if g2 > least:
                found.append((-g2, f))
    return [f for _, f in sorted(found)]


def copy_weights(texts: list[str]) -> list[float]:
    """A weight for each text: texts that look like copies of each other (a pair of least 3-word shingle keys is
    equal) share 1, so that one document with many copies is not taken for many."""
    group: dict[tuple[int, ...], int] = {}
    own, size = [], Counter()
    for i, t in enumerate(texts):
        _, _, _, words, _ = keyed([t], ALNUM)
        keys = shingle_keys(words, min(3, len(words))) if len(words) else words
        if len(keys):
            low = [int(mix64(keys + np.uint64(j)).min()) for j in range(6)]
            marks = [(j, low[j], low[j + 1]) for j in (0, 2, 4)]
            g = next((group[m] for m in marks if m in group), i)
            for m in marks:
                group.setdefault(m, g)
        else:
            g = -1
        own.append(g)
        size[g] += 1
    return [1 / size[g] for g in own]


def fit(texts: dict[int, list[str]], total: dict[int, int]) -> Crf:
    """The model of a sample: texts and the number of training rows of class 1 (toxic) and 0."""
    share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    if not texts.get(0) or not texts.get(1):
        out = Crf({}, np.zeros(0), 0.0, np.zeros((2, 2)), constant=share)
        out.prepare()
        return out
    own: dict[bytes, bytes] = {}

    def tokens(c: int) -> list[tuple[list[bytes], float]]:
        some = texts[c]
        return [([own.setdefault(w, w) for w in t.encode().translate(ALNUM).split()], v) for t, v in zip(some, copy_weights(some), strict=True)]

    words = {c: tokens(c) for c in (1, 0)}
    texts.clear()
    names = {f: i for i, f in enumerate(candidates(words[1], words[0]))}
    memo: dict[bytes, list[int]] = {}
    none: list[int] = []

    def coded(doc: list[bytes]) -> list[list[int]]:
        for w in set(doc):
            if w not in memo:
                memo[w] = [names[f] for f in word_features(w) if f in names] or none
        return [memo[w] for w in doc]

    docs = [(coded(d), c, v) for c in (1, 0) for d, v in words[c]]
    del words, own
    model = fit_field([(d, [c == 1 and bool(fs) for fs in d], v) for d, c, v in docs], names)
    model.prepare()
    x = []
    for d, _, _ in docs:
        places = [i for i, fs in enumerate(d) if fs]
        x.append(_doc_features(model.marginals(places, [model.bias + float(model.weights[d[i]].sum()) for i in places], len(d)), len(d)))
    y, v = np.array([float(c) for _, c, _ in docs]), np.array([v for _, _, v in docs])
    weight = v * np.where(y == 1, total[1] / v[y == 1].sum(), total[0] / v[y == 0].sum())
    model.calibration = _logistic(np.array(x), y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_toxic: int = 1500, most_clean: int = 2000, most_bytes: int = 1 << 23) -> Crf:
    ids, total = training_ids(labels, label, {1: most_toxic, 0: most_clean})
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list[str]] = {1: [], 0: []}
        left = {1: most_bytes, 0: most_bytes}
        for part in slices(batches, "text"):
            for y, t in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                left[y] -= len(t.encode())
                if left[y] >= 0 or not texts[y]:
                    texts[y].append(t)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, total))], pa.binary())], names=["model"])

    fitted = rows.repartition(1).sortWithinPartitions("y", "place", "text").mapInArrow(run, "model binary").first()
    return pickle.loads(fitted[0]) if fitted else fit({}, total)


class Tagger:
    """Scores texts in one Python worker; remembers which words have features."""

    def __init__(self, model: Crf):
        self.model, self.score_of = model, {}

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        model = self.model
        if model.constant is not None:
            return [model.constant] * len(texts), [[] for _ in texts]
        buf, begin, end, keys, bounds = keyed(texts, ALNUM)
        own, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.score_of) > 300_000:
            self.score_of.clear()
        known = self.score_of
        emission = np.full(len(own), np.nan)
        for i, k in enumerate(own.tolist()):
            u = known.get(k)
            if u is None:
                j = first[i]
                fs = [model.features[f] for f in word_features(buf[begin[j] : end[j]]) if f in model.features]
                u = known[k] = model.bias + float(model.weights[fs].sum()) if fs else math.nan
            emission[i] = u
        per_word = emission[back] if len(own) else np.zeros(0)
        flagged = np.flatnonzero(~np.isnan(per_word))
        cut = np.searchsorted(flagged, bounds)
        at = np.cumsum([0, *(len((t or "").encode()) + 1 for t in texts)])
        scores, spans = [], []
        for d in range(len(texts)):
            some = flagged[cut[d] : cut[d + 1]]
            places = (some - bounds[d]).tolist()
            marginal = model.marginals(places, per_word[some].tolist(), int(bounds[d + 1] - bounds[d]))
            z = float(np.dot(model.calibration, _doc_features(marginal, int(bounds[d + 1] - bounds[d]))))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            found: list[list] = []
            last = -2
            for p, w, m in zip(places, some.tolist(), marginal, strict=True):
                if m >= 0.5:
                    if p == last + 1:
                        found[-1][1] = int(end[w] - at[d])
                        found[-1][2] = max(found[-1][2], m)
                    else:
                        found.append([int(begin[w] - at[d]), int(end[w] - at[d]), m])
                    last = p
            if found:  # bytes to code points
                raw = np.frombuffer((texts[d] or "").encode(), np.uint8)
                points = np.cumsum((raw & 0xC0) != 0x80)
                found = [[int(points[a]) - 1, int(points[b - 1]), m] for a, b, m in found]
            spans.append([tuple(f) for f in found])
        return scores, spans


def tag(docs: DataFrame, model: Crf, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """rec (the columns of ``docs``, or ``keep``), score and spans (start, end, marginal) of each row."""
    own, place = recorded(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
    schema = own.selectExpr("rec", "0.0D AS score", "cast(null as array<struct<start:int,end:int,marginal:double>>) AS spans").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for part in slices(batches, place):
            scores, spans = tagger(column(part, place).to_pylist())
            rows = [[{"start": a, "end": b, "marginal": m} for a, b, m in s] for s in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(rows, kind)], names=["rec", "score", "spans"])

    return own.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    return tag(docs, train(docs, labels)).where(F.col("score") < threshold).select("rec.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tag(docs, train(docs, table(spark, sf_dir, "labels")), keep=("doc_id",)).select("rec.doc_id", "score", "spans")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
