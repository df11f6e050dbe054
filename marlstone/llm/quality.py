"""Quality classifier: ordinal regression with cumulative links on graded ratings (operator 5).

One weight for each hashed feature is shared by all grades, and ordered thresholds part them:
P(grade <= k) = sigmoid(threshold_k - weights . features). Features are which words and marks a text has, in lower
case, and how repetitive and how loud it is. The model is fitted on a bounded sample of rated documents.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import held, over_texts

_TOKENS = re.compile(r"\w+|[^\w\s]+")
STORE = 250_000


def features(text: str, size: int) -> tuple[list[str], list[int]]:
    """Distinct lower-case tokens, and indices of the features of the whole text."""
    tokens = _TOKENS.findall(text)
    known = set(map(str.lower, tokens))
    n = len(tokens) or 1
    loud = sum(map(str.isupper, tokens))
    marks = sum(not t[0].isalnum() for t in tokens)
    shape = [f"distinct {int(8 * len(known) / n)}", f"loud {int(8 * loud / n)}", f"marks {int(8 * marks / n)}", f"size {min(14, n.bit_length())}"]
    return list(known), [zlib.crc32(s.encode(), 1) % size for s in shape]


def index(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def rated_features(docs: DataFrame, rated: DataFrame, *, grade: str, sample: int, sample_features: int, size: int, key: str = "doc_id", text: str = "text") -> list:
    """(grade, feature indices) of at most ``sample`` rated documents, taken by a hash of their keys, in turn as long as
    they have at most ``sample_features`` features together: that is what the driver holds, however long texts are."""
    graded = rated.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(grade).alias("grade"))
    n = max(1, graded.count())
    share = F.shiftrightunsigned(F.xxhash64(key), 1) / F.lit(float(1 << 63))
    few = graded.where(share * n < 2 * sample)  # about twice the sample, so that it needn't be taken from all
    taken = few.orderBy(F.xxhash64(key), key).limit(sample)

    def make():
        def work(texts):
            out = []
            for x in texts:
                known, shape = features(x, size)
                out.append((sorted({index(t, size) for t in known} | set(shape)),))
            return out

        return work

    some = docs.select(key, text).join(F.broadcast(taken.select(key)), key, "left_semi")
    found = over_texts(some, make, "found array<int>", key=key, text=text).join(F.broadcast(taken), key)
    held = F.sum(F.size("found")).over(Window.orderBy(F.xxhash64(key), key, "found").rowsBetween(Window.unboundedPreceding, 0))  # of a sample
    return found.withColumn("held", held).where(F.col("held") <= sample_features).select("grade", "found").collect()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Likelihood:
    """The mean log-likelihood of rated documents under weights and thresholds, and its slopes."""

    def __init__(self, rows: list, size: int, decay: float):
        self.y = np.array([r["grade"] for r in rows])
        self.at = np.concatenate([np.asarray(r["found"], dtype=np.int64) for r in rows])
        sizes = np.array([len(r["found"]) for r in rows])
        self.owner, self.begin = np.repeat(np.arange(len(rows)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size, self.decay = size, decay

    def _sides(self, w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(grade <= y) and P(grade < y) of each document."""
        score, edges = np.add.reduceat(w[self.at], self.begin), np.concatenate([[-np.inf], theta, [np.inf]])
        return _sigmoid(edges[self.y + 1] - score), _sigmoid(edges[self.y] - score)

    def loss(self, w: np.ndarray, theta: np.ndarray) -> float:
        hi, lo = self._sides(w, theta)
        return -np.log(np.maximum(hi - lo, 1e-9)).mean() + self.decay * (w @ w) / 2

    def slopes(self, w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi, lo = self._sides(w, theta)
        p, y = np.maximum(hi - lo, 1e-9), self.y
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p  # slopes of log p by the upper and the lower edge
        g = np.bincount(self.at, weights=((d_hi - d_lo) / len(y))[self.owner], minlength=self.size) + self.decay * w
        return g, np.array([(np.sum(d_lo[y == k + 1]) - np.sum(d_hi[y == k])) / len(y) for k in range(len(theta))])


def fit(rows: list, *, grades: int, size: int, steps: int = 120, rate: float = 0.05, prior: float = 3.0, support: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch gradient steps with momentum; all zeros if there are no rows.

    Features of fewer than ``support`` documents of the sample have no weight. ``prior`` is how strongly weights are held
    to zero, in documents: the more of them there are, the less it counts.
    """
    w, theta = np.zeros(size), np.linspace(-2, 2, grades - 1) if grades > 1 else np.zeros(0)
    often = np.bincount(np.concatenate([np.asarray(r["found"], dtype=np.int64) for r in rows] or [np.zeros(0, np.int64)]), minlength=size) >= support
    rows = [{"grade": r["grade"], "found": [i for i in r["found"] if often[i]]} for r in rows]
    rows = sorted((r for r in rows if r["found"]), key=lambda r: (r["grade"], r["found"]))
    if not rows:
        return w, theta
    model = Likelihood(rows, size, prior / len(rows))
    m, v, mt, vt = np.zeros(size), np.zeros(size), np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g, gt = model.slopes(w, theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        theta = np.maximum.accumulate(theta - rate * (mt / a) / (np.sqrt(vt / b) + 1e-8))
    return w, theta


def score(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, *, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, grade, tail, kept`` of every whole text: expected grade, P(highest grade) and whether that is >= least.

    Null and empty texts have only the shape's features. One row for each input row; a table without rows gives none.
    Columns but key and text are not read, whatever their names.
    """
    size, sc = len(weights), docs.sparkSession.sparkContext
    shared = sc.broadcast((weights.astype(np.float32), thresholds))  # bounded by the number of features

    def make():
        w, theta = shared.value
        known_at, weight = held(("quality", zlib.crc32(w.tobytes())), lambda: ({}, w.tolist()))

        def one(x: str):
            known, shape = features(x, size)
            if len(known_at) > STORE:
                known_at.clear()
            spots = set(shape)
            for t in known:
                i = known_at.get(t)
                if i is None:
                    i = index(t, size)
                    if len(t) <= 64:
                        known_at[t] = i
                spots.add(i)
            total = sum(weight[i] for i in sorted(spots))
            above = 1 / (1 + np.exp(np.clip(theta - total, -40, 40)))  # P(grade > k)
            tail = float(above[-1]) if len(above) else 1.0
            return float(above.sum()), tail, tail >= least

        return lambda texts: [one(x) for x in texts]

    return over_texts(docs, make, "grade double, tail double, kept boolean", key=key, text=text)


def classify(docs: DataFrame, rated: DataFrame, *, grade: str, grades: int, sample: int = 6_000, sample_features: int = 4_000_000, size: int = 1 << 18, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on a sample of at most ``sample`` rated documents, of at most ``sample_features`` features together, and score
    all; see ``score`` for the columns. Of repeated ratings of a key the lowest counts; null keys and grades aren't
    learned from. Without rated documents all weights are zero, and an empty table of documents gives no rows."""
    w, theta = fit(rated_features(docs, rated, grade=grade, sample=sample, sample_features=sample_features, size=size, key=key, text=text), grades=grades, size=size)
    return score(docs, w, theta, least=least, key=key, text=text)
