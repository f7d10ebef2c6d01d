"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is encoded from its
words' make-up (case, digits, marks, shapes, repetition), gated attention weighs
the passages, and the weighted sum is scored.  Only document labels are learnt
from: attention weights and passage encoder are trained together by gradient
descent in numpy on a bounded sample of labelled documents (``max_docs``, taken
in order of a hash of doc_id; their passages' features come to the driver).
Scoring covers every passage of every document.

Defined cases: null and empty texts are one passage without words and get a
score; repeated labels of a document count as 1 if any is 1, null labels are
left out; without labels of both kinds every score is the share of label 1 (0.5
without any).  Columns other than key and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import resident, table

PASSAGE, SHAPES = 64, 32
_WORD = 8
FEATURES = _WORD + SHAPES + 3
MEMO = 150_000
MAX_DOCS = 4_000
ACCEPT = 0.7


def _word_row(word: str) -> list[float]:
    upper = sum(c.isupper() for c in word)
    alpha = sum(c.isalpha() for c in word)
    digit = sum(c.isdigit() for c in word)
    n = len(word)
    tail = n - len(word.rstrip("!?*$%&#@~^_=+|<>-"))
    row = [min(n, 30) / 10, upper / n, digit / n, (n - alpha - digit) / n, float(n > 1 and upper == alpha > 0), float(tail > 1), float(alpha == 0), float(n > 20)]
    shape, last = [], ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if kind != last:
            shape.append(kind)
            last = kind
    hot = [0.0] * SHAPES
    hot[zlib.crc32("".join(shape).encode()) % SHAPES] = 1.0
    return row + hot


class Encoder:
    """Passage features; remembers each word's row."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((MEMO + 1, _WORD + SHAPES), np.float32)

    def encode(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros((1, FEATURES), np.float32)
        at = self.at
        new = {w for w in words if w not in at}
        if len(at) + len(new) > MEMO:
            at.clear()
            new = set(words)
        if len(new) > MEMO:
            half = PASSAGE * (len(words) // PASSAGE // 2)
            return np.concatenate([self.encode(" ".join(words[:half])), self.encode(" ".join(words[half:]))])
        for w in new:
            self.rows[len(at)] = _word_row(w)
            at[w] = len(at)
        ids = np.array([at[w] for w in words])
        starts = np.arange(0, len(ids), PASSAGE)
        sizes = np.diff(np.append(starts, len(ids)))
        out = np.empty((len(starts), FEATURES), np.float32)
        out[:, : _WORD + SHAPES] = np.add.reduceat(self.rows[ids], starts, axis=0) / sizes[:, None]
        again = np.append(ids[1:] == ids[:-1], False).astype(np.float32)
        out[:, -3] = np.add.reduceat(again, starts) / sizes
        out[:, -2] = [len(set(words[s : s + PASSAGE])) for s in starts] / sizes
        out[:, -1] = np.log1p(sizes) / 5
        return out


def encoder() -> Encoder:
    return resident("encoder", Encoder)


@dataclass
class Model:
    """Weights of encoder, gated attention and score; mean and scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    base: float

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        w = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, s = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * s) @ w["att"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-(z @ w["out"] + w["out0"])))
        return p, {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Scores of bags of passages, each bag by itself so that equal texts score alike."""
        if not self.weights:
            return np.full(len(bags), self.base)
        first = np.zeros(1, np.int64)
        return np.array([round(float(self.forward(b.astype(np.float64), first)[0][0]), 6) for b in bags])


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 200, rate: float = 0.02, hidden: int = 16, seed: int = 8) -> Model:
    """Train on bags of passages and their documents' labels (Adam, full batch, weight decay)."""
    y = np.asarray(labels, np.float64)
    base = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, base)
    x = np.concatenate(bags).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    rng = np.random.default_rng(seed)
    shape = {"enc": (FEATURES, hidden), "enc0": (hidden,), "tanh": (hidden, hidden), "gate": (hidden, hidden), "att": (hidden,), "out": (hidden,), "out0": ()}
    w = {k: np.asarray(rng.normal(0, 0.2, s)) if not k.endswith("0") else np.zeros(s) for k, s in shape.items()}
    model = Model(x.mean(0), x.std(0) + 1e-3, w, base)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for step in range(1, epochs + 1):
        p, c = model.forward(x, starts)
        h, t, s, a, bag = c["h"], c["t"], c["s"], c["a"], c["bag"]
        d = (p - y) / len(y)
        dz = np.outer(d, w["out"])[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dg = np.outer(de, w["att"])
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["tanh"].T + ds @ w["gate"].T) * (1 - h * h)
        g = {"enc": c["x"].T @ dh, "enc0": dh.sum(0), "tanh": h.T @ dt, "gate": h.T @ ds, "att": (t * s).T @ de, "out": c["z"].T @ d, "out0": d.sum()}
        for k in w:
            grad = g[k] + 1e-4 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def is_held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled documents outside the held-out quarter."""
    known = labels.filter(F.col(label).isNotNull() & ~is_held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(max_docs)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_key")
    rows = rows.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))  # one row a key, however often it is repeated

    def encode(batches):
        for pdf in batches:
            bags = [encoder().encode(t) for t in pdf["_text"]]
            yield pd.DataFrame({"_key": pdf["_key"], "label": pdf["_label"].astype("int32"), "n": [len(b) for b in bags], "bag": [b.tobytes() for b in bags]})

    got = rows.mapInPandas(encode, "_key long, label int, n int, bag binary").toPandas().sort_values("_key", kind="stable")
    return fit([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["bag"]], got["label"].to_numpy())


def scorer(model: Model):
    """Column function: quality score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([model.score([encoder().encode(t) for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)] or [np.zeros(0)]))

    return score


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    scored = docs.select(F.col(key).alias("doc_id"), is_held_out(F.col(key)).alias("held_out"), scorer(model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below the mark go.

    Null and empty texts are scored like others; equal texts fare alike; repeated rows
    stay or go together; an empty table, or labels of no kind, gives an empty result.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(scorer(model)(F.col("text")) >= ACCEPT)
