"""Document quality with a byte convolutional network over overlapping chunks of the whole text.

Chunks of ``CHUNK`` bytes begin every ``HOP`` bytes, so every byte of a text lies in one at least. The filters'
maxima of a chunk give its logit; mean, lowest and highest chunk logit and the text's length in chunks are combined
into one probability by a logistic layer. Both are trained in numpy on a bounded sample of labelled texts
(``sample`` documents, ``per_text`` chunks of each) on the driver.

Defined results: null and empty texts are scored as one chunk of padding; repeated rows get equal scores; an empty
table gives an empty result; other columns are not read. Training needs both labels, else every score is the share
of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytecnn import ByteConvNet, cut_windows
from .common import bounded_sample

CHUNK, HOP = 320, 256
GOOD = 0.7  # fixed value: a document is accepted from this score on


def combine(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(texts, features): mean, lowest and highest chunk logit, logarithm of the number of chunks, one."""
    count = np.bincount(owner, minlength=n)
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, owner, logits)
    np.maximum.at(high, owner, logits)
    return np.stack([np.bincount(owner, logits, n) / count, low, high, np.log1p(count), np.ones(n)], 1)


@dataclass
class QualityModel:
    net: ByteConvNet | None
    last: np.ndarray
    share: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        windows, owner = cut_windows([(t or "").encode() or b"\0" for t in texts], CHUNK, HOP)
        z = self.net.logits(windows)
        return combine((z[:, 1] - z[:, 0]).astype(float), owner, len(texts))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.last, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps on the penalised log-likelihood."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = 5000, per_text: int = 6, steps: int = 1800) -> QualityModel:
    """``labels``: (id, label 0 or 1) of the rows to learn from. The sample is drawn from the labels before texts are joined."""
    drawn = bounded_sample(labels.select(id_col, F.col(label_col).cast("int").alias("label")).where(F.col(label_col).isin(0, 1)).distinct(), id_col, sample)
    spark = docs.sparkSession
    small = spark.createDataFrame([(r[id_col], r["label"]) for r in drawn], f"{id_col} long, label int")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).join(F.broadcast(small), id_col).collect()  # at most ``sample`` ids
    rows = sorted(rows, key=lambda r: (r[id_col], r["text"] or ""))
    y = np.array([r["label"] for r in rows], int)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y)) < 2:
        return QualityModel(None, np.zeros(5), share)
    windows, owner = cut_windows([(r["text"] or "").encode() or b"\0" for r in rows], CHUNK, HOP)
    rng = np.random.default_rng(5)
    order = np.lexsort((rng.random(len(owner)), owner))
    place = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
    keep = np.sort(order[place < per_text])
    # short texts are rare, yet must not be judged by their padding: one short cut of every text is learned too
    short = [(r["text"] or "").encode()[:n] or b"\0" for r, n in zip(rows, rng.integers(12, 160, len(rows)), strict=True)]
    extra, extra_owner = cut_windows(short, CHUNK, HOP)
    seen, whose = np.concatenate([windows[keep], extra]), np.concatenate([owner[keep], extra_owner])
    weight = np.where(y == 1, 1 / share, 1 / (1 - share))
    net = ByteConvNet(classes=2, widths=(3, 5, 8), filters=12, seed=2)
    net.fit(seen, y[whose], np.sqrt(weight)[whose], steps=steps)
    model = QualityModel(net, np.zeros(5), share)
    z = net.logits(windows)
    model.last = logistic(combine((z[:, 1] - z[:, 0]).astype(float), owner, len(rows)), y.astype(float))
    return model


def verdict(model: QualityModel, text: Column, batch: int = 256) -> Column:
    """struct(score, predicted) of a whole text."""
    @F.pandas_udf("score double, predicted int")
    def judge(texts: pd.Series) -> pd.DataFrame:
        score = np.concatenate([model.score(list(texts[i:i + batch])) for i in range(0, len(texts), batch)] or [np.zeros(0)])
        return pd.DataFrame({"score": score, "predicted": (score >= GOOD).astype("int32")})

    return judge(text)


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    return docs.select(F.col(id_col).cast("long").alias(id_col), verdict(model, F.col(text_col)).alias("v")).select(id_col, "v.score", "v.predicted")


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least ``GOOD``, all their columns as they are."""
    return docs.where(verdict(model, F.col(text_col))["predicted"] == 1)
