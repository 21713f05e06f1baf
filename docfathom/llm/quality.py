"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text gives two streams of tokens, its lower-cased words and their shapes (case, digits, symbols, repeats of the word
before), and each stream its n-grams of one and two tokens, hashed into 2**BITS weights. The value of an n-gram is its
count, the vector has length one, and the score is the logistic function of the sparse dot product.

Training reads at most `rows` labelled documents, those of the smallest hash of doc_id, so one task can hold them. The
learned weights (8 * 2**BITS bytes at most) reach the driver and from there every scoring task.

Defined results: null and empty texts score by the bias alone; null labels and doc_ids are not learned from; an empty
label table gives the score 0.5; rows that repeat get equal scores and are learned from once (of texts under one doc_id
the first in order); texts of any length are read whole; labels that tie in hash go by doc_id; other columns are only
passed on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash

BITS = 18
#: Labelled documents that are learned from, at most.
ROWS = 12_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
MEMO = 300_000

_memo: dict[str, tuple[int, int]] = {}


def shape(token: str) -> str:
    first = token[0]
    if not first.isalnum():
        return token[:4]
    if token.isdigit():
        return "9" * min(3, len(token))
    if token.isalpha():
        case = "aa" if token.islower() else "AA" if token.isupper() and len(token) > 1 else "Aa" if first.isupper() and (token[1:].islower() or len(token) == 1) else "aA"
        return case + "+" * (len(token) > 12)
    return "a9"


def hashes(token: str) -> tuple[int, int]:
    return xxhash.xxh32_intdigest(token.lower()), xxhash.xxh32_intdigest("\t" + shape(token))


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the text's sparse vector."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    memo = _memo
    if len(memo) > MEMO:
        memo.clear()
    for t in set(tokens).difference(memo):
        memo[t] = hashes(t)
    both = np.array([memo[t] for t in tokens], dtype=np.uint64)
    word, form = both[:, 0], both[:, 1].copy()
    form[1:][word[1:] == word[:-1]] += np.uint64(7919)  # the word before again
    mask = np.uint64((1 << BITS) - 1)
    mixed = [h * np.uint64(0x9E3779B1) for h in (word, form)]
    pairs = [(h[:-1] * np.uint64(0x85EBCA6B) + h[1:] * np.uint64(0xC2B2AE35)) for h in (word, form)]
    every = np.concatenate([*mixed, *pairs])
    index = ((every ^ (every >> np.uint64(29))) & mask).astype(np.int64)
    index, count = np.unique(index, return_counts=True)
    value = np.sqrt(count)
    return index, value / np.sqrt((value**2).sum())


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias and not regularised."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (logistic(w @ x) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights that are not zero, learned in one task from a sample bounded by `rows`."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = F.broadcast(sample_by_hash(chosen, "doc_id", rows))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # rows may repeat

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                                              pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "y", "i", "v"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl((1 << BITS) + 1)
        frame = frame.sort_values(["order", "y"], kind="stable")
        examples = [(i.astype(np.int64), v.astype(float), y) for i, v, y in zip(frame.i, frame.v, frame.y, strict=True)]
        for _ in range(EPOCHS):
            for i, v, y in examples:
                model.learn(i, v, y)
        every = np.arange(len(model.z))
        w = model.weights(every)
        return pd.DataFrame({"i": every[w != 0], "w": w[w != 0]})

    found = texts.select("doc_id", "text", "y").mapInArrow(vectors, "doc_id long, y int, i array<int>, v array<float>")
    model = found.withColumn("order", F.xxhash64("doc_id")).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda f: fit(f), "i long, w double").toPandas()
    return model["i"].to_numpy(np.int64), model["w"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and `_df_score`, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*[F.col(f"`{k}`") for k in keep]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                i, v = vector(text)
                found.append(logistic(w[i] @ v + w[-1]))
            names = [f.name for f in batch.schema][1:]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], names=[*names, "_df_score"])

    return docs.select(F.col("text").alias("_df_text"), *[F.col(f"`{k}`") for k in keep]).mapInArrow(run, fields.add("_df_score", "double"))
