"""Quality classifier: logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader.

Features are 1- and 2-grams of folded words and 1- to 3-grams of word shapes (kinds of characters, closing mark, length,
repeats the word before). A feature's value is its share of the document's words, so that the score is a mean of
weights: a sparse dot product that needs neither sorting nor any document's vector in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ftrl import Ftrl, sigmoid
from .kernels import U, Words, mix, released, text_slices
from .labelled import TEXT_BYTES, Row, learnt

BITS = 20
SAMPLE_ROWS = 8000
EPOCHS = 3
SCALE = 30.0

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KIND[_c] = 16 if chr(_c) in ".,;:'\"!?-()" else 8


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 64-bit feature) of every n-gram."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    if not n:
        return doc, h
    kinds = np.bitwise_or.reduceat(_KIND[words.data], words.start).astype(U)
    last = words.data[words.end - 1]
    mark = np.where(_KIND[last] >= 8, last, 0).astype(U)
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    capital = (_KIND[words.data[words.start]] == 2).astype(U)
    shape = mix(kinds | (mark << U(8)) | (np.minimum(words.end - words.start, 15) >> 2).astype(U) << U(16) | again.astype(U) << U(24) | capital << U(25), 5)
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pair = mix(shape[:-1], 6) + shape[1:]
    return (
        np.concatenate([doc, doc[1:][two], doc, doc[1:][two], doc[2:][three]]),
        np.concatenate([mix(h, 1), mix(mix(h[:-1], 2) + h[1:], 2)[two], mix(shape, 3), mix(pair, 4)[two], mix(mix(pair[:-1], 7) + shape[2:], 5)[three]]),
    )


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights (the last is the bias) from at most sample_rows labelled rows; a documented bound, not a cut of what is scored."""
    return learnt(docs, labels, column, ngrams, BITS, sample_rows, learn)[0]


def learn(rows: list[Row]) -> list[np.ndarray]:
    """[weights]"""
    model, bias = Ftrl(BITS, alpha=0.3, beta=0.05, l1=0.02, l2=0.0), 0.0
    for _ in range(EPOCHS):
        for label, idx, count, n in rows:
            val = SCALE * count / max(n, 1)
            g = float(sigmoid(bias + model.score(idx, val))) - min(max(label, 0), 1)
            model.step(idx, val, g)
            bias -= 0.02 * g
    return [np.append(model.weights(), bias).astype(np.float32)]


def scorer(docs: DataFrame, labels: DataFrame, column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Callable[[Column], Column]:
    """A function of a text column: the probability of label 1, double. The model goes to the executors once; of a row,
    only its text does to Python."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, column, sample_rows))

    def scored(text: pa.Array) -> np.ndarray:
        weights, words = model.value, Words(text)
        doc, feature = ngrams(words)
        total = np.bincount(doc, weights[(feature >> U(64 - BITS)).astype(np.int64)], words.n_docs)
        return sigmoid(float(weights[-1]) + SCALE * total / np.maximum(words.count, 1))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(pa.array(np.concatenate([np.zeros(0), *(scored(part) for part in text_slices(text, TEXT_BYTES))])) for text in texts)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, column: str = "quality", keep: tuple[str, ...] = ("doc_id",), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs' `keep` columns and score double, the probability of label 1 of every row's whole text.

    Only text counts. Null and blank texts are scored by the bias alone; very long texts are scored whole, alone; repeated rows
    get equal scores; without a labelled row every score is 0.5; ids may be of any type; columns not kept are ignored, and a
    kept one named score must be renamed first (scorer() has no such name); an empty table gives an empty result.
    """
    return docs.select(*keep, scorer(docs, labels, column, sample_rows)(F.col("text")).alias("score"))
