"""Toxicity: a cumulative-link (proportional odds) model of severity grades over sparse word features.

P(grade <= k) = sigmoid(t_k - w.x): the grades share the weights w, only the ordered thresholds t differ. w is learnt by
follow-the-regularised-leader, so that it stays sparse; the thresholds by plain steps, kept in order. Where labels hold 0
and 1 only, severity_grades() spreads the ones over grades by how much evidence a text holds: occurrences of terms whose
log-odds for label 1 are high in the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ftrl import Ftrl, sigmoid
from .kernels import PUNCT, U, Words, mix, released, text_slices
from .labelled import TEXT_BYTES, Row, learnt

BITS = 18
SAMPLE_ROWS = 8000
EPOCHS = 8
STEMS = (4, 5, 6, 7, 8)
#: Occurrences of evidence from which a text labelled 1 is of grade 2, and of grade 3.
EVIDENCE = (3, 6)
MIN_TEXTS, MIN_LOG_ODDS, MIN_Z = 3, 3.0, 4.0


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 64-bit feature) of every word, and of the first bytes of longer ones, for inflected and compound forms."""
    doc, feature = [words.doc], [mix(words.hash, 9)]
    for k in STEMS:
        long = words.end - words.start > k
        doc.append(words.doc[long])
        feature.append(mix(words.hashed(words.start[long], words.start[long] + k), 9 + k))
    return np.concatenate(doc), np.concatenate(feature)


terms.args = (PUNCT,)


def severity_grades(rows: list[Row]) -> list[int]:
    """A grade for each sampled row: its label if labels go beyond 1, else 0, or 1 to 3 by evidence."""
    if any(label > 1 for label, *_ in rows):
        return [max(label, 0) for label, *_ in rows]
    seen = np.zeros((2, 1 << BITS))
    many = np.zeros(2)
    for label, idx, _, _ in rows:
        seen[int(label > 0), idx] += 1
        many[int(label > 0)] += 1
    odds = np.log((seen[1] + 0.5) / (many[1] + 1)) - np.log((seen[0] + 0.5) / (many[0] + 1))
    evidence = (odds >= MIN_LOG_ODDS) & (seen[1] >= MIN_TEXTS)
    return [0 if label <= 0 else 1 + sum(count[evidence[idx]].sum() >= e for e in EVIDENCE) for label, idx, count, _ in rows]


def telling(rows: list[Row]) -> np.ndarray:
    """Features of MIN_TEXTS sampled texts or more whose shares among texts labelled 0 and above 0 differ by MIN_Z standard errors."""
    seen, many = np.zeros((2, 1 << BITS)), np.zeros(2)
    for label, idx, _, _ in rows:
        seen[int(label > 0), idx] += 1
        many[int(label > 0)] += 1
    many = np.maximum(many, 1)
    share = seen.sum(0) / many.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / many).sum())
    return (seen.sum(0) >= MIN_TEXTS) & (np.abs(seen[1] / many[1] - seen[0] / many[0]) >= MIN_Z * error)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from at most sample_rows labelled rows."""
    weights, t = learnt(docs, labels, column, terms, BITS, sample_rows, learn)
    return weights, t


def learn(rows: list[Row]) -> list[np.ndarray]:
    """[weights, thresholds]"""
    grades = severity_grades(rows)
    often = telling(rows)
    rows = [(label, idx[often[idx]], count[often[idx]], n) for label, idx, count, n in rows]
    top = max([1, *grades])
    model, t = Ftrl(BITS, alpha=1.0, beta=0.5, l1=0.1, l2=0.0), np.linspace(1.0, 1.0 + top - 1, top)
    for epoch in range(EPOCHS):
        for (_, idx, count, _), y in zip(rows, grades):
            val = np.log2(1.0 + count)
            s = model.score(idx, val)
            above = float(sigmoid(t[y] - s)) if y < top else 1.0
            below = float(sigmoid(t[y - 1] - s)) if y else 0.0
            model.step(idx, val, 1.0 - above - below)  # d(-log P(y)) / ds
            rate = 0.05 / (1 + epoch)
            gap = max(above - below, 0.05)
            if y < top:
                t[y] += rate * above * (1 - above) / gap
            if y:
                t[y - 1] -= rate * below * (1 - below) / gap
            for k in range(1, top):
                t[k] = max(t[k], t[k - 1] + 0.1)
    return [model.weights().astype(np.float32), t]


def grader(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Callable[[Column], Column]:
    """A function of a text column: struct(severity double, grade int, toxic boolean). The model goes to the executors
    once; of a row, only its text does to Python."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, column, sample_rows))

    def graded(text: pa.Array) -> pa.StructArray:
        weights, t = model.value
        words = Words(text, PUNCT)
        doc, index = terms(words)
        index = (index >> U(64 - BITS)).astype(np.int64)
        used = weights[index] != 0
        key, count = np.unique((doc[used].astype(np.int64) << BITS) | index[used], return_counts=True)
        s = np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)] * np.log2(1.0 + count), words.n_docs)
        over = 1 - sigmoid(t[None, :] - s[:, None])
        share = -np.diff(np.concatenate([np.ones((len(s), 1)), over, np.zeros((len(s), 1))], 1), axis=1)
        return pa.StructArray.from_arrays([pa.array(over.sum(1)), pa.array(share.argmax(1).astype(np.int32)), pa.array(over[:, 0] > 0.5)], ["severity", "grade", "toxic"])

    @F.arrow_udf("severity double, grade int, toxic boolean")
    def grades(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(whole(texts))

    def whole(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = [graded(part) for part in text_slices(text, TEXT_BYTES)]
            yield pa.concat_arrays(parts) if parts else graded(text)

    return grades


def severities(docs: DataFrame, labels: DataFrame, column: str = "toxic", keep: tuple[str, ...] = ("doc_id",), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs' `keep` columns, severity double (expected grade), grade int (the likeliest) and toxic boolean (a grade
    above 0 is likelier than 0), of every row's whole text.

    Null and blank texts have no feature and get the grade of the thresholds alone; very long texts are scored whole, alone;
    repeated rows get equal results; without a labelled row nothing is toxic; ids may be of any type; columns not kept are
    ignored, and kept ones named severity, grade or toxic must be renamed first (grader() has no such names); an empty table
    gives an empty result.
    """
    graded = docs.select(*keep, grader(docs, labels, column, sample_rows)(F.col("text")).alias("graded_text"))
    return graded.select(*keep, "graded_text.severity", "graded_text.grade", "graded_text.toxic")
