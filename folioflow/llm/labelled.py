"""What a bounded sample of labelled texts, as sparse features, teaches; learnt by one task, so that the driver gets the weights only."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, Words, released, slices


#: Bytes of features of a sample, at most; and of the texts that a worker makes features of, or scores, at a time.
SAMPLE_BYTES = 128 << 20
TEXT_BYTES = 1 << 18


def _order(identity: object) -> int:
    number = identity if isinstance(identity, int) else int.from_bytes(hashlib.md5(str(identity).encode()).digest()[:8])
    return number * 0x9E3779B97F4A7C15 % (1 << 64)


#: (label, feature indexes, counts, words) of a text.
Row = tuple[int, np.ndarray, np.ndarray, int]


def learnt(docs: DataFrame, labels: DataFrame, column: str, features: Callable[[Words], tuple[np.ndarray, np.ndarray]], bits: int, rows: int, learn: Callable[[list[Row]], list[np.ndarray]]) -> list[np.ndarray]:
    """What learn() makes of at most `rows` labelled documents, in an order set by a hash of the id.

    labels: doc_id and the label column; null labels are left out, of several labels for one id the largest holds, and of
    several texts with one id the one with the least features by their bytes. The sample (not above `rows` ids) is
    broadcast, so that the texts are read once and not shuffled; features past SAMPLE_BYTES, in the order of a hash of the
    id, are left out. The task that ends with all features runs learn(); only its arrays go to the driver.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXT_BYTES):
            words = Words(batch.column(1), *getattr(features, "args", ()))
            doc, feature = features(words)
            feature = (feature >> U(64 - bits)).astype(np.int64)
            order = np.lexsort((feature, doc))
            doc, feature = doc[order], feature[order]
            begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])])) if len(doc) else np.zeros(0, int)
            count = np.diff(np.append(begin, len(doc))).astype(np.int32)
            cut = np.searchsorted(doc[begin], np.arange(words.n_docs + 1))
            idx = feature[begin].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([idx[cut[i] : cut[i + 1]].tobytes() for i in range(words.n_docs)], pa.binary()), pa.array([count[cut[i] : cut[i + 1]].tobytes() for i in range(words.n_docs)], pa.binary()), pa.array(words.count.astype(np.int64))],
                names=["doc_id", "label", "idx", "count", "words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(lambda batches: released(extract(batches)), f"doc_id {kind}, label int, idx binary, count binary, words long")
    found = found.groupBy("doc_id").agg(F.min(F.struct("idx", "count", "words", "label")).alias("f")).select("doc_id", "f.*")

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, held = [], 0
        for batch in batches:
            for number, label, idx, count, words in zip(*(batch.column(c) for c in ("doc_id", "label", "idx", "count", "words"))):
                idx, count = (np.frombuffer(x.as_buffer(), np.int32) for x in (idx, count))  # views of the batch, no copies
                held += idx.nbytes
                if held <= SAMPLE_BYTES:
                    every.append((_order(number.as_py()), str(number.as_py()), len(every), (label.as_py(), idx, count, words.as_py())))
        every.sort(key=lambda x: x[:3])
        arrays = learn([row for *_, row in every])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(arrays)), pa.int32()), pa.array([_saved(x) for x in arrays], pa.binary())], names=["number", "array"])

    # one task for a sample of bounded rows; they are sorted once, and no window holds them again
    found = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    parts = found.mapInArrow(lambda batches: released(taught(batches)), "number int, array binary").toArrow().to_pylist()
    parts.sort(key=lambda r: r["number"])
    # an empty table may have no task
    return [np.load(io.BytesIO(r["array"])) for r in parts] if parts else learn([])


def _saved(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()
