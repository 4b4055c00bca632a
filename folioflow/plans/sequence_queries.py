"""Queries of alignment, common subsequences, exact merge, wrapping and noise. Those without SQL are tested by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators.ranks import numbered
from ..sources.fixtures import TOK_SQL, boxes, detected, read
from ..sources.stored import stored
from .registry import _tok, query

_EDGE = S.EDGE.replace("'", "''")


@query(f"WITH {TOK_SQL}, w AS (SELECT doc_id, ln, wn, trim(tok, '{_EDGE}') AS word FROM tok) SELECT doc_id, ln, wn, word FROM w WHERE regexp_matches(lower(word), '[a-z0-9]')")
def txt5_transcript_words(spark, d):
    words = S.transcript_words(_tok(spark, d).withColumnRenamed("tok", "text"))
    return words.select("doc_id", "ln", "wn", "word")


@query()
def txt4_similarity(spark, d):
    """Labels that a second detection read otherwise, with their similarity."""
    tok = _tok(spark, d)
    pairs = boxes(tok).select("page_key", "box_id", "text").join(detected(tok).select("page_key", "box_id", F.col("text").alias("again")), ["page_key", "box_id"]).where("text <> again")
    return pairs.select("page_key", "box_id", S.similarity("text", "again").alias("sim"))


@query()
def txt18_word_sync(spark, d):
    """Each turn of a conversation as an edit of the turn before it."""
    words = F.posexplode(F.split("text", r"\s+")).alias("ord", "word")
    turns = stored(read(spark, d, "conversations").select("conv_id", "turn", words))
    number = numbered(turns.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "doc_id")
    after = turns.join(number, ["conv_id", "turn"]).select("doc_id", "ord", "word")
    before = turns.withColumn("turn", F.col("turn") + 1).join(number, ["conv_id", "turn"]).select("doc_id", "ord", "word")
    return S.synced(before, after)


@query()
def noi1_unit_noise(spark, d):
    return read(spark, d, "documents").select("doc_id", S.unit_noise(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("u"), S.drift(F.lit(7), F.col("doc_id") % 9, F.col("doc_id") / 8, 0.5).alias("drift"))


