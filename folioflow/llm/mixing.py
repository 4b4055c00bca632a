"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal size in words. Slot i falls on the van der Corput point of i (its bits mirrored), which
the sources' cumulative targets map to a source; the slots of a source are ranked, and rank r takes the words
[r * block, (r + 1) * block) of the source's documents, put in an order set by a hash and repeated end to end. So every
prefix of the schedule has the target weights nearly, and a source's words are taken evenly.

A block holds max(16, words of the mix / 2**20) words, hence no more than about a million slots at any input size: ranking
them is bounded work. What blocks can't resolve is made up by slots after the last: once blocks are longer than 16 words, and
for any source of fewer than FEW blocks, a source gets the ranks that its scheduled slots leave out, so that it takes the
whole words of its target.
Running word counts of a hot source are summed in 4,096 hash ranges first, so that no task gets a
whole source; blocks join slots on (source, rank), which spreads any source over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SLOTS = 1 << 20
LEAST = 16
FEW = 64
CELLS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source as key (null apart from any string), words, and a place in the shuffled order."""
    return docs.select(
        "doc_id",
        F.concat(F.lit("s"), "source").alias("k"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("h"),
    ).withColumn("k", F.coalesce("k", F.lit("n")))


def source_targets(sizes: DataFrame) -> DataFrame:
    """k, source_size, target, and the bounds lo, hi of the source's part of [0, 1), with total words and block size.

    Shares by weight that exceed MOST times a source's words stop there, and the excess goes to the others by weight until
    none is above: with sources in order of cap / weight, the level is the largest (rest of the total) / (rest of the weights).
    """
    per = sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
    # 'n' of a null source sorts after every 's...' once told apart
    place = F.row_number().over(W.orderBy(F.col("k") == "n", "k"))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = per.withColumn("place", place).withColumn("w", weight).withColumn("total", SHARE * F.sum("source_size").over(every))
    by_cap = W.orderBy(F.col("source_size") / F.col("w"), "place")
    left = F.col("total") - MOST * (F.sum("source_size").over(by_cap.rowsBetween(W.unboundedPreceding, 0)) - F.col("source_size"))
    level = left / F.sum("w").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    ranked = ranked.withColumn("target", F.least(MOST * F.col("source_size").cast("double"), F.col("level") * F.col("w")))
    hi = F.sum("target").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    ranked = ranked.withColumn("hi", hi).withColumn("block", F.greatest(F.lit(LEAST), F.ceil(F.col("total") / SLOTS)).cast("long"))
    return ranked.select("k", "source_size", "target", "total", "block", (F.col("hi") - F.col("target")).alias("lo"), F.when(F.col("place") == F.max("place").over(every), F.col("total") + 1).otherwise(F.col("hi")).alias("hi"))


def schedule(targets: DataFrame) -> DataFrame:
    """(slot, k, rank): which source each slot takes from, and how many slots of that source came before. Slots from
    ceil(total / block) on are those that make up for what the schedule leaves out."""
    one = targets.agg(F.max("total").alias("total"), F.max("block").alias("block")).where("total > 0")
    slots = one.select("total", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("total") / F.col("block")) - 1).cast("long"))).alias("slot"))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), 32, "0")), 2, 10).cast("double") / float(1 << 32) * F.col("total")
    slots = slots.select("slot", point.alias("u"), F.floor(point / F.col("total") * CELLS).alias("cell"))
    last = F.lit(CELLS - 1)
    spans = targets.where("target > 0").select("k", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") / F.col("total") * CELLS), last), F.least(F.floor(F.col("hi") / F.col("total") * CELLS), last))).alias("cell"))
    picked = slots.join(spans.hint("merge"), "cell").where("u >= lo and u < hi").select("slot", "k")
    picked = written(picked.select("slot", "k", (F.row_number().over(W.partitionBy("k").orderBy("slot")) - 1).cast("long").alias("rank")))
    needed = F.ceil(F.floor("target") / F.col("block"))
    short = targets.withColumn("needed", needed).join(picked.groupBy("k").agg(F.count("*").alias("ranks")), "k", "left").withColumn("ranks", F.coalesce("ranks", F.lit(0).cast("long")))
    short = short.where((F.col("needed") > F.col("ranks")) & ((F.col("block") > LEAST) | (F.col("needed") < FEW)))
    upto = F.sum(F.col("needed") - F.col("ranks")).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    short = short.withColumn("from", F.ceil(F.col("total") / F.col("block")) + upto - F.col("needed"))
    rest = short.select("from", "k", F.explode(F.sequence("ranks", F.col("needed") - 1)).alias("rank"))
    return picked.union(rest.select((F.col("from") + F.col("rank")).cast("long"), "k", "rank"))


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, k, size, source_size, target, start (words of the source before it in the
    shuffled order). pieces: those columns with slot, rank, first and length: the words of the repeated source that a slot
    takes from the document; slot is null where nothing is taken.

    Null and blank texts have size 0 and take nothing; very long texts may fill many slots; a null source is a source of its own, the last; repeated rows count
    each; without any word all targets are 0; other columns are ignored; an empty table gives empty results.
    """
    sizes = written(sized(docs))  # the texts are read once
    targets = written(source_targets(sizes))
    parts = sizes.withColumn("part", F.shiftright("h", 48))
    offsets = parts.groupBy("k", "part").agg(F.sum("size").alias("words"))
    offsets = offsets.select("k", "part", (F.sum("words").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("before"))
    inside = F.sum("size").over(W.partitionBy("k", "part").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = parts.withColumn("inside", inside).join(offsets, ["k", "part"]).join(targets.select("k", "source_size", "target", "block"), "k")
    placed = placed.select("doc_id", "k", "size", "source_size", "target", "block", (F.col("before") + F.col("inside")).alias("start"))
    rounds = F.array(*(F.col("start") + i * F.col("source_size") for i in range(MOST)))
    here = F.filter(rounds, lambda p: (F.col("size") > 0) & (p < F.col("target")))
    blocks = placed.withColumn("at", F.explode_outer(here)).withColumn("rank", F.explode_outer(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.least(F.col("at") + F.col("size"), F.ceil("target")) - 1) / F.col("block")))))
    pieces = blocks.join(schedule(targets).hint("merge"), ["k", "rank"], "left")
    first = F.greatest(F.col("at"), F.col("rank") * F.col("block"))
    end = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * F.col("block"), F.floor("target"))
    taken = F.when(F.col("slot").isNotNull(), F.greatest(end - first, F.lit(0)))
    return placed, pieces.withColumn("first", first).withColumn("length", taken)


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the document, repeats counted)."""
    placed, pieces = mixed(docs)
    out = pieces.groupBy("doc_id", "k", "start", "size", "source_size", "target").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("taken"))
    # rows without words take nothing, and repeated ones share all keys
    return out.where("size > 0").select("doc_id", "size", "source_size", "target", "taken").union(placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long")))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
per AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
r0 AS (SELECT *, row_number() OVER (ORDER BY k = 'n', k) AS place FROM per),
r1 AS (SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS w, 1.5::DOUBLE * (SELECT sum(source_size) FROM per) AS total FROM r0),
r2 AS (SELECT *, (total - 2 * (sum(source_size) OVER q - source_size)) / (sum(w) OVER (ORDER BY source_size::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM r1 WINDOW q AS (ORDER BY source_size::DOUBLE / w, place ROWS UNBOUNDED PRECEDING)),
r3 AS (SELECT *, least(2 * source_size::DOUBLE, (SELECT max(level) FROM r2) * w) AS target, greatest(16, ceil(total / 1048576))::BIGINT AS block FROM r2),
r4 AS (SELECT *, sum(target) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS hi0 FROM r3),
r5 AS (SELECT *, hi0 - target AS lo, CASE WHEN place = (SELECT max(place) FROM r3) THEN total + 1 ELSE hi0 END AS hi FROM r4),
s AS (SELECT i, (SELECT max(total) FROM r3) * (list_sum(list_transform(range(32), lambda b: ((i >> b) & 1) * (1::BIGINT << (31 - b))))::DOUBLE / 4294967296) AS u
    FROM range((SELECT ceil(max(total) / max(block))::BIGINT FROM r3)) AS g(i)),
slots AS (SELECT r5.k, count(*) AS ranks FROM s JOIN r5 ON s.u >= r5.lo AND s.u < r5.hi WHERE r5.target > 0 GROUP BY r5.k),
p AS (SELECT d.*, r5.source_size, r5.target, CASE WHEN ceil(floor(target) / block) > coalesce(ranks, 0) AND (block > 16 OR ceil(floor(target) / block) < 64) THEN floor(target) ELSE least(coalesce(ranks, 0) * block, floor(target)) END AS upto, sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
    FROM d JOIN r5 USING (k) LEFT JOIN slots USING (k))
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, upto) - least(start, upto)) + greatest(0, least(start + source_size + size, upto) - least(start + source_size, upto)))::BIGINT AS taken FROM p
"""
