"""Crops, labels and review: derived columns, filters and the joins between manifest, labels and the box store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import offending

#: The longest side of a working image, the height of packed images, the largest 16-bit length.
WORKING_SIDE, PACK_HEIGHT, INT16_MAX = 2500, 32, 32767


def crop_name(page_key: Column, box_id: Column) -> Column:
    """PRJ-2."""
    return F.concat(page_key, F.lit("__"), box_id, F.lit(".png"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def with_defaults(boxes: DataFrame) -> DataFrame:
    """PRJ-3: what a box lacks as the store fills it in."""
    empty = {"text": F.lit(""), "conf": F.lit(0.0), "line": F.lit(0), "word": F.lit(0), "source": F.lit("vision"), "edited": F.lit(False), "deleted": F.lit(False)}
    return boxes.withColumns({c: F.coalesce(F.col(c), v) if c in boxes.columns else v for c, v in empty.items()})


def crop_corners(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """PRJ-5: a crop padded by max(2, int(0.08 h)) and cut at the page, as two corners."""
    pad = F.greatest(F.lit(2), (F.col("h") * 0.08).cast("int"))
    low = {f"{a}0": F.greatest(F.lit(0), F.col(a) - pad) for a in "xy"}
    high = {f"{a}1": F.least(F.lit(most), F.col(a) + F.col(n) + pad) for a, n, most in (("x", "w", width), ("y", "h", height))}
    return boxes.select("page_key", "box_id", *(c.alias(n) for n, c in (low | high).items()))


def clipped(boxes: DataFrame, width: int, height: int, min_w: int = 10, min_h: int = 16) -> DataFrame:
    """PRJ-6: boxes cut to the page; those left smaller than the least size drop out."""
    x0, y0 = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    x1, y1 = F.least(F.lit(width), F.col("x") + F.col("w")), F.least(F.lit(height), F.col("y") + F.col("h"))
    cut = boxes.withColumns({"bbox_x": x0, "bbox_y": y0, "bbox_w": x1 - x0, "bbox_h": y1 - y0})
    return cut.where((F.col("bbox_w") >= min_w) & (F.col("bbox_h") >= min_h))


def downscaled(width: Column, height: Column, most: int = WORKING_SIDE) -> tuple[Column, Column]:
    """PRJ-9: sides scaled so that the longer is at most `most`, rounded half to even."""
    longest = F.greatest(width, height)
    scale = F.lit(float(most)) / longest
    return tuple(F.when(longest <= most, side).otherwise(F.bround(side * scale).cast("int")) for side in (width, height))


def rotated(boxes: DataFrame, degrees: Column, width: int, height: int) -> DataFrame:
    """PRJ-11: boxes of a page of width x height after a clockwise turn by 0, 90, 180 or 270 degrees."""
    x, y, w, h = (F.col(c) for c in "xywh")
    turn = lambda none, quarter, half, three: F.when(degrees == 90, quarter).when(degrees == 180, half).when(degrees == 270, three).otherwise(none)
    return boxes.withColumns({"x": turn(x, height - y - h, width - x - w, y), "y": turn(y, x, height - y - h, width - x - w), "w": turn(w, h, w, h), "h": turn(h, w, h, w)})


def quality(ink: Column, contrast: Column, focus: Column) -> Column:
    """PRJ-12: a crop's score; the weights and levels are fixed values."""
    healthy = F.greatest(F.lit(0.0), 1.0 - F.abs(ink - 0.25) / 0.35)
    return F.round(0.5 * F.least(focus / 250.0, F.lit(1.0)) + 0.3 * F.least(contrast / 140.0, F.lit(1.0)) + 0.2 * healthy, 4)


def shown_text(curated: Column, auto: Column) -> Column:
    """PRJ-13: the curated label, else the reader's guess."""
    return F.coalesce(F.nullif(curated, F.lit("")), auto)


def recased(source: Column, words: Column) -> Column:
    """PRJ-16: every word with a capital first where the source has one."""
    return F.when(F.substring(source, 1, 1).rlike(r"\p{Lu}"), F.initcap(words)).otherwise(words)


def pack_reason(text: Column, width: Column, exists: Column, alphabet: str) -> Column:
    """FLT-9, FLT-10, DQ-3: why a label can't be packed, the first reason counts; null if it can. text is the cleaned label."""
    known = F.rlike(text, F.lit(r"\A[" + "".join(c if c.isalnum() else f"\\{c}" for c in alphabet) + r"]*+\z"))
    return (
        F.when(~exists, "file not found")
        .when(F.trim(text) == "", "empty label")
        .when(~known, F.concat(F.lit("not in alphabet: "), offending(text, alphabet)))
        .when(F.length(text) >= INT16_MAX, "label too long")
        .when(width >= INT16_MAX, "image too wide")
    )


def last_labels(labels: DataFrame) -> DataFrame:
    """JON-2: name, text of the last label (by ord) of each file name."""
    return labels.groupBy(basename(F.col("image_path")).alias("name")).agg(F.max_by("text", "ord").alias("text"))


def saved(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """JON-10, FLT-21: an editor's save. Both: page_key, box_id, x, y, w, h, text; prior also source, edited, deleted.

    Incoming boxes win and are not deleted; new, moved or reworded ones count as edited. Boxes that the editor no longer
    has are soft-deleted, never lost.
    """
    shape = ["x", "y", "w", "h", "text"]
    a, b = prior.alias("a"), incoming.withColumn("here", F.lit(True)).alias("b")
    j = a.join(b, ["page_key", "box_id"], "full")
    same = reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in shape))
    here = F.coalesce("here", F.lit(False))
    value = lambda c: F.when(here, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    edited = F.when(here, F.coalesce("edited", F.lit(False)) | ~same).otherwise(F.coalesce("edited", F.lit(False)))
    return j.select("page_key", "box_id", *map(value, shape), F.coalesce("source", F.lit("manual")).alias("source"), edited.alias("edited"), (~here).alias("deleted"))


def within_edits(words: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """JON-13: word, candidate, distance of pairs at most k insertions, deletions and replacements apart, 0 left out."""
    from ..functions.text import near_by_deletion

    near = near_by_deletion(words, vocab, k).withColumn("distance", F.levenshtein("word", "candidate"))
    return near.where(F.col("distance") <= k)


def nearest(points: DataFrame, marks: DataFrame, by: str, point: str, mark: str, within: float) -> DataFrame:
    """JON-16: points with the nearest mark of their group, the smaller of equals, if it is closer than `within`. Both sides are
    sorted once and each point looks at the last mark before and the first after it, so no pair is made."""
    both = points.select(*points.columns, F.col(point).cast("double").alias("_at"), F.lit(None).cast("double").alias("_mark"))
    both = both.unionByName(marks.select(by, F.col(mark).cast("double").alias("_at"), F.col(mark).cast("double").alias("_mark")), allowMissingColumns=True)
    order = W.partitionBy(by).orderBy("_at")
    # RANGE frames: marks at the very place count on both sides
    before = F.max("_mark").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.min("_mark").over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    found = both.withColumn("_low", before).withColumn("_high", after).where("_mark is null")
    low, high = F.col("_at") - F.col("_low"), F.col("_high") - F.col("_at")
    best = F.when(F.col("_high").isNull() | (low <= high), F.col("_low")).otherwise(F.col("_high"))
    best = F.when(F.col("_low").isNull(), F.col("_high")).otherwise(best)
    return found.withColumn("nearest", best).where(F.abs(F.col("nearest") - F.col("_at")) < within).select(*points.columns, "nearest")


def word_accuracy(read: DataFrame, key: DataFrame) -> DataFrame:
    """AGG-20: page_key, right (words of the key that were read, as a multiset), expected, extras. Both: page_key, word."""
    counts = read.groupBy("page_key", "word").agg(F.count("*").alias("a")).join(key.groupBy("page_key", "word").agg(F.count("*").alias("b")), ["page_key", "word"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return counts.groupBy("page_key").agg(F.sum(F.least(a, b)).alias("right"), F.sum(b).alias("expected"), F.sum(a - F.least(a, b)).alias("extras"))


def mean_vectors(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """AGG-19: the element-wise mean of each group's vectors and whether all elements are finite."""
    each = vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    finite = F.every(F.col("m").isNotNull() & ~F.isnan("m") & (F.abs("m") < float("inf")))
    return each.groupBy(by).agg(ordered.alias("mean"), finite.alias("finite"))
