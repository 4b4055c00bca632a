"""Word boxes: geometry, gates, reading order, spatial join and merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = 256


def pad_clip(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """PRJ-4: boxes padded by max(2, int(0.06 h)) and clipped to the page."""
    pad = F.greatest(F.lit(2), (F.col("h") * 0.06).cast("int"))
    x, y = F.greatest(F.lit(0), F.col("x") - pad), F.greatest(F.lit(0), F.col("y") - pad)
    return boxes.select("page_key", "box_id", x.alias("x"), y.alias("y"), F.least(width - x, F.col("w") + 2 * pad).alias("w"), F.least(height - y, F.col("h") + 2 * pad).alias("h"))


def line_bbox(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """PRJ-7: the rectangle around a line's words, 4 pixels wider on each side, clipped to the page."""
    zero = F.lit(0)
    x1, y1 = F.max(F.col("x") + F.col("w")) + 4, F.max(F.col("y") + F.col("h")) + 4
    return boxes.groupBy("page_key", "line").agg(F.greatest(zero, F.min("x") - 4).alias("x0"), F.greatest(zero, F.min("y") - 4).alias("y0"), F.least(F.lit(width), x1).alias("x1"), F.least(F.lit(height), y1).alias("y1"))


def active(boxes: DataFrame) -> DataFrame:
    """FLT-1: not deleted; an unknown flag counts as not deleted."""
    return boxes.where(~F.coalesce("deleted", F.lit(False)))


def protection(boxes: DataFrame) -> DataFrame:
    """FLT-2: a box that a person edited or drew is protected; other active ones are refreshable; the rest is retired."""
    return boxes.withColumn("state", F.when(F.col("edited") | (F.col("source") == "manual"), "protected").when(~F.col("deleted"), "refreshable").otherwise("retired"))


def body_column(boxes: DataFrame, page_width: int, least: int = 3, share: float = 0.18) -> DataFrame:
    """FLT-4: words of lines that start near the page's median left edge, taken over lines of `least` words or more."""
    lines = boxes.groupBy("page_key", "line").agg(F.min("x").alias("x0"), F.count("*").alias("n"))
    anchor = lines.where(F.col("n") >= least).groupBy("page_key").agg(F.percentile("x0", 0.5).alias("anchor"))
    kept = lines.join(anchor, "page_key", "left").where(F.col("anchor").isNull() | (F.abs(F.col("x0") - F.col("anchor")) <= share * page_width))
    return boxes.join(kept.select("page_key", "line"), ["page_key", "line"], "left_semi")


def upper_median(value: str) -> Column:
    """AGG-10: sorted[n // 2]."""
    return F.element_at(F.sort_array(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """WIN-1: lines by centre height, a new one where the gap to the box before exceeds max(4, int(0.6 * upper median
    height)), and words from left to right, both from 1. Equal places go by stored order. All windows are over the page: one exchange."""
    page = W.partitionBy("page_key")
    b = active(boxes).select("page_key", "box_id", "box_ord", "x", "h", (F.col("y") + F.col("h") / 2).alias("cy"))
    b = b.withColumn("n", F.count("*").over(page)).withColumn("r", F.row_number().over(page.orderBy("h")))
    middle = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("h"))).over(page)
    gap = F.greatest(F.lit(4), (F.when(middle == 0, 1).otherwise(middle) * 0.6).cast("int"))
    by_height = page.orderBy("cy", "box_ord")
    b = b.withColumn("gap", gap).withColumn("jump", F.coalesce((F.col("cy") - F.lag("cy").over(by_height) > F.col("gap")).cast("int"), F.lit(1)))
    b = b.withColumn("out_line", F.sum("jump").over(by_height.rowsBetween(W.unboundedPreceding, 0)))
    return b.withColumn("out_word", F.row_number().over(W.partitionBy("page_key", "out_line").orderBy("x", "cy", "box_ord"))).select("page_key", "box_id", "out_line", "out_word")


def iou_pairs(old: DataFrame, new: DataFrame, least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """JON-7: pairs of a page whose intersection over union is `least` or more: page_key, box_ord, det_ord, iou, and old's `keep`.

    Boxes are dealt to the grid cells that they touch, and a pair is compared only in the cell that holds the upper left
    corner of its intersection: an equi-join on (page, cell) that gives each pair once. Only places and geometry move.
    """

    def celled(df: DataFrame, p: str, *key: str) -> DataFrame:
        cells = [F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(a) + F.greatest(F.col(n) - 1, F.lit(0))) / CELL)) for a, n in (("x", "w"), ("y", "h"))]
        out = df.select("page_key", *key, *(F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "w", "h")), cells[1].alias("rows"), F.explode(cells[0]).alias("cx"))
        return out.withColumn("cy", F.explode("rows")).drop("rows")

    j = celled(old, "old", "box_ord", *keep).join(celled(new, "new", "det_ord"), ["page_key", "cx", "cy"])
    x0, y0 = F.greatest("old_x", "new_x"), F.greatest("old_y", "new_y")
    w = F.least(F.col("old_x") + F.col("old_w"), F.col("new_x") + F.col("new_w")) - x0
    h = F.least(F.col("old_y") + F.col("old_h"), F.col("new_y") + F.col("new_h")) - y0
    j = j.where((F.floor(x0 / CELL) == F.col("cx")) & (F.floor(y0 / CELL) == F.col("cy")) & (w > 0) & (h > 0))
    inter = w.cast("long") * h
    j = j.withColumn("iou", inter / (F.col("old_w").cast("long") * F.col("old_h") + F.col("new_w").cast("long") * F.col("new_h") - inter))
    return j.where(F.col("iou") >= least).select("page_key", "box_ord", "det_ord", "iou", *keep)


def _celled(boxes: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(box, cell column, cell row) of every cell that boxes (x, y, w, h) touch."""
    first = boxes[:, :2] // cell
    across, down = ((boxes[:, :2] + np.maximum(boxes[:, 2:] - 1, 0)) // cell - first + 1).T
    n = across * down
    box = np.repeat(np.arange(len(boxes)), n)
    k = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n)
    return box, first[box, 0] + k % across[box], first[box, 1] + k // across[box]


def _overlaps(old: np.ndarray, new: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """iou_pairs() of one page: (place in old, place in new, iou) of boxes (x, y, w, h), with cells of twice the mean size."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if len(old) and len(new):
        cell = np.maximum(1, 2 * np.concatenate([old, new])[:, 2:].mean(axis=0)).astype(np.int64)
        (i, cx, cy), (j, dx, dy) = _celled(old, cell), _celled(new, cell)
        left, wide = min(cx.min(), dx.min()), max(cx.max(), dx.max()) - min(cx.min(), dx.min()) + 1
        key, place = dy * wide + dx - left, cy * wide + cx - left
        order = np.argsort(key, kind="stable")
        j, key = j[order], key[order]
        low = np.searchsorted(key, place)
        many = np.searchsorted(key, place, "right") - low
        upto = np.cumsum(many)
        # so many candidates at a time
        cut = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], 1 << 16)), len(many)))
        for s, e in zip(cut[:-1], cut[1:]):
            at = np.repeat(np.arange(s, e), many[s:e])
            b = j[np.arange(len(at)) - np.repeat(upto[s:e] - many[s:e] - (upto[s] - many[s]), many[s:e]) + low[at]]
            p, q = old[i[at]], new[b]
            corner = np.maximum(p[:, :2], q[:, :2])
            size = np.minimum(p[:, :2] + p[:, 2:], q[:, :2] + q[:, 2:]) - corner
            own = (size > 0).all(axis=1) & (corner[:, 0] // cell[0] == cx[at]) & (corner[:, 1] // cell[1] == cy[at])
            at, b, p, q, size = at[own], b[own], p[own], q[own], size[own]
            inter = size[:, 0] * size[:, 1]
            iou = inter / (p[:, 2] * p[:, 3] + q[:, 2] * q[:, 3] - inter)
            found.append((i[at][iou >= least], b[iou >= least], iou[iou >= least]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_turn(old: np.ndarray, new: np.ndarray, iou: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Old boxes in stored order each take the free detection of greatest overlap, the first of equals. Where neither side has
    another candidate there is nothing to decide."""
    (_, a, many), (_, b, more) = (np.unique(x, return_inverse=True, return_counts=True) for x in (old, new))
    sure = (many[a] == 1) & (more[b] == 1)
    rest = np.flatnonzero(~sure)
    rest = rest[np.lexsort((new[rest], -iou[rest], old[rest]))]
    done, used, chosen = set(), set(), []
    for i, o, n in zip(rest.tolist(), old[rest].tolist(), new[rest].tolist()):
        if o not in done and n not in used:
            done.add(o)
            used.add(n)
            chosen.append(i)
    chosen = np.concatenate([np.flatnonzero(sure), np.array(chosen, int)])
    return old[chosen], new[chosen]


_GEOMETRY = ["x", "y", "w", "h", "text"]
_STATES = ("protected", "refreshable", "retired")
_OUTCOMES = pa.array(["kept", "retired", "carried", "refreshed", "added"])


def _merged(key: tuple[pa.Scalar, ...], old: pa.Table, new: pa.Table, least: float) -> pa.Table:
    """The merge of one page."""

    def placed(side: pa.Table, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the page's order, x to h, rows that can be compared)"""
        columns = [side[c].combine_chunks() for c in (order, "x", "y", "w", "h")]
        known = np.ones(len(side), bool)
        for c in columns:
            if c.null_count:
                known &= c.is_valid().to_numpy(zero_copy_only=False)
        number, *rest = (c.fill_null(0).to_numpy().astype(np.int64) for c in columns)
        return number, np.stack(rest, 1), np.flatnonzero(known & key[0].is_valid)

    (box_ord, where, known), (det_ord, there, seen) = placed(old, "box_ord"), placed(new, "det_ord")
    state = old["state"].to_numpy()
    known = known[state[known] != _STATES.index("retired")]
    i, j, iou = _overlaps(where[known], there[seen], least)
    i, j = known[i], seen[j]
    free = state[i] == _STATES.index("refreshable")
    box, det = _in_turn(box_ord[i[free]], det_ord[j[free]], iou[free])

    # each old box with the detections of the place that it took
    by_box, by_det = np.argsort(box), np.argsort(det_ord, kind="stable")
    box, det = box[by_box], det[by_box]
    at = np.minimum(np.searchsorted(box, box_ord), max(len(box) - 1, 0))
    hit = box[at] == box_ord if len(box) else np.zeros(len(old), bool)
    took = det[at[hit]]
    low, n = np.zeros(len(old), np.int64), np.ones(len(old), np.int64)
    low[hit] = np.searchsorted(det_ord[by_det], took)
    n[hit] = np.searchsorted(det_ord[by_det], took, "right") - low[hit]
    held = np.repeat(np.arange(len(old)), n)
    source, hit = held.copy(), hit[held]
    k = np.arange(len(held)) - np.repeat(np.cumsum(n) - n, n)
    source[hit] = len(old) + by_det[low[held[hit]] + k[hit]]
    outcome = np.where(hit & (state[held] == _STATES.index("refreshable")), 3, state[held])
    added = np.flatnonzero(~np.isin(det_ord, np.concatenate([det, det_ord[j[~free]]])))

    ids = new["box_id"].combine_chunks()
    ids = pc.binary_join_element_wise(pa.scalar("n", ids.type), ids, pa.scalar("", ids.type))
    source, named = np.concatenate([source, len(old) + added]), np.concatenate([held, len(old) + added])
    columns = [pa.repeat(key[0], len(source)), pa.concat_arrays([old["box_id"].combine_chunks(), ids]).take(pa.array(named))]
    columns += [pa.concat_arrays([old[c].combine_chunks(), new[c].combine_chunks()]).take(pa.array(source)) for c in _GEOMETRY]
    columns.append(_OUTCOMES.take(pa.array(np.concatenate([outcome, np.full(len(added), 4)]))))
    return pa.Table.from_arrays(columns, ["page_key", "box_id", *_GEOMETRY, "outcome"])


def merge_detection(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """GEO-2: page_key, box_id, x, y, w, h, text, outcome of every old box and every detection that comes in.

    Protected boxes are kept. Each refreshable box, in stored order, takes the free detection of greatest overlap if that is
    `least` or more (refreshed: its id, the detection's text and geometry), else it is retired: soft-deleted. Boxes deleted
    before are carried on. A detection that none took is added, unless it lies on a protected box, deleted or not.

    Pages are merged one at a time, so boxes move at most once; not at all if both sides come from texts dealt by page key.
    """
    columns = ["page_key", "box_id", *_GEOMETRY]
    both = old.select(*columns).union(new.select(*columns)).schema
    typed = [F.col(f.name).cast(f.dataType) for f in both]
    state = F.coalesce(*(F.when(F.col("state") == s, F.lit(k)) for k, s in enumerate(_STATES)))
    left = protection(old).select(*typed, "box_ord", state.alias("state"))
    right = new.select(*typed, "det_ord")

    def merged(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        return _merged(key, a, b, least)

    return left.groupBy("page_key").cogroup(right.groupBy("page_key")).applyInArrow(merged, both.add("outcome", "string"))


def suppress(new: DataFrame, old: DataFrame) -> DataFrame:
    """JON-8: detections that overlap no protected box, deleted or not."""
    guards = protection(old).where("state = 'protected'")
    return new.join(iou_pairs(guards, new).select("page_key", "det_ord").distinct(), ["page_key", "det_ord"], "left_anti")


def quality_gate(crops: DataFrame) -> DataFrame:
    """FLT-5: page_key, box_id, reason: the first gate that a crop fails, null for none. The page's median height is taken over
    crops that clear the least size; crops: h, w, ink, contrast, focus beside the ids. The limits are fixed values."""
    plausible = F.when((F.col("h") >= 20) & (F.col("w") >= 14), F.col("h"))
    median = crops.groupBy("page_key").agg(F.coalesce(F.percentile(plausible, 0.5), F.lit(0.0)).alias("mh"))
    h, mh = F.col("h"), F.col("mh")
    reason = F.when((h < 20) | (F.col("w") < 14), "too_small").when(h > 220, "too_tall").when((mh > 0) & ~h.between(0.55 * mh, 2.20 * mh), "off_page_scale")
    reason = reason.when(~F.col("ink").between(0.05, 0.65), "bad_ink").when(F.col("contrast") < 45, "low_contrast").when(F.col("focus") < 55, "blurry")
    return crops.join(median, "page_key").select("page_key", "box_id", reason.alias("reason"))
