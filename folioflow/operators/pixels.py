"""Grey pictures as rows (page, row, col, v): measures by grouping and windows, and kernels where a picture is one unit of work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .series import peaks


def otsu(cells: DataFrame) -> DataFrame:
    """PIX-2: page, threshold, ink, contrast: the split of grey values that parts two classes best (the first of equals), the share
    of values below it or at it, and the spread; a spread below 10 has no ink. Works on the histogram, at most 256 rows a page."""
    hist = cells.groupBy("page", "v").agg(F.count("*").alias("n"))
    page, below = W.partitionBy("page"), W.partitionBy("page").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    h = hist.withColumn("n0", F.sum("n").over(below)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(below))
    h = h.withColumn("all", F.sum("n").over(page)).withColumn("sum", F.sum(F.col("n") * F.col("v")).over(page)).withColumn("lo", F.min("v").over(page)).withColumn("hi", F.max("v").over(page))
    n1 = F.col("all") - F.col("n0")
    means = F.col("s0") / F.col("n0") - F.try_divide(F.col("sum") - F.col("s0"), n1)
    h = h.withColumn("between", F.round(F.coalesce(F.col("n0") * n1 * means * means, F.lit(0.0)), 3))
    best = h.groupBy("page").agg(F.max(F.struct("between", (-F.col("v")).alias("m"), "n0")).alias("b"), F.max("all").alias("all"), (F.max("hi") - F.min("lo")).cast("double").alias("contrast"))
    ink = F.when(F.col("contrast") < 10, 0.0).otherwise(F.col("b.n0") / F.col("all"))
    return best.select("page", (-F.col("b.m")).alias("threshold"), ink.alias("ink"), "contrast")


def focus(cells: DataFrame, height: int, width: int) -> DataFrame:
    """PIX-3: page, focus: the variance of the Laplacian, borders mirrored without repeating the edge."""
    across, down = W.partitionBy("page", "row").orderBy("col"), W.partitionBy("page", "col").orderBy("row")
    left, right, up, low = F.lag("v").over(across), F.lead("v").over(across), F.lag("v").over(down), F.lead("v").over(down)
    c = cells.withColumns({"l": left, "r": right}).withColumns({"u": up, "d": low})
    lap = F.coalesce("l", "r") + F.coalesce("r", "l") + F.coalesce("u", "d") + F.coalesce("d", "u") - 4 * F.col("v")
    return c.groupBy("page").agg(F.var_pop(lap.cast("double")).alias("focus"))


def kernel(cells: DataFrame, work: Callable[[np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """For each page's picture as an array, the rows that `work` makes of it, with the page. A picture fits a task."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(group: pa.Table) -> pa.Table:
        row, col, v = (group[c].to_numpy() for c in ("row", "col", "v"))
        picture = np.zeros((row.max() + 1, col.max() + 1))
        picture[row, col] = v
        found = work(picture)
        n = len(next(iter(found.values())))
        return pa.table({"page": pa.array([group["page"][0].as_py()] * n, pa.int64()), **{c: pa.array(found[c], kinds[k]) for c, k in (f.split(" ") for f in schema.split(", "))}}).select(["page", *names])

    return cells.selectExpr("cast(page as long) page", "cast(row as int) row", "cast(col as int) col", "cast(v as double) v").groupBy("page").applyInArrow(run, f"page long, {schema}")


def _box(picture: np.ndarray, reach_y: int, reach_x: int, reduce: Callable) -> np.ndarray:
    """The maximum or minimum over a rectangle around each cell."""
    padded = np.pad(picture, ((reach_y, reach_y), (reach_x, reach_x)), mode="edge")
    views = np.lib.stride_tricks.sliding_window_view(padded, (2 * reach_y + 1, 2 * reach_x + 1))
    return reduce(views, axis=(2, 3))


def blurred(picture: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, edges mirrored."""
    reach = max(1, int(round(3 * sigma)))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (min(reach, picture.shape[axis] - 1),) * 2
        more = np.pad(picture, pad, mode="reflect")
        lines = np.moveaxis(more, axis, -1)
        out = np.apply_along_axis(lambda x: np.convolve(np.pad(x, reach - pad[axis][0], mode="edge"), weight, "valid"), -1, lines)
        picture = np.moveaxis(out, -1, axis)
    return picture


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (0 for off) of the connected cells of a mask, corners included, and of each label from 1 on x, y, w, h, area."""
    rows, starts, ends = [], [], []
    for y, line in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        rows += [y] * (len(edge) // 2)
        starts += edge[::2].tolist()
        ends += edge[1::2].tolist()
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    before: list[int] = []
    i = 0
    for y in range(len(mask)):
        here = []
        while i < len(rows) and rows[i] == y:
            here.append(i)
            i += 1
        p = 0
        for k in here:
            while p < len(before) and ends[before[p]] < starts[k]:
                p += 1
            q = p
            while q < len(before) and starts[before[q]] <= ends[k]:
                a, b = find(before[q]), find(k)
                up[max(a, b)] = min(a, b)
                q += 1
        before = here
    roots = [find(k) for k in range(len(rows))]
    number = {r: n for n, r in enumerate(dict.fromkeys(roots), 1)}
    labels = np.zeros(mask.shape, np.int64)
    stats = np.zeros((len(number), 5), np.int64)
    stats[:, :2], stats[:, 2:4] = 1 << 40, 0
    for k, r in enumerate(roots):
        n = number[r]
        labels[rows[k], starts[k] : ends[k]] = n
        s = stats[n - 1]
        s[0], s[1], s[2], s[3], s[4] = min(s[0], starts[k]), min(s[1], rows[k]), max(s[2], ends[k]), max(s[3], rows[k] + 1), s[4] + ends[k] - starts[k]
    stats[:, 2:4] -= stats[:, :2]
    return labels, stats


def component_rows(cells: DataFrame, dark: float = 128.0) -> DataFrame:
    """page, x, y, w, h, area, height of the connected dark parts of each picture."""

    def work(picture: np.ndarray) -> dict[str, list]:
        _, s = components(picture < dark)
        return {**{c: s[:, i].tolist() for i, c in enumerate(("x", "y", "w", "h", "area"))}, "height": [len(picture)] * len(s), "cells": [picture.size] * len(s)}

    return kernel(cells, work, "x long, y long, w long, h long, area long, height long, cells long")


def letter_ink(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """PIX-1: page, ink: the share of a crop's cells that letter-shaped parts cover: not short or tiny ones, nor flat rules; crops of
    fewer than 100 cells have none. pages: page, cells (null where the page is missing, which has no ink to tell)."""
    flat = (F.col("w") > 6 * F.col("h")) & (F.col("h") < 0.30 * F.col("height"))
    good = (F.col("h") >= F.greatest(F.lit(3.0), 0.14 * F.col("height"))) & (F.col("area") >= 12) & ~flat
    kept = parts.groupBy("page").agg(F.sum(F.when(good, F.col("area")).otherwise(0)).alias("kept"))
    ink = F.when(F.col("cells").isNull(), None).when(F.col("cells") < 100, 0.0).otherwise(F.coalesce("kept", F.lit(0)) / F.col("cells"))
    return pages.join(kept, "page", "left").select("page", ink.alias("ink"))


def ruled_or_large(w: Column, h: Column, width: int, height: int) -> Column:
    """PIX-7: what isn't writing among the parts of a binarised page: rules (0.55 of the width and at most 6 high) and structures of
    over half the page's height or width."""
    return F.when((w >= 0.55 * width) & (h <= 6), "rule").when((h > 0.5 * height) | (w > 0.5 * width), "large").otherwise("keep")


def normalised_background(picture: np.ndarray) -> np.ndarray:
    """PIX-5: a picture over its own background (a closing, blurred), as grey on white of 220."""
    ground = _box(_box(picture, 7, 7, np.max), 7, 7, np.min)
    return np.clip(picture / np.maximum(blurred(ground, 5.0), 1.0) * 220.0, 0, 255)


def page_region(picture: np.ndarray, split: float) -> tuple[int, int, int, int] | None:
    """PIX-4: x, y, w, h of the largest bright part, closed first, if it covers 0.08 to 0.98 of the picture."""
    mask = _box(_box((picture > split).astype(float), 4, 4, np.max), 4, 4, np.min) > 0
    _, s = components(mask)
    if not len(s):
        return None
    x, y, w, h, _ = s[np.argmax(s[:, 4])].tolist()
    return (x, y, w, h) if 0.08 <= w * h / picture.size <= 0.98 else None


def deskew_angle(angle: Column, cap: float = 30.0) -> Column:
    """PIX-6: the turn to make for a rectangle's angle from -90 to 90: the shorter way round, none below 0.3 or above the cap."""
    short = F.when(angle < -45, angle + 90).when(angle > 45, angle - 90).otherwise(angle)
    return F.when((F.abs(short) < 0.3) | (F.abs(short) > cap), 0.0).otherwise(short)


def word_splits(picture: np.ndarray, dark: float = 128.0, least: int = 40) -> list[tuple[int, int, int, int]]:
    """PIX-8: x, y, w, h of a line's words: dark parts joined over 0.45 of the line's height (8 at least), from left to right."""
    reach = max(8, round(0.45 * len(picture)))
    wide = _box((picture < dark).astype(float), 1, reach // 2, np.max) > 0
    _, s = components(wide)
    return sorted(tuple(r[:4]) for r in s.tolist() if r[4] >= least)


def channel_response(cells: DataFrame, sigma: float = 4.0) -> DataFrame:
    """PIX-9: page, row, col, response of pictures with columns b and r: how much bluer a cell is than its surroundings."""

    def work(picture: np.ndarray) -> dict[str, list]:
        row, col = np.indices(picture.shape)
        out = picture - blurred(picture, sigma)
        return {"row": row.ravel().tolist(), "col": col.ravel().tolist(), "response": out.ravel().tolist()}

    return kernel(cells.withColumn("v", F.col("b") - F.col("r")), work, "row long, col long, response double")


def sampled(points: DataFrame, cells: DataFrame) -> DataFrame:
    """PIX-10: points (page, id, x, y) with value, the picture there by bilinear weights of the four cells around; 0 outside."""
    x0, y0 = F.floor("x"), F.floor("y")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    near = F.array(*(F.struct((x0 + i).cast("int").alias("col"), (y0 + j).cast("int").alias("row"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("weight")) for i in (0, 1) for j in (0, 1)))
    each = points.select("page", "id", F.inline(near))
    j = each.join(cells.select("page", "row", "col", "v"), ["page", "row", "col"], "left")
    return j.groupBy("page", "id").agg(F.sum(F.col("weight") * F.coalesce("v", F.lit(0))).alias("value"))


def ink_matte(cells: DataFrame) -> DataFrame:
    """PIX-11: page, row, col, alpha of each cell: how much ink covers the paper, from the page's own levels of paper (the 96th
    percentile) and ink (the 2nd); thin cover is paper, and strokes are made solid again. The numbers are fixed values."""
    levels = cells.groupBy("page").agg(F.percentile("v", 0.96).alias("paper"), F.percentile("v", 0.02).alias("ink"))
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    a = held((F.col("paper") - F.col("v")) / F.greatest(F.lit(8.0), F.col("paper") - F.col("ink")))
    alpha = held(held((a - 0.30) / 0.70) * 2.2)
    return cells.join(levels, "page").select("page", "row", "col", alpha.alias("alpha"))


def rule_angle(picture: np.ndarray, span: float = 40.0) -> float:
    """GEO-19: the turn in degrees that makes the sums of rows vary most: in steps of 2, then of 0.25 around the best. Cells go to
    rows by their turned centres, so no picture is drawn."""
    x = (picture - picture.mean()) / (picture.std() + 1e-6)
    row, col = np.indices(x.shape)
    cy, cx = (np.array(x.shape) - 1) / 2
    keep = np.abs(col - cx) <= x.shape[1] / 4

    def variance(angle: float) -> float:
        t = np.radians(angle)
        at = np.rint((row - cy) * np.cos(t) - (col - cx) * np.sin(t) + cy).astype(int)
        inside = keep & (at >= 0) & (at < len(x))
        n = np.bincount(at[inside], minlength=len(x))
        return float((np.bincount(at[inside], x[inside], len(x)) / np.maximum(n, 1)).var())

    best = max(np.arange(-span, span + 1e-9, 2.0), key=variance)
    return float(max(np.arange(best - 2, best + 2 + 1e-9, 0.25), key=variance))


def margin_position(picture: np.ndarray, step: float = 1.0) -> int | None:
    """GEO-12: the column of a printed margin: a peak of the median profile at least twice its spread, seen on over 0.55 of the
    lines there (0.40 of them on the picture, and 4); the strongest by prominence and share. Cells off the picture are NaN."""
    there = ~np.isnan(picture)
    profile = np.nan_to_num(np.nanmedian(np.where(there, picture, np.nan), axis=0), nan=0.0)
    profile = profile - np.median(profile)
    if profile.std() < 1e-6:
        return None
    ground = np.nan_to_num(np.nanmedian(picture, axis=1), nan=0.0)
    found, top = None, 0.0
    for at in peaks(profile, max(3, int(0.25 / step)), None, 2 * profile.std()).tolist():
        on = there[:, at]
        if on.sum() < 4 or on.mean() < 0.40:
            continue
        share = float((picture[on, at] - ground[on] > 0.4 * profile[at]).mean())
        higher = np.flatnonzero(profile > profile[at])
        left, right = higher[higher < at], higher[higher > at]
        rise = profile[at] - max(profile[(left[-1] + 1 if len(left) else 0) : at + 1].min(), profile[at : (right[0] if len(right) else len(profile))].min())
        score = float(rise) * share * float(on.mean())
        if share > 0.55 and score > top:
            found, top = at, score
    return found


def decoded(files: DataFrame) -> DataFrame:
    """SRC-11: name, width, height, v (grey values by rows) of PGM and PPM files (name, content), colours by their usual weights;
    null width and values for content that can't be read, to be warned of and skipped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [netpbm(c) for c in batch.column(1).to_pylist()]
            shape = [(None, None) if f is None else f.shape for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for _, w in shape], pa.int32()), pa.array([h for h, _ in shape], pa.int32()), pa.array([None if f is None else f.ravel().tolist() for f in found], pa.list_(pa.int32()))], names=["name", "width", "height", "v"])

    return files.select("name", "content").mapInArrow(read, "name string, width int, height int, v array<int>")


def netpbm(content: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM or PPM file of one byte a sample, plain or raw, else None."""
    head = re.match(rb"P([2356])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)(?:\s|$)", content or b"")
    if not head or not 0 < int(head[4]) < 256:
        return None
    w, h, many = int(head[2]), int(head[3]), 3 if head[1] in b"36" else 1
    rest = content[head.end() :]
    try:
        flat = np.frombuffer(rest, np.uint8)[: w * h * many] if head[1] in b"56" else np.array(rest.split()[: w * h * many], int)
    except ValueError:
        return None
    if len(flat) < w * h * many or not w * h:
        return None
    picture = flat.reshape(h, w, many).astype(float) * 255.0 / int(head[4])
    return np.rint(picture[..., 0] if many == 1 else picture @ [0.299, 0.587, 0.114]).astype(int)


def upright_cells(cells: DataFrame, orientation: Column, height: int, width: int) -> DataFrame:
    """SRC-12: cells where they belong once a photo's orientation tag (1 to 8; others count as 1) is carried out."""
    row, col = F.col("row"), F.col("col")
    low, right = height - 1 - row, width - 1 - col
    to = {2: (row, right), 3: (low, right), 4: (low, col), 5: (col, row), 6: (col, low), 7: (right, low), 8: (right, row)}
    at = [F.coalesce(*(F.when(orientation == k, v[i]) for k, v in to.items()), (row, col)[i]) for i in (0, 1)]
    return cells.withColumns({"row": at[0], "col": at[1]})


def composited(cells: DataFrame) -> DataFrame:
    """PIX-12: cells with out: paper under ink: paper * (1 - alpha + alpha * tone), in whole grey values. cells: paper, alpha, tone."""
    mixed = F.col("paper") * (1 - F.col("alpha") + F.col("alpha") * F.col("tone"))
    return cells.withColumn("out", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(mixed, 6)))).cast("int"))


def changed_span(one: DataFrame, other: DataFrame) -> DataFrame:
    """PIX-14: page, lo, hi, centre: the columns in which two pictures of a word differ most: around the largest difference, smoothed
    over five columns, as far as it stays over 0.35 of that. Pages without a difference have no row."""
    j = one.join(other.select("page", "row", "col", F.col("v").alias("w")), ["page", "row", "col"])
    d = j.groupBy("page", "col").agg(F.sum(F.abs(F.col("v") - F.col("w"))).cast("double").alias("d"))
    order, page = W.partitionBy("page").orderBy("col"), W.partitionBy("page")
    d = d.withColumn("s", F.sum("d").over(order.rowsBetween(-2, 2)) / 5).withColumn("top", F.max("s").over(page)).where("top > 0")
    d = d.withColumn("peak", F.min(F.when(F.col("s") == F.col("top"), F.col("col"))).over(page)).withColumn("off", F.col("s") <= 0.35 * F.col("top"))
    d = d.withColumn("lo", F.coalesce(F.max(F.when(F.col("off") & (F.col("col") < F.col("peak")), F.col("col"))).over(page) + 1, F.min("col").over(page)))
    d = d.withColumn("hi", F.coalesce(F.min(F.when(F.col("off") & (F.col("col") > F.col("peak")), F.col("col"))).over(page) - 1, F.max("col").over(page)))
    return d.where("col between lo and hi").groupBy("page", "lo", "hi").agg((F.sum(F.col("col") * F.col("s")) / F.sum("s")).alias("centre"))
