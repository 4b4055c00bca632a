"""Sequences of numbers by group: runs, peaks, stretches, gaps and profiles, as windows over a group's order where SQL says it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_islands(profile: DataFrame, height: int, min_height: int = 14, most: float = 0.25) -> DataFrame:
    """WIN-7, PIX-8: page, y0, h of the runs of rows whose ink exceeds max(3, 6 % of the page's peak), in the allowed heights.
    profile: page, row, ink. The limits are fixed values."""
    page = W.partitionBy("page")
    on = profile.withColumn("peak", F.max("ink").over(page)).where(F.col("ink") > F.greatest(F.lit(3.0), 0.06 * F.col("peak")))
    runs = on.withColumn("run", F.col("row") - F.row_number().over(page.orderBy("row"))).groupBy("page", "run").agg(F.min("row").alias("y0"), F.count("*").alias("h"))
    return runs.where((F.col("h") >= min_height) & (F.col("h") <= most * height)).select("page", "y0", "h")


def longest_steady_run(rows: DataFrame, by: str, value: str, tolerance: float = 0.35) -> DataFrame:
    """WIN-11: by, first, n: the longest run of values in order whose gaps change by at most `tolerance` from one to the next, the
    first of equals. Groups of fewer than three values are a run."""
    order = W.partitionBy(by).orderBy(value)
    r = rows.select(by, value).withColumn("i", F.row_number().over(order) - 1).withColumn("many", F.count("*").over(W.partitionBy(by)))
    gap = F.col(value) - F.lag(value).over(order)
    r = r.withColumn("gap", gap)
    before = F.coalesce(F.lag("gap").over(order), F.col("gap"))
    steady = (F.col("gap") > 0) & (before > 0) & (F.abs(F.try_divide(F.col("gap"), before) - 1) <= tolerance)
    r = r.withColumn("breaks", F.when(F.col("many") < 3, F.when(F.col("i") == 0, 1).otherwise(0)).otherwise(F.when(F.coalesce(steady, F.lit(False)), 0).otherwise(1)))
    r = r.withColumn("run", F.sum("breaks").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = r.groupBy(by, "run").agg(F.min("i").cast("long").alias("first"), F.count("*").alias("n"))
    return runs.groupBy(by).agg(F.max(F.struct("n", (-F.col("first")).alias("m"))).alias("b")).select(by, (-F.col("b.m")).alias("first"), "b.n")


def longest_stretch(rows: DataFrame, by: str, order: str, on: Column, reach: int = 4) -> DataFrame:
    """WIN-12: by, first, last: the longest stretch that is on once gaps of up to 2 * reach places are closed, the first of equals.
    Closing spreads what is on by `reach` places and takes as much away again; places outside the sequence are off."""
    place = W.partitionBy(by).orderBy(order)
    near = place.rowsBetween(-reach, reach)
    r = rows.select(by, order, F.coalesce(on, F.lit(False)).cast("int").alias("on")).withColumn("i", F.row_number().over(place) - 1)
    r = r.withColumn("wide", F.max("on").over(near))
    r = r.withColumn("closed", (F.min("wide").over(near) == 1) & (F.count("*").over(near) == 2 * reach + 1)).where("closed")
    runs = r.withColumn("run", F.col("i") - F.row_number().over(place)).groupBy(by, "run").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    best = runs.groupBy(by).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("n"), (-F.col("a")).alias("m"), "a", "b")).alias("s"))
    return best.select(by, F.col("s.a").cast("long").alias("first"), F.col("s.b").cast("long").alias("last"))


def free_gaps(taken: DataFrame, by: str, low: float, high: float) -> DataFrame:
    """WIN-13: by, a, b of what intervals (a, b) leave of [low, high]; groups without an interval have no row."""
    order = W.partitionBy(by).orderBy("a", "b")
    reach = F.greatest(F.lit(float(low)), F.coalesce(F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(float(low))))
    inner = taken.withColumn("from", reach).select(by, F.col("from").alias("x"), F.least(F.col("a"), F.lit(float(high))).alias("y"))
    end = taken.groupBy(by).agg(F.greatest(F.lit(float(low)), F.max("b")).alias("x")).select(by, "x", F.lit(float(high)).alias("y"))
    return inner.union(end).where("y - x > 1e-6").select(by, F.col("x").alias("a"), F.col("y").alias("b"))


def carried_breaks(words: DataFrame, by: str, removed: Column) -> DataFrame:
    """WIN-14: the words that stay, with nl grown by the line ends of the words removed right before them."""
    order = W.partitionBy(by).orderBy("ord")
    w = words.withColumn("gone", removed)
    survivors = F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    w = w.withColumn("part", survivors - F.when(F.col("gone"), 0).otherwise(1))
    # a survivor closes the part of the removed words before it
    w = w.withColumn("nl", F.sum("nl").over(W.partitionBy(by, "part")))
    return w.where("not gone").drop("gone", "part")


def hardened_breaks(words: DataFrame, by: str, chosen: Column) -> DataFrame:
    """WIN-15: nl of 1 where a wrapped line break is seen: the word's line differs from that of the placed word before it, it
    holds no line end, and it stands between the first and last chosen word."""
    order = W.partitionBy(by).orderBy("ord")
    before = F.last("line", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    picked = F.when(chosen, F.col("ord"))
    span = W.partitionBy(by)
    w = words.withColumn("prev", before).withColumn("lo", F.min(picked).over(span)).withColumn("hi", F.max(picked).over(span))
    seen = F.col("line").isNotNull() & (F.col("line") != F.col("prev")) & F.col("ord").between(F.col("lo"), F.col("hi")) & (F.col("nl") == 0)
    return w.withColumn("nl", F.when(F.coalesce(seen, F.lit(False)), 1).otherwise(F.col("nl"))).drop("prev", "lo", "hi")


def renumbered(words: DataFrame, by: str) -> DataFrame:
    """WIN-16: ord anew: flowing words (box_rank null) first, then those of each box in the boxes' order."""
    order = W.partitionBy(by).orderBy(F.coalesce(F.col("box_rank") + 1, F.lit(0)), "ord")
    return words.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))


def foot_of_letters(profile: DataFrame) -> DataFrame:
    """WIN-18: page, foot: the row where letters end: the first local fall of at least 0.6 of the steepest after which at most 0.65
    of the most ink is left, else the steepest fall. profile: page, row (from 0), ink. The shares are fixed values."""
    place = W.partitionBy("page").orderBy("row")
    at = lambda c, k: F.coalesce(F.lag(c, k).over(place) if k > 0 else F.lead(c, -k).over(place), F.lit(0.0))
    p = profile.withColumn("s", F.round((at("ink", 2) + 2 * at("ink", 1) + 3 * F.col("ink") + 2 * at("ink", -1) + at("ink", -2)) / 9.0, 9))
    p = p.withColumn("next", F.lead("s").over(place)).withColumn("most", F.max("s").over(W.partitionBy("page")))
    p = p.withColumn("d", F.round(F.col("next") - F.col("s"), 9)).where("d is not null")
    p = p.withColumn("least", F.min("d").over(W.partitionBy("page"))).withColumn("a", F.lag("d").over(place)).withColumn("b", F.lead("d").over(place))
    fall = (F.col("d") < F.col("a")) & (F.col("d") <= F.col("b")) & (F.col("d") <= 0.6 * F.col("least"))
    end = F.min(F.when(fall & (F.col("next") <= 0.65 * F.col("most")), F.col("row")))
    steepest = F.min_by("row", F.struct("d", "row"))
    return p.groupBy("page").agg((F.coalesce(end, steepest) + 1).cast("long").alias("foot"))


def autocorrelation(profile: DataFrame, low: int = 20, high: int = 400) -> DataFrame:
    """WIN-19: page, lag: the lag of the highest local maximum of a profile's autocorrelation, from low to below high."""
    page = W.partitionBy("page")
    x = profile.withColumn("x", F.col("ink") - F.avg("ink").over(page)).withColumn("n", F.count("*").over(page)).select("page", "row", "x", "n")
    # only rows at most `high` apart meet, by an equi-join on the place
    shifted = x.select("page", F.col("x").alias("y"), F.col("row").alias("to"))
    lags = x.withColumn("lag", F.explode(F.sequence(F.lit(low - 1), F.least(F.lit(high), F.col("n").cast("int") - 1)))).withColumn("to", F.col("row") + F.col("lag"))
    ac = lags.join(shifted, ["page", "to"]).groupBy("page", "lag").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("ac"))
    order = page.orderBy("lag")
    ac = ac.withColumn("a", F.lag("ac").over(order)).withColumn("b", F.lead("ac").over(order))
    peaks = ac.where((F.col("ac") > F.col("a")) & (F.col("ac") > F.col("b")) & (F.col("lag") > low) & (F.col("lag") < high - 1))
    return peaks.groupBy("page").agg(F.max_by("lag", F.struct("ac", -F.col("lag"))).cast("long").alias("lag"))


def peaks(x: np.ndarray, distance: float = 1, height: float | None = None, prominence: float | None = None) -> np.ndarray:
    """WIN-9: places of local maxima (the middle of a flat top) of at least `height`, those within `distance` of a higher one left
    out (the later of equals stays), and of at least `prominence`: their rise above the higher of the lowest points that lie
    between them and something higher, or the end, on either side."""
    n = len(x)
    if n < 3:
        return np.zeros(0, int)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    stop = np.append(start[1:], n) - 1
    level = x[start]
    inner = np.arange(1, len(start) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])] if len(start) > 2 else inner[:0]
    at = (start[top] + stop[top]) // 2
    if height is not None:
        at = at[x[at] >= height]
    if distance > 1 and len(at):
        keep = np.ones(len(at), bool)
        for k in np.argsort(x[at], kind="stable")[::-1]:
            if keep[k]:
                keep &= (np.abs(at - at[k]) >= distance) | (np.arange(len(at)) == k)
        at = at[keep]
    if prominence is not None:
        rise = []
        for k in at:
            higher = np.flatnonzero(x > x[k])
            left, right = higher[higher < k], higher[higher > k]
            low = max(x[(left[-1] + 1 if len(left) else 0) : k + 1].min(), x[k : (right[0] if len(right) else n)].min())
            rise.append(x[k] - low)
        at = at[np.array(rise) >= prominence] if len(at) else at
    return at


def group_peaks(rows: DataFrame, by: str, order: str, value: str, distance: float, height: float, prominence: float) -> DataFrame:
    """WIN-9 for every group: by, place (from 0) of its peaks. A group is one sequence, hence one unit of work."""

    def found(group: pa.Table) -> pa.Table:
        at = peaks(group.sort_by(order)[value].to_numpy(), distance, height, prominence)
        return pa.table({by: pa.array([group[by][0].as_py()] * len(at), group[by].type), "place": pa.array(at, pa.int64())})

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, order, value).groupBy(by).applyInArrow(found, f"{by} {kind}, place long")


def followed(slabs: DataFrame, spacing: float) -> DataFrame:
    """JON-17, WIN-17: page, seed, slab, x, y: from every peak of the middle slab, the peaks that go on from it to both sides: in
    each slab the one nearest to where the last two point, if closer than 0.4 of the spacing. slabs: page, slab, x, y. A walk
    depends on its own steps, so a page is one unit of work."""

    def walk(group: pa.Table) -> pa.Table:
        slab, x, y = (group[c].to_numpy() for c in ("slab", "x", "y"))
        numbers = np.unique(slab)
        held = {s: (float(x[slab == s][0]), np.sort(y[slab == s])) for s in numbers.tolist()}
        middle = numbers.tolist()[len(numbers) // 2]
        out = []
        for seed in held[middle][1].tolist():
            found = {middle: seed}
            for side in ([s for s in numbers.tolist() if s < middle][::-1], [s for s in numbers.tolist() if s > middle]):
                path = [(held[middle][0], seed)]
                for s in side:
                    at, ys = held[s]
                    (x1, y1), (x0, y0) = path[-1], path[-2] if len(path) > 1 else path[-1]
                    aim = y1 + ((y1 - y0) / (x1 - x0) * (at - x1) if x1 != x0 else 0.0)
                    near = float(ys[np.argmin(np.abs(ys - aim))])
                    if abs(near - aim) < 0.4 * spacing:
                        path.append((at, near))
                        found[s] = near
            out += [(seed, s, held[s][0], v) for s, v in sorted(found.items())]
        page = group["page"][0].as_py()
        return pa.table({"page": pa.array([page] * len(out), pa.int64()), "seed": pa.array([o[0] for o in out], pa.float64()), "slab": pa.array([o[1] for o in out], pa.int64()), "x": pa.array([o[2] for o in out], pa.float64()), "y": pa.array([o[3] for o in out], pa.float64())})

    return slabs.selectExpr("cast(page as long) page", "cast(slab as long) slab", "cast(x as double) x", "cast(y as double) y").groupBy("page").applyInArrow(walk, "page long, seed double, slab long, x double, y double")
