"""Layout of words on lines, in boxes and on pages; pins, histories and packed arrays.

A layout depends on every word before, so a document (or a box) is one unit of work, hundreds to thousands of words; everything
around the running position is Columns.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .sequences import unit_noise

#: A word's width before its picture is known, in line heights; the share of a picture above its baseline.
DEFAULT_ASPECT, BASELINE = 3.0, 0.907


def word_width(aspect: Column, scale: Column, own: Column) -> Column:
    """PRJ-15."""
    return F.coalesce(aspect, F.lit(DEFAULT_ASPECT)) * scale * F.coalesce(own, F.lit(1.0))


def sized_words(words: DataFrame, boxes: DataFrame, scale: float) -> DataFrame:
    """JON-14: words with width; a word inside a text box has the box's size instead of the page's. boxes: doc_id, box_id, size."""
    j = words.join(boxes.select("doc_id", "box_id", "size"), ["doc_id", "box_id"], "left")
    used = F.coalesce("size", F.lit(float(scale)))
    return j.withColumn("width", word_width(F.col("aspect"), used, F.lit(None).cast("double"))).drop("size")


def _rows(group: pa.Table) -> list[dict]:
    return group.sort_by("ord").to_pylist()


def boxed(words: DataFrame, space: float, tab: float) -> DataFrame:
    """ARR-7: doc_id, box_id, ord, v, u, overflow of the words of each text box, wrapped inside it at its own size.

    words: doc_id, box_id, ord, nl, tabs, aspect, and the box's u0, v0, u1, v1, size. Lines are a size apart, the first a size
    below the top, or on the bottom edge of a box thinner than that. Words below the bottom overflow. A box holds tens of
    words, so its words are folded as an array.
    """
    size, left, right, bottom = (F.col(c) for c in ("size", "left", "right", "bottom"))
    edges = {"left": F.least("u0", "u1"), "right": F.greatest("u0", "u1"), "top": F.least("v0", "v1"), "bottom": F.greatest("v0", "v1")}
    one = F.array_sort(F.collect_list(F.struct("ord", "nl", "tabs", F.col("aspect").cast("double").alias("aspect"))))
    boxes = words.withColumns(edges).groupBy("doc_id", "box_id").agg(one.alias("run"), *(F.max(c).cast("double").alias(c) for c in ("size", *edges)))
    start = F.struct(F.least(F.col("top") + size, bottom).alias("v"), left.alias("u"), F.array().cast("array<struct<ord:bigint,v:double,u:double,overflow:boolean>>").alias("out"))

    def place(so_far: Column, word: Column) -> Column:
        fresh = (word["nl"] > 0) & (F.size(so_far["out"]) > 0)
        u = F.when(fresh, left).otherwise(so_far["u"]) + word["tabs"] * tab * size
        width = word["aspect"] * size
        wraps = (u > left + 1e-9) & (u + width > right)
        v = so_far["v"] + F.when(fresh, size * word["nl"]).otherwise(0.0) + F.when(wraps, size).otherwise(0.0)
        over, u = v > bottom + 1e-6, F.when(wraps, left).otherwise(u)
        found = F.struct(word["ord"].cast("bigint").alias("ord"), F.when(~over, v).alias("v"), F.when(~over, u).alias("u"), over.alias("overflow"))
        return F.struct(v.alias("v"), F.when(over, u).otherwise(u + width + space * size).alias("u"), F.concat(so_far["out"], F.array(found)).alias("out"))

    return boxes.select("doc_id", "box_id", F.inline(F.aggregate("run", start, place)["out"]))


def paged(pictures: DataFrame, width: int, height: int, margin: int, word_gap: int, line_gap: int, word_height: int) -> DataFrame:
    """ARR-8: doc_id, ord, page, x, y, w of word pictures (doc_id, ord, w) set from left to right, wrapped and cut into pages; a
    picture wider than a line is shrunk to it."""
    usable = width - 2 * margin

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("ord")
        page, x, y, out = 0, margin, margin, []
        for w in group["w"].to_pylist():
            w = min(w, usable)
            if x != margin and x + word_gap + w > width - margin:
                x, y = margin, y + word_height + line_gap
            if y + word_height > height - margin:
                page, x, y = page + 1, margin, margin
            x += word_gap if x != margin else 0
            out.append((page, x, y, w))
            x += w
        return pa.table({"doc_id": group["doc_id"], "ord": group["ord"], **{c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("page", "x", "y", "w"))}})

    return pictures.selectExpr("cast(doc_id as long) doc_id", "cast(ord as long) ord", "cast(w as long) w").groupBy("doc_id").applyInArrow(fill, "doc_id long, ord long, page long, x long, y long, w long")


def _unit(seed: int, key: str) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "big") / 2.0**64


class Gaps:
    """The free stretches of a line between pinned words."""

    def __init__(self, low: float, high: float, taken: list[tuple[float, float]]) -> None:
        edge, self.free = low, []
        for a, b in sorted(taken):
            if a > edge:
                self.free.append((edge, min(a, high)))
            edge = max(edge, b)
        if edge < high:
            self.free.append((edge, high))
        self.free = [(a, b) for a, b in self.free if b - a > 1e-6]

    def fit(self, u: float, width: float) -> tuple[float, tuple[float, float]] | None:
        """Where a word of this width fits from u on, and the stretch, or None."""
        at = bisect.bisect_left([b for _, b in self.free], u + width)
        for a, b in self.free[at:]:
            if max(u, a) + width <= b:
                return max(u, a), (a, b)
        return None


def flowed(words: DataFrame, first: int, last: int, left: float, right: float, scale: float, space: float, tab: float, space_sd: float, seed: int) -> DataFrame:
    """ARR-6: doc_id, ord, line, u, overflow, clipped, orphaned of flowing words on lines first to last, around pinned ones.

    words: doc_id, ord, word_id, nl, tabs, aspect, pin_line, pin_u (null if not pinned). Pinned words keep their place and block
    it with half a space to each side. All others go to the next stretch that holds them, on this line or those after; what
    runs past the last line overflows. Spaces vary by a noise of the word's id.
    """
    gap, columns = space * scale, ("line", "u", "overflow", "clipped", "orphaned")

    def fill(group: pa.Table) -> pa.Table:
        rows = _rows(group)
        widths = [(r["aspect"] or DEFAULT_ASPECT) * scale for r in rows]
        taken: dict[int, list[tuple[float, float]]] = {}
        for r, w in zip(rows, widths):
            if r["pin_line"] is not None:
                taken.setdefault(r["pin_line"], []).append((r["pin_u"] - gap / 2, r["pin_u"] + w + gap / 2))
        lines: dict[int, Gaps] = {}

        def gaps(line: int) -> Gaps:
            if line not in lines:
                lines[line] = Gaps(left, right, taken.get(line, []))
            return lines[line]

        def start(line: int) -> float:
            return gaps(line).free[0][0] if gaps(line).free else left

        line, u, out = first, start(first), []
        for n, (r, w) in enumerate(zip(rows, widths)):
            if r["pin_line"] is not None:
                out.append((r["pin_line"], r["pin_u"], not first <= r["pin_line"] <= last, False, not first <= r["pin_line"] <= last))
                continue
            if n and r["nl"]:
                line += r["nl"]
                u = start(line)
            u += r["tabs"] * tab * scale
            hit = None
            while line <= last and (hit := gaps(line).fit(u, w)) is None:
                line += 1
                u = start(line)
            if hit is None:
                out.append((None, None, True, False, False))
                continue
            u, (a, b) = hit
            out.append((line, u, False, w > b - a, False))
            u += w + gap * (1 + (_unit(seed, f"{r['word_id']}:space") * 2 - 1) * space_sd)
        kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_())
        group = group.sort_by("ord")
        return pa.table({"doc_id": group["doc_id"], "ord": group["ord"], **{c: pa.array([o[i] for o in out], k) for i, (c, k) in enumerate(zip(columns, kinds))}})

    rows = words.selectExpr("cast(doc_id as long) doc_id", "cast(ord as long) ord", "cast(word_id as string) word_id", "cast(nl as int) nl", "cast(tabs as int) tabs", "cast(aspect as double) aspect", "cast(pin_line as long) pin_line", "cast(pin_u as double) pin_u")
    return rows.groupBy("doc_id").applyInArrow(fill, "doc_id long, ord long, line long, u double, overflow boolean, clipped boolean, orphaned boolean")


def layout_stats(placed: DataFrame) -> DataFrame:
    """AGG-17: doc_id, placed, total, and the places of words that overflow and that are clipped."""
    there = F.col("line").isNotNull() & ~F.col("overflow")
    which = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("ord"))))
    return placed.groupBy("doc_id").agg(F.count_if(there).alias("placed"), F.count("*").alias("total"), which("overflow").alias("overflow"), which("clipped").alias("clipped"))


def pinned(words: DataFrame, chosen: Column, line: int, u: float, space: float) -> DataFrame:
    """ARR-10: the words with pin_line and pin_u of a selection set down at (line, u), its shape kept: each word as far from the
    first chosen one as it was placed; words without a place are packed from u on. words: doc_id, ord, line, u, width."""
    doc = W.partitionBy("doc_id")
    w = words.withColumn("_in", F.coalesce(chosen, F.lit(False)))
    anchor = F.min(F.when(F.col("_in"), F.struct("ord", "line", "u"))).over(doc)
    w = w.withColumn("_a", anchor)
    loose = F.col("_in") & (F.col("line").isNull() | F.col("_a.line").isNull())
    packed = F.coalesce(F.sum(F.when(loose, F.col("width") + space)).over(doc.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    w = w.withColumn("_loose", loose).withColumn("_packed", packed)
    pin_line = F.when(F.col("_loose"), F.lit(line)).otherwise(F.lit(line) + F.col("line") - F.col("_a.line"))
    pin_u = F.when(F.col("_loose"), F.lit(u) + F.col("_packed")).otherwise(F.lit(u) + F.col("u") - F.col("_a.u"))
    out = w.withColumn("pin_line", F.when(F.col("_in"), pin_line.cast("long"))).withColumn("pin_u", F.when(F.col("_in"), pin_u))
    return out.drop("_in", "_a", "_loose", "_packed")


def moved(words: DataFrame, chosen: Column, lines: int, by: float) -> DataFrame:
    """ARR-10: pins of a selection moved; words without a pin stay."""
    hit = chosen & F.col("pin_line").isNotNull()
    return words.withColumns({"pin_line": F.when(hit, F.col("pin_line") + lines).otherwise(F.col("pin_line")), "pin_u": F.when(hit, F.col("pin_u") + by).otherwise(F.col("pin_u"))})


def unpinned(words: DataFrame, chosen: Column) -> DataFrame:
    """ARR-10: a selection's pins gone."""
    return words.withColumns({c: F.when(~chosen, F.col(c)) for c in ("pin_line", "pin_u")})


def history(events: DataFrame, cap: int = 60) -> DataFrame:
    """ARR-13: doc_id, seq, state, done of a log of edits, undos and redos: the state after each event and whether there was
    anything to do. events: doc_id, seq, op (edit, undo or redo), state (of an edit). At most `cap` states can be undone; a
    new edit forgets what was undone."""

    def replay(group: pa.Table) -> pa.Table:
        now, back, forth, out = None, [], [], []
        for r in group.sort_by("seq").to_pylist():
            done = True
            if r["op"] == "edit":
                back, forth, now = [*back, now][-cap:], [], r["state"]
            else:
                source, target = (back, forth) if r["op"] == "undo" else (forth, back)
                done = bool(source)
                if done:
                    target.append(now)
                    now = source.pop()
            out.append((r["doc_id"], r["seq"], now, done))
        return pa.table({c: pa.array([o[i] for o in out], k) for i, (c, k) in enumerate((("doc_id", pa.int64()), ("seq", pa.int64()), ("state", pa.string()), ("done", pa.bool_())))})

    rows = events.selectExpr("cast(doc_id as long) doc_id", "cast(seq as long) seq", "op", "cast(state as string) state")
    return rows.groupBy("doc_id").applyInArrow(replay, "doc_id long, seq long, state string, done boolean")


def set_entry(entries: Column, key: Column, value: Column) -> Column:
    """ARR-14: a map with a key set to a value, or without it if the value is 0 or null."""
    rest = F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,int>")), lambda k, _: k != key)
    return F.when(F.coalesce(value, F.lit(0)) == 0, rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def loaded(document: Column, schema: str, version: int = 1) -> Column:
    """ARR-12: struct(status, doc): a JSON document if it can be read and isn't newer than this version; no version counts as 1."""
    doc = F.from_json(document, schema)
    number = F.coalesce(F.get_json_object(document, "$.version").cast("int"), F.lit(1))
    broken = F.get_json_object(document, "$").isNull()
    status = F.when(broken, "unreadable").when(number > version, "newer").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", doc).alias("doc"))


def upright(pixels: Column) -> Column:
    """ARR-3: a picture's grey values, inverted where their mean is below 110."""
    mean = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(pixels)
    return F.when(mean < 110, F.transform(pixels, lambda x: (255 - x).cast("int"))).otherwise(pixels)


def batch_checks(samples: DataFrame, size: int = 4) -> DataFrame:
    """ARR-4: batch, n, width, ok of packed samples (idx, img_len, height, lb_len) taken `size` at a time: pictures are padded to
    the widest, all 32 high, and no label is empty."""
    ok = F.every((F.col("height") == 32) & (F.col("img_len") > 0) & (F.col("lb_len") > 0))
    return samples.groupBy(F.floor(F.col("idx") / size).alias("batch")).agg(F.count("*").alias("n"), F.max("img_len").cast("long").alias("width"), ok.alias("ok"))


def resized_width(width: Column, height: Column, to: int) -> Column:
    """ARR-9: a picture's width at a common height, 1 at least; null for one without height."""
    return F.when(height > 0, F.greatest(F.lit(1), F.bround(width * float(to) / height, 0)).cast("long"))


@F.arrow_udf(LongType())
def word_seed(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NOI-3: a word's own seed, of a text id:variant."""
    for part in ids:
        yield pa.array([None if k is None else int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") % 2**31 for k in part.to_pylist()], pa.int64())


@F.arrow_udf(StringType())
def cache_key(signs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NOI-3: the name of a word's picture, of a text word|seed|style|checkpoint."""
    for part in signs:
        yield pa.array([None if k is None else hashlib.blake2b(k.encode(), digest_size=10).hexdigest() for k in part.to_pylist()], pa.string())


def rerolled(words: DataFrame, chosen: Column) -> DataFrame:
    """NOI-4: a selection's words with the next variant and without a picture."""
    return words.withColumns({"variant": F.when(chosen, F.coalesce("variant", F.lit(0)) + 1).otherwise(F.col("variant")), "png": F.when(~chosen, F.col("png"))})


def word_quads(words: DataFrame, seed: int, scale: float, amplitudes: dict[str, Column]) -> DataFrame:
    """GEO-20: words with v0, u0 to v3, u3, the page-space corners TL, TR, BR, BL of each placed one: drift along the line, a size
    of its own, and a lean. words: word_id, line, u, aspect. Corners go to pixels by a sheet's mapping."""
    from .sequences import drift

    noise = lambda salt: unit_noise(F.concat(F.lit(f"{seed}:"), "word_id", F.lit(f":{salt}"))) * 2 - 1
    w = words.withColumn("_s", scale * (1 + noise("size") * amplitudes["size_sd"])).withColumn("_w", F.coalesce("aspect", F.lit(DEFAULT_ASPECT)) * F.col("_s"))
    w = w.withColumn("_dv", drift(F.lit(seed), F.col("line"), F.col("u") + F.col("_w") / 2, 1.0) * amplitudes["baseline"] * F.col("_s"))
    w = w.withColumn("_lean", F.tan(F.radians(noise("slant") * amplitudes["slant_sd"])) * F.col("_s"))
    top, bottom = F.col("line") + F.col("_dv") - BASELINE * F.col("_s"), F.col("line") + F.col("_dv") + (1 - BASELINE) * F.col("_s")
    u, wide, lean = F.col("u"), F.col("_w"), F.col("_lean")
    corners = {"v0": top, "u0": u + lean, "v1": top, "u1": u + wide + lean, "v2": bottom, "u2": u + wide, "v3": bottom, "u3": u}
    return w.withColumns(corners).drop("_s", "_w", "_dv", "_lean")


def document_view(quads: DataFrame) -> DataFrame:
    """ARR-11: doc_id, view: the document as JSON: its words in order with corners and bounds rounded to tenths, and how many
    overflow. quads: doc_id, ord, word_id, text, overflow, and pixel corners x0, y0 to x3, y3 (null if not placed)."""
    xs, ys = [F.col(f"x{k}") for k in range(4)], [F.col(f"y{k}") for k in range(4)]
    tenth = lambda c: F.round(c, 1)
    placed = F.col("x0").isNotNull() & ~F.col("overflow")
    quad = F.array(*(F.array(tenth(x), tenth(y)) for x, y in zip(xs, ys)))
    item = F.struct("ord", F.col("word_id").alias("id"), "text", "overflow", F.when(placed, quad).alias("quad"), F.when(placed, tenth(F.least(*xs))).alias("x"), F.when(placed, tenth(F.least(*ys))).alias("y"), F.when(placed, tenth(F.greatest(*xs) - F.least(*xs))).alias("w"), F.when(placed, tenth(F.greatest(*ys) - F.least(*ys))).alias("h"))
    one = quads.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("words"), F.count_if("overflow").alias("overflow"))
    return one.select("doc_id", F.to_json(F.struct(F.transform("words", lambda w: w.dropFields("ord")).alias("words"), "overflow")).alias("view"))


def edited_sheet(sheet: dict[str, float], event: dict) -> dict[str, float]:
    """GEO-22: a sheet after one drag or key press, as values. Events: corner (k, x, y), margin (x, y), bow (value), top and bottom
    (lines to add), move (from and to a pixel: the writing area slides by the same way on the page)."""
    s = dict(sheet)
    m = np.array([s[f"m{i}"] for i in range(9)]).reshape(3, 3)
    scale = 2.0 / max(s["img_w"], s["img_h"])

    def page(x: float, y: float) -> tuple[float, float]:
        p = m @ np.array([(x - s["img_w"] / 2) * scale, (y - s["img_h"] / 2) * scale, 1.0])
        w = p[2] if abs(p[2]) >= 1e-12 else 1e-12
        span = s["u_right"] - s["u_left"]
        t = 0.0 if abs(span) < 1e-9 else min(1.25, max(-0.25, (p[0] / w - s["u_left"]) / span))
        return float(p[0] / w), float(p[1] / w + s["c1"] * t * (1 - t) + s["c2"] * t * (1 - t) * (2 * t - 1))

    kind = event["kind"]
    if kind == "corner":
        u, v = page(event["x"], event["y"])
        first, last = s["i_first"], s["i_first"] + s["n_lines"] - 1
        low, high = (u, s["u_right"]) if event["k"] in (0, 3) else (s["u_left"], u)
        first, last = (round(v), last) if event["k"] in (0, 1) else (first, round(v))
        if high - low >= 1.0:
            s["u_left"], s["u_right"] = low, high
        if last > first:
            s["i_first"], s["n_lines"] = first, last - first + 1
    elif kind == "margin":
        u, _ = page(event["x"], event["y"])
        for k in range(3):
            s[f"m{k}"] -= u * s[f"m{6 + k}"]
        s["u_left"], s["u_right"] = 0.0, s["u_right"] - u
    elif kind == "bow":
        s["c1"] = event["x"]
    elif kind == "top":
        s["i_first"], s["n_lines"] = s["i_first"] - event["k"], max(1, s["n_lines"] + event["k"])
    elif kind == "bottom":
        s["n_lines"] = max(1, s["n_lines"] + event["k"])
    elif kind == "move":
        (u0, v0), (u1, v1) = page(event["x"], event["y"]), page(event["x2"], event["y2"])
        s["u_left"], s["u_right"], s["i_first"] = s["u_left"] + u1 - u0, s["u_right"] + u1 - u0, s["i_first"] + round(v1 - v0)
    return s


def edited_sheets(sheets: DataFrame, events: DataFrame) -> DataFrame:
    """GEO-22: each page's sheet after all its events (page, seq, kind, k, x, y, x2, y2) in order."""
    names = sheets.columns

    def fold(mine: pa.Table, log: pa.Table) -> pa.Table:
        out = []
        for sheet in mine.to_pylist():
            for event in log.sort_by("seq").to_pylist():
                sheet = edited_sheet(sheet, event)
            out.append(sheet)
        return pa.table({c: pa.array([r[c] for r in out], mine.schema.field(c).type) for c in names})

    return sheets.groupBy("page").cogroup(events.groupBy("page")).applyInArrow(fold, sheets.schema)
