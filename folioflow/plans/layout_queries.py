"""Queries of layout, pins, histories and packed arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import sequences as S
from ..operators import sheets as G
from ..operators.ranks import numbered
from ..sources.fixtures import FLOW_SQL, RASTER_SQL, flow_words, raster, read
from ..sources.stored import stored
from .registry import query
from .review_queries import _PACK, _packable
from .sheet_queries import _sheets

_WRAP = f"""WITH RECURSIVE {FLOW_SQL}, w AS (SELECT doc_id, ord, aspect * 1.05::DOUBLE AS width, nl, tabs FROM flow),
p AS (SELECT doc_id, ord, width, 0 AS line, tabs * 0.63::DOUBLE AS u FROM w WHERE ord = 0
 UNION ALL SELECT w.doc_id, w.ord, w.width, CASE WHEN nl > 0 THEN line + nl WHEN b + tabs * 0.63::DOUBLE + w.width > 40 THEN line + 1 ELSE line END, CASE WHEN nl > 0 THEN tabs * 0.63::DOUBLE WHEN b + tabs * 0.63::DOUBLE + w.width > 40 THEN 0::DOUBLE ELSE b + tabs * 0.63::DOUBLE END
 FROM (SELECT *, u + width + 0.3::DOUBLE AS b FROM p) q JOIN w ON w.doc_id = q.doc_id AND w.ord = q.ord + 1)"""


def _flow(spark, d):
    return flow_words(spark, d).withColumn("width", F.col("aspect") * 1.05)


@query(_WRAP + " SELECT doc_id, ord, line::BIGINT AS line, round(u, 6)::DOUBLE AS u, line > 30 AS overflow FROM p")
def arr5_line_wrap(spark, d):
    """Every conversation's words wrapped to 40 units, 31 lines."""
    out = S.wrapped(_flow(spark, d), 0.0, 40.0, 30, 0.3, 0.63)
    return out.withColumn("u", F.round("u", 6))


def _placed(spark, d):
    words = _flow(spark, d).withColumn("word_id", F.concat_ws(":", "doc_id", "ord"))
    pin = F.when(F.col("pin"), F.floor(F.col("ord") / 23) * 2 + 1)
    return L.flowed(words.select("doc_id", "ord", "word_id", "nl", "tabs", "aspect", pin.alias("pin_line"), F.when(F.col("pin"), F.lit(9.0)).alias("pin_u")), 0, 30, 0.0, 40.0, 1.05, 0.28, 0.6, 0.1, 7)


@query()
def arr6_flow_layout(spark, d):
    return _placed(spark, d)


@query()
def agg17_layout_stats(spark, d):
    stats = L.layout_stats(_placed(spark, d))
    return stats.select("doc_id", "placed", "total", F.size("overflow").alias("overflow"), F.size("clipped").alias("clipped"))


_BOXW = f"""WITH RECURSIVE {FLOW_SQL}, w AS (SELECT doc_id, box_rank, row_number() OVER (PARTITION BY doc_id, box_rank ORDER BY ord) AS k, ord, aspect * (0.8 + box_rank * 0.1) AS width, 0.8 + box_rank * 0.1 AS size, nl, tabs, (2 + box_rank * 6)::DOUBLE AS v0, CASE WHEN box_rank = 2 THEN 14.5 ELSE 7.0 + box_rank * 6 END AS v1, 3.0 AS u0, 33.0 AS u1 FROM flow WHERE box_rank IS NOT NULL),
p AS (SELECT doc_id, box_rank, k, ord, least(v0 + size, v1)::DOUBLE AS v, (u0 + tabs * 0.6 * size)::DOUBLE AS u, (u0 + tabs * 0.6 * size + width + 0.28 * size)::DOUBLE AS b FROM w WHERE k = 1
 UNION ALL SELECT doc_id, box_rank, k, ord, v, u, CASE WHEN v > v1 + 1e-6 THEN u ELSE u + width + 0.28 * size END FROM (SELECT doc_id, box_rank, k, ord, size, width, v1, CASE WHEN wrap THEN v2 + size ELSE v2 END AS v, CASE WHEN wrap THEN u0 ELSE u2 END AS u FROM (SELECT *, u2 > u0 + 1e-9 AND u2 + width > u1 AS wrap FROM (SELECT w.*, CASE WHEN nl > 0 THEN p.v + w.size * nl ELSE p.v END AS v2, CASE WHEN nl > 0 THEN u0 ELSE p.b END + tabs * 0.6 * w.size AS u2 FROM p JOIN w ON w.doc_id = p.doc_id AND w.box_rank = p.box_rank AND w.k = p.k + 1))))"""


def _boxed(spark, d):
    r = F.col("box_rank")
    words = flow_words(spark, d).where("box_rank is not null").withColumns({"box_id": r.cast("string"), "size": 0.8 + r * 0.1, "u0": F.lit(33.0), "u1": F.lit(3.0), "v0": (2 + r * 6).cast("double"), "v1": F.when(r == 2, 14.5).otherwise(7.0 + r * 6)})
    return L.boxed(words, 0.28, 0.6)


@query(_BOXW + " SELECT p.doc_id, p.box_rank::VARCHAR AS box_id, p.ord, CASE WHEN p.v <= v1 + 1e-6 THEN round(p.v, 6) END AS v, CASE WHEN p.v <= v1 + 1e-6 THEN round(p.u, 6) END AS u, p.v > v1 + 1e-6 AS overflow FROM p JOIN w ON w.doc_id = p.doc_id AND w.ord = p.ord")
def arr7_box_wrap(spark, d):
    """The box of rank 2 is thinner than a line; its text sits on the bottom edge."""
    return _boxed(spark, d).withColumns({"v": F.round("v", 6), "u": F.round("u", 6)})


_PAGED = f"""WITH RECURSIVE {FLOW_SQL}, w AS (SELECT doc_id, ord, least(1080, 20 + len(word) * 23 * CASE WHEN ord % 41 = 5 THEN 12 ELSE 1 END)::BIGINT AS w FROM flow),
p AS (SELECT doc_id, ord, w, 0::BIGINT AS page, 60::BIGINT AS x, 60::BIGINT AS y FROM w WHERE ord = 0
 UNION ALL SELECT doc_id, ord, w, CASE WHEN y2 + 64 > 740 THEN page + 1 ELSE page END, CASE WHEN y2 + 64 > 740 OR wrap THEN 60 ELSE e + 24 END, CASE WHEN y2 + 64 > 740 THEN 60 ELSE y2 END FROM (SELECT *, CASE WHEN wrap THEN y + 92 ELSE y END AS y2 FROM (SELECT w.doc_id, w.ord, w.w, p.page, p.y, p.x + p.w AS e, p.x + p.w + 24 + w.w > 1140 AS wrap FROM p JOIN w ON w.doc_id = p.doc_id AND w.ord = p.ord + 1)))"""


@query(_PAGED + " SELECT doc_id, ord, page, x, y, w FROM p")
def arr8_page_layout(spark, d):
    w = 20 + F.length("word") * 23 * F.when(F.col("ord") % 41 == 5, 12).otherwise(1)
    return L.paged(flow_words(spark, d).select("doc_id", "ord", w.alias("w")), 1200, 800, 60, 24, 28, 64)


@query("SELECT p_partkey, CASE WHEN h > 0 THEN greatest(1, round_even(w * 64.0::DOUBLE / h, 0))::BIGINT ELSE -1 END AS w FROM (SELECT p_partkey, p_size * 13 % 300 AS w, p_size % 17 AS h FROM part)")
def arr9_resized_widths(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", F.coalesce(L.resized_width(s * 13 % 300, s % 17, 64), F.lit(-1)).alias("w"))


@query(f"""WITH {FLOW_SQL}, w AS (SELECT doc_id, ord, CASE WHEN ord % 6 <> 5 THEN ord // 7 END AS line, CASE WHEN ord % 6 <> 5 THEN (ord % 7) * 3.5::DOUBLE END AS u, aspect AS width, ord BETWEEN 4 AND 20 AND ord % 3 <> 1 AS c FROM flow), a AS (SELECT *, min(CASE WHEN c THEN ord END) OVER (PARTITION BY doc_id) AS f FROM w),
l AS (SELECT a.*, b.line AS al, b.u AS au FROM a LEFT JOIN w b ON b.doc_id = a.doc_id AND b.ord = a.f), k AS (SELECT *, c AND (line IS NULL OR al IS NULL) AS loose FROM l), s AS (SELECT *, coalesce(sum(CASE WHEN loose THEN width + 0.3 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS packed FROM k),
p AS (SELECT doc_id, ord, CASE WHEN c THEN CASE WHEN loose THEN 12 ELSE 12 + line - al END END AS pl, CASE WHEN c THEN CASE WHEN loose THEN 5.0 + packed ELSE 5.0 + u - au END END AS pu FROM s)
SELECT doc_id, ord, CASE WHEN ord % 5 <> 0 THEN pl + CASE WHEN ord % 2 = 0 THEN 2 ELSE 0 END END AS pin_line, CASE WHEN ord % 5 <> 0 THEN round(pu + CASE WHEN ord % 2 = 0 THEN 0.5 ELSE 0 END, 6) END AS pin_u FROM p WHERE coalesce(CASE WHEN ord % 5 <> 0 THEN pl END, -1) >= 0""")
def arr10_pins(spark, d):
    """A selection pinned, every second word moved, every fifth unpinned; the words still pinned."""
    o = F.col("ord")
    there = o % 6 != 5
    words = flow_words(spark, d).select("doc_id", "ord", F.when(there, F.floor(o / 7)).alias("line"), F.when(there, o % 7 * 3.5).alias("u"), F.col("aspect").alias("width"))
    out = L.pinned(words, o.between(4, 20) & (o % 3 != 1), 12, 5.0, 0.3)
    out = L.unpinned(L.moved(out, o % 2 == 0, 2, 0.5), o % 5 == 0)
    return out.where("pin_line is not null").select("doc_id", "ord", "pin_line", F.round("pin_u", 6).alias("pin_u"))


def _quads(spark, d):
    words = _flow(spark, d).select("doc_id", "ord", F.col("word").alias("text"), "aspect", F.concat_ws(":", "doc_id", "ord").alias("word_id"))
    placed = words.join(_placed(spark, d), ["doc_id", "ord"])
    return L.word_quads(placed.where("line is not null and not overflow"), 7, 1.05, S.humanised(F.lit(0.35))), placed.where("line is null or overflow")


@query()
def geo20_word_quads(spark, d):
    quads, _ = _quads(spark, d)
    return quads.select("doc_id", "ord", *(F.round(f"{c}{k}", 6).alias(f"{c}{k}") for k in range(4) for c in "vu"))


@query()
def arr11_document_view(spark, d):
    quads, rest = _quads(spark, d)
    sheet = _sheets(spark).where("page = 1").drop("page").withColumn("one", F.lit(1))
    out = quads.withColumn("one", F.lit(1)).join(F.broadcast(sheet), "one")  # one row
    for k in range(4):
        out = G.to_image(out, F.col(f"v{k}"), F.col(f"u{k}"), f"x{k}", f"y{k}")
    columns = ["doc_id", "ord", "word_id", "text", "overflow"]
    corners = [f"{a}{k}" for k in range(4) for a in "xy"]
    return L.document_view(out.select(*columns, *corners).union(rest.select(*columns, *(F.lit(None).cast("double").alias(c) for c in corners))))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unreadable' WHEN event_id % 4 = 2 THEN 'newer' ELSE 'ok' END AS status, CASE WHEN event_id % 11 <> 0 AND event_id % 4 <> 2 THEN event_id % 100 ELSE -1 END AS seed FROM events")
def arr12_versioned_documents(spark, d):
    e = F.col("event_id")
    version = F.when(e % 4 == 3, "").otherwise(F.concat(F.lit('"version": '), (e % 4).cast("string"), F.lit(", ")))
    raw = F.when(e % 11 == 0, '{"version": 1, ').otherwise(F.concat(F.lit("{"), version, F.lit('"seed": '), (e % 100).cast("string"), F.lit("}")))
    return read(spark, d, "events").select("event_id", L.loaded(raw, "seed long").alias("l")).select("event_id", "l.status", F.coalesce("l.doc.seed", F.lit(-1)).alias("seed"))


@query()
def arr13_undo_redo(spark, d):
    """Each user's events as edits, undos and redos of one document."""
    e = F.col("event_id")
    op = F.when(e % 7 < 4, "edit").when(e % 7 < 6, "undo").otherwise("redo")
    return L.history(read(spark, d, "events").select(F.col("user_id").alias("doc_id"), e.alias("seq"), op.alias("op"), e.cast("string").alias("state")), 5)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 2)::INT + 1 ELSE 2 + (event_id % 2)::INT - (event_id % 3 = 0)::INT * (event_id % 2)::INT END AS n, CASE WHEN event_id % 4 <> 0 THEN (event_id % 4 * 90)::INT ELSE 0 END AS degrees FROM events")
def arr14_rotation_entries(spark, d):
    """A map of one or two rotations with one set, or removed if it is 0; one of them may be the same scan's."""
    e = F.col("event_id")
    first = F.create_map(F.lit("a.jpg"), F.lit(90))
    both = F.map_concat(first, F.create_map(F.when((e % 3 == 0) & (e % 4 != 0), "b.jpg").otherwise("c.jpg"), F.lit(180)))
    now = L.set_entry(F.when(e % 2 == 1, both).otherwise(first).cast("map<string,int>"), F.lit("b.jpg"), (e % 4 * 90).cast("int"))
    return read(spark, d, "events").select("event_id", now.alias("m")).select("event_id", F.size("m").alias("n"), F.coalesce(F.element_at("m", "b.jpg"), F.lit(0)).alias("degrees"))


@query(f"WITH {RASTER_SQL}, r AS (SELECT page, row, list(CASE WHEN page % 2 = 0 THEN v ELSE 255 - v END ORDER BY col) AS px FROM raster GROUP BY page, row) SELECT page, row, list_avg(px) < 110 AS inverted, list_sum(CASE WHEN list_avg(px) < 110 THEN list_transform(px, lambda x: 255 - x) ELSE px END)::BIGINT AS total FROM r")
def arr3_polarity_guard(spark, d):
    px = F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda s: s["v"])
    rows = raster(spark).withColumn("v", F.when(F.col("page") % 2 == 0, F.col("v")).otherwise(255 - F.col("v"))).groupBy("page", "row").agg(px.alias("px"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("page", "row", (total(F.col("px")) / F.size("px") < 110).alias("inverted"), total(L.upright(F.col("px"))).alias("total"))


@query(_PACK + ", i AS (SELECT *, row_number() OVER (ORDER BY image_path) - 1 AS idx FROM k) SELECT idx // 4 AS batch, count(*) AS n, max(img_w) AS width, bool_and(img_w > 0 AND len(t) > 0) AS ok FROM i GROUP BY 1")
def arr4_batch_checks(spark, d):
    rows = numbered(_packable(spark, d).select("image_path", F.col("img_w").alias("img_len"), F.length("t").alias("lb_len")), ["image_path"], "idx")
    return L.batch_checks(rows.withColumn("height", F.lit(32)))


@query(f"WITH {FLOW_SQL} SELECT doc_id, ord, round(aspect * coalesce(0.8 + box_rank * 0.1, 1.05), 6)::DOUBLE AS width FROM flow")
def jon14_prj15_word_widths(spark, d):
    words = flow_words(spark, d).withColumn("box_id", F.col("box_rank").cast("string"))
    boxes = words.where("box_rank is not null").select("doc_id", "box_id", (0.8 + F.col("box_rank") * 0.1).alias("size")).distinct()
    return L.sized_words(words, boxes, 1.05).select("doc_id", "ord", F.round("width", 6).alias("width"))


@query()
def noi3_word_seeds(spark, d):
    words = stored(flow_words(spark, d).select(F.concat_ws(":", "doc_id", "ord", F.lit("0")).alias("id"), "word"))
    seeded = words.select("id", "word", L.word_seed("id").alias("seed"))
    return seeded.select("id", "seed", L.cache_key(F.concat_ws("|", "word", "seed", F.lit(""), F.lit("pretrained"))).alias("key"))


@query(f"WITH {FLOW_SQL} SELECT doc_id, ord, CASE WHEN ord % 4 = 1 THEN ord % 3 + 1 ELSE ord % 3 END AS variant, CASE WHEN ord % 4 <> 1 THEN word || '.png' END AS png FROM flow")
def noi4_rerolled(spark, d):
    words = flow_words(spark, d).select("doc_id", "ord", (F.col("ord") % 3).alias("variant"), F.concat("word", F.lit(".png")).alias("png"))
    return L.rerolled(words, F.col("ord") % 4 == 1)


@query()
def geo22_edited_sheets(spark, d):
    """Each sheet after the events of a few users, in order."""
    e = F.col("event_id")
    kinds = F.array(*map(F.lit, ("corner", "bow", "top", "move", "bottom", "margin")))
    log = read(spark, d, "events").where("user_id < 40").select((F.col("user_id") % 3).alias("page"), e.alias("seq"), F.element_at(kinds, (e % 6 + 1).cast("int")).alias("kind"), (e % 4).cast("int").alias("k"), F.when(e % 6 == 1, 0.1).otherwise(100 + e * 37 % 900).cast("double").alias("x"), (100 + e * 53 % 1300).cast("double").alias("y"), (110 + e * 37 % 900).cast("double").alias("x2"), (105 + e * 53 % 1300).cast("double").alias("y2"))
    return L.edited_sheets(_sheets(spark), log)
