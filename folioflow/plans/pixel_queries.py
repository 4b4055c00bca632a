"""Queries of pictures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import pixels as P
from ..sources.fixtures import RASTER_SQL, raster, read
from ..sources.stored import stored
from .registry import query


@query()
def pix1_letter_ink(spark, d):
    """Every picture's letter ink; one page more is missing, one is too small."""
    cells = stored(raster(spark))
    pages = cells.groupBy("page").agg(F.when(F.col("page") == 3, 99).otherwise(F.count("*")).alias("cells")).union(spark.createDataFrame([(99, None)], "page long, cells long"))
    return P.letter_ink(P.component_rows(cells), pages).withColumn("ink", F.round("ink", 9))


@query(f"""WITH {RASTER_SQL}, h AS (SELECT page, v, count(*) AS n FROM raster GROUP BY ALL), c AS (SELECT *, sum(n) OVER b AS n0, sum(n * v) OVER b AS s0, sum(n) OVER p AS n2, sum(n * v) OVER p AS s2 FROM h WINDOW b AS (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY page)),
k AS (SELECT *, round(coalesce(CASE WHEN n2 > n0 THEN n0 * (n2 - n0)::DOUBLE * (s0 / n0::DOUBLE - (s2 - s0) / (n2 - n0)::DOUBLE) ** 2 END, 0), 3) AS between_ FROM c), t AS (SELECT page, arg_max(v, (between_, -v)) AS threshold, arg_max(n0, (between_, -v)) AS n0, max(n2) AS n2, (max(v) - min(v))::DOUBLE AS contrast FROM k GROUP BY page)
SELECT page, threshold, round(CASE WHEN contrast < 10 THEN 0 ELSE n0 / n2::DOUBLE END, 9) AS ink, contrast FROM t""")
def pix2_otsu(spark, d):
    return P.otsu(raster(spark)).withColumn("ink", F.round("ink", 9))


@query(f"WITH {RASTER_SQL}, l AS (SELECT *, lag(v) OVER a AS l, lead(v) OVER a AS r, lag(v) OVER b AS u, lead(v) OVER b AS d FROM raster WINDOW a AS (PARTITION BY page, row ORDER BY col), b AS (PARTITION BY page, col ORDER BY row)) SELECT page, round(var_pop(coalesce(l, r) + coalesce(r, l) + coalesce(u, d) + coalesce(d, u) - 4 * v), 6) AS focus FROM l GROUP BY page")
def pix3_focus(spark, d):
    return P.focus(raster(spark), 160, 120).withColumn("focus", F.round("focus", 6))


@query()
def pix4_page_region(spark, d):
    """The bright sheet in pictures of a sheet on a dark desk."""
    desk = raster(spark).withColumn("v", F.when(F.col("row").between(20, 120) & F.col("col").between(15 + F.col("page"), 100), 230 - F.col("v") % 20).otherwise(30 + F.col("v") % 30))

    def work(picture):
        found = P.page_region(picture, 128.0)
        return {c: [found[i]] if found else [] for i, c in enumerate(("x", "y", "w", "h"))}

    return P.kernel(desk, work, "x long, y long, w long, h long")


@query()
def pix5_background(spark, d):
    """Mean and spread of each picture once its background is level."""
    return P.kernel(raster(spark).where("page < 4"), lambda p: {"mean": [float(np.round(P.normalised_background(p).mean(), 6))], "spread": [float(np.round(P.normalised_background(p).std(), 6))]}, "mean double, spread double")


@query("SELECT event_id, CASE WHEN abs(s) < 0.3 OR abs(s) > 30 THEN 0.0 ELSE s END::DOUBLE AS turn FROM (SELECT event_id, CASE WHEN a < -45 THEN a + 90 WHEN a > 45 THEN a - 90 ELSE a END AS s FROM (SELECT event_id, (event_id * 7 % 1800) / 10.0::DOUBLE - 90 AS a FROM events))")
def pix6_deskew_decision(spark, d):
    return read(spark, d, "events").select("event_id", P.deskew_angle(F.col("event_id") * 7 % 1800 / F.lit(10.0) - 90).alias("turn"))


@query("SELECT p_partkey, CASE WHEN w >= 0.55 * 100 AND h <= 6 THEN 'rule' WHEN h > 0.5 * 60 OR w > 0.5 * 100 THEN 'large' ELSE 'keep' END AS kind FROM (SELECT p_partkey, p_size * 2 AS w, p_size % 37 AS h FROM part)")
def pix7_component_kinds(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", P.ruled_or_large(s * 2, s % 37, 100, 60).alias("kind"))


@query()
def pix8_word_splits(spark, d):
    """The words of each picture's first line."""
    line = raster(spark).where("row between 8 and 27").withColumn("row", F.col("row") - 8).withColumn("v", F.when((F.col("col") + F.col("page")) % 40 < 12, 240).otherwise(F.col("v")))

    def work(picture):
        found = P.word_splits(picture)
        return {c: [f[i] for f in found] for i, c in enumerate(("x", "y", "w", "h"))}

    return P.kernel(line, work, "x long, y long, w long, h long")


@query()
def pix9_channel_response(spark, d):
    cells = raster(spark).where("page < 3").withColumns({"b": F.col("v") + F.when(F.col("row") % 20 == 5, 30).otherwise(0), "r": F.col("v")})
    return P.channel_response(cells).withColumn("response", F.round("response", 6))


_AT = "pts AS (SELECT page, id, page * 3 + id * 5.3::DOUBLE AS x, id * 7.7::DOUBLE AS y FROM (SELECT unnest(range(20)) AS page), (SELECT unnest(range(24)) AS id))"


@query(f"WITH {RASTER_SQL}, {_AT}, n AS (SELECT page, id, floor(x)::INT + i AS col, floor(y)::INT + j AS row, CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END * CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END AS w FROM pts, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(i, j)) SELECT n.page, id, round(sum(w * coalesce(v, 0)), 6) AS value FROM n LEFT JOIN raster r ON r.page = n.page AND r.row = n.row AND r.col = n.col GROUP BY n.page, id")
def pix10_bilinear(spark, d):
    points = spark.range(20 * 24).selectExpr("id div 24 page", "id % 24 i").selectExpr("page", "i id", "page * 3 + i * cast(5.3 as double) x", "i * cast(7.7 as double) y")
    return P.sampled(points, raster(spark)).withColumn("value", F.round("value", 6))


@query(f"WITH {RASTER_SQL}, l AS (SELECT page, quantile_cont(v, 0.96) AS paper, quantile_cont(v, 0.02) AS ink FROM raster GROUP BY page), a AS (SELECT r.page, row, col, greatest(0, least(1, (paper - v) / greatest(8, paper - ink))) AS a FROM raster r JOIN l ON l.page = r.page) SELECT page, row, col, round(greatest(0, least(1, greatest(0, least(1, (a - 0.30::DOUBLE) / 0.70::DOUBLE)) * 2.2::DOUBLE)), 6) AS alpha FROM a")
def pix11_ink_matte(spark, d):
    return P.ink_matte(raster(spark)).withColumn("alpha", F.round("alpha", 6))


@query()
def geo19_rule_angle(spark, d):
    """Pictures of rules that are turned by 1.5 degrees a page."""
    t = F.radians((F.col("page") - 5) * 1.5)
    at = (F.col("row") - 79.5) * F.cos(t) - (F.col("col") - 59.5) * F.sin(t)
    turned = raster(spark).where("page < 10").withColumn("v", F.when(F.abs(at - 16 * F.round(at / 16)) < 1.2, 100).otherwise(0))
    return P.kernel(turned, lambda p: {"angle": [P.rule_angle(p)]}, "angle double")


@query()
def geo12_margin(spark, d):
    """Pictures of a margin at a column of its own, the right of some cut off."""
    lit = raster(spark).withColumn("v", F.when((F.col("col") == 20 + F.col("page")) & ((F.col("row") + F.col("page")) % 9 != 0), 90).otherwise(F.col("v") % 7))

    def work(picture):
        found = P.margin_position(picture)
        return {"at": [] if found is None else [found]}

    return P.kernel(lit, work, "at long")


@query(f"WITH {RASTER_SQL} SELECT page, row, col, v FROM raster WHERE page <> 7 AND page < 10")
def src11_decoded_pictures(spark, d):
    """Pictures written as plain PGM text and decoded; one of them is broken and skipped."""
    px = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "v"))), lambda s: s["v"].cast("string")), " ")
    files = raster(spark).where("page < 10").groupBy("page").agg(px.alias("px"))
    content = F.when(F.col("page") == 7, "P2 oops").otherwise(F.concat(F.lit("P2\n# a picture\n120 160\n255\n"), "px"))
    found = P.decoded(files.select(F.col("page").cast("string").alias("name"), content.cast("binary").alias("content"))).where("width is not null")
    cells = found.select(F.col("name").cast("long").alias("page"), "width", F.posexplode("v").alias("at", "v"))
    return cells.select("page", F.floor(F.col("at") / F.col("width")).cast("int").alias("row"), (F.col("at") % F.col("width")).cast("int").alias("col"), "v")


@query(f"WITH {RASTER_SQL} SELECT page, CASE page % 9 WHEN 3 THEN 159 - row WHEN 4 THEN 159 - row WHEN 5 THEN col WHEN 6 THEN col WHEN 7 THEN 119 - col WHEN 8 THEN 119 - col ELSE row END::INT AS row, CASE page % 9 WHEN 2 THEN 119 - col WHEN 3 THEN 119 - col WHEN 5 THEN row WHEN 6 THEN 159 - row WHEN 7 THEN 159 - row WHEN 8 THEN row ELSE col END::INT AS col, v FROM raster")
def src12_oriented_pictures(spark, d):
    return P.upright_cells(raster(spark), F.col("page") % 9, 160, 120)


@query(f"WITH {RASTER_SQL} SELECT page, row, col, greatest(0, least(255, floor(round((200 + row % 40) * (1 - a + a * (v / 255.0::DOUBLE)), 6))))::INT AS out FROM (SELECT *, (col % 5) / 4.0::DOUBLE AS a FROM raster)")
def pix12_composited(spark, d):
    cells = raster(spark).withColumns({"paper": 200 + F.col("row") % 40, "alpha": F.col("col") % 5 / F.lit(4.0), "tone": F.col("v") / F.lit(255.0)})
    return P.composited(cells).select("page", "row", "col", "out")


@query(f"""WITH {RASTER_SQL}, d AS (SELECT page, col, sum(CASE WHEN col BETWEEN 30 + page AND 44 + page THEN (col * 7 + row) % 50 ELSE 0 END)::DOUBLE AS d FROM raster GROUP BY ALL), s AS (SELECT *, sum(d) OVER (PARTITION BY page ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM d), t AS (SELECT *, max(s) OVER (PARTITION BY page) AS top FROM s),
p AS (SELECT *, min(CASE WHEN s = top THEN col END) OVER (PARTITION BY page) AS peak, s <= 0.35::DOUBLE * top AS off FROM t WHERE top > 0), l AS (SELECT *, coalesce(max(CASE WHEN off AND col < peak THEN col END) OVER (PARTITION BY page) + 1, min(col) OVER (PARTITION BY page)) AS lo, coalesce(min(CASE WHEN off AND col > peak THEN col END) OVER (PARTITION BY page) - 1, max(col) OVER (PARTITION BY page)) AS hi FROM p)
SELECT page, lo, hi, round(sum(col * s) / sum(s), 6) AS centre FROM l WHERE col BETWEEN lo AND hi GROUP BY page, lo, hi""")
def pix14_changed_span(spark, d):
    """Each picture against itself with one letter's columns changed."""
    cells = raster(spark)
    new = cells.withColumn("v", F.when(F.col("col").between(30 + F.col("page"), 44 + F.col("page")), F.col("v") + (F.col("col") * 7 + F.col("row")) % 50).otherwise(F.col("v")))
    return P.changed_span(cells, new).withColumn("centre", F.round("centre", 6))
