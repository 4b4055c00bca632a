"""Queries of sheets: mapping, checks and fits."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import sheets as G
from ..sources.fixtures import read
from ..sources.stored import stored
from .registry import query

#: Three sheets: upright, turned and bowed, in perspective.
_SHEETS = (
    (0, (14.0, 0.0, 14.0, 0.0, 14.0, 14.0, 0.0, 0.0, 1.0), 0.0, 0.0, 0.0, 28.0, 1, 26, 1200, 1600),
    (1, (13.0, -1.5, 13.0, 1.5, 13.0, 12.0, 0.0, 0.0, 1.0), 0.4, -0.2, 1.0, 24.0, 0, 24, 1200, 1600),
    (2, (12.0, 0.5, 11.0, 0.25, 13.5, 13.0, 0.05, 0.11, 1.0), 0.3, 0.1, 0.5, 22.0, 2, 22, 1600, 1200),
)
_SHEET_SQL = "sheets AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{v}" if isinstance(v, int) else f"{v}::DOUBLE" for v in (p, *m, *rest)) + ")" for p, m, *rest in _SHEETS) + ") AS t(page, " + ", ".join(G.M) + ", c1, c2, u_left, u_right, i_first, n_lines, img_w, img_h))"
_POINT_SQL = "points AS (SELECT event_id, event_id % 3 AS page, (event_id * 37 % 1200)::DOUBLE AS x, (event_id * 91 % 1200)::DOUBLE AS y FROM events)"


def _t(u):
    return f"greatest(-0.25, least(1.25, ({u} - u_left) / (u_right - u_left)))"


def _bow_sql(u):
    return f"(c1 * {_t(u)} * (1 - {_t(u)}) + c2 * {_t(u)} * (1 - {_t(u)}) * (2 * {_t(u)} - 1))"


_NORM = "(x - img_w / 2.0::DOUBLE) * (2.0::DOUBLE / greatest(img_w, img_h)) AS xn, (y - img_h / 2.0::DOUBLE) * (2.0::DOUBLE / greatest(img_w, img_h)) AS yn"
_UV = f"uv AS (SELECT *, (m3 * xn + m4 * yn + m5) / w + {_bow_sql('u')} AS v FROM (SELECT *, (m0 * xn + m1 * yn + m2) / w AS u FROM (SELECT *, m6 * xn + m7 * yn + m8 AS w FROM (SELECT p.*, s.* EXCLUDE (page), {_NORM} FROM points p JOIN sheets s ON s.page = p.page))))"


def _xy(line: str, u: str, x: str, y: str) -> tuple[str, str]:
    """SQL of the pixel at (line, u): the three rows of the inverse matrix over the determinant."""
    det = "(m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6))"
    v = f"(({line}) - {_bow_sql(u)})"
    p = f"(((m4 * m8 - m5 * m7) * {u} + (m2 * m7 - m1 * m8) * {v} + (m1 * m5 - m2 * m4)) / {det})"
    q = f"(((m5 * m6 - m3 * m8) * {u} + (m0 * m8 - m2 * m6) * {v} + (m2 * m3 - m0 * m5)) / {det})"
    r = f"(((m3 * m7 - m4 * m6) * {u} + (m1 * m6 - m0 * m7) * {v} + (m0 * m4 - m1 * m3)) / {det})"
    s = "(2.0::DOUBLE / greatest(img_w, img_h))"
    return f"({p} / {r} / {s} + img_w / 2.0::DOUBLE) AS {x}", f"({q} / {r} / {s} + img_h / 2.0::DOUBLE) AS {y}"


def _sheets(spark):
    rows = [(p, *m, *rest) for p, m, *rest in _SHEETS]
    return spark.createDataFrame(rows, "page long, " + ", ".join(f"{m} double" for m in G.M) + ", c1 double, c2 double, u_left double, u_right double, i_first int, n_lines int, img_w int, img_h int")


def _points(spark, d):
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", (e % 3).alias("page"), (e * 37 % 1200).cast("double").alias("x"), (e * 91 % 1200).cast("double").alias("y"))


@query(f"WITH {_SHEET_SQL}, {_POINT_SQL} SELECT event_id, round(xn, 9) AS xn, round(yn, 9) AS yn FROM (SELECT event_id, {_NORM} FROM points JOIN sheets USING (page))")
def geo3_normalised(spark, d):
    x, y = G.normalised(F.col("x"), F.col("y"))
    return _points(spark, d).join(_sheets(spark), "page").select("event_id", F.round(x, 9).alias("xn"), F.round(y, 9).alias("yn"))


@query(f"WITH {_SHEET_SQL}, {_POINT_SQL}, {_UV} SELECT event_id, round(u, 6) AS u, round(v, 6) AS v FROM uv")
def geo4_to_page(spark, d):
    u, v = G.to_page(F.col("x"), F.col("y"))
    return _points(spark, d).join(_sheets(spark), "page").select("event_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query(f"WITH {_SHEET_SQL}, {_POINT_SQL}, q AS (SELECT event_id, {', '.join(_xy('x / 50', 'y / 50', 'px', 'py'))} FROM points JOIN sheets USING (page)) SELECT event_id, round(px, 4) AS px, round(py, 4) AS py FROM q")
def geo5_to_image(spark, d):
    out = G.to_image(_points(spark, d).join(_sheets(spark), "page"), F.col("x") / 50, F.col("y") / 50, "px", "py")
    return out.select("event_id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query(f"""WITH {_SHEET_SQL}, l AS (SELECT *, unnest(range(i_first, i_first + n_lines)) AS line, (u_left + u_right) / 2 AS u FROM sheets), q AS (SELECT page, line, {', '.join(_xy('line', 'u', 'x0', 'y0'))}, {', '.join(_xy('line + 1', 'u', 'x1', 'y1'))}, {', '.join(_xy('line', '(u - 0.05)', 'xa', 'ya'))}, {', '.join(_xy('line', '(u + 0.05)', 'xb', 'yb'))} FROM l)
SELECT page, line, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 4) AS spacing, round(degrees(atan2(yb - ya, xb - xa)), 4) AS tangent FROM q""")
def geo6_spacing_tangent(spark, d):
    s = _sheets(spark).withColumn("line", F.explode(F.sequence(F.col("i_first"), F.col("i_first") + F.col("n_lines") - 1))).withColumn("line", F.col("line").cast("long"))
    line, u = F.col("line").cast("double"), (F.col("u_left") + F.col("u_right")) / 2
    out = G.with_tangent(G.with_spacing(s, line, u), line, u)
    return out.select("page", "line", F.round("spacing", 4).alias("spacing"), F.round("tangent", 4).alias("tangent"))


@query(f"WITH {_SHEET_SQL}, l AS (SELECT *, unnest(range(i_first, i_first + n_lines)) AS line FROM sheets), k AS (SELECT *, unnest(range(24)) AS k FROM l), v AS (SELECT *, u_left + (u_right - u_left) * k / 23 AS u FROM k), q AS (SELECT page, line, k, {', '.join(_xy('line', 'u', 'x', 'y'))} FROM v) SELECT page, line, k, round(x, 4) AS x, round(y, 4) AS y FROM q")
def geo6_polylines(spark, d):
    lines = G.polylines(_sheets(spark))
    return lines.select("page", F.col("line").cast("long").alias("line"), F.col("k").cast("long").alias("k"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {_SHEET_SQL}, {_POINT_SQL}, moved AS (SELECT * REPLACE (m0 + 2.5 * m6 AS m0, m1 + 2.5 * m7 AS m1, m2 + 2.5 * m8 AS m2, u_left + 2.5 AS u_left, u_right + 2.5 AS u_right) FROM sheets), {_UV.replace('JOIN sheets s', 'JOIN moved s')} SELECT event_id, round(u, 6) AS u, round(v, 6) AS v FROM uv")
def geo6_shifted_u(spark, d):
    u, v = G.to_page(F.col("x"), F.col("y"))
    return _points(spark, d).join(G.shifted(_sheets(spark), F.lit(2.5)), "page").select("event_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


_QUADS = "quads AS (SELECT p_partkey AS page, (p_size % 5)::DOUBLE AS u0, (p_size % 7) / 2.0::DOUBLE AS v0, (20 + p_size % 3)::DOUBLE AS u1, (p_size % 4)::DOUBLE AS v1, (21 + p_size % 6)::DOUBLE AS u2, (9 + p_size % 5) * 1.5::DOUBLE AS v2, (p_size % 2)::DOUBLE AS u3, (12 + p_size % 8)::DOUBLE AS v3 FROM part)"


def _quads(spark, d):
    s = F.col("p_size")
    columns = {"u0": (s % 5).cast("double"), "v0": (s % 7) / 2.0, "u1": (20 + s % 3).cast("double"), "v1": (s % 4).cast("double"), "u2": (21 + s % 6).cast("double"), "v2": (9 + s % 5) * 1.5, "u3": (s % 2).cast("double"), "v3": (12 + s % 8).cast("double")}
    return read(spark, d, "part").select(F.col("p_partkey").alias("page"), *(c.alias(n) for n, c in columns.items()))


@query(f"""WITH {_QUADS}, l AS (SELECT *, unnest(range((floor(least(v0, v1, v2, v3)) - 1)::BIGINT, (ceil(greatest(v0, v1, v2, v3)) + 2)::BIGINT)) AS line FROM quads), t AS (SELECT *, (line - v0) / (v3 - v0) AS tl, (line - v1) / (v2 - v1) AS tr FROM l),
k AS (SELECT *, u0 + (u3 - u0) * greatest(0, least(1, tl)) AS a, u1 + (u2 - u1) * greatest(0, least(1, tr)) AS b FROM t WHERE tl BETWEEN -1e-9 AND 1 + 1e-9 AND tr BETWEEN -1e-9 AND 1 + 1e-9)
SELECT page, line, round(least(a, b), 6) AS lo, round(greatest(a, b), 6) AS hi, min(line) OVER (PARTITION BY page) AS i_first, count(*) OVER (PARTITION BY page) AS n_lines FROM k""")
def geo7_lines_in_quad(spark, d):
    out = G.crop_lines(_quads(spark, d))
    return out.select("page", F.col("line").cast("long").alias("line"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.col("i_first").cast("long").alias("i_first"), "n_lines")


@query()
def geo8_four_corners(spark, d):
    """The homography from each part's quad to a letter page of 30 lines, row by row."""

    def solve(batches):
        for batch in batches:
            rows = batch.to_pylist()
            target = np.array([[0.0, 0.0], [30 * 8.5 / 11, 0.0], [30 * 8.5 / 11, 30.0], [0.0, 30.0]])
            found = [G.four_corners(np.array([[r[f"u{k}"], r[f"v{k}"]] for k in range(4)]), target) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in range(9))], names=["page", *G.M])

    return _quads(spark, d).mapInArrow(solve, "page long, " + ", ".join(f"{m} double" for m in G.M))


def _observations(spark):
    """Where the lines of the three sheets run, with a slight deterministic error and some astray."""
    lines = G.polylines(_sheets(spark), 30)
    n = F.col("line") * 7 + F.col("k") * 3 + F.col("page")
    astray = F.when(n % 19 == 0, 25.0).otherwise(0.0)
    return lines.select("page", "x", (F.col("y") + (n % 5 - 2) * 0.3 + astray).alias("y"), F.col("line").cast("double").alias("line_idx"))


@query()
def geo9_fitted_sheets(spark, d):
    return G.fitted_sheets(_observations(spark), 1200, 1600)


@query()
def geo10_better_sheets(spark, d):
    old = _sheets(spark)
    new = G.fitted_sheets(_observations(spark), 1200, 1600).drop("inliers").withColumn("img_w", F.lit(1200)).withColumn("img_h", F.lit(1600))
    return G.better_sheets(old.where("page < 2"), stored(new), _observations(spark).where("page < 2"))


_OBS = f"""l AS (SELECT *, unnest(range(i_first, i_first + n_lines)) AS line FROM sheets), k AS (SELECT *, unnest(range(30)) AS k FROM l), v AS (SELECT *, u_left + (u_right - u_left) * k / 29 AS u FROM k), q AS (SELECT page, line, k, {', '.join(_xy('line', 'u', 'x', 'y'))} FROM v),
points AS (SELECT page, x, y + ((line * 7 + k * 3 + page) % 5 - 2) * 0.3 + CASE WHEN (line * 7 + k * 3 + page) % 19 = 0 THEN 25.0 ELSE 0.0 END AS y, line AS line_idx, k FROM q)"""
_RESIDUAL = f"""{_OBS}, {_UV}, r AS (SELECT page, line_idx, k, abs(v - line_idx) * sp AS residual FROM uv JOIN (SELECT page, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS sp FROM (SELECT page, {', '.join(_xy('mid', 'mu', 'x0', 'y0'))}, {', '.join(_xy('mid + 1', 'mu', 'x1', 'y1'))} FROM (SELECT *, i_first + n_lines / 2.0::DOUBLE AS mid, (u_left + u_right) / 2 AS mu FROM sheets))) USING (page))"""


@query(f"WITH {_SHEET_SQL}, {_RESIDUAL} SELECT page, round(avg(residual), 2) AS resid_mean, round(max(residual), 2) AS resid_max FROM r GROUP BY page")
def geo11_agg15_residuals(spark, d):
    return G.fit_summary(G.residuals(_observations(spark), _sheets(spark)))


@query(f"WITH {_SHEET_SQL}, {_RESIDUAL}, m AS (SELECT page, quantile_cont(residual, 0.5) AS m FROM r GROUP BY page) SELECT page, count(*) AS n FROM r JOIN m USING (page) WHERE residual < 3.0 * greatest(1.4826 * m, 1e-4) GROUP BY page")
def flt18_inliers(spark, d):
    return G.inliers(G.residuals(_observations(spark), _sheets(spark)), "page", "residual").groupBy("page").agg(F.count("*").alias("n"))


_CORNERS = "q AS (SELECT p_partkey, (p_size * 3 % 50)::DOUBLE AS x0, (p_size * 5 % 40)::DOUBLE AS y0, (60 + p_size * 7 % 90)::DOUBLE AS x1, (p_size * 11 % 45)::DOUBLE AS y1, (p_size * 13 % 120)::DOUBLE AS x2, (p_size * 17 % 100)::DOUBLE AS y2, (p_size * 19 % 60)::DOUBLE AS x3, (p_size * 23 % 110)::DOUBLE AS y3 FROM part)"


@query(f"""WITH {_CORNERS}, t AS (SELECT *, (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) AS a, (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) AS b, (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3) AS c, (x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0) AS e, (x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2.0 AS area FROM q)
SELECT p_partkey, NOT (least(a, b, c, e) <= 0 AND greatest(a, b, c, e) > 0) AND greatest(a, b, c, e) > 0 AND area > 0 AND area BETWEEN 4.0 AND 0.25 * 200 * 200 AS ok FROM t""")
def flt17_quad_ok(spark, d):
    s = F.col("p_size")
    xs = [(s * 3 % 50).cast("double"), (60 + s * 7 % 90).cast("double"), (s * 13 % 120).cast("double"), (s * 19 % 60).cast("double")]
    ys = [(s * k % m).cast("double") for k, m in ((5, 40), (11, 45), (17, 100), (23, 110))]
    return read(spark, d, "part").select("p_partkey", G.quad_ok(xs, ys, F.lit(200), F.lit(200)).alias("ok"))


_POLY = [(100.0, 100.0), (900.0, 200.0), (700.0, 700.0), (500.0, 400.0), (200.0, 900.0)]


@query(f"""WITH {_POINT_SQL}, e AS (SELECT * FROM (VALUES {', '.join(f'({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)' for (ax, ay), (bx, by) in zip(_POLY, _POLY[1:] + _POLY[:1]))}) AS t(ax, ay, bx, "by")),
i AS (SELECT event_id, page, sum(CASE WHEN ay <> "by" AND y >= least(ay, "by") AND y < greatest(ay, "by") AND x < ax + (y - ay) * ((bx - ax) / ("by" - ay)) THEN 1 ELSE 0 END) % 2 = 1 OR bool_or((bx - ax) * (y - ay) - ("by" - ay) * (x - ax) = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, "by") AND greatest(ay, "by")) AS inside FROM points, e GROUP BY event_id, page, x, y)
SELECT event_id FROM (SELECT *, sum(inside::INT) OVER (PARTITION BY page) AS n FROM i) WHERE inside OR n < 30""")
def flt19_points_in_polygon(spark, d):
    return G.kept_observations(_points(spark, d), _POLY).select("event_id")


@query("""WITH o AS (SELECT user_id AS page, (value * 7) % 11 - 5 AS off, 40 + user_id % 9 * 1.0::DOUBLE AS sp, event_id % 10 / 10.0::DOUBLE AS conf FROM events), g AS (SELECT page, quantile_cont(abs(off), 0.5) AS m, avg((abs(off) <= greatest(4.0, 0.06 * sp))::INT) AS w, avg((conf < 0.35)::INT) AS weak, max(sp) AS sp FROM o GROUP BY page HAVING count(*) >= 20)
SELECT page, round(m, 1) AS median_px, round(w, 3) AS within, round(weak, 3) AS weak_frac, round(w, 3) < 0.45 OR round(m, 1) > round(sp, 1) * 0.12 AS poor FROM g""")
def agg14_fit_verdict(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("user_id").alias("page"), ((F.col("value") * 7) % 11 - 5).alias("offset"), (40 + F.col("user_id") % 9).cast("double").alias("spacing"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    return G.alignment_verdict(rows)


@query("SELECT user_id AS page, min(value) AS lo, max(value) AS hi FROM (SELECT user_id, value, event_id % 97 AS r, max(event_id % 97) OVER (PARTITION BY user_id) AS most FROM events) WHERE r > most * 0.25 GROUP BY user_id")
def geo13_extent(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("page"), F.col("value").alias("u"), (F.col("event_id") % 97).alias("response"))
    return G.extent(e)


_RESP = "r AS (SELECT page, line, (100 + page * 7 % 13 - CASE WHEN line < 0 THEN (-line) * (page % 9 + 4) * 3 WHEN line >= 20 THEN (line - 19) * (page % 7 + 5) * 2 ELSE line * 3 % 17 END)::DOUBLE AS response FROM (SELECT unnest(range(60)) AS page), (SELECT unnest(range(-8, 28)) AS line))"


@query(f"WITH {_RESP}, b AS (SELECT page, quantile_cont(response, 0.5) * 0.35 AS bar FROM r WHERE line BETWEEN 0 AND 19 GROUP BY page), s AS (SELECT page, CASE WHEN line < 0 THEN -line ELSE line - 19 END AS step, line < 0 AS up, response >= bar AS ok FROM r JOIN b USING (page) WHERE line < 0 OR line > 19) SELECT page, coalesce(min(step) FILTER (WHERE up AND NOT ok), 9) - 1 AS up, coalesce(min(step) FILTER (WHERE NOT up AND NOT ok), 9) - 1 AS down FROM s GROUP BY page")
def geo14_grown_lines(spark, d):
    cells = spark.range(60 * 36).selectExpr("id div 36 page", "id % 36 - 8 line")
    rows = cells.selectExpr("page", "line", "cast(100 + page * 7 % 13 - case when line < 0 then (-line) * (page % 9 + 4) * 3 when line >= 20 then (line - 19) * (page % 7 + 5) * 2 else line * 3 % 17 end as double) response", "0 i_first", "20 n_lines")
    return G.grown_lines(rows)


@query("WITH s AS (SELECT page, half, ((page * 5 + half * 7) % 23 + CASE WHEN half % 2 = 0 THEN 15 + page % 4 ELSE 0 END)::DOUBLE AS r FROM (SELECT unnest(range(40)) AS page), (SELECT unnest(range(-1, 62)) AS half)), a AS (SELECT page, half // 2 AS line, r - 0.5 * (lag(r) OVER w + lead(r) OVER w) AS a, half FROM s WINDOW w AS (PARTITION BY page ORDER BY half)), m AS (SELECT page, coalesce(quantile_cont(a, 0.5) FILTER (WHERE a > 0), 1.0) AS m FROM a WHERE half % 2 = 0 AND a IS NOT NULL GROUP BY page) SELECT page, line, round(greatest(0.0, least(1.5, a / m)), 6) AS confidence FROM a JOIN m USING (page) WHERE half % 2 = 0 AND a IS NOT NULL")
def geo15_line_confidence(spark, d):
    rows = spark.range(40 * 63).selectExpr("id div 63 page", "id % 63 - 1 half").selectExpr("page", "half", "cast((page * 5 + half * 7) % 23 + if(half % 2 = 0, 15 + page % 4, 0) as double) response")
    return G.line_confidence(rows).withColumn("confidence", F.round("confidence", 6))


def _robust_sql(rounds: int = 5) -> str:
    out = "p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS i, value FROM events), q AS (SELECT user_id, i, 3 * i + value + CASE WHEN i % 11 = 0 THEN 300 ELSE 0 END AS v FROM p), f0 AS (SELECT user_id, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM q GROUP BY user_id)"
    for n in range(1, rounds + 1):
        out += f", r{n} AS (SELECT q.*, abs(v - a * i - b) AS r FROM q JOIN f{n - 1} USING (user_id)), m{n} AS (SELECT user_id, greatest(2 * quantile_cont(r, 0.5), 20) AS lim FROM r{n} GROUP BY user_id), g{n} AS (SELECT user_id, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM r{n} JOIN m{n} USING (user_id) WHERE r < lim GROUP BY user_id HAVING count(*) >= 4), f{n} AS (SELECT f.user_id, coalesce(g.a, f.a) AS a, coalesce(g.b, f.b) AS b FROM f{n - 1} f LEFT JOIN g{n} g USING (user_id))"
    return out


@query(f"WITH {_robust_sql()} SELECT user_id, round(a, 6) AS a, round(b, 4) AS b FROM f5")
def geo16_robust_lines(spark, d):
    i = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("double")
    p = read(spark, d, "events").select("user_id", i.alias("i"), "value")
    p = stored(p.select("user_id", "i", (3 * F.col("i") + F.col("value") + F.when(F.col("i") % 11 == 0, 300).otherwise(0)).alias("v")))
    return G.robust_lines(p, "user_id").select("user_id", F.round("a", 6).alias("a"), F.round("b", 4).alias("b"))


@query()
def geo17_rule_polynomials(spark, d):
    points = spark.range(10 * 12 * 20).selectExpr("id div 240 page", "id div 20 % 12 rule", "id % 20 k").where("rule <> 11 or k < 4")
    rows = points.selectExpr("page", "rule", "k * 50.0 x", "rule * 40 + 0.001 * page * pow(k * 50 - 400, 2) / 100 + 0.05 * k * 50 + (k * 7 + rule) % 3 - 1 y")
    return G.rule_polynomials(rows).select("page", "rule", F.round("a", 9).alias("a"), F.round("b", 6).alias("b"), F.round("c", 4).alias("c"))


@query("WITH c AS (SELECT user_id AS page, value AS x, event_id % 37 AS prominence, 20.0 + user_id % 5 AS x_min, 95.0 AS x_max FROM events) SELECT page, arg_max(x, (prominence, -x)) AS x FROM c WHERE x BETWEEN x_min - 0.10 * (x_max - x_min) AND x_min + 0.35 * (x_max - x_min) GROUP BY page")
def geo18_margin_choice(spark, d):
    u = F.col("user_id")
    return G.margin_choice(read(spark, d, "events").select(u.alias("page"), F.col("value").alias("x"), (F.col("event_id") % 37).alias("prominence"), (F.lit(Decimal("20.0")) + u % 5).alias("x_min"), F.lit(Decimal("95.0")).alias("x_max")))


@query(f"WITH {_POINT_SQL} SELECT event_id, round(cos(radians(7)) * (x - 600) - sin(radians(7)) * (y - 800) + 600, 6) AS x, round(sin(radians(7)) * (x - 600) + cos(radians(7)) * (y - 800) + 800, 6) AS y FROM points")
def geo21_rotated_back(spark, d):
    out = G.rotated_back(_points(spark, d), 7.0, 600.0, 800.0)
    return out.select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
