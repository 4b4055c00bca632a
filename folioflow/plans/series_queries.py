"""Queries of numeric sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as N
from ..sources.fixtures import BOX_SQL, FLOW_SQL, RASTER_SQL, flow_words, raster, read
from .registry import query
from .review_queries import _MAN, _manifest

_PROFILE = f"{RASTER_SQL}, profile AS (SELECT page, row, sum(CASE WHEN v < 128 THEN 1 ELSE 0 END)::DOUBLE AS ink FROM raster GROUP BY page, row)"


def _profile(spark):
    return raster(spark).groupBy("page", "row").agg(F.sum(F.when(F.col("v") < 128, 1.0).otherwise(0.0)).alias("ink"))


@query(f"WITH {BOX_SQL}, {_MAN} SELECT crop_path, bbox_w FROM manifest ORDER BY bbox_w DESC, crop_path LIMIT 3")
def win6_style_refs(spark, d):
    """WIN-6: the three widest crops; the limit is the feature."""
    return _manifest(spark, d).select("crop_path", "bbox_w").orderBy(F.desc("bbox_w"), "crop_path").limit(3)


@query(f"WITH {_PROFILE}, o AS (SELECT * FROM (SELECT *, max(ink) OVER (PARTITION BY page) AS peak FROM profile) WHERE ink > greatest(3, 0.06 * peak)), g AS (SELECT *, row - row_number() OVER (PARTITION BY page ORDER BY row) AS run FROM o) SELECT page, min(row) AS y0, count(*) AS h FROM g GROUP BY page, run HAVING count(*) >= 14 AND count(*) <= 0.25 * 160")
def win7_line_islands(spark, d):
    return N.line_islands(_profile(spark), 160)


@query()
def win9_peaks(spark, d):
    """Peaks of each user's values in event order."""
    return N.group_peaks(read(spark, d, "events"), "user_id", "event_id", "value", 3, 20.0, 5.0)


@query("SELECT user_id, round_even(quantile_cont(gap, 0.5), 0)::BIGINT AS spacing FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) WHERE gap > 15 AND gap < 400 GROUP BY user_id HAVING count(*) >= 12")
def win10_gap_median(spark, d):
    """WIN-10: the median gap of each user's events where twelve or more lie within the bounds."""
    from pyspark.sql import Window as W

    gaps = read(spark, d, "events").select("user_id", (F.col("event_id") - F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))).alias("gap"))
    return gaps.where("gap > 15 and gap < 400").groupBy("user_id").agg(F.bround(F.percentile("gap", 0.5), 0).cast("long").alias("spacing"), F.count("*").alias("n")).where("n >= 12").drop("n")


@query("""WITH v AS (SELECT DISTINCT user_id, value FROM events), r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS many, value - lag(value) OVER w AS gap FROM v WINDOW w AS (PARTITION BY user_id ORDER BY value)),
b AS (SELECT *, coalesce(lag(gap) OVER w, gap) AS prev FROM r WINDOW w AS (PARTITION BY user_id ORDER BY value)), k AS (SELECT *, CASE WHEN many < 3 THEN CASE WHEN i = 0 THEN 1 ELSE 0 END WHEN coalesce(gap > 0 AND prev > 0 AND abs(gap / prev - 1) <= 0.35, false) THEN 0 ELSE 1 END AS brk FROM b),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY value) AS run FROM k), n AS (SELECT user_id, run, min(i) AS first, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, arg_max(first, (n, -first)) AS first, max(n) AS n FROM n GROUP BY user_id""")
def win11_steady_run(spark, d):
    return N.longest_steady_run(read(spark, d, "events").select("user_id", "value").distinct(), "user_id", "value")


@query("""WITH e AS (SELECT user_id, event_id, (value >= 60)::INT AS on_, row_number() OVER w - 1 AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), a AS (SELECT *, max(on_) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS wide FROM e),
c AS (SELECT * FROM (SELECT *, min(wide) OVER n AS low, count(*) OVER n AS k FROM a WINDOW n AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE low = 1 AND k = 9), r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM c),
s AS (SELECT user_id, run, min(i) AS a, max(i) AS b FROM r GROUP BY ALL) SELECT user_id, arg_max(a, (b - a, -a)) AS first, arg_max(b, (b - a, -a)) AS last FROM s GROUP BY user_id""")
def win12_longest_stretch(spark, d):
    return N.longest_stretch(read(spark, d, "events"), "user_id", "event_id", F.col("value") >= 60)


@query("""WITH t AS (SELECT user_id, value AS a, value + (event_id % 5) AS b FROM events WHERE event_id % 3 = 0), g AS (SELECT user_id, greatest(0, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a, least(a, 100) AS b FROM t)
SELECT * FROM (SELECT user_id, a, b FROM g UNION ALL SELECT user_id, greatest(0, max(b)), 100.0::DOUBLE FROM t GROUP BY user_id) WHERE b - a > 1e-6""")
def win13_free_gaps(spark, d):
    taken = read(spark, d, "events").where("event_id % 3 = 0").select("user_id", F.col("value").alias("a"), (F.col("value") + F.col("event_id") % 5).alias("b"))
    return N.free_gaps(taken, "user_id", 0.0, 100.0)


@query(f"WITH {FLOW_SQL}, g AS (SELECT *, (doc_id + ord * ord) % 4 = 0 AS gone FROM flow), p AS (SELECT *, sum((NOT gone)::INT) OVER (PARTITION BY doc_id ORDER BY ord) - (NOT gone)::INT AS part FROM g) SELECT doc_id, ord, word, (sum(nl) OVER (PARTITION BY doc_id, part))::BIGINT AS nl FROM p QUALIFY NOT gone")
def win14_carried_breaks(spark, d):
    words = flow_words(spark, d).select("doc_id", "ord", "word", F.col("nl").cast("long").alias("nl"))
    return N.carried_breaks(words, "doc_id", (F.col("doc_id") + F.col("ord") * F.col("ord")) % 4 == 0)


@query(f"""WITH {FLOW_SQL}, l AS (SELECT doc_id, ord, word, nl, CASE WHEN ord % 9 <> 0 THEN ord // 7 END AS line, ord % 3 = 1 AND ord > 5 AS chosen FROM flow), b AS (SELECT *, last_value(line IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, min(CASE WHEN chosen THEN ord END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN chosen THEN ord END) OVER (PARTITION BY doc_id) AS hi FROM l)
SELECT doc_id, ord, CASE WHEN coalesce(line IS NOT NULL AND line <> prev AND ord BETWEEN lo AND hi AND nl = 0, false) THEN 1 ELSE nl END AS nl FROM b""")
def win15_hardened_breaks(spark, d):
    words = flow_words(spark, d).select("doc_id", "ord", "nl", F.when(F.col("ord") % 9 != 0, F.floor(F.col("ord") / 7)).alias("line"))
    return N.hardened_breaks(words, "doc_id", (F.col("ord") % 3 == 1) & (F.col("ord") > 5)).select("doc_id", "ord", "nl")


@query(f"WITH {FLOW_SQL} SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(box_rank + 1, 0), ord) - 1 AS ord FROM flow")
def win16_renumbered(spark, d):
    return N.renumbered(flow_words(spark, d), "doc_id").select("doc_id", "word", "ord")


@query(f"""WITH {_PROFILE}, s AS (SELECT page, row, round((lag(ink, 2, 0) OVER w + 2 * lag(ink, 1, 0) OVER w + 3 * ink + 2 * lead(ink, 1, 0) OVER w + lead(ink, 2, 0) OVER w) / 9.0, 9) AS s FROM profile WINDOW w AS (PARTITION BY page ORDER BY row)),
n AS (SELECT *, lead(s) OVER (PARTITION BY page ORDER BY row) AS next, max(s) OVER (PARTITION BY page) AS most FROM s), d AS (SELECT *, round(next - s, 9) AS d FROM n WHERE next IS NOT NULL),
f AS (SELECT *, min(d) OVER (PARTITION BY page) AS least, lag(d) OVER (PARTITION BY page ORDER BY row) AS a, lead(d) OVER (PARTITION BY page ORDER BY row) AS b FROM d)
SELECT page, coalesce(min(row) FILTER (WHERE d < a AND d <= b AND d <= 0.6 * least AND next <= 0.65 * most), arg_min(row, (d, row))) + 1 AS foot FROM f GROUP BY page""")
def win18_foot_of_letters(spark, d):
    return N.foot_of_letters(_profile(spark))


@query(f"""WITH {_PROFILE}, x AS (SELECT page, row, ink - avg(ink) OVER (PARTITION BY page) AS x FROM profile), ac AS (SELECT a.page, b.row - a.row AS lag, round(sum(a.x * b.x), 6) AS ac FROM x a JOIN x b ON a.page = b.page AND b.row - a.row BETWEEN 19 AND 159 GROUP BY ALL),
p AS (SELECT *, lag(ac) OVER w AS a, lead(ac) OVER w AS b FROM ac WINDOW w AS (PARTITION BY page ORDER BY lag)) SELECT page, arg_max(lag, (ac, -lag)) AS lag FROM p WHERE ac > a AND ac > b AND lag > 20 GROUP BY page""")
def win19_autocorrelation(spark, d):
    return N.autocorrelation(_profile(spark))


@query()
def jon17_win17_followed_peaks(spark, d):
    """Twenty slabs a page of peaks on slightly bent rules, some missing, some astray."""
    base = spark.range(20 * 20 * 12).selectExpr("id div 240 page", "id div 12 % 20 slab", "id % 12 rule")
    rows = base.where("(page * 7 + slab * 3 + rule * 5) % 17 <> 0").selectExpr("page", "slab", "slab * 50.0 x", "rule * 40.0 + slab * 0.8 * page / 10 + pow(slab - 10, 2) * 0.05 + (page * 3 + slab * 5 + rule * 11) % 5 + if((page + slab + rule) % 23 = 0, 15, 0) y")
    return N.followed(rows, 40.0)
