"""Queries beyond the survey's parity: approximate counts, streams, and operators from SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from ..sources.fixtures import read
from ..streaming import events as E
from .registry import query


@query("SELECT event_type, approx AS users_ok, median_ok FROM (SELECT event_type, true AS approx, true AS median_ok FROM events GROUP BY event_type)")
def ext_approx(spark, d):
    """Whether approximate counts and percentiles lie within 5 % of the exact ones, by event type."""
    e = read(spark, d, "events")
    near = lambda a, b: F.abs(a - b) <= 0.05 * b + 1
    g = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("a"), F.percentile_approx("value", 0.5, 10000).alias("m"), F.countDistinct("user_id").alias("b"), F.percentile("value", 0.5).alias("p"))
    return g.select("event_type", near(F.col("a"), F.col("b")).alias("users_ok"), near(F.col("m"), F.col("p")).alias("median_ok"))


@query("WITH b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM b), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, s) SELECT user_id, start, n FROM g WHERE stop <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def ext_stream_sessions(spark, d):
    return E.closed_sessions(spark, d)


@query("SELECT event_id FROM events")
def ext_stream_dedup(spark, d):
    return E.first_arrivals(spark, d)


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY user_id")
def ext_stream_state(spark, d):
    return E.running_totals(spark, d)


@query("SELECT DISTINCT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ext_review_sink(spark, d):
    return E.reviewed_once(spark, d)


@query("SELECT role, count(*) AS words, sum(len(word))::BIGINT AS chars FROM (SELECT role, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY role")
def ext_sql_surface(spark, d):
    """Operators called from SQL text: a view, a registered table function of words, and a registered similarity."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ord int, word string")
    class Words:
        """The words of a text with their places."""

        def eval(self, text: str):
            for n, w in enumerate((text or "").split()):
                yield n, w

    spark.udtf.register("flow_words", Words)
    spark.udf.register("likeness", S.likeness, "double")
    read(spark, d, "conversations").createOrReplaceTempView("turns")
    return spark.sql("SELECT role, count(*) AS words, cast(sum(length(word)) AS bigint) AS chars FROM turns, LATERAL flow_words(text) WHERE likeness(word, word) >= 0 GROUP BY role")
