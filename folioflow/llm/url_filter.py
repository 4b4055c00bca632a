"""URL filter: listed rules first, then the ratio of two smoothed variable-order Markov models of characters.

Accepted and rejected URLs are those that the rules decide. Each class has counts of up to three characters over a fixed
alphabet (A symbols, so that no table exceeds A**3 rows however many URLs there are); a character's probability mixes the
longest context with shorter ones by Witten and Bell's weights. A URL's score is its mean log-likelihood difference per
character, and the threshold is the one with the least sum of both error rates on the URLs with a rule. DataFrame
functions only: one pass with a broadcast of the bounded table sums each URL where it was read, and one row a URL is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
#: Symbols: 0 for any other character, those of ALPHABET, and the last for what stands before the first character.
A = len(ALPHABET) + 2
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, SMALL), F.regexp_extract(text, parts, 2)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def trigrams(url: Column) -> Column:
    """Codes of every character with the two before it."""
    symbols = F.transform(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, SMALL), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    symbols = F.when(F.length(url) > 0, symbols).otherwise(F.array().cast("array<int>"))  # '' splits into one empty string
    before = F.concat(F.array(F.lit(A - 1), F.lit(A - 1)), symbols)
    return F.transform(symbols, lambda c, i: (F.get(before, i) * A + F.get(before, i + 1)) * A + c)


def _log_ratio(counts: DataFrame) -> DataFrame:
    """(t, delta): log P(accepted) - log P(rejected) of the last symbol of every code t, from counts (label, t, n)."""
    grid = counts.sparkSession.range(A**3).select(F.col("id").cast("int").alias("t"), F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("label"))
    two = counts.groupBy("label", (F.col("t") % (A * A)).alias("t2")).agg(F.sum("n").alias("n2"))
    one = two.groupBy("label", (F.col("t2") % A).alias("t1")).agg(F.sum("n2").alias("n1"))
    sums = one.groupBy("label").agg(F.sum("n1").alias("all0"), F.count("*").alias("kinds0"))
    sums2 = two.groupBy("label", F.floor(F.col("t2") / A).cast("int").alias("c2")).agg(F.sum("n2").alias("all1"), F.count("*").alias("kinds1"))
    sums3 = counts.groupBy("label", F.floor(F.col("t") / A).cast("int").alias("c3")).agg(F.sum("n").alias("all2"), F.count("*").alias("kinds2"))
    g = grid.select("t", "label", (F.col("t") % (A * A)).alias("t2"), (F.col("t") % A).alias("t1"), F.floor(F.col("t") / A).cast("int").alias("c3"), (F.floor(F.col("t") / A) % A).cast("int").alias("c2"))
    for other, on in ((counts, ["label", "t"]), (two, ["label", "t2"]), (one, ["label", "t1"]), (sums, ["label"]), (sums2, ["label", "c2"]), (sums3, ["label", "c3"])):
        g = g.join(other, on, "left")
    g = g.fillna(0)
    p = F.lit(1.0 / A)
    for n, every, kinds in (("n1", "all0", "kinds0"), ("n2", "all1", "kinds1"), ("n", "all2", "kinds2")):
        p = F.when(F.col(every) > 0, (F.col(n) + F.col(kinds) * p) / (F.col(every) + F.col(kinds))).otherwise(p)
    return g.groupBy("t").agg(F.sum(F.when(F.col("label") == "allow", F.log(p)).otherwise(-F.log(p))).alias("delta"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of every row's url.

    Host and path are empty for a null url and one without ://. A url without any character scores 0, like any url while one
    class has no example; a score of the threshold or more is allowed. Repeated rows are judged each; very long urls are
    scored whole; other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"), "url")
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    counts = rows.where("found is not null").select(F.col("found.verdict").alias("label"), F.explode(trigrams(F.col("url"))).alias("t")).groupBy("label", "t").agg(F.count("*").alias("n"))
    model = written(_log_ratio(written(counts)).where("delta <> 0"))
    # at most A**3 rows
    scored = rows.withColumn("t", F.explode_outer(trigrams(F.col("url")))).join(F.broadcast(model), "t", "left")
    scored = written(scored.groupBy("row", "page_id", "host", "path", "found").agg(F.coalesce(F.sum("delta") / F.count("*"), F.lit(0.0)).alias("score")))

    known = scored.where("found is not null").select((F.col("found.verdict") == "allow").alias("good"), F.least(F.greatest(F.floor(F.col("score") * 100), F.lit(-BINS)), F.lit(BINS)).alias("bin"))
    bins = known.groupBy("bin").agg(F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # at most 2 * BINS + 1 rows
    errors = bins.select("bin", F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"), (F.sum("bad").over(every) - F.coalesce(F.sum("bad").over(below), F.lit(0))).alias("kept"), F.sum("good").over(every).alias("goods"), F.sum("bad").over(every).alias("bads")).where("goods > 0 and bads > 0")
    best = errors.orderBy(F.col("lost") / F.col("goods") + F.col("kept") / F.col("bads"), F.abs("bin"), "bin").first()
    threshold = best.bin / 100 if best else 0.0
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
