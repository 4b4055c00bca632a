"""Annotated-page views over the driver tables: word tokens and word boxes with exact, engine-independent arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(documents: DataFrame, *keep: str, dealt: bool | int = False) -> DataFrame:
    """doc_id, ln, wn, tok and what to keep: words between single spaces of every line, with 0-based places; empty ones are left
    out. If dealt, texts go by page key before they become words, which are many times larger: what groups by page finds it done.
    A number deals them to that many partitions."""
    texts = documents.select("doc_id", "text", *keep)
    texts = texts.repartition(*([] if dealt is True else [dealt]), F.col("doc_id").cast("string")) if dealt else spread(texts)
    lines = texts.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.select("doc_id", *keep, "ln", F.posexplode(F.split("line", " ")).alias("wn", "tok")).where("tok <> ''")


def boxes(tok: DataFrame, *keep: str) -> DataFrame:
    """One word box for each token, with the columns of the box store."""
    d, ln, wn = F.col("doc_id"), F.col("ln"), F.col("wn")
    return tok.select(
        d.cast("string").alias("page_key"),
        F.substring(F.sha2(F.concat_ws(":", d, ln, wn), 256), 1, 10).alias("box_id"),
        (wn * 60).cast("int").alias("x"),
        (ln * 40 + (d * 7 + wn * 3) % 5).cast("int").alias("y"),
        (F.length("tok") * 10).alias("w"),
        (24 + (d + wn) % 5).cast("int").alias("h"),
        F.col("tok").alias("text"),
        ((d * 31 + ln * 17 + wn * 7) % 100 / F.lit(100.0)).alias("conf"),
        ln.cast("int").alias("line"),
        wn.cast("int").alias("word"),
        F.when((ln + wn) % 29 == 0, "manual").otherwise("detected").alias("source"),
        ((d + wn) % 13 == 0).alias("edited"),
        ((d + ln + wn) % 37 == 0).alias("deleted"),
        (ln.cast("long") * (1 << 32) + wn).alias("box_ord"),
        *keep,
    )


def crops(tok: DataFrame) -> DataFrame:
    """boxes with the ink, contrast and focus that a segmenter would measure."""
    d = F.col("page_key").cast("long")
    ln, wn = F.col("line"), F.col("word")
    return boxes(tok).withColumns({"ink": (d * 3 + ln * 5 + wn * 7) % 80 / F.lit(100.0), "contrast": ((d * 11 + ln + wn * 13) % 160).cast("double"), "focus": ((d * 17 + ln * 3 + wn * 5) % 300).cast("double")})


def detected(tok: DataFrame) -> DataFrame:
    """A second detection of the same words: shifted, some missing, some read otherwise; det_ord is its order."""
    old = boxes(tok).withColumn("doc", F.col("page_key").cast("long")).where("(doc + word) % 11 <> 0")
    return old.select("page_key", "box_id", (F.col("x") + F.col("word") % 5 - 2).alias("x"), (F.col("y") + F.col("line") % 3 - 1).alias("y"), "w", "h", F.when((F.col("line") + F.col("word")) % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), "line", "word", F.col("box_ord").alias("det_ord"))


TOK_SQL = """tok AS (SELECT doc_id, ln, wn, string_split(lines[ln + 1], ' ')[wn + 1] AS tok FROM (SELECT doc_id, ln, lines, unnest(range(len(string_split(lines[ln + 1], ' ')))) AS wn
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents)) WHERE tok <> '')"""
BOX_SQL = TOK_SQL + """, boxes AS (SELECT doc_id::VARCHAR AS page_key, substr(sha256(doc_id || ':' || ln || ':' || wn), 1, 10) AS box_id, (wn * 60)::INT AS x, (ln * 40 + (doc_id * 7 + wn * 3) % 5)::INT AS y,
  (length(tok) * 10)::INT AS w, (24 + (doc_id + wn) % 5)::INT AS h, tok AS text, ((doc_id * 31 + ln * 17 + wn * 7) % 100) / 100.0::DOUBLE AS conf, ln::INT AS line, wn::INT AS word,
  CASE WHEN (ln + wn) % 29 = 0 THEN 'manual' ELSE 'detected' END AS source, (doc_id + wn) % 13 = 0 AS edited, (doc_id + ln + wn) % 37 = 0 AS deleted, ln::BIGINT * 4294967296 + wn AS box_ord FROM tok)"""
CROP_SQL = BOX_SQL + """, crops AS (SELECT *, ((page_key::BIGINT * 3 + line * 5 + word * 7) % 80) / 100.0::DOUBLE AS ink, ((page_key::BIGINT * 11 + line + word * 13) % 160)::DOUBLE AS contrast,
  ((page_key::BIGINT * 17 + line * 3 + word * 5) % 300)::DOUBLE AS focus FROM boxes)"""
DET_SQL = BOX_SQL + """, det AS (SELECT page_key, box_id, x + word % 5 - 2 AS x, y + line % 3 - 1 AS y, w, h, CASE WHEN (line + word) % 17 = 0 THEN text || 'x' ELSE text END AS text, line, word, box_ord AS det_ord FROM boxes WHERE (page_key::BIGINT + word) % 11 <> 0)"""


def raster(spark: SparkSession) -> DataFrame:
    """page, row, col, v: twenty grey pictures of 160 x 120 with bands of dark cells, by arithmetic."""
    cell = spark.range(20 * 160 * 120).selectExpr("id div 19200 page", "cast(id div 120 % 160 as int) row", "cast(id % 120 as int) col")
    dark = "row % 40 between 8 and 22 + page % 5 and col >= page and col < 100 - page % 7 and (col * 7 + row * 3 + page * 5) % 11 < 6"
    return cell.selectExpr("page", "row", "col", f"cast(if({dark}, 20 + (row * 5 + col * 3 + page) % 60, 180 + (row * 3 + col * 7 + page * 11) % 60) as int) v")


def flow_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, word, nl, tabs, aspect, box_rank, pin: the words of each conversation as one flowing text; a turn begins a line."""
    from .stored import stored

    tok = stored(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.split("text", "[ \n]")).alias("pos", "word")).where("word <> ''"))
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("doc_id").orderBy("turn", "pos")) - 1
    new = F.row_number().over(W.partitionBy("doc_id", "turn").orderBy("pos")) == 1
    out = tok.withColumn("ord", n.cast("long")).withColumn("nl", F.when(new & (F.col("turn") > 0), 1).otherwise(0))
    return out.select("doc_id", "ord", "word", "nl", F.when(F.col("ord") % 31 == 7, 1).otherwise(0).alias("tabs"), (F.length("word") / 2.0).alias("aspect"), F.when(F.col("ord") % 8 == 3, F.col("ord") % 3).alias("box_rank"), (F.col("ord") % 23 == 11).alias("pin"))


RASTER_SQL = """raster AS (SELECT page, row, col, CASE WHEN row % 40 BETWEEN 8 AND 22 + page % 5 AND col >= page AND col < 100 - page % 7 AND (col * 7 + row * 3 + page * 5) % 11 < 6 THEN 20 + (row * 5 + col * 3 + page) % 60 ELSE 180 + (row * 3 + col * 7 + page * 11) % 60 END::INT AS v
  FROM (SELECT id // 19200 AS page, (id // 120 % 160)::INT AS row, (id % 120)::INT AS col FROM (SELECT unnest(range(384000)) AS id)))"""
FLOW_SQL = """fw AS (SELECT conv_id AS doc_id, turn, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS t FROM conversations)),
fn AS (SELECT doc_id, turn, word, row_number() OVER (PARTITION BY doc_id ORDER BY turn, pos) - 1 AS ord, row_number() OVER (PARTITION BY doc_id, turn ORDER BY pos) = 1 AS new FROM fw WHERE word <> ''),
flow AS (SELECT doc_id, ord, word, CASE WHEN new AND turn > 0 THEN 1 ELSE 0 END AS nl, CASE WHEN ord % 31 = 7 THEN 1 ELSE 0 END AS tabs, len(word) / 2.0::DOUBLE AS aspect, CASE WHEN ord % 8 = 3 THEN ord % 3 END AS box_rank, ord % 23 = 11 AS pin FROM fn)"""


def synthetic_pages(spark: SparkSession, texts: list[str], degrees: float, width: int = 1700, height: int = 2200, step: int = 90, left: int = 140, top: int = 260, letter: int = 24) -> DataFrame:
    """SRC-14: the known truth of a page of text lines photographed at a slant: line and word (from 1), text, and the corners x0, y0 to
    x3, y3 (TL, TR, BR, BL) of each word's rectangle, turned about the page's centre. Each line is off by a pixel or so, by
    its number; letters are of equal width."""
    lines = spark.createDataFrame(list(enumerate(texts, 1)), "line int, content string")
    words = lines.select("line", F.posexplode(F.split("content", " ")).alias("pos", "text"), "content")
    before = F.length(F.array_join(F.slice(F.split("content", " "), 1, F.col("pos")), " ")) + F.when(F.col("pos") > 0, 1).otherwise(0)
    x = left + (F.col("line") * 7 % 5 - 2) + before * letter
    y = top + (F.col("line") - 1) * step + F.col("line") * 3 % 5 - 2
    w, h = F.length("text") * letter, 2 * letter
    c, s = float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))
    out = {}
    for k, (px, py) in enumerate(((x, y), (x + w, y), (x + w, y + h), (x, y + h))):
        dx, dy = px - width / 2.0, py - height / 2.0
        out |= {f"x{k}": c * dx + s * dy + width / 2.0, f"y{k}": -s * dx + c * dy + height / 2.0}
    return words.select("line", (F.col("pos") + 1).alias("word"), "text", *(F.round(v, 6).alias(n) for n, v in out.items()))
