"""Files that the tables come from and go to: listings, CSV, page documents, dictionaries, and writes that never leave half a table.

Schemas are stated, never inferred. Every write goes through Spark's writers and the file system that the path names, so that
any store serves; a reader sees a table as it was or as it will be.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import stored

#: Short words that dictionaries often leave out, which count as known.
BUILT_IN = (
    "a i an as at be by do go he if in is it me my no of on or so to up us we "
    "the and but for not you all can her was one our out has had his how its who did get him "
    "she too use way why new now old see two may are were been have this that with they から "
    "will from them than then when what your into also more most must such some each very over om"
).split()
#: Codes in a block of a packed file.
BLOCK = 1 << 16
BOX = "id string, x int, y int, w int, h int, text string, conf double, line int, word int, source string, edited boolean, deleted boolean"


def listed(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> DataFrame:
    """SRC-1: name of every file of a folder with one of these endings, in any case. Contents aren't read."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    files = spark.read.format("binaryFile").load(folder).select(name.alias("name"))
    return files.where(F.lower(F.regexp_extract("name", r"\.([^.]*)\z", 1)).isin(*endings))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SRC-3: rows of a CSV table with a header, all columns as strings; quoted fields may hold line ends, '' is a value."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """SNK-2: df as CSV with a header, its files in the order of these columns."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def page_documents(boxes: DataFrame) -> DataFrame:
    """One document a page: page_key and its boxes, in stored order."""
    one = F.struct("box_ord", F.col("box_id").alias("id"), *(F.col(c.split(" ")[0]) for c in BOX.split(", ")[1:]))
    kept = F.transform(F.array_sort(F.collect_list(one)), lambda b: b.dropFields("box_ord"))
    return boxes.groupBy("page_key").agg(kept.alias("boxes"))


def read_page_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: one row for each box of the JSON documents below path, fields that a document lacks as null. Pages without a
    document have no row: a left join from the pages shows them as missing."""
    docs = spark.read.schema(f"page_key string, boxes array<struct<{', '.join(f.replace(' ', ':', 1) for f in BOX.split(', '))}>>").json(path)
    return docs.select("page_key", F.inline("boxes")).withColumnRenamed("id", "box_id")


def with_documents(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """SRC-4: pages (page_key) left joined with the boxes of the documents below path. Only keys move: the boxes of documents that
    stand for one page each, as all should, stay where they are read; others are joined."""
    keys = spark.read.schema("page_key string").json(path).groupBy("page_key").agg(F.lit(1).alias("held"))
    both = pages.groupBy("page_key").agg(F.count("*").alias("n")).join(keys, "page_key", "full")
    odd = stored(both.select("page_key", F.coalesce("n", F.lit(0)).alias("n"), F.col("held").isNotNull().alias("held")).where("n <> 1 or not held"))
    boxes = read_page_documents(spark, path)
    again = odd.where("held and n > 1").select("page_key", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("page_key")
    missing = odd.where("not held").select("page_key", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("page_key")
    single = boxes.join(odd.where("held").select("page_key"), "page_key", "left_anti")
    return single.unionByName(again.join(boxes, "page_key")).unionByName(missing, allowMissingColumns=True)


def code_blocks(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """block, codes: the labels of rows (page_key, t, lb_seek, lb_len) as one array of codes, one byte each as all are ASCII, written in
    blocks of BLOCK codes."""
    labels = F.array_sort(F.collect_list(F.struct("lb_seek", "t")))
    chunks = rows.groupBy("page_key").agg(F.min("lb_seek").alias("first"), F.array_join(F.transform(labels, lambda s: s["t"]), "").cast("binary").alias("codes"))
    last = F.col("first") + F.length("codes") - 1
    pieces = chunks.select("first", "codes", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))).alias("block"))
    low = F.greatest(F.col("first"), F.col("block") * BLOCK)
    piece = F.substr("codes", (low - F.col("first") + 1).cast("int"), F.least(F.lit(BLOCK), (F.col("block") + 1) * BLOCK - low).cast("int"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct(low.alias("low"), piece.cast("string").alias("piece")))), lambda s: s["piece"])
    blocks = pieces.groupBy("block").agg(F.array_join(whole, "").cast("binary").alias("codes"))
    blocks.write.parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def read_back(rows: DataFrame, starts: DataFrame, blocks: DataFrame) -> DataFrame:
    """ARR-2: image_path, decoded, same of rows (image_path, page_key, t, lb_seek, lb_len): the codes from each row's offset on, and
    whether they spell what was packed. A row whose codes are missing has null. starts: page_key, start, end of a page's codes."""
    wanted = starts.withColumnRenamed("start", "first").select("page_key", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block"))
    low = F.greatest(F.col("first"), F.col("block") * BLOCK)
    part = F.substr("codes", (low - F.col("block") * BLOCK + 1).cast("int"), (F.least(F.col("end"), (F.col("block") + 1) * BLOCK) - low).cast("int"))
    parts = wanted.join(blocks, "block").select("page_key", "first", low.alias("low"), part.cast("string").alias("part"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("low", "part"))), lambda s: s["part"])
    pages = parts.groupBy("page_key").agg(F.min("first").alias("_first"), F.array_join(found, "").cast("binary").alias("_codes"))
    at = (F.col("lb_seek") - F.col("_first") + 1).cast("int")
    out = rows.join(pages, "page_key", "left").withColumn("decoded", F.substr("_codes", at, F.col("lb_len").cast("int")).cast("string"))
    return out.select("image_path", "decoded", F.col("decoded").eqNullSafe(F.col("t")).alias("same"))


def rotation(document: Column, name: Column) -> Column:
    """SRC-5: the degrees that a JSON map has for a scan, 0 if it has none or can't be read."""
    return F.coalesce(F.element_at(F.from_json(document, "map<string,int>"), name), F.lit(0))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6, SET-1: the words of a text file, one a line, lower-cased, blanks dropped, with the built-in ones."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''")
    return words.union(spark.createDataFrame([(w,) for w in BUILT_IN], "word string")).distinct()


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def published(df: DataFrame, path: str) -> DataFrame:
    """SNK-1: df as the Parquet table at path, written beside it and renamed once whole. The table before it stays until then."""
    spark = df.sparkSession
    staging, aside = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(staging)
    fs, target = _system(spark, path)
    new, old = (_system(spark, p)[1] for p in (staging, aside))
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"could not publish {path}")
    if had:
        fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def appended(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """SNK-3, JON-3: rows whose key the table at path lacks, appended to it; the table as it is then. Running it again after a
    failure adds what is missing, and of rows with one key one is added."""
    fs, target = _system(spark, path)
    new = rows.dropDuplicates([key])
    if fs.exists(target):
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti").select(*rows.columns)
    new.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def rewritten(spark: SparkSession, path: str, rows: DataFrame, by: str) -> DataFrame:
    """SNK-4, SNK-5: the partitions of the table at path that rows has, replaced whole; all others stay."""
    rows.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def page_file(path: Column, page: Column, pages: Column) -> Column:
    """SNK-7: the file of one of `pages` pages: the path itself if it is the only one, else with _p01, _p02, ... before its ending."""
    number = F.lpad(page.cast("string"), F.greatest(F.lit(2), F.length(page.cast("string"))), F.lit("0"))
    stem, ending = F.regexp_replace(path, r"\.[^./]*\z", ""), F.regexp_extract(path, r"\.[^./]*\z", 0)
    return F.when(pages > 1, F.concat(stem, F.lit("_p"), number, ending)).otherwise(path)


def server_event(text: Column) -> Column:
    """SNK-9: a text as one server-sent event, each of its lines as data."""
    lines = F.replace(F.replace(text, F.lit("\n"), F.lit("\ndata: ")), F.lit("\r"), F.lit(""))
    return F.concat(F.lit("data: "), lines, F.lit("\n\n"))


def contained(path: Column) -> Column:
    """FLT-20: whether a relative path stays below its folder: it names no root, and no part of it climbs higher than it came."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda a, p: a["now"] + F.when(p == "..", -1).otherwise(1)
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, p: F.struct(step(a, p).alias("now"), F.least(a["least"], step(a, p)).alias("least")))
    return ~path.startswith("/") & (depth["least"] >= 0) & (depth["now"] > 0)


def shell_quoted(text: Column) -> Column:
    """TXT-24: a text as one word of a shell command."""
    whole = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(text.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), text).otherwise(whole)
