"""Sources, sinks, transcripts and curation on small cases."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions import transcripts as X
from folioflow.operators import review as R
from folioflow.operators import sequences as S
from folioflow.operators.ranks import group_starts, running_in_groups
from folioflow.plans.registry import ORACLE_SQL, QUERIES
from folioflow.sources import files
from folioflow.sources.fixtures import boxes, tokens


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", 'say "hi", ok', "w"), ("b", "two\nlines", "w"), ("c", "", "w"), ("d", " edge ", None), ("e", "back\\slash", "ü")]
    df = spark.createDataFrame(rows, "path string, text string, writer string")
    files.write_csv(df, f"{tmp_path}/t.csv", ["path"])
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/t.csv", df.columns).collect()), key=str) == sorted(rows, key=str)


def test_listing(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt", "noend"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.name for r in files.listed(spark, f"file://{tmp_path}", ("png", "jpg")).collect()) == ["a.png", "b.JPG"]


def test_published_table_is_old_or_new(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    files.published(spark.range(5), path)
    broken = spark.range(3).withColumn("id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception):
        files.published(broken, path)
    assert spark.read.parquet(path).count() == 5
    assert files.published(spark.range(9), path).count() == 9


def test_appending_resumes(spark, tmp_path):
    path = f"file://{tmp_path}/labels"
    rows = lambda *ids: spark.createDataFrame([(i, f"label_for_{i}") for i in ids], "path string, text string")
    assert files.appended(spark, path, rows("a", "b", "b"), "path").count() == 2
    assert sorted(r.path for r in files.appended(spark, path, rows("a", "b", "c"), "path").collect()) == ["a", "b", "c"]
    assert files.appended(spark, path, rows("a"), "path").count() == 3


def test_partial_rewrite(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    files.rewritten(spark, path, spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "page string, n int"), "page")
    got = files.rewritten(spark, path, spark.createDataFrame([("p", 9)], "page string, n int"), "page")
    assert sorted(map(tuple, got.collect())) == [("p", 9), ("q", 3)]


def test_dictionary_and_rotation(spark, tmp_path):
    (tmp_path / "words").write_text(" Zebra \n\n\tapple\nZEBRA\n", encoding="utf-8")
    words = {r.word for r in files.dictionary(spark, f"file://{tmp_path}/words").collect()}
    assert {"zebra", "a", "om"} <= words and "" not in words
    maps = spark.createDataFrame([('{"s.jpg": 90}',), ("{",), (None,), ('{"t": 1}',)], "m string")
    assert [r[0] for r in maps.select(files.rotation(F.col("m"), F.lit("s.jpg"))).collect()] == [90, 0, 0, 0]


def test_markup(spark):
    raw = "<p>One &amp; two</p><div>① step<br/>three</div><script>x</script>  <li> </li>\r\nfour &lt;b&gt;"
    got = spark.createDataFrame([(raw,), ("",), (None,)], "t string").select(X.markup_lines(F.col("t")).alias("l")).collect()
    assert got[0].l == ["One & two", "1 step", "three", "x", "four <b>"] and got[1].l == [] and got[2].l is None


def test_markup_query_takes_references_with_a_semicolon(spark, tmp_path):
    """its SQL replaces whole references, '&amp' without a semicolon is text."""
    raw = "<p>and&&&amp <i>x</i> &amp;&copy;&ampere; &quot</p>&amp;amp; &bogus; &middot;"
    spark.createDataFrame([(7, raw)], "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    want = duckdb.sql(ORACLE_SQL["txt1_markup_lines"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = sorted(map(tuple, QUERIES["txt1_markup_lines"](spark, f"file://{tmp_path}").select("page_id", "ln", "line").collect()))
    assert got == sorted(want) and "&amp " in got[0][2]
    loose = spark.createDataFrame([(raw,)], "t string").select(X.markup_lines(F.col("t")).alias("l")).collect()[0].l
    assert "&amp " not in loose[0]


def test_parsed_and_rebuilt_text(spark):
    text = "\tone two\n\n \t\n\tthree\t four \t\nfive"
    frame = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n ")], "doc long, text string")
    got = [(r.word, r.nl, r.tabs) for r in X.parsed_text(frame).orderBy("doc", "ord").collect()]
    assert got == [("one", 0, 1), ("two", 0, 0), ("three", 3, 1), ("four", 0, 1), ("five", 1, 0)]
    lead = [(r.word, r.nl, r.tabs) for r in X.parsed_text(frame, leading_only=True).orderBy("doc", "ord").collect()]
    assert lead == [("one", 0, 1), ("two", 0, 0), ("three", 3, 1), ("four", 0, 0), ("five", 1, 0)]
    back = {r.doc: r.text for r in X.rebuilt_text(X.parsed_text(frame), "doc").collect()}
    assert back == {1: "\tone two\n\n\n\tthree \tfour\nfive"}


def test_marks(spark):
    words = ["más", "¿qué?", "año.", "x日", ".", None, "Ⅷ"]
    got = [tuple(r) for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.split_marks(F.col("w"), T.ALPHABET).alias("s")).select("s.base", "s.marks").collect()]
    assert got == [("mas", ["1:acute"]), ("que?", ["0:invert:?", "2:acute"]), ("ano", ["-:append:.", "1:tilde"]), ("x", []), (".", []), ("", []), ("", [])]


def test_curation(spark):
    vocab = spark.createDataFrame([(w,) for w in ("operation", "plan", "decide", "work", "force", "forecast", "a")], "word string")
    texts = ["Operations", "planning", "12/3", "", " ", "€", "x", "work-force", "Forcast's", "qqqq", "a", None]
    rows = spark.createDataFrame([(str(i), t, 0.9) for i, t in enumerate(texts)] + [("low", "plan", 0.1), ("none", "plan", None)], "crop_path string, auto_text string, line_conf double")
    got = {r.crop_path: (r.status, r.label) for r in X.curated(rows, vocab).collect()}
    want = [("accept", "Operations"), ("accept", "planning"), ("accept_numeric", "12/3"), ("reject_empty", ""), ("reject_empty", ""), ("review_nonword", "€"), ("reject_tooshort", "x"), ("accept", "work-force"), ("correct", "Forecast's"), ("review_unknown", "qqqq"), ("accept", "a"), ("reject_empty", "")]
    assert got == {str(i): w for i, w in enumerate(want)} | {"low": ("reject_lowconf", "plan"), "none": ("reject_lowconf", "plan")}


def test_editor_save(spark):
    shape = "page_key string, box_id string, x int, y int, w int, h int, text string"
    prior = spark.createDataFrame([("p", "a", 1, 1, 5, 5, "t", "vision", False, False), ("p", "b", 1, 1, 5, 5, None, "vision", True, True), ("p", "c", 1, 1, 5, 5, "t", "manual", False, False)], shape + ", source string, edited boolean, deleted boolean")
    now = spark.createDataFrame([("p", "a", 1, 1, 5, 5, "t"), ("p", "b", 1, 1, 5, 5, None), ("p", "n", 1, 1, 5, 5, "new")], shape)
    got = {r.box_id: (r.source, r.edited, r.deleted) for r in R.saved(prior, now).collect()}
    assert got == {"a": ("vision", False, False), "b": ("vision", True, False), "c": ("manual", False, True), "n": ("manual", True, False)}


def test_nearest_marks_and_accuracy(spark):
    points = spark.createDataFrame([(1, 0.0), (1, 4.9), (1, 5.0), (1, 50.0), (2, 1.0)], "g int, x double")
    marks = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 49.0)], "g int, m double")
    assert {(r.g, r.x, r.nearest) for r in R.nearest(points, marks, "g", "x", "m", 6.0).collect()} == {(1, 0.0, 0.0), (1, 4.9, 0.0), (1, 5.0, 0.0), (1, 50.0, 49.0)}
    read = spark.createDataFrame([("p", w) for w in "a a b x".split()], "page_key string, word string")
    key = spark.createDataFrame([("p", w) for w in "a b b c".split()], "page_key string, word string")
    assert [tuple(r) for r in R.word_accuracy(read, key).collect()] == [("p", 2, 4, 2)]


def test_long_subsequences_take_little_memory():
    a = [f"w{i % 700}" for i in range(6000)]
    pairs = S.common(a, a[100:] + a[:100])
    assert len(pairs) == 5900 and all(a[i] == (a[100:] + a[:100])[j] for i, j in pairs)


def test_long_labels_are_judged_in_time(spark):
    """reasons of labels of 50,000 characters, which took milliseconds each as arrays of characters."""
    rows = [("word", 9), ("[a]^b\\é]", 9), ("", 9), ("x-`\"*", 40000), ("ü€ü😀", 9), ("\n", 9), (None, 9)]
    frame = spark.createDataFrame(rows, "t string, w int")
    got = [r[0] for r in frame.select(R.pack_reason(F.col("t"), F.col("w"), F.lit(True), T.ALPHABET)).collect()]
    assert got == [None, "not in alphabet: [\\]^é", "empty label", "image too wide", "not in alphabet: ü€😀", "not in alphabet: \n", None]
    long = spark.range(4000).select(F.repeat(F.concat(F.lit("word"), F.when(F.col("id") % 1000 == 0, "é").otherwise("s")), F.lit(10000)).alias("t"))
    began = time.time()
    tally = long.groupBy(R.pack_reason(F.col("t"), F.lit(9), F.lit(True), T.ALPHABET).alias("r")).count().collect()
    assert sorted(map(tuple, tally)) == [("label too long", 3996), ("not in alphabet: é", 4)] and time.time() - began < 15


def test_page_documents_are_packed_and_only_keys_move(spark, tmp_path, monkeypatch):
    """boxes go to their page before texts become boxes, documents are compressed, and missing or repeated pages still count."""
    docs = spark.createDataFrame([(1, "a b\nc"), (2, "d"), (3, ""), (10, "gone")], "doc_id long, text string")
    made = files.page_documents(boxes(tokens(docs, dealt=True)))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    path = f"file://{tmp_path}/pages"
    made.write.json(path, compression="gzip")
    pages = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), ("9",), ("9",)], "page_key string")
    got = sorted((r.page_key, r.text or "") for r in files.with_documents(spark, path, pages).collect())
    want = pages.join(files.read_page_documents(spark, path), "page_key", "left")
    assert got == sorted((r.page_key, r.text or "") for r in want.collect()) and len(got) == 8
    spark.createDataFrame([(k, "one two three " * k) for k in range(1, 31)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/d/documents.parquet")
    monkeypatch.setattr("folioflow.plans.file_queries.shared_path", lambda spark: f"file://{tmp_path}/kept")
    assert QUERIES["src4_page_documents"](spark, f"file://{tmp_path}/d").count() == 3 * (465 - 60) + 3
    assert not list(tmp_path.glob("kept/pages/*.json")) and list(tmp_path.glob("kept/pages/*.json.gz"))


@pytest.mark.parametrize("block", [1 << 16, 7, 1])
def test_labels_are_read_back_from_blocks_of_codes(spark, tmp_path, monkeypatch, block):
    """offsets look up blocks of codes; single codes are neither dealt out nor joined. Labels may span blocks."""
    monkeypatch.setattr(files, "BLOCK", block)
    rows = [(p, f"{k:02}", "".join(chr(97 + (p * 7 + k + i) % 26) for i in range(1 + (p + k) % 12))) for p in (1, 10, 2, 12, 123) for k in range(9)]
    labels = spark.createDataFrame([(str(p), k, t, f"{p}__{k}", len(t)) for p, k, t in rows], "page_key string, box_id string, t string, image_path string, lb_len long")
    starts = group_starts(labels, "page_key", F.concat("page_key", F.lit("__")), "lb_len")
    placed = running_in_groups(labels, starts, "page_key", ["box_id"], "lb_len", "lb_seek")
    at = sum_before = 0
    for r in sorted(placed.collect(), key=lambda r: r.image_path):
        assert r.lb_seek == sum_before, at
        at, sum_before = at + 1, sum_before + r.lb_len
    blocks = files.code_blocks(spark, placed, f"file://{tmp_path}/codes")
    assert b"".join(r.codes for r in sorted(blocks.collect())).decode() == "".join(r.t for r in sorted(labels.collect(), key=lambda r: r.image_path))
    got = {r.image_path: (r.decoded, r.same) for r in files.read_back(placed, starts, blocks).collect()}
    assert got == {f"{p}__{k}": (t, True) for p, k, t in rows}
