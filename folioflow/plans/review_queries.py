"""Queries of crops, labels and review."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boxes as B
from ..operators import review as R
from ..operators.ranks import numbered
from ..sources.fixtures import BOX_SQL, CROP_SQL, TOK_SQL, crops, read
from ..sources.stored import stored
from .registry import _ALPHA, _DF, _LAB, _VOCAB, _boxes, _labels, _tok, query
from .verdict_queries import _JUDGED, _MARKED, _VERDICT, _marked

_MAN = "manifest AS (SELECT 'segmented/' || page_key || '__' || box_id || '.png' AS crop_path, page_key || '.jpg' AS source_scan, page_key, box_id, x AS bbox_x, y AS bbox_y, w AS bbox_w, h AS bbox_h, line AS line_idx, word AS word_idx, text AS auto_text, conf AS line_conf, source, edited FROM boxes WHERE NOT deleted AND w >= 10 AND h >= 16)"
_SCANS = "scans AS (SELECT doc_id, 'scan ' || doc_id || ['.jpg', '.PNG', '.heic', '.txt', '.pdf', '.Tiff', ''][doc_id % 7 + 1] AS name FROM documents)"
_EXTS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "heic")
_EXT_SQL = "lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN (" + ", ".join(f"'{e}'" for e in _EXTS) + ")"


def _manifest(spark, d):
    b = B.active(_boxes(spark, d)).where("w >= 10 and h >= 16")
    path = F.concat(F.lit("segmented/"), R.crop_name(F.col("page_key"), F.col("box_id")))
    return b.select(path.alias("crop_path"), F.concat("page_key", F.lit(".jpg")).alias("source_scan"), "page_key", "box_id", *(F.col(c).alias(f"bbox_{c}") for c in "xywh"), F.col("line").alias("line_idx"), F.col("word").alias("word_idx"), F.col("text").alias("auto_text"), F.col("conf").alias("line_conf"), "source", "edited")


def _scans(spark, d):
    ends = F.array(*map(F.lit, (".jpg", ".PNG", ".heic", ".txt", ".pdf", ".Tiff", "")))
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("scan "), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int"))).alias("name"))


def _is_scan(name):
    return F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).isin(*_EXTS)


# ---- scans


@query(f"WITH {_SCANS} SELECT name, row_number() OVER (ORDER BY name) - 1 AS ord FROM scans WHERE {_EXT_SQL}")
def src1_list_scans(spark, d):
    return numbered(_scans(spark, d).where(_is_scan(F.col("name"))).select("name"), ["name"]).select("name", "ord")


@query(f"WITH {_SCANS} SELECT name FROM scans WHERE {_EXT_SQL} AND contains(name, '1') ORDER BY name LIMIT 25")
def src2_only_and_limit(spark, d):
    return _scans(spark, d).where(_is_scan(F.col("name")) & F.col("name").contains("1")).select("name").orderBy("name").limit(25)


@query(f"WITH {_SCANS} SELECT name, CASE WHEN suffix(name, '.pdf') THEN 'pages' WHEN {_EXT_SQL} THEN 'saved' ELSE 'rejected' END AS outcome FROM scans")
def src13_upload_report(spark, d):
    name = F.col("name")
    outcome = F.when(F.lower(name).endswith(".pdf"), "pages").when(_is_scan(name), "saved").otherwise("rejected")
    return _scans(spark, d).select("name", outcome.alias("outcome"))


@query("""WITH p AS (SELECT p_partkey, p_size AS n, p_size * 17.0::DOUBLE + 200 AS w, p_retailprice + 100 AS h FROM part), s AS (SELECT *, least(300 / 72.0::DOUBLE, 4200 / greatest(w, h)) AS scale FROM p)
SELECT p_partkey, i, 'scan' || p_partkey || '_p' || lpad(i::VARCHAR, greatest(2, len(n::VARCHAR))::INT, '0') || '.jpg' AS name, round_even(w * scale, 0)::BIGINT AS px_w, round_even(h * scale, 0)::BIGINT AS px_h FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM s)""")
def src10_pdf_pages(spark, d):
    """SRC-10: names and pixel sizes of the pages that a PDF is drawn as, 300 dots an inch with the long side capped."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("n"), (F.col("p_size") * 17.0 + 200).alias("w"), (F.col("p_retailprice") + 100).alias("h"))
    p = p.withColumn("scale", F.least(F.lit(300 / 72.0), 4200 / F.greatest("w", "h"))).withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    number = F.lpad(F.col("i").cast("string"), F.greatest(F.lit(2), F.length(F.col("n").cast("string"))), F.lit("0"))
    name = F.concat(F.lit("scan"), F.col("p_partkey").cast("string"), F.lit("_p"), number, F.lit(".jpg"))
    return p.select("p_partkey", F.col("i").cast("long").alias("i"), name.alias("name"), *(F.bround(F.col(c) * F.col("scale"), 0).cast("long").alias(f"px_{c}") for c in "wh"))


# ---- derived columns


@query(f"WITH {BOX_SQL} SELECT page_key || '__' || box_id || '.png' AS name FROM boxes")
def prj2_crop_name(spark, d):
    return _boxes(spark, d).select(R.crop_name(F.col("page_key"), F.col("box_id")).alias("name"))


@query(f"WITH {BOX_SQL} SELECT page_key, box_id, coalesce(CASE WHEN word % 3 = 0 THEN text END, '') AS text, 0.0::DOUBLE AS conf, 0 AS line, 0 AS word, coalesce(CASE WHEN word % 4 = 0 THEN source END, 'vision') AS source, coalesce(CASE WHEN word % 5 = 0 THEN edited END, false) AS edited, false AS deleted FROM boxes")
def prj3_box_defaults(spark, d):
    w = F.col("word")
    bare = _boxes(spark, d).select("page_key", "box_id", F.when(w % 3 == 0, F.col("text")).alias("text"), F.when(w % 4 == 0, F.col("source")).alias("source"), F.when(w % 5 == 0, F.col("edited")).alias("edited"))
    return R.with_defaults(bare)


@query(f"WITH {BOX_SQL}, p AS (SELECT *, greatest(2, trunc(h * 0.08)::INT) AS pad FROM boxes) SELECT page_key, box_id, greatest(0, x - pad) AS x0, greatest(0, y - pad) AS y0, least(2000, x + w + pad) AS x1, least(3000, y + h + pad) AS y1 FROM p")
def prj5_crop_corners(spark, d):
    return R.crop_corners(_boxes(spark, d), 2000, 3000)


@query(f"WITH {BOX_SQL}, c AS (SELECT page_key, box_id, greatest(0, x) AS bbox_x, greatest(0, y) AS bbox_y, least(2000, x + w) - greatest(0, x) AS bbox_w, least(900, y + h) - greatest(0, y) AS bbox_h FROM boxes) SELECT * FROM c WHERE bbox_w >= 10 AND bbox_h >= 16")
def prj6_clip_and_drop(spark, d):
    return R.clipped(_boxes(spark, d), 2000, 900).select("page_key", "box_id", *(f"bbox_{c}" for c in "xywh"))


@query("SELECT p_partkey, CASE WHEN greatest(w, h) <= 2500 THEN w ELSE round_even(w * (2500.0::DOUBLE / greatest(w, h)), 0)::INT END AS w, CASE WHEN greatest(w, h) <= 2500 THEN h ELSE round_even(h * (2500.0::DOUBLE / greatest(w, h)), 0)::INT END AS h FROM (SELECT p_partkey, (p_size * 113 + 300)::INT AS w, (p_partkey % 4000 + 50)::INT AS h FROM part)")
def prj9_downscale(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 113 + 300).alias("w"), (F.col("p_partkey") % 4000 + 50).cast("int").alias("h"))
    w, h = R.downscaled(F.col("w"), F.col("h"))
    return p.select("p_partkey", w.alias("w"), h.alias("h"))


@query(f"""WITH {BOX_SQL}, t AS (SELECT *, [0, 90, 180, 270][page_key::BIGINT % 4 + 1] AS deg FROM boxes)
SELECT page_key, box_id, CASE deg WHEN 90 THEN 3000 - y - h WHEN 180 THEN 2000 - x - w WHEN 270 THEN y ELSE x END AS x, CASE deg WHEN 90 THEN x WHEN 180 THEN 3000 - y - h WHEN 270 THEN 2000 - x - w ELSE y END AS y, CASE WHEN deg % 180 = 90 THEN h ELSE w END AS w, CASE WHEN deg % 180 = 90 THEN w ELSE h END AS h FROM t""")
def prj11_rotated_boxes(spark, d):
    deg = (F.col("page_key").cast("long") % 4 * 90).cast("int")
    return R.rotated(_boxes(spark, d), deg, 2000, 3000).select("page_key", "box_id", "x", "y", "w", "h")


@query(f"WITH {CROP_SQL} SELECT page_key, box_id, round(0.5 * least(focus / 250.0, 1.0) + 0.3 * least(contrast / 140.0, 1.0) + 0.2 * greatest(0.0, 1.0 - abs(ink - 0.25) / 0.35), 4)::DOUBLE AS quality FROM crops")
def prj12_quality_score(spark, d):
    return crops(_tok(spark, d)).select("page_key", "box_id", R.quality(F.col("ink"), F.col("contrast"), F.col("focus")).alias("quality"))


@query(f"WITH {BOX_SQL} SELECT page_key, box_id, CASE WHEN word % 3 = 0 THEN 'x' || text ELSE text END AS shown FROM boxes")
def prj13_shown_text(spark, d):
    curated = F.when(F.col("word") % 3 == 0, F.concat(F.lit("x"), "text")).when(F.col("word") % 3 == 1, "")
    return _boxes(spark, d).select("page_key", "box_id", R.shown_text(curated, F.col("text")).alias("shown"))


@query("SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN array_to_string(list_transform(string_split(r, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') ELSE r END AS word FROM (SELECT conv_id, turn, role, 'each other ' || lower(role) AS r FROM conversations)")
def prj16_recase(spark, d):
    source = F.when(F.col("turn") % 2 == 0, "Word").otherwise("word")
    return read(spark, d, "conversations").select("conv_id", "turn", "role", R.recased(source, F.concat(F.lit("each other "), F.lower("role"))).alias("word"))


# ---- filters


@query(f"WITH {BOX_SQL}, t AS (SELECT page_key, box_id, w, trim(CASE WHEN (page_key::BIGINT + line + word) % 499 = 0 THEN repeat(text, 9000) WHEN word % 19 = 0 THEN ' ' ELSE replace(translate(text, '’‘“”–—', '''''\"\"--'), '…', '...') END) AS t, word % 23 <> 0 AS found, CASE WHEN word % 29 = 0 THEN 40000 ELSE w END AS img_w FROM boxes WHERE NOT deleted), r AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(left(t, 300), ''), lambda c: NOT contains('{_ALPHA}', c)))), '') AS bad FROM t)"
       " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT found THEN 'file not found' WHEN t = '' THEN 'empty label' WHEN bad <> '' THEN 'not in alphabet: ' || bad WHEN len(t) >= 32767 THEN 'label too long' WHEN img_w >= 32767 THEN 'image too wide' ELSE 'packed' END AS reason FROM r) GROUP BY reason")
def flt9_flt10_dq3_skip_reasons(spark, d):
    """Labels made long by repetition; a label's characters are those of one repeat."""
    w = F.col("word")
    text = F.trim(F.when((F.col("page_key").cast("long") + F.col("line") + w) % 499 == 0, F.repeat("text", F.lit(9000))).when(w % 19 == 0, " ").otherwise(T.clean_label(F.col("text"))))
    rows = B.active(_boxes(spark, d)).select(text.alias("t"), (w % 23 != 0).alias("found"), F.when(w % 29 == 0, 40000).otherwise(F.col("w")).alias("img_w"))
    return rows.groupBy(F.coalesce(R.pack_reason(F.col("t"), F.col("img_w"), F.col("found"), T.ALPHABET), F.lit("packed")).alias("reason")).agg(F.count("*").alias("n"))


_FILTERED = f"WITH {BOX_SQL}, {_JUDGED}, {_MARKED}, r AS (SELECT page_key, box_id, CASE WHEN word % 3 = 0 THEN '' ELSE text END AS label, {_VERDICT} AS flag, edited FROM m WHERE NOT deleted)"


@query(_FILTERED + " SELECT f AS filter, count(*) FILTER (WHERE f = 'all' OR (f = 'unlabeled' AND trim(label) = '') OR (f = 'flagged' AND flag IS NOT NULL) OR (f = 'edited' AND edited)) AS total_filtered, count(*) AS total_all FROM r, (SELECT unnest(['all', 'unlabeled', 'flagged', 'edited']) AS f) GROUP BY f")
def flt16_crop_filter(spark, d):
    """FLT-16: rows under each of the crop list's filters, beside all of them."""
    rows = B.active(_marked(spark, d)).select(F.when(F.col("word") % 3 == 0, "").otherwise(F.col("text")).alias("label"), "flag", "edited")
    tests = {"all": F.lit(True), "unlabeled": F.trim("label") == "", "flagged": F.col("flag").isNotNull(), "edited": F.col("edited")}
    one = rows.agg(*(F.count_if(test).alias(name) for name, test in tests.items()), F.count("*").alias("total_all"))
    names = ", ".join(f"'{n}', {n}" for n in tests)
    return one.selectExpr("total_all", f"stack({len(tests)}, {names}) as (filter, total_filtered)")


@query(f"WITH {TOK_SQL}, w AS (SELECT doc_id, ln, wn, array_to_string(list_filter(string_split(tok, ''), lambda c: contains('{_ALPHA}', c)), '') AS word FROM tok) SELECT doc_id, ln, wn, word, len(word) > 20 AS long FROM w WHERE word <> ''")
def flt22_generator_words(spark, d):
    """FLT-22: words without the characters that a generator lacks; empty ones are skipped, long ones marked."""
    known = F.array(*map(F.lit, T.ALPHABET))
    word = F.array_join(F.filter(F.split("tok", ""), lambda c: F.array_contains(known, c)), "")
    return _tok(spark, d).select("doc_id", "ln", "wn", word.alias("word")).where("word <> ''").withColumn("long", F.length("word") > 20)


# ---- joins


@query(f"WITH {BOX_SQL}, {_MAN}, info AS (SELECT box_id, page_key, trim(text) AS text FROM boxes WHERE NOT deleted AND page_key::BIGINT % 3 <> 0) SELECT i.box_id IS NOT NULL AS reviewed, count(*) AS n, coalesce(sum(len(i.text)), 0)::BIGINT AS chars FROM manifest m LEFT JOIN info i ON i.page_key = m.page_key AND i.box_id = m.box_id GROUP BY 1")
def jon1_manifest_reviewed(spark, d):
    info = B.active(_boxes(spark, d)).where(F.col("page_key").cast("long") % 3 != 0).select("page_key", "box_id", F.trim("text").alias("text"))
    j = _manifest(spark, d).join(info, ["page_key", "box_id"], "left")
    return j.groupBy(F.col("text").isNotNull().alias("reviewed")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))


@query(f"WITH {BOX_SQL}, {_MAN}, l AS (SELECT '/a/' || page_key || '__' || box_id || '.png' AS image_path, text, 1 AS ord FROM boxes WHERE word % 2 = 0 UNION ALL SELECT 'b/' || page_key || '__' || box_id || '.png', text || '!', 2 FROM boxes WHERE word % 6 = 0), u AS (SELECT regexp_extract(image_path, '[^/]*$') AS name, arg_max(text, ord) AS text FROM l GROUP BY 1) SELECT m.crop_path, u.text FROM manifest m LEFT JOIN u ON u.name = regexp_extract(m.crop_path, '[^/]*$')")
def jon2_labels_by_name(spark, d):
    b = _boxes(spark, d)
    name = R.crop_name(F.col("page_key"), F.col("box_id"))
    twice = b.where("word % 2 = 0").select(F.concat(F.lit("/a/"), name).alias("image_path"), "text", F.lit(1).alias("ord")).union(b.where("word % 6 = 0").select(F.concat(F.lit("b/"), name), F.concat("text", F.lit("!")), F.lit(2)))
    m = _manifest(spark, d).select("crop_path", R.basename(F.col("crop_path")).alias("name"))
    return m.join(R.last_labels(twice), "name", "left").select("crop_path", "text")


@query(_LAB + f", {_MAN} SELECT count(DISTINCT m.page_key) AS pages FROM manifest m SEMI JOIN lab l ON l.page_key = m.page_key AND l.box_id = m.box_id")
def jon4_pages_represented(spark, d):
    return _manifest(spark, d).join(_labels(spark, d).select("page_key", "box_id"), ["page_key", "box_id"], "left_semi").agg(F.countDistinct("page_key").alias("pages"))


@query(f"WITH {BOX_SQL}, {_MAN} SELECT b.page_key, count(*) AS cropped FROM boxes b SEMI JOIN manifest m ON m.page_key = b.page_key AND m.box_id = b.box_id GROUP BY b.page_key")
def jon5_boxes_with_crops(spark, d):
    tok = stored(_tok(spark, d))
    from ..sources.fixtures import boxes

    made = B.active(boxes(tok)).where("w >= 10 and h >= 16").select("page_key", "box_id")
    return boxes(tok).join(made, ["page_key", "box_id"], "left_semi").groupBy("page_key").agg(F.count("*").alias("cropped"))


@query(f"WITH {BOX_SQL}, {_JUDGED}, {_MAN}, ok AS (SELECT page_key, box_id FROM boxes WHERE word % 10 = 0 AND page_key IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 0)) SELECT m.page_key, m.box_id, CASE WHEN ok.box_id IS NULL THEN v.flag END AS flag FROM manifest m JOIN v ON v.text = m.auto_text LEFT JOIN ok ON ok.page_key = m.page_key AND ok.box_id = m.box_id")
def jon6_accepted_excluded(spark, d):
    from .verdict_queries import _judged

    clean = read(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("page_key")).distinct()
    ok = _boxes(spark, d).where("word % 10 = 0").join(clean, "page_key", "left_semi").select("page_key", "box_id", F.lit(True).alias("ok"))
    m = _manifest(spark, d).join(_judged(spark, d).select(F.col("text").alias("auto_text"), "flag"), "auto_text").join(ok, ["page_key", "box_id"], "left")
    return m.select("page_key", "box_id", F.when(F.col("ok").isNull(), F.col("flag")).alias("flag"))


_SAVE = f"""WITH {BOX_SQL}, inc AS (SELECT page_key, box_id, CASE WHEN word % 5 = 0 THEN x + 1 ELSE x END AS x, y, w, h, CASE WHEN word % 11 = 0 THEN text || '?' ELSE text END AS text FROM boxes WHERE (line + word) % 7 <> 0
 UNION ALL SELECT page_key, 'new' || box_id, x, y, w, h, text FROM boxes WHERE word % 13 = 0)"""


@query(_SAVE + """ SELECT coalesce(b.page_key, i.page_key) AS page_key, coalesce(b.box_id, i.box_id) AS box_id, coalesce(i.x, b.x) AS x, coalesce(i.y, b.y) AS y, coalesce(i.w, b.w) AS w, coalesce(i.h, b.h) AS h, coalesce(i.text, b.text) AS text, coalesce(b.source, 'manual') AS source,
 CASE WHEN i.box_id IS NULL THEN b.edited WHEN b.box_id IS NULL THEN true ELSE b.edited OR i.x <> b.x OR i.text <> b.text END AS edited, i.box_id IS NULL AS deleted FROM boxes b FULL JOIN inc i ON b.page_key = i.page_key AND b.box_id = i.box_id""")
def jon10_flt21_editor_save(spark, d):
    b = _boxes(spark, d)
    shape = ["page_key", "box_id", "x", "y", "w", "h", "text"]
    w = F.col("word")
    kept = b.where("(line + word) % 7 <> 0").withColumns({"x": F.when(w % 5 == 0, F.col("x") + 1).otherwise(F.col("x")), "text": F.when(w % 11 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))}).select(*shape)
    new = b.where("word % 13 = 0").withColumn("box_id", F.concat(F.lit("new"), "box_id")).select(*shape)
    return R.saved(b.select(*shape, "source", "edited", "deleted"), kept.union(new))


@query(f"WITH {TOK_SQL}, {_VOCAB}, s AS (SELECT DISTINCT lower(tok) AS word FROM tok) SELECT word, word IN (SELECT word FROM vocab) AS known FROM s")
def jon11_vocabulary_member(spark, d):
    words = _tok(spark, d).select(F.lower("tok").alias("word")).distinct()
    return words.join(T.vocabulary(read(spark, d, "benchmark")).withColumn("k", F.lit(True)), "word", "left").select("word", F.coalesce("k", F.lit(False)).alias("known"))


@query(_DF + ", a AS (SELECT DISTINCT word FROM df WHERE n < 2), b AS (SELECT word AS candidate FROM df WHERE n >= 2) SELECT word, candidate, levenshtein(word, candidate) AS distance FROM a JOIN b ON abs(len(word) - len(candidate)) <= 2 AND levenshtein(word, candidate) <= 2 AND word <> candidate")
def jon13_two_edits(spark, d):
    counts = stored(T.document_frequency(_tok(spark, d), T.vocabulary(read(spark, d, "benchmark"))))
    return R.within_edits(counts.where("n < 2").select("word"), counts.where("n >= 2").select("word"), 2)


@query("WITH p AS (SELECT user_id, event_id, value FROM events), m AS (SELECT user_id, value AS mark FROM events WHERE event_id % 5 = 0), j AS (SELECT p.user_id, event_id, value, arg_min(mark, (abs(mark - value), mark)) AS nearest FROM p JOIN m ON m.user_id = p.user_id AND abs(mark - value) < 0.35 * 10 GROUP BY ALL) SELECT user_id, event_id, nearest FROM j")
def jon16_nearest_mark(spark, d):
    e = read(spark, d, "events")
    marks = e.where("event_id % 5 = 0").select("user_id", F.col("value").alias("mark"))
    return R.nearest(e.select("user_id", "event_id", "value"), marks, "user_id", "value", "mark", 0.35 * 10).select("user_id", "event_id", "nearest")


# ---- aggregates


@query(_LAB + " SELECT array_to_string(list_sort(list_distinct(flatten(list(string_split(text, ''))))), '') AS characters, count(DISTINCT lower(text)) AS words FROM lab")
def agg8_coverage(spark, d):
    lab = stored(_labels(spark, d).select("text"))
    chars = lab.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").agg(F.array_join(F.array_sort(F.collect_set("c")), "").alias("characters"))
    return chars.join(lab.agg(F.countDistinct(F.lower("text")).alias("words")).hint("broadcast"))  # one row each


@query(_FILTERED + " SELECT page_key, count(*) FILTER (WHERE flag IS NOT NULL) AS flagged, count(*) AS boxes FROM r GROUP BY page_key")
def agg9_flagged(spark, d):
    return B.active(_marked(spark, d)).groupBy("page_key").agg(F.count_if(F.col("flag").isNotNull()).alias("flagged"), F.count("*").alias("boxes"))


@query("SELECT label, pos - 1 AS pos, round(avg(x::DOUBLE), 6) AS mean, true AS finite FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def agg19_mean_vectors(spark, d):
    means = R.mean_vectors(read(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", "finite", F.posexplode("mean").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query(f"WITH {BOX_SQL}, k AS (SELECT page_key, lower(text) AS word, count(*) AS b FROM boxes GROUP BY ALL), r AS (SELECT page_key, lower(CASE WHEN word % 9 = 0 THEN text || 'z' ELSE text END) AS word, count(*) AS a FROM boxes WHERE word % 8 <> 0 GROUP BY ALL) SELECT page_key, sum(least(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS \"right\", sum(coalesce(b, 0))::BIGINT AS expected, sum(coalesce(a, 0) - least(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS extras FROM r FULL JOIN k USING (page_key, word) GROUP BY page_key")
def agg20_word_accuracy(spark, d):
    b = _boxes(spark, d)
    text = F.when(F.col("word") % 9 == 0, F.concat("text", F.lit("z"))).otherwise(F.col("text"))
    return R.word_accuracy(b.where("word % 8 <> 0").select("page_key", F.lower(text).alias("word")), b.select("page_key", F.lower("text").alias("word")))


# ---- order and sets


@query(f"WITH {BOX_SQL} SELECT page_key, box_id, row_number() OVER (PARTITION BY page_key ORDER BY line, word) AS place FROM boxes")
def srt1_line_word(spark, d):
    return _boxes(spark, d).select("page_key", "box_id", F.row_number().over(W.partitionBy("page_key").orderBy("line", "word")).alias("place"))


@query(f"WITH {BOX_SQL}, {_MAN} SELECT crop_path FROM manifest ORDER BY crop_path LIMIT 200 OFFSET 400")
def srt2_result_page(spark, d):
    """SRT-2: the third page of 200 crops; the limit is the feature."""
    return _manifest(spark, d).select("crop_path").orderBy("crop_path").offset(400).limit(200)


@query(_LAB + " SELECT image_path, row_number() OVER (ORDER BY image_path) - 1 AS ord FROM lab")
def srt3_labels_by_name(spark, d):
    return numbered(_labels(spark, d).select("image_path"), ["image_path"]).select("image_path", "ord")


@query("SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) - 1 AS ord FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def srt4_histogram_order(spark, d):
    counts = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("less", -F.col("n"))
    return numbered(counts, ["less", "event_type"]).select("event_type", "n", "ord")


@query("SELECT doc_id, right(text, 8000) AS tail FROM documents")
def srt7_log_tail(spark, d):
    """SRT-7: the last 8,000 characters, the length of a log's tail."""
    return read(spark, d, "documents").select("doc_id", F.expr("right(text, 8000)").alias("tail"))


@query("WITH n AS (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN '_line.png' ELSE lpad(turn::VARCHAR, 3, '0') || '_' || role || '.png' END AS name FROM conversations) SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY name) - 1 AS place FROM n WHERE NOT starts_with(name, '_')")
def srt8_padded_names(spark, d):
    name = F.when(F.col("turn") % 5 == 4, "_line.png").otherwise(F.concat(F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit("_"), "role", F.lit(".png")))
    n = read(spark, d, "conversations").select("conv_id", name.alias("name")).where(~F.col("name").startswith("_"))
    return n.select("conv_id", "name", (F.row_number().over(W.partitionBy("conv_id").orderBy("name")) - 1).alias("place"))


@query(f"WITH {BOX_SQL}, {_MAN} SELECT crop_path, 'detect' AS producer, line_conf, NULL::DOUBLE AS ink FROM manifest WHERE page_key::BIGINT % 2 = 0 UNION ALL SELECT crop_path, 'classical', NULL, bbox_w / 100.0::DOUBLE FROM manifest WHERE page_key::BIGINT % 2 = 1")
def set3_one_manifest(spark, d):
    """SET-3: manifests of two producers with different columns as one."""
    m, page = _manifest(spark, d), F.col("page_key").cast("long")
    first = m.where(page % 2 == 0).select("crop_path", F.lit("detect").alias("producer"), "line_conf")
    second = m.where(page % 2 == 1).select("crop_path", F.lit("classical").alias("producer"), (F.col("bbox_w") / 100.0).alias("ink"))
    return first.unionByName(second, allowMissingColumns=True)


@query(f"WITH {TOK_SQL} SELECT doc_id, ln, wn, tok FROM tok WHERE ln <> 1 UNION ALL SELECT doc_id, 1, wn, tok || '!' FROM tok WHERE ln = 1 AND wn % 2 = 0")
def set4_replaced_run(spark, d):
    """SET-4: one line of every document rewritten, the others as they were."""
    tok = stored(_tok(spark, d))
    new = tok.where("ln = 1 and wn % 2 = 0").withColumn("tok", F.concat("tok", F.lit("!")))
    return tok.where("ln <> 1").unionByName(new)


@query(f"WITH {BOX_SQL}, {_MAN} SELECT page_key, count(*) AS n FROM manifest WHERE page_key IN ('1', '5', '17', '80') GROUP BY page_key")
def set5_page_subset(spark, d):
    """SET-5: pages named in a list; an empty list means all."""
    chosen = [k for k in "1,5,17,80".split(",") if k]
    m = _manifest(spark, d)
    return (m.where(F.col("page_key").isin(chosen)) if chosen else m).groupBy("page_key").agg(F.count("*").alias("n"))


@query(f"WITH {TOK_SQL}, {_VOCAB}, s AS (SELECT DISTINCT word FROM (SELECT lower(tok) AS word FROM tok) WHERE regexp_full_match(word, '[a-z]{{2,}}')), e AS (SELECT s.word, v.word AS c FROM s JOIN vocab v ON abs(len(s.word) - len(v.word)) <= 1 AND damerau_levenshtein(s.word, v.word) = 1) SELECT word, min(c) AS only FROM e GROUP BY word HAVING count(*) = 1")
def set2_unique_neighbour(spark, d):
    words = _tok(spark, d).select(F.lower("tok").alias("word")).where("word rlike '^[a-z]{2,}$'").distinct()
    near = T.one_edit(words, T.vocabulary(read(spark, d, "benchmark")))
    return near.groupBy("word").agg(F.min("candidate").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")


# ---- samples and acceptance


@query(_LAB + ", r AS (SELECT image_path, text AS original_text, CASE WHEN ascii(right(box_id, 1)) % 4 = 0 THEN text || '~' ELSE text END AS reentered_text FROM lab WHERE ascii(right(box_id, 1)) % 3 <> 0) SELECT *, CASE WHEN original_text = reentered_text THEN 'OK' ELSE 'MISMATCH' END AS status FROM r")
def smp2_reentry_report(spark, d):
    last = F.ascii(F.substring("box_id", -1, 1))
    r = _labels(spark, d).where(last % 3 != 0).select("image_path", F.col("text").alias("original_text"), F.when(last % 4 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")).alias("reentered_text"))
    return r.withColumn("status", F.when(F.col("original_text") == F.col("reentered_text"), "OK").otherwise("MISMATCH"))


@query(_LAB + ", files AS (SELECT image_path FROM lab WHERE ascii(right(box_id, 1)) % 6 <> 0) SELECT image_path FROM lab ANTI JOIN files USING (image_path)")
def smp3_missing_files(spark, d):
    """SMP-3: labels whose file isn't in the listing, to be warned of and skipped."""
    lab = _labels(spark, d).select("image_path", "box_id")
    return lab.join(lab.where(F.ascii(F.substring("box_id", -1, 1)) % 6 != 0).select("image_path"), "image_path", "left_anti").select("image_path")


_PACK = _LAB + f", c AS (SELECT image_path, trim(replace(translate(text, '’‘“”–—', '''''\"\"--'), '…', '...')) AS t, writer, greatest(8, round_even(w * 32.0 / h, 0))::BIGINT AS img_w FROM lab), k AS (SELECT *, dense_rank() OVER (ORDER BY writer) - 1 AS wid FROM c WHERE t <> '' AND len(list_filter(string_split(t, ''), lambda c: NOT contains('{_ALPHA}', c))) = 0 AND len(t) < 32767 AND img_w < 32767)"


def _fitting(spark, d):
    """The labels that can be packed."""
    lab = _labels(spark, d).select("image_path", "page_key", "box_id", "writer", T.clean_label(F.col("text")).alias("t"), F.greatest(F.lit(8), F.bround(F.col("w") * 32.0 / F.col("h"), 0)).cast("long").alias("img_w"))
    return lab.where(R.pack_reason(F.col("t"), F.col("img_w"), F.lit(True), T.ALPHABET).isNull())


def _packable(spark, d):
    from .registry import _writers

    return _writers(_fitting(spark, d))


@query(_PACK + " SELECT * FROM (SELECT 'length' AS name, count(*) >= 3 AS ok, count(*) AS n FROM k UNION ALL SELECT 'width', bool_and(img_w BETWEEN 8 AND 32766), count(*) FILTER (WHERE NOT img_w BETWEEN 8 AND 32766) FROM k UNION ALL SELECT 'label', bool_and(len(t) BETWEEN 1 AND 32766), count(*) FILTER (WHERE NOT len(t) BETWEEN 1 AND 32766) FROM k UNION ALL SELECT 'writer', bool_and(wid >= 0), count(*) FILTER (WHERE wid < 0) FROM k UNION ALL SELECT 'path', count(*) = count(DISTINCT image_path), count(*) - count(DISTINCT image_path) FROM k)")
def dq1_acceptance(spark, d):
    """DQ-1: checks of the data set to be packed: name, ok, n (rows, or rows that fail)."""
    n = F.count("*")
    wrong = {"width": ~F.col("img_w").between(8, 32766), "label": ~F.length("t").between(1, 32766), "writer": F.col("wid") < 0}
    one = _packable(spark, d).agg(n.alias("rows"), F.countDistinct("image_path").alias("paths"), *(F.count_if(c).alias(k) for k, c in wrong.items()))
    return one.selectExpr("stack(5, 'length', rows >= 3, rows, 'width', width = 0, width, 'label', label = 0, label, 'writer', writer = 0, writer, 'path', rows = paths, rows - paths) as (name, ok, n)")


@query(_PACK + " SELECT (SELECT count(*) FROM lab WHERE trim(text) <> '') AS requested, count(*) AS packed FROM k")
def dq2_requested_packed(spark, d):
    asked = _labels(spark, d).where("trim(text) <> ''").agg(F.count("*").alias("requested"))
    return asked.join(_packable(spark, d).agg(F.count("*").alias("packed")).hint("broadcast"))  # one row each


@query("SELECT event_type, floor(epoch(max(ts)))::BIGINT AS newest, strftime(max(ts), '%Y%m%d_%H%M%S') AS stamp, arg_max(event_id, (ts, -event_id)) AS latest FROM events GROUP BY event_type")
def dat1_stamps(spark, d):
    ts = F.col("ts").cast("timestamp")
    found = F.max_by("event_id", F.struct("ts", -F.col("event_id")))
    return read(spark, d, "events").groupBy("event_type").agg(F.unix_timestamp(F.max(ts)).alias("newest"), F.date_format(F.max(ts), "yyyyMMdd_HHmmss").alias("stamp"), found.alias("latest"))
