"""Named queries over the driver tables, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boxes as B
from ..operators.ranks import numbered, quantiles, running
from ..sources.files import BUILT_IN
from ..sources.fixtures import BOX_SQL, CROP_SQL, DET_SQL, TOK_SQL, boxes, crops, detected, read, tokens
from ..sources.stored import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _tok(spark: SparkSession, d: str) -> DataFrame:
    return tokens(read(spark, d, "documents"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes(_tok(spark, d))


# ---- boxes


@query(f"""WITH {BOX_SQL}, b AS (SELECT *, y + h / 2.0 AS cy FROM boxes WHERE NOT deleted),
g AS (SELECT page_key, greatest(4, trunc(list_sort(list(h))[(count(*) // 2 + 1)::INT] * 0.6)::INT) AS gap FROM b GROUP BY page_key),
j AS (SELECT b.*, CASE WHEN lag(cy) OVER o IS NULL OR cy - lag(cy) OVER o > gap THEN 1 ELSE 0 END AS jump FROM b JOIN g USING (page_key) WINDOW o AS (PARTITION BY page_key ORDER BY cy, box_ord)),
l AS (SELECT *, sum(jump) OVER (PARTITION BY page_key ORDER BY cy, box_ord ROWS UNBOUNDED PRECEDING)::BIGINT AS out_line FROM j)
SELECT page_key, box_id, out_line, row_number() OVER (PARTITION BY page_key, out_line ORDER BY x, cy, box_ord) AS out_word FROM l""")
def win1_reading_order(spark, d):
    return B.reading_order(_boxes(spark, d))


@query(f"""WITH {BOX_SQL}, p AS (SELECT *, greatest(2, trunc(h * 0.06)::INT) AS pad FROM boxes)
SELECT page_key, box_id, greatest(0, x - pad) AS x, greatest(0, y - pad) AS y, least(2000 - greatest(0, x - pad), w + 2 * pad) AS w, least(3000 - greatest(0, y - pad), h + 2 * pad) AS h FROM p""")
def prj4_pad_clip(spark, d):
    return B.pad_clip(_boxes(spark, d), 2000, 3000)


@query(f"WITH {BOX_SQL} SELECT page_key, line, greatest(0, min(x) - 4) AS x0, greatest(0, min(y) - 4) AS y0, least(2000, max(x + w) + 4) AS x1, least(3000, max(y + h) + 4) AS y1 FROM boxes GROUP BY page_key, line")
def prj7_line_bbox(spark, d):
    return B.line_bbox(_boxes(spark, d), 2000, 3000)


@query(f"WITH {BOX_SQL} SELECT page_key, count(*) FILTER (WHERE NOT deleted) AS active FROM boxes GROUP BY page_key HAVING active > 0")
def flt1_active_boxes(spark, d):
    return B.active(_boxes(spark, d)).groupBy("page_key").agg(F.count("*").alias("active"))


@query(f"WITH {BOX_SQL} SELECT CASE WHEN edited OR source = 'manual' THEN 'protected' WHEN NOT deleted THEN 'refreshable' ELSE 'retired' END AS state, count(*) AS n FROM boxes GROUP BY 1")
def flt2_protection(spark, d):
    return B.protection(_boxes(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {BOX_SQL} SELECT page_key, box_id FROM (SELECT *, count(*) OVER (PARTITION BY page_key, line) AS n FROM boxes) WHERE n >= 3 AND conf >= 0.3")
def flt3_line_rejection(spark, d):
    n = F.count("*").over(W.partitionBy("page_key", "line"))
    return _boxes(spark, d).withColumn("n", n).where("n >= 3 and conf >= 0.3").select("page_key", "box_id")


@query(f"""WITH {BOX_SQL}, l AS (SELECT page_key, line, min(x) AS x0, count(*) AS n FROM boxes GROUP BY page_key, line), a AS (SELECT page_key, quantile_cont(x0, 0.5) AS anchor FROM l WHERE n >= 3 GROUP BY page_key)
SELECT b.page_key, b.box_id FROM boxes b JOIN l USING (page_key, line) LEFT JOIN a ON a.page_key = b.page_key WHERE anchor IS NULL OR abs(x0 - anchor) <= 0.18 * 300""")
def flt4_body_column(spark, d):
    return B.body_column(_boxes(spark, d), 300).select("page_key", "box_id")


_GATES = """m AS (SELECT page_key, coalesce(quantile_cont(h, 0.5) FILTER (WHERE h >= 20 AND w >= 14), 0) AS mh FROM crops GROUP BY page_key),
r AS (SELECT page_key, box_id, CASE WHEN h < 20 OR w < 14 THEN 'too_small' WHEN h > 220 THEN 'too_tall' WHEN mh > 0 AND NOT (h BETWEEN 0.55 * mh AND 2.20 * mh) THEN 'off_page_scale' WHEN NOT (ink BETWEEN 0.05 AND 0.65) THEN 'bad_ink' WHEN contrast < 45 THEN 'low_contrast' WHEN focus < 55 THEN 'blurry' END AS reason FROM crops JOIN m USING (page_key))"""


@query(f"WITH {CROP_SQL}, {_GATES} SELECT * FROM r")
def flt5_quality_gates(spark, d):
    return B.quality_gate(stored(crops(_tok(spark, d)).select("page_key", "box_id", "h", "w", "ink", "contrast", "focus")))


@query(f"WITH {CROP_SQL}, {_GATES} SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 4)::DOUBLE AS percent FROM r WHERE reason IS NOT NULL GROUP BY reason")
def agg3_gate_tally(spark, d):
    tally = flt5_quality_gates(spark, d).groupBy("reason").agg(F.count("*").alias("n"))
    return tally.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4)).where("reason is not null")


_CELLS = "unnest(range(floor(x / 512)::INT, floor((x + w) / 512)::INT + 1)) AS c"
_IOU = f"""WITH {DET_SQL}, st AS (SELECT *, CASE WHEN edited OR source = 'manual' THEN 'protected' WHEN NOT deleted THEN 'refreshable' ELSE 'retired' END AS state FROM boxes),
oc AS (SELECT page_key, box_ord, state, x, y, w, h, line + unnest([-1, 0, 1]) AS near, c FROM (SELECT *, {_CELLS} FROM st)), nc AS (SELECT *, {_CELLS} FROM det),
iou AS (SELECT o.page_key, o.box_ord, n.det_ord, o.state, (least(o.x + o.w, n.x + n.w) - greatest(o.x, n.x))::BIGINT * (least(o.y + o.h, n.y + n.h) - greatest(o.y, n.y)) AS i, o.w::BIGINT * o.h + n.w::BIGINT * n.h AS s
 FROM oc o JOIN nc n ON o.page_key = n.page_key AND o.near = n.line AND o.c = n.c AND o.x < n.x + n.w AND n.x < o.x + o.w AND o.y < n.y + n.h AND n.y < o.y + o.h AND floor(greatest(o.x, n.x) / 512) = o.c),
pairs AS (SELECT *, i / (s - i)::DOUBLE AS iou FROM iou WHERE i / (s - i)::DOUBLE >= 0.5)"""


@query(_IOU + " SELECT p.page_key, b.box_id AS old_id, d.box_id AS new_id, iou FROM pairs p JOIN boxes b ON b.page_key = p.page_key AND b.box_ord = p.box_ord JOIN det d ON d.page_key = p.page_key AND d.det_ord = p.det_ord")
def jon7_iou_pairs(spark, d):
    tok = stored(_tok(spark, d))
    # a box's id is a digest of its place
    named = lambda ord_: F.substring(F.sha2(F.concat_ws(":", "page_key", F.shiftright(ord_, 32), F.col(ord_).bitwiseAND(F.lit((1 << 32) - 1))), 256), 1, 10)
    return B.iou_pairs(boxes(tok), detected(tok)).select("page_key", named("box_ord").alias("old_id"), named("det_ord").alias("new_id"), "iou")


@query(_IOU + ", hit AS (SELECT DISTINCT page_key, det_ord FROM pairs WHERE state = 'protected') SELECT page_key, box_id FROM det ANTI JOIN hit USING (page_key, det_ord)")
def jon8_protected_suppress(spark, d):
    tok = stored(_tok(spark, d))
    return B.suppress(detected(tok), boxes(tok)).select("page_key", "box_id")


#: Candidates of refreshable boxes fall into islands of boxes that share detections; each island is worked through in order.
_MERGE = _IOU.replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT page_key, box_ord, list(det_ord ORDER BY iou DESC, det_ord) AS cands, min(det_ord) AS lo, max(det_ord) AS hi FROM pairs WHERE state = 'refreshable' GROUP BY page_key, box_ord),
i AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY page_key ORDER BY box_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM c),
s AS (SELECT *, sum(new) OVER (PARTITION BY page_key ORDER BY box_ord) AS island FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY page_key, island ORDER BY box_ord) AS k, count(*) OVER (PARTITION BY page_key, island) AS many FROM s),
long AS (SELECT page_key, island, k, box_ord, cands FROM k WHERE many > 1),
turn AS (SELECT page_key, island, k, box_ord, cands[1] AS pick, [cands[1]] AS used FROM long WHERE k = 1
 UNION ALL SELECT l.page_key, l.island, l.k, l.box_ord, list_filter(l.cands, lambda x: NOT list_contains(t.used, x))[1], list_append(t.used, list_filter(l.cands, lambda x: NOT list_contains(t.used, x))[1]) FROM turn t JOIN long l ON l.page_key = t.page_key AND l.island = t.island AND l.k = t.k + 1),
best AS (SELECT page_key, box_ord, pick AS det_ord FROM turn WHERE pick IS NOT NULL UNION ALL SELECT page_key, box_ord, cands[1] FROM k WHERE many = 1),
merged AS (SELECT s.page_key, s.box_id, coalesce(d.x, s.x) AS x, coalesce(d.y, s.y) AS y, coalesce(d.w, s.w) AS w, coalesce(d.h, s.h) AS h, coalesce(d.text, s.text) AS text, CASE s.state WHEN 'protected' THEN 'kept' WHEN 'retired' THEN 'carried' ELSE CASE WHEN d.det_ord IS NULL THEN 'retired' ELSE 'refreshed' END END AS outcome
 FROM st s LEFT JOIN best b ON b.page_key = s.page_key AND b.box_ord = s.box_ord LEFT JOIN det d ON d.page_key = b.page_key AND d.det_ord = b.det_ord
 UNION ALL SELECT page_key, 'n' || box_id, x, y, w, h, text, 'added' FROM det ANTI JOIN (SELECT page_key, det_ord FROM best UNION ALL SELECT page_key, det_ord FROM pairs WHERE state = 'protected') USING (page_key, det_ord))"""


@query(_MERGE + " SELECT * FROM merged")
def geo2_merge_fast(spark, d):
    documents = read(spark, d, "documents")
    # texts become boxes of some 50 times their bytes, which a task sorts by page
    parts = max(spark.sparkContext.defaultParallelism, int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >> 20)
    tok = tokens(documents, dealt=min(parts, 1 << 16))
    return B.merge_detection(boxes(tok), detected(tok))


@query(_MERGE + " SELECT coalesce(outcome, 'total') AS outcome, count(*) AS n FROM merged GROUP BY ROLLUP (outcome)")
def agg4_merge_stats(spark, d):
    return geo2_merge_fast(spark, d).rollup("outcome").agg(F.count("*").alias("n")).withColumn("outcome", F.coalesce("outcome", F.lit("total")))


@query(f"WITH {BOX_SQL} SELECT page_key, list_sort(list(h))[(count(*) // 2 + 1)::INT] AS median_h FROM boxes GROUP BY page_key")
def agg10_upper_median(spark, d):
    return _boxes(spark, d).groupBy("page_key").agg(B.upper_median("h").alias("median_h"))


@query(f"WITH {BOX_SQL}, m AS (SELECT page_key, quantile_cont(conf, 0.5) AS m FROM boxes GROUP BY page_key) SELECT page_key, round(1.4826 * quantile_cont(abs(conf - m), 0.5), 6) AS sigma FROM boxes JOIN m USING (page_key) GROUP BY page_key")
def agg13_robust_sigma(spark, d):
    b = _boxes(spark, d)
    m = b.groupBy("page_key").agg(F.percentile("conf", 0.5).alias("m"))
    return b.join(m, "page_key").groupBy("page_key").agg(F.round(1.4826 * F.percentile(F.abs(F.col("conf") - F.col("m")), 0.5), 6).alias("sigma"))


# ---- text


@query(f"WITH {TOK_SQL} SELECT doc_id, ln, wn, tok FROM tok")
def txt_token_stream(spark, d):
    return _tok(spark, d)


@query(f"WITH {TOK_SQL} SELECT doc_id, ln, wn, regexp_replace(lower(tok), '[^a-z0-9]', '', 'g') AS norm FROM tok")
def txt2_norm_compare(spark, d):
    return _tok(spark, d).select("doc_id", "ln", "wn", T.normalised(F.col("tok")).alias("norm"))


@query(f"WITH {TOK_SQL} SELECT doc_id, ln, wn, trim(replace(translate(tok, '’‘“”–—', '''''\"\"--'), '…', '...')) AS label FROM tok")
def txt7_clean_label(spark, d):
    return _tok(spark, d).select("doc_id", "ln", "wn", T.clean_label(F.col("tok")).alias("label"))


_STEM = r"""regexp_replace(regexp_replace(lower({0}), '^[.,;:!?''"]+|[.,;:!?''"]+$', '', 'g'), '''s$', '')"""
_BUILT = "SELECT unnest([" + ", ".join(f"'{w}'" for w in BUILT_IN) + "]) AS word"
_VOCAB = f"vocab AS (SELECT DISTINCT word FROM (SELECT word FROM (SELECT {_STEM.format('t')} AS word FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS t FROM benchmark)) WHERE regexp_full_match(word, '[a-z]+') UNION ALL {_BUILT}))"


@query(f"WITH {TOK_SQL}, s AS (SELECT {_STEM.format('tok')} AS stem, count(*) AS n FROM tok GROUP BY 1) SELECT * FROM s")
def txt8_stems(spark, d):
    return _tok(spark, d).groupBy(T.stem(F.col("tok")).alias("stem")).agg(F.count("*").alias("n"))


_INITIALS = r"(len(regexp_replace({0}, '^\.+|\.+$', '', 'g')) BETWEEN 2 AND 4 AND len(regexp_extract_all({0}, '\p{{Lu}}')) >= greatest(2, len(regexp_replace({0}, '^\.+|\.+$', '', 'g')) - 1))"
_NUMBER = "regexp_full_match({0}, '[0-9]+([./-][0-9]+)*')"


@query(f"WITH {TOK_SQL} SELECT CASE WHEN regexp_full_match(tok, '[0-9]+([./-][0-9]+)*') THEN 'number' WHEN {_INITIALS.format('tok')} THEN 'initialism' ELSE 'other' END AS kind, count(*) AS n FROM tok GROUP BY 1")
def flt6_flt7_token_kinds(spark, d):
    kind = F.when(T.is_number(F.col("tok")), "number").when(T.is_initialism(F.col("tok")), "initialism").otherwise("other")
    return _tok(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_ALPHA = T.ALPHABET.replace("'", "''")


@query(f"WITH {TOK_SQL}, r AS (SELECT doc_id, ln, wn, array_to_string(list_sort(list_distinct(list_filter(string_split(tok, ''), lambda c: NOT contains('{_ALPHA}', c)))), '') AS bad FROM tok) SELECT * FROM r WHERE bad <> ''")
def flt8_alphabet_reject(spark, d):
    return _tok(spark, d).select("doc_id", "ln", "wn", T.offending(F.col("tok")).alias("bad")).where("bad <> ''")


@query(f"WITH {TOK_SQL}, c AS (SELECT unnest(string_split(tok, '')) AS ch FROM tok) SELECT ch, count(*) AS n FROM c WHERE NOT contains('{_ALPHA}', ch) GROUP BY ch")
def agg7_unsupported_characters(spark, d):
    chars = _tok(spark, d).select(F.explode(F.split("tok", "")).alias("ch")).where("ch <> ''")
    return chars.where(~F.col("ch").isin(list(T.ALPHABET))).groupBy("ch").agg(F.count("*").alias("n"))


#: The forms to look up for each word of a relation {0}.
_FORMS = """f AS (SELECT word, unnest([word, CASE WHEN word LIKE '%ies' AND len(word) > 5 THEN left(word, -3) || 'y' END, CASE WHEN word LIKE '%es' AND len(word) > 4 THEN left(word, -2) END, CASE WHEN word LIKE '%s' AND len(word) > 3 THEN left(word, -1) END] ||
 flatten(list_transform(list_filter(['ed', 'ing', 'ly', 'er', 'est'], lambda e: suffix(word, e) AND len(word) - len(e) >= 3), lambda e: [left(word, -len(e)), left(word, -len(e)) || 'e', CASE WHEN word[-len(e) - 1] = 'i' THEN left(word, -len(e) - 1) || 'y' END, CASE WHEN word[-len(e) - 1] = word[-len(e) - 2] THEN left(word, -len(e) - 1) END]))) AS form FROM {0})"""

_DF = f"""WITH {TOK_SQL}, {_VOCAB}, seen AS (SELECT word, count(*) AS n FROM (SELECT regexp_replace(lower(trim(tok)), '^[.,;:!?''"]+|[.,;:!?''"]+$', '', 'g') AS word FROM tok) WHERE regexp_full_match(word, '[a-z][a-z''-]+') GROUP BY word),
{_FORMS.format('seen')}, df AS (SELECT word, n FROM seen WHERE word IN (SELECT word FROM f WHERE form IN (SELECT word FROM vocab)))"""


@query(_DF + " SELECT * FROM df")
def agg1_document_frequency(spark, d):
    return T.document_frequency(_tok(spark, d), T.vocabulary(read(spark, d, "benchmark")))


@query(_DF + " SELECT word FROM df WHERE n >= 2")
def agg2_strong_vocabulary(spark, d):
    return agg1_document_frequency(spark, d).where("n >= 2").select("word")


@query(f"WITH {_VOCAB} SELECT word FROM vocab")
def set1_vocabulary(spark, d):
    return T.vocabulary(read(spark, d, "benchmark"))


_STEMS = f"WITH {TOK_SQL}, {_VOCAB}, stems AS (SELECT DISTINCT word FROM (SELECT {_STEM.format('tok')} AS word FROM tok) WHERE regexp_full_match(word, '[a-z]{{2,}}'))"


def _stems(spark: SparkSession, d: str) -> DataFrame:
    return _tok(spark, d).select(T.stem(F.col("tok")).alias("word")).where("word rlike '^[a-z]{2,}$'").distinct()


@query(_STEMS + ", " + _FORMS.format("stems") + " SELECT word, bool_or(coalesce(form IN (SELECT word FROM vocab), false)) AS known FROM f GROUP BY word")
def txt9_inflection_known(spark, d):
    return T.inflected(_stems(spark, d), T.vocabulary(read(spark, d, "benchmark")))


@query(_STEMS + " SELECT s.word, v.word AS candidate FROM stems s JOIN vocab v ON abs(len(s.word) - len(v.word)) <= 1 AND damerau_levenshtein(s.word, v.word) = 1")
def jon12_edit1(spark, d):
    return T.one_edit(_stems(spark, d), T.vocabulary(read(spark, d, "benchmark")))


# ---- labels and data sets


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """ord, image_path, text, writer_id: one label for each active box of a page of good quality."""
    good = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("page_key"))
    docs = read(spark, d, "documents").select("doc_id", "text", "source", F.col("doc_id").cast("string").alias("page_key"))
    writers = docs.select("page_key", F.col("source").alias("writer"))
    texts = docs.drop("source").join(good.distinct(), "page_key", "left_semi").join(writers, "page_key")  # texts, as boxes are many times larger
    b = B.active(boxes(tokens(texts, "writer", dealt=True), "writer")).where("w >= 10 and h >= 16")
    return b.select(F.concat_ws("__", "page_key", "box_id").alias("image_path"), "text", "writer", "page_key", "box_id", "w", "h")


_LAB = f"WITH {BOX_SQL}, lab AS (SELECT page_key || '__' || box_id AS image_path, b.text, d.source AS writer, page_key, box_id, w, h FROM boxes b JOIN documents d ON d.doc_id::VARCHAR = b.page_key WHERE NOT deleted AND w >= 10 AND h >= 16 AND page_key IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1))"


@query(_LAB + " SELECT image_path, text, writer, dense_rank() OVER (ORDER BY writer) - 1 AS wid FROM lab")
def win3_writer_ids(spark, d):
    return _writers(_labels(spark, d).select("image_path", "text", "writer"))


def _writers(labels: DataFrame) -> DataFrame:
    """WIN-3: labels with wid, the place of their writer among all. Places are taken over the writers, not their labels; the list of
    writers is written, and broadcast if it is small."""
    ids = stored(numbered(labels.select("writer").distinct(), ["writer"], "wid"))
    return labels.join(ids, "writer")


@query(_LAB + " SELECT image_path, len(text) AS lb_len, (sum(len(text)) OVER (ORDER BY image_path ROWS UNBOUNDED PRECEDING) - len(text))::BIGINT AS lb_seek, array_to_string(list_transform(string_split(text, ''), lambda c: ord(c)::VARCHAR), ' ') AS codes FROM lab")
def arr1_pack_offsets(spark, d):
    lab = _labels(spark, d).select("image_path", "text", F.length("text").cast("long").alias("lb_len"))
    codes = F.array_join(F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("string")), " ")
    return running(lab, ["image_path"], "lb_len", "lb_seek").select("image_path", "lb_len", "lb_seek", codes.alias("codes"))


@query(_LAB + " SELECT image_path, text, greatest(8, round_even(w * 32.0 / h, 0))::BIGINT AS img_w FROM lab")
def prj10_resize_width(spark, d):
    return _labels(spark, d).select("image_path", "text", F.greatest(F.lit(8), F.bround(F.col("w") * 32.0 / F.col("h"), 0)).cast("long").alias("img_w"))


@query(_LAB + """, c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM lab) SELECT count(*) AS samples, count(*) FILTER (WHERE trim(text) <> '') AS requested, count(DISTINCT page_key) AS pages, count(DISTINCT lower(text)) AS words, round(avg(len(text)), 6) AS avg_len, sum(len(text))::BIGINT AS total, (SELECT count(*) FROM c) AS n_chars, (SELECT string_agg(ch, '' ORDER BY ch) FROM c) AS chars FROM lab""")
def agg6_dataset_info(spark, d):
    n = F.length("text")
    lab = stored(_labels(spark, d).select("page_key", "text"))
    chars = lab.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").agg(F.array_sort(F.collect_set("c")).alias("c"))
    one = lab.agg(F.count("*").alias("samples"), F.count_if(F.trim("text") != "").alias("requested"), F.countDistinct("page_key").alias("pages"), F.countDistinct(F.lower("text")).alias("words"), F.round(F.avg(n), 6).alias("avg_len"), F.sum(n).cast("long").alias("total"))
    both = one.join(chars.hint("broadcast"))  # one row each
    return both.select("*", F.size("c").cast("long").alias("n_chars"), F.array_join("c", "").alias("chars")).drop("c")


@query(_LAB + " SELECT page_key, count(*) AS pending FROM boxes WHERE NOT deleted AND page_key || '__' || box_id NOT IN (SELECT image_path FROM lab) GROUP BY page_key")
def jon3_resume_pending(spark, d):
    done = _labels(spark, d).select("page_key", "box_id")
    return B.active(_boxes(spark, d)).join(done, ["page_key", "box_id"], "left_anti").groupBy("page_key").agg(F.count("*").alias("pending"))


@query(_LAB + ", k AS (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT AS k FROM lab) SELECT image_path, text FROM (SELECT *, row_number() OVER (ORDER BY sha256(image_path || '7'), image_path) AS r FROM lab), k WHERE r <= k")
def smp1_qa_sample(spark, d):
    lab = _labels(spark, d).select("image_path", "text", F.sha2(F.concat("image_path", F.lit("7")), 256).alias("draw"))
    placed = numbered(lab, ["draw", "image_path"], "place", total="n")
    return placed.where(F.col("place") < F.greatest(F.lit(1), F.bround(F.col("n") * 0.1))).select("image_path", "text")


@query(_LAB + ", r AS (SELECT image_path, text, CASE WHEN ascii(right(box_id, 1)) % 4 = 0 THEN text || '~' ELSE text END AS again FROM lab) SELECT CASE WHEN text = again THEN 'OK' ELSE 'MISMATCH' END AS status, count(*) AS n FROM r GROUP BY 1")
def smp2_reentry_status(spark, d):
    again = F.when(F.ascii(F.substring("box_id", -1, 1)) % 4 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    return _labels(spark, d).groupBy(F.when(F.col("text") == again, "OK").otherwise("MISMATCH").alias("status")).agg(F.count("*").alias("n"))


@query(_LAB + ", new AS (SELECT image_path, text || '!' AS text FROM lab WHERE ascii(right(box_id, 1)) % 3 = 0 UNION ALL SELECT 'new__' || image_path, text FROM lab WHERE ascii(right(box_id, 1)) % 5 = 0) SELECT coalesce(n.image_path, l.image_path) AS image_path, coalesce(n.text, l.text) AS text, coalesce(l.writer, 'me') AS writer FROM lab l FULL JOIN new n ON l.image_path = n.image_path")
def jon9_label_upsert(spark, d):
    lab = _labels(spark, d)
    last = F.ascii(F.substring("box_id", -1, 1))
    new = lab.where(last % 3 == 0).select("image_path", F.concat("text", F.lit("!")).alias("new_text")).union(lab.where(last % 5 == 0).select(F.concat(F.lit("new__"), "image_path"), "text"))
    return lab.select("image_path", "text", "writer").join(new, "image_path", "full").select("image_path", F.coalesce("new_text", "text").alias("text"), F.coalesce("writer", F.lit("me")).alias("writer"))


# ---- artefacts and sequences over events


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def win4_keep_last(spark, d):
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return read(spark, d, "events").withColumn("r", r).where("r <= 3").select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_id, (ts, -event_id)) AS event_id FROM events GROUP BY user_id")
def win5_latest_artefact(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", -F.col("event_id"))).alias("event_id"))


@query("""WITH e AS (SELECT user_id, event_id, value >= 50 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
g AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e WHERE on_) SELECT user_id, min(r) AS start, max(r) AS stop, count(*) AS n FROM g GROUP BY user_id, g""")
def win7_islands(spark, d):
    by = W.partitionBy("user_id").orderBy("event_id")
    on = read(spark, d, "events").withColumn("r", F.row_number().over(by)).where("value >= 50")
    return on.withColumn("g", F.col("r") - F.row_number().over(by)).groupBy("user_id", "g").agg(F.min("r").cast("long").alias("start"), F.max("r").cast("long").alias("stop"), F.count("*").alias("n")).drop("g")


@query("SELECT user_id, event_id, round((lag(value, 2, 0) OVER w + 4 * lag(value, 1, 0) OVER w + 6 * value + 4 * lead(value, 1, 0) OVER w + lead(value, 2, 0) OVER w) / 16, 6) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win8_smoothing(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    v = lambda k: F.lag("value", k, 0.0).over(w) if k > 0 else F.lead("value", -k, 0.0).over(w)
    return read(spark, d, "events").select("user_id", "event_id", F.round((v(2) + 4 * v(1) + 6 * F.col("value") + 4 * v(-1) + v(-2)) / 16, 6).alias("smooth"))


@query("SELECT event_type, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.98), 6) AS p98 FROM events GROUP BY event_type")
def agg12_percentiles(spark, d):
    found = quantiles(read(spark, d, "events"), "event_type", "value", {"p2": 0.02, "p50": 0.5, "p98": 0.98})
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("p2", "p50", "p98")))


@query("SELECT 'scans' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'labelled', count(*) FROM labels WHERE quality = 1 UNION ALL SELECT 'checkpoints', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'samples', count(*) FROM events WHERE event_type <> 'click'")
def agg16_status_counts(spark, d):
    """Counts over the tables that stand for the folders of scans, labels, checkpoints and samples."""
    click = F.col("event_type") == "click"
    parts = {"scans": read(spark, d, "documents"), "labels": read(spark, d, "labels"), "labelled": read(spark, d, "labels").where("quality = 1"), "checkpoints": read(spark, d, "events").where(click), "samples": read(spark, d, "events").where(~click)}
    return reduce(DataFrame.union, (t.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, t in parts.items()))


# ---- beyond parity


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def ext_star_join(spark, d):
    t = {n: read(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(t["customer"], F.expr("o_custkey = c_custkey")).join(t["nation"], F.expr("c_nationkey = n_nationkey")).join(t["region"], F.expr("n_regionkey = r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_grouping_sets(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("g"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderkey, rank() OVER w AS r, ntile(4) OVER w AS q, round(percent_rank() OVER w, 9) AS pr, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def ext_rank_frames(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    near = W.partitionBy("o_custkey").orderBy("o_totalprice").rangeBetween(-10000, 10000)
    return read(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("q"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.count("*").over(near).alias("near"))


@query("SELECT 'except' AS op, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def ext_set_ops(spark, d):
    a, b = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return reduce(DataFrame.union, (df.select(F.lit(op).alias("op"), "k") for op, df in (("except", a.exceptAll(b)), ("intersect", a.intersectAll(b)), ("union", a.union(b).distinct()))))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s")
def ext_sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    b = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0)
    s = read(spark, d, "events").withColumn("b", b).withColumn("s", F.sum("b").over(w))
    return s.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("s")


@query("SELECT event_id, (SELECT max(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND (c.ts < e.ts OR (c.ts = e.ts AND c.event_id < e.event_id))) AS last_click FROM events e")
def ext_asof_last_click(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return read(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("ts")), ignorenulls=True).over(w).alias("last_click"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def ext_json_props(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_stream_tumbling(spark, d):
    from ..streaming.tumbling import daily_counts

    return daily_counts(spark, d)


from . import sequence_queries, verdict_queries, review_queries, file_queries, text_queries, series_queries, sheet_queries, layout_queries, pixel_queries, extension_queries  # noqa: E402, F401, I001
