"""Queries of sources and sinks: each writes a table, reads it back and returns what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranks import group_starts, numbered, running, running_in_groups
from ..sources import files as S
from ..sources.fixtures import BOX_SQL, boxes, read, synthetic_pages, tokens
from ..sources.stored import shared_path, stored
from .registry import _ALPHA, _BUILT, _LAB, _boxes, _labels, query
from .review_queries import _PACK, _fitting, _packable

_BOXES = "page_key, box_id, x, y, w, h, text, conf, line, word, source, edited, deleted"


@query(_LAB + " SELECT image_path, text, writer FROM lab")
def src3_snk2_label_csv(spark, d):
    path = f"{shared_path(spark)}/labels.csv"
    S.write_csv(_labels(spark, d).select("image_path", "text", "writer"), path, ["image_path"])
    return S.read_csv(spark, path, ["image_path", "text", "writer"])


@query(f"WITH {BOX_SQL} SELECT d.doc_id::VARCHAR AS page_key, coalesce(b.box_id, 'none') AS box_id, coalesce(x, -1) AS x, coalesce(y, -1) AS y, coalesce(w, -1) AS w, coalesce(h, -1) AS h, coalesce(b.text, '') AS text, coalesce(conf, -1) AS conf, coalesce(line, -1) AS line, coalesce(word, -1) AS word, coalesce(b.source, '') AS source, coalesce(edited, false) AS edited, coalesce(deleted, false) AS deleted FROM documents d LEFT JOIN boxes b ON b.page_key = d.doc_id::VARCHAR AND d.doc_id % 10 <> 0")
def src4_page_documents(spark, d):
    """Every tenth page has no document."""
    path = f"{shared_path(spark)}/pages"
    words = tokens(read(spark, d, "documents").where("doc_id % 10 <> 0"), dealt=True)
    S.page_documents(boxes(words)).write.json(path, compression="gzip")
    pages = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("page_key"))
    found = S.with_documents(spark, path, pages).fillna({"box_id": "none"})
    return found.fillna(-1).fillna("").fillna(False).select(*_BOXES.split(", "))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 0 ELSE (doc_id % 4 * 90)::INT END AS degrees FROM documents")
def src5_rotation_map(spark, d):
    """Some maps are broken, some lack the scan."""
    i = F.col("doc_id").cast("string")
    whole = F.concat(F.lit('{"other.jpg": 7, "scan_'), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(i), F.lit('.jpg": '), (F.col("doc_id") % 4 * 90).cast("string"), F.lit("}"))
    raw = F.when(F.col("doc_id") % 7 == 0, "{broken").otherwise(whole)
    return read(spark, d, "documents").select("doc_id", S.rotation(raw, F.concat(F.lit("scan_"), i, F.lit(".jpg"))).alias("degrees"))


@query(f"WITH w AS (SELECT lower(trim(unnest(string_split(replace(text, chr(10), ' '), ' ')), ' ')) AS word FROM benchmark) SELECT DISTINCT word FROM (SELECT word FROM w WHERE word <> '' UNION ALL {_BUILT})")
def src6_dictionary(spark, d):
    path = f"{shared_path(spark)}/words"
    read(spark, d, "benchmark").select(F.explode(F.split("text", r"[ \n]")).alias("w")).select(F.concat(F.lit("  "), F.translate("w", "aeiou", "AEIOU"))).write.text(path)
    return S.dictionary(spark, path)


_PLACEHOLDERS = "ph AS (SELECT word, row_number() OVER (ORDER BY item_id, pos) - 1 AS ord FROM (SELECT item_id, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS t FROM benchmark)) WHERE regexp_full_match(word, '[a-z]+'))"


def _placeholders(spark, d):
    words = read(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"[ \n]")).alias("pos", "word"))
    return numbered(words.where(r"word rlike '\\A[a-z]+\\z'"), ["item_id", "pos"]).select("word", "ord")


@query(f"WITH {_PLACEHOLDERS} SELECT word, ord FROM ph")
def src7_placeholder_words(spark, d):
    return _placeholders(spark, d)


@query(_LAB + f", {_PLACEHOLDERS}, n AS (SELECT count(*) AS n FROM ph), p AS (SELECT image_path, list_reduce(list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256(image_path), i, 1))::BIGINT - 1), lambda a, x: (a * 16 + x) % n) AS ord FROM lab, n) SELECT image_path, word AS text FROM p JOIN ph USING (ord)")
def txt23_placeholder_labels(spark, d):
    """TXT-23: for each crop the word that its name's digest, as a number, picks."""
    words = stored(_placeholders(spark, d))
    n = words.agg(F.count("*").alias("n"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.instr(F.lit("0123456789abcdef"), F.substr("digest", i, F.lit(1))).cast("long") - 1)
    names = _labels(spark, d).select("image_path", F.sha2("image_path", 256).alias("digest")).join(F.broadcast(n))  # one row
    picked = names.select("image_path", F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * 16 + x) % F.col("n")).alias("ord"))
    return picked.join(words, "ord").select("image_path", F.col("word").alias("text"))


_PACKED = _PACK + ", o AS (SELECT *, (sum(len(t)) OVER (ORDER BY image_path ROWS UNBOUNDED PRECEDING) - len(t))::BIGINT AS lb_seek, (sum(img_w) OVER (ORDER BY image_path ROWS UNBOUNDED PRECEDING) - img_w)::BIGINT AS img_seek FROM k)"


def _pack(spark, d):
    """The packed table: one row a sample with lengths and offsets, labels as code points."""
    rows = _packable(spark, d).withColumn("lb_len", F.length("t").cast("long"))
    rows = running(running(rows, ["image_path"], "lb_len", "lb_seek"), ["image_path"], "img_w", "img_seek")
    codes = F.transform(F.filter(F.split("t", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return rows.select("image_path", F.col("img_w").cast("smallint").alias("img_len"), "img_seek", codes.alias("lb"), F.col("lb_len").cast("smallint").alias("lb_len"), "lb_seek", F.col("wid").cast("smallint").alias("wid"))


@query(_PACKED + " SELECT image_path, img_w::INT AS img_len, img_seek, array_to_string(list_transform(string_split(t, ''), lambda c: ord(c)::VARCHAR), ' ') AS codes, len(t)::INT AS lb_len, lb_seek, wid::INT AS wid FROM o")
def snk6_packed_table(spark, d):
    packed = S.published(_pack(spark, d), f"{shared_path(spark)}/packed")
    codes = F.array_join(F.transform("lb", lambda c: c.cast("string")), " ")
    return packed.select("image_path", F.col("img_len").cast("int").alias("img_len"), "img_seek", codes.alias("codes"), F.col("lb_len").cast("int").alias("lb_len"), "lb_seek", F.col("wid").cast("int").alias("wid"))


@query(_PACKED + ", ch AS (SELECT DISTINCT unnest(string_split(t, '')) AS c FROM o) SELECT count(*) AS samples, sum(img_w)::BIGINT AS total_px, round(avg(len(t)), 6) AS avg_len, (SELECT string_agg(c, '' ORDER BY c) FROM ch) AS chars FROM o")
def src8_read_packed(spark, d):
    packed = S.published(_pack(spark, d), f"{shared_path(spark)}/packed")
    chars = packed.select(F.explode("lb").alias("c")).distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.char(c.cast("long"))), "").alias("chars"))
    return packed.agg(F.count("*").alias("samples"), F.sum("img_len").alias("total_px"), F.round(F.avg("lb_len"), 6).alias("avg_len")).join(chars.hint("broadcast"))  # one row each


@query(_PACKED + " SELECT image_path, t AS decoded, true AS same FROM o")
def arr2_round_trip(spark, d):
    """ARR-2: labels read back through offsets into one array of codes a file, compared with what was packed. The file is written in
    blocks. A page's labels follow each other, so that blocks are looked up once for each page, and only codes and keys move."""
    rows = _fitting(spark, d).withColumn("lb_len", F.length("t").cast("long"))
    # paths begin with the page, then "__", which no page key holds: pages follow each other by that
    starts = group_starts(rows, "page_key", F.concat("page_key", F.lit("__")), "lb_len")
    rows = running_in_groups(rows, starts, "page_key", ["box_id"], "lb_len", "lb_seek")
    return S.read_back(rows, starts, S.code_blocks(spark, rows, f"{shared_path(spark)}/codes"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 6 <> 0 THEN 'hit' ELSE 'miss' END AS status, CASE WHEN page_id % 3 = 0 AND page_id % 6 <> 0 THEN len(html) ELSE 0 END AS chars FROM pages")
def src9_jon15_transcript_cache(spark, d):
    """SRC-9, JON-15: pages split by whether the cache holds a transcript of the same content; broken entries count as misses."""
    pages = read(spark, d, "pages").select("page_id", "html", F.sha1(F.concat(F.col("page_id").cast("string"), "html")).alias("content_hash"))
    entry = F.when(F.col("page_id") % 6 == 0, "{oops").otherwise(F.to_json(F.struct(F.col("html").alias("raw"))))
    cache = pages.where("page_id % 3 = 0").select("content_hash", entry.alias("entry"))
    raw = F.from_json("entry", "raw string")["raw"]
    held = pages.select("page_id", "content_hash").join(cache.select("content_hash", raw.alias("raw")), "content_hash", "left")
    return held.select("page_id", F.when(F.col("raw").isNotNull(), "hit").otherwise("miss").alias("status"), F.coalesce(F.length("raw"), F.lit(0)).cast("long").alias("chars"))


@query(f"WITH {BOX_SQL} SELECT page_key, count(*) AS n FROM boxes WHERE word % 2 = 1 GROUP BY page_key")
def snk1_atomic_write(spark, d):
    """A table published twice: readers see the second whole."""
    path, counts = f"{shared_path(spark)}/table", lambda rest: _boxes(spark, d).where(F.col("word") % 2 == rest).groupBy("page_key").agg(F.count("*").alias("n"))
    S.published(counts(0), path)
    return S.published(counts(1), path)


@query(_LAB + " SELECT image_path, CASE WHEN ascii(right(box_id, 1)) % 2 = 0 THEN text ELSE 'second' END AS text FROM lab")
def snk3_append_labels(spark, d):
    """Labelling stopped half way and started again: the second run adds only what is missing."""
    path, lab = f"{shared_path(spark)}/labels", stored(_labels(spark, d).select("image_path", "text", "box_id"))
    S.appended(spark, path, lab.where(F.ascii(F.substring("box_id", -1, 1)) % 2 == 0).select("image_path", "text"), "image_path")
    return S.appended(spark, path, lab.select("image_path", F.lit("second").alias("text")), "image_path")


@query(f"WITH {BOX_SQL}, p AS (SELECT d.source, b.box_id, b.text, b.word, d.source IN (SELECT source FROM documents WHERE doc_id % 9 = 0) AS again FROM boxes b JOIN documents d ON d.doc_id::VARCHAR = b.page_key) SELECT source, box_id, CASE WHEN again THEN upper(left(box_id, 4)) ELSE text END AS text FROM p WHERE NOT again OR word % 3 = 0")
def snk4_snk5_partial_rewrite(spark, d):
    """A partial run rewrites its own sources only, and drops what they held before."""
    docs = read(spark, d, "documents")
    rows = stored(_boxes(spark, d).join(docs.select(F.col("doc_id").cast("string").alias("page_key"), F.col("source").alias("origin")), "page_key").select("box_id", "text", "word", "origin"))
    path = f"{shared_path(spark)}/manifest"
    S.rewritten(spark, path, rows.select("box_id", "text", F.col("origin").alias("source")), "source")
    again = rows.join(docs.where("doc_id % 9 = 0").select(F.col("source").alias("origin")).distinct(), "origin", "left_semi").where("word % 3 = 0")
    return S.rewritten(spark, path, again.select("box_id", F.upper(F.substring("box_id", 1, 4)).alias("text"), F.col("origin").alias("source")), "source")


@query(f"WITH {BOX_SQL} SELECT page_key, box_id, CASE WHEN n >= 3 AND conf >= 0.3 THEN 'green' ELSE 'red' END AS colour, x, y, x + w AS x1, y + h AS y1 FROM (SELECT *, count(*) OVER (PARTITION BY page_key, line) AS n FROM boxes)")
def snk8_debug_overlay(spark, d):
    """SNK-8: the rectangles that a debug picture shows, kept ones green, rejected ones red."""
    from pyspark.sql import Window as W

    b = _boxes(spark, d).withColumn("n", F.count("*").over(W.partitionBy("page_key", "line")))
    colour = F.when((F.col("n") >= 3) & (F.col("conf") >= 0.3), "green").otherwise("red")
    return b.select("page_key", "box_id", colour.alias("colour"), "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))


@query(f"SELECT ch, idx FROM (SELECT unnest(string_split('{_ALPHA}', '')) AS ch, generate_subscripts(string_split('{_ALPHA}', ''), 1) - 1 AS idx)")
def txt22_alphabet_table(spark, d):
    """TXT-22: an alphabet's characters with their places, read from the literal of a source text with escapes."""
    literal = "LETTERS = {'some': 'abc', 'all': '" + T.ALPHABET.replace("\\", "\\\\").replace("'", "\\u0027") + "'}"
    return T.alphabet_table(spark, literal, "all")


@query("SELECT p_partkey, i, 'out/part' || p_partkey || CASE WHEN n > 1 THEN '_p' || lpad(i::VARCHAR, greatest(2, len(i::VARCHAR))::INT, '0') ELSE '' END || '.png' AS path FROM (SELECT p_partkey, p_size % 5 + 1 AS n, unnest(range(1, p_size % 5 + 2)) AS i FROM part)")
def snk7_page_names(spark, d):
    """SNK-7: names of the files that pages are saved as, numbered only if there are several."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    path = S.page_file(F.concat(F.lit("out/part"), F.col("p_partkey").cast("string"), F.lit(".png")), F.col("i"), F.col("n"))
    return p.select("p_partkey", F.col("i").cast("long").alias("i"), path.alias("path"))


@query("SELECT conv_id, turn, 'data: ' || replace(replace(text, chr(10), chr(10) || 'data: '), chr(13), '') || chr(10) || chr(10) AS event FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'data: __DONE__ 0' || chr(10) || chr(10) FROM conversations GROUP BY conv_id")
def snk9_server_events(spark, d):
    """SNK-9: the lines of a run as server-sent events, with its end."""
    t = read(spark, d, "conversations").select("conv_id", "turn", "text")
    done = t.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("text", F.lit("__DONE__ 0"))
    return t.unionByName(done).select("conv_id", "turn", S.server_event(F.col("text")).alias("event"))


@query("SELECT event_id, event_id % 5 IN (0, 1) AS safe FROM events")
def flt20_safe_paths(spark, d):
    """FLT-20: paths below a folder, upward ones and others that only look so."""
    e = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("a/b.png", "a/../b.png", "../secret", "/etc/passwd", "a/../../b"))), (e % 5 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", S.contained(name).alias("safe"))


_QUOTED = """SELECT doc_id, CASE WHEN regexp_full_match(x, '[A-Za-z0-9_@%+=:,./-]+') THEN x ELSE '''' || replace(x, '''', '''"''"''') || '''' END AS quoted FROM (SELECT doc_id, left(text, 40) AS x FROM documents)"""


@query(_QUOTED)
def txt24_shell_quoted(spark, d):
    """TXT-24: the beginnings of documents as words of a shell command."""
    return read(spark, d, "documents").select("doc_id", S.shell_quoted(F.expr("left(text, 40)")).alias("quoted"))


@query("SELECT label, count(*) AS rows_, sum(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))))::BIGINT AS bad, round(sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS norm FROM embeddings GROUP BY label")
def agg18_norms(spark, d):
    """AGG-18: of each label's vectors as one gradient: elements that aren't finite, and the L2 norm."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = read(spark, d, "embeddings").select("label", F.size(F.filter("embedding", bad)).alias("bad"), square.alias("q"))
    return v.groupBy("label").agg(F.count("*").alias("rows_"), F.sum("bad").alias("bad"), F.round(F.sqrt(F.sum("q")), 5).alias("norm"))


@query("SELECT event_id, event_id % 25 = 0 AND event_id > 0 AS sample, event_id % 100 = 0 AND event_id > 0 AS checkpoint, event_id // 8 AS batches FROM events")
def mdl1_schedule(spark, d):
    """MDL-1, the part that is a query: at which steps a run samples and saves, and how many whole batches so many samples make."""
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", ((e % 25 == 0) & (e > 0)).alias("sample"), ((e % 100 == 0) & (e > 0)).alias("checkpoint"), F.floor(e / 8).alias("batches"))


_SAID = ("Small pages teach a patient reader.", "Each line knows the words it holds.", "Slanted photos bend what was level.", "A crop should end where the word ends.", "Truth is kept beside every picture.")


def _turned(k: int) -> str:
    x, y = (f"({a}{f' + {b}' if k in on else ''})" for a, b, on in (("x", "w", (1, 2)), ("y", "48", (2, 3))))
    c, s, dx, dy = "cos(radians(4.5))", "sin(radians(4.5))", f"({x} - 850.0)", f"({y} - 1100.0)"
    return f"round({c} * {dx} + {s} * {dy} + 850.0, 6) AS x{k}, round(-{s} * {dx} + {c} * {dy} + 1100.0, 6) AS y{k}"


@query("WITH l AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_SAID, 1)) + f") AS t(line, content)), w AS (SELECT line, unnest(string_split(content, ' ')) AS text, generate_subscripts(string_split(content, ' '), 1) AS word, content FROM l), p AS (SELECT line, word, text, 140 + (line * 7 % 5 - 2) + 24 * (len(array_to_string(string_split(content, ' ')[1:word - 1], ' ')) + CASE WHEN word > 1 THEN 1 ELSE 0 END) AS x, 260 + (line - 1) * 90 + line * 3 % 5 - 2 AS y, len(text) * 24 AS w FROM w) SELECT line, word::INT AS word, text, {', '.join(_turned(k) for k in range(4))} FROM p")
def src14_synthetic_page(spark, d):
    return synthetic_pages(spark, list(_SAID), 4.5)
