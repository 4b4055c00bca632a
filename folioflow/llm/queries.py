"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import MIX_SQL
from .mtree import TOP_SQL
from .shared import shared_folder, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90).withColumnRenamed("id", "doc_id")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mtree import nearest_by_inner_product

    return nearest_by_inner_product(table(spark, sf_dir, "embeddings"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import severities

    return severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zipwarc import read_archives, write_archives

    path = f"{shared_folder(spark)}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_exact_top_k, op3_benchmark_decontamination, op4_toxicity, op5_mixing_sources, op6_warc, op7_html_extraction, op8_url_filters, op9_quality_classifier, op10_license_scans)}

#: All pairs of documents that share a shingle, by plain joins.
LINK_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 90 * (x.n + y.n - same)),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS c FROM two UNION SELECT two.b, r.c FROM r JOIN two ON two.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: Base 32 takes five hexadecimal digits, twenty bits, as four letters.
WARC_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, payload_bytes, hex, array_to_string(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, i * 5 + 1, 5))::BIGINT) >> s) & 31)::INT + 1, 1)))), '') AS payload_digest FROM d),
l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM l
"""


def _license_sql() -> str:
    """Where each template's shingles stand, and how many of them each window of one and a half templates holds."""
    from .licenses import MIN_CONTAINMENT, TEMPLATES, K, _shingles, _words

    known = [(n, name, _words(text)) for n, (name, text) in enumerate(TEMPLATES)]
    rows = ", ".join(f"({n}, '{name}', {len(w)}, {min(K, len(w))}, '{g}')" for n, name, w in known for g in sorted(set(_shingles(w, min(K, len(w))))))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS t(template, license, words, k, g)), z AS (SELECT template, license, words, k, count(*) AS wanted, ceil(1.5 * words)::BIGINT AS size, greatest(1, words // 2) AS step FROM t GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents), ks AS (SELECT DISTINCT k FROM t),
p AS (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k),
h AS (SELECT DISTINCT p.doc_id, t.template, p.i, t.g FROM p JOIN t ON t.k = p.k AND t.g = array_to_string(w[i + 1 : i + p.k], ' ')),
b AS (SELECT h.*, z.license, z.wanted, step, unnest(range(greatest(0, ceil((i - size + k) / step)::BIGINT), i // step + 1)) AS b FROM h JOIN z USING (template)),
c AS (SELECT doc_id, template, license, b * step AS at_, count(DISTINCT g) / wanted::DOUBLE AS containment FROM b GROUP BY doc_id, template, license, b, step, wanted)
SELECT doc_id, template, license, max(containment) AS containment, arg_max(at_, (containment, -at_))::INT AS "at" FROM c WHERE containment >= {MIN_CONTAINMENT} GROUP BY doc_id, template, license
"""


ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": LINK_SQL, "op2_exact_top_k": TOP_SQL, "op5_mixing_sources": MIX_SQL, "op6_warc": WARC_SQL, "op10_license_scans": _license_sql()}
