"""The corpus pipeline against brute force, with repeated rows, null ids and ids that stand for two texts."""

from collections import Counter

import pytest

pytest.importorskip("folioflow.llm")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table_rows():
    base, other = words(80, 1), words(80, 2)
    near = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in (0, 79)]
    texts = [(1, " ".join(base)), (1, " ".join(base)), (2, near[0]), (3, near[1]), (None, near[1]), (None, near[1])]
    texts += [(None, " ".join(other)), (None, " ".join(other)), (7, " ".join(words(50, 3))), (7, near[0]), (8, None), (8, None), (9, " "), (None, "")]
    texts += [(20 + i, " ".join(words(60, 20 + i))) for i in range(30)] + [(5, "a b"), (5, "a b"), (4, "A b")]
    return [(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(texts)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def one_of_each_group(rows):
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = {}
    for n, r in enumerate(rows):
        groups.setdefault(find(n), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def known(rows):
    return Counter((r[0], (r[1] or "").lower()) for r in rows)


def test_near_duplicates(spark):
    rows = table_rows()
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()]
    want = one_of_each_group(rows)
    assert known(got) == known(want) and len(want) == len(rows) - 9
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_pipeline(spark, tmp_path):
    rows = table_rows()
    item = " ".join(words(60, 25))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(20 + i, i % 2, i % 4 == 0) for i in range(20)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = corpus_pipeline.quality(spark, corpus_pipeline.toxicity(spark, docs, str(tmp_path)), str(tmp_path))
    want = [r for r in one_of_each_group([tuple(r) for r in judged.collect()]) if item not in (r[1] or "")]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert want and Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in want)


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, tmp_path):
    """Columns that bear the names of the operators' own results, nulls everywhere, and no rows at all."""
    extra = "score double, grade int, toxic boolean, severity string, component_id long, hit int, text_ string"
    rows = [(*r, 0.5, 1, None, "s", 7, None, None) for r in table_rows()] + [(None,) * 12]
    spark.createDataFrame([(1, " ".join(words(60, 25)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(20 + i, i % 2, int(i % 4 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, f"{DOCS}, {extra}").repartition(2)
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        found = Counter(map(tuple, kept.collect()))
        assert found and not found - Counter(map(tuple, rows))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.mixing(spark, docs, "").count() == len(rows) and corpus_pipeline.mixing(spark, docs.limit(0), "").count() == 0
