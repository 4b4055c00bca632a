"""The ten operators against brute force on small tables, with nulls, blanks, ties, repeated rows and empty tables."""

import base64
import hashlib
import os
import random
import time
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("folioflow.llm")

from folioflow.llm import components, decontaminate, html_text, jaccard_join, labelled, licenses, mixing, mtree, quality, toxicity, url_filter, zipwarc  # noqa: E402
from folioflow.llm.components import connected_components  # noqa: E402
from folioflow.llm.jaccard_join import jaccard_components  # noqa: E402

DOCS = "doc_id long, text string, source string, score double, n int"


def docs(spark, rows):
    """Columns score and n clash with the operators' own names."""
    return spark.createDataFrame([(i, t, s, 0.0, 1) for i, t, s in rows], DOCS)


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize("edges", [0, 1 << 18])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "LOCAL_EDGES", edges)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3)] + [(100, i) for i in range(101, 160)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in (1, 2, 3, 8, 9)} == {1} and got[5] == got[4] == 4 and 7 not in got and {got[i] for i in range(100, 160)} == {100}


def linked(rows, k, percent):
    """Components by comparing all pairs."""
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [3, 8])
def test_jaccard_of_families_of_many_blocks(spark, monkeypatch, block):
    """Chains of texts of growing length, copies of one text with words changed, and words that a third of all texts hold."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    r, base, rows = random.Random(2), words(60, 1, 10**6), []
    for i in range(70):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(60)] = f"y{r.randrange(6)}"
        rows.append((i, " ".join(w), "a"))
    chain = words(200, 3, 10**6)
    rows += [(100 + i, " ".join(chain[: 30 + 5 * i]), "a") for i in range(30)]
    rows += [(200 + i, " ".join([*base[:12], *words(20, 900 + i, 10**6)]), "a") for i in range(40)]
    rows += [(300 + i, rows[i][1], "a") for i in range(20)]
    got = {x.id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs(spark, rows).repartition(5), k=3, percent=80).collect()}
    want = linked(rows, 3, 80)
    assert got == want and len({c for _, c in want.values()}) > 45


def test_jaccard(spark):
    base = words(80, 1)
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]]), "a") for i in range(0, 80, 8)]
    rows += [(200 + i, " ".join(words(60, 50 + i)), "a") for i in range(10)] + [(300, "one two", "a"), (301, "ONE\ttwo", "b"), (302, None, None), (303, " ", "a"), (304, "", "a"), (305, "one two", "a")]
    rows += [(1000, " ".join(words(60_000, 8, 10**6)), "a"), (1001, " ".join(words(60_000, 8, 10**6)) + " end", "b")]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, rows), k=3, percent=90).collect()}
    assert got == linked(rows, 3, 90) and got[1001][1] == 1000
    again = jaccard_components(docs(spark, rows[:9] + rows[:9] + [(None, rows[0][1], "a")]), k=3, percent=90).collect()
    assert len(again) == 18 and {(r.id, r.component_id) for r in again} == {(i, c) for i, (_, c) in linked(rows[:9], 3, 90).items()}
    assert jaccard_components(docs(spark, rows).limit(0)).count() == 0


def test_top_k_of_repeated_and_odd_vectors(spark):
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot, i, i) for i in range(300)] + [(1000 + i, [float(i), 1.0, 0.0], 0, 0) for i in range(20)] + [(2000, [float("inf"), 0.0, 0.0], 0, 0), (2100, [float("-inf")], 0, 0), (2200, [], 0, 0), (2300, [1.0], 0, 0), (1000, [3.0, 1.0, 0.0], 0, 0), (None, hot, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long, rank int")
    got = {}
    for r in mtree.nearest_by_inner_product(df, trees=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ints = [(i, np.floor(1024 * np.array((v + [0.0] * 3)[:3]))) for i, v, *_ in rows if i is not None and i not in (2000, 2100)]
    for q in {i for i, _ in ints if i % 100 == 0}:
        for own in [v for i, v in ints if i == q][:1]:
            best = sorted((-int(own @ v), i) for i, v in ints if i != q)[:10]
            if q != 1000:  # two vectors of one id are two queries
                assert got[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(best)}
    with pytest.raises(ValueError):
        mtree.nearest_by_inner_product(spark.createDataFrame([(1, [3e7]), (2, [3e7])], "vec_id long, embedding array<double>")).count()


def test_top_k(spark):
    r = np.random.default_rng(3)
    x = [(i, [float(v) for v in r.normal(size=6)]) for i in range(350)] + [(400 + i, [1.0] * 6) for i in range(40)] + [(900, None), (901, [float("nan")] * 6), (902, [None, 1.0])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    got = {(q.query_id, q.rank): (q.vec_id, q.score) for q in mtree.nearest_by_inner_product(df, trees=3).collect()}
    ints = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in x[:-3]}
    want = {}
    for q in (i for i in ints if i % 100 == 0):
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:10]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert mtree.nearest_by_inner_product(df.limit(0)).count() == 0


def test_decontamination(spark):
    item = "The river rose above its banks in spring again. Nobody in the valley had expected so much water there."
    bench = spark.createDataFrame([(1, item), (2, " ".join(words(30, 9)) + "."), (3, None), (4, "")], "item_id long, text string")
    long = " ".join(words(3000, 5))
    rows = [(1, f"{long} {item.upper()} {long}", "a"), (2, long, "a"), (3, None, "a"), (4, item[:40], "a"), (5, "", "a"), (1, item, "a")]
    found = [(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(spark, rows), bench).collect()]
    assert sorted(found) == [(1, 1), (1, 1)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs(spark, rows), bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminations(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_short_last_sentences(spark):
    question = " ".join(words(30, 11)) + ". " + " ".join(words(14, 12)) + "."
    bench = spark.createDataFrame([(1, f"{question} Yes."), (2, " ".join(words(40, 13)) + ". One two three four five six seven eight."), (3, "Why so? " + " ".join(words(40, 14)) + "."), (4, "+ - *")], "item_id long, text string")
    rows = [(1, f"x {question} Yes, and more", "a"), (2, f"“{question} yes”", "a"), (3, f"{question} No.", "a")]
    rows += [(4, " ".join(words(40, 13)) + ". One two three four five six seven nine", "a"), (5, "How so? " + " ".join(words(40, 14)), "a")]
    rows += [(9, " ".join(words(40, 13)) + ". One two three X five six seven eight.", "a"), (10, f"{question} Answer: yes", "a")]
    rows += [(6, " ".join(words(20, 11)), "a"), (7, "x + - * y", "a"), (8, " ".join(words(40, 13)) + ". " + " ".join(words(8, 99)), "a")]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(spark, rows), bench).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (7, 4), (9, 2), (10, 1)]


def test_wand_equals_brute_force():
    r = random.Random(4)
    index = decontaminate.Index([(i, " ".join(words(12, i, 60))) for i in range(80)])
    for _ in range(60):
        terms = np.array(sorted(r.sample(range(len(index.terms)), 25)))
        total = np.zeros(80)
        for t in terms:
            total[index.items[t]] += index.impacts[t]
        got = index.search(terms, 0.4)
        assert [i for i, _ in got] == np.flatnonzero(total >= 0.4 - 1e-9).tolist()
        assert np.allclose([s for _, s in got], total[[i for i, _ in got]])


@pytest.mark.parametrize("dense", [1, 10**9])
def test_hopeful_passes_all_that_brute_force_finds(monkeypatch, dense):
    monkeypatch.setattr(decontaminate, "DENSE_ITEMS", dense, raising=False)
    twin = " ".join(words(14, 7, 10**6))
    items = [" ".join(words(12, i, 300)) for i in range(200)] + [twin] * 8 + [" ".join(words(8, 500 + i, 4)) for i in range(60)]
    index = decontaminate.Index(list(enumerate(items)))
    passages = [" ".join(words(60, 900 + i, 300)) for i in range(40)] + [f"{' '.join(words(50, 950 + i, 10**5))} {items[i * 13 % len(items)]}" for i in range(60)] + [f"so {twin} it", items[-1], ""]
    own = decontaminate.Words(decontaminate.pa.array(passages))
    term, end = index.find(own.hash), np.cumsum(own.count)
    got = index.hopeful(term, end - own.count, end, 0.75)
    for w, (a, b) in enumerate(zip(end - own.count, end)):
        total = np.zeros(len(items))
        for t in set(term[a:b].tolist()) - {-1}:
            total[index.items[t]] += index.impacts[t]
        assert got[w] or not (total >= 0.75).any(), w
    assert got[-3] and got[-2]


def test_decontamination_of_repeated_items_by_either_branch(monkeypatch):
    twin = " ".join(words(40, 7, 10**6)) + "."
    bench = [(i, " ".join(words(40, 100 + i, 10**6))) for i in range(100)] + [(200 + i, twin) for i in range(6)]
    found = {}
    for dense in (1, 10**9):
        monkeypatch.setattr(decontaminate, "DENSE_ITEMS", dense, raising=False)
        texts = decontaminate.pa.array([f"so {twin} it", " ".join(words(400, 3))])
        found[dense] = sorted((r, i) for r, i, *_ in decontaminate._matches(texts, decontaminate.indexed(bench)))
    assert found[1] == found[10**9] == [(0, 200 + i) for i in range(6)]


def test_decontamination_shards_and_lengths_change_nothing(spark, monkeypatch):
    items = [(i, " ".join(words(12 + 9 * (i % 7), i, 300)) + ".") for i in range(60)] + [(100 + i, " ".join(words(700 + 90 * i, 70 + i, 900))) for i in range(3)] + [(200, items_text) for items_text in [None, ""]]
    rows = []
    for n, (_, text) in enumerate(items[:63]):
        w = text.split()
        held = [x for j, x in enumerate(w) if n % 3 == 0 or j % (5 if n % 3 == 1 else 17)]
        rows.append((n, " ".join([*words(200, 400 + n, 5000), *held, *words(300, 500 + n, 5000)]), "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap) for r in decontaminate.contaminations(docs(spark, rows), bench).collect())

    whole = found()
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 4000)
    assert decontaminate._shards(bench)[0] > 3 and found() == whole and {d for d, *_ in whole} >= set(range(0, 63, 3))
    kept = {r.doc_id for r in decontaminate.decontaminated(docs(spark, rows), bench).collect()}
    assert kept == {i for i, *_ in rows} - {d for d, *_ in whole}


def test_decontamination_equals_brute_force(spark):
    """BM25 of every window of twice 64 words by plain loops, then shares of 5-word shingles."""
    import math

    items = [(i, " ".join(words(30 + i % 5, i, 60))) for i in range(30)]
    rows = []
    for n in range(60):
        w = items[n % 30][1].split()
        kept = [x if (j * 7 + n) % 40 else "zz" for j, x in enumerate(w)] if n % 2 else w[: 10 + n % 25]
        rows.append((n, " ".join([*words(150, 900 + n, 60), *kept, *words(40, 950 + n, 60)]), "a"))
    bags = [t.split() for _, t in items]
    mean = sum(map(len, bags)) / len(bags)
    df = {t: sum(t in b for b in bags) for b in bags for t in b}

    def weight(t, bag):
        tf = bag.count(t)
        return math.log1p((len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))

    def grams(w):
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    own = [sum(weight(t, b) for t in set(b)) for b in bags]
    want = set()
    for n, text, _ in rows:
        w = text.split()
        ends = [w[a : a + 128] for a in range(0, max(1, len(w) - 64), 64)]
        for (i, _), bag, full in zip(items, bags, own):
            best = max(sum(weight(t, bag) for t in set(bag) & set(x)) / full for x in ends)
            share = len(grams(bag) & grams(w)) / len(grams(bag))
            first, last = (len(grams(h) & grams(w)) / len(grams(h)) for h in (bag[:29], bag[-29:]))
            if best >= 0.75 and max(share, first) >= 0.8 and max(share, last) >= 0.8:
                want.add((n, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 10 < len(want) < 60


def test_models_are_learnt_by_a_task(spark):
    """The sample's features stay out of the driver: learn() runs once, in a worker, on all rows in their order."""
    df = spark.createDataFrame([(i, " ".join(words(20, i))) for i in range(60)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")

    def learn(rows):
        return [np.array([os.getpid()]), np.array([label for label, *_ in rows]), np.array([idx.sum() + count.sum() for _, idx, count, _ in rows])]

    got = [labelled.learnt(docs, labels, "toxic", toxicity.terms, toxicity.BITS, 40, learn) for docs in (df, df.repartition(2), df.limit(0))]
    assert got[0][0] != os.getpid() and len(got[0][1]) == 40 and len(got[2][1]) == 0
    assert all((a == b).all() for a, b in zip(got[0][1:], got[1][1:]))


def test_sampled_texts_are_taken_in_small_slices(spark):
    """A worker makes features of at most 256 KB of texts at a time, whatever the size of Spark's batches."""
    df = spark.createDataFrame([(i, "word " * 4000) for i in range(200)], "doc_id long, text string").repartition(1)
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")

    def features(words):
        return np.arange(words.n_docs), np.full(words.n_docs, len(words.data), np.uint64) << np.uint64(40)

    def learn(rows):
        return [np.array([int(idx[0]) for _, idx, *_ in rows])]

    (seen,) = labelled.learnt(df, labels, "toxic", features, 24, 200, learn)
    assert len(seen) == 200 and 20_000 <= seen.max() <= 1 << 18


@pytest.mark.parametrize("model", ["toxicity", "quality"])
def test_classifiers(spark, model):
    rows = [(i, " ".join(words(40, i) + (["vile", "vile", "scoundrel"] if i % 4 == 0 else [])), "a") for i in range(240)] + [(900, None, "a"), (901, "", "a")]
    label = {"toxicity": lambda i: int(i % 4 == 0), "quality": lambda i: int(i % 4 != 0)}[model]
    labels = spark.createDataFrame([(i, label(i), label(i)) for i in range(160)], "doc_id long, toxic int, quality int")
    df = docs(spark, rows)
    got = toxicity.severities(df, labels) if model == "toxicity" else quality.quality_scores(df, labels)
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == 242
    right = [(got[i].toxic if model == "toxicity" else got[i].score >= 0.5) == bool(label(i)) for i in range(160, 240)]
    assert np.mean(right) >= 0.9
    empty = labels.limit(0)
    assert (toxicity.severities(df, empty) if model == "toxicity" else quality.quality_scores(df, empty)).count() == 242


def test_scores_equal_plain_loops(spark):
    """Toxicity grades and quality scores of the trained weights, feature by feature."""
    import math

    rows = [(i, " ".join(words(40, i) + (["Vile,", "vile", "scoundrel"] * (i % 3) if i % 4 == 0 else [])), "a") for i in range(120)] + [(900, None, "a"), (901, " ", "a"), (902, "long " * 300_000, "a"), (5, words(3, 1)[0], "a")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0)) for i in range(90)] + [(7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, toxic int, quality int")
    df = docs(spark, rows)
    weights, t = toxicity.train(df, labels)
    graded = {(x.doc_id, x.text): x for x in toxicity.severities(df, labels, keep=("doc_id", "text")).collect()}
    bias = quality.train(df, labels)
    scored = {(x.doc_id, x.text): x.score for x in quality.quality_scores(df, labels, keep=("doc_id", "text")).collect()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    for i, text, _ in rows:
        own = toxicity.Words(toxicity.pa.array([text]), toxicity.PUNCT)
        seen = Counter(int(f) >> (64 - toxicity.BITS) for f in toxicity.terms(own)[1].tolist())
        s = sum(float(weights[f]) * math.log2(1 + n) for f, n in seen.items())
        over = [1 - sig(x - s) for x in t]
        share = [1 - over[0], *(a - b for a, b in zip(over, over[1:])), over[-1]]
        r = graded[i, text]
        assert abs(r.severity - sum(over)) < 1e-4 and r.grade == max(range(len(share)), key=lambda k: share[k]) and r.toxic == (over[0] > 0.5)
        own = quality.Words(quality.pa.array([text]))
        grams = [int(f) >> (64 - quality.BITS) for f in quality.ngrams(own)[1].tolist()]
        want = sig(float(bias[-1]) + quality.SCALE * sum(float(bias[f]) for f in grams) / max(1, len((text or "").split())))
        assert abs(scored[i, text] - want) < 1e-4
    named = spark.createDataFrame([(str(i), t) for i, t, _ in rows], "doc_id string, text string")
    by_name = labels.withColumn("doc_id", labels.doc_id.cast("string"))
    assert toxicity.severities(named, by_name).count() == quality.quality_scores(named, by_name).count() == len(rows)
    assert toxicity.severities(df.limit(0), labels).count() == quality.quality_scores(df.limit(0), labels).count() == 0


def test_mixing_of_empty_and_repeated_rows(spark):
    assert mixing.mixture(docs(spark, []).limit(0)).count() == 0
    assert {(r["size"], r.taken, r.target) for r in mixing.mixture(docs(spark, [(1, None, "a"), (2, " ", None)])).collect()} == {(0, 0, 0.0)}
    rows = [(1, "a b c", "x")] * 3 + [(2, "d e f g", "y"), (None, "h i", "y")]
    out = mixing.mixture(docs(spark, rows)).collect()
    assert len(out) == 5 and all(0 <= r.taken <= 2 * r["size"] for r in out)


def test_mixing(spark):
    rows = [(i, " ".join(words(50 + i % 7, i)), ["a", "b", "c", None][i % 4 if i < 40 else 0]) for i in range(200)] + [(500, None, "z"), (501, "", "z")]
    out = mixing.mixture(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    taken, target = {}, {}
    for r in out:
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
        target[key] = r.target
    assert all(abs(taken[k] - target[k]) <= 128 for k in target)
    assert out == mixing.mixture(docs(spark, rows)).collect() or sorted(map(str, out)) == sorted(map(str, mixing.mixture(docs(spark, rows)).collect()))


@pytest.mark.parametrize("slots", [1 << 20, 1 << 9])
def test_mixing_of_sources_below_a_block(spark, monkeypatch, slots):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    rows = [(i, " ".join(words(3 + i % 9, i)), f"s{i:04}") for i in range(2000)] + [(5000 + i, " ".join(words(60, i)), "t") for i in range(150)]
    _, pieces = mixing.mixed(docs(spark, rows))
    used = [(r.slot, r.k) for r in pieces.where("slot is not null").select("slot", "k").distinct().collect()]
    assert len(used) == len({s for s, _ in used})
    taken, target = {}, {}
    for r in pieces.select("k", "target", "length").collect():
        taken[r.k], target[r.k] = taken.get(r.k, 0) + (r.length or 0), r.target
    few = [k for k in target if slots < 1 << 20 or k != "st"]
    assert len(target) == 2001 and {k: taken[k] for k in few} == {k: int(target[k]) for k in few}


@pytest.mark.parametrize("wide", [False, True])
def test_zip_round_trip(wide):
    data = zipwarc.zip_bytes([("a", b"x" * 1000), ("dir/ü", b""), ("PK\x05\x06", b"PK\x05\x06")], comment=b"\n", zip64=wide)
    at = zipwarc.directory(zipwarc.Range(data))
    assert {n: data[o : o + k] for n, (o, k) in at.items()} == {"a": b"x" * 1000, "dir/ü": b"", "PK\x05\x06": b"PK\x05\x06"}


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "é\r\n\r\nz")]
    zipwarc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = {r.page_id: r for r in zipwarc.read_archives(spark, f"{tmp_path}/w").collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert [(got[i].record_type, got[i].refers_to) for i in range(1, 6)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None)]
    assert bytes(got[5].payload).decode() == "é\r\n\r\nz"


def test_warc_of_odd_rows(spark, tmp_path):
    rows = [(None, None, "same", "x"), (7, "u", "same", "x"), (7, "u", "same", "x"), (3, "v", "same", "x"), (None, "w", None, "x"), (5, "l", "long " * 400_000, "x")]
    folder = f"{tmp_path}/a folder/ünï"
    zipwarc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string").repartition(2), folder)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in zipwarc.read_archives(spark, folder).collect()), key=str)
    assert got == sorted([(None, "revisit", 7, 4), (7, "response", None, 4), (7, "response", None, 4), (3, "revisit", 7, 4), (None, "response", None, 0), (5, "response", None, 2_000_000)], key=str)
    empty = f"{tmp_path}/empty"
    zipwarc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert zipwarc.read_archives(spark, empty).count() == 0
    small = f"{tmp_path}/small"
    zipwarc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string"), small, min_bytes=5)
    assert {r.record_type for r in zipwarc.read_archives(spark, small).collect()} == {"response"}


def test_html():
    page = "<head><title>t</title></head><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four<script>x</script><div class='ad'>buy</div><p>five</article><section class=comments>hi</section><footer>f</footer>"
    assert html_text.blocks(page) == (["A & B", "one two three", "four", "five"], False)
    assert html_text.blocks(None) == ([], True)


def test_html_marks():
    def text(page):
        return html_text.blocks(page)[0]

    assert text('<main><p>Real story text</p><article class="comment">nice!</article></main>') == ["Real story text"]
    assert text('<article><h2 id="share-prices">Up</h2><p class="related-work">It was</p><p class="ad">buy</p><div class="ad-slot">x</div></article>') == ["Up", "It was"]
    assert text("<main><h1>One</h1><article><p>two</p></article><p>three</p></main><p>four</p>") == ["One", "two", "three"]
    assert text('<div class="has-sidebar"><article><p data-id="ad">a < b &lt; c</p></article></div>') == ["a < b < c"]
    assert text("<article><p title='5 > 4'>a</p><p title=don't>b</p><!-- x --><p>c<") == ["a", "b", "c<"]


@pytest.mark.parametrize("page", ["<a " * 10**6, '<a x="' * 10**6 + ">", "<script></script" * 10**5, "<!--" * 10**6, "<p class" * 10**5 + ">", "<" * 10**6, '<a ="' * 10**5 + "'>" * 10**5])
def test_html_is_read_in_linear_time(page):
    began = time.time()
    html_text.blocks(page)
    assert time.time() - began < 15


def test_suffix_array_equals_sorting():
    r = random.Random(8)
    for size, kinds in ((1, 1), (40, 2), (300, 3), (500, 40)):
        tokens = [*(r.randrange(kinds) for _ in range(size)), 99]
        sa, levels = html_text.suffix_array(np.array(tokens))
        assert sa.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])
        common = html_text.common_prefixes(sa, levels, 4)
        for a, b, got in zip(sa[:-1], sa[1:], common[1:]):
            n = 0
            while a + n < len(tokens) and b + n < len(tokens) and tokens[a + n] == tokens[b + n]:
                n += 1
            assert got == (n if n >= 4 else 0)


@pytest.mark.parametrize("shard", [400, 100_000])
def test_html_equals_brute_force(spark, monkeypatch, shard):
    """Every run of RUN tokens of every page is looked for in all other pages of its host; whole blocks of articles too."""
    monkeypatch.setattr(html_text, "SHARD_BYTES", shard)
    r = random.Random(5)
    pool = [" ".join(words(r.choice([3, 9, 14]), 700 + i, 10**6)) for i in range(12)]
    note = " ".join(words(10, 699, 10**6))
    rows = []
    for i in range(60):
        parts = [" ".join([*words(5, 10 * i + j, 10**6), r.choice(pool), *words(r.randrange(6), 5000 + 10 * i + j, 10**6)]) if r.random() < 0.5 else r.choice(pool) if r.random() < 0.6 else " ".join(words(25, 9000 + 10 * i + j, 10**6)) for j in range(6)]
        page = "".join(f"<p>{x}</p>" for x in ([note] if i % 3 != 2 and i % 2 == 0 else []) + parts)
        rows.append((i, f"http://{'ab'[i % 2]}.org/{i}", f"<article>{page}</article>" if i % 3 != 2 else page))
    rows += [(100 + i, f"http://a.org/x{i}", rows[2][2]) for i in range(4)]
    got = {x.page_id: x.text for x in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    pages = {}
    for i, url, page in rows:
        found, opened = html_text.blocks(page)
        tokens = [t for b in found for t in (*b.split(), "\n")]
        units = [tuple(tokens[a : a + 8]) for a in range(len(tokens) - 7)] if opened else [tuple(b.split()) if len(b.split()) >= 8 else None for b in found]
        pages[i] = (url.split("/")[2], tuple(found), opened, tokens, units)
    for i, (host, found, opened, tokens, units) in pages.items():
        every = {(p[1], p[2]): p for p in pages.values() if p[0] == host}.values()
        sets = [set(p[4]) for p in every if p[2] == opened]
        count = {n: c for n, u in enumerate(units) if u and (c := sum(u in s for s in sets)) >= 3 and (opened or 2 * c > len(every))}
        gone = html_text._repeated([1] * len(units) if opened else [len(b.split()) for b in found], count)
        if opened:
            cover = {n + j for n in gone for j in range(8)}
            left = " ".join("\n" if t == "\n" else t for n, t in enumerate(tokens) if t == "\n" or n not in cover)
            want = "\n".join(x.strip() for x in left.split("\n") if x.strip())
        else:
            want = "\n".join(b for n, b in enumerate(found) if n not in gone)
        assert got[i] == want, i
    for kind in (True, False):
        assert any(got[i] != "\n".join(p[1]) for i, p in pages.items() if p[2] == kind)


def test_html_of_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, text string, shard int, page_key string"
    rows = [(None, None, None, "h", "t", 1, "k"), (1, "http://a.b/", "", "h", "t", 1, "k"), (1, "http://a.b/", "", "h", "t", 1, "k"), (2, "http://a.b/2", "<p>" + "long " * 200_000 + "</p>", "h", "t", 1, "k")]
    frame = spark.createDataFrame(rows, schema)
    got = sorted(((r.page_id or 0, r.n_chars) for r in html_text.main_texts(frame).collect()))
    assert got == [(0, 0), (1, 0), (1, 0), (2, 999_999)]
    assert html_text.main_texts(frame.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and html_text.main_texts(frame.limit(0)).count() == 0


def test_html_boilerplate(spark):
    note = "Sign up for our weekly letter and never miss a story again okay"
    rows = [(i, f"http://a.b/{i}", f"<div>{note}</div><p>" + " ".join(f"p{i}w{j}" for j in range(20))) for i in range(4)]
    for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == " ".join(f"p{r.page_id}w{j}" for j in range(20)) and r.n_chars == len(r.text)


def test_html_copies_keep_their_text(spark):
    note = "Sign up for our weekly letter and never miss a story again okay"

    def text(i):
        return " ".join(f"p{i}w{j}" for j in range(30))

    rows = [(i, f"http://a.b/{i}", f"<title>{i}</title><div>{note}</div><p>{text(i)}") for i in range(4)]
    rows += [(10 + i, f"http://a.b/c{i}", f"<title>{i}</title><div>{note}</div><p>{text(10)}") for i in range(4)]  # copies
    rows += [(20 + i, f"http://a.b/n{i}", f"<div>{note}</div><p>{text(20)} n{i}") for i in range(3)]  # near copies
    rows += [(30 + i, [None, "a/b", "mailto:x"][i % 3], f"<p>{text(30)}") for i in range(6)]  # no host
    rows += [(40 + i, f"c.org/{i}", f"<div>{note}</div><p>{text(40 + i)}") for i in range(3)] + [(50, "d.org/", f"<div>{note}</div><p>{text(50)}")]
    want = {i: text(i) for i in range(4)} | {10 + i: text(10) for i in range(4)} | {20 + i: f"{text(20)} n{i}" for i in range(3)} | {30 + i: text(30) for i in range(6)} | {40 + i: text(40 + i) for i in range(3)} | {50: f"{note}\n{text(50)}"}
    frame = spark.createDataFrame(rows + rows[4:5], "page_id long, url string, html string")
    got = html_text.main_texts(frame).collect()
    assert len(got) == len(rows) + 1 and {r.page_id: r.text for r in got} == want


def test_html_boilerplate_inside_articles(spark):
    note = "This site keeps small files on your device so that pages load faster"

    def text(i):
        return " ".join(f"p{i}w{j}" for j in range(40))

    quote = "a quotation of eight words that all hold"
    rows = [(i, f"http://a.b/{i}", f"<article><p>{note.upper() if i == 1 else note}</p><p>{quote} {text(i)}</p><p>Read more</p></article>") for i in range(3)]
    rows += [(10 + i, f"http://e.f/c{i}", f"<main><p>{text(10)}</p><p>c{i}</p></main>") for i in range(3)]  # near copies
    rows += [(20 + i, f"http://c.d/{i}", f"<article><p>{note}</p><p>{text(20 + i)}</p></article>") for i in range(2)]
    rows += [(30 + i, f"http://g.h/{i}", f"<article><p>{note if i < 4 else text(80 + i)}</p><p>{text(30 + i)}</p></article>") for i in range(9)]  # a line of some articles
    want = {i: f"{quote} {text(i)}\nRead more" for i in range(3)} | {10 + i: f"{text(10)}\nc{i}" for i in range(3)} | {20 + i: f"{note}\n{text(20 + i)}" for i in range(2)}
    want |= {30 + i: f"{note if i < 4 else text(80 + i)}\n{text(30 + i)}" for i in range(9)}
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize("shard", [60, 100_000])
def test_html_shards_change_nothing(spark, monkeypatch, shard):
    monkeypatch.setattr(html_text, "SHARD_BYTES", shard)
    test_html_boilerplate(spark)
    test_html_copies_keep_their_text(spark)
    test_html_boilerplate_inside_articles(spark)


def test_urls(spark):
    urls = ["http://example.org/es/1", "http://A.EXAMPLE.org/en/12?x#y", "http://example.org/en/2", "https://m.x.com/fr/a", "http://x.com/de/b", "x.com/de", None, "", "http://x.net/q"]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(9)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert (got[1].host, got[1].path) == ("a.example.org", "/en/12") and (got[5].host, got[6].host, got[7].path) == ("", "", "")


def test_url_scores_equal_brute_force(spark):
    """Witten and Bell's mixture of one to three characters by plain loops, and the threshold of least error."""
    import math

    r = random.Random(9)
    pages = ["http://www.a.org/" + "".join(r.choice("abcdefg/") for _ in range(r.randrange(1, 12))) for _ in range(40)]
    pages += ["http://x.com/de/" + "".join(r.choice("fghijk-%") for _ in range(r.randrange(1, 12))) for _ in range(40)]
    pages += ["https://n.net/" + "".join(r.choice("abcdefghijk/É") for _ in range(9)) for _ in range(40)] + [None, "", "x" * 5000, "http://n.net/q"]
    got = {x.page_id: x for x in url_filter.judged(spark.createDataFrame([(i, u, 0.0, "t") for i, u in enumerate(pages)], "page_id long, url string, score double, t string")).collect()}
    a = url_filter.A

    def codes(url):
        s = [url_filter.ALPHABET.find(c.lower() if c.isascii() else c) + 1 for c in url or ""]
        return list(zip([a - 1, a - 1, *s], [a - 1, *s], s))

    counts = {label: [Counter(), Counter(), Counter()] for label in ("allow", "block")}
    for i, u in enumerate(pages):
        if got[i].rule:
            for x in codes(u):
                for k in range(3):
                    counts[got[i].verdict][k][x[2 - k :]] += 1

    def chance(label, x):
        p = 1 / a
        for k in range(3):
            seen = {y: n for y, n in counts[label][k].items() if y[:-1] == x[2 - k : 2]}
            total, kinds = sum(seen.values()), len(seen)
            if total:
                p = (seen.get(x[2 - k :], 0) + kinds * p) / (total + kinds)
        return p

    score = {i: (sum(math.log(chance("allow", x)) - math.log(chance("block", x)) for x in codes(u)) / len(codes(u)) if u else 0.0) for i, u in enumerate(pages)}
    assert all(abs(got[i].score - s) < 1e-9 for i, s in score.items()) and got[120].score == got[121].score == 0.0
    known = [(math.floor(min(max(got[i].score * 100, -200), 200)), got[i].verdict == "allow") for i in score if got[i].rule]

    def cost(b):
        lost, kept = sum(g and x < b for x, g in known), sum(not g and x >= b for x, g in known)
        return lost / sum(g for _, g in known) + kept / sum(not g for _, g in known)

    best = min({x for x, _ in known}, key=lambda b: (cost(b), abs(b), b)) / 100
    assert all(got[i].verdict == ("allow" if got[i].score >= best else "block") for i in score if not got[i].rule)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(empty).count() == 0


def test_licenses_equal_brute_force(spark):
    """Every window of every template's length, shifted by half of it, against all templates."""
    r = random.Random(4)
    rows = []
    for i in range(60):
        n = r.randrange(len(licenses.TEMPLATES))
        w = licenses._words(licenses.TEMPLATES[n][1])
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "zzz"
        rows.append((i, " ".join([*words(r.randrange(80), i), *w, *words(r.randrange(80), 99 + i)]), "a"))
    rows += [(100, None, "a"), (101, "", "a"), (102, " ".join(words(50_000, 3)) + " " + licenses.TEMPLATES[5][1], "a"), (0, rows[0][1], "a")]
    got = {(x.doc_id, x.template, round(x.containment, 9), x.at) for x in licenses.license_matches(docs(spark, rows)).collect()}
    want = set()
    for i, text, _ in rows:
        w = licenses._words(text or "")
        for n, (_, template) in enumerate(licenses.TEMPLATES):
            t = licenses._words(template)
            k = min(5, len(t))
            held = set(licenses._shingles(t, k))
            size, step = -(-3 * len(t) // 2), max(1, len(t) // 2)
            found = [(len(held & set(licenses._shingles(w[b : b + size], k))) / len(held), -b) for b in range(0, max(1, len(w)), step) if w]
            if found and max(found)[0] >= 0.8:
                want.add((i, n, round(max(found)[0], 9), -max(found)[1]))
    assert got == want and len(want) > 20
    assert licenses.license_matches(docs(spark, rows).limit(0)).count() == 0


def test_licenses(spark):
    text = licenses.TEMPLATES[1][1]
    rows = [(1, " ".join(words(300, 1)) + " " + text.upper(), "a"), (2, "Released under the MIT License.", "a"), (3, " ".join(words(300, 2)) + " license", "a"), (4, None, "a"), (5, "", "a"), (2, "All rights reserved. x", "a")]
    got = sorted((r.doc_id, r.template) for r in licenses.license_matches(docs(spark, rows)).collect())
    assert got == [(1, 1), (2, 0), (2, 9)]
