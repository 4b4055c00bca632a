"""Order-dependent operators against brute force and known results, and null and empty cases."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import verdicts as V
from folioflow.operators import boxes as B
from folioflow.operators import sequences as S
from folioflow.operators.ranks import numbered, quantiles, running
from folioflow.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_likeness_is_not_symmetric():
    assert S.likeness("tide", "diet") == 0.25 and S.likeness("diet", "tide") == 0.5
    assert S.likeness("--", "a") == 0.0 and S.likeness(None, "a") == 0.0


def test_alignment_of_split_words_bullets_and_numbers(spark):
    assert [k for *_, k in S.aligned(["R", "ight"], ["Right"])] == ["split", "split"]
    assert S.aligned(["-", "Lean"], ["Lean"]) == [(None, 0.0, "unmatched"), (0, 1.0, "1:1")]
    boxes = spark.createDataFrame([("p", str(i), 0, i, t) for i, t in enumerate(["alpha", "800", "beta", None])] + [("q", "z", 0, 0, "lone")], "page_key string, box_id string, line int, word int, text string")
    words = spark.createDataFrame([("p", i, t) for i, t in enumerate(["alpha", "500", "beta"])], "page_key string, ord int, word string")
    flags = {r.box_id: (r.text, r.flag) for r in S.page_alignment(boxes, words).collect()}
    assert flags == {"0": ("alpha", None), "1": ("500", "number_mismatch"), "2": ("beta", None), "3": ("", "not_in_transcript"), "z": ("lone", "not_in_transcript")}


def test_common_subsequence_is_longest():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        got = S.common(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
        subs = {s for n in range(len(a) + 1) for s in itertools.combinations(a, n)}
        longest = max(len(s) for s in subs if all(x in it for it in [iter(b)] for x in s))
        assert len(got) == longest


SHAPE = "page_key string, box_id string, x int, y int, w int, h int, text string"


def merged_by_hand(old, new):
    """The rules, one box at a time."""
    out, used = [], set()

    def iou(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        return w * h / (a[4] * a[5] + b[4] * b[5] - w * h) if w > 0 and h > 0 else 0.0

    guarded = [o for o in old if o[7] == "manual" or o[8]]
    for o in sorted(old, key=lambda o: o[10]):
        if o in guarded or o[9]:
            out.append((o[0], o[1], o[2], o[6], "kept" if o in guarded else "carried"))
            continue
        free = [n for n in new if n[0] == o[0] and n not in used and iou(o, n) >= 0.5]
        if free:
            n = max(free, key=lambda n: (iou(o, n), -n[7]))
            used.add(n)
            out.append((o[0], o[1], n[2], n[6], "refreshed"))
        else:
            out.append((o[0], o[1], o[2], o[6], "retired"))
    out += [(n[0], "n" + n[1], n[2], n[6], "added") for n in new if n not in used and not any(g[0] == n[0] and iou(g, n) >= 0.5 for g in guarded)]
    return sorted(out)


def test_merge_in_stored_order(spark):
    rng = random.Random(3)
    old, new = [], []
    for page in "pqr":
        for i in range(40):
            old.append((page, f"o{i}", rng.randrange(60), rng.randrange(8), 20, 10, f"t{i}", rng.choice(["manual", "detected", "detected", "detected"]), rng.random() < 0.1, rng.random() < 0.2, i))
            if i % 5:
                new.append((page, f"d{i}", rng.randrange(60), rng.randrange(8), 20, 10, f"u{i}", i))
    a = spark.createDataFrame(old, SHAPE + ", source string, edited boolean, deleted boolean, box_ord long")
    b = spark.createDataFrame(new, SHAPE + ", det_ord long")
    got = sorted((r.page_key, r.box_id, r.x, r.text, r.outcome) for r in B.merge_detection(a, b).collect())
    assert got == merged_by_hand(old, new) and {x[4] for x in got} == {"kept", "refreshed", "retired", "carried", "added"}
    assert B.merge_detection(a.limit(0), b.limit(0)).count() == 0


def test_merge_moves_texts_only(spark, tmp_path):
    """Boxes of dealt texts are merged without an exchange or a table of boxes; pages may have one side, or more candidates than one lot."""
    rng = random.Random(4)
    spark.createDataFrame([(i, "a bb ccc\nd e") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["geo2_merge_fast"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # of (doc_id, text), below what makes words
    below = [plan[m.start() :].split("\n", 1)[1] for m in re.finditer("Exchange ", plan)]
    assert len(below) == 2 and not any("Generate" in x.split("FileScan")[0] for x in below)
    assert plan.count("FileScan") == plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 2
    old = [("p", f"o{i}", rng.randrange(90), rng.randrange(90), 20, 10, f"t{i}", "detected", False, False, i) for i in range(600)] + [("q", "o", 0, 0, 9, 9, "t", "manual", False, False, 1)]
    new = [("p", f"d{i}", rng.randrange(90), rng.randrange(90), 20, 10, f"u{i}", i) for i in range(600)] + [("r", "d", 0, 0, 9, 9, "u", 1)]
    a = spark.createDataFrame(old, SHAPE + ", source string, edited boolean, deleted boolean, box_ord long")
    b = spark.createDataFrame(new, SHAPE + ", det_ord long")
    assert sorted((r.page_key, r.box_id, r.x, r.text, r.outcome) for r in B.merge_detection(a, b).collect()) == merged_by_hand(old, new)


@pytest.mark.parametrize("parts, adaptive", [(8, "true"), (16, "false"), (64, "true")])
def test_running_sums_do_not_depend_on_partitions(spark, parts, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2048")
        rows = [(f"k{i * 7919 % 5000:05}", i % 9) for i in range(5000)]
        frame = spark.createDataFrame(rows, "k string, n int").withColumn("long_text", F.repeat("k", 20))
        got = [(r.k, r.at) for r in running(frame, ["k"], "n", "at").select("k", "at").collect()]
        at, want = 0, []
        for k, n in sorted(rows):
            want.append((k, at))
            at += n
        assert sorted(got) == want
        assert numbered(frame.limit(0), ["k"]).count() == 0
        q = quantiles(spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", None), ("c", 4.0)], "g string, v double"), "g", "v", {"p": 0.25, "m": 0.5}).collect()
        assert {(r.g, r.p, r.m) for r in q} == {("a", 2.25, 4.5), ("c", 4.0, 4.0)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_alignment_equals_full_search():
    """Against the best score over all local alignments of short lines, by recursion."""
    rng = random.Random(6)
    for _ in range(40):
        texts, words = (["".join(rng.choice("abc1") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 5))] for _ in range(2))

        def best(i, j):
            """Best score of an alignment that ends before box i and word j."""
            found = [0.0]
            if i and j:
                s = S.likeness(texts[i - 1], words[j - 1])
                found.append(best(i - 1, j - 1) + s - 0.4)
                if i > 1:
                    two = S.likeness(texts[i - 2] + texts[i - 1], words[j - 1])
                    if two >= max(s, S.likeness(texts[i - 2], words[j - 1])) + 0.1:
                        found.append(best(i - 2, j - 1) + 2 * (two - 0.4) - 0.1)
                found += [best(i - 1, j) - 0.35, best(i, j - 1) - 0.25]
            return max(found)

        top = max(best(i, j) for i in range(len(texts) + 1) for j in range(len(words) + 1))
        got = S.aligned(texts, words)
        places = [w for w, _, _ in got if w is not None]
        assert places == sorted(places)
        used = [i for i, (w, _, _) in enumerate(got) if w is not None]
        if not used:
            assert top < 1e-9
            continue
        pairs = {w: [i for i in used if got[i][0] == w] for w in places}
        earned = sum(got[v[0]][1] - 0.4 if len(v) == 1 else 2 * (got[v[0]][1] - 0.4) - 0.1 for v in pairs.values())
        cost = 0.35 * (used[-1] - used[0] + 1 - len(used)) + 0.25 * (places[-1] - places[0] + 1 - len(pairs))
        assert abs(earned - cost - top) < 1e-9


def test_wrap_against_a_loop(spark):
    rng, rows = random.Random(2), []
    for doc in range(20):
        rows += [(doc, i, rng.randint(1, 9), rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 0, 1])) for i in range(rng.randint(1, 30))]
    got = {(r.doc_id, r.ord): (r.line, r.u, r.overflow) for r in S.wrapped(spark.createDataFrame(rows, "doc_id long, ord int, width int, nl int, tabs int"), 2.0, 20.0, 5, 1.0, 3.0).collect()}
    want, doc = {}, None
    for d, i, width, nl, tabs in rows:
        if d != doc:
            doc, line, u, nl = d, 0, 2.0, 0
            start = True
        if nl:
            line, u = line + nl, 2.0
        u += 3.0 * tabs
        if not start and not nl and u + width > 20.0:
            line, u = line + 1, 2.0
        want[d, i], start = (line, u, line > 5), False
        u += width + 1.0
    assert got == want


def test_noise(spark):
    key = "7:12"
    got = spark.createDataFrame([(key,)], "k string").select(S.unit_noise("k")).head()[0]
    assert got == int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big") / 2**64
    assert all(abs(r.drift) <= 0.5 for r in QUERIES["noi1_unit_noise"](spark, DATA).collect())


def test_verdicts_and_suggestions(spark):
    vocab = spark.createDataFrame([(w,) for w in ("forecast", "region", "management", "work", "force", "efficiency", "it")], "word string")
    texts = ["Forcast", "workforce", "mangement", "12/3", "HR", "x", "€", "", None, "Regions's", "work-force", "efficencies"]
    flags = {r.text: r.flag for r in V.flagged(spark.createDataFrame([(t,) for t in texts], "text string"), vocab).collect()}
    assert flags == {"Forcast": "misspelled", "workforce": None, "mangement": "misspelled", "12/3": None, "HR": None, "x": "too_short", "€": "not_a_word", "": "empty", None: "empty", "Regions's": None, "work-force": None, "efficencies": "misspelled"}
    wrong = spark.createDataFrame([("forcast",), ("mangement",), ("efficencies",), ("wurq",)], "word string")
    counts = spark.createDataFrame([("management", 3), ("work", 2), ("region", 1)], "word string, n long")
    got = {r.word: (r.candidate, r.evidence) for r in V.suggested(wrong, vocab, counts).collect()}
    assert got == {"forcast": ("forecast", "dict"), "mangement": ("management", "doc"), "efficencies": ("efficiencies", "dict"), "wurq": ("work", "doc2")}


def test_queries_without_sql_run(spark):
    for name in ("txt4_similarity", "txt18_word_sync"):
        assert QUERIES[name](spark, DATA).count() > 0, name


def test_alignment_makes_few_similarities_exact(monkeypatch):
    """a line of twelve boxes against a page needed all similarities; bounds stand for most, with the same result."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    calls, likeness, rounds = [], S.likeness, S.ROUNDS
    monkeypatch.setattr(S, "likeness", lambda a, b: calls.append(1) or likeness(a, b))
    counted = 0
    for start in range(0, 108, 12):
        texts = [w if rng.random() < 0.6 else rng.choice(["x" + w, w[::-1], w[:2], "--", rng.choice(words), "aaaaaaaaaaa"]) for w in words[start : start + 12]]
        calls.clear()
        monkeypatch.setattr(S, "ROUNDS", rounds)
        got = S.aligned(texts, words)
        counted += len(calls)
        monkeypatch.setattr(S, "ROUNDS", 1)
        assert S.aligned(texts, words) == got
    assert counted < 9 * 24 * 120 / 10
