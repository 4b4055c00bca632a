"""Kernels against plain definitions: peaks, walks, fits, layouts, histories and connected parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import layout as L
from folioflow.operators import pixels as P
from folioflow.operators import series as N
from folioflow.operators import sheets as G
from folioflow.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_peaks(x, distance, height, prominence):
    found, n = [], len(x)
    for i in range(1, n - 1):
        a, b = i, i
        while a > 0 and x[a - 1] == x[i]:
            a -= 1
        while b < n - 1 and x[b + 1] == x[i]:
            b += 1
        if a > 0 and b < n - 1 and x[a - 1] < x[i] > x[b + 1] and i == (a + b) // 2 and x[i] >= height:
            found.append(i)
    kept = []
    for i in sorted(found, key=lambda i: (-x[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)

    def rise(i):
        lows = []
        for step in (-1, 1):
            low, k = x[i], i
            while 0 <= k < n and x[k] <= x[i]:
                low, k = min(low, x[k]), k + step
            lows.append(low)
        return x[i] - max(lows)

    return sorted(i for i in kept if rise(i) >= prominence)


def test_peaks():
    r = random.Random(1)
    for _ in range(200):
        x = np.array([r.randrange(6) for _ in range(r.randrange(0, 40))], float)
        for distance, height, prominence in ((1, 0, 0), (3, 1, 0), (4, 0, 2)):
            assert N.peaks(x, distance, height, prominence).tolist() == plain_peaks(x.tolist(), distance, height, prominence)


def test_followed_peaks_keep_to_their_rules(spark):
    rows = [(1, s, s * 10.0, 50.0 * k + 2.0 * s) for s in range(7) for k in range(3) if (s, k) != (2, 1)] + [(1, 5, 50.0, 85.0)]
    got = {(r.seed, r.slab): r.y for r in N.followed(spark.createDataFrame(rows, "page long, slab long, x double, y double"), 50.0).collect()}
    assert got[56.0, 6] == 62.0 and got[6.0, 0] == 0.0 and (56.0, 2) not in got and got[56.0, 0] == 50.0
    assert {s for s, _ in got} == {6.0, 56.0, 106.0}


def test_four_corners_and_fits(spark):
    src, dst = np.array([[0, 0], [2, 0.1], [2.2, 3], [-0.1, 2.9]]), np.array([[0, 0], [23.0, 0], [23.0, 30.0], [0, 30.0]])
    m = G.four_corners(src, dst).reshape(3, 3)
    for (x, y), want in zip(src, dst):
        p = m @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], want)
    sheets = QUERIES["geo9_fitted_sheets"](spark, DATA).collect()
    assert len(sheets) == 3 and all(0.85 * s.n_lines * 30 <= s.inliers < s.n_lines * 30 for s in sheets)
    from folioflow.plans.sheet_queries import _observations, _sheets

    new = QUERIES["geo9_fitted_sheets"](spark, DATA)
    middle = G.residuals(_observations(spark).where("page < 2"), new).groupBy("page").agg(F.percentile("residual", 0.5).alias("m")).collect()
    assert len(middle) == 2 and all(r.m < 2.0 for r in middle)
    assert G.fitted_sheets(_observations(spark).limit(20), 1200, 1600).count() == 0
    kept = G.better_sheets(_sheets(spark).where("page < 2"), _sheets(spark).where("page < 2").withColumn("m5", F.col("m5") + 3), _observations(spark).where("page < 2"))
    assert sorted(r.m5 for r in kept.collect()) == sorted(r.m5 for r in _sheets(spark).where("page < 2").collect())


def test_rule_polynomials_equal_least_squares(spark):
    r = random.Random(2)
    rows = [(p, k, float(x), 3 + 0.2 * x + 0.001 * x * x * (k % 2) + r.random()) for p in range(3) for k in range(4) for x in r.sample(range(0, 900), 4 if k == 3 else 15)]
    for got in G.rule_polynomials(spark.createDataFrame(rows, "page long, rule long, x double, y double")).collect():
        x, y = (np.array([row[i] for row in rows if row[:2] == (got.page, got.rule)]) for i in (2, 3))
        want = np.polyfit(x, y, 2 if len(x) >= 6 else 1)
        assert np.allclose([got.a, got.b, got.c][3 - len(want) :], want, rtol=1e-6, atol=1e-6)


def test_quads_and_polygons(spark):
    square = [[0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0]]
    cases = [(*square[0], *square[1], True), (0.0, 0.0, 10.0, 10.0, 0.0, 10.0, 10.0, 0.0, False), (0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, False), (float("nan"), 10.0, 10.0, 0.0, 0.0, 0.0, 10.0, 10.0, False), (0.0, 90.0, 90.0, 0.0, 0.0, 0.0, 90.0, 90.0, False), (None, 10.0, 10.0, 0.0, 0.0, 0.0, 10.0, 10.0, False)]
    names = [f"x{k}" for k in range(4)] + [f"y{k}" for k in range(4)]
    frame = spark.createDataFrame(cases, ", ".join(f"{n} double" for n in names) + ", want boolean")
    assert all(r.ok == r.want for r in frame.withColumn("ok", G.quad_ok([F.col(n) for n in names[:4]], [F.col(n) for n in names[4:]], F.lit(100), F.lit(100))).collect())


def test_flow_against_a_scan(spark):
    r = random.Random(5)
    rows = []
    for doc in range(12):
        for i in range(60):
            pin = (r.randrange(6), r.random() * 15) if r.random() < 0.15 else (None, None)
            rows.append((doc, i, f"{doc}:{i}", r.choice([0, 0, 0, 1]), r.choice([0, 0, 1]), r.choice([1.0, 2.0, 4.5, 25.0]) if r.random() < 0.95 else None, *pin))
    frame = spark.createDataFrame(rows, "doc_id long, ord long, word_id string, nl int, tabs int, aspect double, pin_line long, pin_u double")
    got = {(x.doc_id, x.ord): (x.line, x.u, x.overflow) for x in L.flowed(frame, 0, 5, 0.0, 20.0, 1.0, 0.3, 0.5, 0.1, 7).collect()}
    for doc in range(12):
        words = [w for w in rows if w[0] == doc]
        line, u, fresh = 0, None, True

        def stretches(at):
            edge, out = 0.0, []
            for w in sorted((w for w in words if w[6] == at), key=lambda w: w[7]):
                a, b = w[7] - 0.15, w[7] + (w[5] or 3.0) + 0.15
                if a > edge and min(a, 20.0) - edge > 1e-6:
                    out.append((edge, min(a, 20.0)))
                edge = max(edge, b)
            return out + ([(edge, 20.0)] if 20.0 - edge > 1e-6 else [])

        def begin(at):
            return stretches(at)[0][0] if stretches(at) else 0.0

        u = begin(0)
        for _, i, name, nl, tabs, aspect, pl, pu in words:
            if pl is not None:
                assert got[doc, i][:2] == (pl, pu)
                fresh = False
                continue
            width = aspect or 3.0
            if nl and not fresh:
                line, u = line + nl, begin(line + nl)
            fresh = False
            u += tabs * 0.5
            place = None
            while line <= 5 and place is None:
                place = next((max(u, a) for a, b in stretches(line) if max(u, a) + width <= b), None)
                if place is None:
                    line, u = line + 1, begin(line + 1)
            if place is None:
                assert got[doc, i] == (None, None, True)
                continue
            assert got[doc, i] == (line, pytest.approx(place), False)
            place = got[doc, i][1]
            u = place + width + 0.3 * (1 + (L._unit(7, f"{name}:space") * 2 - 1) * 0.1)


def test_history(spark):
    log = [(1, i, *e) for i, e in enumerate([("undo", None), ("edit", "a"), ("edit", "b"), ("undo", None), ("redo", None), ("undo", None), ("edit", "c"), ("redo", None), ("undo", None), ("undo", None), ("undo", None)])]
    got = [(r.state, r.done) for r in L.history(spark.createDataFrame(log, "doc_id long, seq long, op string, state string")).orderBy("seq").collect()]
    assert got == [(None, False), ("a", True), ("b", True), ("a", True), ("b", True), ("a", True), ("c", True), ("c", False), ("a", True), (None, True), (None, False)]
    many = [(1, i, "edit", str(i)) for i in range(10)] + [(1, 10 + i, "undo", None) for i in range(5)]
    assert [r.state for r in L.history(spark.createDataFrame(many, "doc_id long, seq long, op string, state string"), 3).orderBy("seq").collect()][-5:] == ["8", "7", "6", "6", "6"]


def test_sheet_edits():
    s = {f"m{i}": v for i, v in enumerate((14.0, 0.0, 14.0, 0.0, 14.0, 14.0, 0.0, 0.0, 1.0))} | {"c1": 0.0, "c2": 0.0, "u_left": 0.0, "u_right": 28.0, "i_first": 1, "n_lines": 26, "img_w": 1000, "img_h": 1000}
    assert L.edited_sheet(s, {"kind": "margin", "x": 250.0, "y": 500.0})["u_right"] == 21.0
    assert (L.edited_sheet(s, {"kind": "top", "k": 2})["i_first"], L.edited_sheet(s, {"kind": "bottom", "k": -40})["n_lines"]) == (-1, 1)
    moved = L.edited_sheet(s, {"kind": "move", "x": 0.0, "y": 0.0, "x2": 250.0, "y2": 250.0})
    assert (moved["u_left"], moved["u_right"], moved["i_first"]) == (7.0, 35.0, 8)
    corner = L.edited_sheet(s, {"kind": "corner", "k": 2, "x": 750.0, "y": 500.0})
    assert (corner["u_right"], corner["i_first"], corner["n_lines"]) == (21.0, 1, 14)
    assert L.edited_sheet(s, {"kind": "bow", "x": 0.5})["c1"] == 0.5 and s["c1"] == 0.0


def test_connected_parts():
    r = random.Random(3)
    for _ in range(60):
        mask = np.array([[r.random() < 0.45 for _ in range(r.randrange(1, 14))]] * 1)
        mask = np.array([[r.random() < 0.45 for _ in range(mask.shape[1])] for _ in range(r.randrange(1, 14))])
        labels, stats = P.components(mask)
        seen, parts = set(), []
        for y, x in zip(*np.nonzero(mask)):
            if (y, x) not in seen:
                todo, part = [(y, x)], set()
                while todo:
                    a, b = todo.pop()
                    if (a, b) in part or not (0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b]):
                        continue
                    part.add((a, b))
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                seen |= part
                parts.append(part)
        want = sorted((min(b for _, b in p), min(a for a, _ in p), max(b for _, b in p) - min(b for _, b in p) + 1, max(a for a, _ in p) - min(a for a, _ in p) + 1, len(p)) for p in parts)
        assert sorted(map(tuple, stats.tolist())) == want
        assert len({labels[y, x] for y, x in zip(*np.nonzero(mask))}) == len(parts) and not labels[~mask].any()


def test_pictures(spark):
    angles = {r.page: r.angle for r in QUERIES["geo19_rule_angle"](spark, DATA).collect()}
    assert all(abs(angles[p] - (p - 5) * 1.5) <= 0.75 for p in range(10))
    assert {r.page: r["at"] for r in QUERIES["geo12_margin"](spark, DATA).collect()} == {p: 20 + p for p in range(20)}
    region = {r.page: (r.x, r.y, r.w, r.h) for r in QUERIES["pix4_page_region"](spark, DATA).collect()}
    assert region == {p: (15 + p, 20, 86 - p, 101) for p in range(20)}
    parts = [(1, 0, 0, 5, 5, 20, 30, 900), (1, 0, 0, 30, 2, 50, 30, 900), (1, 0, 0, 3, 2, 6, 30, 900), (2, 0, 0, 9, 9, 50, 30, 99)]
    frame = spark.createDataFrame(parts, "page long, x long, y long, w long, h long, area long, height long, cells long")
    pages = spark.createDataFrame([(1, 900), (2, 99), (3, 900), (4, None)], "page long, cells long")
    assert {r.page: r.ink for r in P.letter_ink(frame, pages).collect()} == {1: 20 / 900, 2: 0.0, 3: 0.0, 4: None}


@pytest.mark.parametrize("name", ["win9_peaks", "pix5_background", "pix8_word_splits", "pix9_channel_response", "geo20_word_quads", "arr11_document_view", "geo22_edited_sheets", "noi3_word_seeds", "agg17_layout_stats", "geo10_better_sheets"])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
