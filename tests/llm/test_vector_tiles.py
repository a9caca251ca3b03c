"""Embedding near-duplicates against all cosines in double precision."""

import math
import random

import numpy as np
import pytest

from pagemill.llm import vector_tiles as vt

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, threshold=0.98):
    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [fine(v, label) for _, v, label in rows]
    units = [np.array(v, np.float64) / np.abs(np.array(v, np.float64)).max() if k else None for k, (_, v, _) in zip(ok, rows, strict=True)]
    units = [u / np.sqrt((u * u).sum()) if u is not None else None for u in units]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                near[a].append(b)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(near[a]), least, rows[a][0] == least))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in vt.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)


def around(rnd, centre, angle):
    """A float vector at about that angle from the centre."""
    step = rnd.standard_normal(len(centre))
    step -= centre * (step @ centre) / (centre @ centre)
    out = centre / np.linalg.norm(centre) + math.tan(angle) * step / np.linalg.norm(step)
    return [float(np.float32(x)) for x in out * rnd.uniform(0.1, 10)]


def cloud(rnd, n, width, labels):
    rows = []
    for k in range(n):
        label = int(rnd.integers(labels))
        if rows and rnd.random() < 0.7:  # chains whose cosines lie on both sides of the threshold
            centre = np.array(rows[int(rnd.integers(len(rows)))][1])
            rows.append((k, around(rnd, centre, rnd.uniform(0.1, 0.3)), label))
        else:
            rows.append((k, [float(np.float32(x)) for x in rnd.standard_normal(width)], label))
    return rows


@pytest.mark.parametrize("width", [2, 7, 64])
def test_random_clouds(spark, width):
    rows = cloud(np.random.default_rng(width), 240, width, 2)
    want = slow(rows)
    assert got(spark, rows) == want and any(r[1] for r in want)


def test_blocks_and_tiles_meet(spark, monkeypatch):
    """Small blocks and tiles inside one process, then dealt by Spark: nothing is lost between them."""
    rnd = np.random.default_rng(5)
    rows = cloud(rnd, 300, 8, 1)
    want = {i: (n, least) for i, n, least, _ in slow(rows)}
    vectors = np.array([v for _, v, _ in rows], np.float32)
    monkeypatch.setattr(vt, "TILE", 32)
    links, least = vt.link_blocks(vectors, np.ones(300, np.int64), 300, 0.98)
    assert {k: (links[k], least[k]) for k in range(300)} == want
    monkeypatch.setattr(vt, "BLOCK", 40)
    assert got(spark, rows) == slow(rows)


def test_bounds_hold():
    rnd = np.random.default_rng(6)
    for width in (1, 3, 64, 300, 1100):
        unit = vt.unit_rows(rnd.standard_normal((60, width)) ** 5)
        small, scale, error = vt.quantise(unit)
        near = (small.astype(np.float64) @ small.T.astype(np.float64)) * scale[:, None] * scale
        bound = (1 + error)[:, None] * (1 + error) - 1
        assert small.dtype == np.int8 and (np.abs(unit @ unit.T - near) <= bound + 1e-12).all()


def test_few_pairs_are_worked_out_in_full(monkeypatch):
    rnd = np.random.default_rng(7)
    unit = vt.unit_rows(rnd.standard_normal((500, 64)))
    full = []
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: full.append(len(a)) or plain(how, a, b))
    part = (unit, *vt.quantise(unit))
    assert vt.tile_links(part, part, 0.98).sum() == 500 and sum(full) <= 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, -0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1),
        (None, [1.0, 1e-3], 1), (None, [0.0, 1.0], 1), (13, [-1.0, 0.0], 1), (14, [1e-38, 0.0], 1), (15, [3e38, 1e37], 1), (None, None, None),
    ]
    assert got(spark, rows) == slow(rows)
    assert got(spark, []) == []
    wide = [(1, [1e300, 0.0], 1), (2, [1e-300, 0.0], 1), (3, [1e300, 1e300], 1)]
    assert got(spark, wide, "vec_id long, embedding array<double>, label int") == slow(wide)


def test_a_hot_group_of_copies_and_near_copies(spark):
    rnd = np.random.default_rng(8)
    centre = rnd.standard_normal(16)
    rows = [(k, [float(np.float32(x)) for x in centre], 1) for k in range(3000)]
    rows += [(3000 + k, around(rnd, centre, 0.05), 1) for k in range(1500)]
    out = got(spark, rows)
    assert {r[1] for r in out} == {4499} and {r[2] for r in out} == {0} and sum(r[3] for r in out) == 1


def test_clashing_columns(spark):
    rnd = random.Random(9)
    rows = [(k, [rnd.random(), rnd.random()], 1, "a", 1, 1) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA + ", node string, copies int, first int")
    assert sorted(tuple(r) for r in vt.near_vectors(df).collect()) == sorted(slow([(i, [float(np.float32(x)) for x in v], label) for i, v, label, *_ in rows]))
    assert vt.near_vectors(df).columns == ["vec_id", "n_links", "component_id", "kept"]
