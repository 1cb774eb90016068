"""Near-duplicate vectors and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, rep long, row long, score string"


def frame(spark, vectors, labels=None, ids=None):
    return spark.createDataFrame([(int(ids[i]) if ids else i, None if v is None else [None if x is None else float(x) for x in v], None if labels is None else labels[i], 1, 2, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def brute(vectors, labels, least):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) and labels[i] is not None for i, v in enumerate(vectors)]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]) and cosine(np.array(vectors[i], float), np.array(vectors[j], float)) >= least:
                link[i, j] = link[j, i] = True
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return link.sum(axis=1).tolist(), comp


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    out, labels = [], []
    for c in range(5):
        centre = rng.normal(size=24)
        for _ in range(30):
            out.append((centre + rng.normal(size=24) * rng.choice([0.05, 0.14, 0.2])).tolist())
            labels.append(c % 2)
    out += [(np.array(out[0]) * 1e-200).tolist(), (np.array(out[0]) * 1e150).tolist(), out[3], out[3], out[40]]
    labels += [0, 0, 0, 1, None]
    out += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0], [2.0], out[0][:20]]
    labels += [0] * 9
    return out, labels


@pytest.mark.parametrize("cap", [2048, 5])
def test_near_duplicates(spark, vectors, cap):
    v, labels = vectors
    links, comp = brute(v, labels, 0.98)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame(spark, v, labels), cap=cap).collect()}
    assert len(got) == len(v) and max(links) > 3
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], comp[i], comp[i] == i), i


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embedding_dedup.hadamard(x)
    np.testing.assert_allclose((x * x).sum(axis=1), (y * y).sum(axis=1))
    np.testing.assert_allclose(embedding_dedup.hadamard(y), x, atol=1e-12)


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 32))
    got = {}
    for r in ann.nearest(frame(spark, v.tolist()), block_rows=200, block_queries=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 50))
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        s = np.array([cosine(v[q], x) for x in v])
        s[q] = -2
        hit += len({r[1] for r in rows} & set(np.argsort(-s)[:5].tolist()))
        for _, i, score in rows:
            assert score == pytest.approx(s[i], abs=1e-12)
    assert hit / (5 * len(got)) >= 0.9


def test_nearest_edges(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, 0.0], [3.0]]
    got = ann.nearest(frame(spark, v), is_query=F.col("vec_id").isin(0, 3, 7)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 6), (0, 2), (0, 1)]
    ties = ann.nearest(frame(spark, [[1.0, 2.0]] * 9), is_query=F.col("vec_id") == 4).orderBy("rank").collect()
    assert [r["vec_id"] for r in ties] == [0, 1, 2, 3, 5]


def exact(v, queries, k):
    """Brute force in one fixed order of sums, so that copies tie."""
    unit = []
    for x in v:
        x = np.array(x, float)
        x = x / np.abs(x).max()
        total = 0.0
        for a in x:
            total += a * a
        unit.append(x / np.sqrt(total))
    u = np.array(unit)
    out = {}
    for q in queries:
        s = np.zeros(len(u))
        for j in range(u.shape[1]):
            s += u[:, j] * u[q, j]
        order = [int(i) for i in np.lexsort((np.arange(len(u)), -s)) if i != q][:k]
        out[q] = [(r + 1, i, min(1.0, s[i])) for r, i in enumerate(order)]
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 50, "block_queries": 3}])
def test_nearest_copies_at_64_dimensions(spark, options):
    """30 groups of many equal vectors, one of them very large: ids and scores equal brute force, ties by vec_id."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 64))
    v = np.concatenate([np.repeat(centres, 9, axis=0), np.repeat(centres[:1], 180, axis=0), centres[:20] + rng.normal(size=(20, 64)) * 0.05, rng.normal(size=(30, 64))])
    v = v[rng.permutation(len(v))]
    got = {}
    for r in ann.nearest(frame(spark, v.tolist()), is_query=F.col("vec_id") % 10 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(v.tolist(), range(0, len(v), 10), 5)
    same = sum(got[q] == want[q] for q in want)
    assert set(got) == set(want) and same >= 0.9 * len(want)
    for q in want:  # a query with copies of its own has nothing but them
        if want[q][4][2] > 0.999:
            assert got[q] == want[q]


def test_nearest_repeated_ids(spark):
    got = ann.nearest(frame(spark, [[1.0, 0.0], [0.6, 0.8], [1.0, 0.0]], ids=[50, 7, 50])).orderBy("query_id", "rank", "vec_id").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(50, 1, 50), (50, 1, 50), (50, 2, 7), (50, 2, 7)]


def test_collision_counting_verifies_a_small_part():
    """At the radius of the k-th best, far fewer than half of a block without structure are verified."""
    rng = np.random.default_rng(5)
    x = embedding_dedup.unit(rng.normal(size=(4000, 64)))
    block = ann.Block(x, np.arange(4000), np.arange(4000), 128, 3)
    s = x[:40] @ x.T
    radius = np.sqrt(2 - 2 * np.sort(s, axis=1)[:, -6])
    hit = 0
    for i in range(40):
        rows, _ = block.search(x[i], radius[i], 6, 1.3, 1.9, 0.3, 1.5)
        hit += len(set(rows.tolist()) & set(np.argsort(-s[i])[:6].tolist()))
    assert hit >= 0.9 * 240 and block.verified < 0.25 * 40 * 4000


def test_repeated_ids_are_different_vectors(spark):
    got = embedding_dedup.near_duplicates(frame(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.001]], [1, 1, 1], ids=[4, 4, 9])).orderBy("vec_id", "n_links").collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(4, 0, 4, True), (4, 1, 4, True), (9, 1, 4, False)]


def test_empty(spark):
    none = frame(spark, [[1.0]], [1]).where("vec_id < 0")
    assert embedding_dedup.near_duplicates(none).count() == 0 and ann.nearest(none).count() == 0
