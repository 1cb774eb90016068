"""Products of packed counts against numpy: missing counts, absent rows, several tiles, windows, many features."""

import numpy as np
import pytest

from mosaica.operators import packed

SCHEMA = "block long, feature long, entity long, x int, y int"


def data(spark, features, entities, seed, blocks=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (blocks, features, entities, 2)).astype(float)
    x[x == 3] = np.nan
    there = rng.random((blocks, features, entities)) < 0.9
    there[:, :, 1] = False  # an entity without rows
    rows = [(b, f, e, *(None if np.isnan(v) else int(v) for v in x[b, f, e])) for b, f, e in zip(*np.nonzero(there), strict=True)]
    x[~there] = np.nan
    df = spark.createDataFrame([tuple(int(v) if v is not None else None for v in r) for r in rows], SCHEMA)
    return df.repartition(3), x


@pytest.mark.parametrize(("features", "entities", "within", "tasks"), [(40, 10, None, 1), (30, 150, None, 9), (25, 200, 70, 4), (1100, 6, None, 1)])
def test_products_by_feature(spark, features, entities, within, tasks):
    df, x = data(spark, features, entities, 1)
    shift, scale = np.random.default_rng(2).normal(size=(2, features, 2))
    tables = spark.createDataFrame([(f, *(float(v) for k in (0, 1) for v in (shift[f, k], scale[f, k]))) for f in range(features) if f != 7], "feature long, x_shift double, x_scale double, y_shift double, y_scale double")
    z = np.nan_to_num((x[0] - shift[:, None]) * scale[:, None])
    z[7] = 0
    got = packed.coded_products(df, ["x", "y"], by_feature=tables, tile=64, within=within, tasks=tasks).collect()
    pairs = {(i, j) for i in range(entities) for j in range(i + 1) if 1 not in (i, j) and (within is None or i - j < within)}
    assert {(r["i"], r["j"]) for r in got} == pairs and len(got) == len(pairs)
    xx, xy, yx, yy = (z[..., a].T @ z[..., b] for a in (0, 1) for b in (0, 1))
    for r in got:
        np.testing.assert_allclose([r["x_x"], r["x_y"], r["y_x"], r["y_y"]], [m[r["i"], r["j"]] for m in (xx, xy, yx, yy)], atol=1e-9)


@pytest.mark.parametrize("within", [None, 65])
def test_products_by_entity(spark, within):
    features, entities, blocks = 20, 140, 2
    df, x = data(spark, features, entities, 3, blocks)
    shift, scale = np.random.default_rng(4).normal(size=(2, blocks, entities, 2))
    tables = spark.createDataFrame([(b, e, *(float(v) for k in (0, 1) for v in (shift[b, e, k], scale[b, e, k]))) for b in range(blocks) for e in range(entities)], "block long, entity long, x_shift double, x_scale double, y_shift double, y_scale double")
    z = np.nan_to_num((x - shift[:, None]) * scale[:, None])
    got = packed.coded_products(df, ["x", "y"], by_entity=tables, tile=64, within=within, tasks=5).collect()
    assert len(got) == blocks * sum(1 for i in range(entities) for j in range(i + 1) if 1 not in (i, j) and (within is None or i - j < within))
    for r in got:
        u, v = z[r["block"], :, r["i"]], z[r["block"], :, r["j"]]
        np.testing.assert_allclose([r["x_x"], r["x_y"], r["y_x"], r["y_y"]], [u[:, a] @ v[:, b] for a in (0, 1) for b in (0, 1)], atol=1e-9)
