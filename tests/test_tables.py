"""Table functions called from SQL, batch by batch, against plain Python."""

import numpy as np
import pytest

from mosaica.functions import tables
from mosaica.operators import align


@pytest.fixture(params=[10_000, 3])
def batches(spark, request):
    """Arrow batches that hold a partition, and such that cut it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segment_rows(spark, batches):
    breaks = [(1, 3, 0, 1), (1, 3, 1, 1), (1, 10, None, 0), (2, 2, 1, 1), (2, 5, 0, 0), (2, 6, 1, 0), (2, 7, 0, 1), (2, 90_000, 1, 1), (3, None, 0, 0)]
    got = tables.decode(spark, spark.createDataFrame(breaks, "indiv long, stop long, anc0 int, anc1 int"))
    want, start = [], {}
    for i, stop, a, b in breaks:
        want += [(s, i, a, b) for s in range(start.get(i, 0), stop or 0)]
        start[i] = stop or 0
    assert sorted(map(tuple, got.where("snp < 100").collect()), key=repr) == sorted((w for w in want if w[0] < 100), key=repr)
    assert got.count() == len(want)
    assert tables.decode(spark, spark.createDataFrame([], "indiv long, stop long, anc0 int, anc1 int")).count() == 0


def test_lifted_positions(spark, batches):
    rng = np.random.default_rng(3)
    chain = []
    for chrom in (1, 2):
        for start in rng.integers(0, 900, 25).tolist():
            chain.append((chrom, start, start + int(rng.integers(0, 60)), None if start % 9 == 0 else chrom + 20, int(rng.integers(1000, 9000)), bool(rng.integers(0, 2))))
    chain.append((3, 0, 1000, 5, 7, True))  # one long block over all groups
    snps = [(k, int(rng.integers(1, 5)), int(rng.integers(0, 1000))) for k in range(400)] + [(400, 1, None), (401, None, 5)]
    c = spark.createDataFrame(chain, "chrom int, start long, stop long, to_chrom int, to_start long, forward boolean")
    s = spark.createDataFrame(snps, "snp long, chrom int, pos long")
    want = {}
    for k, chrom, pos in snps:
        hit = [b for b in chain if b[0] == chrom and pos is not None and b[1] <= pos < b[2]]
        want[k] = (-1, -1)
        if len(hit) == 1 and hit[0][3] is not None:
            _, start, stop, to, at, forward = hit[0]
            want[k] = (to, at + pos - start if forward else at + stop - 1 - pos)
    for lifted in (tables.lift_over(spark, s, c, width=100), align.lift_over(s, c, width=100)):
        assert {r["snp"]: (r["chrom"], r["pos"]) for r in lifted.collect()} == want
    assert sum(w != (-1, -1) for w in want.values()) > 100


def test_called_by_name(spark):
    tables.register(spark)
    spark.createDataFrame([(7, 2, 0, 1), (7, 3, 1, 1)], "indiv long, stop long, anc0 int, anc1 int").createOrReplaceTempView("breaks")
    got = spark.sql("SELECT snp, c0 + c1 AS c FROM segment_rows(TABLE(breaks) PARTITION BY indiv ORDER BY stop) WHERE snp > 0")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2)]
