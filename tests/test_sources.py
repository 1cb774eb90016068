"""Text and binary formats, the panel store, streaming and the command line."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica import cli
from mosaica.panel import Panel
from mosaica.sources import binary, lanc, rfmix, store, text
from mosaica.streaming import incremental

def test_lanc_round_trip(spark, tmp_path):
    src = tmp_path / "a.lanc"
    src.write_text("300 3\n100:01 300:00\n120:10 300:01\n300:00\n")
    seg, n_snp, n_indiv = lanc.read(spark, str(src))
    assert (n_snp, n_indiv, seg.count()) == (300, 3, 5)
    lanc.write(seg, 300, str(tmp_path / "out"))
    parts = [p for p in os.listdir(tmp_path / "out") if p.startswith("part")]
    assert "".join(open(tmp_path / "out" / p).read() for p in parts).split("\n")[:4] == src.read_text().split("\n")[:4]
    src.write_text("300 3\n100:01 300:00\n120:10 299:01\n300:00\n")
    with pytest.raises(ValueError):
        lanc.read(spark, str(src))


def test_variant_and_sample_tables(spark, tmp_path):
    (tmp_path / "v.pvar").write_text("##fileformat=x\n##source=y\n#CHROM\tPOS\tID\tREF\tALT\tINFO\nchr22\t16059040\trs1\tA\tC\tq\n22\t16059100\trs2\tG\tT\tr\n")
    v = text.variants(spark, str(tmp_path / "v.pvar")).orderBy("snp").collect()
    assert [(r["snp"], r["id"], r["chrom"], r["pos"], r["ref"], r["alt"], r["INFO"]) for r in v] == [(0, "rs1", 22, 16059040, "A", "C", "q"), (1, "rs2", 22, 16059100, "G", "T", "r")]
    (tmp_path / "s.psam").write_text("#IID\tSEX\tPopulation\ns1\t1\tP1\ns2\t2\tP2\n")
    s = text.samples(spark, str(tmp_path / "s.psam")).orderBy("indiv").collect()
    assert [(r["indiv"], r["id"], r["Population"]) for r in s] == [(0, "s1", "P1"), (1, "s2", "P2")]
    (tmp_path / "info.tsv").write_text("snp\tFREQ\nrs1\t0.5\nrs2\tNA\n")
    info = text.info(spark, str(tmp_path / "info.tsv"), "id")
    joined = text.attach_info(text.variants(spark, str(tmp_path / "v.pvar")), info, "id")
    assert {r["id"]: r["FREQ"] for r in joined.collect()} == {"rs1": 0.5, "rs2": None}
    with pytest.raises(ValueError):
        text.attach_info(joined, info, "id")
    (tmp_path / "a.bim").write_text("22 rs1 0.1 7 C A\n22 rs2 0.2 9 T G\n")
    assert [(r["pos"], r["ref"]) for r in text.bim(spark, str(tmp_path / "a.bim")).orderBy("line").collect()] == [(7, "A"), (9, "G")]


def test_breakpoint_files(spark, tmp_path):
    (tmp_path / "a.bp").write_text("header\n0:2 0:4 1:9\n1:9\n")
    got = lanc.breakpoints(spark, str(tmp_path / "a.bp"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 5, 0), (0, 0, 10, 1), (0, 1, 10, 1)]
    (tmp_path / "b.bp").write_text("Sample_1_1\nYRI 1 15 0.1\nCEU 1 100 0.5\nSample_1_2\nCEU 1 100 0.5\n")
    snps = spark.createDataFrame([(i, p) for i, p in enumerate([5, 10, 15, 20])], "snp long, pos long")
    got = lanc.sample_blocks(spark, str(tmp_path / "b.bp"), snps, {"CEU": 0, "YRI": 1})
    assert sorted(map(tuple, got.collect())) == [(0, 0, 2, 1), (0, 0, 4, 0), (0, 1, 4, 0)]


def test_region_calls(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#Subpopulation codes\n#chm\tspos\tepos\ts1.0\ts1.1\n1\t10\t20\t0\t1\n1\t20\t30\t1\t1\n")
    calls = rfmix.read(spark, str(tmp_path / "a.tsv")).withColumnRenamed("id", "indiv")
    snps = spark.createDataFrame([(0, 1, 5), (1, 1, 19), (2, 1, 20), (3, 1, 99)], "snp long, chrom int, pos long")
    got = rfmix.regions_to_variants(snps, calls, width=7)
    assert sorted((r["snp"], r["c0"], r["c1"]) for r in got.collect()) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 1, 1)]
    people = spark.createDataFrame([("s1",)], "indiv string")
    got = rfmix.assign(snps, people, calls)
    assert sorted((r["snp"], r["c0"]) for r in got.collect()) == [(0, -1), (1, 0), (2, 1), (3, -1)]


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nchr22\t7\trs1\tA\tC,G\t.\t.\tR2=0.9;MAF=0.1\tGT:DS\t0|1:1\t1|1:2\nchr22\t9\trs2\tA\tC\t.\t.\tR2=0.8;MAF=0.2\tGT\t0|0\t1|0\n")
    v, g = text.vcf(spark, str(tmp_path / "a.vcf"), (22, 1, 8))
    r = v.first()
    assert v.count() == 1 and (r["chrom"], r["alt"], r["r2"], r["maf"]) == (22, "C", 0.9, 0.1)
    assert sorted((x["id"], x["a0"], x["a1"]) for x in g.collect()) == [("a", 0, 1), ("b", 1, 1)]


def test_digits(spark, tmp_path):
    (tmp_path / "d.txt").write_text("0 1-2\n210\n")
    got = text.read_digits(spark, str(tmp_path / "d.txt"), True)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 1), (1, 2, 0)]
    text.write_digits(got, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["012", "210"]


def test_kernel_files(spark, tmp_path):
    n = 7
    rows = [(i, j, float(i * 10 + j)) for i in range(n) for j in range(i + 1)]
    binary.write_kernel(spark.createDataFrame(rows, "i long, j long, value double"), [("f", str(i)) for i in range(n)], 5, str(tmp_path / "k"))
    kernel, ids = binary.read_kernel(spark, str(tmp_path / "k"))
    assert sorted(map(tuple, kernel.collect())) == rows and ids.count() == n
    # Ranges of three entries, read by several tasks, give the same.
    small, _ = binary.read_kernel(spark, str(tmp_path / "k"), 12)
    assert small.rdd.getNumPartitions() > 1 and sorted(map(tuple, small.collect())) == rows
    # The file's bytes are the entries in order, also when batches and partitions cut them; a lost or repeated one is an error.
    want = np.array([v for _, _, v in rows], "<f4").tobytes()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        given = lambda rows: binary.write_kernel(spark.createDataFrame(rows, "i long, j long, value double").repartition(5), [("f", str(i)) for i in range(n)], 5, str(tmp_path / "k"))
        given(rows[::-1])
        assert (tmp_path / "k.grm.bin").read_bytes() == want and (tmp_path / "k.grm.N.bin").read_bytes() == np.full(len(rows), 5, "<f4").tobytes()
        for bad in (rows[:10] + rows[11:], rows + rows[3:4], rows[:-1], rows[1:]):
            with pytest.raises(Exception, match="missing or repeat|entries for"):
                given(bad)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bed(spark, tmp_path):
    # 5 people: homozygous first, heterozygous, homozygous second, missing, homozygous first
    first = 0b00 | 0b10 << 2 | 0b11 << 4 | 0b01 << 6
    (tmp_path / "a.bed").write_bytes(binary.BED_MAGIC + bytes([first, 0]))
    got = [r["g"] for r in binary.read_bed(spark, str(tmp_path / "a.bed"), 5).orderBy("indiv").collect()]
    assert got == [2, 1, 0, None, 2]
    body = [int(x) for x in np.random.default_rng(1).integers(0, 256, 2 * 40)]
    (tmp_path / "b.bed").write_bytes(binary.BED_MAGIC + bytes(body))
    whole, split = (binary.read_bed(spark, str(tmp_path / "b.bed"), 7, step) for step in (1 << 20, 32))
    assert split.rdd.getNumPartitions() > 1 and sorted(map(repr, whole.collect())) == sorted(map(repr, split.collect())) and whole.count() == 280
    (tmp_path / "c.bed").write_bytes(b"abc" + bytes(body))
    with pytest.raises(ValueError):
        binary.read_bed(spark, str(tmp_path / "c.bed"), 7)


@pytest.mark.parametrize("digits", [4, 6, 8])
def test_significant_digits(spark, digits):
    xs = [0.0, 3.0, -3.0, 2.5, 100.0, 7500.0, 120.5, 100000.0, 999999.6, 1e6, 1234567.0, 0.1, 0.0001, 0.00001234, 1e-5, 1.5e-10, 1e300, 1e-300, 12345.678, float("inf"), -float("inf")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None, float("nan")])], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(text.significant(F.col("x"), digits)).collect()]
    assert got == [f"%.{digits}g" % x for x in xs] + ["NA", "NA"]


@pytest.mark.parametrize("digits", [6, 8])
def test_significant_digits_of_ties(spark, digits):
    # Integers and eighths that lie midway between two numbers of so many digits.
    xs = [k * 10.0**e + 5 * 10.0 ** (e - 1) for k in (10 ** (digits - 1), 10 ** (digits - 1) + 1, 10**digits - 1) for e in (1, 2, 4)] + [1000000.5, 1000001.5, 10000000.5, 10000001.5, 100000.125, 100000.375]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(text.significant(F.col("x"), digits)).collect()]
    assert got == [f"%.{digits}g" % x for x in xs]


def test_lines_of_a_file_in_several_splits(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(5000)]
    (tmp_path / "long.txt").write_text("\n".join(want) + "\n")
    (tmp_path / "other.txt").write_text("a\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = text.lines(spark, [str(tmp_path / "long.txt"), str(tmp_path / "other.txt")])
        assert got.rdd.getNumPartitions() > 4
        rows = {(os.path.basename(r["file"]), r["line"]): r["value"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {("long.txt", i): v for i, v in enumerate(want) if v} | {("other.txt", 0): "a", ("other.txt", 1): "b"}


@pytest.fixture
def stored(spark, tmp_path):
    rng = np.random.default_rng(0)
    m, n = 20, 30
    geno = spark.createDataFrame([(s, i, *map(int, rng.integers(0, 2, 4))) for s in range(m) for i in range(n)], incremental.GENO)
    snps = spark.createDataFrame([(s, f"rs{s}", s // 10, s * 10, "A", "C") for s in range(m)], "snp long, id string, chrom int, pos long, ref string, alt string")
    indivs = spark.createDataFrame([(i, str(i), "P1" if i % 2 else "P2") for i in range(n)], "indiv long, id string, pop string")
    store.write(Panel(geno, snps, indivs, 2), str(tmp_path / "panel"))
    return str(tmp_path / "panel"), geno


def test_store_subset_and_validation(spark, stored):
    path, geno = stored
    p = store.read(spark, path)
    assert p.n_anc == 2 and p.geno.count() == 600
    p.validate()
    small = p.slice(5, 10, 0, 4)
    assert small.geno.count() == 20 and small.snps.count() == 5
    ids = spark.createDataFrame([("rs3",), ("rs7",)], "id string")
    assert p.select_ids("snp", ids, "id").geno.count() == 60
    with pytest.raises(KeyError):
        p.select_ids("snp", spark.createDataFrame([("nope",)], "id string"), "id")
    assert sorted(r[0] for r in small.reindexed("snp").snps.select("snp").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        Panel(geno.union(geno), p.snps, p.indivs, 2).validate()


def test_stream_adds_up(spark, stored, tmp_path):
    from mosaica.operators.alleles import af_per_anc

    _, geno = stored
    landing = str(tmp_path / "landing")
    for half in (0, 1):
        geno.where(f"indiv % 2 = {half}").write.mode("append").parquet(landing)
        incremental.follow(spark, landing, str(tmp_path / "sums"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["snp"], r["anc"]): r["af"] for r in incremental.frequencies(spark, str(tmp_path / "sums")).collect()}
    want = {(r["snp"], r["anc"]): r["af"] for r in af_per_anc(geno, 2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_commands(spark, stored, tmp_path):
    path, _ = stored
    rng = np.random.default_rng(1)
    (tmp_path / "pheno.tsv").write_text("indiv\ty\tx\tg\n" + "".join(f"{i}\t{rng.normal():.4f}\t{rng.normal():.4f}\t{'ab'[i % 2]}\n" for i in range(30)))
    cli.main(["assoc", "--panel", path, "--pheno", str(tmp_path / "pheno.tsv"), "--out", str(tmp_path / "o"), "--method", "ATT,TRACTOR"])
    assert spark.read.csv(str(tmp_path / "o.TRACTOR.assoc"), sep="\t", header=True).count() == 20
    cli.main(["append-snp-info", "--panel", path, "--out", str(tmp_path / "info")])
    cli.main(["admix-grm", "--panel", path, "--out", str(tmp_path / "k")])
    cli.main(["admix-grm-merge", "--parts", str(tmp_path / "k"), str(tmp_path / "k"), "--out", str(tmp_path / "kk")])
    (tmp_path / "p2.tsv").write_text("indiv\ty\n" + "".join(f"{i}\t{rng.normal():.4f}\n" for i in range(30)))
    cli.main(["genet-cor", "--pheno", str(tmp_path / "p2.tsv"), "--kernel", str(tmp_path / "kk"), "--out", str(tmp_path / "curve")])
    cli.main(["summarize-genet-cor", "--curves", str(tmp_path / "curve"), "--out", str(tmp_path / "s.json")])
    assert 0 <= json.load(open(tmp_path / "s.json"))["rg_mode"] <= 1
    cli.main(["simulate-pheno", "--panel", path, "--out", str(tmp_path / "sim"), "--n-causal", "5", "--prevalence", "0.3"])


def test_alignment_commands(spark, stored, tmp_path):
    path, geno = stored
    (tmp_path / "a.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n1\t10\trs1\tA\tC\n1\t20\trs2\tG\tT\n2\t5\trs3\tA\tG\n")
    (tmp_path / "b.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n1\t10\tx1\tC\tA\n1\t20\tx2\tG\tT\n1\t30\tx3\tA\tG\n")
    (tmp_path / "chain.tsv").write_text("chrom\tstart\tstop\tto_chrom\tto_start\tforward\n1\t0\t15\t7\t100\ttrue\n1\t15\t25\t8\t200\tfalse\n")
    a, b, out = (str(tmp_path / x) for x in ("a.pvar", "b.pvar", "out"))
    cli.main(["pfile-align-snp", "--left", a, "--right", b, "--out", out])
    assert sorted((r["snp1"], r["snp2"], r["flip"]) for r in spark.read.parquet(out).collect()) == [(0, 0, -1), (1, 1, 1)]
    cli.main(["subset-hapmap3", "--variants", a, "--reference", b, "--out", out])
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["rs1", "rs2"]
    cli.main(["liftover", "--variants", a, "--chain", str(tmp_path / "chain.tsv"), "--out", out])
    assert sorted(map(tuple, spark.read.parquet(out).select("snp", "chrom", "pos").collect())) == [(0, 7, 110), (1, 8, 204), (2, -1, -1)]
    cli.main(["pfile-merge-indiv", "--left", path, "--right", path, "--out", out])
    assert spark.read.parquet(out).count() == 2 * geno.count()


def test_results_of_other_tools(spark, tmp_path):
    from mosaica.sources import results

    (tmp_path / "p.eigenvec").write_text("#FID IID PC1 PC2\n0 a 0.5 -1e-3\n0 b 0.25 2\n")
    (tmp_path / "p.eigenval").write_text("3.5\n1.25\n")
    pcs, values = results.eigenvectors(spark, str(tmp_path / "p"))
    assert values == [3.5, 1.25] and sorted(map(tuple, pcs.collect())) == [("a", 0.5, -0.001), ("b", 0.25, 2.0)]
    (tmp_path / "r.log").write_text("start\n\nSummary result of REML analysis:\nSource\tVariance\tSE\nV(G)\t0.4\t0.1\nV(e)\t0.6\t0.2\nVp\t1.0\t0.1\n\nSampling variance/covariance of the estimates of variance components:\n0.01\t-0.005\n-0.005\t0.04\n")
    (tmp_path / "r.hsq").write_text("Source\tVariance\tSE\nlogL\t-12.5\nn\t100\n")
    got = results.variance_components(spark, str(tmp_path / "r"))
    assert (got["loglik"], got["n"]) == (-12.5, 100)
    assert sorted(map(tuple, got["est"].collect())) == [("V(G)", 0.4, 0.1), ("V(e)", 0.6, 0.2)]
    assert {(r["a"], r["b"]): r["value"] for r in got["varcov"].collect()}[("V(e)", "V(G)")] == -0.005


def test_break_lines_with_runs_of_one_variant(spark, tmp_path):
    from mosaica.plans import file_queries

    want = [(h, s, a) for h in range(4) for s, a in zip((1, 2, 3, 7, 8), ((h + i) % 2 for i in range(5)), strict=True)]
    path = file_queries._lines(spark, file_queries._break_lines(spark.createDataFrame(want, "hap long, stop long, anc int")), "bp", "AFR EUR")
    got = [(2 * r["indiv"] + r["ploidy"], r["stop"], r["anc"]) for r in lanc.breakpoints(spark, path).collect()]
    assert sorted(got) == want
