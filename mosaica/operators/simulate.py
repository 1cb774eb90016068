"""Simulation of ancestry, genotypes and phenotypes.

Randomness is a hash of (seed, keys), so a row's draw doesn't depend on
partitioning, retries or order; distributions match, not another generator's draws.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alleles import multiply, of_ancestry


def uniform(seed: int | Column, *keys: str | Column) -> Column:
    """In (0, 1), by hash."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int | Column, *keys: str | Column) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def mosaic_size(snps: DataFrame, gmap: DataFrame, n_gen: float) -> DataFrame:
    """chrom, mosaic_size: variants per ancestry segment, n_snp / (n_gen * Morgans), by the map rows nearest to the first and last variant."""
    ends = snps.groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    at = lambda p: F.min_by("cm", F.struct(F.abs(F.col("position") - F.col(p)), F.col("position")))
    near = ends.join(gmap, "chrom").groupBy("chrom", "n").agg(at("hi").alias("_h"), at("lo").alias("_l"))
    return near.select("chrom", F.try_divide(F.col("n"), n_gen * (F.col("_h") - F.col("_l")) / 100).alias("mosaic_size"))


def causal_effects(snps: DataFrame, n_causal: int, n_anc: int, cor: float, seed: int) -> DataFrame:
    """snp, beta1..betak of ``n_causal`` variants chosen by hash; ancestries' effects are normal with correlation ``cor``."""
    chosen = snps.select("snp").orderBy(uniform(seed, "snp")).limit(n_causal)
    shared = normal(seed + 10, "snp")
    return chosen.select("snp", *[(math.sqrt(max(cor, 0.0)) * shared + math.sqrt(1 - max(cor, 0.0)) * normal(seed + 20 + 2 * a, "snp")).alias(f"beta{a + 1}") for a in range(n_anc)])


def genetic_value(geno: DataFrame, effects: DataFrame, n_anc: int) -> DataFrame:
    """indiv, g: alleles of each ancestry times that ancestry's effects."""
    per = sum((of_ancestry(a) * F.col(f"beta{a + 1}") for a in range(1, n_anc)), of_ancestry(0) * F.col("beta1"))
    return geno.join(effects, "snp").groupBy("indiv").agg(F.sum(per).alias("g"))


def scaled(values: DataFrame, variance: float, column: str = "g") -> DataFrame:
    """The column scaled to a population variance, without centring."""
    s = values.agg(F.stddev_pop(column).alias("_s"))
    return values.crossJoin(F.broadcast(s)).withColumn(column, F.col(column) * F.try_divide(F.lit(math.sqrt(variance)), F.col("_s"))).drop("_s")


def quantitative(geno: DataFrame, snps: DataFrame, n_anc: int, hsq: float, n_causal: int, cor: float = 1.0, seed: int = 1, effects: DataFrame | None = None, covariates: DataFrame | None = None, cov_effects: dict[str, float] | None = None) -> DataFrame:
    """indiv, g (variance ``hsq``), pheno = g + covariates + noise of variance 1 - hsq."""
    if effects is None:
        effects = causal_effects(snps, n_causal, n_anc, cor, seed)
    out = scaled(genetic_value(geno, effects, n_anc), hsq)
    out = out.withColumn("pheno", F.col("g") + math.sqrt(max(1 - hsq, 0.0)) * normal(seed + 100, "indiv"))
    for name, effect in (cov_effects or {}).items():
        out = out.join(covariates.select("indiv", F.col(name).alias("_c")), "indiv").withColumn("pheno", F.col("pheno") + effect * F.col("_c")).drop("_c")
    return out


def quantitative_1pop(geno: DataFrame, prior: DataFrame, hsq: float, n_causal: int, seed: int = 1) -> DataFrame:
    """One population: effects normal with variance ``prior_var`` (snp, prior_var)."""
    chosen = prior.orderBy(uniform(seed, "snp")).limit(n_causal)
    weights = chosen.select("snp", F.lit("g").alias("col"), (F.sqrt("prior_var") * normal(seed + 10, "snp")).alias("w"))
    g = scaled(multiply(geno, weights).select("indiv", F.col("value").alias("g")), hsq)
    return g.withColumn("pheno", F.col("g") + math.sqrt(max(1 - hsq, 0.0)) * normal(seed + 100, "indiv"))


def from_kernels(kernels: DataFrame, variances: dict[str, float], covariates: DataFrame | None = None, effects: dict[str, float] | None = None, n_sim: int = 10, seed: int = 1, tile: int = 512, direct: int = 2048, steps: int = 80) -> DataFrame:
    """indiv, sim, pheno: draws from a normal with covariance sum of variance x kernel (``e``: the identity) around the
    covariates' effects (drawn by seed where not given).

    kernels: i, j (i >= j) and a column for each variance but e. A draw is the
    root of the covariance times normal numbers: by Cholesky up to ``direct``
    people, beyond by Lanczos on products of the distributed tiles.
    """
    from .kernels import Tiles
    from .variance import _triangle, lanczos

    names = [k for k in variances if k != "e"]
    tiles = Tiles(kernels.select("i", "j", *names), names, tile)
    n = len(tiles.ids)
    z = np.random.default_rng(seed).normal(size=(n, n_sim))
    if n <= direct:
        y = np.linalg.cholesky(sum((variances[k] * tiles.whole(k) for k in names), variances["e"] * np.eye(n))) @ z
    else:
        def apply(v: np.ndarray) -> np.ndarray:
            got = tiles.times(v)
            return sum((variances[k] * got[k] for k in names), variances["e"] * v)

        alphas, betas, basis = lanczos(apply, z, min(steps, n), keep=True)
        y = np.zeros_like(z)
        for c in range(n_sim):
            value, vector = _triangle(alphas, betas, c)
            root = vector @ (np.sqrt(np.maximum(value, 0.0)) * vector[0])
            y[:, c] = np.linalg.norm(z[:, c]) * sum(r * q[:, c] for r, q in zip(root, basis, strict=True))
    spark = kernels.sparkSession
    wide = spark.createDataFrame(pd.DataFrame(y, columns=[f"s{c}" for c in range(n_sim)]).assign(indiv=tiles.ids))
    out = wide.select("indiv", F.posexplode(F.array(*[f"s{c}" for c in range(n_sim)])).alias("sim", "pheno"))
    names = [c for c in covariates.columns if c != "indiv"] if covariates is not None else []
    if names:
        drawn = np.random.default_rng([seed, 1]).normal(size=len(names))
        b = {c: (effects or {}).get(c, float(x)) for c, x in zip(names, drawn, strict=True)}
        fixed = sum((F.lit(b[c]) * F.col(c) for c in names[1:]), F.lit(b[names[0]]) * F.col(names[0]))
        out = out.join(covariates.select("indiv", fixed.alias("_f")), "indiv").withColumn("pheno", F.col("pheno") + F.col("_f")).drop("_f")
    return out


def binary(values: DataFrame, prevalence: float, method: str = "probit", seed: int = 1) -> DataFrame:
    """Add ``case`` to (indiv, pheno). probit: the liability, centred, at or above its threshold; logit: Bernoulli of the logistic
    value, whose intercept brings the mean to the prevalence (30 bisection steps over a histogram of the values)."""
    from statistics import NormalDist

    if method == "probit":
        mean = values.agg(F.avg("pheno").alias("_m"), F.stddev_pop("pheno").alias("_s"))
        bar = -NormalDist().inv_cdf(prevalence)
        return values.crossJoin(F.broadcast(mean)).withColumn("case", (F.try_divide(F.col("pheno") - F.col("_m"), "_s") >= bar).cast("int")).drop("_m", "_s")
    if method != "logit":
        raise ValueError("method is probit or logit")
    lo, hi = values.agg(F.min("pheno"), F.max("pheno")).first()
    width = max((hi - lo) / 4096, 1e-12)
    hist = values.groupBy(F.floor((F.col("pheno") - lo) / width).alias("b")).agg(F.count("*").alias("n"), F.avg("pheno").alias("x")).toPandas()  # at most 4097 rows
    x, n = hist.x.to_numpy(), hist.n.to_numpy()
    a, b = -40 - hi, 40 - lo
    for _ in range(60):
        c = (a + b) / 2
        a, b = (c, b) if (n / (1 + np.exp(-np.clip(x + c, -500, 500)))).sum() / n.sum() < prevalence else (a, c)
    return values.withColumn("case", (uniform(seed, "indiv") < 1 / (1 + F.exp(-(F.col("pheno") + (a + b) / 2)))).cast("int"))


def case_control(values: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    """All cases and int(n_case * ratio) controls, chosen by hash."""
    n = int(values.agg(F.sum("case")).first()[0] or 0)
    controls = values.where("case = 0").orderBy(uniform(seed, "indiv")).limit(int(n * ratio))
    return values.where("case = 1").unionByName(controls)


def haplotype_ancestry(spark, n_snp: int, n_hap: int, mosaic: float, props: list[float], seed: int = 1) -> DataFrame:
    """indiv, ploidy, stop, anc: exponential segment lengths and ancestries by proportion, haplotype by haplotype."""
    schema = "indiv long, ploidy int, stop long, anc int"

    def draw(frames):
        for pdf in frames:
            out = []
            for hap in pdf["id"]:
                rng = np.random.default_rng([seed, int(hap)])
                at, last = 0.0, None
                while at < n_snp:
                    at += max(1.0, rng.exponential(mosaic))
                    anc = int(rng.choice(len(props), p=np.array(props) / np.sum(props)))
                    stop = min(int(round(at)), n_snp)
                    if last == anc:
                        out[-1] = (hap // 2, hap % 2, stop, anc)
                    else:
                        out.append((hap // 2, hap % 2, stop, anc))
                    last = anc
            yield pd.DataFrame(out, columns=["indiv", "ploidy", "stop", "anc"])

    from .._ship import ensure_on_workers

    ensure_on_workers(spark)
    return spark.range(n_hap).mapInPandas(draw, schema)


def copy_genotypes(haps: DataFrame, reference: DataFrame, n_ref: dict[int, int], seed: int = 1) -> DataFrame:
    """Genotypes of simulated people: each segment copies a reference haplotype of its ancestry, chosen by hash.

    haps: indiv, ploidy, stop, anc; reference: anc, ref (0 .. n_ref[anc] - 1), snp, allele.
    """
    w = Window.partitionBy("indiv", "ploidy").orderBy("stop")
    seg = haps.withColumn("start", F.lag("stop", 1, 0).over(w))
    sizes = F.create_map(*[F.lit(x) for kv in n_ref.items() for x in kv])
    seg = seg.withColumn("ref", F.floor(uniform(seed, "indiv", "ploidy", "stop") * sizes[F.col("anc")]).cast("int"))
    cells = seg.where("start < stop").select("indiv", "ploidy", "anc", "ref", F.explode(F.sequence("start", F.col("stop") - 1)).alias("snp"))
    got = cells.join(reference, ["anc", "ref", "snp"])
    return got.groupBy("snp", "indiv").agg(*[F.max(F.when(F.col("ploidy") == h, F.col("allele"))).alias(f"a{h}") for h in (0, 1)], *[F.max(F.when(F.col("ploidy") == h, F.col("anc"))).alias(f"c{h}") for h in (0, 1)])


def independent_genotypes(ancestry: DataFrame, freqs: DataFrame, seed: int = 1) -> DataFrame:
    """(snp, indiv, c0, c1) and (snp, f1..fk) -> alleles drawn by the frequency of each haplotype's ancestry."""
    k = len([c for c in freqs.columns if c.startswith("f")])
    j = ancestry.join(freqs, "snp")
    f = F.array(*[F.col(f"f{a + 1}") for a in range(k)])
    return j.select("snp", "indiv", *[(uniform(seed + 2 * h, "snp", "indiv") < F.element_at(f, F.col(f"c{h}") + 1)).cast("int").alias(f"a{h}") for h in (0, 1)], "c0", "c1")


def gamma(shape: Column, seed: int, *keys: str | Column, tries: int = 12) -> Column:
    """A gamma draw of scale 1 by squeezed normals: of ``tries`` hashed proposals the first accepted (each is with a chance of
    over 0.95); a shape below 1 is drawn one higher and scaled by a power of a uniform number."""
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1 / 3
    c = 1 / F.sqrt(9 * d)

    def proposal(t: Column) -> Column:
        x = normal(F.lit(seed) + 10 * t, *keys)
        return F.struct(x.alias("x"), F.pow(1 + c * x, F.lit(3.0)).alias("v"), uniform(F.lit(seed + 5) + 10 * t, *keys).alias("u"))

    # One small expression over the numbers of the tries, so that plans stay small.
    tried = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), proposal)
    accepted = lambda p: (p["v"] > 0) & (F.log(p["u"]) < 0.5 * p["x"] * p["x"] + d - d * p["v"] + d * F.log(p["v"]))
    low = F.when(shape < 1, F.pow(uniform(seed + 7, *keys), 1 / shape)).otherwise(1.0)
    return d * F.coalesce(F.get(F.filter(tried, accepted), F.lit(0))["v"], F.lit(1.0)) * low


def balding_nichols(freqs: DataFrame, fst: float, n_anc: int, seed: int = 1) -> DataFrame:
    """snp, f1..fk: ancestry frequencies drawn from the beta with mean ``freq`` and variance fst freq (1 - freq), as a quotient
    of two gammas. Frequencies 0 and 1 and fst 0 stay as they are."""
    scale = (1 - fst) / fst if fst > 0 else None

    def draw(a: int) -> Column:
        if scale is None:
            return F.col("freq")
        p = F.col("freq")
        x, y = gamma(p * scale, seed + 1000 * a, "snp"), gamma((1 - p) * scale, seed + 1000 * a + 500, "snp")
        return F.when((p <= 0) | (p >= 1), p).otherwise(F.coalesce(F.try_divide(x, x + y), p))

    return freqs.select("snp", *[draw(a).alias(f"f{a + 1}") for a in range(n_anc)])
