"""Association of every variant with a phenotype: seven designs, linear and logistic.

Linear: one pass makes, per variant, the sums of products of all columns that
any design uses (map-side combined, so a task shuffles one row per variant);
every design and its null model are then solved from these few numbers in Arrow
batches of variants. Nothing per individual is shuffled.

For ancestries 1..k, G_a are alleles on haplotypes of ancestry a, L_a the number
of such haplotypes (a < k), G their sum:

ATT G | SNP1 G given L | TRACTOR G_1..G_k given L | JOINT all of G_a, L_a |
ASE G_1..G_k | ADM L | HET equality of G_1..G_k
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ensure_on_workers
from ..functions.special import chi2_sf, f_sf
from .alleles import dosage, haplotypes_of, of_ancestry
from .frames import cut
from .logistic import one_pass, statistics

METHODS = ("ATT", "SNP1", "TRACTOR", "JOINT", "ASE", "ADM", "HET")


def design(method: str, k: int) -> tuple[list[str], list[int]]:
    """Names of a design's variables and which of them are tested."""
    g, lanc = [f"G{a + 1}" for a in range(k)], [f"L{a + 1}" for a in range(k - 1)]
    table = {"ATT": (["G"], 1), "SNP1": (["G", *lanc], 1), "TRACTOR": ([*g, *lanc], k), "JOINT": ([*g, *lanc], 2 * k - 1), "ASE": (g, k), "ADM": (lanc, k - 1), "HET": (g, k)}
    if method not in table:
        raise ValueError(f"method is one of {METHODS}")
    names, tested = table[method]
    return names, list(range(tested))


def columns(k: int) -> list[tuple[str, object]]:
    return [("G", dosage())] + [(f"G{a + 1}", of_ancestry(a)) for a in range(k)] + [(f"L{a + 1}", haplotypes_of(a)) for a in range(k - 1)]


def prepared(indivs: DataFrame, pheno: str, covariates: list[str]) -> DataFrame:
    """indiv, y and x0 = 1, x1..: rows with a phenotype; missing covariates take their mean; all are centred, so that sums of products stay small."""
    base = indivs.where(F.col(pheno).isNotNull()).select("indiv", F.col(pheno).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(covariates)])
    names = ["y", *[f"x{i + 1}" for i in range(len(covariates))]]
    means = base.agg(*[F.avg(c).alias(f"_{c}") for c in names])
    out = base.crossJoin(F.broadcast(means))  # one row
    return out.select("indiv", *[(F.coalesce(c, f"_{c}") - F.col(f"_{c}")).alias(c) for c in names], F.lit(1.0).alias("x0"))


def sufficient(geno: DataFrame, people: DataFrame, k: int, n_cov: int, only_ancestry: bool = False, most: int = 500_000) -> tuple[DataFrame, list[str]]:
    """Per variant: n and the sums of products of (x0.., variables, y) over complete rows.

    A missing allele takes its person out of the variant, except for designs
    of ancestry alone (``only_ancestry``). Up to ``most`` people go to the tasks
    whole; beyond, they and the panel are dealt by person.
    """
    cols = [c for c in columns(k) if not only_ancestry or c[0].startswith("L")]
    xs = [f"x{i}" for i in range(n_cov + 1)]
    wide = geno.select("snp", "indiv", *[c.cast("double").alias(n) for n, c in cols])
    if not only_ancestry:
        wide = wide.where(F.col("G").isNotNull())
    names = [*xs, *[n for n, _ in cols], "y"]
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]]
    people = F.broadcast(people) if people.count() <= most else people
    return wide.join(people, "indiv").groupBy("snp").agg(F.count("*").alias("n"), *pairs), names


def matrices(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    out = np.empty((len(pdf), len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            out[:, i, j] = out[:, j, i] = pdf[f"{a}*{b}"].to_numpy(float)
    return out


def solve(m: np.ndarray, use: list[int], y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least squares from cross products: (coefficients, inverse, rss, full rank) for columns ``use`` on column ``y``."""
    a, b, yy = m[:, use][:, :, use], m[:, use, y], m[:, y, y]
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0))
    ok = (scale > 0).all(axis=1)
    s = np.where(scale > 0, scale, 1)
    c = a / s[:, :, None] / s[:, None, :]
    c[~ok] = np.eye(len(use))
    ok &= np.linalg.eigvalsh(c)[:, 0] > 1e-10
    c[~ok] = np.eye(len(use))
    inv = np.linalg.inv(c) / s[:, :, None] / s[:, None, :]
    coef = np.einsum("nij,nj->ni", inv, b)
    return coef, inv, yy - np.einsum("ni,ni->n", coef, b), ok


def _tested(pdf: pd.DataFrame, names: list[str], method: str, k: int, n_cov: int) -> pd.DataFrame:
    variables, tested = design(method, k)
    m, n, y = matrices(pdf, names), pdf["n"].to_numpy(float), len(names) - 1
    base = list(range(n_cov + 1))
    use = base + [names.index(v) for v in variables]
    coef, inv, rss, ok = solve(m, use, y)
    p, q = len(use), len(tested)
    free = n - p
    if method == "HET":
        _, _, reduced, ok0 = solve(m, [*base, names.index("G")], y)
        q = k - 1
        with np.errstate(all="ignore"):
            stat = n * np.log(reduced / rss)
        pvalue = chi2_sf(np.maximum(np.nan_to_num(stat), 0), q)
    else:
        _, _, reduced, ok0 = solve(m, [c for i, c in enumerate(use) if i - len(base) not in tested], y)
        with np.errstate(all="ignore"):
            stat = ((reduced - rss) / q) / (rss / free)
        pvalue = f_sf(np.where(free > 0, np.nan_to_num(stat), 0), q, np.maximum(free, 1))
    good = ok & ok0 & (free > 0) & np.isfinite(stat) & (rss > 0)
    with np.errstate(all="ignore"):
        se = np.sqrt((rss / free)[:, None] * np.einsum("nii->ni", inv))
    out = {"snp": pdf["snp"].to_numpy()}
    for i, v in enumerate(variables):
        out[f"{v}_BETA"] = np.where(good, coef[:, len(base) + i], np.nan)
        out[f"{v}_SE"] = np.where(good, se[:, len(base) + i], np.nan)
    return pd.DataFrame(out | {"N": pdf["n"].to_numpy(np.int64), "STAT": np.where(good, stat, np.nan), "P": np.where(good, pvalue, np.nan)})


def linear(geno: DataFrame, indivs: DataFrame, pheno: str, n_anc: int, method: str = "ATT", covariates: list[str] | None = None) -> DataFrame:
    """snp, <V>_BETA, <V>_SE of each variable, N, STAT (F; a likelihood ratio for HET), P; null but for N where a design lacks rank."""
    covariates = covariates or []
    people = prepared(indivs, pheno, covariates)
    sums, names = sufficient(geno, people, n_anc, len(covariates), method == "ADM")
    return tests(sums, names, method, n_anc, len(covariates))


def tests(sums: DataFrame, names: list[str], method: str, n_anc: int, n_cov: int) -> DataFrame:
    """One design's table from sums that several designs may share."""
    variables, _ = design(method, n_anc)
    cols = [f"{v}_{x}" for v in variables for x in ("BETA", "SE")]
    schema = "snp long, " + ", ".join(f"{c} double" for c in cols) + ", N long, STAT double, P double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield _tested(pdf, names, method, n_anc, n_cov)

    ensure_on_workers(sums.sparkSession)
    solved = sums.mapInPandas(run, schema)
    return solved.select("snp", *[F.nullif(F.nanvl(c, F.lit(None)), F.lit(float("nan"))).alias(c) for c in cols], "N", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("STAT", "P")])


def _newton(pdf: pd.DataFrame, last: bool, tol: float = 1e-6) -> pd.DataFrame:
    """One step of each variant's fit from its sums at ``beta``: the next coefficients, or how the fit ended (1 converged, -1 not)."""
    out = []
    for snp, n, beta, se, before, ll, g, h in zip(*[pdf[c] for c in ("snp", "n", "beta", "se", "before", "ll", "g", "h")], strict=True):
        beta, g = np.asarray(beta), np.asarray(g)
        h = np.asarray(h).reshape(len(g), len(g))
        if abs(ll - before) < tol * (abs(ll) + tol):
            out.append((snp, n, beta, se, ll, 1))
            continue
        size = np.sqrt(np.diag(h))
        if last or not (size > 1e-8).all() or np.linalg.eigvalsh(h / np.outer(size, size))[0] < 1e-10:
            out.append((snp, n, beta, se, ll, -1))
            continue
        # The first likelihood, at coefficients of 0, ends no fit.
        out.append((snp, n, beta + np.linalg.solve(h, g), np.sqrt(np.diag(np.linalg.inv(h))), -np.inf if before == np.inf else ll, 0))
    return pd.DataFrame(out, columns=["snp", "n", "beta", "se", "before", "state"])


def _logistic(rows: DataFrame, names: list[str], steps: int = 100) -> DataFrame:
    """snp, n, beta, se, before (the log-likelihood), state: iteratively reweighted least squares of y on ``names`` for every variant.

    A step sums X'WX, X'(y - mu) and the log-likelihood per variant (map-side
    combined) and solves only these; variants that have ended leave the next.
    """
    p = len(names)
    schema = "snp long, n long, beta array<double>, se array<double>, before double, state int"
    zeros = F.array(*[F.lit(0.0)] * p)
    done, active, at = [], None, rows.select("snp", "y", *names, zeros.alias("beta"))
    for step in range(steps + 1):
        eta = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(names[1:], 1)), F.col("beta")[0] * F.col(names[0]))
        e = at.withColumn("_e", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))).withColumn("_mu", 1 / (1 + F.exp(-F.col("_e"))))
        e = e.withColumn("_w", F.greatest(F.col("_mu") * (1 - F.col("_mu")), F.lit(1e-12)))
        ll = F.sum(F.col("y") * F.col("_e") - F.greatest(F.col("_e"), F.lit(0.0)) - F.log1p(F.exp(-F.abs("_e"))))
        g = F.array(*[F.sum(F.col(c) * (F.col("y") - F.col("_mu"))) for c in names])
        h = {(i, j): F.sum(F.col(names[i]) * F.col(names[j]) * F.col("_w")).alias(f"_h{i}_{j}") for i in range(p) for j in range(i, p)}
        sums = e.groupBy("snp").agg(F.count("*").alias("n"), ll.alias("ll"), g.alias("g"), *h.values())
        sums = sums.select("snp", "n", "ll", "g", F.array(*[F.col(f"_h{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("h"))
        if active is None:
            sums = sums.withColumn("beta", zeros).withColumn("se", zeros).withColumn("before", F.lit(float("inf")))
        else:
            sums = sums.join(active.select("snp", "beta", "se", "before"), "snp")

        def run(frames: Iterator[pd.DataFrame], last: bool = step == steps) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    yield _newton(pdf, last)

        now = cut(sums.select("snp", "n", "beta", "se", "before", "ll", "g", "h").mapInPandas(run, schema))
        done.append(now.where("state <> 0"))
        active = now.where("state = 0")
        left = active.count()
        if not left:
            break
        betas = active.select("snp", "beta")
        at = rows.join(F.broadcast(betas) if left <= 50_000 else betas, "snp")
    return reduce(DataFrame.unionByName, done)


def logistic(geno: DataFrame, indivs: DataFrame, pheno: str, n_anc: int, method: str = "ATT", covariates: list[str] | None = None, most: int = 500_000) -> DataFrame:
    """As ``linear`` for a phenotype of 0 and 1: likelihood-ratio tests of maximum-likelihood fits.

    Up to ``most`` people, whose phenotypes and covariates are shared with the tasks, the panel is read once and a block
    of variants takes all its steps in a task. Beyond, every step of the fits is one map-side combined sum per variant,
    so no row or group grows with the number of people; steps then run when this is called. Both stop alike.
    """
    covariates = covariates or []
    variables, tested = design(method, n_anc)
    bad = indivs.where(F.col(pheno).isNotNull() & ~F.col(pheno).isin(0, 1)).limit(1).count()
    if bad:
        raise ValueError("a logistic phenotype is 0 or 1")
    people = prepared(indivs, pheno, covariates).drop("y").join(indivs.select("indiv", F.col(pheno).cast("double").alias("y")), "indiv")
    need = dict(columns(n_anc))
    xs = [f"x{i}" for i in range(len(covariates) + 1)]
    vs = [*variables, "G"] if method == "HET" else variables
    null_names = [*xs, "G"] if method == "HET" else [*xs, *[v for i, v in enumerate(variables) if i not in tested]]
    ensure_on_workers(geno.sparkSession)
    people = cut(people)
    count = people.count()
    if count <= most:
        both = one_pass(geno, people, {v: need[v] for v in dict.fromkeys(vs)}, [*xs, *variables], null_names)
    else:
        wide = geno.select("snp", "indiv", *[need[v].cast("double").alias(v) for v in dict.fromkeys(vs)])
        wide = wide.where(F.col(vs[0]).isNotNull()) if method == "ADM" else wide.where(F.concat(*vs).isNotNull())
        rows = wide.join(F.broadcast(people) if count <= 50_000 else people, "indiv")
        full, null = _logistic(rows, [*xs, *variables]), _logistic(rows, null_names)
        both = full.join(null.select("snp", F.col("before").alias("null_ll"), F.col("state").alias("null_state")), "snp")
    cols = [f"{v}_{x}" for v in variables for x in ("BETA", "SE")]
    solved = statistics(both, cols, len(xs), n_anc - 1 if method == "HET" else len(tested), chi2_sf)
    return solved.select("snp", *[F.nanvl(c, F.lit(None)).alias(c) for c in cols], "N", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("STAT", "P")])


def marginal(geno: DataFrame, indivs: DataFrame, pheno: str, n_anc: int, method: str = "ATT", covariates: list[str] | None = None, family: str = "linear") -> DataFrame:
    if family not in ("linear", "logistic"):
        raise ValueError("family is linear or logistic")
    return (linear if family == "linear" else logistic)(geno, indivs, pheno, n_anc, method, covariates)


def simple(geno: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Many phenotypes (indiv, sim, y), one predictor: snp, sim, coef, se, z; X and Y centred, X mean-imputed, the error
    variance that of Y (no correction for degrees of freedom)."""
    g = geno.select("snp", "indiv", dosage().cast("double").alias("g"))
    m = g.groupBy("snp").agg(F.avg("g").alias("_m"), F.sum(F.col("g") * F.col("g")).alias("_q"), F.count("g").alias("_n"))
    xx = m.select("snp", "_m", (F.col("_q") - F.col("_n") * F.col("_m") * F.col("_m")).alias("_xx"))
    y = phenotypes.groupBy("sim").agg(F.avg("y").alias("_my"), F.var_pop("y").alias("_vy"))
    centred = phenotypes.join(y, "sim").select("indiv", "sim", (F.col("y") - F.col("_my")).alias("y"), "_vy")
    # A missing dosage is its variant's mean, 0 once centred, so it adds nothing to the products.
    # sum over people present of (g - m) y = sum(g y) - m sum(y): one pass, no join of means to genotypes.
    xy = g.where("g IS NOT NULL").join(centred, "indiv").groupBy("snp", "sim").agg(F.sum(F.col("g") * F.col("y")).alias("_gy"), F.sum("y").alias("_sy"), F.first("_vy").alias("_vy"))
    j = xy.join(xx, "snp").where("_xx > 0")
    coef = (F.col("_gy") - F.col("_m") * F.col("_sy")) / F.col("_xx")
    se = F.sqrt(F.col("_vy") / F.col("_xx"))
    return j.select("snp", "sim", coef.alias("coef"), se.alias("se"), F.try_divide(coef, se).alias("z"))
