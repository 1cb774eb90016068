"""Variance components and cross-ancestry genetic correlation from kernels in long form (i, j, columns; i >= j)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ensure_on_workers
from ..functions.special import chi2_sf
from . import cholesky
from .frames import written
from .kernels import Tiles


def with_identity(kernels: DataFrame, name: str = "e") -> DataFrame:
    return kernels.withColumn(name, (F.col("i") == F.col("j")).cast("double"))


def twice() -> Column:
    """The weight of a lower-triangle entry in a sum over the whole matrix."""
    return F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)


def trace_products(kernels: DataFrame, names: list[str]) -> DataFrame:
    """a, b, value: the sum of the products of all entries, for every two kernels."""
    pairs = [(a, b) for p, a in enumerate(names) for b in names[p:]]
    wide = kernels.agg(*[F.sum(F.col(a) * F.col(b) * twice()).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs])))


def times(kernels: DataFrame, names: list[str], vectors: DataFrame, columns: list[str]) -> DataFrame:
    """i, <k>_<c> = (K c)_i of every kernel and column of (indiv, columns)."""
    v = vectors.select(F.col("indiv").alias("j"), *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    both = kernels.select("i", "j", *names).unionByName(kernels.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *names))
    return both.join(v, "j").groupBy("i").agg(*[F.sum(F.col(k) * F.col(f"_{c}")).alias(f"{k}_{c}") for k in names for c in columns])


def _gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    row = df.agg(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}|{b}") for a in columns for b in columns]).first()
    return np.array([[row[f"{a}|{b}"] for b in columns] for a in columns])


def he_moments(kernels: DataFrame, names: list[str], people: DataFrame, covariates: list[str]) -> tuple[DataFrame, DataFrame]:
    """(design: a, b, value), (response: a, value) of Haseman-Elston regression of y on kernels, both projected off the covariates.

    With P the projection, design is tr(P K_a K_b) = sum of K_a o K_b less
    sum of (C'C)^-1 o (K_a C)'(K_b C); response is (P y)' K_a (P y). Only vectors
    meet the kernels; the covariates' small inverse is the driver's. Kernels are
    dear and are read several times, so they are written first.
    people: indiv, y, covariates (with the intercept as a column of ones).
    """
    kernels = written(kernels.select("i", "j", *names))
    inv = np.linalg.inv(_gram(people, covariates)) if covariates else np.zeros((0, 0))
    plain = trace_products(kernels, names)
    y = people.select("indiv", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in covariates])
    if covariates:
        cy = np.array(y.agg(*[F.sum(F.col(c) * F.col("y")).alias(c) for c in covariates]).first())
        coef = inv @ cy
        fit = sum((F.lit(float(b)) * F.col(c) for b, c in zip(coef[1:], covariates[1:], strict=True)), F.lit(float(coef[0])) * F.col(covariates[0]))
        y = y.withColumn("y", F.col("y") - fit)
        kc = times(kernels, names, y, covariates)
        less = []
        for p, a in enumerate(names):
            for b in names[p:]:
                terms = [F.lit(float(inv[r, s])) * F.sum(F.col(f"{a}_{ca}") * F.col(f"{b}_{cb}")) for r, ca in enumerate(covariates) for s, cb in enumerate(covariates)]
                less.append((a, b, sum(terms[1:], terms[0])))
        wide = kc.agg(*[t.alias(f"{a}|{b}") for a, b, t in less])
        minus = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("_less")) for a, b, _ in less])))
        plain = plain.join(minus, ["a", "b"]).select("a", "b", (F.col("value") - F.col("_less")).alias("value"))
    ky = times(kernels, names, y, ["y"]).join(y.select(F.col("indiv").alias("i"), "y"), "i")
    wide = ky.agg(*[F.sum(F.col("y") * F.col(f"{k}_y")).alias(k) for k in names])
    response = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("a"), F.col(k).alias("value")) for k in names])))
    return plain, response


def he_regression(kernels: DataFrame, names: list[str], people: DataFrame, covariates: list[str]) -> dict[str, float]:
    """Variance of each kernel and of the environment (e). What is solved is as small as the number of kernels."""
    return _he(with_identity(kernels), [*names, "e"], people, covariates)[0]


def _he(kernels: DataFrame, full: list[str], people: DataFrame, covariates: list[str]) -> tuple[dict[str, float], np.ndarray]:
    """The regression's variances and its design."""
    design, response = he_moments(kernels, full, people, covariates)
    m, r = np.zeros((len(full),) * 2), np.zeros(len(full))
    for row in design.collect():
        p, q = full.index(row["a"]), full.index(row["b"])
        m[p, q] = m[q, p] = row["value"]
    for row in response.collect():
        r[full.index(row["a"])] = row["value"]
    return dict(zip(full, np.linalg.solve(m, r).tolist(), strict=True)), m


def mixed(kernels: DataFrame, grid: list[float]) -> DataFrame:
    """rg, i, j, value = k1 + rg * k2 at every grid point."""
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    return kernels.select(points.alias("rg"), "i", "j", "k1", "k2").select("rg", "i", "j", (F.col("k1") + F.col("rg") * F.col("k2")).alias("value"))


DIRECT = 2048


def lanczos(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Alphas and betas (steps x columns) of the Lanczos recurrence from every column, and the vectors if asked for. A
    column whose space is used up goes on with zeros, which have no weight."""
    v = start / np.maximum(np.linalg.norm(start, axis=0), 1e-300)
    before, beta = np.zeros_like(v), np.zeros(v.shape[1])
    alphas, betas, basis = [], [], []
    for _ in range(steps):
        if keep:
            basis.append(v)
        w = apply(v) - beta * before
        alpha = (w * v).sum(axis=0)
        w -= alpha * v
        for q in basis:  # only where vectors are kept: they stay orthogonal
            w -= (q * w).sum(axis=0) * q
        size = np.linalg.norm(w, axis=0)
        live = size > 1e-10 * np.maximum(1.0, np.abs(alpha))
        alphas.append(alpha)
        betas.append(np.where(live, size, 0.0))
        before, beta, v = v, betas[-1], np.where(live, w / np.where(live, size, 1.0), 0.0)
        if not live.any():
            break
    return np.array(alphas), np.array(betas), basis


def _triangle(alphas: np.ndarray, betas: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.diag(alphas[:, c]) + np.diag(betas[:-1, c], 1) + np.diag(betas[:-1, c], -1)
    return np.linalg.eigh(t)


def maximise(theta: np.ndarray, z: np.ndarray, weight: np.ndarray, n: int) -> tuple[float, float, float]:
    """(restricted log-likelihood, genetic variance, environmental variance) for eigenvalues with squared coordinates ``z`` of
    y and counts ``weight`` (ones if all n eigenvalues are listed), by a search over the genetic share."""
    seen = theta[(weight > 1e-12) | (z > 0)]

    def at(t: float) -> tuple[float, float]:
        d = t * theta + (1 - t)
        if (t * seen + (1 - t)).min() <= 1e-10:
            return -np.inf, 0.0
        d = np.maximum(d, 1e-10)
        var = (z / d).sum() / n
        return -0.5 * (n * np.log(2 * np.pi * var) + (weight * np.log(d)).sum() + n), var

    top = seen.max()
    # Shares below 0 are allowed as far as the matrix stays positive.
    lowest = max(-0.5, -0.99 / max(top - 1, 1e-6)) if top > 1 else -0.5
    grid = np.linspace(lowest, 0.999, 60)
    best = int(np.argmax([at(t)[0] for t in grid]))
    a, b, g = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], (np.sqrt(5) - 1) / 2
    for _ in range(60):
        x, w = b - g * (b - a), a + g * (b - a)
        a, b = (a, w) if at(x)[0] >= at(w)[0] else (x, b)
    ll, var = at((a + b) / 2)
    return float(ll), float(var * (a + b) / 2), float(var * (1 - (a + b) / 2))


def reml(k: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float, float]:
    """(restricted log-likelihood, genetic variance, environmental variance) by one eigen-decomposition."""
    u, _, _ = np.linalg.svd(c, full_matrices=True)
    q = u[:, np.linalg.matrix_rank(c) :]
    s, v = np.linalg.eigh(q.T @ k @ q)
    return maximise(s, (v.T @ (q.T @ y)) ** 2, np.ones(len(s)), len(s))


def _people(kernels: DataFrame, people: DataFrame, columns: list[str], names: list[str], tile: int) -> tuple[Tiles, np.ndarray]:
    """Tiles over the people of both tables without a null, and their columns in the tiles' order (a number per person and column)."""
    who = people.select("indiv", *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    ids = who.select("indiv")
    k = kernels.join(ids.withColumnRenamed("indiv", "i"), "i", "left_semi").join(ids.withColumnRenamed("indiv", "j"), "j", "left_semi")
    tiles = Tiles(k.select("i", "j", *names), names, tile)
    rows = who.toPandas().drop_duplicates("indiv").set_index("indiv").loc[tiles.ids]
    return tiles, rows[columns].to_numpy(float).reshape(len(tiles.ids), len(columns))


def correlation_curve(kernels: DataFrame, people: DataFrame, covariates: list[str], grid: list[float] | None = None, tile: int = 512, direct: int = DIRECT, probes: int | None = None, steps: int = 60, seed: int = 5) -> DataFrame:
    """rg, loglkl, vg, ve: the restricted likelihood of K1 + rg K2 at each grid point. People missing from either side are left out.

    Exact at every size. Up to ``direct`` people, the matrices are shared (67 MB)
    and points are factored in parallel. Beyond, no matrix leaves its tiles: the
    points' covariances are factored by blocked Cholesky rounds side by side, at
    the genetic shares that a search for each point's maximum asks for.

    With ``probes`` (beyond ``direct`` people) it is an estimate at far less work:
    Lanczos recurrences of all points, from y and from so many random vectors, on
    products of tiles with a thin matrix; quadratic forms of y are exact to
    rounding after few steps, the log determinant is a mean over the probes, which
    are the same at every point, so that curves are smooth.
    """
    spark = kernels.sparkSession
    grid = [i / 20 for i in range(21)] if grid is None else grid
    tiles, x = _people(kernels, people, ["y", *covariates], ["k1", "k2"], tile)
    n = len(tiles.ids)
    y, c = x[:, 0], x[:, 1:] if covariates else np.ones((n, 1))
    schema = "rg double, loglkl double, vg double, ve double"
    if n <= direct:
        shared = spark.sparkContext.broadcast((tiles.whole("k1"), tiles.whole("k2"), y, c))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k1, k2, y, c = shared.value
            for pdf in frames:
                yield pd.DataFrame([(g, *reml(k1 + g * k2, y, c)) for g in pdf["rg"]], columns=["rg", "loglkl", "vg", "ve"])

        ensure_on_workers(spark)
        points = spark.createDataFrame([(float(g),) for g in grid], "rg double").repartition(len(grid))
        return points.mapInPandas(run, schema)
    q = np.linalg.qr(c)[0][:, : np.linalg.matrix_rank(c)]
    off = lambda v: v - q @ (q.T @ v)
    free = n - q.shape[1]
    if probes is None:
        return spark.createDataFrame(_exact_curve(tiles, [float(g) for g in grid], y, q, free), schema)
    z = off(np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, probes)))
    first = np.column_stack((off(y), z))
    w = first.shape[1]
    rg = np.repeat(np.array(grid, float), w)

    def apply(v: np.ndarray) -> np.ndarray:
        got = tiles.times(v)
        return off(got["k1"] + rg * got["k2"])

    alphas, betas, _ = lanczos(apply, np.tile(first, (1, len(grid))), min(steps, free))
    out = []
    for g, point in enumerate(grid):
        theta, squares, counts = [], [], []
        for i in range(w):
            value, vector = _triangle(alphas, betas, g * w + i)
            mass = vector[0] ** 2
            theta.append(value)
            squares.append(mass * (first[:, 0] @ first[:, 0]) if i == 0 else np.zeros(len(mass)))
            counts.append(mass * free / probes if i else np.zeros(len(mass)))
        out.append((float(point), *maximise(np.concatenate(theta), np.concatenate(squares), np.concatenate(counts), free)))
    return spark.createDataFrame(out, schema)


def _exact_curve(tiles: Tiles, grid: list[float], y: np.ndarray, q: np.ndarray, free: int) -> list[tuple[float, float, float, float]]:
    """(rg, restricted log-likelihood, genetic variance, environmental variance) at every grid point's best genetic share.
    Shares below 0 are allowed as far as the matrix stays positive."""
    known: dict[tuple[int, float], tuple[float, float]] = {}

    def at(asked: list[tuple[int, float]]) -> list[float]:
        forms = cholesky.quadratic_forms(tiles, [{"k1": t, "k2": t * grid[g], "e": 1 - t} for g, t in asked], y, q)
        for key, (log, form) in zip(asked, forms, strict=True):
            var = form / free
            known[key] = (-0.5 * (free * np.log(2 * np.pi * var) + log + free), var) if np.isfinite(log) and var > 0 else (-np.inf, 0.0)
        return [known[key][0] for key in asked]

    best = cholesky.peaks(at, len(grid), -0.5, 0.999)
    return [(rg, float(ll), float(var * t), float(var * (1 - t))) for g, (rg, t) in enumerate(zip(grid, best, strict=True)) for ll, var in (known[g, t],)]


def he_covariance(kernels: DataFrame, names: list[str], people: DataFrame, covariates: list[str], tile: int = 512, columns: int = 256, probes: int | None = None, seed: int = 5) -> tuple[dict[str, float], np.ndarray]:
    """(variances of the kernels and e, their sampling covariance D^-1 V D^-1) of Haseman-Elston regression.

    With G_a = K_a P and S the sum of the kernels at their variances times P, V is
    2 tr((S G_a)' (S G_b)). The trace is exact as a sum over unit vectors, which
    pass the tiles ``columns`` at a time; with ``probes`` it is a mean over so
    many random vectors instead.
    """
    full = [*names, "e"]
    kernels = written(kernels.select("i", "j", *names))
    est, design = _he(with_identity(kernels), full, people, covariates)
    tiles, x = _people(kernels, people, ["y", *covariates], names, tile)
    n = len(tiles.ids)
    q = np.linalg.qr(x[:, 1:])[0] if covariates else np.zeros((n, 0))
    off = lambda v: v - q @ (q.T @ v)

    def each(v: np.ndarray) -> list[np.ndarray]:
        v = off(v)
        return [*tiles.times(v).values(), v]

    v = np.zeros((len(full),) * 2)
    random = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, probes)) if probes else None
    for a in range(0, probes or n, columns):
        start = random[:, a : a + columns] if probes else np.eye(n, min(columns, n - a), -a)
        images = each(start)
        width = start.shape[1]
        stacked = each(np.hstack(images))
        total = sum(est[name] * s for name, s in zip(full, stacked, strict=True))
        parts = [total[:, i * width : (i + 1) * width] for i in range(len(full))]
        v += 2 * np.array([[(s * t).sum() for t in parts] for s in parts]) / (probes or 1)
    inv = np.linalg.inv(design)
    return est, inv @ v @ inv


def reml_components(kernels: DataFrame, names: list[str], people: DataFrame, covariates: list[str], tile: int = 512, direct: int = DIRECT, probes: int | None = None, rounds: int = 50, tolerance: float = 1e-6, seed: int = 5) -> dict:
    """Variances of several kernels and e by restricted maximum likelihood: {"var", "varcov", "rounds"}.

    Average-information steps. What is needed of V^-1 is its product with y, the
    covariates and vectors that come of them, and traces of P K_a. Exact at every
    size: up to ``direct`` people from one inverse, beyond from the inverse as
    tiles, by blocked Cholesky rounds. With ``probes`` (beyond ``direct`` people)
    an estimate at less work: conjugate gradients on products of tiles, traces
    as means over so many random vectors.
    """
    tiles, x = _people(kernels, people, ["y", *covariates], names, tile)
    n = len(tiles.ids)
    y, c = x[:, 0], x[:, 1:] if covariates else np.ones((n, 1))
    full = [*names, "e"]
    if n <= direct:
        # Factored in a task, as bounded work for an executor.
        spark = kernels.sparkSession
        shared = spark.sparkContext.broadcast(([tiles.whole(k) for k in names], y, c))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            dense, y, c = shared.value
            for _ in frames:
                var, cov, done = _dense_components(dense, y, c, rounds, tolerance)
                yield pd.DataFrame({"var": [var], "cov": [cov.ravel()], "rounds": [done]})

        ensure_on_workers(spark)
        got = spark.range(0, 1, 1, 1).mapInPandas(run, "var array<double>, cov array<double>, rounds int").first()
        return {"var": dict(zip(full, got["var"], strict=True)), "varcov": np.array(got["cov"]).reshape(len(full), -1), "rounds": got["rounds"]}

    def each(v: np.ndarray) -> list[np.ndarray]:
        return [*tiles.times(v).values(), v]

    if probes is None:
        var, cov, done = _tiled_components(tiles, each, y, c, rounds, tolerance)
        return {"var": dict(zip(full, var.tolist(), strict=True)), "varcov": cov, "rounds": done}
    z = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, probes))
    var, cov, done = stochastic_components(each, y, c, z, rounds, tolerance)
    return {"var": dict(zip(full, var.tolist(), strict=True)), "varcov": cov, "rounds": done}


def _tiled_components(tiles: Tiles, each: Callable, y: np.ndarray, c: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Components from inverses as tiles; the last one is kept, as a step that is accepted is the next one's start."""
    last: dict[bytes, Tiles | None] = {}

    def at(var: np.ndarray) -> Tiles | None:
        if var.tobytes() not in last:
            last.clear()
            got = cholesky.inverse(tiles, dict(zip([*tiles.columns, "e"], var.tolist(), strict=True)))
            last[var.tobytes()] = got[1] if got else None
        return last[var.tobytes()]

    def whole(var: np.ndarray) -> np.ndarray:
        got = cholesky.traces(at(var), tiles)
        return np.array([got[k] for k in [*tiles.columns, "e"]])

    nothing = np.zeros((len(y), 0))
    return _average_information(each, lambda v, b: at(v).times(b)["v"], lambda v: bool(v[-1] > 0) and at(v) is not None, y, c, nothing, 1.0, rounds, tolerance, whole)


def stochastic_components(each: Callable, y: np.ndarray, c: np.ndarray, z: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Components from products with the kernels alone; conjugate gradients meet a negative curvature where the covariance isn't positive."""

    def positive(v: np.ndarray) -> bool:
        try:
            conjugate_gradients(each, v, np.column_stack((y, z[:, :2])))
        except np.linalg.LinAlgError:
            return False
        return bool(v[-1] > 0)

    return _average_information(each, lambda v, b: conjugate_gradients(each, v, b), positive, y, c, z, 1 / z.shape[1], rounds, tolerance)


def conjugate_gradients(each: Callable, var: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(sum of var x kernel)^-1 b for all columns side by side; ``each`` multiplies by every kernel."""
    out, r = np.zeros_like(b), b.copy()
    p, size = r.copy(), (r * r).sum(axis=0)
    least = 1e-20 * np.maximum(size, 1e-300)
    for _ in range(2 * len(b)):
        vp = sum(s * k for s, k in zip(var, each(p), strict=True))
        bend = (p * vp).sum(axis=0)
        if (bend[size > least] <= 0).any():
            raise np.linalg.LinAlgError("not positive")
        step = np.where(size > least, size / np.where(size > least, bend, 1.0), 0.0)
        out, r = out + step * p, r - step * vp
        new = (r * r).sum(axis=0)
        if (new <= least).all():
            break
        p, size = r + np.where(size > least, new / np.where(size > least, size, 1.0), 0.0) * p, new
    return out


def _dense_components(dense: list[np.ndarray], y: np.ndarray, c: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    one = np.eye(len(y))
    total = lambda v: sum(s * k for s, k in zip(v, [*dense, one], strict=True))

    def positive(v: np.ndarray) -> bool:
        try:
            np.linalg.cholesky(total(v))
        except np.linalg.LinAlgError:
            return False
        return bool(v[-1] > 0)

    return _average_information(lambda v: [*(k @ v for k in dense), v], lambda v, b: np.linalg.solve(total(v), b), positive, y, c, one, 1.0, rounds, tolerance)


def _average_information(each: Callable, solve: Callable, positive: Callable, y: np.ndarray, c: np.ndarray, z: np.ndarray, weight: float, rounds: int, tolerance: float, traces: Callable | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(variances, their covariance, rounds): ``each`` multiplies by every kernel, ``solve`` by the inverse covariance; traces
    are ``weight`` times sums over the columns of z, or come from ``traces`` (those of the inverse times every kernel)."""
    var = np.full(len(each(y[:, None])), y.var())
    var /= len(var)
    for done in range(1, rounds + 1):
        inverse = solve(var, np.column_stack((y, c, z)))
        vy, vc, vz = inverse[:, 0], inverse[:, 1 : 1 + c.shape[1]], inverse[:, 1 + c.shape[1] :]
        middle = np.linalg.inv(c.T @ vc)
        project = lambda raw, b: raw - vc @ (middle @ (vc.T @ b))  # noqa: E731, B023
        py, pz = project(vy, y), project(vz, z)
        kpy = np.column_stack(each(py[:, None]))
        ai = kpy.T @ project(solve(var, kpy), kpy) / 2
        if traces is None:
            trace = weight * np.array([(pz * k).sum() for k in each(z)])
        else:
            trace = traces(var) - np.array([np.trace(middle @ (vc.T @ k)) for k in each(vc)])
        score = ((kpy * py[:, None]).sum(axis=0) - trace) / 2
        step = np.linalg.lstsq(ai, score, rcond=None)[0]
        # The covariance has to stay positive: a step that leaves is halved.
        scale = 1.0
        while scale > 1e-6 and not (np.isfinite(step).all() and positive(var + scale * step)):
            scale /= 2
        if scale <= 1e-6:
            break
        var = var + scale * step
        if np.abs(scale * step).max() <= tolerance * y.var():
            break
    return var, np.linalg.pinv(ai), done


def estimate(kernels: DataFrame, names: list[str], people: DataFrame, covariates: list[str], method: str = "HE", **options) -> dict[str, float]:
    """Variances of kernels and e by moments (HE) or restricted likelihood (REML)."""
    if method == "HE":
        return he_regression(kernels, names, people, covariates)
    if method == "REML":
        return reml_components(kernels, names, people, covariates, **options)["var"]
    raise ValueError("method is HE or REML")


def sum_curves(curves: DataFrame) -> DataFrame:
    """Curves of several studies on one grid, added up. A not-a-knot spline is linear in its data, so one spline of the sum is the sum of splines."""
    return curves.groupBy("rg").agg(F.sum("loglkl").alias("loglkl"))


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline whose third derivative is continuous at the second and the last but one knot, in time linear in the knots."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h = np.diff(x)
    # Three diagonals for the inner second derivatives; the ends are put in terms of their neighbours.
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    b = 6 * (np.diff(y[1:]) / h[1:] - np.diff(y[:-1]) / h[:-1])
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] * h[0] / h[1]
    mid[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    low[-1] -= h[-1] * h[-1] / h[-2]
    m = np.zeros(n)
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        b[i] -= f * b[i - 1]
    m[n - 2] = b[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (b[i] - up[i] * m[i + 2]) / mid[i]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-2] + h[-1]) * m[-2] - h[-1] * m[-3]) / h[-2]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    lo, hi = x[k + 1] - at, at - x[k]
    return (m[k] * lo**3 + m[k + 1] * hi**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * lo + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * hi


def summary(curve: DataFrame, points: int = 1001) -> dict:
    """Mode, 50 % and 95 % intervals of highest density and the p value of rg = 1, from a curve: one row per grid point."""
    rows = curve.select("rg", "loglkl").orderBy("rg").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    fine = np.linspace(x[0], x[-1], points)
    ll = not_a_knot(x, y, fine)
    lrt = max(0.0, 2 * float(ll.max() - ll[-1]))
    return {"rg_mode": float(fine[ll.argmax()]), "rg_hpdi_50": density_intervals(fine, ll, 0.5), "rg_hpdi_95": density_intervals(fine, ll, 0.95), "rg1_p": float(chi2_sf(np.array([lrt]), 1)[0])}


def density_intervals(x: np.ndarray, ll: np.ndarray, ci: float) -> list[tuple[float, float]]:
    p = np.exp(ll - ll.max())
    p /= p.sum()
    down = np.sort(p)[::-1]
    inside = p > down[int(np.argmax(np.cumsum(down) >= ci))]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(int)))
    return [(float(x[a]), float(x[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
