"""Relationship and linkage-disequilibrium matrices by tiled cross products.

The entities (people for a GRM, variants for LD) are cut into tiles. A
feature's values for a tile are packed into one row; pairs of tiles are cells,
and where cells are few their features are dealt over several tasks. A task
streams its features in blocks through BLAS and holds two tiles and their
product, whatever the number of features; partial products are added up. No row
per pair and feature is ever made, and with a window only neighbouring tiles meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ensure_on_workers
from ..functions.ordering import dense_index
from .alleles import dosage, of_ancestry
from .frames import discard, written
from .packed import coded_products

TILE = 512
BLOCK = 1024


def cross_products(values: DataFrame, names: list[str], tile: int = TILE, within: int | None = None, tasks: int | None = None) -> DataFrame:
    """(block, feature, entity, <names>) -> block, i, j (i >= j), and <a>_<b> = sum over features of a_i * b_j for all names a, b.

    Entities are compared inside their ``block`` only (a chromosome, or 0 for
    all), and with ``within`` only those fewer places apart. Nulls count as 0.
    A block of few cells is dealt over about ``tasks`` tasks by features.
    """
    tasks = tasks or min(64, max(8, values.sparkSession.sparkContext.defaultParallelism))
    if within is not None:
        tile = min(tile, max(16, within))
    v = values.select("block", "feature", "entity", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    v = v.withColumn("tile", F.floor(F.col("entity") / tile))
    rows = F.sort_array(F.collect_list(F.struct("entity", *names)))
    packed = v.groupBy("block", "feature", "tile").agg(rows.alias("_r"))
    packed = packed.select("block", "feature", "tile", F.col("_r").getField("entity").alias("ids"), *[F.col("_r").getField(n).alias(n) for n in names])
    tiles = v.select("block", "tile").distinct().groupBy("block").agg(F.sort_array(F.collect_set("tile")).alias("_t"))
    # A tile goes to the cells it is the larger or the smaller half of.
    near = F.col("_t") if within is None else F.filter("_t", lambda o: F.abs(o - F.col("tile")) <= -(-(within - 1) // tile))
    count = F.size("_t") * (F.size("_t") + 1) / 2 if within is None else F.size("_t") * (2 if within > 1 else 1)
    part = F.pmod(F.xxhash64("feature"), F.greatest(F.lit(1), F.ceil(F.lit(tasks) / count))).cast("int")
    cells = packed.join(tiles, "block").withColumn("part", part).withColumn("_o", F.explode(near))
    cells = cells.select("block", F.greatest("tile", "_o").alias("ti"), F.least("tile", "_o").alias("tj"), "part", "feature", "tile", "ids", *names)
    cells = cells.repartition("block", "ti", "tj", "part").sortWithinPartitions("block", "ti", "tj", "part", "feature", "tile")
    outs = [f"{a}_{b}" for a in names for b in names]
    schema = "block long, i long, j long, " + ", ".join(f"{o} double" for o in outs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"key": None}

        def place(side: str, ids: np.ndarray) -> np.ndarray:
            base = state["key"][1 if side == "i" else 2] * tile
            return np.asarray(ids) - base

        def fold() -> None:
            if state["key"] is None or not state["n"]:
                return
            same = state["key"][1] == state["key"][2]
            for p, a in enumerate(names):
                for q, b in enumerate(names):
                    state["sum"][p, q] += state["x"][p][: state["n"]].T @ (state["x"] if same else state["y"])[q][: state["n"]]
            state["x"][:, : state["n"]] = 0
            state["y"][:, : state["n"]] = 0
            state["n"], state["feature"] = 0, None

        def finish() -> Iterator[pd.DataFrame]:
            if state["key"] is None:
                return
            fold()
            block, ti, tj, _ = state["key"]
            a, b = np.flatnonzero(state["has"][0]), np.flatnonzero(state["has"][0] if ti == tj else state["has"][1])
            for part in np.array_split(a, max(1, len(a) // 64)):
                i, j = np.meshgrid(part, b, indexing="ij")
                keep = (i >= j) if ti == tj else np.ones(i.shape, bool)
                if within is not None:
                    keep &= i + ti * tile - j - tj * tile < within
                i, j = i[keep], j[keep]
                yield pd.DataFrame({"block": block, "i": i + ti * tile, "j": j + tj * tile} | {o: state["sum"][k // len(names), k % len(names)][i, j] for k, o in enumerate(outs)})

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                key = (row.block, row.ti, row.tj, row.part)
                if key != state["key"]:
                    yield from finish()
                    m = len(names)
                    state.update(key=key, sum=np.zeros((m, m, tile, tile)), x=np.zeros((m, BLOCK, tile)), y=np.zeros((m, BLOCK, tile)), n=0, feature=None, has=np.zeros((2, tile), bool))
                if row.feature != state["feature"]:
                    if state["n"] == BLOCK:
                        fold()
                    state["n"] += 1
                    state["feature"] = row.feature
                side = "i" if row.tile == row.ti else "j"
                at = place(side, row.ids)
                state["has"][0 if side == "i" else 1, at] = True
                for p, n in enumerate(names):
                    state["x" if side == "i" else "y"][p, state["n"] - 1, at] = getattr(row, n)
        yield from finish()

    ensure_on_workers(values.sparkSession)
    partial = cells.select("block", "ti", "tj", "part", "feature", "tile", "ids", *names).mapInPandas(run, schema)
    return partial.groupBy("block", "i", "j").agg(*[F.sum(o).alias(o) for o in outs])


def standardised(geno: DataFrame, method: str = "std", groups: DataFrame | None = None) -> DataFrame:
    """snp, indiv, z: mean-imputed dosages, centred and (std) scaled by their population deviation, per variant or per
    variant and group of people (indiv, group). A variant without variance has z = 0 under std."""
    if method not in ("std", "allele"):
        raise ValueError("method is std or allele")
    g = geno.select("snp", "indiv", dosage().cast("double").alias("g"))
    keys = ["snp"]
    if groups is not None:
        g, keys = g.join(groups, "indiv"), ["snp", "group"]
    m = moments(g, keys)
    centred = F.coalesce(F.col("g") - F.col("_m"), F.lit(0.0))
    z = centred if method == "allele" else F.when(F.col("_sd") > 1e-12, centred / F.col("_sd")).otherwise(0.0)
    return g.join(m, keys).select("snp", "indiv", z.alias("z"))


def moments(g: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _m, _sd: mean of the dosages g that are there, and deviation of the mean-imputed ones."""
    m = g.groupBy(*keys).agg(F.avg("g").alias("_m"), F.count("*").alias("_all"), F.sum(F.col("g") * F.col("g")).alias("_q"), F.count("g").alias("_n"))
    # Imputed values are means: they add nothing to the sum of squares but count in the deviation's denominator.
    sd = F.sqrt((F.col("_q") - F.col("_n") * F.col("_m") * F.col("_m")) / F.col("_all"))
    return m.select(*keys, "_m", sd.alias("_sd"))


def _scales(geno: DataFrame, method: str, name: str) -> DataFrame:
    """snp, z_shift, z_scale that make standardised dosages of counts, the variant under another name."""
    m = moments(geno.select("snp", dosage().cast("double").alias("g")), ["snp"])
    scale = F.lit(1.0) if method == "allele" else F.when(F.col("_sd") > 1e-12, 1 / F.col("_sd")).otherwise(0.0)
    return m.select(F.col("snp").alias(name), F.coalesce("_m", F.lit(0.0)).alias("z_shift"), scale.alias("z_scale"))


def grm(geno: DataFrame, method: str = "std", groups: DataFrame | None = None) -> DataFrame:
    """i, j (i >= j), value: sum of z_i z_j over variants, divided by the number of all variants."""
    n = geno.agg(F.countDistinct("snp").alias("_n"))
    if groups is None and method in ("std", "allele"):
        counts = geno.select(F.lit(0).cast("long").alias("block"), F.col("snp").alias("feature"), F.col("indiv").alias("entity"), dosage().alias("z"))
        return coded_products(counts, ["z"], by_feature=_scales(geno, method, "feature")).crossJoin(F.broadcast(n)).select("i", "j", (F.col("z_z") / F.col("_n")).alias("value"))
    z = standardised(geno, method, groups).select(F.lit(0).cast("long").alias("block"), F.col("snp").alias("feature"), F.col("indiv").alias("entity"), "z")
    return cross_products(z, ["z"]).crossJoin(F.broadcast(n)).select("i", "j", (F.col("z_z") / F.col("_n")).alias("value"))


def _by_ancestry(geno: DataFrame, n_anc: int, prior: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Products of all ancestries' counts, weighted by prior variance, and the total of that."""
    names = [f"a{k + 1}" for k in range(n_anc)]
    counts = geno.select(F.lit(0).cast("long").alias("block"), F.col("snp").alias("feature"), F.col("indiv").alias("entity"), *[of_ancestry(k).alias(f"a{k + 1}") for k in range(n_anc)])
    prior = geno.select("snp").distinct().withColumn("prior_var", F.lit(1.0)) if prior is None else prior.select("snp", "prior_var")
    scales = prior.select(F.col("snp").alias("feature"), *[c for n in names for c in (F.lit(0.0).alias(f"{n}_shift"), F.sqrt("prior_var").alias(f"{n}_scale"))])
    return coded_products(counts, names, by_feature=scales), prior.agg(F.sum("prior_var").alias("_w"))


def admix_grm_raw(geno: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """i, j, g1, g2, g12, g21: ancestry-specific products over two ancestries, divided by the total prior variance (i >= j; g21 is g12 of j and i)."""
    a, w = _by_ancestry(geno, 2, prior)
    p = a.crossJoin(F.broadcast(w))
    return p.select("i", "j", *[(F.col(s) / F.col("_w")).alias(n) for s, n in (("a1_a1", "g1"), ("a2_a2", "g2"), ("a1_a2", "g12"), ("a2_a1", "g21"))])


def admix_grm(geno: DataFrame, n_anc: int, prior: DataFrame | None = None) -> DataFrame:
    """i, j, k1, k2: products within ancestries and between different ones, divided by the total prior variance."""
    return ancestry_kernel(*_by_ancestry(geno, n_anc, prior), n_anc)


def ancestry_kernel(products: DataFrame, weight: DataFrame, n_anc: int) -> DataFrame:
    """i, j, k1, k2 of products of all ancestries' counts (a1_a1, a1_a2, ...) and their total weight (one row, _w)."""
    names = [f"a{k + 1}" for k in range(n_anc)]
    total = lambda pairs: sum((F.col(c) for c in pairs[1:]), F.col(pairs[0]))
    p = products.crossJoin(F.broadcast(weight))
    k1 = total([f"{x}_{x}" for x in names])
    k2 = total([f"{x}_{y}" for x in names for y in names if x != y]) if n_anc > 1 else F.lit(0.0)
    return p.select("i", "j", (k1 / F.col("_w")).alias("k1"), (k2 / F.col("_w")).alias("k2"))


def merge_kernels(parts: DataFrame, columns: list[str], weight: str = "w") -> DataFrame:
    """(part, i, j, columns, w) -> weighted means over parts."""
    return parts.groupBy("i", "j").agg(*[F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in columns])


def ancestry_ld(geno: DataFrame, snps: DataFrame, covariates: DataFrame | None = None, within: int | None = None) -> DataFrame:
    """chrom, s, t (s >= t), ld11, ld22, ld12, ld21 over two ancestries inside chromosomes: products of the alleles of each
    ancestry, residualised on the intercept (and on covariates: indiv, columns), divided by the number of people; with
    ``within`` only of variants fewer places apart."""
    names = ["a1", "a2"]
    a = geno.select("snp", "indiv", *[of_ancestry(k).alias(f"a{k + 1}") for k in range(2)])
    n = geno.agg(F.countDistinct("indiv").alias("_n"))
    chrom = F.broadcast(snps.select("snp", "chrom")) if snps.count() <= 50_000 else snps.select("snp", "chrom")
    place = [F.col("chrom").cast("long").alias("block"), F.col("snp").alias("entity")]
    if covariates is None:
        means = a.groupBy("snp").agg(*[F.avg(c).alias(f"{c}_shift") for c in names]).join(chrom, "snp")
        means = means.select(*place, *[c for x in names for c in (F.coalesce(f"{x}_shift", F.lit(0.0)).alias(f"{x}_shift"), F.lit(1.0).alias(f"{x}_scale"))])
        p = coded_products(a.join(chrom, "snp").select(*place, F.col("indiv").alias("feature"), *names), names, by_entity=means, within=within)
    else:
        v = residualised(a.select("snp", "indiv", *[F.col(c).cast("double") for c in names]), names, covariates)
        p = cross_products(v.join(chrom, "snp").select(*place, F.col("indiv").alias("feature"), *names), names, within=within)
    p = p.crossJoin(F.broadcast(n))
    return p.select(F.col("block").cast("int").alias("chrom"), F.col("i").alias("s"), F.col("j").alias("t"), *[(F.col(x) / F.col("_n")).alias(y) for x, y in (("a1_a1", "ld11"), ("a2_a2", "ld22"), ("a1_a2", "ld12"), ("a2_a1", "ld21"))])


def residualised(a: DataFrame, names: list[str], covariates: DataFrame | None = None) -> DataFrame:
    """Columns less their least-squares fit on an intercept and covariates, per variant: the sums X'a per variant, and one
    small inverse for all variants."""
    if covariates is None:
        m = a.groupBy("snp").agg(*[F.avg(c).alias(f"_{c}") for c in names])
        return a.join(m, "snp").select("snp", "indiv", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in names])
    cov = [c for c in covariates.columns if c != "indiv"]
    x = covariates.select("indiv", F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i + 1}") for i, c in enumerate(cov)])
    xs = [f"_x{i}" for i in range(len(cov) + 1)]
    row = x.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{p}{q}") for p in xs for q in xs]).first()
    inv = np.linalg.inv(np.array([[row[f"{p}{q}"] for q in xs] for p in xs]))
    j = a.join(x, "indiv")
    sums = j.groupBy("snp").agg(*[F.sum(F.col(p) * F.col(c)).alias(f"_s{p}{c}") for p in xs for c in names])

    def fit(c: str) -> Column:
        coef = [sum((F.lit(float(inv[p, q])) * F.col(f"_s{xs[q]}{c}") for q in range(1, len(xs))), F.lit(float(inv[p, 0])) * F.col(f"_s{xs[0]}{c}")) for p in range(len(xs))]
        return sum((b * F.col(v) for b, v in zip(coef[1:], xs[1:], strict=True)), coef[0] * F.col(xs[0]))

    return j.join(sums, "snp").select("snp", "indiv", *[(F.col(c) - fit(c)).alias(c) for c in names])


def tagging(ld: DataFrame) -> DataFrame:
    """chrom, tag, causal, beta1, beta2: what a causal variant with effect 1 in both ancestries puts on a tag's two
    ancestry-specific alleles: the tag's 2x2 covariance inverted times its covariance with the causal variant, times ones."""
    d = ld.where("s = t").select("chrom", F.col("s").alias("tag"), F.col("ld11").alias("_a"), F.col("ld12").alias("_b"), F.col("ld22").alias("_c"))
    both = ld.select("chrom", F.col("s").alias("tag"), F.col("t").alias("causal"), "ld11", "ld12", "ld21", "ld22").unionByName(
        ld.where("s <> t").select("chrom", F.col("t").alias("tag"), F.col("s").alias("causal"), "ld11", F.col("ld21").alias("ld12"), F.col("ld12").alias("ld21"), "ld22")
    )
    r1, r2 = F.col("ld11") + F.col("ld12"), F.col("ld21") + F.col("ld22")
    det = F.col("_a") * F.col("_c") - F.col("_b") * F.col("_b")
    det = F.when(F.abs(det) > 1e-12, det)
    return both.join(d, ["chrom", "tag"]).select("chrom", "tag", "causal", ((F.col("_c") * r1 - F.col("_b") * r2) / det).alias("beta1"), ((F.col("_a") * r2 - F.col("_b") * r1) / det).alias("beta2"))


def correlations(geno: DataFrame, snps: DataFrame, within: int | None = None) -> DataFrame:
    """chrom, s, t (s > t), corr of mean-imputed dosages inside chromosomes, with ``within`` only of variants fewer places
    apart; pairs with a constant variant are left out."""
    chrom = F.broadcast(snps.select("snp", "chrom")) if snps.count() <= 50_000 else snps.select("snp", "chrom")
    place = [F.col("chrom").cast("long").alias("block"), F.col("snp").alias("entity")]
    counts = geno.select("snp", "indiv", dosage().alias("z")).join(chrom, "snp").select(*place, F.col("indiv").alias("feature"), "z")
    scales = _scales(geno, "std", "snp").join(chrom, "snp").select(*place, "z_shift", "z_scale")
    n = geno.agg(F.countDistinct("indiv").alias("_n"))
    p = coded_products(counts, ["z"], by_entity=scales, within=within).crossJoin(F.broadcast(n)).select(F.col("block").cast("int").alias("chrom"), F.col("i").alias("s"), F.col("j").alias("t"), (F.col("z_z") / F.col("_n")).alias("corr"))
    useful = p.where("s = t AND corr > 0.5").select(F.col("s").alias("_v"))
    return p.where("s > t").join(useful, F.col("s") == F.col("_v"), "left_semi").join(useful, F.col("t") == F.col("_v"), "left_semi")


class Tiles:
    """A symmetric kernel (i, j, value; i >= j) as a written table of dense tiles, which multiplies thin matrices.

    A product is one pass over the tiles in parallel; what driver and tasks
    share is the thin matrix (entities x columns), never the kernel.
    """

    def __init__(self, kernel: DataFrame, columns: list[str], tile: int = TILE):
        spark = kernel.sparkSession
        ensure_on_workers(spark)
        self.columns, self.tile = columns, tile
        # Written, as a kernel is dear and is read three times here.
        kernel = written(kernel.select("i", "j", *columns))
        index = dense_index(kernel.select(F.col("i").alias("entity")).unionByName(kernel.select(F.col("j").alias("entity"))).distinct(), "entity", "at")
        index = written(index.select("entity", "at"))
        self.ids = np.array([r[0] for r in index.orderBy("at").select("entity").toLocalIterator()], np.int64)  # a number for each entity
        at = lambda c, name: index.select(F.col("entity").alias(c), F.col("at").alias(name))
        k = kernel.join(at("i", "_x"), "i").join(at("j", "_y"), "j")
        k = k.select(F.greatest("_x", "_y").alias("x"), F.least("_x", "_y").alias("y"), *columns)
        k = k.select(F.floor(F.col("x") / tile).alias("ti"), F.floor(F.col("y") / tile).alias("tj"), "x", "y", *columns)

        def dense(pdf: pd.DataFrame) -> pd.DataFrame:
            ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
            row: dict = {"ti": [ti], "tj": [tj]}
            for c in columns:
                a = np.zeros((tile, tile))
                a[pdf["x"].to_numpy() - ti * tile, pdf["y"].to_numpy() - tj * tile] = pdf[c].to_numpy(float)
                row[c] = [(a + np.tril(a, -1).T if ti == tj else a).ravel()]
            return pd.DataFrame(row)

        schema = "ti long, tj long, " + ", ".join(f"{c} array<double>" for c in columns)
        self.table = written(k.groupBy("ti", "tj").applyInPandas(dense, schema))
        discard(kernel, index)

    @classmethod
    def of(cls, table: DataFrame, columns: list[str], tile: int, ids: np.ndarray) -> Tiles:
        """Of a written table (ti, tj, columns; ti >= tj, tiles on the diagonal whole) over entities in this order."""
        self = cls.__new__(cls)
        self.table, self.columns, self.tile, self.ids = table, columns, tile, ids
        return self

    def times(self, v: np.ndarray) -> dict[str, np.ndarray]:
        """Each kernel times v (entities x columns)."""
        tile, names, n, width = self.tile, self.columns, len(self.ids), v.shape[1]
        shared = self.table.sparkSession.sparkContext.broadcast(np.vstack((v, np.zeros((-n % tile, width)))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Sums of a task's tiles: one row for each stretch of entities it met.
            sums: dict[tuple[int, str], np.ndarray] = {}
            for pdf in frames:
                for row in pdf.itertuples(index=False):
                    for c in names:
                        a = np.asarray(getattr(row, c)).reshape(tile, tile)
                        for side, other, m in ((row.ti, row.tj, a),) + (((row.tj, row.ti, a.T),) if row.ti != row.tj else ()):
                            part = m @ shared.value[other * tile : (other + 1) * tile]
                            sums[side, c] = sums[side, c] + part if (side, c) in sums else part
            yield pd.DataFrame({"t": [t for t, _ in sums], "c": [c for _, c in sums], "p": [p.ravel() for p in sums.values()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"t": pdf["t"].iloc[:1], "c": pdf["c"].iloc[:1], "p": [np.sum(pdf["p"].to_list(), axis=0)]})

        out = {c: np.zeros((n + -n % tile, width)) for c in names}
        for r in self.table.mapInPandas(run, "t long, c string, p array<double>").groupBy("t", "c").applyInPandas(add, "t long, c string, p array<double>").toLocalIterator():
            out[r["c"]][r["t"] * tile : (r["t"] + 1) * tile] = np.asarray(r["p"]).reshape(tile, width)
        shared.unpersist()
        return {c: x[:n] for c, x in out.items()}

    def whole(self, c: str) -> np.ndarray:
        """The kernel as one matrix, for few entities."""
        n, tile = len(self.ids), self.tile
        out = np.zeros((n + -n % tile,) * 2)
        for r in self.table.select("ti", "tj", c).toLocalIterator():
            a = np.asarray(r[c]).reshape(tile, tile)
            out[r["ti"] * tile : (r["ti"] + 1) * tile, r["tj"] * tile : (r["tj"] + 1) * tile] = a
            out[r["tj"] * tile : (r["tj"] + 1) * tile, r["ti"] * tile : (r["ti"] + 1) * tile] = a.T
        return out[:n, :n]


def principal_components(kernel: DataFrame, k: int = 10, tile: int = TILE, direct: int = 2048, depth: int = 6, tolerance: float = 1e-9, restarts: int = 200, seed: int = 7) -> DataFrame:
    """entity, pc1..pck of a kernel (i, j, value), scaled as unit eigenvectors; the largest entry of each is positive.

    Up to ``direct`` entities are factored at once. Beyond, a block Krylov space
    of the kernel is built, reduced to its best vectors and restarted until
    residuals are small: each step is one product of the distributed tiles with
    a thin matrix, so what the driver holds grows with the entities, not with
    their square.
    """
    tiles = Tiles(kernel.select("i", "j", "value"), ["value"], tile)
    n = len(tiles.ids)
    if n <= direct:
        value, vector = np.linalg.eigh(tiles.whole("value"))
        v = vector[:, np.argsort(-value)[:k]]
    else:
        width = min(n, k + 4)
        v = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
        for _ in range(restarts):
            basis, images, w = [], [], v
            for _ in range(depth):
                basis.append(w)
                images.append(tiles.times(w)["value"])
                q = np.hstack(basis)
                w = images[-1] - q @ (q.T @ images[-1])
                w -= q @ (q.T @ w)
                w, r = np.linalg.qr(w)
                w = w[:, np.abs(np.diag(r)) > 1e-12 * max(1.0, np.abs(r).max())]
                if not w.shape[1] or q.shape[1] + w.shape[1] > n:
                    break
            q, kq = np.hstack(basis), np.hstack(images)
            h = q.T @ kq
            value, y = np.linalg.eigh((h + h.T) / 2)
            y = y[:, np.argsort(-value)[:width]]
            value = np.sort(value)[::-1][:width]
            v = np.linalg.qr(q @ y)[0]
            residual = np.linalg.norm((kq @ y - (q @ y) * value)[:, :k], axis=0)
            if residual.max() <= tolerance * max(abs(value[0]), 1e-300) or q.shape[1] >= n:
                break
        v = v[:, :k]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    out = pd.DataFrame(v, columns=[f"pc{c + 1}" for c in range(v.shape[1])])
    out.insert(0, "entity", tiles.ids)
    return kernel.sparkSession.createDataFrame(out)


def symmetric(kernel: DataFrame) -> DataFrame:
    """Both triangles of (i, j, value)."""
    return kernel.unionByName(kernel.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
