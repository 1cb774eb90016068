"""Language identification and quality scores: held-out accuracy and edge cases."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


from mosaica.llm import langid, quality
from mosaica.llm.common import table

DATA = "/root/testdata/sf0.01"
real = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")


@real
def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    got = langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, lang, "x", "y") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    rows += [(100, None, "en", "x", "y"), (101, "", "en", "x", "y"), (102, "123 !! ...", "en", "x", "y"), (103, "the dog " * 100_000, None, "x", "y"), (None, "le chien", None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, h string")
    got = {r["doc_id"]: r for r in langid.language(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))
    assert got[103]["lang_pred"] == "en" and got[None]["lang_pred"] == "fr"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 62
    none = docs.where("doc_id < 0")
    assert langid.language(none).count() == 0
    assert {r["lang_pred"] for r in langid.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_weights_are_sparse_and_those_of_dense_updates(spark):
    """The model of a table of texts against updates of all coordinates, written down plainly, in the same order."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    words = {"en": "the cat and dog of house with tree".split(), "fr": "le chat et chien de maison avec arbre".split(), "de": "die katze und hund von haus mit baum".split()}
    rows = [(i, " ".join(rng.choice(words[lang], rng.integers(3, 12))), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    options = {"dim": 256, "longest": 2, "sample": 60, "calibration": 20, "alpha": 0.5, "beta": 1.0, "l1": 0.5, "l2": 1e-2, "epochs": 3, "seed": 5}
    model = langid.train(docs, **options)
    dense = np.zeros((256, 3))
    dense[np.repeat(np.arange(256), np.diff(model.first)), model.of] = model.weight

    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = [langid.counts(t, 256, 2) for _, t, _ in seen]
    df = np.zeros(256)
    for ids, _ in got:
        df[ids] += 1
    idf = np.log((1 + len(seen)) / (1 + df)) + 1
    np.testing.assert_allclose(model.idf, idf)
    limit = 80
    keyed = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(5)).alias("h"))
    keyed = keyed.select("doc_id", "h", (F.pmod(F.xxhash64("h", F.lit("calibrate")), F.lit(limit)) < 20).alias("cal"), *[F.xxhash64("h", F.lit(e), F.lit(5)).alias(f"p{e}") for e in range(4)])
    keys = {r["doc_id"]: r for r in keyed.collect()}
    taken = sorted((r for r in seen), key=lambda r: keys[r[0]]["h"])[:limit]
    langs = ["de", "en", "fr"]

    def features(text):
        ids, n = langid.counts(text, 256, 2)
        x = np.zeros(257)
        x[ids] = (1 + np.log(n)) * idf[ids]
        x /= np.linalg.norm(x)
        x[256] = 1.0
        return x

    z, n = np.zeros((257, 3)), np.zeros((257, 3))
    l1 = np.full((257, 1), 0.5)
    l1[256] = 0
    weights = lambda: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / 0.5 + 1e-2), 0.0)
    for e in range(3):
        for r in sorted((r for r in taken if not keys[r[0]]["cal"]), key=lambda r: keys[r[0]][f"p{e}"]):
            x, w = features(r[1]), weights()
            p = np.exp(x @ w) / np.exp(x @ w).sum()
            g = np.outer(x, p - np.eye(3)[langs.index(r[2])])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w
            n += g * g
    w = weights()
    np.testing.assert_allclose(dense, w[:256], atol=1e-9)
    np.testing.assert_allclose(model.bias, w[256], atol=1e-9)
    held = [r for r in taken if keys[r[0]]["cal"]]
    logits = np.array([features(r[1]) @ w for r in held])
    loss = lambda t: -np.mean([(np.log(np.exp(q / t) / np.exp(q / t).sum()) * np.where(np.arange(3) == langs.index(r[2]), (len(held) + 1) / (len(held) + 2), 1 / (len(held) + 2) / 2)).sum() for q, r in zip(logits, held, strict=True)])
    assert len(held) > 5 and loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.02, 20, 300)) + 1e-6
    assert (dense == 0).mean() > 0.5
    for _, t, _ in rows[:30]:
        p = np.exp(features(t) @ w / model.temperature)
        lang, score = model.predict(t)
        assert lang == langs[p.argmax()] and score == pytest.approx(p.max() / p.sum())


@real
def test_most_weights_vanish(spark):
    docs = table(spark, DATA, "documents")
    model = langid.train(docs)
    assert len(model.weight) < 0.05 * model.dim * len(model.languages) and len(model.languages) > 1


def test_machine_is_that_of_dense_updates():
    """Updates of a row's own features against full-length vectors with all pairs written out."""
    rng = np.random.default_rng(1)
    dim, k = 32, len(quality.STATISTICS)
    texts = ["good plain words here and there", "BAD!! BAD!! 77 ##", "one two three one", "", "Zed zed ZED\nzed"] * 6
    found = [quality.features(t, dim) for t in texts]
    y = rng.integers(0, 2, len(texts)).astype(float)
    stats = np.array([x[-k:] for _, x in found])
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    machine = quality.Machine(quality.start(dim, 3, y.mean(), mean, scale, 4), 0.1, 1e-3)
    w0, w, v = machine.m.w0, machine.m.w.copy(), machine.m.v.copy()
    gw, gv = np.full(w.shape, 1e-2), np.full(v.shape, 1e-2)
    for (ids, x), t in zip(found, y, strict=True):
        machine.step(ids, x, t)
        full = np.zeros(dim + k)
        full[ids] = x
        full[dim:] = np.clip((full[dim:] - mean) / scale, -4, 4) / 4
        has = np.zeros(dim + k, bool)
        has[ids] = True
        out = w0 + w @ full + sum((v[i] @ v[j]) * full[i] * full[j] for i in ids for j in ids if i < j)
        g = 1 / (1 + np.exp(-out)) - t
        w0 -= 0.01 * g
        dw = np.where(has, g * full + 1e-3 * w, 0)
        dv = np.where(has[:, None], g * np.array([full[i] * sum(full[j] * v[j] for j in ids if j != i) for i in range(dim + k)]) + 1e-3 * v, 0)
        gw, gv = gw + dw * dw, gv + dv * dv
        w, v = w - 0.1 * dw / np.sqrt(gw), v - 0.1 * dv / np.sqrt(gv)
    assert machine.m.w0 == pytest.approx(w0)
    np.testing.assert_allclose(machine.m.w, w, atol=1e-9)
    np.testing.assert_allclose(machine.m.v, v, atol=1e-9)
    for t in texts[:5]:
        ids, x = quality.features(t, dim)
        x = machine.m.prepared(ids, x)
        out = w0 + sum(w[i] * a for i, a in zip(ids, x, strict=True)) + sum((v[i] @ v[j]) * a * b for i, a in zip(ids, x, strict=True) for j, b in zip(ids, x, strict=True) if i < j)
        assert machine.m.score(t) == pytest.approx(1 / (1 + np.exp(-out)))


def dense_fit(rows, dim, rank, epochs, seed, order, rate=0.1, l2=1e-5):
    """The same fit with full-length vectors and all pairs' gradients, in the given order of each epoch."""
    k = len(quality.STATISTICS)
    full = np.zeros((len(rows), dim + k))
    for i, (text, _) in enumerate(rows):
        ids, x = quality.features(text, dim)
        full[i, ids] = x
    used = [set(quality.features(t, dim)[0].tolist()) for t, _ in rows]
    mean, scale = full[:, dim:].mean(axis=0), np.maximum(full[:, dim:].std(axis=0), 1e-3)
    full[:, dim:] = np.clip((full[:, dim:] - mean) / scale, -4, 4) / 4
    y = np.array([q for _, q in rows])
    w0, w, v = np.log(y.mean() / (1 - y.mean())), np.zeros(dim + k), np.random.default_rng(seed).normal(0, 0.02, (dim + k, rank))
    gw, gv = np.full(w.shape, 1e-2), np.full(v.shape, 1e-2)
    for turn in range(1, epochs + 1):
        for i in order(turn):
            x, has = full[i], np.array([j in used[i] for j in range(dim + k)])
            pairs = x[:, None] * x[None, :] * (v @ v.T)
            out = w0 + w @ x + (pairs.sum() - np.trace(pairs)) / 2
            g = 1 / (1 + np.exp(-out)) - y[i]
            w0 -= 0.01 * g
            dw = np.where(has, g * x + l2 * w, 0)
            others = np.array([x[j] * (x @ v - x[j] * v[j]) for j in range(dim + k)])
            dv = np.where(has[:, None], g * others + l2 * v, 0)
            gw, gv = gw + dw * dw, gv + dv * dv
            w, v = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
    return w0, w, v


def test_the_trained_machine_is_that_of_dense_updates(spark):
    """quality.train itself, on a table, with texts longer than a piece and an id that has two texts."""
    rng = np.random.default_rng(3)
    texts = {i: " ".join(f"w{j}" for j in rng.integers(0, 900, rng.integers(1, 1500 if i % 9 == 0 else 20))) for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (5, texts[5]), (5, texts[5])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, dim=1024, rank=2, epochs=2, seed=9)
    known = labels.where("doc_id is not null").where(~quality.held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit(9)))
    ids = [(r.doc_id, r.quality) for r in known.orderBy("doc_id").collect()]
    rank = {t: {r.doc_id: r.p for r in known.select("doc_id", F.xxhash64("h", F.lit(t), F.lit(9)).alias("p")).collect()} for t in (1, 2)}
    order = lambda turn: sorted(range(len(ids)), key=lambda i: rank[turn][ids[i][0]])
    w0, w, v = dense_fit([(texts[i], q) for i, q in ids], 1024, 2, 2, 9, order)
    assert model.w0 == pytest.approx(w0)
    np.testing.assert_allclose(model.w, w, atol=1e-9)
    np.testing.assert_allclose(model.v, v, atol=1e-9)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """Thousands of labelled rows under one id, or none, don't break the bound; equal rows count once."""
    seen = []
    for module in (langid, quality):
        joined = module.joined
        monkeypatch.setattr(module, "materialize_table", lambda df, f=module.materialize_table: (seen.append(t := f(df)), t)[1])
        assert joined
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id") % 2500).alias("text"), F.lit("en").alias("lang"))
    langid.train(docs, sample=10, calibration=4, dim=64)
    assert seen[-1].select("h").distinct().count() == 14
    same = spark.range(3000).select(F.lit(8).cast("long").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    quality.train(same, spark.createDataFrame([(8, 1), (9, 0)], "doc_id long, quality int"), dim=64, rank=2, sample=5)
    assert seen[-1].select("h").distinct().count() == seen[-1].count() == 1


def test_structure_statistics():
    """The statistics of a text counted by hand."""
    text = "Ab cd 12 !\nAb cd 12 !\n\u00e9 x x"
    ids, x = quality.features(text, 64)
    s = dict(zip(quality.STATISTICS, x[-len(quality.STATISTICS) :], strict=True))
    size = len(text.encode())
    want = {"chars": np.log1p(size) / 10, "words": np.log1p(11) / 10, "lines": np.log1p(3) / 5, "upper": 2 / 10, "digits": 4 / size * 5, "symbols": 2 / size * 5, "non_ascii": 2 / size,
            "distinct_words": 6 / 11, "top_word": 2 / 11, "distinct_lines": 2 / 3, "repeated_next": 1 / 10, "lone_symbols": 2 / 11 * 3, "line_ends": 3 / 11, "short": 0.0}
    for name, value in want.items():
        assert s[name] == pytest.approx(value), name
    assert np.linalg.norm(x[: -len(quality.STATISTICS)]) == pytest.approx(1)


def test_very_long_texts(spark):
    text = "plain words of a long text " * 120_000
    docs = spark.createDataFrame([(1, text), (2, "x" * 2_500_000), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality(docs, labels).collect())
    found = langid.language(docs.withColumn("lang", F.lit("en"))).collect()
    assert {r["lang_pred"] for r in found} == {"en"}


def test_chunks_count_like_one_pass(monkeypatch):
    text = "Ünïcode wörds, 日本語 and more " * 40
    whole = langid.counts(text, 1 << 12, 3)
    monkeypatch.setattr(langid, "_CHUNK", 64)
    parts = langid.counts(text, 1 << 12, 3)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


@real
def test_quality_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.quality(docs, labels)
    assert got.count() == docs.count()
    p = got.join(labels, "doc_id").where("held_out").toPandas()
    rank = p.score.rank().to_numpy()
    good = p.quality.to_numpy() == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (p.predicted == (p.score >= 0.7)).all()


def test_quality_edges(spark):
    rows = [(i, t) for i, t in enumerate(["good plain words here", "BAD!! BAD!! BAD!!"] * 20)] + [(100, None), (101, ""), (None, "good plain words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)] + [(0, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == 43 and got[None]["score"] > got[1]["score"] and 0 <= got[100]["score"] <= 1 and got[100]["score"] == got[101]["score"]
    assert quality.quality(docs.where("doc_id < 0"), labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in quality.quality(docs, labels.where("doc_id < 0")).collect())


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    v, x, w = rng.normal(size=(6, 3)), rng.normal(size=6), rng.normal(size=6)
    pairs = sum((v[i] @ v[j]) * x[i] * x[j] for i in range(6) for j in range(i))
    assert quality.interactions(0.5, w, v, x) == pytest.approx(0.5 + w @ x + pairs)
