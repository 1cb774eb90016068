"""Packing, substring dedup, SimHash and mixing against brute force; nulls, empties, repeats, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaica.llm import mixing, packing, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k long, size long, tag long, _size string"


def frame(spark, texts, sources=None, ids=None):
    rows = [((ids[i] if ids else i), t, "en", (sources[i] if sources else "s"), len(t or ""), 1, 2, 3, 4, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(500)] + ["é", "Ünder", "日本", "x" * 40]
    sent = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, hot = sent(60), sent(37)
    texts = [sent(rng.randint(1, 200)) for _ in range(40)]
    texts += [f"{sent(30)} {passage} {sent(20)}" for _ in range(4)] + [f"{sent(rng.randint(0, 9))}\n{hot}\t{sent(rng.randint(0, 9))}" for _ in range(30)]
    texts += [texts[0]] * 12 + [texts[3] + " one more"] + ["a b c d " * 40, "z " * 34, "z " * 35, "z " * 36, None, "", "   ", "\x1cA\x85 b", "one"]
    return texts


# --- packing


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*corpus, "a  b <|endoftext|> c", "long text here " * 80_000]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(frame(spark, texts), longest=64).collect()
    by_doc = {}
    for r in got:
        assert r["length"] in {1 << b for b in range(7)} and r["length"] == len(r["ids"]) and r["offset"] == 0 and 1 << r["bucket"] == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in got}) == len(got) and len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for p in pieces for x in p["ids"]] == want and {p["doc_tokens"] for p in pieces} == {len(want)}


def test_piece_lengths():
    assert packing.piece_lengths(2500, 1024) == [1024, 1024, 256, 128, 64, 4]
    with pytest.raises(ValueError):
        packing.pack(None, longest=100)


# --- substring dedup


def brute_repeats(texts, window):
    seen = {}
    for d, t in enumerate(texts):
        w = words(t)
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((d, s))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d].update(range(s, s + window))
    return gone


@pytest.mark.parametrize("window, seed", [(35, 8), (12, 4), (9, 8)])
def test_substring_dedup(spark, corpus, window, seed):
    gone = brute_repeats(corpus, window)
    got = substring_dedup.remove_repeats(frame(spark, corpus), window, seed).collect()
    assert len(got) == len(corpus)
    for r in got:
        w, g = words(corpus[r["doc_id"]]), gone[r["doc_id"]]
        kept = b" ".join(x for i, x in enumerate(w) if i not in g)
        assert (r["n_words"], r["n_removed"]) == (len(w), len(g)) and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert sum(s["length"] for s in r["spans"]) == len(g)


@pytest.mark.parametrize("block_words", [500_000, 300])
def test_parsing_by_minimiser_loses_no_factor(spark, corpus, block_words):
    """Longest matches against every other text, position by position, against what the routed parse covers; with tiny
    blocks most minimisers take the way of single windows."""
    gone = brute_repeats(corpus, 12)
    parsed = 0
    for r in substring_dedup.remove_repeats(frame(spark, corpus), 12, 4, block_words).collect():
        covered = {i for s in r["spans"] for i in range(s["start"], s["start"] + s["length"])}
        assert covered == gone[r["doc_id"]]
        for f in r["factors"] or ():
            parsed += f["block"] is not None
            assert f["words"] >= 12 and set(range(f["start"], f["start"] + f["words"])) <= covered
    assert parsed > 20 or block_words == 300


def test_longest_matches_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    phrases = [rng.integers(0, 3, rng.integers(1, 40)) for _ in range(30)]
    x, ends = np.concatenate(phrases), np.cumsum([len(p) for p in phrases])
    length, place = substring_dedup.longest_matches(x, ends)
    stop = np.repeat(ends, [len(p) for p in phrases])

    def common(i, j):
        n = 0
        while i + n < stop[i] and j + n < stop[j] and x[i + n] == x[j + n]:
            n += 1
        return n

    for i in range(len(x)):
        assert length[i] == max(common(i, j) for j in range(len(x)) if j != i)
        assert length[i] == 0 or (place[i] != i and common(i, place[i]) == length[i])


def test_factors_are_greedy_with_windows_over_boundaries():
    assert substring_dedup.factors_of(np.array([0, 0, 6, 5, 7, 6, 5, 4, 5, 4, 3]), 2, 8, 4) == [(2, 6), (5, 6), (8, 5)]


def test_very_long_texts(spark, monkeypatch):
    """Texts far beyond the parts in which words are hashed, one of them without white space."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    long = [" ".join(str(rng.randint(0, 10**9)) for _ in range(150_000)) for _ in range(2)]
    texts = [f"{long[0]} {passage} tail", f"{passage} {long[1]}", "y" * 3_000_000, "z " * 40_000]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert [(got[i]["n_words"], got[i]["n_removed"]) for i in range(4)] == [(150_051, 50), (150_050, 50), (1, 0), (40_000, 40_000)]
    prints = {r["doc_id"]: r["fp"] % 2**64 for r in simhash.near_duplicates(docs).collect()}
    assert all(prints[i] == brute_fingerprint(t) for i, t in enumerate(texts) if i != 1)
    assert [r["size"] for r in mixing.plan(docs).orderBy("doc_id").collect()] == [150_051, 150_050, 1, 40_000]


def test_words_are_hashed_alike_in_parts(monkeypatch):
    data = " ".join(f"w{i}" for i in range(500)).encode() + b"\t" + b"x" * 700 + b" end"
    whole = substring_dedup.word_hashes(data)
    monkeypatch.setattr(substring_dedup, "_CHUNK", 64)
    parts = substring_dedup.word_hashes(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_random_small_alphabet(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    gone = brute_repeats(texts, 10)
    for r in substring_dedup.remove_repeats(frame(spark, texts), 10, 3).collect():
        assert r["n_removed"] == len(gone[r["doc_id"]])


def test_equal_ids_with_other_texts_stay_apart(spark, corpus):
    texts = [corpus[0], corpus[1], corpus[0], corpus[2]]
    got = substring_dedup.remove_repeats(frame(spark, texts, ids=[7, 7, None, None]), 9, 4).collect()
    gone = brute_repeats(texts, 9)
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == sorted((len(words(t)), len(g)) for t, g in zip(texts, gone, strict=True))


def test_cut_repeats_keeps_columns(spark, corpus):
    docs = frame(spark, corpus)
    out = substring_dedup.cut_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    gone = brute_repeats(corpus, 35)
    for d, t in enumerate(corpus):
        if gone[d] and len(gone[d]) == len(words(t)):
            assert d not in got
        elif not gone[d]:
            assert got[d]["text"] == t
        else:
            assert got[d]["text"].split(" ") == [x.decode() for i, x in enumerate(words(t)) if i not in gone[d]] and got[d]["n_chars"] == len(got[d]["text"])


# --- SimHash


def brute_fingerprint(t):
    w = [x.lower() for x in words(t)]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash(spark, corpus):
    texts = corpus + [corpus[5].upper()]
    fps = [brute_fingerprint(t) for t in texts]
    want = groups(len(texts), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["fp"] % 2**64 == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("segments, cap", [(2, 4096), (3, 3), (4, 2), (3, 4096)])
def test_multi_index_hashing_finds_every_link(spark, segments, cap):
    """Dense clusters around few centres, small caps so that hot buckets are split over cells."""
    rng = random.Random(2)
    fps = []
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(25):
            fps.append(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = list(dict.fromkeys(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from mosaica.llm import buckets
    from mosaica.llm.common import map_arrow
    from mosaica.llm.components import connected_components

    rows = buckets.split_hot(simhash.index_rows(df, 4, segments), simhash.hot_keys(df, 4, segments, cap), "fp")
    links = map_arrow(buckets.dealt(rows), lambda b: simhash._links(b, 4), "u long, v long")
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = groups(len(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    mine = [roots.get(s, s) for s in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(want)) == len(set(mine))


def test_keep_one_with_null_and_shared_ids(spark):
    """One document of each group, though ids are null or stand for several texts; all columns as they were."""
    same, near = "the same text here today and more of it follows now", "the same text here today and more of it follows now"
    texts = [same, near, same.upper(), "quite another thing altogether now", "and one more text of its own kind", "", None]
    docs = frame(spark, texts, ids=[None, None, 4, 4, 4, None, 9]).withColumn("_id", F.lit(5)).withColumn("_doc", F.lit(6))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9].lower()) for r in out.collect()) == [(4, "and one m"), (4, "quite ano"), (4, "the same "), (9, "")]
    nulls = simhash.keep_one(frame(spark, [same, same + " x", None], ids=[None, None, None]))
    assert nulls.count() == len({r["fp"] for r in simhash.near_duplicates(frame(spark, [same, same + " x", None])).select(F.col("component_id").alias("fp")).collect()})


def test_keep_one(spark):
    texts = ["the same text here today", "the same text here today", "quite another thing altogether now", None, ""]
    docs = frame(spark, texts, ids=[5, 3, 9, 11, 12])
    out = simhash.keep_one(docs.unionByName(docs.where("doc_id = 9")))
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 9, 11]


# --- mixing


def test_mixing_targets_and_caps(spark):
    rng = random.Random(3)
    texts, sources = [], []
    for s, n in (("big", 300), ("mid", 60), ("tiny", 3), (None, 30), ("éa", 10)):
        for _ in range(n):
            texts.append(" ".join("w" for _ in range(rng.randint(0, 80))))
            sources.append(s)
    texts += [None, ""]
    sources += ["mid", "void"]
    docs = frame(spark, texts, sources)
    got = mixing.plan(docs, shard_words=2000).collect()
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, list(order)
    left = float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    taken = {}
    assert len(got) == len(texts)
    for r in got:
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 16 + 16 * (1 + sizes[s] // 2000)
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in mixing.plan(docs.repartition(7), shard_words=2000).collect()}


def test_mix_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(f"{i}_{j}" for j in range(rng.randint(1, 30))) for i in range(60)]
    sources = ["a" if i < 50 else "b" for i in range(60)]
    docs = frame(spark, texts, sources)
    plan = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for d, r in plan.items():
        assert sum(len(t.split()) for t in got.get(d, [])) == r["taken"]
        assert sum(t == texts[d] for t in got.get(d, [])) >= r["full"]


def test_mix_equal_rows_and_shared_ids(spark):
    """Rows that share an id, or are equal, are each taken as planned; clashing column names come through."""
    texts = [f"{i} a b c d e f" for i in range(40)] * 2 + ["same words here"] * 30
    docs = frame(spark, texts, ["s" if i % 2 else None for i in range(110)], ids=[1 if i < 20 else None for i in range(110)]).withColumn("_doc", F.lit(1)).withColumn("_mark", F.lit(2)).withColumn("mark", F.lit("m"))
    plan = mixing.plan(docs).groupBy("source").agg(F.sum("taken")).collect()
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.select("_doc", "_mark", "mark").distinct().count() == 1
    got = out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).cast("long")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plan), key=repr)


def test_mix_of_very_many_equal_rows(spark):
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"), F.col("id").alias("other"))
    docs = docs.unionByName(spark.range(50_000).select((F.col("id") + 10).alias("doc_id"), F.lit("x y").alias("text"), F.lit("t").alias("source"), F.lit(-1).cast("long").alias("other")))
    taken = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("rows")).orderBy("source").collect()
    out = mixing.mix(docs)
    got = out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n"), F.count("*").alias("rows")).orderBy("source").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in taken]
    # Each of the equal rows has takes of its own: none comes more often than the plan's largest.
    assert out.where("source = 's'").groupBy("other").count().agg(F.max("count")).first()[0] <= 3


def test_equal_rows_of_which_one_is_taken(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 2 + [(2, "q " * 5000, "t")], "doc_id long, text string, source string")
    taken = mixing.plan(docs).groupBy("source").agg(F.sum("taken")).collect()
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))).collect()
    assert sorted(map(tuple, got)) == sorted(t for t in map(tuple, taken) if t[1])


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(5)
    for seats in (1, 7, 40, 333):
        w = [rng.choice([0, 1, 5, 1000, rng.randint(1, 300)]) for _ in range(15)]
        df = spark.createDataFrame([(1, i, x, sum(w), seats) for i, x in enumerate(w)], "g int, p int, w long, total long, seats long")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], "p", "w", "total", "seats").collect()}
        want = [0] * len(w)
        for _ in range(seats):
            best = max(range(len(w)), key=lambda i: (w[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert [got[i] for i in range(len(w))] == want


# --- all of them on an empty table


def test_empty_tables(spark):
    none = frame(spark, ["x"]).where("doc_id < 0")
    for df in (packing.pack(none), substring_dedup.remove_repeats(none), substring_dedup.cut_repeats(none), simhash.near_duplicates(none), simhash.keep_one(none), mixing.plan(none), mixing.mix(none)):
        assert df.count() == 0


def test_all_null_or_empty(spark):
    docs = frame(spark, [None, "", None], ids=[1, None, None])
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == 3
    assert substring_dedup.remove_repeats(docs).agg(F.sum("n_words")).first()[0] == 0
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1}
    assert mixing.plan(docs).agg(F.sum("taken")).first()[0] == 0


def test_rounds_of_components_write_few_files(spark):
    """Each file costs processes on an executor; 211 tasks with a few rows each made 211 files a table."""
    from mosaica.llm.components import connected_components

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        roots = connected_components(spark.range(2000).select(F.col("id").alias("u"), (F.col("id") - F.col("id") % 500).alias("v")))
        assert len(set(roots.inputFiles())) <= 12
        assert {(r["root"], r["n"]) for r in roots.groupBy("root").agg(F.count("*").alias("n")).collect()} == {(500 * i, 500) for i in range(4)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
