"""Periodic runs, url rules and spelling variants against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaica.llm import runs, urls, variants


def runs_by_hand(s: list, least: int, times: int) -> list:
    best: dict = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            if i > a and i - a + q >= max(least, times * q):
                best.setdefault((a, i + q), q)
            i += i == a
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 6)), max_size=8)


@settings(max_examples=400, deadline=None)
@given(pieces, st.sampled_from([(2, 2), (6, 3), (24, 3), (5, 2)]))
def test_runs_are_those_of_brute_force(parts, bounds):
    s = [x for piece, times in parts for x in piece * times]
    expected = runs_by_hand(s, *bounds)
    assert runs.runs_of(s, *bounds) == expected
    words = [b"w%d" % x for x in s]
    assert runs.runs_of_words(words, np.array(s, np.uint64), *bounds) == expected  # behind the screen


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_factors_are_longest_earlier_pieces(s):
    at = 0
    for start, length, source in runs.factors(s):
        assert start == at
        earlier = lambda m, start=start: [j for j in range(start) if start + m <= len(s) and s[j : j + m] == s[start : start + m]]
        if source < 0:
            assert length == 1 and not earlier(1)
        else:
            assert source in earlier(length) and not earlier(length + 1)
        at += length
    assert at == len(s)


def test_periodic_runs_of_a_table(spark):
    line = " ".join(f"w{i}" for i in range(9))
    rows = [(1, None, 0), (2, "", 0), (3, "a b " * 12, 0), (3, "a b " * 12, 0), (None, f"x {line} {line}\n{line} y", 0), (4, "é " * 30_000, 0), (5, "a b c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(docs).collect()}
    assert runs.periodic_runs(docs).count() == len(rows)
    as_tuples = lambda r: [tuple(x) for x in r.runs]
    assert as_tuples(found[1, 0]) == as_tuples(found[2, 0]) == as_tuples(found[5, 3]) == [] and found[1, 0].collapsed == ""
    assert as_tuples(found[3, 24]) == [(0, 24, 2)] and found[3, 24].collapsed == "a b"
    assert as_tuples(found[None, 29]) == [(1, 27, 9)] and found[None, 29].collapsed == f"x {line} y"
    assert as_tuples(found[4, 30_000]) == [(0, 30_000, 1)] and found[4, 30_000].collapsed == "é"
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_repeats_follow_the_rule(spark):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 70))) for i in range(200)] + [(None, "a b"), (13, None), (17, " \n")]
    rows += [(i, "") for i in range(30)]
    for r, (i, text) in zip(runs.with_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), rows, strict=True):
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        assert (r.text or "").split() == words


def test_best_run_is_that_of_greatest_exact_exponent(spark):
    cases = [([], None), ([(0, 30, 10), (5, 31, 10)], (5, 31, 10)), ([(4, 60, 20), (2, 30, 10)], (2, 30, 10)), ([(2, 60, 20), (2, 30, 10)], (2, 30, 10))]
    df = spark.createDataFrame([(list(c),) for c, _ in cases], "runs array<struct<start: long, length: long, period: long>>").coalesce(1)
    got = [r[0] and tuple(r[0]) for r in df.select(runs.longest_exponent(df.runs)).collect()]
    assert got == [b for _, b in cases]


def url_by_hand(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u[u.index("://") + 3 :].split("?", 1)[0].split("#", 1)[0]
    host = rest.split("/", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[len(host) :]


@pytest.mark.parametrize("seed", [1, 2])
def test_urls_are_judged_as_by_hand(spark, seed):
    rng = random.Random(seed)
    host = lambda k: ".".join(rng.choice(["a", "b", "ab", "a-b", "B", "0", "É"]) for _ in range(k))
    path = lambda: rng.choice(["", "/", "/x", "/x/", "/x/y", "/xy", "/x/y/z?a=1", "#f", "?q://a.b/"])
    rules = [(host(rng.randint(1, 4)), rng.choice(["", "/", "/x", "/x/", "/x/y"]), rng.choice(["allow", "block"])) for _ in range(100)]
    rules += rules[:5] + [("", "/", "block"), (None, "/", "block"), ("a", None, "allow"), ("a/b", "/", "block"), ("b", "/", None)]
    pages = [(i, rng.choice(["http://", "https://", "", "x://"]) + host(rng.randint(1, 6)) + path()) for i in range(1500)]
    pages += [(None, None), (7, ""), (8, "://"), (9, "http://a.b" + "/x" * 50_000)] + [(1, "http://c.a.b/x/y")] * 700  # one url holds a third of all rows
    known: dict = {}
    for h, p, v in rules:
        if h and v and not set(h) & set("/?#"):
            k = ("".join(c.lower() if "A" <= c <= "Z" else c for c in h), p or "")
            known[k] = max(known.get(k, ""), v)

    def judged(u):
        h, p = url_by_hand(u)
        fits = [(len(a) + len(b), len(a), a + b, v) for (a, b), v in known.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return (h, p, *max(fits)[2:]) if fits else (h, p, None, "allow")

    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, rule string, part int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert sorted(map(str, map(tuple, urls.judge(df, table).collect()))) == sorted(str((i, *judged(u))) for i, u in pages)
    assert urls.judge(df.limit(0), table).count() == 0
    assert {tuple(r[3:]) for r in urls.judge(df, table.limit(0), default="block").collect()} == {(None, "block")}


def test_url_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = urls.judge(df, spark.sql("SELECT * FROM VALUES ('org', '/', 'block') AS r(host, path, verdict)"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def near(x: str, y: str) -> bool:
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


@pytest.mark.parametrize(("letters", "many", "cap"), [("abé", 400, 4096), ("ab", 250, 5), ("abcde", 500, 7), ("a", 6, 10)])
def test_forms_are_those_of_all_pairs(spark, letters, many, cap):
    rng = random.Random(many)
    n: dict = {}
    while len(n) < many:
        n["".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))] = rng.randint(1, 40)
    words = spark.createDataFrame([*n.items(), (None, 3)], "word string, n long")
    found = [(r.word, r.near, r.near_n) for r in variants.near_words(words.where("word is not null"), cap).collect()]
    assert sorted(found) == sorted((x, y, n[y]) for x in n for y in n if near(x, y))
    form = {}
    for x in n:
        best = min(((-n[y], y) for y in n if near(x, y)), default=None)
        form[x] = best[1] if best and -best[0] >= 2 * n[x] else None
    rows = {r.word: r for r in variants.forms(words, cap=cap).collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        root = x
        while form[root]:
            root = form[root]
        assert (r.form, r.root, r.n, r.n_near, r.form_n) == (form[x], root, n[x], sum(near(x, y) for y in n), n.get(form[x]))


def test_very_long_words_and_hot_triples(spark):
    long = "x" * 3000
    n = {long: 9, long + "x": 5, long[:-1] + "y": 3} | {f"prefix{a}{b}suffix": 1 + i for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")}
    rows = {r.word: r for r in variants.forms(spark.createDataFrame(list(n.items()), "word string, n long"), cap=8).collect()}
    assert all(r.n_near == (14 if "prefix" in w else sum(near(w, y) for y in n if y[0] == "x")) for w, r in rows.items())
    with pytest.raises(ValueError, match="at least 4"):
        variants.forms(spark.createDataFrame([("abc", 1)], "word string, n long"))
    assert variants.forms(spark.createDataFrame([], "word string, n long")).count() == 0


def test_vocabulary_counts_whole_texts(spark):
    import re
    import zlib
    from collections import Counter

    rng = random.Random(4)
    texts = [(i % 40 or None, " ".join(rng.choice(["Straße", "Hello", "wörld", "ab", "xyzzy1abcde", "naïve-ness"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    texts += [(5, None), (6, ""), (7, "Letter" * 4000), (7, "Letter" * 4000)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, word int")
    want: Counter = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    got = {r.word: r.n for r in variants.vocabulary(variants.with_typos(variants.occurrences(docs)), count=2).collect()}
    assert got == {w: c for w, c in want.items() if len(w) >= 5 and c >= 2}
