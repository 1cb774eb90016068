"""Preference formatting and licence scans: worked cases and brute force."""

import re

from mosaica.llm import licenses, preference

SCHEMA = "pair_id long, chosen boolean, turn long, role string, text string, part string, _end int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_prompt_is_the_common_prefix(spark):
    rows = [(1, side, t, role, text) for side in (True, False) for t, role, text in [(0, "system", "be kind"), (1, "user", "hi")]]
    rows += [(1, True, 2, "assistant", "hello there"), (1, False, 2, "assistant", "go away"), (1, False, 3, "user", "oh"), (1, False, 4, "assistant", "yes")]
    r = preference.assemble(preference.segments(turns(spark, rows))).first()
    assert r["prompt"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert [r["chosen"][m["from"] : m["to"]] for m in r["chosen_mask"]] == ["hello there<|im_end|>"]
    assert [r["rejected"][m["from"] : m["to"]] for m in r["rejected_mask"]] == ["go away<|im_end|>", "yes<|im_end|>"]


def test_edges(spark):
    rows = [
        (1, True, 0, "user", "same"), (1, False, 0, "user", "same"),  # equal sides
        (2, True, 0, "user", "only"),  # one side
        (3, True, 0, "user", "a"), (3, False, 1, "user", "a"),  # turns that don't meet
        (4, True, 0, None, None), (4, False, 0, "", ""), (4, True, None, "assistant", "last"),
        (5, True, 0, "user", "x"), (5, True, 0, "user", "x"), (5, False, 0, "user", "x"), (5, True, 1, "user", "later"), (5, False, 2, "user", "later"),
        (None, True, 0, "user", "gone"), (6, None, 0, "user", "gone"),
    ]
    got = sorted((r["pair_id"], r["part"], -1 if r["turn"] is None else r["turn"]) for r in preference.segments(turns(spark, rows)).collect())
    assert got == [(1, "prompt", 0), (2, "chosen", 0), (3, "chosen", 0), (3, "rejected", 1), (4, "chosen", -1), (4, "prompt", 0), (5, "chosen", 1), (5, "prompt", 0), (5, "rejected", 2)]
    assert preference.segments(turns(spark, rows[:1]).where("turn > 9")).count() == 0


def brute_scan(text, threshold=licenses.THRESHOLD):
    """Every template laid at every place of the text, without anchors; of overlapping fits the best."""
    w = licenses.words_of(text)
    pairs = lambda x: {f"{a} {b}" for a, b in zip(x, x[1:], strict=False)}
    fits = []
    for number, (name, template) in enumerate(licenses.TEMPLATES):
        t = licenses.words_of(template)
        b = pairs(t)
        for at in range(1 - len(t), len(w)):
            start, stop = max(0, at), min(len(w), at + len(t))
            a = pairs(w[start:stop])
            d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if d >= threshold:
                fits.append((-d, start - stop, name, number, start, stop))
    fits = sorted(set(fits))
    return fits


def the_best(fits):
    return sorted({(f[4], f[5] - f[4], f[2], round(-f[0], 9)) for f in fits if not any(g < f and g[4] < f[5] and f[4] < g[5] for g in fits)})


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, n int")
    out = {}
    for r in licenses.scan(docs).collect():
        out.setdefault(r["doc_id"], []).append((r["start"], r["words"], r["license"], round(r["dice"], 9)))
    return {i: sorted(x) for i, x in out.items()}


def of(name, least=300):
    return next(t for n, t in licenses.TEMPLATES if n == name and len(t) > least)


def test_licenses(spark):
    """Whole notices are where brute force has its best fit, and nothing is found where it has none."""
    mit = of("mit")
    texts = ["Some words.\nReleased under the MIT License!\nmore", "released under THE mit license", mit, mit.replace(". ", ".\n"), "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0", "under the mit license license license", "one", "", None, "\n\n", "nothing of the kind " * 500, "(c) All rights reserved. All rights reserved"]
    texts += [" ".join(["before"] * 9 + licenses.words_of(t) + ["after"] * 9) for _, t in licenses.TEMPLATES]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got.get(i, []) == the_best(brute_scan(t or "")), t
    docs = spark.createDataFrame([(None, mit), (None, mit)], "doc_id long, text string")
    assert licenses.scan(docs).count() == 2 and licenses.scan(docs.where("doc_id < 0")).count() == 0


def test_embedded_and_truncated_notices(spark):
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(300))
    wrap = lambda t, mark, n=9: "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    cut = lambda t, share: " ".join(t.split()[: int(len(t.split()) * share)])
    texts = [
        wrap(of("mit"), " * ") + "\n" + code, code + "\n" + wrap(of("gpl-3.0-or-later", 100), "# ") + "\n" + code, "word " * 20_000 + of("apache-2.0") + " word" * 20_000,
        wrap("Copyright 2001 Someone. " + of("bsd-3-clause"), "// ") + code, cut(of("mit"), 0.75), code + cut(of("zlib"), 0.8), cut(of("mit"), 0.5), of("mit").replace("the", "a"), of("mit") + "\n" + of("isc"),
    ]
    got = {i: [x[2] for x in v] for i, v in found(spark, texts).items()}
    assert got == {0: ["mit"], 1: ["gpl-3.0-or-later"], 2: ["apache-2.0"], 3: ["bsd-3-clause"], 4: ["mit"], 5: ["zlib"], 7: ["mit"], 8: ["mit", "isc"]}


def test_units_at_the_size_bound(spark):
    """Texts that end after two thirds of a template's bigrams, whose Dice is the threshold itself."""
    texts = []
    for _, template in licenses.TEMPLATES:
        w = licenses.words_of(template)
        n = len({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        if n % 3 == 0 and n == len(w) - 1:
            texts.append(" ".join(w[: n * 2 // 3 + 1]))
    got = found(spark, texts)
    want = {i: the_best(brute_scan(t)) for i, t in enumerate(texts)}
    assert {i: x for i, x in want.items() if x} == got and sum(x[-1][3] == 0.8 for x in want.values() if x) >= 2


def test_anchors_leave_no_fit_of_short_templates_out():
    for _, template in licenses.TEMPLATES:
        w = licenses.words_of(template)
        n, places = len(w) - 1, licenses.anchors(w)
        assert len(set(places)) == len(places) == min(8, int(n / 3 + 1e-9) + 1)


def test_notices_without_any_anchor(spark):
    """A word of each of the eight anchors altered: each fit of brute force without a better one is found."""
    texts, names = [], []
    for name, template in licenses.TEMPLATES:
        w = licenses.words_of(template)
        for i in licenses.anchors(w):
            w[i if len(w[i]) > 2 else i + 1] += "x"
        if len(w) > 90:
            texts.append(" ".join(["before"] * 9 + w + ["after"] * 9))
            names.append(name)
    w = licenses.words_of(of("mit"))
    texts.append(" ".join(w[90:] + w[:90]))  # no word at its place in the whole
    got = found(spark, texts)
    for i, t in enumerate(texts):
        fits = brute_scan(t)
        rows = {(f[4], f[5] - f[4], f[2], round(-f[0], 9)) for f in fits}
        assert set(the_best(fits)) <= set(got[i]) <= rows and got[i]
    assert {"mit", "isc", "zlib", "unlicense"} <= {got[i][0][2] for i in range(len(names)) if len(got[i]) == 1} and len(names) == 6


def test_a_notice_without_anchors_beside_another(spark):
    """The first notice laid a few words late overlaps the second and is better; two of one template are two rows."""
    isc = licenses.words_of(of("isc"))
    for i in licenses.anchors(isc):
        isc[i] += "x"
    less = isc[:20] + ["other"] + isc[21:]
    got = found(spark, [of("mit") + "\n" + " ".join(isc), " ".join(isc) + "\n" + of("mit"), " ".join(isc + less)])
    assert {i: [x[2] for x in v] for i, v in got.items()} == {0: ["mit", "isc"], 1: ["isc", "mit"], 2: ["isc", "isc"]}
