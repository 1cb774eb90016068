"""Periodic runs of words in texts, by the method of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least ``times`` x q words
and at least ``least`` words long, that neither neighbour extends. Each text is
screened first: inside a run every word comes again within q words, so a run lies
in a stretch whose next occurrences are all near (``stretches``, for every scale of
q at once). What passes is a string of its own:

* LZ factors from the suffix automaton (``factors``): the longest piece that
  starts earlier too, or one new word;
* Main's algorithm at each factor's start (``crossing``): all runs that touch it
  and end in the factor, from two Z functions over a window of the factor and twice
  the one before; these include the leftmost occurrence of every run;
* runs strictly inside a factor are copied from its earlier occurrence.

Time is linear in a text's words but for the screen's scales, memory linear in the
longest text. Texts are independent, so there is no shuffle.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, map_arrow, slices_by_bytes
from .substring_dedup import word_hashes

Run = tuple[int, int, int]  # start, length, period


def stretches(hashes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Disjoint [from, to) that hold every run, and every run whole.

    A run of period q has at least (times - 1) q words, and least - q, whose next
    occurrence is at most q on. For 2^(k-1) < q <= 2^k these are a stretch of
    words with next occurrences within 2^k; the run ends at most 2^k after it.
    """
    n = len(hashes)
    if n < least:
        return []
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    ahead = np.full(n, n, np.int64)
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found = []
    top = 1
    while True:
        near = ahead <= top
        edge = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).view(np.int8)))
        low = top // 2 + 1
        # The least of max(least, times q) - q over the scale's q.
        shortest = max((times - 1) * low, least - top)
        for a, b in edge.reshape(-1, 2):
            if b - a >= shortest:
                found.append((int(a), int(min(n, b + top))))
        if top * times > n:
            break
        top *= 2
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors (start, length, earlier start; -1 for a new letter) of a string of numbers from 0.

    The suffix automaton keeps each state's first transition in arrays and any
    further ones in a dict, as most states have one; ``first`` is the earliest end
    of a state's strings.
    """
    length, link, first = array("q", [0]), array("q", [-1]), array("q", [-1])
    by, to = array("q", [-1]), array("q", [-1])
    more: dict[int, dict[int, int]] = {0: {}}
    last = 0
    for i, c in enumerate(s):
        cur = len(length)
        length.append(i + 1), link.append(0), first.append(i), by.append(-1), to.append(-1)
        p = last
        target = -1
        while p != -1:
            if by[p] == c:
                target = to[p]
                break
            if p in more and c in more[p]:
                target = more[p][c]
                break
            if by[p] == -1:
                by[p], to[p] = c, cur
            else:
                more.setdefault(p, {})[c] = cur
            p = link[p]
        if target != -1:
            if length[p] + 1 == length[target]:
                link[cur] = target
            else:
                clone = len(length)
                length.append(length[p] + 1), link.append(link[target]), first.append(first[target]), by.append(by[target]), to.append(to[target])
                if target in more:
                    more[clone] = dict(more[target])
                while p != -1:
                    if by[p] == c:
                        if to[p] != target:
                            break
                        to[p] = clone
                    elif p in more and more[p].get(c) == target:
                        more[p][c] = clone
                    else:
                        break
                    p = link[p]
                link[target] = link[cur] = clone
        last = cur
    out = []
    i, n = 0, len(s)
    while i < n:
        state, j = 0, i
        while j < n:
            c = s[j]
            step = to[state] if by[state] == c else more[state].get(c, -1) if state in more else -1
            if step == -1 or first[step] >= j:  # its earliest end is here: it doesn't start earlier
                break
            state = step
            j += 1
        if j == i:
            out.append((i, 1, -1))
            i += 1
        else:
            out.append((i, j - i, first[state] - (j - i) + 1))
            i = j
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of the string and its suffix there (0 at place 0)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = right - i if i < right else 0
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(s: list[int], b: int, before: int, size: int, least: int, times: int) -> list[Run]:
    """Main's algorithm: repetitions of s that touch place b and end in s[b - 1:b + size], whole ones only.

    ``size`` is the length of the factor that starts at b, ``before`` that of the
    one before. A run that ends in the factor starts less than 2 before + size
    words ahead of b: otherwise the factor before would have reached its end.
    """
    lo, hi = max(0, b - 2 * before - size), b + size
    t, u = s[lo:b], s[b:hi]
    nt, nu = len(t), len(u)
    if nt + nu < least:
        return []
    whole = t + u
    fore = z_function([*u, -1, *whole])
    back = z_function([*t[::-1], -1, *whole[::-1]])
    found = []

    def keep(p: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
        """Periods p, common extensions to the left of at and to the right, where ``at`` starts the first period."""
        ok = (left + right + p >= np.maximum(least, times * p)).nonzero()[0]
        for k in ok.tolist():
            start, length, q = int(at[k] - left[k]), int(left[k] + right[k] + p[k]), int(p[k])
            end = start + length
            if (start > lo or lo == 0) and not (end < len(s) and s[end] == s[end - q]):
                found.append((start, length, q))

    if nu:
        p = np.arange(1, nu + 1)
        z = np.array(fore[: nu + 1])
        z[nu] = 0
        keep(p, np.array(back[nt + 1 :])[nu - p] if nt else np.zeros(nu, np.int64), z[p], np.full(nu, b))
    if nt:
        p = np.arange(1, nt + 1)
        z = np.array(back[: nt + 1])
        z[nt] = 0
        keep(p, z[p], np.array(fore[nu + 1 :])[nt - p] if nu else np.zeros(nt, np.int64), b - p)
    return found


def runs_of(s: list[int], least: int = 24, times: int = 3) -> list[Run]:
    """All runs (start, length, period) of at least max(least, times * period) numbers, by start, then period."""
    parts = factors(s)
    least_period: dict[tuple[int, int], int] = {}  # (start, end): a stretch's other periods are multiples of its smallest
    starts: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, length: int, period: int) -> None:
        old = least_period.get((start, start + length))
        if old is None:
            starts.setdefault(start, []).append((start + length, period))
        elif old > period:
            starts[start] = [(e, period if e == start + length else q) for e, q in starts[start]]
        if old is None or old > period:
            least_period[start, start + length] = period

    before = 0
    for b, size, source in [*parts, (len(s), 0, -1)]:
        for run in crossing(s, b, before, size, least, times) if b else []:
            add(*run)
        if source >= 0 and size > least:
            # Runs strictly inside the factor, first to last, as a source may reach into the factor itself.
            shift = b - source
            heads = sorted(x for x in starts if source < x < source + size)
            k = 0
            while k < len(heads):
                x = heads[k]
                k += 1
                for end, period in list(starts[x]):
                    if end < source + size and x + shift > b:
                        fresh = x + shift not in starts
                        add(x + shift, end - x, period)
                        if fresh and x + shift < source + size:
                            heads.append(x + shift)
                            heads.sort()
        before = size
    return sorted(((a, b - a, q) for (a, b), q in least_period.items()), key=lambda r: (r[0], r[2]))


def runs_of_words(words: list[bytes], hashes: np.ndarray, least: int, times: int) -> list[Run]:
    found = []
    for a, b in stretches(hashes, least, times):
        number: dict[bytes, int] = {}
        found += [(a + start, length, q) for start, length, q in runs_of([number.setdefault(w, len(number)) for w in words[a:b]], least, times)]
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs and the text with each run brought down to its first period.

    runs: array of (start, length, period) in words, by start, then period.
    ``collapsed``: the kept words joined by one space. Null and empty texts have no
    word, no run and an empty collapsed text. Repeated rows give repeated rows, null
    ids stay null, an empty table gives no row, further columns are left out. A text
    of one word many times is one run of period 1. Long texts are worked on whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_by_bytes(batches, "text"):
            counts, found, texts = [], [], []
            for text in part.column("text").to_pylist():
                data = (text or "").encode()
                words = data.split()  # at \x20 and \x09-\x0D, as bytes do
                runs = runs_of_words(words, word_hashes(data)[0], least, times) if len(words) >= least else []
                counts.append(len(words))
                found.append([{"start": a, "length": m, "period": q} for a, m, q in runs])
                texts.append(b" ".join(collapsed(words, runs)).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, where every tenth text by crc32 of its id goes on in a period from a word on.

    With n words, h = crc32(decimal id) and g = h // 10: if h % 10 is 0, word i >= a
    becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) // (3 + g % 8). A null id
    leaves its text alone; a text without a word stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, n = F.col("_w"), F.size("_w").cast("long")
    g = F.floor(h / 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", h)
    rows = rows.withColumn("_w", F.when((F.col("_h") % 10 == 0) & F.col("text").rlike(WORD_PATTERN), F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), F.lit(1))))
    rows = rows.withColumn("_a", (g % n).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    made = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.element_at(words, at(i) + 1)))
    return rows.select("doc_id", F.when(words.isNotNull(), made).otherwise(F.col("text")).alias("text"))


def longest_exponent(runs: Column) -> Column:
    """Of an array of runs the one of greatest length / period, exactly; ties: smallest start, then period. Null if empty."""
    kind = "struct<start: bigint, length: bigint, period: bigint>"

    def better(best: Column, r: Column) -> Column:
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        wins = best.isNull() | (a > b) | ((a == b) & ((r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))))
        return F.when(wins, r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(kind), better)
