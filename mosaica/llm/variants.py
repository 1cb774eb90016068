"""Spelling variants: words one inserted, deleted or replaced code point apart, and the forms they lead to.

Near words come from a positional q-gram inverted index. It is dealt over tasks by
long grams: one edit leaves all but one of four disjoint positional grams of a word
as they are, so near words share the other three, at the same places or, behind an
insertion, one further on. Each word is stored under its four triples and looked up
under those of its own length and of words one shorter (the length limit).

Inside a task the words of a triple have postings of their bigrams around the place
that is left open, by position. The posting lists that a word's bigrams reach within
the position limits (the same place; for a longer word also one before) are merged,
and numbers that come at least as often as one edit leaves bigrams standing are
candidates. Only these are verified. Lists are sorted runs, and the merge is one
stable sort of them, which merges runs, rather than a heap of one number at a time.

A pair is taken under the triple whose open place holds its (first possible) edit,
so it comes once. Triples of very many words are split into a grid of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, materialize_table, spread_join

#: Fixed values of the contract: the letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
PARTS = 4
STORED, SAME, LONGER = 0, 1, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUP, _PLACE, _LEFT, _RIGHT, _ANY = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def occurrences(docs: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, word: every run of at least ``least`` letters of every whole text, A-Z lower-cased. Null texts have none."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(runs).alias("word")).withColumn("word", F.translate("word", _UPPER, _LOWER))


def with_typos(words: DataFrame, every: int = 97) -> DataFrame:
    """word, where an occurrence loses a letter if ``every`` divides h, the crc32 of ``<doc_id>:<word>``: the one at h % length. A null id is empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return words.select(F.when(h % every == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, length: int = 5, count: int = 3) -> DataFrame:
    """word, n of the words of at least ``length`` code points and ``count`` occurrences."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _triples(words: DataFrame, shortest: int) -> DataFrame:
    """(key, role, part, base, word, n): each word under its own triples (stored) and under those of words one shorter (longer)."""
    entries = []
    for role, base in ((STORED, F.length("word")), (LONGER, F.length("word") - 1)):
        for part in range(PARTS):
            start, end = F.floor(base * part / PARTS).cast("int"), F.floor(base * (part + 1) / PARTS).cast("int")
            key = F.xxhash64(base, F.lit(part), F.substring("word", F.lit(1), start), F.substring(F.col("word"), end + (2 if role == LONGER else 1), F.length("word")))
            entries.append(F.struct(key.alias("key"), F.lit(role).alias("role"), F.lit(part).alias("part"), base.alias("base")))
    longer = F.when(F.length("word") > shortest, F.array(*entries)).otherwise(F.array(*entries[:PARTS]))
    return words.select("word", "n", F.explode(longer).alias("_e")).select("_e.*", "word", "n")


def _celled(rows: DataFrame, cap: int) -> DataFrame:
    """Add ``cell``: -1, or for keys of more than ``cap`` rows of a side the cells of a grid of blocks.

    A stored row of block b is stored in cells (b, c) for every c and looks others up
    in cells (c, b); a longer row of block p looks them up in (c, stored blocks + p).
    """
    n = rows.groupBy("key").agg(F.sum((F.col("role") == STORED).cast("long")).alias("s"), F.sum((F.col("role") == LONGER).cast("long")).alias("l"))
    hot = n.where((F.col("s") > 0) & ((F.col("s") > cap) | (F.col("l") > cap))).select("key", F.ceil(F.col("s") / cap).alias("gs"), F.ceil(F.col("l") / cap).alias("gl"))
    hot, found = broadcast_if_small(hot)
    if not found:
        return rows.withColumn("cell", F.lit(-1).cast("long"))
    cols = rows.columns
    g, salt = F.col("gs") + F.col("gl"), F.xxhash64("word")
    block = F.when(F.col("role") == STORED, F.pmod(salt, F.col("gs"))).otherwise(F.col("gs") + F.pmod(salt, F.greatest("gl", F.lit(1))))
    kind = "array<struct<cell: bigint, role: int>>"
    as_stored = F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda c: F.struct((F.col("_b") * g + c).alias("cell"), F.lit(STORED).alias("role")))
    searching = F.when(F.col("role") == STORED, F.lit(SAME)).otherwise(F.col("role"))
    as_search = F.transform(F.sequence(F.lit(0).cast("long"), F.col("gs") - 1), lambda c: F.struct((c * g + F.col("_b")).alias("cell"), searching.alias("role")))
    places = F.when(F.col("gs").isNull(), F.array(F.struct(F.lit(-1).cast("long").alias("cell"), F.col("role").alias("role"))).cast(kind)).when(F.col("role") == STORED, F.concat(as_stored, as_search).cast(kind)).otherwise(as_search.cast(kind))
    spread = rows.join(hot, "key", "left").withColumn("_b", block).withColumn("_c", F.explode(places))
    return spread.select(*[c for c in cols if c != "role"], F.col("_c.role").alias("role"), F.col("_c.cell").alias("cell"))


def edit_place(x: str, y: str, start: int, end: int) -> int:
    """Where y has one letter replaced, or one more than x, if that is the only difference and lies at start <= place < end
    (behind x's last letter too); -1 otherwise. Of several places for an insertion the last that leaves all before it equal counts."""
    if x[:start] != y[:start]:
        return -1
    p, m = start, len(x)
    while p < end and x[p] == y[p]:
        p += 1
    if len(y) == m:
        return p if p < end and x[p + 1 :] == y[p + 1 :] else -1
    return p if (p < end or end == m) and x[p:] == y[p + 1 :] else -1


def near_pairs(group: np.ndarray, split: np.ndarray, role: np.ndarray, part: np.ndarray, base: np.ndarray, words: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row numbers (x, y) of near words, y not the shorter, of rows sorted by group; ``split`` marks groups that are cells."""
    start, end = base * part // PARTS, base * (part + 1) // PARTS
    gap = end - start
    # One letter of context on each side of the open place, which a longer word fills with one letter more.
    width = gap + 2 + (role == LONGER)
    text = "".join([("\0" + w + "\0")[a : a + m] for w, a, m in zip(words, start.tolist(), width.tolist(), strict=True)])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(width) - width
    row = np.repeat(np.arange(len(words)), width - 1)
    place = np.arange(len(row)) - np.repeat(np.cumsum(width - 1) - (width - 1), width - 1)
    at = first[row] + place
    of_group = group.astype(np.uint64) * _GROUP
    gram = of_group[row] + code[at] * _LEFT + code[at + 1] * _RIGHT
    key = gram + place.astype(np.uint64) * _PLACE
    # One letter open: one edit may leave no bigram, and any two words differ by just that letter. An entry that all have.
    one = np.flatnonzero((gap == 1) & (role != LONGER))
    stored = role[row] == STORED
    k = np.concatenate((key[stored], of_group[one[role[one] == STORED]] + _ANY))
    r = np.concatenate((row[stored], one[role[one] == STORED]))
    order = np.argsort(k, kind="stable")
    k, r = k[order], r[order]
    # Look-ups: words of the same length at the same place, longer ones also at the place before.
    long_ = np.flatnonzero(role[row] == LONGER)
    same = np.flatnonzero(~((role[row] == STORED) & split[row]) & (role[row] != LONGER))
    lone = one[~((role[one] == STORED) & split[one])]
    back = long_[place[long_] > 0]
    look = np.concatenate((key[same], of_group[lone] + _ANY, key[long_], key[back] - _PLACE))
    who = np.concatenate((row[same], lone, row[long_], row[back]))
    by_row = np.argsort(who, kind="stable")
    look, who = look[by_row], who[by_row]
    left, right = np.searchsorted(k, look, "left"), np.searchsorted(k, look, "right")
    hits = right - left
    total = np.cumsum(hits)
    need = np.where(role == LONGER, gap, np.maximum(gap - 1, 1))
    a = 0
    while a < len(who):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right"))
        if b < len(who):  # a row's look-ups stay together
            b = int(np.searchsorted(who, who[b], "left"))
            b = b if b > a else int(np.searchsorted(who, who[a], "right"))
        n = hits[a:b]
        y = np.repeat(who[a:b], n)
        x = r[np.repeat(left[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        # In a group of its own each pair is looked up from both sides; one is enough. In cells the smaller word is stored.
        once = (role[y] != STORED) | (x > y)
        pair = np.sort((y[once] << 32) | x[once], kind="stable")
        if len(pair):
            edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
            times = np.diff(edge)
            pair = pair[edge[:-1]]
            pair = pair[times >= need[pair >> 32]]
            for i, j in zip((pair & 0xFFFFFFFF).tolist(), (pair >> 32).tolist(), strict=True):
                if (role[j] != SAME or words[i] < words[j]) and edit_place(words[i], words[j], int(start[j]), int(end[j])) >= 0:
                    yield i, j
        a = b


def _links(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    names = ["key", "cell", "role", "part", "base", "n", "word"]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cell, role, part, base, n = (table.column(c).to_numpy() for c in names[:6])
        words = table.column("word").to_pylist()
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
        # Groups without two words are left out before any posting is made.
        use = np.bincount(group)[group] > 1
        use &= np.bincount(group, role == STORED)[group] > 0
        at = np.flatnonzero(use)
        if not len(at):
            return
        pairs = np.array(list(near_pairs(group[at], cell[at] >= 0, role[at], part[at].astype(np.int64), base[at].astype(np.int64), [words[i] for i in at.tolist()])), np.int64).reshape(-1, 2)
        x, y = at[pairs[:, 0]], at[pairs[:, 1]]
        w, one, other = table.column("word").combine_chunks(), np.concatenate((x, y)), np.concatenate((y, x))
        for s in range(0, len(one), 100_000):
            yield pa.RecordBatch.from_arrays([w.take(pa.array(one[s : s + 100_000])), w.take(pa.array(other[s : s + 100_000])), pa.array(n[other[s : s + 100_000]])], ["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            key, cell = table.column("key").to_numpy(), table.column("cell").to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            cut = int(edge[-1]) + 1 if len(edge) else 0
            if cut:
                yield from found(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
    if size:
        yield from found(pa.Table.from_batches(held))


def near_words(words: DataFrame, cap: int = 4096) -> DataFrame:
    """word, near, near_n: both directions of every pair of words that one inserted, deleted or replaced code point divides.

    words: distinct (word, n) of at least four code points each, preferably a written table.
    """
    shortest = words.agg(F.min(F.length("word")).alias("l")).first()["l"]
    if shortest is not None and shortest < PARTS:
        raise ValueError(f"words of at least {PARTS} code points are needed")
    rows = _celled(_triples(words, shortest or PARTS), cap)
    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "role", "word")
    return map_arrow(dealt.select("key", "cell", "role", "part", "base", "n", "word"), _links, "word string, near string, near_n long")


def forms(words: DataFrame, ratio: int = 2, cap: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if
    that is at least ``ratio`` (2 or more) times the word's own, else null;
    ``root`` is the last of the forms that follow each other from the word, itself
    if it has none: n grows from each to the next, so they end. Null words are left
    out; an empty table gives no row.
    """
    words = materialize_table(words.where(F.col("word").isNotNull()).select("word", "n"))
    best = near_words(words, cap).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    found = words.join(best, "word", "left")
    leads = F.col("b").isNotNull() & (-F.col("b.m") >= ratio * F.col("n"))
    found = materialize_table(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("b.w")).alias("form"), F.when(leads, -F.col("b.m")).alias("form_n")))
    # Pointer doubling: each round a word's root becomes its root's root.
    steps = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        steps = materialize_table(steps)
        if not steps.join(steps.select(F.col("word").alias("root")), "root", "left_semi").limit(1).count():
            break
        steps = spread_join(steps, steps.select(F.col("word").alias("root"), F.col("root").alias("next")), ["root"], ["word"], "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
