"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Reference. A text is cut by content into phrases: runs of consecutive windows of
``window`` words that share their minimiser (the smallest hash among the
``seed``-word seeds inside the window), with the words they cover. The reference
is one copy of each distinct phrase whose minimiser occurs more than once; a
phrase that occurs twice or more is a factor as a whole. Reference blocks of
bounded size hold all phrases of their minimisers, one after the other, under a
suffix array.

Routing. Equal windows have the same minimiser, so the windows of a document
under a minimiser can only match in that minimiser's block: parsing each phrase
against its own block finds what parsing each document against every block
would, without meeting every block (a test compares both).

Parsing. The longest match of each position of a phrase with any other position
of its block comes from its neighbours in the suffix array. Greedily from left
to right the longest matches are factors (block, offset, length); those of
``window`` words or more are duplicate spans. Windows that reach over a factor's
boundary, and so lie in no factor, are checked by the same index one by one.

A minimiser with more reference words than a block may hold is not put into one
block: its windows are dealt by their hashes and counted (the exact way for
the rest). Shuffled per document: about one small row for each 14 words, the
compressed text, and the words of phrases that share a minimiser with others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize_table, slices_by_bytes, spread_join

R = 0x9E3779B97F4A7C15  # odd multiplier of the word-level rolling hash
RB = 0xD6E8FEB86659FD93  # the same for bytes
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}
_CHUNK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base & (2**64 - 1), np.uint64))))
        _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words of a byte string, in bounded pieces cut at white space."""
    hashes, offsets = [], []
    at = 0
    view = np.frombuffer(data, np.uint8)
    while at < len(data):
        stop = min(len(data), at + _CHUNK)
        while stop < len(data):
            space = np.flatnonzero(_SPACE[view[stop : stop + 65_536]])
            stop += int(space[0]) if len(space) else min(65_536, len(data) - stop)
            if len(space):
                break
        b = view[at:stop]
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            p = powers(RB, len(b))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p)))
            h = (sums[ends] - sums[starts]) * powers(inverse(RB), len(b))[starts]
            hashes.append(mixed(h + (ends - starts).astype(np.uint64) * np.uint64(R)))
            offsets.append(starts + at)
        at = stop
    none = np.empty(0, np.int64)
    return (np.concatenate(hashes), np.concatenate(offsets)) if hashes else (none.astype(np.uint64), none)


def _spans(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts of a slice, and each text's first and last-plus-one word."""
    texts = [(t or "").encode() for t in part.column("text").to_pylist()]
    h, at = word_hashes(b"\n".join(texts))
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    cuts = np.searchsorted(at, first)
    return h, cuts[:-1], cuts[1:]


def phrase_runs(h: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, seed: int) -> dict[str, np.ndarray] | None:
    """Phrases of several texts: doc (row number), start (word in its text), n (windows), v, phrase, repeats."""
    n_words, q = len(h), window - seed + 1
    if n_words < window:
        return None
    with np.errstate(over="ignore"):
        s = np.zeros(n_words - seed + 1, np.uint64)
        for t in range(seed):
            s = s * np.uint64(R) + h[t : n_words - seed + 1 + t]
        s = mixed(s)
        m, width = s, 1
        while width * 2 <= q:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < q:
            m = np.minimum(m[: len(m) - (q - width)], m[q - width :])
        valid = np.zeros(len(m) + 1, np.int32)
        long = last - first >= window
        if not long.any():
            return None
        np.add.at(valid, first[long], 1)
        np.add.at(valid, last[long] - window + 1, -1)
        valid = np.cumsum(valid)[:-1] > 0
        same = np.zeros(len(m), bool)
        same[1:] = valid[1:] & valid[:-1] & (m[1:] == m[:-1])
        # Two texts may be exactly `window` - 1 words apart only across a gap of invalid windows, so runs never join texts
        # unless the gap is empty; texts' first windows therefore always begin a run.
        same[first[long]] = False
        begin = np.flatnonzero(valid & ~same)
        end = np.flatnonzero(valid & ~np.append(same[1:], False))
        n = end - begin + 1
        near = np.zeros(len(s), bool)
        for d in range(1, q):
            near[:-d] |= s[:-d] == s[d:]
        near = np.concatenate(([0], np.cumsum(near)))
        repeats = near[np.minimum(end + q, len(s))] > near[begin]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(R, n_words))))
        phrase = mixed((sums[end + window] - sums[begin]) * powers(inverse(R), n_words)[begin] + n.astype(np.uint64) * np.uint64(RB))
    doc = np.searchsorted(first, begin, side="right") - 1
    return {"doc": doc, "start": begin - first[doc], "n": n, "v": m[begin], "phrase": phrase, "repeats": repeats.astype(np.int32)}


def window_hashes(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(R, len(h)))))
        return mixed((sums[starts + window] - sums[starts]) * powers(inverse(R), len(h))[starts])


def _keyed(docs: DataFrame) -> DataFrame:
    """(k, tag) names a row by its id and its text, so that rows that share an id stay apart; equal rows share it."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-1)).alias("k"), F.xxhash64(doc_id, text).alias("tag"), doc_id.alias("doc_id"), text.alias("text"))


def _phrases(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    for part in slices_by_bytes(batches, "text", _CHUNK):
        found = phrase_runs(*_spans(part), window, seed)
        if found is None:
            continue
        doc = pa.array(found["doc"])
        yield pa.RecordBatch.from_arrays(
            [part.column("k").take(doc), part.column("tag").take(doc), pa.array(found["start"].astype(np.int32)), pa.array(found["n"].astype(np.int32)), pa.array(found["v"].view(np.int64)), pa.array(found["phrase"].view(np.int64)), pa.array(found["repeats"])],
            ["k", "tag", "start", "n", "v", "phrase", "repeats"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for part in slices_by_bytes(batches, "text"):
        z = pa.array([pack((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("k"), part.column("tag"), part.column("doc_id"), z], ["k", "tag", "doc_id", "z"])


def _contents(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Word hashes of the phrases that go to a block, and window hashes (at most 4,096 a row) of those that are dealt singly."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for row in range(0, batch.num_rows, 16):
            part = batch.slice(row, 16)
            out: list[tuple] = []
            for k, tag, z, marks in zip(*(part.column(c).to_pylist() for c in ("k", "tag", "z", "marks")), strict=True):
                h, _ = word_hashes(unpack(z))
                for m in marks:
                    if not m["mode"]:
                        continue
                    first, n = m["start"], m["n"]
                    if not m["single"]:
                        out.append((k, tag, m["v"], False, m["mode"] == 2, first, h[first : first + n + window - 1]))
                        continue
                    for at in range(first, first + n, 4096):
                        out.append((k, tag, m["v"], True, m["mode"] == 2, at, window_hashes_at(h, np.arange(at, min(first + n, at + 4096)), window)))
            if out:
                words = pa.ListArray.from_arrays(np.cumsum([0] + [len(x[6]) for x in out]).astype(np.int32), pa.array(np.concatenate([x[6] for x in out]).view(np.int64)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)), words], ["k", "tag", "v", "single", "ask", "start", "words"])


def window_hashes_at(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Hashes of consecutive windows, from their own words only, so that they don't depend on what stands before."""
    piece = h[starts[0] : starts[-1] + window]
    return window_hashes(piece, starts - starts[0], window)


def longest_matches(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest match of each position of ``x`` with another one, by a suffix array.

    x: words of several phrases; ``ends``: where they end (exclusive). Matches
    don't cross ends, as each has a separator of its own. Ranks of prefixes of
    1, 2, 4 ... words are kept: they sort the suffixes and measure matches.
    """
    m = len(ends)
    n = len(x) + m
    at = np.arange(len(x)) + np.repeat(np.arange(m), np.diff(np.concatenate(([0], ends))))
    rank = np.empty(n, np.int64)
    _, ids = np.unique(x, return_inverse=True)
    rank[at] = ids
    separators = ends + np.arange(m)
    rank[separators] = len(x) + np.arange(m)
    levels = [np.unique(rank, return_inverse=True)[1]]
    width = 1
    while levels[-1].max() < n - 1:
        r = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - width] = r[width:] + 1
        levels.append(np.unique(r * (n + 1) + after, return_inverse=True)[1])
        width *= 2
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    i, j = order[:-1].copy(), order[1:].copy()
    same = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 2, -1, -1):
        inside = np.flatnonzero((i < n) & (j < n))
        eq = inside[levels[level][i[inside]] == levels[level][j[inside]]]
        for a in (same, i, j):
            a[eq] += 1 << level
    length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before, after = np.concatenate(([0], same)), np.concatenate((same, [0]))
    length[order] = np.maximum(before, after)
    other = np.where(before >= after, np.concatenate(([0], order[:-1])), np.concatenate((order[1:], [0])))
    place[order] = other
    return length[at], place[at] - np.searchsorted(separators, place[at])


def factors_of(length: np.ndarray, first: int, last: int, window: int) -> list[tuple[int, int]]:
    """(position, words) of a stretch of repeated windows [first, last]: greedily the longest match at each place reached,
    and after each the windows over its boundary, which lie in no factor and were looked up by themselves."""
    out, p = [], first
    while p <= last:
        end = p + int(length[p])
        out.append((p, end - p))
        over, stop = end - window + 1, min(last, end - 1)
        if over <= stop:
            out.append((over, stop - over + window))
        p = end
    return out


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by block -> the spans of asked phrases: a factor, as far as windows over its boundaries carry it on."""
    current, held = None, []

    def finish() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        words = table.column("words").combine_chunks()
        sizes = np.diff(words.offsets.to_numpy())
        ends = np.cumsum(sizes)
        length, place = longest_matches(words.flatten().to_numpy(), ends)
        phrase = np.repeat(np.arange(len(sizes)), sizes)
        dup = (length >= window) & table.column("ask").to_numpy()[phrase]
        begin = np.flatnonzero(dup & ~np.concatenate(([False], dup[:-1] & (phrase[1:] == phrase[:-1]))))
        last = np.flatnonzero(dup & ~np.concatenate((dup[1:] & (phrase[1:] == phrase[:-1]), [False])))
        found = np.array([f for i, j in zip(begin.tolist(), last.tolist(), strict=True) for f in factors_of(length, i, j, window)], np.int64).reshape(-1, 2)
        if len(found):
            at, of = found[:, 0], phrase[found[:, 0]]
            start = table.column("start").to_numpy()[of] + at - (ends - sizes)[of]
            take = pa.array(of)
            columns = [table.column(c).combine_chunks().take(take) for c in ("k", "tag")]
            columns += [pa.array(x) for x in (start.astype(np.int32), found[:, 1].astype(np.int32), np.full(len(of), current), place[at])]
            yield pa.RecordBatch.from_arrays(columns, ["k", "tag", "start", "words", "block", "offset"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(batch.schema.get_field_index("block")).to_numpy()
        edge = np.flatnonzero(block[1:] != block[:-1]) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.append(edge, len(block)), strict=True):
            if block[a] != current:
                yield from finish()
                current, held = int(block[a]), []
            held.append(batch.slice(a, b - a).select(["k", "tag", "ask", "start", "words"]))
    yield from finish()


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            part = batch.slice(row, 64)
            out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "spans", "kept_text")}
            for z, marks, factors in zip(*(part.column(c).to_pylist() for c in ("z", "marks", "factors")), strict=True):
                words = unpack(z).split()
                cover = np.zeros(len(words) + 1, np.int32)
                for mark in marks or ():
                    if mark["mode"] < 2:
                        cover[mark["start"]] += 1
                        cover[mark["start"] + mark["n"] - 1 + window] -= 1
                for factor in factors or ():
                    cover[factor["start"]] += 1
                    cover[factor["start"] + factor["words"]] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                out["kept_text"].append(b" ".join(compress(words, ~gone) if len(edge) else words).decode())
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in out["kept_text"]]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tag"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), part.column("factors"), pa.array(out["kept_text"], pa.string()), pa.array(digest)],
                ["doc_id", "tag", "n_words", "n_removed", "spans", "factors", "kept_text", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 8, block_words: int = 500_000) -> DataFrame:
    """doc_id, tag (hash of id and text), n_words, n_removed, spans (start, length: the maximal repeated stretches),
    factors (start, words, block, offset: found by parsing, beside whole phrases), kept_text, kept_sha256.

    A word goes if a window of ``window`` words around it starts anywhere else
    too, in another document or in the same. Null and empty texts have no word;
    texts shorter than a window lose nothing; texts of any length are read
    whole, in parts cut at white space; repeated rows are repeats of each other;
    rows with a null doc_id take part; only doc_id and text are read, whatever
    else there is; an empty table gives no row.
    """
    keyed = _keyed(docs)
    runs = map_arrow(keyed.select("k", "tag", "text"), lambda b: _phrases(b, window, seed), "k long, tag long, start int, n int, v long, phrase long, repeats int")
    # Minimisers that occur in more than one phrase occurrence. Partial aggregation makes hot ones cheap.
    index = runs.groupBy("v").agg(F.count("*").alias("c"), F.min("phrase").alias("a"), F.max("phrase").alias("b"), F.max("repeats").alias("r"))
    index = index.where("c > 1 or r > 0").select(F.col("v").alias("iv"), ((F.col("a") != F.col("b")) | (F.col("r") > 0)).alias("fine"))
    # Written, so that the join is a plain shuffled one: Spark splits the partition of a minimiser that many texts share.
    index = materialize_table(index)
    marked = materialize_table(runs.join(index, F.col("v") == F.col("iv")).select("k", "tag", "start", "n", "v", "phrase", "fine"))
    # Phrases seen twice are factors as a whole; the first of them stands for all in the reference.
    fine = marked.where("fine")
    classes = fine.groupBy("v", "phrase").agg(F.count("*").alias("c"), F.min(F.struct("k", "tag", "start")).alias("first"), F.first("n").alias("_n"))
    classes = materialize_table(classes)
    # A minimiser's reference words, for its block; more than a fifth of a block go singly.
    per = classes.groupBy("v").agg(F.sum(F.col("_n") + (window - 1)).alias("_w")).select("v", (F.col("_w") > block_words // 5).alias("single"))
    classes = materialize_table(spread_join(classes, per, ["v"], ["phrase"]).drop("_n"))
    fine = spread_join(fine, classes, ["v", "phrase"], ["k", "tag", "start"])
    mode = F.when(F.col("c") == 1, 2).when(F.col("first") == F.struct("k", "tag", "start"), 1).otherwise(0)
    moded = fine.select("k", "tag", "start", "n", "v", mode.alias("mode"), "single").unionByName(marked.where("not fine").select("k", "tag", "start", "n", "v", F.lit(0).alias("mode"), F.lit(False).alias("single")))
    marks = moded.groupBy("k", "tag").agg(F.collect_set(F.struct("start", "n", "v", "mode", "single")).alias("marks"))
    packed = map_arrow(keyed, _packed, "k long, tag long, doc_id long, z binary")
    whole = materialize_table(packed.join(marks, ["k", "tag"], "left"))
    asking = whole.where(F.exists("marks", lambda m: m["mode"] > 0)).select("k", "tag", "z", "marks")
    contents = materialize_table(map_arrow(asking, lambda b: _contents(b, window), "k long, tag long, v long, single boolean, ask boolean, start int, words array<long>"))
    words = contents.where("NOT single").agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(64, -(-words // block_words))
    phrases = contents.where("NOT single").withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))).select("block", "k", "tag", "ask", "start", "words")
    found = map_arrow(phrases.repartition("block").sortWithinPartitions("block"), lambda b: _parsed(b, window), "k long, tag long, start int, words int, block long, offset long")
    # The rest: windows one by one, dealt by their hashes.
    singly = contents.where("single").select("k", "tag", "v", "ask", "start", F.posexplode("words").alias("_i", "w"))
    singly = singly.select("k", "tag", "v", "ask", (F.col("start") + F.col("_i")).alias("start"), "w")
    if not contents.where("single").isEmpty():
        singly = materialize_table(singly)
        twice = materialize_table(singly.groupBy("v", "w").agg(F.count("*").alias("c")).where("c > 1").select("v", "w"))
        one = spread_join(singly.where("ask"), twice, ["v", "w"], ["k", "tag", "start"])
        found = found.unionByName(one.select("k", "tag", "start", F.lit(window).alias("words"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("offset")))
    factors = found.groupBy("k", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "words", "block", "offset"))).alias("factors"))
    whole = whole.join(factors, ["k", "tag"], "left").select("doc_id", "tag", "z", "marks", "factors")
    factor = "array<struct<start: int, words: int, block: long, offset: long>>"
    schema = f"doc_id long, tag long, n_words long, n_removed long, spans array<struct<start: long, length: long>>, factors {factor}, kept_text string, kept_sha256 string"
    return map_arrow(whole, lambda b: _cut(b, window), schema)


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated passages, all columns kept: a text that loses words becomes its kept words, joined by one
    space (``n_chars``, where present, follows); one that loses none stays as it was; one that loses all of them goes."""
    cut = remove_repeats(docs, **options).where("n_removed > 0")
    cut = cut.select(F.coalesce("doc_id", F.lit(-1)).alias("k"), "tag", "kept_text", (F.col("n_removed") == F.col("n_words")).alias("gone")).dropDuplicates(["k", "tag"])
    # The document as one struct: no name of its columns can clash.
    tag = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), tag.alias("tag"), F.struct(*docs.columns).alias("d"))
    rows = rows.join(cut, ["k", "tag"], "left").where(~F.coalesce("gone", F.lit(False)))
    out = {"text": F.coalesce("kept_text", "d.text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.length("kept_text")).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) if c in out else F.col("d").getField(c).alias(c) for c in docs.columns])
