"""The pipeline against brute force, stage by stage on what the stage before kept, and run() as a whole."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mosaica.llm import langid
from mosaica.llm.common import materialize_table, table
from mosaica.llm.queries import OP8_SQL

from test_text_ops import brute_fingerprint, brute_repeats, groups, words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with a documents table: real rows where there are some, nulls, empty and repeated rows, shared ids."""
    folder = tmp_path_factory.mktemp("pipeline")
    rows = []
    if os.path.isdir(DATA):
        rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).orderBy("doc_id").limit(120).collect()]
    base = "one two three four five six seven eight nine ten " * 5
    rows += [(9001, base, "en", "a", 1), (9002, base, "en", "a", 1), (9002, base, "en", "a", 1), (9003, base.upper(), "en", "b", 1), (9004, None, "en", "a", 1), (9005, "", None, None, None), (9006, "!! 12 ..", "en", "a", 1)]
    rows += [(None, "some words that stand alone in a document without an id", "en", "c", 1), (9001, "another text under an id that was used before it", "en", None, 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_and_run(spark, tables):
    docs = table(spark, tables, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "simhash_near_dedup", "substring_dedup", "mixing", "packing"]
    step = lambda name, d: materialize_table(stage[name](spark, d, tables))

    # Language: the same rows, those that the model knows with half its score at least.
    kept = step("language_id", docs)
    model = langid.train(docs)
    known = [r for r in rows_of(docs) if (p := model.predict(r[1]))[0] != "und" and p[1] >= 0.5]
    assert kept.columns == columns and rows_of(kept) == known and len(known) < docs.count()

    # Near duplicates: one row of each group of brute force, the one of smallest id.
    one = step("simhash_near_dedup", kept)
    prints = [brute_fingerprint(r[1]) for r in known]
    root = groups(len(known), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    left = rows_of(one)
    assert one.columns == columns and len(left) == len(set(root)) < len(known)
    where = {}
    for g, r in zip(root, known, strict=True):
        where.setdefault(g, []).append(r)
    ids = sorted(min((r[0] is None, r[0] or 0) for r in group) for group in where.values())
    assert ids == sorted((r[0] is None, r[0] or 0) for r in left) and all(r in known for r in left)

    # Repeated passages: kept words of brute force; untouched texts as they were.
    cut = step("substring_dedup", one)
    gone = brute_repeats([r[1] for r in left], 35)
    want = []
    for r, g in zip(left, gone, strict=True):
        w = words(r[1])
        text = r[1] if not g else b" ".join(x for i, x in enumerate(w) if i not in g).decode()
        if not g or len(g) < len(w):
            want.append((r[0], text, r[2], r[3], len(text) if g else r[4]))
    assert cut.columns == columns and rows_of(cut) == sorted(want, key=repr)

    # Mixing: the words that the plan's SQL takes of each row, as whole copies and one run (around the end).
    mixed = step("mixing", cut)
    con = duckdb.connect()
    documents = cut.toPandas()
    con.register("documents", documents)
    taken = {}
    for doc_id, size, *_, n in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP8_SQL})").fetchall():
        taken[(doc_id, size)] = taken.get((doc_id, size), 0) + n
    assert mixed.columns == columns and sum(taken.values()) == sum(len(words(r[1])) for r in rows_of(mixed))
    source = {(r[0], r[2], r[3]): [] for r in rows_of(cut)}
    for r in rows_of(cut):
        source[(r[0], r[2], r[3])].append(words(r[1]))
    for r in rows_of(mixed):
        w = words(r[1])
        assert any(len(w) <= len(x) and any((x + x)[i : i + len(w)] == w for i in range(len(x))) for x in source[(r[0], r[2], r[3])])

    # Packing: every document's ids, once, in powers of two.
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stage["packing"](spark, mixed, tables)
    got = {}
    for r in packed.collect():
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).append(r["length"])
    ids = {}
    for r in rows_of(mixed):
        ids.setdefault(r[0], []).append(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    assert {d: sum(n) for d, n in got.items()} == {d: sum(n) for d, n in ids.items()}

    # The whole: the same pieces as the stages one after the other.
    pieces = lambda df: rows_of(df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    assert pieces(corpus_pipeline.run(spark, tables)) == pieces(packed)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
