"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are powers of two up to the
context length: whole contexts first, then the binary digits of the rest. Each
piece is a sequence of its own, so no sequence crosses documents, none is
padded, and sequences of one length form a bucket that batches are drawn from.
No shuffle is needed: pieces are made where the document is read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices_by_bytes

TOKENIZER = "byte_bpe_50k"
_LONG = 1_000_000
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_made: dict[str, Callable[[str], bytes]] = {}


def encoder(name_or_path: str = TOKENIZER) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit bytes, as the ``tokenizers`` file gives them.

    The same vocabulary's ranks are read by ``tiktoken``, which gives the same
    ids in a fifth of the time; a text that holds a special token's string goes
    to ``tokenizers`` itself. Very long texts are encoded in parts that begin at
    a space between two other characters, which no pre-token reaches over.
    """
    if name_or_path not in _made:
        _made[name_or_path] = _encoder(name_or_path)
    return _made[name_or_path]


def _encoder(name: str) -> Callable[[str], bytes]:
    import base64
    import json

    import public_tokenizers
    import tiktoken

    json_path = name if "/" in name else public_tokenizers.path(f"{name}.json")
    with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    with open(json_path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    whole: list = []

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(json_path))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= _LONG:
            return np.array(fast(text), "<u4").tobytes()
        cuts, at = [0], _LONG
        while found := _BREAK.search(text, at):
            cuts.append(found.start())
            at = found.start() + _LONG
        return b"".join(np.array(fast(text[a:b]), "<u4").tobytes() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))

    return encode


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that sum to ``n``: as many ``longest`` as fit, then the binary digits of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, longest: int = 1024, end_id: int = 0, tokenizer: str = TOKENIZER, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unless left out), ids_crc32, doc_tokens, bucket, sequence_id, offset.

    A document's ids are its text's followed by ``end_id``; null and empty texts
    have that one id. A sequence is one piece, so ``offset`` is 0 and padding is
    none. ``bucket`` is log2 of the length. Repeated rows and null ids are packed
    like any other; an empty table gives no row. ``longest`` is a power of two.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for part in slices_by_bytes(batches, "text", 1_000_000):
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                data = memoryview(encode(text or "") + end)
                n, at = len(data) // 4, 0
                for size in piece_lengths(n, longest):
                    piece = data[at * 4 : (at + size) * 4]
                    doc.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    at += size
            columns = [part.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
    return pieces.withColumn("bucket", F.log2("length").cast("int")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
