"""Sequence packing by power-of-two decomposition.

A document of n ids becomes pieces of 2048 ids while they last and then one piece for each set bit of the
rest, longest first. Every piece is a sequence of its own in the bucket of its length, so no sequence
holds two documents and none is padded. Sequence numbers run bucket by bucket, longest first.

Tokenizing streams; its result is never gathered. The numbering is one range shuffle of small rows
(ids only if asked for). Defined results: a null text is one end id; repeated rows are packed each;
an empty table gives no rows; a null doc_id keeps null.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Scratch, numbered, tidy

LONGEST = 2048


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Callable[[str], list[int]]:
    """Text -> ids of the byte-level BPE in json_path.

    ranks_path holds the same vocabulary as ranks; its library gives the same ids several times faster.
    It takes the texts below U+0240, where both split words alike, unless the special token's name is in
    the text; all other texts go to the tokenizer of json_path.
    """
    import public_tokenizers
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole: list = []  # loaded when a text needs it
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < 0xC9:
            if "<|endoftext|>" not in text:
                return fast.encode_ordinary(text)
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of n ids: powers of two, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if n % longest >> b & 1]


def pieces(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, longest: int = LONGEST, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): ids are packed little-endian unsigned 32-bit numbers."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for own, string in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(string or ""), end_id], "<u4")
                at = 0
                for n in lengths(len(ids), longest):
                    rows.append((own, at, n, len(ids), ids[at : at + n].tobytes()))
                    at += n
                held += len(ids)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], names)

    return documents.select(F.col(doc_id).cast("long"), text).mapInArrow(tidy(run), "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


def pack(documents: DataFrame, ids: bool = True, **parameters) -> DataFrame:
    """Pieces with sequence_id, offset (0), bucket (log2 of the length), ids_crc32 and, if asked for, ids."""
    scratch = Scratch(documents.sparkSession, "packing")
    found = pieces(documents, **parameters).withColumn("ids_crc32", F.crc32("ids"))
    found = scratch.table(found if ids else found.drop("ids"), "pieces")
    out = numbered(scratch, found, [F.desc("length"), "doc_id", "start", "ids_crc32"], "sequences", "sequence_id")
    scratch.drop("pieces")
    return out.withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))
