"""Lempel-Ziv phrase fingerprints: minimum-hash signatures of a text's dictionary phrases.

A text is parsed left to right into phrases, each the shortest piece that is not yet in the dictionary, as
long as that may be. Every prefix of a known phrase is known, so a long phrase's length is found by doubling
and halving: the work is a text's length times the logarithm of its longest phrase, and the dictionary holds
no more characters than the text. The set of phrases is hashed and each of ``bins`` ranges of the hash keeps
its smallest value; an empty range borrows from the next full one. Likeness is the share of equal ranges: two texts that a dictionary coder would see as one
share their phrases.

Every text is also compared with an edited form: its last third is replaced by the start of the next
document in descending id (after the last, the first). Texts are sorted by one range shuffle, an id of many
rows by its texts' crc; each partition also receives the first text of the one that follows, so neighbours
meet without a window. Equal rows meet in one task, which parses them once.

Defined results: null is the empty text; the empty text has the signature of no phrase and is like only
itself; repeated rows and equal ids follow each other in the order of their texts' crc; a null id sorts
last; a table of one row is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bounded_batches, partitions, tidy
from quillspark.llm.textarrays import span_hashes

BINS = 128
NONE = np.uint64((1 << 64) - 1)
NO_ID = -(1 << 63)  # the place of a null id: last


def _parse(text: str, known: set[str], piece: str) -> tuple[list[str], str]:
    """Continue a parse that stands at ``piece``, a known one: (phrases added to known in turn, the open piece)."""
    text = piece + text
    n, place = len(text), len(piece)
    added: list[str] = []
    add, keep = known.add, added.append
    while place < n:
        block = text[place : place + 64]
        for c in block:
            piece += c
            if piece not in known:
                add(piece)
                keep(piece)
                piece = ""
        place += len(block)
        if len(piece) > 64:  # a long phrase: double its known length while it is known, then halve the gap
            at, low = place - len(piece), len(piece)
            high = 2 * low
            while at + high <= n and text[at : at + high] in known:
                low, high = high, 2 * high
            high = min(high, n - at + 1)  # what would end beyond the text counts as unknown
            while high - low > 1:
                middle = (low + high) // 2
                if text[at : at + middle] in known:
                    low = middle
                else:
                    high = middle
            piece, place = text[at : at + low + 1], at + low + 1
            if place <= n:
                add(piece)
                keep(piece)
                piece = ""
    return added, piece


def _minimums(parts: list[list[str]], bins: int) -> np.ndarray:
    """Per list of phrases its bins' least hashes."""
    out = np.full((len(parts), bins), NONE, np.uint64)
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    sizes = np.fromiter((len(x) for own in parts for x in own), np.int64, int(count.sum()))
    if not len(sizes):
        return out
    buffer = np.frombuffer("".join(x for own in parts for x in own).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        h = span_hashes(buffer, ends - sizes, ends)
    row = np.repeat(np.arange(len(parts)), count)
    np.minimum.at(out.reshape(-1), row * bins + (h % np.uint64(bins)).astype(np.int64), h // np.uint64(bins))
    return out


def _signature(low: np.ndarray) -> np.ndarray:
    """16-bit values of each bin; empty bins take the next full bin's value, shifted by the distance."""
    n, bins = low.shape
    full = np.concatenate([low != NONE] * 2, axis=1)
    at = np.where(full, np.arange(2 * bins), 4 * bins)
    after = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
    gap = (after - np.arange(bins)).astype(np.uint64)
    with np.errstate(over="ignore"):
        value = np.take_along_axis(low, after % bins, axis=1) + gap * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(17)) ^ (value >> np.uint64(37))) & np.uint64(0xFFFF)
    return np.where(after >= 2 * bins, np.uint64(0xFFFF), value).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """Share of equal bins; a text without phrases is like only another one."""
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), (a == b).mean(axis=1))


def _compare(rows: list[tuple[int | None, str]], following: list[str], bins: int) -> pa.RecordBatch:
    """rows: documents in order; following: the text after each."""
    parts: list[list[str]] = []
    hashes: list[str] = []
    before: tuple[str, str] | None = None
    for (_, text), after in zip(rows, following, strict=True):
        if before == (text, after):  # repeated rows
            parts += parts[-3:]
            hashes.append(hashes[-1])
            continue
        before = text, after
        cut = len(text) - len(text) // 3
        tail = after[: len(text) // 3]
        known: set[str] = set()
        head, piece = _parse(text[:cut], known, "")
        rest, _ = _parse(text[cut:], known, piece)
        known.difference_update(rest)
        edited, _ = _parse(tail, known, piece)
        parts += [head, rest, edited]
        hashes.append(hashlib.sha256((text[:cut] + tail).encode("utf-8", "surrogatepass")).hexdigest())
    low = _minimums(parts, bins).reshape(len(rows), 3, bins)
    own, edited = np.minimum(low[:, 0], low[:, 1]), np.minimum(low[:, 0], low[:, 2])
    signs, edits = _signature(own), _signature(edited)
    next_low = _minimums([_parse(t, set(), "")[0] for t in following[-1:]], bins)
    nexts, bare = np.concatenate([signs[1:], _signature(next_low)]), (own == NONE).all(axis=1)
    next_bare = np.concatenate([bare[1:], (next_low == NONE).all(axis=1)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()), pa.array(hashes), pa.array([s.tobytes().hex() for s in signs]), pa.array([s.tobytes().hex() for s in edits]),
            pa.array(likeness(signs, edits, bare, (edited == NONE).all(axis=1))), pa.array(likeness(signs, nexts, bare, next_bare)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", bins: int = BINS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    bounded_batches(documents.sparkSession)
    spark = documents.sparkSession
    parts = partitions(spark)
    text_crc = F.crc32(F.col("text").cast("binary"))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # cuts of about equal numbers of rows; a key that holds several shares lies between two of its own
    shares = docs.where("doc_id is not null").select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    shares = [int(c) for c in shares]
    often = [a for a, b in zip(shares, shares[1:], strict=False) if a == b]
    cuts = sorted({*shares, *(a + 1 for a in often), NO_ID + 1} - {NO_ID}, reverse=True)
    docs = docs.withColumn("range", F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: F.col("key") < c)))
    ranges = {r["range"]: r for r in docs.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).collect()}
    mean = sum(r["n"] for r in ranges.values()) / parts
    # a range of one key is dealt by its texts' crc
    split = [max(1, round(ranges[i]["n"] / mean)) if i in ranges and ranges[i]["low"] == ranges[i]["high"] else 1 for i in range(len(cuts) + 1)]
    first = [sum(split[:i]) for i in range(len(split))]
    of = lambda x: F.get(F.array(*(F.lit(v) for v in x)), F.col("range"))
    docs = docs.withColumn("crc", text_crc)
    docs = docs.select("doc_id", "key", "text", "crc", (of(first) + F.shiftright(F.col("crc") * of(split), 32)).cast("int").alias("bucket"))
    starts = docs.groupBy("bucket").agg(F.max(F.struct("key", (-F.col("crc")).alias("back"))).alias("x")).select("bucket", "x.*").collect()
    starts = sorted((r["bucket"], r["key"], -r["back"]) for r in starts)
    before = [(key, crc, starts[i - 1][0]) for i, (_, key, crc) in enumerate(starts)]  # a row per partition
    ahead = F.broadcast(spark.createDataFrame(before, "key bigint, crc bigint, to int"))
    extra = docs.join(ahead, ["key", "crc"]).groupBy(F.col("to").alias("bucket")).agg(F.first("text").alias("text"))
    extra = extra.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), "text", F.lit(None).cast("long").alias("crc"), "bucket", F.lit(True).alias("ahead"))
    dealt = docs.withColumn("ahead", F.lit(False)).unionByName(extra)
    dealt = dealt.repartitionById(sum(split), F.col("bucket")).sortWithinPartitions("ahead", F.desc("key"), "crc").select("doc_id", "text", "ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, over = 0, False
        for batch in batches:
            for i, t, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if over:
                    continue
                if last or size > 1_000_000:
                    if held:
                        yield _compare(held, [x for _, x in held[1:]] + [t], bins)
                    held, size, over = [], 0, last
                if not last:
                    held.append((i, t))
                    size += len(t)

    return dealt.mapInArrow(tidy(run), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
