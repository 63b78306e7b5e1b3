"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters is one space, and n-grams of 1 to 3 characters are
hashed into ``features`` columns. The log-probability matrix (languages x features, its size a parameter
times the number of languages, at most ``most_languages``: more are an error) is broadcast; whole texts are
scored in Arrow batches by summing the rows of their n-grams in numpy. The model is fitted on about
``per_language`` labelled training rows of each language (texts of at most ``longest`` bytes, or of the least
size there is if a language has only longer ones), drawn by a hash of the id: a documented, bounded sample.
All languages weigh the same: there is no prior. lang, source and ids are never inputs of a prediction.

score is the posterior probability of the predicted language. Defined results: a null text or one without
letters is `und` with score 0; ties go to the first language in code-point order; without training rows
every text is `und`; a null id is training; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.shared import bounded_batches, fold, release, tidy

ORDERS = (1, 2, 3)


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space for anything else."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


class Features:
    """Hashed n-gram columns of texts; one table of letters for a worker's life."""

    def __init__(self, features: int):
        self.bits, self.letters = features.bit_length() - 1, _letters()

    def runs(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, columns of all its run's n-grams, the text of each) by runs of about 300,000 characters."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 300_000):
                size += len(texts[j])
                j += 1
            # two spaces after each text: no n-gram of letters spans two texts
            codes = self.letters[np.frombuffer("".join(t + "  " for t in texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)]
            owner = np.repeat(np.arange(j - i), np.fromiter((len(t) + 2 for t in texts[i:j]), np.int64, j - i))
            space = codes == 32
            keep = ~space | ~np.concatenate([[True], space[:-1]])
            codes, owner, space = codes[keep], owner[keep], space[keep]
            columns, owners = [], []
            h = np.zeros(len(codes), np.uint32)
            for n in range(max(ORDERS)):
                size = len(codes) - n
                if size <= 0:
                    break
                h = (h[:size] ^ codes[n:]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                if n + 1 in ORDERS:
                    whole = (owner[:size] == owner[n:]) & ~(space[:size] & (n == 0))
                    columns.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - self.bits))[whole])
                    owners.append(owner[:size][whole])
            yield i, np.concatenate(columns) if columns else np.zeros(0, np.uint32), np.concatenate(owners) if owners else np.zeros(0, np.int64)
            i = j

    def has_letter(self, texts: list[str]) -> np.ndarray:
        return np.fromiter((any(c.isalpha() for c in t) for t in texts), bool, len(texts))


def fit(training: DataFrame, text: str, lang: str, id_hash: Column, features: int, per_language: int, longest: int, most_languages: int) -> dict:
    """languages and the float32 log-probability matrix; n-grams are counted in the executors."""
    known = F.col(lang).isNotNull() & F.col(text).isNotNull()
    labelled = training.where(known).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), id_hash.alias("h"), F.octet_length(text).alias("n"))
    short = F.greatest(F.lit(1), F.count_if(F.col("n") <= longest))
    facts = labelled.groupBy("l").agg(F.greatest(F.lit(longest), F.min("n")).alias("most"), F.least(F.lit(1.0), F.lit(float(per_language)) / short).alias("p"))
    facts = facts.limit(most_languages + 1).collect()
    if len(facts) > most_languages:
        raise ValueError(f"more than {most_languages} languages: a matrix of that size isn't broadcast")
    names = sorted((r["l"] for r in facts), key=lambda x: x.encode())
    counts = np.zeros((len(names), features))
    if names:
        shares = F.broadcast(training.sparkSession.createDataFrame(facts, "l string, most int, p double"))
        drawn = labelled.join(shares, "l").where((F.col("n") <= F.col("most")) & (F.pmod("h", F.lit(1 << 30)) < F.col("p") * F.lit(1 << 30))).select("l", "t")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maker, found = Features(features), {}
            for batch in batches:
                langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for name in set(langs):
                    own = found.setdefault(name, np.zeros(features))
                    for _, columns, _ in maker.runs([t for x, t in zip(langs, texts, strict=True) if x == name]):
                        own += np.bincount(columns, minlength=features)
            for name, own in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([own.tobytes()], pa.binary())], ["l", "n"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {}
            for batch in batches:
                for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found[name] = found.get(name, 0) + np.frombuffer(n)
            for name, own in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([own.tobytes()], pa.binary())], ["l", "n"])

        summed = drawn.mapInArrow(tidy(count), "l string, n binary").repartition("l").mapInArrow(tidy(total), "l string, n binary")
        for r in summed.collect():  # a row per language
            counts[names.index(r["l"])] = np.frombuffer(r["n"])
    log = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * features)) if names else counts
    return {"languages": names, "log": np.ascontiguousarray(log.astype(np.float32))}


def score_batch(model: dict, maker: Features, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, posterior) of each text."""
    names, log = model["languages"], model["log"]
    total = np.zeros((len(texts), len(names)))
    bare = ~maker.has_letter(texts)
    if names:
        for i, columns, owners in maker.runs(texts):
            n = int(owners.max()) + 1 if len(owners) else 0
            for k in range(len(names)):
                total[i : i + n, k] += np.bincount(owners, weights=log[k][columns], minlength=n)
    best = total.argmax(axis=1) if names else np.zeros(len(texts), int)
    posterior = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1) if names else np.zeros(len(texts))
    posterior[bare] = 0.0
    return ["und" if b or not names else names[k] for b, k in zip(bare, best, strict=True)], posterior


def identify(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", held_out: Column | None = None, rows: bool = False,
    features: int = 1 << 15, per_language: int = 1500, longest: int = 20_000, most_languages: int = 1000,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score; with rows also ``row``, a struct of every column of documents.

    held_out: rows the model doesn't learn from (default: crc32 of doc_id as text is divisible by 5).
    """
    bounded_batches(documents.sparkSession)
    held = fold(F.col(doc_id), 5) == 0 if held_out is None else held_out
    model = fit(documents.where(~held), text, lang, F.xxhash64(F.col(doc_id).cast("string"), F.lit(5)), features, per_language, longest, most_languages)
    bc = documents.sparkSession.sparkContext.broadcast(model)
    release()

    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bc.value
        if "maker" not in own:  # once in a worker's life
            own["maker"] = Features(features)
        for batch in batches:
            texts = batch.column(2).field(place) if rows else batch.column(2)
            names, posterior = score_batch(own, own["maker"], [t or "" for t in texts.to_pylist()])
            kept = batch.num_columns if rows else 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(names, pa.string()), pa.array(posterior, pa.float64())], [*batch.schema.names[:kept], "lang_pred", "score"])

    body = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row") if rows else F.col(text).alias("text")
    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), body)
    kept = StructType([*(given if rows else given.drop("text")).schema.fields]).add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(tidy(run), kept)
