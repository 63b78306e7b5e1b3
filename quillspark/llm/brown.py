"""Class-based n-gram language model: exchange clustering assigns words to classes.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)).

* Counts cover every training text. Word counts are one shuffle of per-task sums. The most frequent
  ``clustered`` words are first clustered singly, the others as ``buckets`` groups by their last two bytes.
  Bigram counts of these units are gathered as one packed row per (task, previous unit); their number is
  bounded by the square of the unit count, a parameter, whatever the corpus. One task runs the exchange
  on that bounded matrix (4 bytes a cell, and once more transposed: about 150 MB at the default), sweep
  after sweep until it has settled.
* Then every other word seen at least ``least`` times gets its class by an exchange step of its own: its
  counts with the classes of its neighbours are joined by a shuffle, and it goes where the likelihood is
  highest against the class table, its own counts taken out of it. All of these words are placed against
  the same table, where their rarer neighbours stand in the classes of their buckets; the step is not
  repeated. Words seen less often, and words never seen, stay in their buckets.
* The class bigrams of the model are counted anew over the training texts with the classes of all words.
* Scoring needs each token's count and class. Those of the ``head`` most frequent words at most are broadcast
  (bound: a parameter; words of equal counts together or not at all); the other tokens are joined with the table of words by a shuffle, so no word is
  left out, and a text's classes are put together again from both.

Defined results: a null text scores as an empty one (one end token); a null doc_id is training; repeated
rows each give a row; an empty table gives no rows; without training text train_tokens is 0 and every
probability is that of an unseen token.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Scratch, fold, partitions, tidy
from quillspark.llm.textarrays import text_bytes

END = b"\n"  # no word holds white space
ADD = 0.1  # what smoothing adds to a count


def _count(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for b in text_bytes(batch.column(0)):
            found.update(b.lower().split())
            found[END] += 1
            if len(found) > most:
                yield out()
                found.clear()
    if found:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c) over all texts of a one-column table; END counts the texts."""
    return texts.mapInArrow(tidy(_count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


class Units(dict):
    """Word -> unit: its own number if clustered singly, else the number of its suffix bucket."""

    def __init__(self, singles: list[bytes], buckets: int):
        super().__init__((w, i) for i, w in enumerate(singles))
        self.first, self.buckets, self.memo = len(singles), buckets, 400_000

    def __missing__(self, word: bytes) -> int:
        unit = self.first + zlib.crc32(word[-2:]) % self.buckets
        if len(self) < self.memo:
            self[word] = unit
        return unit


def unit_bigrams(texts: DataFrame, singles: list[bytes], buckets: int, parts: int) -> DataFrame:
    """(prev, cur, n): per previous unit, packed int32 arrays of the following units and their counts.

    Unit len(singles) + buckets is the text boundary, before the first and after the last word.
    """
    m = len(singles) + buckets + 1

    def emit(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        prev, cur = codes // m, (codes % m).astype(np.int32)
        at = np.concatenate([np.flatnonzero(np.diff(prev, prepend=-1)), [len(prev)]])
        for lo in range(0, len(at) - 1, 2000):
            spans = list(zip(at[lo : lo + 2000], at[lo + 1 : lo + 2001], strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(prev[a]) for a, _ in spans], pa.int32()), pa.array([cur[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())],
                ["prev", "cur", "n"],
            )

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, n = np.concatenate([c for c, _ in held]), np.concatenate([x for _, x in held])
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(n, first)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held, size = Units(singles, buckets), [], 0
        look, end = units.__getitem__, m - 1
        ids: list[int] = [end]

        def count() -> None:
            nonlocal held, size, ids
            a = np.array(ids, np.int64)
            held.append(np.unique(a[:-1] * m + a[1:], return_counts=True))
            ids, size = [end], size + len(held[-1][0])
            if size > 6_000_000:
                held = [merged(held)]
                size = len(held[0][0])

        for batch in batches:
            for b in text_bytes(batch.column(0)):
                ids.extend(map(look, b.lower().split()))
                ids.append(end)
                if len(ids) > 2_000_000:
                    count()
        if len(ids) > 1:
            count()
        if held:
            yield from emit(*merged(held))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for p, c, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = held.setdefault(p, [])
                own.append((np.frombuffer(c, np.int32), np.frombuffer(n, np.int64)))
                if len(own) > 64:
                    held[p] = [merged(own)]
        for p, own in held.items():
            cur, n = merged(own)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([cur.astype(np.int32).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["prev", "cur", "n"])

    schema = "prev int, cur binary, n binary"
    return texts.mapInArrow(tidy(pairs), schema).repartition(parts, "prev").mapInArrow(tidy(total), schema)


def exchange(follows: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit (the last, the boundary, keeps class ``classes``) and the class bigram counts.

    follows[p, q] counts unit q after unit p. Each sweep takes every unit out of its class and puts it where
    the likelihood of the class bigrams is highest; sweeps go on until fewer than one unit in 500 moves. A
    move raises the likelihood, so they end.
    """
    m, c = len(follows), classes + 1
    before = np.ascontiguousarray(follows.T)
    label = np.arange(m) % classes
    label[m - 1] = classes
    table = np.zeros((c, c))
    for p in range(m):
        table[label[p]] += np.bincount(label, weights=follows[p], minlength=c)
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    own = follows.sum(axis=1, dtype=np.float64)
    order = [int(w) for w in np.argsort(-own[: m - 1], kind="stable") if own[w] > 0]
    span = np.arange(classes)
    moved = len(order)
    while moved and moved * 500 >= len(order):
        moved = 0
        for w in order:
            a, twice = label[w], float(follows[w, w])
            r = np.bincount(label, weights=follows[w], minlength=c)
            s = np.bincount(label, weights=before[w], minlength=c)
            r[a] -= twice
            s[a] -= twice
            table[a, :] -= r
            table[:, a] -= s
            table[a, a] -= twice
            rows_sum, cols_sum = table.sum(1) + s, table.sum(0) + r  # wherever w goes, its neighbours count it
            base = f(table)
            gain = (f(table[:classes] + r) - base[:classes]).sum(1) + (f(table[:, :classes] + s[:, None]) - base[:, :classes]).sum(0)
            corner = table[span, span]
            both, one, other = corner + r[:classes] + s[:classes] + twice, corner + r[:classes], corner + s[:classes]
            gain += f(both) - f(one) - f(other) + f(corner)
            out_n, in_n = r.sum() + twice, s.sum() + twice
            gain -= f(rows_sum[:classes] + out_n) - f(rows_sum[:classes]) + f(cols_sum[:classes] + in_n) - f(cols_sum[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                best = a
            table[best, :] += r
            table[:, best] += s
            table[best, best] += twice
            if best != a:
                label[w] = best
                moved += 1
    return label, table


class _Seen(dict):
    """Word -> its unit if clustered singly, else a number after the boundary's; ``classes`` has the class of each."""

    def __init__(self, singles: list[bytes], buckets: int, label: np.ndarray):
        super().__init__((w, i) for i, w in enumerate(singles))
        self.first, self.buckets, self.label = len(singles), buckets, label.tolist()
        self.words: list[bytes] = []
        self.classes = [*self.label[: self.first], self.label[-1]]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.classes)
        self.words.append(word)
        self.classes.append(self.label[self.first + zlib.crc32(word[-2:]) % self.buckets])
        return found


def tail_contexts(texts: DataFrame, singles: list[bytes], buckets: int, label: np.ndarray, most: int = 300_000) -> DataFrame:
    """(word, x): of each word that isn't clustered singly, packed int64 of n * (2 c + 1) + slot.

    Of the c classes with the boundary, slot k is a follower in class k, c + k a predecessor, 2 c itself.
    """
    c = int(label[-1]) + 1
    slots = 2 * c + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(singles)
        seen, ids, held = _Seen(singles, buckets, label), [end], []

        def count() -> None:
            nonlocal ids
            a, cls = np.array(ids, np.int64), np.array(seen.classes, np.int64)
            prev, cur = a[:-1], a[1:]
            same, right, left = prev == cur, prev > end, cur > end
            codes = np.concatenate([
                (prev * slots + np.where(same, 2 * c, cls[cur]))[right],
                (cur * slots + c + cls[prev])[left & ~same],
            ])
            held.append(np.unique(codes, return_counts=True))
            ids = [end]

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            codes, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            order = np.argsort(codes, kind="stable")
            word, packed = codes[order] // slots - end - 1, (n * slots + codes % slots)[order]
            at = np.searchsorted(word, np.arange(len(seen.words) + 1))
            for lo in range(0, len(seen.words), 10_000):
                some = at[lo : lo + 10_001]
                offsets = pa.py_buffer(((some - some[0]) * 8).astype(np.int32))
                x = pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, offsets, pa.py_buffer(packed[some[0] : some[-1]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(seen.words[lo : lo + 10_000], pa.binary()), x], ["word", "x"])
            seen = _Seen(singles, buckets, label)

        for batch in batches:
            for b in text_bytes(batch.column(0)):
                ids.extend(map(seen.__getitem__, b.lower().split()))
                ids.append(end)
                if len(ids) > 1_000_000 or len(seen.words) > most:
                    count()
                    if len(seen.words) > most or len(held) > 8:
                        yield from out()
        if len(ids) > 1:
            count()
        if held:
            yield from out()

    return texts.mapInArrow(tidy(run), "word binary, x binary")


def place(contexts: np.ndarray, now: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word by one exchange step against ``table``; contexts: a row of slots a word.

    now: the class in which each word's counts stand in the table. They are taken out before it is placed.
    """
    c = len(table)
    classes, rows, span = c - 1, np.arange(len(now)), np.arange(c - 1)
    r, s, twice = contexts[:, :c], contexts[:, c : 2 * c], contexts[:, 2 * c]
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    gain = np.zeros((len(now), classes))
    for n, other, side in ((r, s, table.T), (s, r, table)):
        w, j = np.nonzero(n)
        for lo in range(0, len(w), 20_000):
            i, k = w[lo : lo + 20_000], j[lo : lo + 20_000]
            amount = n[i, k]
            cell = side[k, :classes].astype(np.float64)
            own = k == now[i]
            cell[own] -= other[i[own], :classes]  # the word is that neighbour's neighbour on its other side
            cell[np.arange(len(i)), now[i]] -= amount + np.where(own, twice[i], 0.0)
            first = np.flatnonzero(np.diff(i, prepend=-1))
            gain[i[first]] += np.add.reduceat(f(cell + amount[:, None]) - f(cell), first, axis=0)
    corner = np.broadcast_to(table[span, span], gain.shape).copy()
    corner[rows, now] -= r[rows, now] + s[rows, now] + twice
    one, two = r[:, :classes], s[:, :classes]
    gain += f(corner + one + two + twice[:, None]) - f(corner + one) - f(corner + two) + f(corner)
    for total, n in ((table.sum(1), r.sum(1) + twice), (table.sum(0), s.sum(1) + twice)):
        margin = np.broadcast_to(total[:classes], gain.shape).copy()
        margin[rows, now] -= n
        gain -= f(margin + n[:, None]) - f(margin)
    best = gain.argmax(1)
    return np.where(gain[rows, best] > gain[rows, now] + 1e-9, best, now)


def placed_words(contexts: DataFrame, buckets: int, clustered: int, label: np.ndarray, table: np.ndarray, least: int, parts: int) -> DataFrame:
    """(word, b, c, cls): bucket, count and class of each word of contexts; no class if seen under ``least`` times."""
    slots = 2 * len(table) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: list[bytes], b: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            n = rows[:, : len(table)].sum(1) + rows[:, -1]
            kept = n >= least
            cls = np.zeros(len(n), np.int32)
            cls[kept] = place(rows[kept], label[clustered + b[kept]].astype(np.int64), table)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(b, pa.int32()), pa.array(n.astype(np.int64)), pa.array(cls, pa.int32(), mask=~kept)], ["word", "b", "c", "cls"])

        last = None  # the word that may go on in the next batch
        for batch in batches:
            words, b, packed = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            if not words:
                continue
            first = np.array([i for i, w in enumerate(words) if not i or w != words[i - 1]])
            run_of = np.searchsorted(first, np.arange(len(words)), side="right") - 1
            x = np.frombuffer(b"".join(packed), np.int64)
            owner = np.repeat(run_of, np.fromiter((len(p) // 8 for p in packed), np.int64, len(packed)))
            rows = np.bincount(owner * slots + x % slots, weights=x // slots, minlength=len(first) * slots).reshape(len(first), slots)
            own, b = [words[i] for i in first], b[first]
            if last is not None and last[0] == own[0]:
                rows[0] += last[2][0]
            elif last is not None:
                yield out([last[0]], last[1], last[2])
            if len(own) > 1:
                yield out(own[:-1], b[:-1], rows[:-1])
            last = own[-1], b[-1:].copy(), rows[-1:].copy()
        if last is not None:
            yield out([last[0]], last[1], last[2])

    rows = contexts.select("word", (F.crc32(F.substring("word", -2, 2)) % buckets).cast("int").alias("b"), "x")
    return rows.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(tidy(run), "word binary, b int, c bigint, cls int")


def fit(scratch: Scratch, training: DataFrame, clustered: int = 4096, buckets: int = 256, classes: int = 48, head: int = 262_144, least: int = 2) -> tuple[dict, DataFrame]:
    """(model of bounded size, the table of all words that aren't clustered singly) of a one-column table of training texts."""
    spark = scratch.spark
    counts = scratch.table(word_counts(training), "counts")
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, kinds = int(whole[0] or 0), int(whole[1])
    # how many words have each count: a row for each count, of which there are few (they sum up to the tokens);
    # with it the most frequent words are a filter, and no task sorts more than those
    of_count = counts.groupBy("c").agg(F.count("*").alias("k")).toArrow().sort_by([("c", "descending")])
    each, upto = of_count["c"].to_numpy(), np.cumsum(of_count["k"].to_numpy())
    enough = int(np.searchsorted(upto, min(clustered, head) + 1))  # and the end
    above = F.col("c") >= int(each[min(enough, len(each) - 1)]) if len(each) else F.lit(False)
    top = counts.where(above & (F.col("word") != F.lit(END))).orderBy(F.desc("c"), F.asc("word")).limit(min(clustered, head)).toArrow()
    singles, c = top["word"].to_pylist(), top["c"].to_pylist()
    end_n = counts.where(F.col("word") == F.lit(END)).first()
    m = len(singles) + buckets + 1

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows = np.zeros((m, m), np.float32)
        for batch in batches:
            for p, q, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                follows[p, np.frombuffer(q, np.int32)] += np.frombuffer(n, np.int64)
        label, table = exchange(follows, classes)
        yield pa.RecordBatch.from_arrays([pa.array([label.astype(np.int32).tobytes()], pa.binary()), pa.array([table.tobytes()], pa.binary())], ["label", "table"])

    bigrams = scratch.table(unit_bigrams(training, singles, buckets, partitions(spark)), "bigrams")
    found = bigrams.coalesce(1).mapInArrow(cluster, "label binary, table binary").first()
    if found:
        label, table = np.frombuffer(found[0], np.int32), np.frombuffer(found[1]).reshape(classes + 1, classes + 1)
    else:  # no training text
        label, table = exchange(np.zeros((m, m), np.float32), classes)
    scratch.drop("bigrams", "counts")
    tail = scratch.table(placed_words(tail_contexts(training, singles, buckets, label), buckets, len(singles), label, table, least, partitions(spark)), "tail")

    in_bucket, kinds_in = np.zeros(buckets), np.zeros(buckets)
    for r in tail.where("cls IS NULL").groupBy("b").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        in_bucket[r["b"]], kinds_in[r["b"]] = r["n"], r["v"]
    k = len(singles)
    class_n = np.bincount(label[:-1], weights=np.concatenate([c, in_bucket]), minlength=classes)
    class_units = np.bincount(label[:-1], minlength=classes).astype(np.float64)
    for r in tail.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["cls"]] += r["n"]
        class_units[r["cls"]] += r["v"]
    of_class = -np.log10(class_n + ADD * class_units)  # of a word with a class of its own, without its own count
    # of a word in its bucket, without its own count
    of_bucket = np.log10(in_bucket + ADD) + of_class[label[k:-1]] - np.log10(in_bucket + ADD * (kinds_in + 1))
    fitting = int(np.searchsorted(upto, head, side="right"))  # words of equal counts are broadcast together or not
    rest = tail.where(F.col("c") >= int(each[fitting - 1])).orderBy(F.desc("c"), F.asc("word")).toArrow() if fitting else tail.limit(0).toArrow()
    own = rest["cls"].to_numpy() if rest.num_rows else np.zeros(0)  # nan: none
    n, b = np.concatenate([c, rest["c"].to_numpy()]), np.array(rest["b"].to_pylist(), np.int64)
    single = np.isnan(own.astype(np.float64))
    classes_of = np.concatenate([label[:k], np.where(single, label[k + b], np.nan_to_num(own.astype(np.float64)))]).astype(np.int64)
    log_c = np.log10(n + ADD)
    word_log = log_c + np.concatenate([of_class[classes_of[:k]], np.where(single, of_bucket[b], of_class[classes_of[k:]])])
    model = {
        "words": singles + rest["word"].to_pylist(), "class_of": classes_of, "word_log": word_log, "count_log": log_c, "edge": classes,
        "buckets": buckets, "bucket_class": label[k:-1], "of_class": of_class, "of_bucket": of_bucket,
        "tokens": tokens, "kinds": kinds, "log_base": math.log10(tokens + ADD * (kinds + 1)), "end": float(end_n["c"]) if end_n else 0.0,
    }
    return model, tail


def _code(edge: int) -> np.dtype:
    """The type of a class in a packed row of classes; its largest value stands for a class still to be joined."""
    return np.dtype(np.uint8 if edge < 255 else np.uint16)


def _parts(batches: Iterator[pa.RecordBatch], bc) -> Iterator[pa.RecordBatch]:
    """Of each document, what the broadcast part of the model tells, and a row for each of its other tokens.

    Input columns: doc_id, held_out, text. A document's row has a null word.
    """
    model = bc.value
    if "index" not in model:  # once in a worker's life
        model["index"] = {w: i for i, w in enumerate(model["words"])}
        # position -1 reaches what is put at the end
        for name, kind, none in (("class_of", _code(model["edge"]), np.iinfo(_code(model["edge"])).max), ("word_log", np.float64, 0.0), ("count_log", np.float64, 0.0)):
            model[name] = np.concatenate([model[name], [none]]).astype(kind)
    look, class_of, word_log, count_log = model["index"].get, model["class_of"], model["word_log"], model["count_log"]
    edge = np.array([model["edge"]], class_of.dtype)
    end_log = math.log10(model["end"] + ADD) - model["log_base"]
    task, row = TaskContext.get().partitionId(), 0
    names = ["rid", "doc_id", "held_out", "word", "n", "n_known", "log_counts", "score", "classes"]
    for batch in batches:
        ids, held, texts = batch.column(0), batch.column(1), text_bytes(batch.column(2))
        rids, n_tokens, n_known, log_counts, scores, sequences, t_rid, t_many, t_word, t_at = [], [], [], [], [], [], [], [], [], []
        for text in texts:
            rid = (task << 33) | row
            row += 1
            tokens = text.lower().split()
            at = np.fromiter(map(look, tokens, repeat(-1)), np.int64, len(tokens))
            rest = np.flatnonzero(at < 0).tolist()
            rids.append(rid)
            n_tokens.append(len(tokens) + 1)
            n_known.append(len(tokens) - len(rest) + (model["end"] > 0))
            log_counts.append(float(count_log[at].sum()) + end_log + model["log_base"])
            scores.append(float(word_log[at].sum()))
            sequences.append(np.concatenate([edge, class_of[at], edge]).tobytes())
            t_rid.append(rid)
            t_word += [tokens[i] for i in rest]
            t_at += rest
            t_many.append(len(rest))
        n = len(rids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rids, pa.int64()), ids.cast(pa.int64()), held, pa.nulls(n, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_counts, pa.float64()), pa.array(scores, pa.float64()), pa.array(sequences, pa.binary())], names
        )
        m = len(t_word)
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(t_rid, t_many), pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(t_word, pa.binary()), pa.array(np.array(t_at, np.int64) + 1), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.binary())], names
            )


def score(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out: Column | None = None, **parameters) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    held_out: which rows the model doesn't learn from (default: crc32 of doc_id as text is divisible by 10).
    base_score: the add-0.1 unigram's log10 probability; score: the class model's; perplexity: of a token
    under the class model.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "brown")
    held = fold(F.col(doc_id), 10) == 0 if held_out is None else held_out
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    model, tail = fit(scratch, docs.where(~F.col("held_out")).select("text"), **parameters)
    bc = spark.sparkContext.broadcast(model)
    edge, buckets, log_base, tokens = model["edge"], model["buckets"], model["log_base"], model["tokens"]
    code, c = _code(edge), edge + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parts(batches, bc)

    schema = "rid bigint, doc_id bigint, held_out boolean, word binary, n bigint, n_known bigint, log_counts double, score double, classes binary"
    parts = scratch.table(docs.mapInArrow(tidy(run), schema), "parts")
    rest = parts.where(F.col("word").isNotNull()).select("rid", "word", F.col("n").alias("at")).join(tail.drop("b"), "word", "left")
    listed = lambda x, i: F.get(F.array(*(F.lit(v) for v in x.tolist())), i)
    b = (F.crc32(F.substring("word", -2, 2)) % buckets).cast("int")
    own_log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))
    joined = rest.select(
        "rid", (F.col("at") * 65536 + F.coalesce("cls", listed(model["bucket_class"], b))).alias("mark"), (F.coalesce(listed(model["of_class"], F.col("cls")), listed(model["of_bucket"], b)) + own_log).alias("s"), own_log.alias("l"), F.col("c").isNotNull().cast("long").alias("known")
    )
    lists = joined.groupBy("rid").agg(F.collect_list("mark").alias("marks"), F.sum("s").alias("s"), F.sum("l").alias("l"), F.sum("known").alias("known"))
    zero = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    whole = parts.where(F.col("word").isNull()).join(lists, "rid", "left").select("doc_id", "held_out", "n", zero("n_known", "known"), zero("log_counts", "l"), zero("score", "s"), "classes", "marks")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, marks in zip(batch.column(6).to_pylist(), batch.column(7), strict=True):
                own = np.frombuffer(packed, code).copy()
                if marks.is_valid:
                    x = marks.values.to_numpy()
                    own[x >> 16] = x & 65535
                out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.binary())], batch.schema.names[:7])

    kept = "doc_id bigint, held_out boolean, n bigint, n_known bigint, log_counts double, score double, classes binary"
    sequences = scratch.table(whole.mapInArrow(tidy(filled), kept), "sequences")
    scratch.drop("parts", "tail")

    def steps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The class bigrams of a batch, as codes, and where each document's begin; the last of each but the last document is none."""
        packed = column.to_pylist()
        a = np.frombuffer(b"".join(packed), code).astype(np.int64)
        return a[:-1] * c + a[1:], np.cumsum([0, *(len(p) // code.itemsize for p in packed[:-1])])

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c * c, np.int64)
        for batch in batches:
            if batch.num_rows:
                codes, begin = steps(batch.column(0))
                total += np.bincount(np.delete(codes, begin[1:] - 1), minlength=c * c)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], ["cell", "n"])

    table = np.zeros(c * c)
    for r in sequences.where("NOT held_out").select("classes").mapInArrow(tidy(bigrams), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"]] = r["n"]
    table = table.reshape(c, c)
    to = (table.sum(0) + 0.5) / (table.sum() + 0.5 * c)
    log_step = np.log10((table + 10.0 * to) / (table.sum(1, keepdims=True) + 10.0)).ravel()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, begin = steps(batch.column(6))
                log = log_step[codes]
                log[begin[1:] - 1] = 0.0
                total = pa.array(batch.column(5).to_numpy() + np.add.reduceat(log, begin))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], total], batch.schema.names[:6])

    out = sequences.mapInArrow(tidy(scored), kept.removesuffix(", classes binary"))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n") * F.lit(log_base)).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n")).alias("perplexity"),
    )
