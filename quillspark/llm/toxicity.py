"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters through two channels. The word itself: its log-odds, if known, and then a trained vector (of
its hash, modulo a table's size). Its characters: the mean of the trained vectors of its trigrams, and the log-odds
of its n-grams of 3 to 6 bytes, word ends included (largest and mean per order). A gated recurrent network of
a few units reads windows of ``window`` words in both directions, attention pools its states, and a text
scores as its highest window; windows start every ``window / 2`` words and cover whole texts. A long text is
read in parts that hold the same windows.

The model is fitted on at most about ``sample`` labelled training rows of each class (texts of at most
``longest`` bytes, or of the least size there is if a class has only longer ones), drawn by a hash of the id:
a documented bound. Log-odds count the sample's documents. While the network is trained, a document's
log-odds come from the other folds of the sample, so that it can't trust what the document itself has told
them. A toxic document teaches through its most toxic window, a clean one through its most toxic and random
ones, chosen anew in each round. labels, lang, source and ids are never inputs of a score.

Defined results: null and wordless texts score 0; without labels of both classes every score is 0; several
labels of an id count as 1 if any is 1; of several texts of an id the least in byte order teaches; a null id
is training; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.shared import bounded_batches, fold, opened, release, shipped, tidy
from quillspark.llm.textarrays import chunks, span_hashes, text_bytes, word_spans

GRAMS = (3, 4, 5, 6)  # bytes of the n-grams with log-odds; the first order also has trained vectors
EVIDENCE = 2 + 2 * len(GRAMS)
ROWS, SIZE = 1 << 14, 6  # of a table of trained vectors
INPUTS = EVIDENCE + 2 * SIZE
FOLDS = 5
PART = 1_000_000  # bytes of text at a time


class Lookup:
    """64-bit hash -> log-odds (0 if unknown): open addressing in a table of at most a quarter full, no entry lost."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        size = 1 << max(10, (4 * len(hashes)).bit_length())
        self.mask, self.probes = np.uint64(size - 1), 0
        self.hash, self.value = np.zeros(size, np.uint64), np.zeros(size, np.float32)
        left = np.flatnonzero(hashes != 0)  # 0 marks a free slot
        while len(left):
            at = (hashes[left] + np.uint64(self.probes)) & self.mask
            free = np.flatnonzero(self.hash[at] == 0)
            slot, first = np.unique(at[free], return_index=True)
            own = left[free[first]]
            self.hash[slot], self.value[slot] = hashes[own], values[own]
            left = np.delete(left, free[first])
            self.probes += 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        found = self.hash[at]
        out = np.where(found == hashes, self.value[at], np.float32(0))
        left = np.flatnonzero((found != hashes) & (found != 0))
        for k in range(1, self.probes):
            at = (hashes[left] + np.uint64(k)) & self.mask
            found = self.hash[at]
            hit = found == hashes[left]
            out[left[hit]] = self.value[at[hit]]
            left = left[~hit & (found != 0)]
        return out


class Words:
    """The distinct words of some texts, with their hashes, and which of them each token is."""

    def __init__(self, texts: list[bytes]):
        buffer, starts, ends, self.first = word_spans(texts)
        hashes = span_hashes(buffer, starts, ends)
        self.hash, at, self.token = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = ends[at] - starts[at]
        self.begin = np.cumsum(sizes + 2) - (sizes + 2)
        self.size = sizes + 2
        total = int(self.size.sum())
        self.buffer = np.empty(total, np.uint8)
        inside = np.ones(total, bool)
        inside[self.begin] = inside[self.begin + self.size - 1] = False
        self.buffer[self.begin], self.buffer[self.begin + self.size - 1] = ord("<"), ord(">")
        self.buffer[inside] = buffer[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[at], sizes)]

    def grams(self, n: int, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the n-grams inside the words from a to b."""
        size = self.size[a:b]
        base = int(self.begin[a]) if len(size) else 0
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        pos = np.arange(max(0, len(owner) - n + 1))
        pos = pos[owner[pos] == owner[pos + n - 1]]
        return base + pos, span_hashes(self.buffer[base : base + len(owner)], pos, pos + n)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the tables of trained vectors: each word's, its trigrams' in turn, and where a word's begin."""
        pos, hashes = self.grams(GRAMS[0])
        limits = np.searchsorted(pos, np.concatenate([self.begin, [len(self.buffer)]]))
        return (self.hash >> np.uint64(20)) % np.uint64(ROWS), (hashes >> np.uint64(20)) % np.uint64(ROWS), limits

    def evidence(self, word: Lookup, gram: Lookup) -> np.ndarray:
        out = np.zeros((len(self.hash), EVIDENCE), np.float32)
        out[:, 0] = word(self.hash) / 4
        out[:, 1] = out[:, 0] != 0
        for a in range(0, len(self.hash), 20_000):
            begin, size = self.begin[a : a + 20_000] - self.begin[a], self.size[a : a + 20_000]
            for k, n in enumerate(GRAMS):
                value = np.zeros(int(size.sum()), np.float32)
                pos, hashes = self.grams(n, a, a + 20_000)
                value[pos - self.begin[a]] = gram(hashes)
                out[a : a + 20_000, 2 + 2 * k] = np.maximum.reduceat(value, begin) / 4
                out[a : a + 20_000, 3 + 2 * k] = np.add.reduceat(value, begin) / size
        return out


def log_odds(hashes: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, least: int) -> Lookup:
    """Smoothed log-odds of each hash's document counts in toxic against clean documents, shrunk where rare."""
    value = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    value *= (toxic + clean) / (toxic + clean + 4.0)
    keep = (toxic + clean >= least) & (np.abs(value) > 0.7)
    return Lookup(hashes[keep], value[keep].astype(np.float32))


def evidence_of(found: Words, labels: np.ndarray, fold: np.ndarray) -> Iterator[tuple[Lookup, Lookup]]:
    """Log-odds of the words and of their n-grams, without each fold's documents in turn and then from all."""
    hashes, ids, limits = [], [], []
    for n in GRAMS:  # one order at a time keeps the driver small
        pos, own = found.grams(n)
        limits.append(np.searchsorted(pos, np.concatenate([found.begin, [len(found.buffer)]])))
        own, at = np.unique(own, return_inverse=True)
        hashes.append(own)
        ids.append(at.astype(np.int32))
    kinds = np.uint16 if len(labels) < 1 << 16 else np.uint32
    words, grams = np.zeros((FOLDS, 2, len(found.hash)), kinds), [np.zeros((FOLDS, 2, len(h)), kinds) for h in hashes]
    for i, (y, f) in enumerate(zip(labels, fold, strict=True)):
        own = np.unique(found.token[found.first[i] : found.first[i + 1]])
        words[f, y, own] += 1
        for count, at, lim in zip(grams, ids, limits, strict=True):
            size = lim[own + 1] - lim[own]
            mine = at[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lim[own], size)]
            count[f, y, np.unique(mine)] += 1
    hashes, grams = np.concatenate(hashes), np.concatenate(grams, axis=2)
    of = np.array([[((fold == f) & (labels == y)).sum() for y in (0, 1)] for f in range(FOLDS)])
    for left_out in (*range(FOLDS), None):
        kept = [f for f in range(FOLDS) if f != left_out]
        n, w, g = of[kept].sum(axis=0), words[kept].sum(axis=0, dtype=np.float32), grams[kept].sum(axis=0, dtype=np.float32)
        yield log_odds(found.hash, w[1], w[0], n[1], n[0], 3), log_odds(hashes, g[1], g[0], n[1], n[0], 4)


def windows(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, text) of every window of every text."""
    n = np.diff(first)
    step = window // 2
    count = np.where(n > 0, np.maximum(0, -(-(n - window) // step)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][text] + k * step
    return begin, np.minimum(window, first[1:][text] - begin), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Vectors:
    """Trained vectors of words and of their trigrams, in tables of a fixed size."""

    def __init__(self) -> None:
        self.word, self.gram = np.zeros((ROWS, SIZE), np.float32), np.zeros((ROWS, SIZE), np.float32)
        self._seen = np.zeros((ROWS, 1), np.float32), np.zeros((ROWS, 1), np.float32)

    def __call__(self, evidence: np.ndarray, word: np.ndarray, gram: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The inputs of some words; gram: their trigrams' rows in turn, limits: where a word's begin and the end.

        A word without log-odds has no vector of its own: it's too rare to learn one that isn't its documents'.
        """
        out = np.zeros((len(word), INPUTS), np.float32)
        out[:, :EVIDENCE] = evidence
        out[:, EVIDENCE:-SIZE] = self.word[word] * evidence[:, 1:2]
        if len(word):
            out[:, -SIZE:] = np.add.reduceat(self.gram[gram], limits[:-1], axis=0) / np.diff(limits)[:, None]
        return out

    def learn(self, g: np.ndarray, evidence: np.ndarray, word: np.ndarray, gram: np.ndarray, limits: np.ndarray, rate: float) -> None:
        """A step down the gradient g of the inputs of those words, each row at a rate that falls as it learns."""
        size = np.diff(limits)
        of_words, of_grams = g[:, EVIDENCE:-SIZE] * evidence[:, 1:2], np.repeat(g[:, -SIZE:] / size[:, None], size, axis=0)
        for table, seen, rows, own in ((self.word, self._seen[0], word, of_words), (self.gram, self._seen[1], gram, of_grams)):
            used, at = np.unique(rows, return_inverse=True)
            total = np.zeros((len(used), SIZE), np.float32)
            np.add.at(total, at, own)
            seen[used] += (total * total).mean(axis=1, keepdims=True)
            table[used] -= rate * total / (np.sqrt(seen[used]) + 1e-6)


class Network:
    """Bidirectional gated recurrent network with attention pooling and its gradient."""

    def __init__(self, units: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.units = units
        self.p = {}
        for way in "fb":
            self.p[f"w{way}"] = (draw.standard_normal((INPUTS, 3 * units)) * 0.4).astype(np.float32)
            self.p[f"u{way}"] = (draw.standard_normal((units, 3 * units)) * 0.3).astype(np.float32)
            self.p[f"c{way}"] = np.zeros(3 * units, np.float32)
        self.p["attend"] = (draw.standard_normal(2 * units) * 0.3).astype(np.float32)
        self.p["out"] = (draw.standard_normal(2 * units) * 0.3).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)
        self.vectors = Vectors()

    def _walk(self, way: str, projected: np.ndarray, token: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (steps, windows, units); projected: the input part of each distinct word."""
        n, steps = token.shape
        h = np.zeros((n, self.units), np.float32)
        u, k = self.p[f"u{way}"], self.units
        states = np.zeros((steps, n, k), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, hu = projected[token[:, t]], h @ u
            zr = _sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
            new = np.tanh(x[:, 2 * k :] + zr[:, k:] * hu[:, 2 * k :])
            m = mask[:, t : t + 1]
            if keep is not None:
                keep.append((t, h, zr[:, :k], zr[:, k:], new, hu[:, 2 * k :], m))
            h = h + m * (1 - zr[:, :k]) * (new - h)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, token: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logit of each window. x: features of distinct words; token: (windows, steps) of them."""
        states = []
        for way in "fb":
            keep: list | None = None if tape is None else []
            states.append(self._walk(way, x @ self.p[f"w{way}"] + self.p[f"c{way}"], token, mask, keep))
            if tape is not None:
                tape[way] = keep
        s = np.concatenate(states, axis=2)
        e = s @ self.p["attend"]
        e = np.where(mask.T > 0, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, s)
        if tape is not None:
            tape |= {"s": s, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, x: np.ndarray, token: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss, by each parameter and, as ``x``, by the features of the distinct words."""
        tape: dict = {}
        d = ((_sigmoid(self.forward(x, token, mask, tape)) - y) / len(y)).astype(np.float32)
        s, a, k = tape["s"], tape["a"], self.units
        g = {"out": tape["pooled"].T @ d, "bias": np.array([d.sum()])}
        dp = d[:, None] * self.p["out"]
        da = np.einsum("tnk,nk->tn", s, dp)
        de = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tn,tnk->k", de, s)
        ds = a[:, :, None] * dp + de[:, :, None] * self.p["attend"]
        gx, inputs = np.zeros_like(x), x[token.ravel()]
        for i, way in enumerate("fb"):
            u, w = self.p[f"u{way}"], self.p[f"w{way}"]
            gu, back, into = np.zeros_like(u), np.zeros((len(y), k), x.dtype), np.zeros((*token.shape, 3 * k), x.dtype)
            for t, h, z, r, new, hn, m in reversed(tape[way]):
                dh = ds[t, :, i * k : (i + 1) * k] + back
                dz = m * dh * (h - new) * z * (1 - z)
                dn = m * dh * (1 - z) * (1 - new * new)
                dr = dn * hn * r * (1 - r)
                into[:, t] = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                back = dh * (1 - m * (1 - z)) + du @ u.T
                gu += h.T @ du
            into = into.reshape(-1, 3 * k)
            np.add.at(gx, token.ravel(), into @ w.T)
            g |= {f"u{way}": gu, f"w{way}": inputs.T @ into, f"c{way}": into.sum(axis=0)}
        return g | {"x": gx}


def _index(begin: np.ndarray, size: np.ndarray, token: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    at = begin[:, None] + np.minimum(np.arange(window), size[:, None] - 1)
    return token[at], (np.arange(window) < size[:, None]).astype(np.float32)


def parts(text: bytes, window: int, limit: int = PART) -> list[bytes]:
    """A text as parts of about limit bytes whose windows are those of the text."""
    if len(text) <= limit:
        return [text]
    _, starts, ends, _ = word_spans([text])
    step = window // 2
    each = max(1, int(len(starts) * limit / len(text)) // step) * step
    return [text[starts[a] : ends[min(len(ends), a + each + window - step) - 1]] for a in range(0, max(1, len(starts) - (window - step)), each)] if len(starts) else [b""]


class Model:
    def __init__(self, word: Lookup, gram: Lookup, network: Network, window: int):
        self.word, self.gram, self.network, self.window = word, gram, network, window

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text) of every window."""
        found = Words(texts)
        begin, size, text = windows(found.first, self.window)
        x = self.network.vectors(found.evidence(self.word, self.gram), *found.rows())
        out = np.zeros(len(begin), np.float32)
        for lo in range(0, len(begin), 4096):
            token, mask = _index(begin[lo : lo + 4096], size[lo : lo + 4096], found.token, self.window)
            out[lo : lo + 4096] = self.network.forward(x, token, mask)
        return out, text

    def score(self, texts: list[bytes]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        whole = [parts(t, self.window) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in whole])
        flat = [p for own in whole for p in own]
        for i, j in chunks(flat, PART):
            logit, text = self.windows(flat[i:j])
            np.maximum.at(best, owner[i:j][text], logit)
        return 1 / (1 + np.exp(-np.clip(best, -700, 700))) * (best > -np.inf)


def train(texts: list[bytes], labels: np.ndarray, window: int, units: int, rounds: int = 3, steps: int = 150, batch: int = 192, seed: int = 1) -> Model | None:
    """A model of labelled texts, or None without both classes."""
    if not len(labels) or labels.min() == labels.max():
        return None
    found, draw, network = Words(texts), np.random.default_rng(seed), Network(units, seed)
    fold = np.empty(len(labels), np.int64)
    for y in (0, 1):  # as many of each class in each fold as can be
        own = draw.permutation(np.flatnonzero(labels == y))
        fold[own] = np.arange(len(own)) % FOLDS
    # a token is its word with the evidence of its document's fold: the pairs that occur, and which each token is
    n = len(found.hash)
    met, token_of = np.unique(found.token + np.repeat(fold, np.diff(found.first)) * n, return_inverse=True)
    word_of, fold_of = met % max(n, 1), met // max(n, 1)
    x = np.zeros((len(met), EVIDENCE), np.float32)
    for f, (word, gram) in enumerate(evidence_of(found, labels, fold)):
        if f < FOLDS:
            x[fold_of == f] = found.evidence(word, gram)[word_of[fold_of == f]]
    model = Model(word, gram, network, window)  # the last lookups are of all documents
    word_row, gram_row, limits = found.rows()
    begin, size, text = windows(found.first, window)
    if not len(begin):
        return None

    def inputs(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Features of the distinct tokens, which of them each is, and what their vectors are learned by."""
        used, at = np.unique(token, return_inverse=True)
        own = word_of[used]
        many = limits[own + 1] - limits[own]
        ends = np.concatenate([[0], np.cumsum(many)])
        places = x[used], word_row[own], gram_row[np.arange(ends[-1]) - np.repeat(ends[:-1], many) + np.repeat(limits[own], many)], ends
        return network.vectors(*places), at.reshape(token.shape), places

    # at first the window with the largest evidence stands for its document
    evidence = np.concatenate([[0.0], np.cumsum((x.max(axis=1))[token_of])])
    logit = evidence[begin + size] - evidence[begin]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    done = 0
    for k in range(rounds):
        order = np.lexsort((-logit, text))
        top = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
        positive, negative = top[labels[text[top]] == 1], top[labels[text[top]] == 0]
        clean = np.flatnonzero(labels[text] == 0)
        for _ in range(steps if len(positive) and len(negative) else 0):
            third = batch // 3
            rows = np.concatenate([draw.choice(positive, third), draw.choice(negative, third), draw.choice(clean, third)])
            token, mask = _index(begin[rows], size[rows], token_of, window)
            own, token, places = inputs(token)
            y = (labels[text[rows]] == 1).astype(np.float32)
            done += 1
            g = network.gradient(own, token, mask, y)
            network.vectors.learn(g.pop("x"), *places, rate=0.003)
            for name, step in g.items():
                m, v = moment[name]
                m += 0.1 * (step - m)
                v += 0.001 * (step * step - v)
                network.p[name] -= (0.02 * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)).astype(np.float32)
        if k + 1 < rounds:
            for lo in range(0, len(begin), 4096):
                token, mask = _index(begin[lo : lo + 4096], size[lo : lo + 4096], token_of, window)
                own, token, _ = inputs(token)
                logit[lo : lo + 4096] = network.forward(own, token, mask)
    return model


def classify(
    documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", held_out: Column | None = None, rows: bool = False,
    threshold: float = 0.3, window: int = 24, units: int = 8, sample: int = 1500, longest: int = 20_000,
) -> DataFrame:
    """doc_id, held_out, score, predicted; with rows also ``row``, a struct of every column of documents.

    held_out: rows the model doesn't learn from (default: crc32 of doc_id as text mod 4 is 2).
    """
    bounded_batches(documents.sparkSession)
    spark = documents.sparkSession
    held = fold(F.col(doc_id), 4) == 2 if held_out is None else held_out
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("i"), (F.col(label) > 0).cast("int").alias("y"))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    training = documents.where(~held & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("i"), F.octet_length(text).alias("n"), F.col(text).alias("t"))
    sizes = known.join(training.groupBy("i").agg(F.min("n").alias("n")), "i")
    limit = sizes.groupBy("y").agg(F.greatest(F.lit(longest), F.min("n")).alias("most"))  # two rows
    sizes = sizes.join(F.broadcast(limit), "y").where("n <= most")
    share = sizes.groupBy("y").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("p"))  # two rows
    drawn = sizes.join(F.broadcast(share), "y").where(F.pmod(F.xxhash64("i", F.lit(6)), F.lit(1 << 30)) < F.col("p") * F.lit(1 << 30)).select("i", "y", "most")
    drawn = spark.createDataFrame([tuple(r) for r in drawn.collect()], "i bigint, y int, most int")  # about 2 * sample rows
    fitted = training.join(F.broadcast(drawn), "i").where("n <= most").groupBy("i", "y").agg(F.min("t").alias("t"))  # a text of each id
    found = fitted.select("t", "y").toArrow()
    pairs = sorted(set(zip(text_bytes(found["t"].combine_chunks()), found["y"].to_pylist(), strict=True)))
    bc = shipped(spark, train([t for t, _ in pairs], np.array([y for _, y in pairs], np.int64), window, units))
    del found, pairs
    release()

    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(bc)
        for batch in batches:
            texts = text_bytes(batch.column(2).field(place) if rows else batch.column(2))
            score = model.score(texts) if model is not None else np.zeros(len(texts))
            kept = batch.num_columns if rows else 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names[:kept], "score", "predicted"])

    body = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row") if rows else F.col(text).alias("text")
    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), body)
    kept = StructType([*(given if rows else given.drop("text")).schema.fields]).add("score", "double").add("predicted", "integer")
    return given.mapInArrow(tidy(run), kept)
