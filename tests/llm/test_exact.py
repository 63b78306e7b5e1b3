"""Operators against brute force on small tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.conftest import make, words
from quillspark.llm import brown, cover_tree, jaccard_join, kd_shards, langid, licenses, lz_fingerprint, mixing, packing, textarrays, toxicity
from quillspark.llm.components import components
from quillspark.llm.shared import Scratch, numbered


def test_word_spans_split_as_bytes_split():
    texts = [b"A b\tC", b"", b" \n", "é x".encode()]
    buffer, starts, ends, first = textarrays.word_spans(texts)
    got = [[bytes(buffer[s:e]) for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(4)]
    assert got == [t.lower().split() for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab \n", max_size=40), min_size=1, max_size=6))
def test_shingle_hashes_match_sets(texts):
    raw = [t.encode() for t in texts]
    buffer, starts, ends, first = textarrays.word_spans(raw)
    hashes, limits = textarrays.shingles(textarrays.span_hashes(buffer, starts, ends), first, 3)
    seen: dict = {}
    for i, t in enumerate(raw):
        w = t.split()
        own = [tuple(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else []
        assert len(own) == limits[i + 1] - limits[i]
        for g, h in zip(own, hashes[limits[i] : limits[i + 1]].tolist(), strict=True):
            assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 9), (9, 5), (1, 1000), (50, 1)]
    found = dict(map(tuple, components(Scratch(spark, "t"), spark.createDataFrame(links, "u bigint, v bigint"), "t").collect()))
    assert found == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5, 9: 5, 1: 1, 1000: 1, 50: 1}


def test_numbered_is_gapless(spark):
    df = spark.range(1000).selectExpr("id % 7 as a", "id")
    got = [(r["n"], r["a"], r["id"]) for r in numbered(Scratch(spark, "t"), df, ["a", "id"], "x", "n").orderBy("n").collect()]
    assert [g[0] for g in got] == list(range(1000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def brute_components(docs: dict, k: int = 5) -> dict:
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()) for i, w in ((i, (t or "").encode().lower().split()) for i, t in docs.items())}
    root = {i: i for i in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in docs}


def test_jaccard_components(spark):
    import random

    r = random.Random(5)
    passage = words(900, 60)
    docs = {}
    for g in range(6):
        base = words(g, 90).split()
        for c in range(8):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                own[r.randrange(len(own))] = f"edit{g}{c}"
            docs[len(docs) * 3 + 2] = " ".join(own)
    for i in range(10):
        docs[500 + i] = words(100 + i, 30) + " " + passage
    hub = words(77, 100).split()  # a chain: each differs a little from the one before
    for i in range(12):
        hub[i * 8] = f"chain{i}"
        docs[700 + i] = " ".join(hub)
    df = make(spark, [(i, t, "en", "s") for i, t in docs.items()])
    want = brute_components(docs)
    for crowd in (1 << 20, 9):  # 9: the shared passage's shingles are dealt by their holders
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(df, crowd=crowd).collect()}
        assert got == want


def test_a_shingle_of_all_documents_is_dealt_by_its_holders(spark):
    """A line that every document holds: its entries are the same, but no task takes all its holders."""
    line = words(901, 12)
    docs = {i: f"{words(i % 150, 25)} {line} {words(1000 + i % 150, 25)}" for i in range(400)}
    df = make(spark, [(i, t, "en", "s") for i, t in docs.items()])
    found = {}
    for crowd in (1 << 20, 40):
        scratch = Scratch(spark, "t")
        rows = jaccard_join.entries(scratch, df.select("text"), 5, 6, 150, crowd).groupBy("entry", "holders", "weight").agg(F.collect_set("node").alias("n")).collect()
        # an entry's shingles may lie in several fragments: weights of the same holders are summed
        total = Counter()
        for r in rows:
            assert len(r["n"]) == r["holders"]
            total[frozenset(r["n"])] += r["weight"]
        found[crowd] = total
    assert found[1 << 20] == found[40] and max(map(len, found[40])) == 150
    sizes = spark.read.parquet(f"{scratch.base}/shares").where(F.col("kind") == jaccard_join.MEMBER).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) >= 150
    per_share = [len(np.frombuffer(r["nodes"], np.int64)) for r in spark.read.parquet(f"{scratch.base}/fragments").where(F.col("kind") == jaccard_join.CROWDED).collect()]
    assert max(per_share) <= 0.5 * sum(per_share)


def test_cover_tree_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows, i = [], 0
    for b in range(40):
        for _ in range(b % 5):
            rows.append((i, (base[b] + rng.standard_normal(16) * 0.18).tolist(), b % 3))
            i += 1
    rows += [(900, base[0].tolist(), 0), (901, base[0].tolist(), 0), (902, (base[0] * 3).tolist(), 0), (903, None, 0), (904, [0.0] * 16, 0), (905, [math.nan] * 16, 0), (906, base[0].tolist(), None), (907, base[0].tolist()[:5], 0), (None, base[0].tolist(), 0), (908, [], 0), (909, [None, *base[0].tolist()[1:]], 0)]
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), block=16, centres=4, partners=2).collect()}
    good = {i: (np.array(v) / np.linalg.norm(v), x) for i, v, x in rows if i is not None and v and None not in v and x is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    link = {i: {j for j in good if j != i and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.93} for i in good}
    for i, r in got.items():
        if i is None:
            continue
        assert r["n_links"] == len(link.get(i, ()))
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert r["component_id"] == min(seen) and r["kept"] == (min(seen) == i)
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1e-9, 3e-9, 1e-8, 1e-5, 0.05]), st.integers(2, 8))
def test_cover_tree_pairs_at_the_threshold(seed, spread, dims):
    """Bundles of near-equal vectors whose cosines to another bundle lie at the threshold."""
    rng = np.random.default_rng(seed)
    first = rng.standard_normal(dims)
    first /= np.linalg.norm(first)
    across = rng.standard_normal(dims)
    across -= (across @ first) * first
    across /= np.linalg.norm(across)
    second = 0.93 * first + np.sqrt(1 - 0.93**2) * across
    x = np.concatenate([base + spread * rng.standard_normal((40, dims)) for base in (first, second)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    given = x @ x.T
    sure = np.abs(given - 0.93) > 1e-15  # beyond the error of a product's order of summing
    for cut in (80, 37):
        a = cover_tree.Tree(x[:cut], leaf=3)
        b = a if cut == 80 else cover_tree.Tree.opened((tree := cover_tree.Tree(x[cut:], leaf=3)).x, tree.packed())
        place = a.order if cut == 80 else np.concatenate([a.order, cut + tree.order])
        shift = 0 if cut == 80 else cut
        found = np.zeros((80, 80), bool)
        for p, q, whole in cover_tree.dual(a, b, 0.93):
            p, q = place[p], place[shift + q]
            found[np.ix_(p, q) if whole else (p, q)] = True
        found |= found.T
        want = given >= 0.93
        np.fill_diagonal(want, False)
        if cut == 37:
            want[:cut, :cut] = want[cut:, cut:] = False
        assert (found == want)[sure].all()


def test_brown_base_score_and_gain(spark):
    import random

    r = random.Random(1)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    docs = {i: " ".join(r.choice(kinds[(i + j) % 3]) for j in range(60)) for i in range(120)} | {900: None, 901: "never seen words Here"}
    df = make(spark, [(i, t, "en", "s") for i, t in docs.items()])
    out = {x["doc_id"]: x for x in brown.score(df, clustered=30, buckets=4, classes=6, head=40).collect()}  # most words beyond the head
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in docs.items()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        o = out[i]
        assert o["n_tokens"] == len(ws) and o["n_known"] == sum(count[w] > 0 for w in ws) and o["train_tokens"] == n and o["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(o["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    whole = brown.score(df, clustered=200, buckets=4, classes=3).collect()
    held = [o for o in whole if o["held_out"] and o["n_tokens"] > 50]
    assert sum(o["score"] for o in held) > sum(o["base_score"] for o in held) * 0.85  # the cycle of classes is learned
    assert sorted((o["doc_id"], round(o["base_score"], 6)) for o in whole) == sorted((o["doc_id"], round(o["base_score"], 6)) for o in out.values())


def test_exchange_finds_the_classes():
    """Words of three kinds that follow each other in a cycle."""
    rng = np.random.default_rng(1)
    line = (np.arange(4000) % 3) * 20 + rng.integers(0, 20, 4000)
    follows = np.zeros((61, 61), np.float32)
    np.add.at(follows, (line[:-1], line[1:]), 1)
    label, table = brown.exchange(follows, 3)
    assert [len(set(label[k * 20 : k * 20 + 20].tolist())) for k in range(3)] == [1, 1, 1] and len(set(label[:60].tolist())) == 3 and table.sum() == 3999


def test_a_rare_word_is_placed_as_the_likelihood_says():
    rng = np.random.default_rng(2)
    line, c = rng.integers(0, 40, 3000), 6
    label = rng.integers(0, 5, 41)
    label[40] = 5
    line[[0, -1]] = 40

    def table(label):
        return np.bincount(label[line[:-1]] * c + label[line[1:]], minlength=c * c).reshape(c, c).astype(float)

    def likelihood(t):
        f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
        return f(t) - f(t.sum(1)) - f(t.sum(0))

    rows, want = np.zeros((40, 2 * c + 1)), []
    for w in range(40):
        for p, q in zip(line[:-1], line[1:], strict=True):
            if p == q == w:
                rows[w, 2 * c] += 1
            elif p == w:
                rows[w, label[q]] += 1
            elif q == w:
                rows[w, c + label[p]] += 1
        want.append(max(range(5), key=lambda k: likelihood(table(np.where(np.arange(41) == w, k, label)))))
    assert brown.place(rows, label[:40], table(label)).tolist() == want


def test_brown_gives_rare_words_classes_of_their_own(spark):
    """Three kinds of words in a cycle; all end alike, so the buckets can't tell them apart."""
    import random

    r = random.Random(4)
    kinds = [[f"{k}{i}zz" for i in range(40)] for k in "abc"]
    docs = [" ".join(r.choice(kinds[(i + j) % 3]) for j in range(60)) for i in range(150)]
    df = make(spark, [(i, t, "en", "s") for i, t in enumerate(docs)])
    model, tail = brown.fit(Scratch(spark, "t"), df.select("text"), clustered=30, buckets=4, classes=3, head=50)
    of = dict(zip(model["words"], model["class_of"].tolist(), strict=True)) | {bytes(x["word"]): x["cls"] for x in tail.collect()}
    classes = [Counter(of[w.encode()] for w in kind).most_common(1)[0] for kind in kinds]
    assert len(of) == 120 and len({k for k, _ in classes}) == 3 and sum(n for _, n in classes) >= 110
    # rarer words than the head's are joined with their classes: the same scores whatever the head
    one, other = ({x["doc_id"]: x["score"] for x in brown.score(df, clustered=30, buckets=4, classes=3, head=h).collect()} for h in (50, 1000))
    assert len(one) == 150 and all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


@settings(max_examples=40, deadline=None)
@given(st.text(st.characters(max_codepoint=0x23F), max_size=80) | st.text(max_size=40))
def test_encoders_agree(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(test_encoders_agree, "both"):
        test_encoders_agree.both = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast, whole = test_encoders_agree.both
    assert fast(text) == whole.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {1: words(1, 3000), 2: "", 3: "short", 4: "<|endoftext|> x", 5: "日本 🙂"}
    rows = packing.pack(make(spark, [(i, t, "en", "s") for i, t in docs.items()])).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and all(r["offset"] == 0 for r in rows)
    for i, t in docs.items():
        own = sorted((r["start"], r) for r in rows if r["doc_id"] == i)
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for _, r in own]).tolist()
        assert ids == [*whole.encode(t, add_special_tokens=False).ids, 1]
        assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(ids) for _, r in own)


def test_langid_held_out_accuracy(spark):
    docs = [(i, words(i, 30, "zzqx" if i % 2 else "aaoo"), "xx" if i % 2 else "aa", "s") for i in range(300)]
    out = langid.identify(make(spark, docs)).collect()
    right = [r["lang_pred"] == ("xx" if r["doc_id"] % 2 else "aa") for r in out if r["held_out"]]
    assert len(right) > 30 and sum(right) / len(right) > 0.98 and all(0 <= r["score"] <= 1 for r in out)


def plain_languages(train, texts, features=1 << 15):
    """Multinomial naive Bayes over the n-grams of letters, with the operator's hash of an n-gram."""

    def grams(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        flat = " " .join(low.split())
        flat += " " if flat else ""
        for n in (1, 2, 3):
            for i in range(len(flat) - n + 1):
                if n > 1 or flat[i] != " ":
                    h = 0
                    for c in flat[i : i + n]:
                        h = ((h ^ ord(c)) * 0x9E3779B1) % (1 << 32)
                        h ^= h >> 15
                    yield (h * 0x85EBCA6B) % (1 << 32) >> 17

    names = sorted({g for _, g in train})
    counts = {g: Counter(x for t, own in train if own == g for x in grams(t)) for g in names}
    whole = {g: sum(c.values()) for g, c in counts.items()}
    out = []
    for t in texts:
        own = list(grams(t))
        score = [sum(math.log((counts[g][x] + 0.1) / (whole[g] + 0.1 * features)) for x in own) for g in names]
        best = score.index(max(score))
        out.append((names[best], 1 / sum(math.exp(s - score[best]) for s in score)) if any(c.isalpha() for c in t) else ("und", 0.0))
    return out


def test_langid_against_a_plain_version(spark):
    docs = [(i, words(i, 3 + i % 30, ["zzqx", "aaoo", "éüß"][i % 3]) + [" ÀB 12!", "", " 日本", "..X"][i % 4], ["xx", "aa", "éé"][i % 3], "s") for i in range(90)] + [(200, "12 %", "aa", "s"), (201, "", "xx", "s")]
    rows = {r["doc_id"]: r for r in langid.identify(make(spark, docs)).collect()}
    train = [(t, g) for i, t, g, _ in docs if zlib.crc32(str(i).encode()) % 5]
    for (i, *_), (name, p) in zip(docs, plain_languages(train, [t for _, t, _, _ in docs]), strict=True):
        assert rows[i]["lang_pred"] == name and math.isclose(rows[i]["score"], p, rel_tol=1e-3, abs_tol=1e-9)


def test_langid_learns_from_long_rows_where_there_are_no_others(spark):
    docs = [(i, words(i, 60, "zzqx" if i % 2 else "aaoo"), "xx" if i % 2 else "aa", "s") for i in range(1, 40)]
    out = langid.identify(make(spark, docs), longest=10).collect()
    assert {r["lang_pred"] for r in out} == {"xx", "aa"}
    with pytest.raises(ValueError, match="languages"):
        langid.identify(make(spark, docs), most_languages=1)


def plain_logit(net, x):
    """One window's logit, unit by unit and word by word. x: features of its words in order."""
    k, p = net.units, net.p
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for way in "fb":
        h, states[way] = [0.0] * k, [None] * len(x)
        for t in range(len(x)) if way == "f" else reversed(range(len(x))):
            into = [sum(x[t][i] * p[f"w{way}"][i][j] for i in range(len(x[t]))) + p[f"c{way}"][j] for j in range(3 * k)]
            back = [sum(h[i] * p[f"u{way}"][i][j] for i in range(k)) for j in range(3 * k)]
            z, r = [sig(into[j] + back[j]) for j in range(k)], [sig(into[k + j] + back[k + j]) for j in range(k)]
            new = [math.tanh(into[2 * k + j] + r[j] * back[2 * k + j]) for j in range(k)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(k)]
            states[way][t] = h
    both = [f + b for f, b in zip(states["f"], states["b"], strict=True)]
    e = [math.exp(sum(s * a for s, a in zip(own, p["attend"], strict=True))) for own in both]
    pooled = [sum(w * own[j] for w, own in zip(e, both, strict=True)) / sum(e) for j in range(2 * k)]
    return sum(a * b for a, b in zip(pooled, p["out"], strict=True)) + p["bias"][0]


def test_the_network_and_its_windows_against_a_plain_pass():
    docs = [(words(i, 3 + 9 * i) + (" grublix " + words(50 + i, 20) if i % 3 == 0 else "")).encode() for i in range(30)] + [b"", b"one"]
    labels = np.array([i % 3 == 0 for i in range(30)] + [False, False]).astype(int)
    model = toxicity.train(docs, labels, 8, 3, rounds=2, steps=20, batch=30)
    scores = model.score(docs)
    for text, got in zip(docs[:6] + docs[-2:], scores[:6].tolist() + scores[-2:].tolist(), strict=True):
        own = text.split()
        starts = [0] if 0 < len(own) <= 8 else [i for i in range(0, len(own), 4) if i == 0 or i + 4 < len(own)]
        logits = []
        for i in starts:
            window = own[i : i + 8]
            x = [model.network.vectors((w := toxicity.Words([word])).evidence(model.word, model.gram), *w.rows())[0].tolist() for word in window]
            logits.append(plain_logit(model.network, x))
        assert math.isclose(got, 1 / (1 + math.exp(-max(logits))) if logits else 0.0, rel_tol=1e-3, abs_tol=1e-6)


def test_parts_of_a_long_text_hold_its_windows():
    text = words(5, 3000).encode()
    for n in (0, 1, 7, 8, 9, 12, 13, 500, 3000):
        own = b" ".join(text.split()[:n])
        want = {tuple(own.split()[i : i + 8]) for i in ([0] if 0 < n <= 8 else [i for i in range(0, n, 4) if i == 0 or i + 4 < n])}
        got = set()
        for part in toxicity.parts(own, 8, 300):
            got |= {tuple(part.split()[i : i + 8]) for i in ([0] if 0 < len(part.split()) <= 8 else [i for i in range(0, len(part.split()), 4) if i == 0 or i + 4 < len(part.split())])}
        assert got == want


def test_a_lookup_loses_no_entry():
    h = np.random.default_rng(1).integers(1, 1 << 62, 5000).astype(np.uint64)
    h[:2000] = (h[:2000] >> np.uint64(20) << np.uint64(20)) | np.uint64(77)  # many that meet in a slot
    h = np.unique(h)
    look = toxicity.Lookup(h, np.arange(1, len(h) + 1, dtype=np.float32))
    assert (look(h) == np.arange(1, len(h) + 1)).all() and (look(h + np.uint64(1))[~np.isin(h + np.uint64(1), h)] == 0).all()
    assert (toxicity.Lookup(h[:0], np.zeros(0, np.float32))(h) == 0).all()


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, token = rng.standard_normal((7, toxicity.INPUTS)), rng.integers(0, 7, (5, 4))
    mask, y = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0], [1, 1, 1, 0], [1, 1, 1, 1]], float), np.array([1, 0, 1, 0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, token, mask)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradient(x, token, mask, y)
    for name, p in [*net.p.items(), ("x", x)]:
        at = (token[0, 1], 3) if name == "x" else tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-3
        up = loss()
        p[at] = old - 1e-3
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3, name


def test_toxicity_held_out(spark):
    docs, marks = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = words(i, 40 + i % 90)
        if bad:
            text += f" grubl{words(i, 1)[:3]} " + words(i + 999, 20)
        docs.append((i, text, "en", "s"))
        marks.append((i, int(bad)))
    out = toxicity.classify(make(spark, docs), spark.createDataFrame(marks, "doc_id bigint, toxic int")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 30 and sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) / len(held) > 0.9


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_alignment_in_a_wide_band_is_the_whole_alignment():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(1, 4, 9), rng.integers(1, 4, 9)
        region = np.concatenate([np.zeros(9, np.int64), b, np.zeros(9, np.int64)])
        n, first, last = licenses.align(a, region, 19)
        assert n == longest_common(a.tolist(), b.tolist()) and (not n or longest_common(a.tolist(), region[first : last + 1].tolist()) == n)


def test_licenses_find_planted_copies(spark):
    """Exact and edited notices, side by side, far apart and torn open, against what was put in."""
    import random

    r = random.Random(8)
    known = licenses.templates()
    short = [n for n in known if len(licenses.Index({"x": known[n]}, 3, 2).words[0]) < 60 and n != "mit-grant"]
    docs, want = {}, Counter()
    for i in range(150):
        parts = []
        for _ in range(r.randint(1, 4)):
            name = r.choice(short)
            for _ in range(r.choice([1, 1, 2, 3])):
                own = known[name].split()
                kind = r.choice(["", "", "edit", "torn"]) if len(own) >= 11 else ""
                if kind == "edit":
                    own[r.randrange(1, len(own) - 1)] = "changed"
                elif kind == "torn":
                    own[len(own) // 2 : len(own) // 2] = words(i, 40, "xz").split()
                parts.append(" ".join(own))
                want[i, name] += 1
            parts.append(words(i * 7, r.choice([0, 1, 3, 30]), "xz"))
        docs[i] = " ".join(parts)
    rows = licenses.scan(make(spark, [(i, t, "en", "s") for i, t in docs.items()])).collect()
    # notices that are most of each other match together: of those only the planted ones are asked for
    got = Counter((x["doc_id"], x["template"]) for x in rows)
    assert all(got[k] >= n for k, n in want.items())
    split = {n: licenses.Index({"x": known[n]}, 3, 2).words[0].tolist() for n in short}
    near = lambda a, b: longest_common(split[a], split[b]) >= 0.7 * len(split[b])
    bad = {(i, t): (n, docs[i]) for (i, t), n in got.items() if t in split and n > sum(m for (j, name), m in want.items() if i == j and near(name, t))}
    assert not bad
    for x in rows:
        assert docs[x["doc_id"]][x["start_char"] : x["end_char"]] == x["matched_text"]
    by: dict = {}
    for x in rows:
        by.setdefault((x["doc_id"], x["template"]), []).append((x["start_char"], x["end_char"]))
    assert all(a[1] <= b[0] for spans in by.values() for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))


def test_licenses_by_example(spark):
    line, notice = licenses.NOTICES["mit-line"], licenses.NOTICES["gpl-3.0-line"]
    changed = notice.replace("General Public", "GENERAL  public").replace("work", "thing")
    docs = {
        1: f"{words(1, 30)}. {notice}\n{words(2, 10)}", 2: changed, 3: words(3, 200), 4: f"{notice} {notice}", 5: "Released under the MIT License", 6: "licensed under nothing at all",
        7: f"{line} {line}", 8: " ".join([licenses.NOTICES["cc-by-nc-4.0-line"]] * 3), 9: " ".join([licenses.NOTICES["apache-2.0-line"]] * 2), 10: notice.replace("GNU", "GNU " + words(5, 60, "xz")),
    }
    got = sorted((r["doc_id"], r["template"], r["matched"]) for r in licenses.scan(make(spark, [(i, t, "en", "s") for i, t in docs.items()])).collect())
    want = [(1, "gpl-3.0-line", 12), (2, "gpl-3.0-line", 11), *[(4, "gpl-3.0-line", 12)] * 2, (5, "mit-line", 5), *[(7, "mit-line", 5)] * 2, *[(8, "cc-by-nc-4.0-line", 7)] * 3, *[(9, "apache-2.0-line", 8)] * 2, (10, "gpl-3.0-line", 12)]
    assert [g for g in got if not g[1].startswith("cc-by") or g[1] == "cc-by-nc-4.0-line"] == want


def test_licenses_find_whole_texts(spark):
    known = licenses.templates()
    whole = [n for n in known if n not in licenses.NOTICES]
    docs = [(i, f"{words(i, 50)} {known[n]} {words(i + 99, 50)} {known['mit-line']}", "en", "s") for i, n in enumerate(whole)]
    rows = licenses.scan(make(spark, docs)).collect()
    assert {(r["doc_id"], r["template"]) for r in rows} >= {(i, n) for i, n in enumerate(whole)} and sum(r["template"] == "mit-line" for r in rows) == len(whole)
    assert all(r["coverage"] == 1 for r in rows if r["template"] == whole[r["doc_id"]]) and len(whole) == 14


def test_shards_law_and_slots(spark):
    docs = [(i, words(i % 40 if i < 60 else i, 5 + i % 60), ["en", "fr", None][i % 3], "s") for i in range(400)]
    rows = kd_shards.shard(make(spark, docs), shards=8).collect()
    bytes_in = Counter()
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        bytes_in[s] = sum(r["size"] for r in own)
    mean, largest = sum(bytes_in.values()) / 8, max(r["size"] for r in rows)
    assert max(abs(b - mean) for b in bytes_in.values()) <= 2 * largest
    assert all(r["size"] == len(docs[r["doc_id"]][1].encode()) + 16 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]][1].encode()) for r in rows)


def test_shards_are_a_k_d_tree(spark):
    """Every split, found again by brute force: along the widest dimension, at its share of the bytes, equal texts together."""
    docs = [(i, words(i % 40 if i < 60 else i, 5 + (i * i) % 90), ["en", "fr", "fr", None][i % 4], "s") for i in range(900)]
    df = make(spark, docs)
    rows = {r["doc_id"]: r for r in kd_shards.shard(df, shards=11).collect()}
    body = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(body) + 16).cast("long"), F.crc32(body.cast("binary"))
    dims = kd_shards._positions(size, F.length(body), F.col("lang"), crc, F.col("doc_id").cast("long"))
    at = {r[0]: r[1:] for r in df.select("doc_id", *dims).collect()}
    whole = [max(p[d] for p in at.values()) - min(p[d] for p in at.values()) for d in range(3)]
    total = sum(r["size"] for r in rows.values())
    largest, todo, splits = max(r["size"] for r in rows.values()), [(0, 11)], 0
    while todo:
        first, k = todo.pop()
        own = [i for i, r in rows.items() if first <= r["shard"] < first + k]
        if k == 1:
            continue
        left = [i for i in own if rows[i]["shard"] < first + k // 2]
        right = [i for i in own if rows[i]["shard"] >= first + k // 2]
        reach = [(max(at[i][d] for i in own) - min(at[i][d] for i in own)) / whole[d] for d in range(3)]
        d = max(range(3), key=lambda j: (round(reach[j], 6), -j))
        assert max(at[i][d] for i in left) < min(at[i][d] for i in right)
        want = sum(rows[i]["size"] for i in own) * (k // 2) / k
        assert abs(sum(rows[i]["size"] for i in left) - want) <= largest / 2 + total / 11 / 100
        todo += [(first, k // 2), (first + k // 2, k - k // 2)]
        splits += 1
    assert splits == 10
    by_text: dict = {}
    for r in rows.values():
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    few = {k: sum(1 for r in rows.values() if (r["text_crc32"], r["size"]) == k) * k[1] for k in by_text}
    assert all(len(s) == 1 for k, s in by_text.items() if few[k] <= total / 11 / 100)


def test_shards_of_one_text_and_of_few_rows(spark):
    same = kd_shards.shard(make(spark, [(i, "the same words", "en", "s") for i in range(400)]), shards=8).collect()
    n = Counter(r["shard"] for r in same)
    assert len(n) == 8 and max(n.values()) <= 1.25 * min(n.values())
    few = kd_shards.shard(make(spark, [(i, words(i, 5), "en", "s") for i in range(3)] + [(None, None, None, None)] * 2), shards=8).collect()
    assert len(few) == 5 and all(0 <= r["shard"] < 8 for r in few) and sorted((r["shard"], r["slot"]) for r in few) == [(s, k) for s, c in sorted(Counter(r["shard"] for r in few).items()) for k in range(c)]


def test_mixing_plan_matches_a_loop(spark):
    docs = [(i, words(i, 3 + i % 50), "en", [None, "a", "b", "c", "d"][min(4, i % 9)]) for i in range(500)]
    rows = {r["doc_id"]: r for r in mixing.mix(make(spark, docs), rows=False).collect()}
    size = {i: len(t.split()) for i, t, _, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, _, own in docs if own == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    for i, _, _, s in docs:
        r = rows[i]
        assert r["size"] == size[i] and r["source_size"] == total[s] and math.isclose(r["target"], target[s]) and r["taken"] <= 2 * size[i]
    for s in sources:
        assert abs(sum(rows[i]["taken"] for i, _, _, own in docs if own == s) - target[s]) <= 60


def plain_phrases(text):
    known, piece = {""}, ""
    for c in text:
        piece += c
        if piece not in known:
            known.add(piece)
            piece = ""
    return known - {""}


def plain_signature(text, bins=128):
    """Minimum hashes of a plain dictionary parse: the phrase set's least hash in each bin."""
    phrases = sorted(plain_phrases(text))
    if not phrases:
        return None
    sizes = np.array([len(p) for p in phrases])
    ends = np.cumsum(sizes)
    h = textarrays.span_hashes(np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32), ends - sizes, ends).tolist()
    low = {}
    for x in h:
        low[x % bins] = min(low.get(x % bins, 1 << 64), x // bins)
    out = []
    for b in range(bins):
        gap = next(g for g in range(bins) if (b + g) % bins in low)
        v = (low[(b + gap) % bins] + gap * 0x9E3779B97F4A7C15) % (1 << 64)
        out.append((v ^ (v >> 17) ^ (v >> 37)) & 0xFFFF)
    return out


def test_fingerprints(spark):
    docs = {i: words(i // 2, 30 + i) for i in range(20)} | {50: "", 51: "aaaa" * 500, 52: "é🙂" * 90}
    rows = {r["doc_id"]: r for r in lz_fingerprint.fingerprint(make(spark, [(i, t, "en", "s") for i, t in docs.items()])).collect()}
    order = sorted(docs, reverse=True)
    like = lambda a, b: float(a is None and b is None) if a is None or b is None else sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    for k, i in enumerate(order):
        text, after = docs[i], docs[order[(k + 1) % len(order)]]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = rows[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = plain_signature(text), plain_signature(edited), plain_signature(after)
        for found, want in ((r["fingerprint"], own), (r["edited_fingerprint"], changed)):
            assert bytes.fromhex(found) == b"".join(x.to_bytes(2, "big") for x in want or [0xFFFF] * 128)
        assert r["near_edited"] == like(own, changed) and r["near_next"] == like(own, following)
    assert rows[50]["near_edited"] == 1 and rows[50]["near_next"] == 0


def test_fingerprints_of_repeated_ids_and_one_row(spark):
    """An id, and null, that hold a third of the rows each: order by id down, null last, then by crc."""
    ids = [7] * 30 + [None] * 30 + list(range(100, 130))
    docs = [(i, words(k % 20, 12), "en", "s") for k, i in enumerate(ids)]
    rows = lz_fingerprint.fingerprint(make(spark, docs)).collect()
    order = sorted(((i is None, -(i or 0), zlib.crc32(t.encode()), t) for i, t, _, _ in docs))
    want = Counter()
    for k, (none, i, _, t) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        want[None if none else -i, hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in rows) == want
    one = lz_fingerprint.fingerprint(make(spark, docs[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=300) | st.text("a", max_size=300), st.integers(0, 300))
def test_phrases_are_a_dictionary_parse(text, cut):
    known: set = set()
    head, piece = lz_fingerprint._parse(text[:cut], known, "")
    rest, piece = lz_fingerprint._parse(text[cut:], known, piece)
    assert set(head + rest) == known == plain_phrases(text) and "".join(head + rest) + piece == text


def test_phrases_have_no_longest():
    short, long = (lz_fingerprint._parse("a" * n, set(), "")[0] for n in (5000, 500_000))
    assert len(short) == 99 and len(long) == 999 and len(lz_fingerprint._parse("a" * 4000, set(), "")[0]) == 88


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 5000, 1 << 14])
def test_lengths(n):
    assert sum(packing.lengths(n)) == n and all(x & (x - 1) == 0 for x in packing.lengths(n))
