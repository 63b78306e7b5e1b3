"""Terms in texts by an automaton, against one pattern that tries each term at each place."""

import random
import re
import time

import pytest

from quillspark.operators import corpus as C


def by_pattern(terms, text):
    order = sorted(terms, key=lambda t: (-len(t), t))
    names = {t.lower(): t for t in order}
    pattern = re.compile("|".join(rf"\b{re.escape(t)}\b" for t in order), re.IGNORECASE)
    return sorted({names[m.group(0).lower()] for m in pattern.finditer(text or "")})


def glossary(spark, terms):
    return spark.createDataFrame([(t, "means something") for t in terms] + [("redirected", "See Bear."), ("", "nothing"), (None, "none")], "term string, definition string")


@pytest.mark.parametrize("block", [100_000, 4])
def test_terms_as_a_pattern_finds_them(spark, block):
    r = random.Random(2)
    words = ["ab", "Ab", "b", "c'd", "é", "x-y", "1/1", "end", "a", "_a", "İs"]
    terms = sorted({" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(40)})
    texts = [(i, r.choice([" ", "-", "  "]).join(w if r.random() < 0.7 else w.upper() for w in r.choices(words, k=r.randint(0, 30))), "kept") for i in range(150)] + [(900, None, None), (900, "ab b", "twice")]
    got = C.glossary_terms(spark.createDataFrame(texts, "k int, t string, other string").repartition(3), "k", "t", glossary(spark, terms), block)
    assert got.columns == ["k", "t", "other", "glossary_terms"]
    rows = sorted(((r["k"], r["t"] or "", r["other"] or ""), r["glossary_terms"]) for r in got.collect())
    assert rows == sorted(((k, t or "", o or ""), by_pattern(terms, t)) for k, t, o in texts)


def test_no_terms(spark):
    got = C.glossary_terms(spark.createDataFrame([(1, "a bear")], "k int, t string"), "k", "t", glossary(spark, []))
    assert got.first()["glossary_terms"] == []


def test_time_does_not_grow_with_the_terms():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    terms = [f"{word()} {word()}" for _ in range(100_000)]
    text = " ".join(r.choice(terms) if r.random() < 0.01 else word() for _ in range(20_000))
    took = []
    for n in (100, 100_000):
        automaton = C._automaton(terms[:n])
        began = time.process_time()
        found = C._apart(list(C._whole_words(text, automaton)))
        took.append(time.process_time() - began)
    assert len(found) > 100 and took[1] < 20 * took[0] + 0.2
