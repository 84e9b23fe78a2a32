"""Repeats of bytes and words against plain counting."""

import hashlib
import random
import re
from collections import Counter

import pytest

from hearth.llm import repeats
from hearth.llm.byte_repeats import byte_repeats
from hearth.llm.word_repeats import word_repeats

WORD = r"[^\x20\x09-\x0D]+"


def covered(sequences, length):
    seen = Counter(tuple(s[k : k + length]) for s in sequences for k in range(len(s) - length + 1))
    for s in sequences:
        gone = bytearray(len(s))
        for k in range(len(s) - length + 1):
            if seen[tuple(s[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        yield gone


def sample(seed=3):
    random.seed(seed)
    base = [random.choice("a a a b c été".split()) for _ in range(60)]
    texts = [" ".join(random.choice("ab") if random.random() < 0.15 else base[(i * 7 + k) % 60] for k in range(random.randint(0, 80))) for i in range(60)]
    texts += ["a b " * (5 + i) for i in range(5)] + ["x " * n for n in (1, 11, 12, 13, 30)] + ["", "  \t\n", "ab\n\nab"]
    return list(enumerate(texts))


def expected_bytes(rows, length):
    data = [t.encode() for _, t in rows]
    out = Counter()
    for (i, _), raw, gone in zip(rows, data, covered(data, length), strict=True):
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def expected_words(rows, length):
    data = [re.findall(WORD, t) for _, t in rows]
    out = Counter()
    for (i, _), words, gone in zip(rows, data, covered(data, length), strict=True):
        out[i, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length, trigger, hot", [(30, 6, 4096), (24, 24, 4096), (30, 3, 2)])
def test_bytes(spark, monkeypatch, length, trigger, hot):
    monkeypatch.setattr(repeats.repeats, "__defaults__", (hot,))
    rows = sample()
    found = byte_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, trigger)
    assert Counter(tuple(r) for r in found.drop("kept").collect()) == expected_bytes(rows, length)


@pytest.mark.parametrize("length, rounds, context", [(12, 2, 3), (12, 3, 4), (5, 1, 5)])
def test_words(spark, length, rounds, context):
    rows = sample(4)
    found = word_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, rounds, context)
    assert Counter(tuple(r) for r in found.drop("kept").collect()) == expected_words(rows, length)


def test_kept_is_what_was_hashed(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d y"), (3, "z")]
    found = {r.doc_id: r for r in word_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 4, 1, 2).collect()}
    assert found[1].kept == "e f" and found[2].kept == "x y" and found[3].kept == "z"


def test_odd_rows(spark):
    """Null ids and texts, equal rows, other columns with the operators' own names, empty tables."""
    rows = [(None, "p q r s t", 1), (7, None, 2), (8, "m n o p q r s t", 3), (8, "m n o p q r s t", 3), (9, "u v w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").selectExpr("*", "row AS tag", "row AS key", "row AS spans")
    found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in word_repeats(docs, 4, 2, 2).collect()), key=str)
    assert found == sorted([(None, 5, 5), (7, 0, 0), (8, 8, 8), (8, 8, 8), (9, 3, 0)], key=str)
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in byte_repeats(docs, 9, 4).collect()), key=str)
    assert found == sorted([(None, 9, 9), (7, 0, 0), (8, 15, 15), (8, 15, 15), (9, 5, 0)], key=str)
    assert byte_repeats(docs.limit(0)).count() == 0 and word_repeats(docs.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    found = {r.doc_id: r.n_removed for r in word_repeats(spark.createDataFrame([(1, long), (2, "v " + long[:3000]), (3, "v")], "doc_id long, text string")).collect()}
    shared = len(long[:3000].split())
    assert found[2] in (shared, shared - 1) and found[1] == found[2] and found[3] == 0


def test_anchors_do_not_depend_on_the_size_of_the_batch():
    import numpy as np

    from hearth.llm.byte_repeats import least_places

    rest = np.full(1 << 21, 1 << 63, dtype=np.uint64)
    pair = np.array([(5 << 40) + (1 << 16), (5 << 40) + (1 << 17), 1 << 63], dtype=np.uint64)
    small, large = least_places(pair, 3), least_places(np.concatenate((pair, rest)), 3)
    assert small[0] == large[0] == 1
