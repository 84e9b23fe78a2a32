"""The similarity join against plain counting."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm import jaccard_join as module
from hearth.llm.jaccard_join import bits_apart, jaccard_join, one_of_each, wide_parity


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(len(words) - width, 0) + 1)} if words else set()


def expected(rows, width, pct):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def sample(seed, count=260):
    random.seed(seed)
    base = [random.choice("abcdefghijklmnop") + str(random.randint(0, 30)) for _ in range(400)]
    rows = [(0, ""), (1, None), (2, " \t"), (3, "a"), (4, "a b"), (5, "A b"), (6, "b a"), (7, "c d"), (8, "C D")]
    for i in range(10, count):
        n, start = random.choice([20, 40, 90, 150, 165, 180, 300]), random.choice([0, 0, 7, 50])
        words = base[start : start + n]
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            words[random.randrange(len(words))] = "z" + str(random.randint(0, 500))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width, pct, rounds, least", [(3, 90, 3, 64), (5, 80, 1, 4), (3, 90, 0, 4)])
def test_components(spark, monkeypatch, width, pct, rounds, least):
    monkeypatch.setattr(module, "LEAST_FREQUENT", least)
    rows = sample(5)
    found = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width, pct, rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected(rows, width, pct)
    assert len(found) == len(rows)


def test_chain_of_links(spark):
    """Each text is like the next one only; the class is the whole chain."""
    words = [f"w{k}" for k in range(140)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 100])) for i in range(12)]
    found = {r.doc_id: r.component_id for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c) in expected(rows, 3, 90).items()} == found


def test_many_links_between_two_classes_count_once(spark, monkeypatch):
    seen, plain = [], module.classes
    monkeypatch.setattr(module, "classes", lambda links: seen.append(links.count()) or plain(links))
    roots = spark.createDataFrame([(n, 0) for n in range(30)] + [(n, 30) for n in range(30, 60)], "node long, root long")
    links = spark.createDataFrame([(a, b) for a in range(30) for b in range(30, 60)] + [(3, 4), (70, 40), (80, 81)], "a long, b long")
    found = {r.node: r.root for r in module.merged(roots, links).collect()}
    assert found == {n: 0 for n in (*range(60), 70)} | {80: 80, 81: 80}
    assert seen == [3]


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (2, "a b c d e f g", 7), (3, "", 1), (4, None, 1), (None, "a b c d e f g", 8), (None, "q r s t u v", 9), (5, "k l m n o p", 2), (5, "k l m n o p", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr("*", "n AS node", "n AS root")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.n) for r in kept.collect()), key=str) == sorted([(1, 5), (3, 1), (4, 1), (None, 9), (5, 2)], key=str)
    assert jaccard_join(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**9), unique=True, max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_wide_parities_never_refute_a_link(names, drop, add):
    a = np.array(sorted(names), dtype=np.uint64)
    b = np.array(sorted([*names[drop:], *range(2 * 10**9, 2 * 10**9 + add)]), dtype=np.uint64)
    x, y = wide_parity(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    apart = len(set(a.tolist()) ^ set(b.tolist()))
    assert bits_apart(x, y) == bits_apart(y, x) <= apart and bits_apart(x, x) == 0
    assert len(x) * 8 >= max(len(a), 1)
