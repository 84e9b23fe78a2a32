import random

from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm.decontamination import Matcher, _masks, decontamination, myers, without_copies


def distances(pattern, text, free=True):
    """Least edit distance of the pattern to a stretch of the text that ends at each place."""
    row = [0 if free else j for j in range(len(text) + 1)]
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + c % 3 for c in b)), st.binary(max_size=30).map(lambda b: bytes(97 + c % 3 for c in b)))
def test_myers(pattern, text):
    for anchored in (False, True):
        row = distances(pattern, text, not anchored)
        best, end = myers(_masks(pattern), len(pattern), text, anchored)
        assert best == min(len(pattern), *row) and (end == 0 or row[end] == best)


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False))
def test_every_copy_within_the_budget_is_found(rng):
    pattern = bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(20, 60)))
    copy = bytearray(pattern)
    for _ in range(rng.randint(0, 8)):
        at = rng.randrange(len(copy))
        copy[at : at + rng.randint(0, 1)] = bytes([rng.choice(b"xyz")]) * rng.randint(0, 1)
    text = bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(0, 40))) + bytes(copy) + b"tail"
    found = Matcher([("i", pattern, )], 0.1).find(text)
    least = min(distances(pattern, text))
    assert bool(found) == (least <= len(pattern) // 10)
    if found:
        _, distance, a, b = found[0]
        assert distance == least and distances(pattern, text[a:b], free=False)[-1] == least


def test_documents(spark):
    random.seed(2)
    item = "The quick brown Été fox jumps over the lazy dog near the river bank"
    noisy = item.replace("quick", "quack").replace("lazy ", "lazy  ")
    rows = [(1, "intro " + item.upper().replace("É", "É") + " end"), (2, noisy), (3, "nothing"), (4, None), (5, ""), (None, item), (6, item), (6, item), (7, "x " * 40_000 + item.replace(" ", "\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS distance", "3 AS id")
    bench = spark.createDataFrame([(10, item), (11, "short"), (12, None), (10, item), (13, "no such passage in any of the texts")], "item_id long, text string")
    for block in (1 << 20, 40):
        found = sorted(((r.doc_id, r.item_id, r.distance) for r in decontamination(docs, bench, block_bytes=block).collect()), key=str)
        assert found == sorted([(1, 10, 0), (2, 10, 2), (None, 10, 0), (6, 10, 0), (6, 10, 0), (7, 10, 0)], key=str)
        clean = without_copies(docs, bench, block_bytes=block)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    assert decontamination(docs.limit(0), bench).count() == 0 and decontamination(docs, bench.limit(0)).count() == 0
    few = spark.createDataFrame([(20, "lazy dog"), (21, "fox"), (22, ""), (23, "zebra")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontamination(docs.filter("doc_id IN (1, 2, 3)"), few).collect())
    assert got == [(1, 20, 0), (1, 21, 0), (2, 21, 0)]  # the second has two blanks in "lazy dog"
    assert without_copies(docs, few).count() == docs.count()  # too short to prove a copy
    spot = decontamination(docs.filter("doc_id = 1"), bench).first()
    assert (spot.match_start, spot.match_end) == (6, 6 + len(item.encode()))
