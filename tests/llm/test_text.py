import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm.jaccard_join import jaccard_join
from hearth.llm.byte_repeats import byte_repeats
from hearth.llm.quality_rules import text_stats
from hearth.llm.text import Fingerprint
from hearth.llm.word_repeats import word_repeats

NAMES = Fingerprint(5)


def thue_morse(steps):
    """A word over a and b and its complement; running sums of any polynomial modulo 2**64 hardly tell them apart."""
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


T, T2 = thue_morse(11)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.data(), st.booleans())
def test_names(raw, data, wide):
    values = np.frombuffer(raw, dtype=np.uint8)
    if wide:
        values = values.astype(np.uint64)
    spans = data.draw(st.lists(st.tuples(st.integers(0, len(raw)), st.integers(0, len(raw))).map(sorted), min_size=1, max_size=60))
    start, end = (np.array([s[k] for s in spans]) for k in (0, 1))
    found = NAMES.of(NAMES.over(values), start, end)
    same = {}
    for name, (a, b) in zip(found.tolist(), spans):
        assert same.setdefault(raw[a:b], name) == name
    assert len(set(same.values())) == len(same)
    # alike in another place, alone, and without kept levels
    moved = np.concatenate((values[:0], np.array([7, 7, 7], dtype=values.dtype), values))
    ladder = NAMES.over(moved)
    ladder.KEEP = 0
    assert (NAMES.of(ladder, start + 3, end + 3) == found).all()


def test_thue_morse_names():
    for steps in range(5, 12):
        word, other = (np.frombuffer(w.encode(), dtype=np.uint8) for w in thue_morse(steps))
        n = len(word)
        a, b = (int(NAMES.of(NAMES.over(w), np.array([0]), np.array([n]))[0]) for w in (word, other))
        assert 8 < (a ^ b).bit_count() < 56


def test_thue_morse_texts(spark):
    assert T != T2
    w = [f"w{k}" for k in range(60)]
    docs = [
        (1, f"{T}\n{T2}"), (2, " ".join([*w[:5], T, *w[5:10]])), (3, " ".join([*w[:5], T2, *w[5:10]])),
        (4, " ".join([*w[10:30], T, *w[30:50]])), (5, " ".join([*w[10:30], T2, *w[30:50]])),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = text_stats(frame).filter("doc_id = 1").first()
    assert found["n_dup_lines"] == 0
    joined = {r.doc_id: r.component_id for r in jaccard_join(frame).collect()}
    assert all(joined[d] == d for d in (2, 3))
    assert {r.n_removed for r in word_repeats(frame, with_kept=False).collect()} == {0}
    # T holds no 200-byte factor of its own complement twice by accident of hashing: compare with plain counting
    raw = {d: t.encode() for d, t in docs}
    seen = {}
    for t in raw.values():
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    for r in byte_repeats(frame).collect():
        t, gone = raw[r.doc_id], set()
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        kept = bytes(c for k, c in enumerate(t) if k not in gone)
        assert (r.n_removed, r.kept_sha256) == (len(gone), hashlib.sha256(kept).hexdigest())
