import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearth.llm import token_alignment as A

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SLOW = Tokenizer.from_file(A_PATH)
SLOW.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
LETTERS = A._byte_letters()


def plain_tokens(text):
    """(id, start, end) of both tokenizers; nothing where their bytes are not the blank and the text."""
    if not text:
        return [], []
    line = (" " + text).encode()
    a = [(i, bytes(LETTERS[c] for c in SLOW.id_to_token(i))) for i in SLOW.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(t for _, t in a) != line or b"".join(t for _, t in b) != line:
        return [], []
    out = []
    for side in (a, b):
        at, rows = 0, []
        for i, t in side:
            rows.append((i, at, at + len(t)))
            at += len(t)
        out.append(rows)
    return out


def plain(docs):
    """The rows of the query by loops over tokens."""
    tokens = [plain_tokens(t) for _, t in docs]
    counts, linked = Counter(), []
    for a, b in tokens:
        mine = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]]
        linked.append(mine)
        counts.update(mine)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for (doc, _), (a, b), mine in zip(docs, tokens, linked):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x[0]) for x in a if low < x[2] <= cut) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= cut))
            low = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((doc, len(a), len(b), len(cuts), len(mine), sum(counts[p] == best[p[1]] for p in mine), sum(counts[p] for p in mine), sha))
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The cat sat.", "", None, "x  y\n\n z\t", "<s> </s> <unk> <|endoftext|>", "日本語 ﬁ é ▁ U+2581", "a▁b", "naïve 12345 €9.99", "​odd blank", "𝒳🙂🙂 ok", "The cat sat.",
    " leading", "trailing ", "x" * 3000, " " * 3000, "\x00nul", "é combining",
]


def test_alignment(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "The cat."), (3, "x  y\n\n z\t")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS links", "2 AS id")
    found = A.token_alignment(frame).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain(docs), key=str)
    assert A.token_alignment(frame.limit(0)).count() == 0


def test_links(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS) if t is None or len(t) < 100] + [(None, "The cat.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {"overlap": [], "end": [], "group": []}
    for doc, text in docs:
        a, b = plain_tokens(text)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        group = lambda end, cuts=cuts: next(k for k, c in enumerate(cuts) if end <= c)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n = min(x[2], y[2]) - max(x[1], y[1])
                if n > 0:
                    want["overlap"].append((doc, i, j, x[0], y[0], n))
                if n > 0 and x[2] == y[2]:
                    want["end"].append((doc, i, j, x[0], y[0], n))
                if group(x[2]) == group(y[2]):
                    want["group"].append((doc, i, j, x[0], y[0], None))
    for kind, rows in want.items():
        assert sorted(map(tuple, A.token_links(frame, kind).collect()), key=str) == sorted(rows, key=str), kind


def test_very_long_texts(spark):
    words = " ".join(f"w{k} été {k * 7919}" for k in range(20_000))
    docs = [(1, words), (2, "ab" * 150_000), (3, " " * 150_000 + "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in A.token_alignment(frame).collect()}
    for doc, text in docs:
        a, b = SLOW.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
        assert (found[doc].n_a, found[doc].n_b) == (len(a), len(b))
        assert found[doc].n_links == found[doc].n_groups > 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_fast_tokenizer_gives_the_ids_of_the_library(text):
    names = A.vocabularies(A_PATH, B_PATH)
    assert names.encode_a(" " + text).tolist() == SLOW.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 12), st.integers(0, 10**9), st.integers(1, 40))
def test_product(height, inner, width, seed, terms):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 3, (height, inner)), rng.integers(0, 3, (inner, width))

    def rows(m):
        r, c = np.nonzero(m)
        return A.Csr(np.searchsorted(r, np.arange(m.shape[0] + 1)), c, m[r, c], m.shape[1])

    out = np.zeros((height, width), dtype=int)
    for i, j, v in A.product(rows(x), rows(y), terms):
        assert len(v) <= max(terms, inner * width) and not out[i, j].any()
        out[i, j] = v
    assert (out == x @ y).all()
    back = rows(x).transposed()
    assert (back.starts == rows(x.T).starts).all() and (back.columns == rows(x.T).columns).all()
