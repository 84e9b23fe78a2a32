import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm.token_counts import _loaded, chunked_count, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts(spark):
    random.seed(1)
    long = " ".join(random.choice(["word", "étrange", "12345", "<s>", "a\nb", "  x", "日本語", "ﬁ"]) for _ in range(4000))
    rows = [(1, "The cat."), (2, ""), (3, None), (None, "x  y"), (4, "<s> </s> <unk>"), (5, long), (5, long), (6, "a" * 30_000), (7, " " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS n_tokens", "1 AS id")
    want = sorted(((i, len((t or "").encode()), len(PLAIN.encode(t or "")), len(PLAIN.encode(t or "")) > 4096) for i, t in rows), key=str)
    for chunk, overlap in ((1 << 16, 512), (700, 3), (97, 16)):
        found = token_counts(docs, chunk=chunk, overlap=overlap)
        assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert token_counts(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é▁\n\t<s>日1.", max_size=120), st.integers(2, 30), st.integers(1, 8))
def test_any_chunks(text, chunk, overlap):
    model, bridged = _loaded(PATH)
    assert chunked_count(model, bridged, text, chunk, overlap) == len(PLAIN.encode(text))
