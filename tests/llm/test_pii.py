import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm.pii import KINDS, base_spans, luhn, pii_spans, redacted
from hearth.llm.queries import op4_pii
from hearth.llm.text import word_spans

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
CARD = "4556737586899855"


def base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and luhn(d.encode()), 9 <= len(d) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def corpus():
    rows = [(k, f"call +1 (0{k % 90 + 10}) 555-77{k % 90 + 10} or mail user.{k}@mail{k % 9}.example.com from 10.0.{k % 250}.{k % 7} pay {CARD} é now") for k in range(80)]
    rows += [(100 + k, f"plain words only, number {k} and 3.14 times") for k in range(60)]
    return rows


def test_base_is_exact(spark, corpus):
    odd = ["", None, "999.1.1.1 1.2.3.4.5.6.7.8", "1234 5678-9012 3456 " + CARD + "7", "+1 2 3", "+49 (30) 123-456.78 x", "a@b a@b.c a@b.c.d@e.f é@é.é", "4556 7375 8689 9855-" + CARD,
           "0" * 12 + " " + "0" * 19 + "x" + "0" * 20, "+" + CARD, f"{CARD}\n{CARD}", "日本 1.1.1.1日本@x.y", "1" * 5000]
    rows = corpus + [(1000 + k, t) for k, t in enumerate(odd)] + [(None, "7.7.7.7"), (5, "8.8.8.8"), (5, "8.8.8.8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS id")
    found = pii_spans(docs).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in found), key=str)
    assert got == sorted(((i, base(t)) for i, t in rows), key=str)
    for r in found:
        own = [(s.start, s.end, s.base) for s in r.spans]
        assert all(a < b for a, b, _ in own)
        assert not any(not k and x < b and a < y for a, b, k in own for x, y, z in own if z)
    assert pii_spans(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.+-() @ab\né", max_size=60), min_size=1, max_size=6))
def test_any_text(texts):
    import pyarrow as pa

    from hearth.llm.pii import batch_spans
    from hearth.llm.text import text_bytes

    found = batch_spans(*text_bytes(pa.array(texts)), None, 0.9)
    assert [[(KINDS[k], a, b) for a, b, k, _ in spans] for spans in found] == [base(t) for t in texts]


def test_repeats_share_a_label(spark, corpus):
    """A number that fails the check digit is a card where the corpus says that such tokens are; clean texts get nothing."""
    wrong = "4556737586899856"
    rows = corpus + [(500, f"paid {wrong} and again {wrong}! so"), (501, "the sum is 12 of 7 x"), (502, "v1.2 and 2024-01-01")]
    found = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[500] == [("card", False), ("card", False)]
    assert all(found[k] == [] for k in (*range(100, 160), 501, 502))


def test_redaction_and_digest(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus[:70] + corpus[-30:] + [(900, "é 9.9.9.9, x@y.zz")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    clean = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert clean[900] == "é [IP], [EMAIL]" and clean[0].startswith("call [PHONE] or mail [EMAIL] from [IP] pay [CARD] é")
    rows = {r.doc_id: r for r in op4_pii(spark, str(tmp_path)).collect()}
    for i, t in docs.collect():
        own = base(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert rows[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(k == n for k, _, _ in own) for n in KINDS]


def test_long_tokens_take_time_in_proportion():
    size = 1_000_000
    texts = ["@" + "a" * size, "a" * size, "a" * size + "@", "1" * size + ".1.1", "1" * size + ".", "x " + "1" * 5000 + ".1.1.1", "a@" * (size // 2), "1." * (size // 2), "+" + "(" * size, "+1" * (size // 2), "a." * (size // 2) + "@b", "@" * size]
    for text in texts:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        at = np.array([0, len(raw)])
        starts, ends, _ = word_spans(raw, at)
        begun = time.process_time()
        found = base_spans(raw, at, starts, ends)
        assert time.process_time() - begun < 5, text[:20]
        assert all(a < b <= len(raw) for a, _, b in found)
    raw = np.frombuffer(b"001.0255.3.0000 256.1.1.1", dtype=np.uint8)
    assert base_spans(raw, np.array([0, len(raw)]), *word_spans(raw, np.array([0, len(raw)]))[:2]) == [(0, 1, 15)]
