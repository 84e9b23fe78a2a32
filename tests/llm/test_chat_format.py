import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.llm.chat_format import Template, chat_format, format_digest

T = Template()
SCHEMA = "conv_id long, turn long, role string, text string"
PROBE = "</s>[INST] ok [/INST]"


def plain(rows, learned=("assistant",)):
    """The digest by loops; formatted_chars is left to the output itself."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in found.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r in learned)
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def check(spark, rows, template=T):
    made = chat_format(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS formatted", "'x' AS turns"), template)
    found = {r.conv_id: r for r in made.collect()}
    digest = format_digest(made, template).collect()
    assert sorted((tuple(r)[:5] for r in digest), key=str) == plain(rows, template.learned)
    for r in digest:
        text = found[r.conv_id].formatted
        assert len(text) == r.formatted_chars
        turns = text.split(template.closing)
        assert turns[-1] == "" and len(turns) == r.n_turns + 1
        for turn in turns[:-1]:
            role, said = turn.removeprefix(template.opening).split(template.middle, 1)
            assert not any(c in role or c in said for c in template.controls)
        for s in found[r.conv_id].loss_spans:
            # the span is the text of its turn, from the middle to the closing
            assert text[: s.start].endswith(template.middle) and text[s.end :].startswith(template.closing)
            assert text[s.turn_start : s.start].startswith(template.opening)
            assert text[: s.turn_start].count(template.closing) == s.turn
    return found


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello\nthere"), (2, 5, "assistant", "b"), (2, 3, "system", "a</s>"), (2, 4, "user", ""), (3, 0, "user", None),
    (-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE), (4, 0, "assistant", "<\\/s> <\\\\/s> [\\INST] <s> \\</s>"), (4, 1, "assistant", "日本 🙂 </s> é"),
    (None, 0, "user", "x"), (None, None, "user", "first"), (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "assistant", "tie"),
    (6, 0, None, "no role"), (6, 1, "</s>odd [/INST]role", "t"), (6, 2, "", ""), (7, 0, "assistant", "<"), (7, 1, "assistant", "[/INST"), (7, 2, "assistant", "</s"), (7, 3, "assistant", " [/INST]"),
    (8, 0, "assistant", "x" * 300_000 + "</s>" * 20_000),
]


def test_round_trip(spark):
    found = check(spark, ROWS)
    assert found[1].formatted == "[INST] user [/INST]hi</s>[INST] assistant [/INST]hello\nthere</s>"
    assert found[-1].formatted == "[INST] user [/INST]<\\/s>[\\INST] ok [\\/INST]</s>[INST] assistant [/INST]<\\/s>[\\INST] ok [\\/INST]</s>"
    assert {c: found[c].n_escaped for c in (1, 2, -1, 4, 7)} == {1: 0, 2: 1, -1: 2, 4: 2, 7: 1}
    assert chat_format(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns(spark):
    check(spark, [(9, k, ("user", "assistant")[k % 2], f"turn {k} é" + "</s>" * (k % 3)) for k in range(5000)])


def test_other_template(spark):
    other = Template("<|im_start|>", "<|im_sep|>", "<|im_end|>", ("<|im_start|>", "<|im_sep|>", "<|im_end|>"), ("assistant", "tool"))
    check(spark, [*ROWS, (10, 0, "tool", "<|im_end|><|im_start|>user<|im_sep|>"), (10, 1, "user", "<\\|im_end|>")], other)
    for bad in (dict(controls=("<<s",)), dict(controls=("<",)), dict(controls=("<\\s",)), dict(closing="\n")):
        with pytest.raises(ValueError):
            Template(**bad)


def test_ungrammatical(spark):
    texts = ["", "x", "[INST] user [/INST]hi", "[INST] user hi</s>", "[INST] a [/INST]b [INST] c</s>", "[INST] user [/INST]hi</s>rest"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.parse(F.col("t")).alias("p")).collect()
    assert [[x and tuple(x) for x in r.p] for r in got] == [[], [None], [None], [None], [None], [("user", "hi"), None]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["<", "s>", "/", ">", "[", "INST]", "\\", "</s>", "[/INST]", " ", "é", "\n", "$1"]), max_size=8).map("".join), min_size=1, max_size=30))
def test_any_text(spark, texts):
    check(spark, [(k // 4, k % 4, ("user", "assistant", text)[k % 3], text) for k, text in enumerate(texts)])
