"""Quality filtering by a learned decision list over statistics of whole texts.

`text_stats` counts words, symbols, repeated lines and the like.  `learn_list` is sequential covering: it grows a conjunction of
thresholds on one half of the labelled rows until it holds no good document (or gains nothing more), prunes it on the other half,
removes what it covers and goes on.  The list becomes one ordered CASE expression, so judging a corpus is a plain projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.text import SPACE, Fingerprint, U, batches, mix, parked, small_batches, text_bytes, word_spans

LINES, WORDS = Fingerprint(11), Fingerprint(12)
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
RATES = {
    "n_words": "n_words", "mean_word": "word_chars / greatest(n_words, 1)", "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)", "digits": "n_digits / greatest(word_chars, 1)", "marks": "n_marks / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)", "line_words": "n_words / greatest(n_lines, 1)",
}


def _per_text(where: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall into each text."""
    return np.diff(np.searchsorted(where, at))


def _twins(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with a key, inside their text: whether the key occurs twice or more, and whether it occurred before."""
    both = mix(keys + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    again, earlier = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    earlier[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, earlier


def count_stats(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = word_spans(raw, at)
    texts = len(at) - 1
    n_words = np.diff(first)
    doc = np.repeat(np.arange(texts), n_words)
    kind = ~SPACE[raw] & ((raw & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": _per_text(np.flatnonzero(kind), at), "n_symbols": _per_text(np.flatnonzero(SYMBOL[raw]), at)}
    # lines that hold a word
    breaks = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate((at[:-1], breaks + 1)))
    line_start = line_start[line_start < len(raw)]
    line_end = np.concatenate((line_start[1:], [len(raw)])).astype(np.int64)[: len(line_start)]
    line_end = np.where((line_end > 0) & (raw[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(raw) else line_end
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(at, line_start, side="right") - 1
    sums = LINES.over(raw)
    _, earlier = _twins(LINES.of(sums, line_start, line_end), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=texts)
    out["n_lines"] = np.bincount(line_doc, minlength=texts)
    # words in windows of three that occur twice or more
    word = LINES.of(sums, starts, ends)
    _, seen = _twins(word, doc)
    out["n_distinct"] = n_words - np.bincount(doc[seen], minlength=texts)
    covered = np.zeros(len(word) + 3, dtype=bool)
    if len(word) >= 3:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        keys = WORDS.of(WORDS.over(word), inside, inside + 3)
        again, _ = _twins(keys, doc[inside])
        for k in range(3):
            covered[inside[again] + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered[: len(word)]], minlength=texts)
    for name, test in (("n_upper", (raw >= 65) & (raw <= 90)), ("n_digits", (raw >= 48) & (raw <= 57)), ("n_marks", np.isin(raw, np.frombuffer(b".,!?;:", dtype=np.uint8)))):
        out[name] = _per_text(np.flatnonzero(test), at)
    return out


def text_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text (COUNTS); null and empty texts count 0 everywhere.  No shuffle."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = count_stats(*text_bytes(batch.column("text")))
            yield pa.record_batch([batch.column("id"), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """All tests (rate, is_above, threshold) must hold; then the document goes."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, above, threshold in self.tests:
            hit &= x[name] > threshold if above else x[name] <= threshold
        return hit

    def expression(self) -> Column:
        parts = [f"({RATES[name]} {'>' if above else '<='} cast({threshold!r} AS double))" for name, above, threshold in self.tests]
        return F.expr(" AND ".join(parts))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int, bins: int) -> list[tuple[str, bool, float]]:
    tests: list[tuple[str, bool, float]] = []
    live = np.ones(len(bad), dtype=bool)
    while len(tests) < most_tests and (~bad[live]).any():
        p, n = bad[live].sum(), (~bad[live]).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            cuts = np.unique(np.concatenate([np.quantile(values[of], np.linspace(0, 1, bins)) for of in (live & bad, live)]))
            for above in (True, False):
                for cut in np.unique((cuts[1:] + cuts[:-1]) / 2) if len(cuts) > 1 else cuts:
                    hit = live & (values > cut if above else values <= cut)
                    p2, n2 = (hit & bad).sum(), (hit & ~bad).sum()
                    if p2 and (gain := p2 * (np.log2(p2 / (p2 + n2)) - base)) > best[0]:
                        best = gain, (name, above, float(cut)), hit
        if best[1] is None:
            break
        tests.append(best[1])
        live = best[2]
    return tests


def learn_list(stats: list[dict], most_rules: int = 12, most_tests: int = 4, precision: float = 0.85, least: int = 4, bins: int = 24) -> list[Rule]:
    """An ordered list of rules that name bad documents, from rows with the RATES and `bad`.

    A rule is kept if it covers `least` bad rows and is right in `precision` of what it covers on all labelled rows that are left.
    """
    if not stats:
        return []
    x = {name: np.array([float(r[name]) for r in stats]) for name in RATES}
    bad = np.array([bool(r["bad"]) for r in stats])
    half = np.arange(len(bad)) % 3 != 2
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < most_rules and (left & half & bad).sum() >= least:
        tests = _grow({n: v[left & half] for n, v in x.items()}, bad[left & half], most_tests, bins)

        def worth(tests: list, rows: np.ndarray) -> float:
            hit = Rule(tuple(tests)).covers({n: v[rows] for n, v in x.items()})
            p, n = (hit & bad[rows]).sum(), (hit & ~bad[rows]).sum()
            return (p - n) / max(p + n, 1)

        while len(tests) > 1:  # drop tests from the end, or any one, while the held-out rows do not suffer
            shorter = max(([*tests[:k], *tests[k + 1 :]] for k in range(len(tests))), key=lambda t: worth(t, left & ~half))
            if worth(shorter, left & ~half) < worth(tests, left & ~half):
                break
            tests = shorter
        if not tests:
            break
        rule = Rule(tuple(tests))
        hit = rule.covers(x) & left
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if p < least or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    chain = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        chain = F.when(rule.expression(), F.lit(k)).otherwise(chain)
    return chain.cast("int")


def labelled_sample(labels: DataFrame, most: int, label: str) -> DataFrame:
    """(doc_id, bad) of the `most` labelled rows with the least hash of their id: a bound on what reaches the driver."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    picked = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
    return parked(labels.join(picked, "doc_id", "left_semi").groupBy("doc_id").agg((F.min(label) == 0).alias("bad")), "sample")


def quality_rules(docs: DataFrame, labels: DataFrame, most_labels: int = 6000, min_words: int = 50, most_repeat_pct: int = 50, **learning) -> DataFrame:
    """One row per row of `docs`: doc_id, all COUNTS, base_failed, rule (number of the first rule that holds, 0 if none), kept.

    `labels` has doc_id and quality (1 good, 0 bad); the list is learned from at most `most_labels` of them, and only from documents that
    pass the base checks.  Null or empty texts have no words and fail the base check; null ids stay; a document that is there or
    labelled twice counts once; without labels the list is empty and the base checks decide.  Other columns are ignored.  No shuffle after learning.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeat_pct * F.col("n_words"))
    marks = labelled_sample(labels, most_labels, "quality")
    known = text_stats(docs.join(marks, docs["doc_id"] == marks["doc_id"], "left_semi")).filter(~base)
    known = known.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("row")).select("doc_id", "row.*").join(marks, "doc_id")
    rows = [r.asDict() for r in known.select("doc_id", "bad", *(F.expr(e).alias(n) for n, e in RATES.items())).collect()]
    rows.sort(key=lambda r: str(r["doc_id"]))
    rules = learn_list(rows, **learning)
    out = text_stats(docs).withColumn("base_failed", base).withColumn("rule", rule_number(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
