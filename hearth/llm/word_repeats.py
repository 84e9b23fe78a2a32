"""Removal of repeated word sequences by recompression.

Each round renames a text twice: every run of one symbol becomes a symbol, then every pair of a left symbol followed by a right one (a bit of
the name says which) does.  A new name is made of the old names alone, so all tasks give equal sequences equal names without exchanging
a table of them; the names that matter are counted over the whole corpus afterwards.

Inside a window of `length` words the parse is decided by the window alone, except at its two ends: there a run may go on outside, a right
symbol may belong to a pair that began outside, a left one to a pair that ends there.  Dropping those leaves the window's *interior symbols*,
the same for equal windows wherever they stand.  The interior symbol with the least name, of the highest round that left any, is the window's
anchor.  Its name and the words that follow it form the key under which windows meet; `hearth.llm.repeats` then verifies long repeats
whole and the rest word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearth.llm.repeats import Groups, Parser, marked, named_rows, repeats, runs, window_starts
from hearth.llm.text import Fingerprint, U, batches, mix, text_bytes, word_spans

ROUNDS = 2
CONTEXT = 8
WORDS, SEQUENCES = Fingerprint(61), Fingerprint(62)


def least_in(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The index of the least name in each [low, high), the last of equals; ranges are not empty."""
    out = np.empty(len(low), dtype=np.int64)
    if not len(low):
        return out
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    best = np.arange(len(names))
    for j in range(int(level.max()) + 1):
        if j:
            left, right = best[: -(1 << (j - 1))], best[1 << (j - 1) :]
            best = np.where(names[left] < names[right], left, right)
        of = np.flatnonzero(level == j)
        a, b = best[low[of]], best[high[of] - (1 << j)]
        out[of] = np.where(names[a] < names[b], a, b)
    return out


def _grouped(first: np.ndarray) -> np.ndarray:
    """For each symbol the number of the new symbol it goes into; `first` marks where a new one begins."""
    return np.cumsum(first) - 1


def recompressed(names: np.ndarray, text: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round: (names, first symbol of each, run of each old symbol, pair of each run, runs that are left, first run of each pair)."""
    n = len(names)
    first = np.ones(n, dtype=bool)
    first[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    run_at = np.flatnonzero(first)
    size = np.diff(np.concatenate((run_at, [n])))
    run_name = np.where(size > 1, mix(names[run_at] + size.astype(np.uint64) * U(0x9E3779B97F4A7C15)), names[run_at])
    run_text = text[run_at]
    left = ((run_name >> U(17 + turn)) & U(1)).astype(bool)
    joined = np.zeros(len(run_at), dtype=bool)  # is the second of a pair
    joined[1:] = left[:-1] & ~left[1:] & (run_text[1:] == run_text[:-1])
    pair_at = np.flatnonzero(~joined)
    is_pair = np.concatenate((joined, [False]))[pair_at + 1]
    pair_name = run_name[pair_at].copy()
    second = run_name[np.minimum(pair_at + 1, max(len(run_name) - 1, 0))]
    pair_name[is_pair] = mix(mix(pair_name[is_pair]) * U(3) + second[is_pair])
    return pair_name, run_at[pair_at], _grouped(first), _grouped(~joined), left, pair_at


def parser(length: int, rounds: int = ROUNDS, context: int = CONTEXT) -> Parser:
    context = min(context, length)

    def parse(raw: np.ndarray, at: np.ndarray) -> Groups:
        starts, ends, first_word = word_spans(raw, at)
        words = WORDS.of(WORDS.over(raw), starts, ends)
        start, text = window_starts(first_word, length)
        sums = SEQUENCES.over(words)
        # round 0: all words are interior
        names = words
        begins = np.arange(len(words))  # the first word of each symbol
        of_text = np.repeat(np.arange(len(at) - 1), np.diff(first_word))
        low, high = start.copy(), start + length
        live = np.arange(len(start))
        anchor = np.empty(len(start), dtype=np.int64)
        tier = np.zeros(len(start), dtype=np.int64)
        ends_at = start + length - context  # the last word at which the key fits
        for turn in range(rounds + 1):
            if turn:
                names, sym_at, run, pair, left, _ = recompressed(names, of_text, turn)
                low, high = run[low] + 1, run[high - 1]
                ok = low < high
                live, low, high = live[ok], low[ok], high[ok]
                low = low + ~left[low]
                high = high - left[high - 1]
                ok = low < high
                live, low, high = live[ok], low[ok], high[ok]
                low, high = pair[low], pair[high - 1] + 1
                begins, of_text = begins[sym_at], of_text[sym_at]
            usable = np.minimum(high, np.searchsorted(begins, ends_at[live], side="right")) if turn else np.minimum(high, ends_at[live] + 1)
            ok = low < usable
            if turn == 0 and rounds > 0:
                # only windows that no later round decides need the words: they are found in the end
                kept0 = (names, low, usable)
                tier[:] = 0
                continue
            hit = live[ok]
            anchor[hit] = begins[least_in(names, low[ok], usable[ok])]
            tier[hit] = turn
        if rounds > 0:
            rest = np.flatnonzero(tier == 0)
            names0, low0, high0 = kept0
            anchor[rest] = least_in(names0, low0[rest], high0[rest])
        head, tail = runs(anchor * (rounds + 1) + tier, start, text)
        first, last, m = start[head], start[tail], anchor[head]
        key = SEQUENCES.of(sums, m, m + context) + tier[head].astype(np.uint64)
        return Groups(words, first_word, key, SEQUENCES.of(sums, first, last + length), text[head], first, last)

    return parse


def word_repeats(docs: DataFrame, length: int = 35, rounds: int = ROUNDS, context: int = CONTEXT, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, kept (the words that stay, joined by one blank), n_words, n_removed, kept_sha256.

    A word goes if a window of `length` words that covers it starts anywhere else too, in this text or another.  Null and empty texts have no
    words and keep an empty text.  A null doc_id is one more id; a row that is there twice is a repeat of itself; other columns are
    ignored; an empty table gives an empty one.  `with_kept`: whether kept comes along.
    """
    rows = named_rows(docs, doc_id, text)

    def keep(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            raw, at = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(raw, at)
            gone = marked(first, batch.column("spans").to_pylist(), length)
            kept, removed = [], []
            for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                g = gone[a:b]
                if g.any():
                    kept.append(b" ".join(raw[s:e].tobytes() for s, e in zip(starts[a:b][~g], ends[a:b][~g], strict=True)))
                else:
                    kept.append(b" ".join(raw[at[k] : at[k + 1]].tobytes().split()))
                removed.append(int(g.sum()))
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            texts = [pa.array([k.decode() for k in kept])] if with_kept else []
            yield pa.record_batch([batch.column("id"), *texts, pa.array(np.diff(first)), pa.array(removed, pa.int64()), sha], names=names)

    found = repeats(rows, parser(length, rounds, context), np.dtype(np.uint64), length)
    joined = rows.join(found, ["row", "tag"], "left").select("id", "text", "row", "tag", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["doc_id", *(["kept"] if with_kept else []), "n_words", "n_removed", "kept_sha256"]
    return joined.mapInArrow(keep, f"doc_id {kind}, {'kept string, ' if with_kept else ''}n_words long, n_removed long, kept_sha256 string")
