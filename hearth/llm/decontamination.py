"""Benchmark decontamination by pigeonhole edit matching.

An item of m bytes may be copied with k = floor(m * rate) edits.  Cut into k + 1 pieces, at least one piece then stands in the copy
unchanged.  All pieces of a block of items form one Aho-Corasick automaton; each exact hit proposes a place (hit minus the piece's offset),
places closer than the budget are one candidate, and Myers' bit-parallel distance decides over the candidate's whole stretch.

Items come in blocks of bounded size (`block_bytes`); each block is one pass over the documents, so nothing that grows with the benchmark
is broadcast.  Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hearth.llm.text import batches, small_batches, text_bytes, text_udf

#: Upper case folded (ASCII, and the Latin letters that UTF-8 writes after 0xC3), every white space a blank: lengths and offsets stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
FOLD[9:14] = 0x20


def folded(raw: np.ndarray) -> bytes:
    out = FOLD[raw]
    out[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 0x20
    return out.tobytes()


def budget(m: int, rate: float) -> int:
    return int(m * rate + 1e-9)


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 stretches of nearly equal length that cover 0..m."""
    cuts = [m * j // (k + 1) for j in range(k + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def _masks(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for j, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << j
    return out


def myers(masks: dict[int, int], m: int, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of the text, and where the first such stretch ends.

    `anchored`: the stretch starts where the text starts.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | anchored) & full
        plus = (down << 1 | ~(vertical | up)) & full
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """A block of items: (item_id, folded bytes)."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = [(i, p, budget(len(p), rate)) for i, p in items]
        self.masks = {}
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, pattern, k) in enumerate(self.items):
            text = pattern.decode("latin-1")
            for a, b in pieces(len(pattern), k):
                where.setdefault(text[a:b], []).append((n, b))
        for piece, uses in where.items():
            self.automaton.add_word(piece, uses)
        if where:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best copy of each item that is within its budget; the first of equals."""
        if not len(self.automaton):
            return []
        places: dict[int, set[int]] = {}
        for last, uses in self.automaton.iter(text.decode("latin-1")):
            for n, offset in uses:
                places.setdefault(n, set()).add(last + 1 - offset)
        return [(n, *hit) for n, starts in sorted(places.items()) if (hit := self._best(n, sorted(starts), text)) is not None]

    def _best(self, n: int, starts: list[int], text: bytes) -> tuple[int, int, int] | None:
        _, pattern, k = self.items[n]
        m = len(pattern)
        at = next((s for s in starts if s >= 0 and text[s : s + m] == pattern), None)
        if at is not None:
            return 0, at, at + m
        if k == 0:
            return None
        if n not in self.masks:
            self.masks[n] = _masks(pattern), _masks(pattern[::-1])
        ahead, back = self.masks[n]
        best = None
        low = high = starts[0]
        for s in [*starts[1:], None]:
            if s is not None and s - high <= k:
                high = s
                continue
            left = max(0, low - k)
            distance, end = myers(ahead, m, text[left : high + m + k])
            if distance <= k and (best is None or distance < best[0]):
                best = distance, left, left + end
            if s is not None:
                low = high = s
        if best is None:
            return None
        distance, left, end = best
        _, length = myers(back, m, text[max(0, end - m - k) : end][::-1], anchored=True)
        return distance, end - length, end


@lru_cache(maxsize=1)
def _matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(list(items), rate)


def item_blocks(benchmark: DataFrame, block_bytes: int, least: int, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items as lists of (id, folded bytes), each list of about `block_bytes`."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].alias("text")).filter(F.octet_length("text") >= least)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks if total else 0):
        found = rows.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).distinct().collect()
        yield sorted(((r.item_id, folded(np.frombuffer(r.text.encode(), dtype=np.uint8))) for r in found), key=lambda x: (str(x[0]), x[1]))


def decontamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, least: int = 1, block_bytes: int = 1 << 20,
                    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item of which the document holds a copy: doc_id, item_id, distance, match_start, match_end.

    Distances and offsets count bytes; case of Latin letters and kinds of white space do not count.  The best copy is given, the first of equals.
    All items are searched, however short: one whose budget (`rate` of its bytes) is below one edit is found where it stands as it is.  `least` leaves out
    shorter ones.  Null and empty items match nothing; null and empty texts match nothing.  Null ids
    stay; repeated documents are each matched; an item that is there twice counts once; empty tables give an empty one; other columns are
    ignored.
    """
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    item_type = benchmark.schema[item_id].dataType
    wanted = to_arrow_type(item_type)
    schema = f"doc_id {rows.schema['id'].dataType.simpleString()}, item_id {item_type.simpleString()}, distance int, match_start long, match_end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_bytes, least, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(block))

        def match(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = _matcher(shared.value, rate)
            for batch in batches(stream):
                raw, at = text_bytes(batch.column("text"))
                data = folded(raw)
                hits = [(j, *hit) for j in range(batch.num_rows) for hit in known.find(data[at[j] : at[j + 1]])]
                ids = batch.column("id").take(pa.array([h[0] for h in hits], pa.int64()))
                items = pa.array([known.items[h[1]][0] for h in hits], wanted)
                cells = [pa.array([h[c] for h in hits], kind) for c, kind in ((2, pa.int32()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.record_batch([ids, items, *cells], names=["doc_id", "item_id", "distance", "match_start", "match_end"])

        out = out.unionByName(rows.mapInArrow(match, schema))
    return out


def without_copies(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, least: int = 24, block_bytes: int = 1 << 20, text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs`, all columns, without the rows that hold a copy of an item.

    Items of fewer than `least` bytes are words that clean texts hold too; they prove nothing here (`decontamination` reports them).  Rows with a
    null or empty text stay, repeated rows fare alike, an empty benchmark removes nothing.
    """
    for block in item_blocks(benchmark, block_bytes, least, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(block))

        def clean(batch: pa.RecordBatch, shared=shared) -> pa.Array:
            known = _matcher(shared.value, rate)
            raw, at = text_bytes(batch.column("text"))
            data = folded(raw)
            return pa.array([not known.find(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.bool_())

        docs = docs.filter(text_udf(clean, "boolean")(docs[text]))
    return docs
