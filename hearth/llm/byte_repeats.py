"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over `TRIGGER` bytes makes a place a trigger when it is the least among the places of some window of `length` bytes; the text
between two triggers is a phrase.  Whether a place is a trigger for a window depends on the window's bytes alone, and every window holds one,
so equal strings are cut alike wherever they stand: the parse is small and repeats where the text repeats.

The suffixes of a phrase followed by what the parse continues with are all windows that share that phrase's trigger.  They are put into
corpus order by names, not by letters: a (phrase, continuation) class first, and only inside a class that differs are single suffixes
compared.  Equal 200-byte prefixes stand together in that order as they do in a suffix array, which is all that finding repeats needs.
`hearth.llm.repeats` does this for the whole corpus without a row for each suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearth.llm.repeats import Groups, Parser, marked, named_rows, repeats, runs, window_starts
from hearth.llm.text import Fingerprint, U, batches, text_bytes

TRIGGER = 48
ROLLING = Fingerprint(51)


def least_places(names: np.ndarray, width: int) -> np.ndarray:
    """For each index k the index of the least of names[k : k + width], the last of equals; indexes beyond the end do not count.

    Names are compared by their upper 32 bits, whatever the number of names: equal stretches choose alike in every batch.
    Blocks of `width`: a stretch is the end of one block and the beginning of the next.
    """
    n = len(names)
    if not n:
        return np.zeros(0, dtype=np.int64)
    if n + 2 * width >= 1 << 32:
        raise ValueError("more than 4 GB of text in a batch")
    bits = U(32)
    low = (U(1) << bits) - U(1)
    full = np.full(n + width + -(n + width) % width, ~U(0), dtype=np.uint64)
    full[:n] = names >> bits << bits
    full |= low - np.arange(len(full), dtype=np.uint64)
    full[n:] = ~U(0)
    block = full.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (low - (np.minimum(back[:n], ahead[width - 1 : n + width - 1]) & low)).astype(np.int64)


def parser(length: int, trigger: int = TRIGGER) -> Parser:
    trigger = min(trigger, length)

    def parse(raw: np.ndarray, at: np.ndarray) -> Groups:
        start, text = window_starts(at, length)
        sums = ROLLING.over(raw)
        places = np.arange(max(len(raw) - trigger + 1, 0))
        names = ROLLING.of(sums, places, places + trigger)
        anchor = least_places(names, length - trigger + 1)[start] if len(start) else start
        head, tail = runs(anchor, start, text)
        first, last = start[head], start[tail]
        return Groups(raw, at, names[anchor[head]], ROLLING.of(sums, first, last + length), text[head], first, last)

    return parse


def byte_repeats(docs: DataFrame, length: int = 200, trigger: int = TRIGGER, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in this text or another; matches do not cross texts.
    Null and empty texts have no bytes and keep none.  A null doc_id is one more id; a row that is there twice is a repeat of itself;
    other columns are ignored; an empty table gives an empty one.  `with_kept`: whether kept comes along.
    """
    rows = named_rows(docs, doc_id, text)

    def keep(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            raw, at = text_bytes(batch.column("text"))
            gone = marked(at, batch.column("spans").to_pylist(), length)
            kept, removed, spans = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                g = gone[a:b]
                kept.append(raw[a:b][~g].tobytes() if g.any() else raw[a:b].tobytes())
                removed.append(int(g.sum()))
                spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            counts = [pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), sha]
            yield pa.record_batch([batch.column("id"), *([pa.array(kept, pa.binary())] if with_kept else []), *counts], names=names)

    found = repeats(rows, parser(length, trigger), np.dtype(np.uint8), length)
    joined = rows.join(found, ["row", "tag"], "left").select("id", "text", "row", "tag", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["doc_id", *(["kept"] if with_kept else []), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return joined.mapInArrow(keep, f"doc_id {kind}, {'kept binary, ' if with_kept else ''}n_bytes long, n_removed long, n_spans long, kept_sha256 string")
