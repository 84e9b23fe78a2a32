"""Windows of a fixed length that occur twice or more in a corpus, found exactly without a row for each window.

Every window has one *anchor* inside it that its content alone decides, so equal windows have equal anchors (`Anchors`).  All windows of
a text that share an anchor occurrence stand next to each other and form a *group*; their union is one stretch of text.

1. Count the keys of all groups (a key names what stands at the anchor, inside all windows of the group).  A key that occurs once has
   no repeated window.
2. A row for each group whose key occurs again: key and whole (a name of the union).  Groups with equal wholes are repeated window by
   window.  A filter of fixed size (2 MB, whatever the corpus) keeps most groups with single keys from being shuffled; the join decides.
3. What is left are keys with several different wholes.  Of each whole one group stands for all; its text (the union, a few hundred
   bytes) goes to the task of its key, where the windows are compared one by one.  A key with more than `HOT` wholes is not gathered: its
   windows become rows that are counted.

Names are 64-bit and compared in pairs (key and whole, key and window), 128 bits together.  Counts are summed in tasks before they
are shuffled and joined back, so a key that holds a third of all rows is one row a task on the counting side, and Spark splits it on the
other.  A row of the input is known by a hash of its id and text; rows that are equal in both are copies of each other and fare alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.text import Fingerprint, U, batches, mix, parked, small_batches, text_bytes


HOT = 4096  # different wholes of a key that one task compares
MANY = 1024  # groups of one whole that one task joins
FILTER_BITS = 1 << 24


@dataclass
class Groups:
    """Of a batch of texts: its units (bytes or 64-bit names) and its groups of windows, in order."""

    units: np.ndarray
    at: np.ndarray  # the first unit of each text, one number more than texts
    key: np.ndarray
    whole: np.ndarray
    text: np.ndarray
    first: np.ndarray  # the first and the last window's start, among all units
    last: np.ndarray


#: Makes the groups of (bytes, text starts).
Parser = Callable[[np.ndarray, np.ndarray], Groups]


def runs(anchor: np.ndarray, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of consecutive windows of a text with one anchor."""
    if not len(anchor):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])))
    head = np.flatnonzero(new)
    return head, np.concatenate((head[1:], [len(anchor)])) - 1


def window_starts(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of all texts, and their texts."""
    count = np.maximum(np.diff(at) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + at[:-1][text], text


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _slots(key: np.ndarray) -> np.ndarray:
    """Two places in the filter for each key."""
    h = mix(key.view(np.uint64))
    return np.stack((h & U(FILTER_BITS - 1), (h >> U(32)) & U(FILTER_BITS - 1))).astype(np.int64)


def _filter(keys: DataFrame) -> np.ndarray:
    """The filter as 64-bit words: never says no to one of the keys.  FILTER_BITS / 64 sums reach the driver at most."""

    def mark(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            slot = np.unique(_slots(np.asarray(batch.column("key"))))
            word, of = np.unique(slot >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(U(1) << (slot & 63).astype(np.uint64), of) if len(slot) else np.zeros(0, dtype=np.uint64)
            yield pa.record_batch([pa.array(word), _signed(bits)], names=["word", "bits"])

    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    found = keys.select("key").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    return out


def _passes(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    a, b = _slots(key)
    return ((words[a >> 6] >> (a & 63).astype(np.uint64)) & (words[b >> 6] >> (b & 63).astype(np.uint64)) & U(1)).astype(bool)


def _repeated_runs(stream: Iterator[pa.RecordBatch], unit: np.dtype, length: int) -> Iterator[pa.RecordBatch]:
    """Groups ordered by key in; (row, tag, first, last) of runs of repeated windows out.  Holds the groups of one key at a time, and a batch."""
    names = Fingerprint(43)

    def compare(rows: pa.Table) -> pa.RecordBatch:
        data = np.frombuffer(rows.column("units").combine_chunks().cast(pa.large_binary()).buffers()[2], dtype=np.uint8) if rows.num_rows else np.zeros(0, dtype=np.uint8)
        size = np.asarray(pa.compute.binary_length(rows.column("units"))) // unit.itemsize
        units = data[: int(size.sum()) * unit.itemsize].view(unit)
        at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        start, text = window_starts(at, length)
        name = names.of(names.over(units), start, start + length)
        both = mix(name + np.asarray(rows.column("key")).view(np.uint64)[text] * U(0x9E3779B97F4A7C15))
        _, which, n = np.unique(both, return_inverse=True, return_counts=True)
        good = np.flatnonzero((n[which] > 1) & ~np.asarray(rows.column("known"))[text])
        head, tail = runs(np.zeros(len(good), dtype=np.int64), start[good], text[good])
        of = text[good][head]
        shift = np.asarray(rows.column("first"))[of] - at[of]
        picked = [rows.column(c).take(pa.array(of)).combine_chunks() for c in ("row", "tag")]
        return pa.record_batch([*picked, pa.array(start[good][head] + shift), pa.array(start[good][tail] + shift)], names=["row", "tag", "first", "last"])

    kept: pa.Table | None = None
    for batch in stream:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([kept, rows]) if kept is not None else rows
        key = np.asarray(rows.column("key"))
        cut = int(np.flatnonzero(key == key[-1])[0]) if len(key) else 0
        at = 0
        while at < cut:  # whole keys, about a thousand groups at a time
            to = cut if cut - at <= 2048 else int(np.searchsorted(np.flatnonzero(np.diff(key[:cut])) + 1, at + 1024))
            if to != cut:
                edges = np.flatnonzero(np.diff(key[:cut])) + 1
                to = int(edges[to]) if to < len(edges) else cut
            yield compare(rows.slice(at, to - at))
            at = to
        kept = rows.slice(cut)
    if kept is not None and kept.num_rows:
        yield compare(kept)


def repeats(rows: DataFrame, parse: Parser, unit: np.dtype, length: int, hot: int = HOT) -> DataFrame:
    """(row, tag, spans) of the rows that hold repeated windows; spans is an array of (first, last) window starts, in no order.

    `rows` has row, tag and text (see `named_rows`).
    """
    unit = np.dtype(unit)

    def keys_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            yield pa.record_batch([_signed(parse(*text_bytes(batch.column("text"))).key)], names=["key"])

    keys = parked(rows.select("text").mapInArrow(keys_of, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    words = rows.sparkSession.sparkContext.broadcast(_filter(keys))

    def groups_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            g = parse(*text_bytes(batch.column("text")))
            k = np.flatnonzero(_passes(words.value, g.key))
            first = g.first[k] - g.at[g.text[k]]
            place = first << 16 | (g.last[k] - g.first[k])
            of = pa.array(g.text[k])
            yield pa.record_batch([_signed(g.key[k]), _signed(g.whole[k]), batch.column("row").take(of), batch.column("tag").take(of), pa.array(place)], names=["key", "whole", "row", "tag", "place"])

    found = rows.select("row", "tag", "text").mapInArrow(groups_of, "key long, whole long, row long, tag int, place long")
    shared = parked(found.join(keys, "key"), "shared")
    wholes = parked(shared.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "tag", "place")).alias("one")), "wholes")
    # copies of one passage by the thousand are told apart first, by a table of a row for each: Spark broadcasts it while it is small and splits the join otherwise
    common = parked(wholes.filter(F.col("n") > MANY).select("key", "whole"), "common")
    marked_rows = shared.join(common.withColumn("common", F.lit(True)), ["key", "whole"], "left")
    rarer = marked_rows.filter("common IS NULL").join(wholes.filter(F.col("n").between(2, MANY)).select("key", "whole"), ["key", "whole"], "left_semi")
    again = marked_rows.filter("common").unionByName(rarer)
    first, more = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFFFF)
    sure = again.select("row", "tag", first.alias("first"), (first + more).alias("last"))
    several = wholes.groupBy("key").agg(F.count("*").alias("wholes")).filter("wholes > 1")
    single = wholes.join(several, "key").select("key", "one.*", (F.col("n") > 1).alias("known"), (F.col("wholes") > hot).alias("hot"))
    per_row = single.groupBy("row", "tag").agg(F.collect_list(F.struct("key", "place", "known", "hot")).alias("groups"))

    def cut_out(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            g = parse(*text_bytes(batch.column("text")))
            lists = batch.column("groups")
            inner = lists.flatten()
            text = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(lists)))
            place = np.asarray(inner.field("place"))
            start = g.at[text] + (place >> 16)
            size = (place & 0xFFFF) + length
            ends = np.cumsum(size)
            index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)
            data = np.ascontiguousarray(g.units[index]).tobytes()
            offsets = np.concatenate(([0], ends)).astype(np.int64) * unit.itemsize
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
            of = pa.array(text)
            yield pa.record_batch([inner.field("key"), inner.field("known"), inner.field("hot"), batch.column("row").take(of), batch.column("tag").take(of), pa.array(place >> 16), cells],
                                  names=["key", "known", "hot", "row", "tag", "first", "units"])

    cuts = rows.join(per_row, ["row", "tag"]).select("id", "text", "row", "tag", "groups").mapInArrow(
        cut_out, "key long, known boolean, hot boolean, row long, tag int, first long, units binary")
    cuts = parked(cuts, "cuts")
    calm = cuts.filter("NOT hot").drop("hot").repartition("key").sortWithinPartitions("key")
    spans = sure.unionByName(calm.mapInArrow(lambda stream: _repeated_runs(stream, unit, length), "row long, tag int, first long, last long"))
    if not cuts.filter("hot").isEmpty():
        spans = spans.unionByName(_counted_windows(cuts.filter("hot"), unit, length))
    return spans.groupBy("row", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _counted_windows(cuts: DataFrame, unit: np.dtype, length: int) -> DataFrame:
    """Repeated windows of keys with very many wholes: a row for each window, counted, joined back."""

    def windows_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Fingerprint(43)
        for batch in batches(stream, "units"):
            data, offsets = text_bytes(batch.column("units"))
            units, at = data.view(unit), offsets // unit.itemsize
            start, text = window_starts(at, length)
            of = pa.array(text)
            first = np.asarray(batch.column("first"))[text] + start - at[text]
            yield pa.record_batch([batch.column("key").take(of), _signed(names.of(names.over(units), start, start + length)), *(batch.column(c).take(of) for c in ("known", "row", "tag")), pa.array(first)],
                                  names=["key", "name", "known", "row", "tag", "first"])

    windows = parked(cuts.select("key", "known", "row", "tag", "first", "units").mapInArrow(windows_of, "key long, name long, known boolean, row long, tag int, first long"), "windows")
    again = windows.groupBy("key", "name").agg(F.count("*").alias("n")).filter("n > 1").select("key", "name")
    return windows.filter("NOT known").join(again, ["key", "name"], "left_semi").select("row", "tag", "first", F.col("first").alias("last"))


def named_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text and the hashes (row, tag) that name a row by its id and text."""
    small_batches(docs.sparkSession)
    i, t = docs[doc_id].alias("id"), docs[text].alias("text")
    both = F.coalesce(docs[doc_id].cast("string"), F.lit("null")), docs[text]
    return docs.select(i, t, F.xxhash64(*both).alias("row"), F.hash(*both).alias("tag"))


def marked(at: np.ndarray, spans: list, length: int) -> np.ndarray:
    """Which units are covered by repeated windows; `spans` has the (first, last) pairs of each text, or None."""
    edges = np.zeros(int(at[-1]) + 1, dtype=np.int32)
    for k, own in enumerate(spans):
        if own:
            pairs = np.array([(s["first"], s["last"]) for s in own], dtype=np.int64) + at[k]
            np.add.at(edges, pairs[:, 0], 1)
            np.add.at(edges, pairs[:, 1] + length, -1)
    return np.cumsum(edges[:-1]) > 0
