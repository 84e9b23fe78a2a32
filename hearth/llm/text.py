"""Helpers shared by the text operators: bytes of Arrow batches as numpy arrays, words and their hashes, scratch tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.sources.scratch import checkpoint_dir

#: Bytes of text that are worked on at once inside a task; a longer text is a batch of its own.
BATCH_BYTES = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
U = np.uint64


#: The finaliser of splitmix64: shifts and factors, fixed values.
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0))
#: Numbers that are worked on at once, so that they stay in a core's cache.
CACHED = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    for shift, factor in MIX:
        x = x ^ (x >> U(shift))
        if factor:
            x = x * U(factor)
    return x


class Ladder:
    """A sequence and the names of its stretches of 2**k units, made when they are asked for and kept while the sequence is short."""

    KEEP = 1 << 22

    def __init__(self, values: np.ndarray, seed: int):
        self.n, self.seed = len(values), U(seed)
        self.bytes = values.dtype == np.uint8
        if self.bytes:  # eight bytes at each place, in one number; zeros behind the end
            padded = np.zeros(self.n + 8, dtype=np.uint8)
            padded[: self.n] = values
            self.units = np.ndarray(self.n + 1, dtype="<u8", buffer=padded, strides=(1,))
        else:
            self.units = values
        self.first = 3 if self.bytes else 0
        self.kept: dict[int, np.ndarray] = {}

    def levels(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, names of the stretches of 2**k units at every place) up to `most`."""
        names = self.kept.get(self.first)
        if names is None:
            names = joined(self.units, self.seed, 1)
        for k in range(self.first, most + 1):
            if k > self.first:
                later = self.kept.get(k)
                names = later if later is not None else joined(names[: max(len(names) - (1 << (k - 1)), 0)], names[1 << (k - 1) :])
            if self.n <= self.KEEP:
                self.kept[k] = names
            yield k, names


def joined(a: np.ndarray, b: np.ndarray, factor: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Names of pairs of names, one after the other: `mix` of a sum, a cache's worth at a time."""
    out = np.empty(len(a), dtype=np.uint64)
    spare = np.empty(min(len(a), CACHED), dtype=np.uint64)
    for low in range(0, len(a), CACHED):
        x = out[low : low + CACHED]
        y = spare[: len(x)]
        np.multiply(a[low : low + CACHED], U(factor), out=x)
        x += b[low : low + CACHED] if isinstance(b, np.ndarray) else b
        for shift, by in MIX:
            np.right_shift(x, U(shift), out=y)
            x ^= y
            if by:
                x *= U(by)
    return out


class Fingerprint:
    """64-bit names of any stretch of a sequence of bytes or 64-bit numbers.

    A stretch is named by its length and the two stretches of 2**k units that begin and end it and together cover it; those are named by their
    halves, with a scrambling at every step.  There is no sum in it, so no structure of a text makes two stretches collide: unlike the running sums
    of a polynomial modulo 2**64, which sequences such as Thue and Morse's defeat whatever the base.
    """

    def __init__(self, seed: int):
        self.seed = int(np.random.default_rng(seed).integers(1, 1 << 63))

    def over(self, values: np.ndarray) -> Ladder:
        return Ladder(values, self.seed)

    def of(self, ladder: Ladder, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The names of the stretches [start, end)."""
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        size = end - start
        low, high = int(size.min()), int(size.max())
        if low == high and low >= (8 if ladder.bytes else 1):
            return joined(self._alike(ladder, start, low), U(self._of_size(low)), 1)
        out = np.zeros(len(size), dtype=np.uint64)
        level = np.where(size > 0, np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1, -1)
        if ladder.bytes:
            short = np.flatnonzero((size > 0) & (size < 8))
            if len(short):  # the bytes themselves
                mask = (U(1) << (U(8) * size[short].astype(np.uint64))) - U(1)
                out[short] = ladder.units[start[short]] & mask
            level[short] = -1
        if level.max() >= 0:
            for k, names in ladder.levels(int(level.max())):
                of = np.flatnonzero(level == k)
                if len(of):
                    out[of] = joined(names[start[of]], names[end[of] - (1 << k)])
        return joined(out, mix(size.astype(np.uint64) + U(self.seed)), 1)

    def _of_size(self, size: int) -> int:
        return int(mix(np.array([size], dtype=np.uint64) + U(self.seed))[0])

    def _alike(self, ladder: Ladder, start: np.ndarray, size: int) -> np.ndarray:
        """Stretches of one size, not yet scrambled with it."""
        k = size.bit_length() - 1
        names = [n for _, n in ladder.levels(k)][-1]
        first, n, rest = int(start[0]), len(start), size - (1 << k)
        if int(start[-1]) - first == n - 1 and (n < 3 or (np.diff(start) == 1).all()):  # side by side
            return joined(names[first : first + n], names[first + rest : first + rest + n])
        return joined(names[start], names[start + rest])


def batches(stream: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `most` bytes of text, a row at least."""
    for batch in stream:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, nulls as empty texts, and where each text starts (one number more than texts)."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the index of each text's first word (one number more than texts)."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    gap = SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate(([True], gap[:-1])) | edge[:-1]
    after = np.concatenate((gap[1:], [True])) | edge[1:]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def text_udf(judge: Callable[[pa.RecordBatch], pa.Array], kind: str) -> Callable:
    """A column function of a text column that is computed in Python, from batches with the one column `text`.

    Only the result comes back from Python: the rows, texts included, stay with Spark.
    """

    def run(texts: pa.Array) -> pa.Array:
        pieces = [judge(b) for b in batches(iter([pa.record_batch([texts], names=["text"])]))]
        return pa.concat_arrays(pieces) if pieces else pa.array([], {"boolean": pa.bool_(), "string": pa.string()}[kind])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go between Spark and Python in batches of `rows` rows at most: the default of 10,000 is made for narrow rows.

    It is a setting of the session; one that is smaller already stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def parked(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read back: computed once, lineage cut, survives lost executors."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Words of a text as an expression; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
