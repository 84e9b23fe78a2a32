"""Tokens of two tokenizers aligned on the bytes they cover, by products of sparse incidence matrices.

A is the matrix of the first tokenizer's tokens (rows) and the bytes of the text (columns), B that of the second.  Row i of A Bᵀ then holds, for
every token of B that shares bytes with token i, how many they share.  Two tokens *end together* if they overlap and their last byte is
the same one; such ends cut both sequences into groups, and G_A G_Bᵀ of the token-group matrices holds all pairs inside a group.  Matrices are kept
in rows (CSR) and multiplied row by row (Gustavson): each entry of a row of the left matrix brings in one row of the right matrix.

The documents of a batch are laid end to end, so one product serves them all: no block reaches into another.

Which id pairs can end together is known from the vocabularies alone: the bytes of one must be the end of the other's.  There are fewer
such pairs than bytes in both vocabularies (twice as many where a byte has two ids), whatever the corpus, so their counts fit any task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.text import batches, parked, small_batches

#: Products are taken in blocks of rows with about so many terms.
TERMS = 1 << 20
#: The pattern by which the byte-level tokenizer cuts a text into words, a fixed value of it.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: One run of blanks of this length is more than that pattern's matcher bears; such texts take the slower library.
WIDE_GAP = re.compile(r"\s{100000}")


# ---- sparse matrices -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Csr:
    """Rows of a sparse matrix of counts: row r holds `values` at `columns`, from starts[r] up to starts[r + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.zeros(self.width + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=starts[1:])
        return Csr(starts, rows[order], self.values[order], self.height)


def spans(lengths: np.ndarray) -> Csr:
    """Tokens in order against the bytes they cover."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    total = int(starts[-1])
    return Csr(starts, np.arange(total), np.ones(total, dtype=np.int64), total)


def belongs(group: np.ndarray, groups: int) -> Csr:
    """Tokens against the one group each is in."""
    n = len(group)
    return Csr(np.arange(n + 1), group, np.ones(n, dtype=np.int64), groups)


def product(left: Csr, right: Csr, terms: int = TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of left x right in order, a block of rows at a time.

    A block has `terms` terms at most; a single row with more is cut at its columns' bands, so that memory stays bounded.
    """
    reach = np.diff(right.starts)[left.columns]  # terms that each entry of the left matrix brings in
    upto = np.concatenate(([0], np.cumsum(reach)))
    row_upto = upto[left.starts]
    row = 0
    while row < left.height:
        to = max(row + 1, int(np.searchsorted(row_upto, row_upto[row] + terms, side="right")) - 1)
        if row_upto[to] - row_upto[row] <= terms:
            yield _block(left, right, reach, row, to, 0, right.width)
        else:
            band = max(1, int(right.width * terms // (row_upto[to] - row_upto[row])))
            for low in range(0, right.width, band):
                yield _block(left, right, reach, row, to, low, low + band)
        row = to


def _block(left: Csr, right: Csr, reach: np.ndarray, row: int, to: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = left.starts[row], left.starts[to]
    own = left.columns[a:b]
    first, n = right.starts[own], reach[a:b]
    if low > 0 or high < right.width:  # the band's part of each of the rows that come in; their columns are in order
        last = first + n
        first = _lower(right.columns, first, last, low)
        n = _lower(right.columns, first, last, high) - first
    rows = np.repeat(np.repeat(np.arange(row, to), np.diff(left.starts[row : to + 1])), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    columns, values = right.columns[at], np.repeat(left.values[a:b], n) * right.values[at]
    if len(rows) and ((np.diff(rows) < 0) | ((np.diff(rows) == 0) & (np.diff(columns) < 0))).any():
        order = np.lexsort((columns, rows))
        rows, columns, values = rows[order], columns[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
    begin = np.flatnonzero(new)
    return rows[begin], columns[begin], np.add.reduceat(values, begin) if len(begin) else values


def _lower(sequence: np.ndarray, first: np.ndarray, last: np.ndarray, value: int) -> np.ndarray:
    """For each stretch [first, last) of ascending numbers the first place that holds `value` or more."""
    low, high = first.copy(), last.copy()
    while (low < high).any():
        mid = (low + high) // 2
        less = (low < high) & (sequence[np.minimum(mid, len(sequence) - 1)] < value)
        low = np.where(less, mid + 1, low)
        high = np.where(~less & (low < high), mid, high)
    return low


# ---- vocabularies --------------------------------------------------------------------------------------
def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        with open(a_path, encoding="utf-8") as file:
            found = json.load(file)
        special = {t["content"] for t in found["added_tokens"]}
        letters = _byte_letters()
        entries = {i: bytes(letters[c] for c in piece) for piece, i in found["model"]["vocab"].items() if piece not in special}
        # the vocabulary is in the order of its merges, so ids are ranks
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_table, self.b_table = (np.array(of, dtype=object) for of in (self.a_bytes, self.b_bytes))
        self.a_lengths = np.array([len(t) for t in self.a_bytes])
        self.b_lengths = np.array([len(t) for t in self.b_bytes])
        self.pairs = self._pairs()
        # ids as they are written in a digest, with what may follow them: 3 * id + (0: the same side goes on, 1: the other side, 2: the next group)
        size = max(len(self.a_bytes), len(self.b_bytes))
        self.written = np.empty(3 * size, dtype=object)
        self.written[:] = [f"{i}{mark}".encode() for i in range(size) for mark in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def _pairs(self) -> np.ndarray:
        """a * |B| + b, ascending, of all ids of which one's bytes are the end of the other's."""
        own_a, own_b = ({}, {})
        for names, of in ((own_a, self.a_bytes), (own_b, self.b_bytes)):
            for i, token in enumerate(of):
                if token:
                    names.setdefault(token, []).append(i)
        size, found = len(self.b_bytes), set()
        for token, ids in own_a.items():
            found.update(a * size + b for k in range(len(token)) for b in own_b.get(token[k:], ()) for a in ids)
        for token, ids in own_b.items():
            found.update(a * size + b for k in range(len(token)) for a in own_a.get(token[k:], ()) for b in ids)
        return np.array(sorted(found), dtype=np.int64)

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where id pairs that end together stand among all that can."""
        return np.searchsorted(self.pairs, a.astype(np.int64) * len(self.b_bytes) + b)

    def encode_a(self, text: str) -> np.ndarray:
        if WIDE_GAP.search(text):
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self.a_path)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


# ---- the tokens of a batch -----------------------------------------------------------------------------
class Aligned:
    """The tokens of a batch of texts, one text after another, and the products over them.

    a, b: ids.  a_first, b_first: where each text's tokens begin (one number more than texts).
    """

    def __init__(self, names: Vocabularies, texts: list[str | None]):
        self.names = names
        a, b = [], []
        for text, pieces in zip(texts, names.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            mine = names.encode_a(" " + text) if text else np.zeros(0, dtype=np.int64)
            other = np.array(pieces if text else [], dtype=np.int64)
            line = b" " + text.encode() if text else b""
            whole = all(b"".join(of[ids].tolist()) == line for of, ids in ((names.a_table, mine), (names.b_table, other)))
            a.append(mine if whole else mine[:0])
            b.append(other if whole else other[:0])
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.a_first, self.b_first = (np.concatenate(([0], np.cumsum([len(t) for t in ids]))) for ids in (a, b))
        a_length, b_length = names.a_lengths[self.a], names.b_lengths[self.b]
        self.a_spans, self.b_spans = spans(a_length), spans(b_length)
        self.a_end, self.b_end = np.cumsum(a_length), np.cumsum(b_length)
        ends = [(i[same], j[same]) for i, j, _ in self.overlaps() for same in [self.a_end[i] == self.b_end[j]]]
        none = np.zeros(0, dtype=np.int64)
        #: tokens that end together
        self.link_a, self.link_b = (np.concatenate([e[k] for e in ends] or [none]) for k in (0, 1))
        cuts = self.a_end[self.link_a]
        self.a_group, self.b_group = np.searchsorted(cuts, self.a_end), np.searchsorted(cuts, self.b_end)
        self.groups = len(cuts)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, bytes they share)"""
        return product(self.a_spans, self.b_spans.transposed())

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, 1) of all pairs inside a group; a group's pairs are as many as its sides multiplied."""
        return product(belongs(self.a_group, self.groups), belongs(self.b_group, self.groups).transposed())

    def digests(self) -> list[str]:
        """Of each text the digest of its groups, written a1,a2|b1;a3|b2,b3; an empty one without tokens."""
        # a group's tokens of A come first, then those of B
        a_at = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group, side="left")
        b_at = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, side="right")
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        a_mark, b_mark = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        a_mark[self.link_a], b_mark[self.link_b] = 1, 2
        codes[a_at], codes[b_at] = 3 * self.a + a_mark, 3 * self.b + b_mark
        written = self.names.written[codes].tolist()
        first = (self.a_first + self.b_first).tolist()
        return [hashlib.sha256(b"".join(written[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(first, first[1:])]


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def _texts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def token_links(docs: DataFrame, kind: str = "overlap", a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per link: doc_id, a, b (numbers of the tokens in their text, from 0), a_id, b_id, n_bytes.

    kind: "overlap" (they share n_bytes bytes), "end" (they overlap and end together) or "group" (they are in one group; n_bytes is null).
    Texts that are null, empty or not given back whole by both vocabularies have no links.  Repeated rows and null ids are documents like others.
    """
    paths, (rows, id_type) = _paths(a_path, b_path), _texts(docs, doc_id, text)

    def links(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = Aligned(vocabularies(*paths), batch.column("text").to_pylist())
            for i, j, n in found.shared() if kind == "group" else found.overlaps():
                keep = found.a_end[i] == found.b_end[j] if kind == "end" else np.ones(len(i), dtype=bool)
                i, j, n = i[keep], j[keep], n[keep]
                doc = np.searchsorted(found.a_first, i, side="right") - 1
                yield pa.record_batch([
                    batch.column("id").take(pa.array(doc)), pa.array(i - found.a_first[doc]), pa.array(j - found.b_first[doc]), pa.array(found.a[i]), pa.array(found.b[j]),
                    pa.nulls(len(n), pa.int64()) if kind == "group" else pa.array(n)], names=["doc_id", "a", "b", "a_id", "b_id", "n_bytes"])

    return rows.mapInArrow(links, f"doc_id {id_type}, a long, b long, a_id long, b_id long, n_bytes long")


def token_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b (tokens), n_groups, groups_sha256, n_links (pairs that end together), n_best (links whose id
    pair is the most frequent of its B id in all of `docs`, ties included) and count_sum (how often the id pairs of its links are linked in all of `docs`).

    A encodes a blank and the text, B the text.  A text has no tokens (zeros, an empty digest) if it is null or empty, or if the bytes of either's
    tokens are not the blank and the text.  Null ids stay; repeated rows are counted each; other columns are ignored; an empty table gives an
    empty one.

    Texts are encoded once; their links are written as numbers of id pairs, counted, and read again with the counts, which are broadcast: there are
    fewer pairs than twice the bytes of both vocabularies.  A task holds half a megabyte of text, or one text.
    """
    paths, (rows, id_type) = _paths(a_path, b_path), _texts(docs, doc_id, text)

    def align(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabularies(*paths)
        for batch in batches(stream):
            found = Aligned(names, batch.column("text").to_pylist())
            cut = np.searchsorted(found.link_a, found.a_first).astype(np.int32)
            links = pa.ListArray.from_arrays(cut, pa.array(names.place(found.a[found.link_a], found.b[found.link_b]).astype(np.int32)))
            yield pa.record_batch([
                batch.column("id"), pa.array(np.diff(found.a_first)), pa.array(np.diff(found.b_first)), pa.array(np.diff(cut).astype(np.int64)), pa.array(found.digests()), links],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    made = parked(rows.mapInArrow(align, f"doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"), "links")

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabularies(*paths).pairs), dtype=np.int64)
        for batch in stream:
            total += np.bincount(np.asarray(batch.column("links").flatten()), minlength=len(total))
        pair = np.flatnonzero(total)
        for k in range(0, len(pair), 1 << 16):
            part = pair[k : k + (1 << 16)]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["pair", "n"])

    counts = made.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(counts.column("pair")), np.asarray(counts.column("n"))))

    def weigh(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabularies(*paths)
        of, best = np.zeros(len(names.pairs), dtype=np.int64), np.zeros(len(names.b_bytes), dtype=np.int64)
        of[shared.value[0]] = shared.value[1]
        b = names.pairs % len(names.b_bytes)
        np.maximum.at(best, b, of)
        is_best = of == best[b]
        for batch in stream:
            links = batch.column("links")
            pair = np.asarray(links.flatten())
            n = np.asarray(pa.compute.list_value_length(links)).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(n)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[pair])))[upto]) for v in (is_best.astype(np.int64), of)]
            yield pa.record_batch([*batch.columns[:5], pa.array(n), *map(pa.array, sums)], names=[*batch.schema.names[:5], "n_links", "n_best", "count_sum"])

    return made.mapInArrow(weigh, f"doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
