"""Token counts of whole texts by a public SentencePiece model; huge texts are encoded in overlapping chunks and spliced.

A chunk border may split a token and so shift its neighbours.  Chunks therefore overlap, and two neighbours are joined at a
*stable* place of the overlap: one that no piece of the vocabulary can bridge.  A merge never crosses such a place, so what
stands on either side of it is encoded alike in the chunk and in the whole text.  Both chunks must also show a token border
there.  If the overlap has no such place, it is doubled, in the end up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearth.llm.text import batches, small_batches

BLANK = "▁"  # how the library writes a blank inside a piece


@lru_cache(maxsize=4)
def _loaded(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bridged = {piece[k - 1] for piece in map(model.id_to_piece, range(model.get_piece_size())) for k in range(1, len(piece)) if piece[k] == BLANK}
    return model, bridged


def _stable(text: str, k: int, bridged: set[str]) -> bool:
    """Whether the blank at k starts a new token for certain: no piece holds the character before it followed by a blank."""
    return text[k] == " " and text[k - 1] not in bridged and text[k - 1] not in (" ", BLANK) and not text[k - 1].isspace()


def _pieces(model, text: str, start: int, end: int) -> list[int]:
    """Where in the text the tokens of a chunk begin, in characters; the library counts bytes."""
    raw = np.frombuffer(text[start:end].encode() + b" ", dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1 + start
    return char[[p.begin for p in model.encode(text[start:end], return_type="proto").pieces]].tolist()


def chunked_count(model, bridged: set[str], text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text of any length, encoding `chunk` characters at a time."""
    start, end, total, floor = 0, min(chunk, len(text)), 0, 0
    begins = _pieces(model, text, start, end)
    while end < len(text):
        wide = overlap
        while True:
            back = max(start, end - wide)
            to = min(len(text), end + chunk)
            later = _pieces(model, text, back, to)
            left, right = set(begins), set(later)
            cut = next((k for k in range(end - 1, max(back, floor, 0), -1) if _stable(text, k, bridged) and k in left and k in right), None)
            if cut is not None or back == start:
                break
            wide *= 2
        if cut is None:  # nothing to splice at: one longer chunk in place of two
            begins, end = _pieces(model, text, start, to), to
            continue
        total += sum(b < cut for b in begins)
        # from the cut on, the later chunk holds
        # the library puts a blank before a chunk: for a chunk from cut + 1 it stands for the one at the cut
        begins, start, end, floor = [b for b in later if b >= cut], cut + 1, to, cut
    return total + len(begins)


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096, chunk: int = 1 << 16, overlap: int = 512,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have 0 bytes and 0 tokens.  A null doc_id stays null; repeated rows are counted each; an empty table
    gives an empty one.  Other columns are ignored.  Texts longer than `chunk` characters go through overlapping chunks.
    No shuffle; a task holds one batch of half a megabyte, or one text.
    """
    small_batches(docs.sparkSession)
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bridged = _loaded(model_path)
        for batch in batches(stream):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            tokens = [0] * len(texts)
            for k, ids in zip(short, model.encode([texts[k] for k in short], num_threads=1), strict=True):
                tokens[k] = len(ids)
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    tokens[k] = chunked_count(model, bridged, t, chunk, overlap)
            n = pa.array(tokens, pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.record_batch([batch.column("id"), size, n, pa.compute.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
