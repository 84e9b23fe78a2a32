"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

Every text becomes a vector of 1- to 3-byte grams of its letters (ASCII upper case folded, everything that is no letter a blank),
hashed into `DIM` places, weighed by 1 + log(count) and inverse document frequency and scaled to length one.  Each language has
several centroids, found by spherical k-means over its sample; a text takes the language of the centroid with the largest cosine.
A text farther from every centroid than nearly all training texts of that language were is `rejected`.

Document frequencies cover all training documents; only the centroids are fitted on a sample, `per_lang` texts a language at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.text import U, batches, mix, parked, small_batches, text_bytes

DIM = 1 << 13

FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def gram_counts(raw: np.ndarray, at: np.ndarray, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, count) of all grams of all texts, ordered by text and place."""
    n, texts = len(raw), len(at) - 1
    code = FOLD[raw].astype(np.uint32)
    blank = np.uint32(0x20)
    doc = np.repeat(np.arange(texts, dtype=np.int64), np.diff(at))
    place = np.arange(n)
    one = np.where(place >= at[doc] + 1, np.concatenate(([blank], code[:-1])) if n else code, blank)
    two = np.where(place >= at[doc] + 2, np.concatenate(([blank, blank], code[:-2]))[:n] if n else code, blank)
    spaced = (code == blank) & (one == blank)  # a run of blanks counts once
    keys = []
    for width, gram in ((1, code), (2, one << 8 | code), (3, two << 16 | one << 8 | code)):
        keys.append(doc[~spaced] * dim + (mix(gram[~spaced].astype(np.uint64) + U(width << 32)) % U(dim)).astype(np.int64))
    counts = np.bincount(np.concatenate(keys), minlength=texts * dim) if n else np.zeros(texts * dim, dtype=np.int64)
    found = np.flatnonzero(counts)
    return found // dim, found % dim, counts[found]


@dataclass(frozen=True)
class Centroids:
    langs: list[str]  # of each centroid
    rows: np.ndarray  # (centroids, DIM), of length one
    idf: np.ndarray
    least: np.ndarray  # the cosine below which a text is rejected, of each centroid

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc, place, count = gram_counts(raw, at, len(self.idf))
        texts = len(at) - 1
        weight = (1.0 + np.log(count)) * self.idf[place]
        length = np.sqrt(np.bincount(doc, weight * weight, minlength=texts))
        dense = np.zeros((texts, len(self.idf)), dtype=np.float32)
        dense[doc, place] = weight / np.maximum(length, 1e-12)[doc]
        return dense @ self.rows.T.astype(np.float32)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; the first centres are far apart."""
    centres = [x.mean(axis=0)]
    near = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(train: DataFrame, clusters: int = 3, per_lang: int = 300, most_rows: int = 120_000, reject: float = 0.002, dim: int = DIM) -> Centroids | None:
    """Centroids from rows (id, text, lang).  None without a usable row.

    Every language is learned.  The sample holds the `per_lang` rows of each with the least hash of their id, or an equal share of `most_rows` where
    there are so many languages that this is less (one row at least): a bound on what reaches the driver, about 10 KB a row.  `reject` is the share of
    a language's sample that may lie below its threshold.
    """
    spark = train.sparkSession
    train = train.filter("lang IS NOT NULL")
    langs = sorted(r.lang for r in train.select("lang").distinct().collect())
    if not langs:
        return None
    each = max(1, min(per_lang, most_rows // len(langs)))

    def frequencies(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(dim + 1, dtype=np.int64), 0
        for batch in batches(stream):
            raw, at = text_bytes(batch.column("text"))
            _, place, _ = gram_counts(raw, at, dim)
            found[:dim] += np.bincount(place, minlength=dim)
            texts += batch.num_rows
        found[dim] = texts
        yield pa.record_batch([pa.array(np.arange(dim + 1)), pa.array(found)], names=["place", "n"])

    df = np.zeros(dim + 1)
    for r in train.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r.place] = r.n
    idf = np.log((1.0 + df[dim]) / (1.0 + df[:dim])) + 1.0

    def vectors(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            raw, at = text_bytes(batch.column("text"))
            doc, place, count = gram_counts(raw, at, dim)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            cells = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (place, count)]
            yield pa.record_batch([batch.column("lang"), *cells], names=["lang", "place", "n"])

    # the ids first, so that only the sample's texts are read whole
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = train.select("id", "lang", rank.alias("rank")).filter(F.col("rank") <= each)
    ids = parked(picked.select("id").distinct(), "sample")
    one_each = train.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.*")
    sample = one_each.mapInArrow(vectors, "lang string, place array<int>, n array<int>").collect()
    names, rows, least = [], [], []
    for lang in langs:
        own = [r for r in sample if r.lang == lang and r.place]
        if not own:
            continue
        x = np.zeros((len(own), dim), dtype=np.float32)
        for j, r in enumerate(own):
            at = np.array(r.place, dtype=np.int64)
            x[j, at] = (1.0 + np.log(np.array(r.n))) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _k_means(x, clusters, 12, 7)
        names += [lang] * len(c)
        rows.append(c)
        least += [float(np.quantile((x @ c.T).max(axis=1), reject)) * 0.9] * len(c)
    if not names:
        return None
    return Centroids(names, np.concatenate(rows), idf, np.array(least))


def language_id(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score (the largest cosine, 0 to 1), rejected, margin (to the next language).

    `train` has columns id, text and lang and is all that is learned from.  lang_pred is the nearest centroid's language, also where
    the distance rule rejects; callers that want abstention filter on `rejected`.  Texts that are null or hold no letter, and every text
    when nothing could be learned, get `und`, score 0 and rejected.  Null ids stay; repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty one.  One pass without shuffle after fitting.
    """
    small_batches(docs.sparkSession)
    model = fit(train, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches(stream):
            texts = batch.column("text").to_pylist()
            usable = np.array([t is not None and has_letter(t) for t in texts])
            n = len(texts)
            lang, score, margin, far = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
            if known is not None and usable.any():
                raw, at = text_bytes(batch.column("text"))
                cos = np.clip(known.scores(raw, at).astype(float), 0.0, 1.0)
                best = np.argmax(cos, axis=1)
                names = np.array(known.langs, dtype=object)
                rest = np.where(names[None, :] == names[best][:, None], -1.0, cos).max(axis=1)
                score = np.where(usable, cos[np.arange(n), best], 0.0)
                lang = np.where(usable, names[best], "und")
                margin = np.where(usable, score - np.maximum(rest, 0.0), 0.0)
                far = ~usable | (score < known.least[best])
            yield pa.record_batch([batch.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(far), pa.array(margin)],
                                  names=["doc_id", "lang_pred", "score", "rejected", "margin"])

    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double, rejected boolean, margin double")
