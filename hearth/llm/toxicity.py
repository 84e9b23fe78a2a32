"""Toxicity by a chain of linear classifiers.

The categories are predicted in order.  Each model is a logistic regression over the presence of words, their beginnings and six-byte grams in the
whole text, and over the log-odds the earlier categories got.  In training those come from folds that did not see the row (out-of-fold), so a
later model learns from them as they will be: predicted, not known.  The verdict is the last category, cut where the out-of-fold
predictions are right in `precision` of what they name and find the most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hearth.llm.text import Fingerprint, U, batches, mix, parked, small_batches, text_bytes, text_udf

PLACES = 1 << 22
GRAM = 6
PREFIXES = (5, 6, 7, 8)
LEAST = 4  # rows in which a feature must stand to be chosen
EARLIER = 8.0  # log-odds of earlier categories count up to here, in fitting as in prediction
HASH = Fingerprint(21)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LETTER = np.zeros(256, dtype=bool)
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every word of letters, its beginnings, and every gram inside it; pairs may repeat."""
    low = LOWER[raw]
    inside = LETTER[low]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    sums = HASH.over(low)
    words = HASH.of(sums, starts, ends)
    counts = np.maximum(ends - starts - GRAM, 0)  # grams that are shorter than their word
    long = counts > 0
    counts = np.where(long, counts + 1, 0)
    total = int(counts.sum())
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
    grams = HASH.of(sums, first, first + GRAM) + U(1)
    where, keys = [starts, first], [words, grams]
    for width in PREFIXES:
        longer = starts[ends - starts > width]
        where.append(longer)
        keys.append(HASH.of(sums, longer, longer + width) + U(2))
    return np.searchsorted(at, np.concatenate(where), side="right") - 1, (mix(np.concatenate(keys)) % U(PLACES)).astype(np.int64)


@dataclass(frozen=True)
class Link:
    category: str
    places: np.ndarray  # sorted feature places
    weights: np.ndarray  # one for each place, one for each earlier category, the bias

    def log_odds(self, present: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        n = len(self.places)
        return present @ self.weights[:n] + earlier @ self.weights[n:-1] + self.weights[-1]


@dataclass(frozen=True)
class Chain:
    links: list[Link]
    cut: float

    def log_odds(self, doc: np.ndarray, place: np.ndarray, texts: int) -> np.ndarray:
        """(texts, categories)"""
        out = np.zeros((texts, 0), dtype=np.float32)
        for link in self.links:
            out = np.column_stack((out, link.log_odds(_present(doc, place, link.places, texts), np.clip(out, -EARLIER, EARLIER))))
        return out


def _present(doc: np.ndarray, place: np.ndarray, chosen: np.ndarray, texts: int) -> np.ndarray:
    out = np.zeros((texts, len(chosen)), dtype=np.float32)
    if len(chosen) and len(place):
        k = np.minimum(np.searchsorted(chosen, place), len(chosen) - 1)
        hit = chosen[k] == place
        out[doc[hit], k[hit]] = 1.0
    return out


def _choose(doc: np.ndarray, place: np.ndarray, y: np.ndarray, rows: np.ndarray, most: int, least: int) -> np.ndarray:
    """Places whose presence says most about y: by the signed root of the likelihood ratio, in `least` rows or more."""
    live = rows[doc]
    d, p = doc[live], place[live]
    found, which = np.unique(p, return_inverse=True)
    inside = np.bincount(which, minlength=len(found))
    positive = np.bincount(which, y[d], minlength=len(found))
    rate = max(y[rows].mean(), 1e-6)
    seen = np.maximum(inside, 1)
    share = np.clip(positive / seen, 1e-9, 1 - 1e-9)
    gain = inside * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / max(1 - rate, 1e-9)))
    gain = np.where(inside >= least, np.where(share > rate, gain, 0.3 * gain), -1.0)
    order = np.argsort(-gain, kind="stable")[:most]
    return np.sort(found[order[gain[order] > 2.0]])


def _train(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, steps: int = 150) -> np.ndarray:
    """Weights of a logistic regression with squared penalties, by accelerated gradient steps."""
    n = max(len(y), 1)
    x = x.astype(np.float64)
    v = np.ones(x.shape[1]) / np.sqrt(max(x.shape[1], 1))
    for _ in range(12):  # the largest curvature sets the step
        v = x.T @ (x @ v)
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    step = 1.0 / (0.25 * size / n + penalty.max() / n + 1e-9)
    w = z = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ z, -30, 30)))
        later = z - step * ((x.T @ (p - y)) + penalty * z) / n
        z = later + k / (k + 3.0) * (later - w)
        w = later
    return w


def _link(category: str, doc, place, y, rows, earlier, most: int, least: int) -> Link:
    chosen = _choose(doc, place, y, rows, most, least)
    x = np.column_stack((_present(doc, place, chosen, len(y))[rows], np.clip(earlier[rows], -EARLIER, EARLIER) / EARLIER, np.ones(rows.sum(), dtype=np.float32)))
    penalty = np.concatenate((np.full(len(chosen), 0.3), np.full(earlier.shape[1], 0.3), [1e-3]))
    w = _train(x, y[rows].astype(float), penalty).astype(np.float32)
    w[len(chosen) : -1] /= EARLIER
    return Link(category, chosen, w)


def fit_chain(doc: np.ndarray, place: np.ndarray, marks: dict[str, np.ndarray], folds: int = 4, most: int = 768, least: int = LEAST, precision: float = 0.97) -> Chain:
    """A chain over the categories in the order given; doc, place: the (repeat-free) features of the labelled rows."""
    n = len(next(iter(marks.values())))
    fold = np.arange(n) % folds
    everything = np.ones(n, dtype=bool)
    earlier = np.zeros((n, 0), dtype=np.float32)
    links = []
    for category, y in marks.items():
        held = np.zeros(n, dtype=np.float32)
        for f in range(folds):
            link = _link(category, doc, place, y, fold != f, earlier, most, least)
            held[fold == f] = link.log_odds(_present(doc, place, link.places, n), np.clip(earlier, -EARLIER, EARLIER))[fold == f]
        links.append(_link(category, doc, place, y, everything, earlier, most, least))
        earlier = np.column_stack((earlier, held))
    order = np.argsort(-earlier[:, -1], kind="stable")
    hits = np.cumsum(y[order])
    good = hits >= precision * np.arange(1, n + 1)
    cut = float(earlier[order[np.flatnonzero(good)[-1]], -1]) if good.any() else np.inf
    return Chain(links, max(cut, -1.0))


def sampled(train: DataFrame, categories: list[str], most_labels: int = 5000, least: int = LEAST) -> DataFrame:
    """What a chain is fitted on: places (features that stand in `least` rows or more), id and the categories of the sample, one row each.

    Rows with a null id or mark are not used, an id that is there twice counts once.  The `most_labels` rows with the least hash of their id are taken.
    """
    small_batches(train.sparkSession)
    usable = train.dropna(subset=["id", *categories])
    ids = parked(usable.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most_labels), "sample")

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            d, p = features(*text_bytes(batch.column("text")))
            both = np.unique(d * PLACES + p)
            cut = np.searchsorted(both // PLACES, np.arange(batch.num_rows + 1)).astype(np.int32)
            places = pa.ListArray.from_arrays(cut, pa.array((both % PLACES).astype(np.int32)))
            yield pa.record_batch([places, *(batch.column(c) for c in ("id", *categories))], names=["places", "id", *categories])

    marks = [F.col(c).cast("int").alias(c) for c in categories]
    some = usable.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*marks, "text")).alias("row")).select("id", "row.*")
    kind = some.schema["id"].dataType.simpleString()
    rows = parked(some.mapInArrow(gather, f"places array<int>, id {kind}, " + ", ".join(f"{c} int" for c in categories)), "features")

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, dtype=np.int32)
        for batch in stream:
            place, once = np.unique(np.asarray(batch.column("places").flatten()), return_counts=True)
            n[place] += once.astype(np.int32)
        place = np.flatnonzero(n).astype(np.int32)
        for a in range(0, len(place), 1 << 16):
            yield pa.record_batch([pa.array(place[a : a + (1 << 16)]), pa.array(n[place[a : a + (1 << 16)]])], names=["place", "n"])

    # most features stand in one text and none of them is chosen: they stay in Spark
    sums = rows.select("places").mapInArrow(count, "place int, n int").groupBy("place").agg(F.sum("n").alias("n"))
    frequent = sums.filter(F.col("n") >= least).select("place").toArrow().column("place")
    often = np.zeros(PLACES, dtype=bool)
    often[np.asarray(frequent)] = True
    shared = train.sparkSession.sparkContext.broadcast(np.packbits(often))

    def thinned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in stream:
            lists = batch.column("places")
            place = np.asarray(lists.flatten())
            stays = wanted[place]
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists)))
            cut = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], ends))].astype(np.int32)
            yield pa.record_batch([pa.ListArray.from_arrays(cut, pa.array(place[stays])), *batch.columns[1:]], names=batch.schema.names)

    return rows.mapInArrow(thinned, rows.schema)


def learned(train: DataFrame, categories: list[str], most_labels: int = 5000, **fitting) -> Chain | None:
    """A chain from rows (id, text, a 0/1 column for each category); None without a usable row.

    `most_labels` bounds the sample and with it the one task that fits it; the driver gets the weights alone.
    """
    sample = sampled(train, categories, most_labels, fitting.get("least", LEAST))
    schema = to_arrow_schema(sample.schema)

    def fit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of the sample, in one task: the driver gets the weights alone."""
        found = pa.Table.from_batches(list(stream), schema)
        if not found.num_rows:
            return
        marks = {c: np.asarray(found.column(c)).astype(np.int64) for c in categories}
        lists = found.column("places").combine_chunks()
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), np.asarray(pa.compute.list_value_length(lists)))
        chain = fit_chain(doc, np.asarray(lists.flatten()), marks, **fitting)
        for link in chain.links:
            yield pa.record_batch([pa.array([link.category]), pa.array([link.places.astype(np.int64)]), pa.array([link.weights.astype(np.float64)]), pa.array([chain.cut])], names=["category", "places", "weights", "cut"])

    whole = sample.repartition(1).sortWithinPartitions("id")
    links = {r.category: r for r in whole.mapInArrow(fit, "category string, places array<long>, weights array<double>, cut double").collect()}
    if not links:
        return None
    return Chain([Link(c, np.array(links[c].places, dtype=np.int32), np.array(links[c].weights, dtype=np.float32)) for c in categories], links[categories[0]].cut)


def _judged(chain: Chain | None, column: pa.Array, categories: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities by category, verdict) of a text column."""
    n = len(column)
    if chain is None:
        return np.zeros((n, len(categories))), np.zeros(n, dtype=bool)
    raw, at = text_bytes(column)
    odds = chain.log_odds(*features(raw, at), n)
    full = np.diff(at) > 0
    p = np.where(full[:, None], 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30).astype(float))), 0.0)
    return p, full & (odds[:, -1] >= chain.cut)


def toxicity(docs: DataFrame, train: DataFrame, categories: list[str], doc_id: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """One row per row of `docs`: doc_id, p_<category> for each of `categories` (probabilities), score (the last), toxic.

    `train` is what `learned` takes.  Null and empty texts get probability 0 and are not toxic, and so does everything when there is nothing
    to learn from.  Null ids stay; repeated rows are judged alike; other columns are ignored; an empty table gives an empty one.  No
    shuffle after fitting.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned(train, categories, **fitting))

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            p, toxic = _judged(shared.value, batch.column("text"), categories)
            yield pa.record_batch([batch.column("id"), *(pa.array(p[:, k]) for k in range(len(categories))), pa.array(p[:, -1]), pa.array(toxic)],
                                  names=["doc_id", *(f"p_{c}" for c in categories), "score", "toxic"])

    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    out = ", ".join(f"p_{c} double" for c in categories)
    return rows.mapInArrow(judge, f"doc_id {rows.schema['id'].dataType.simpleString()}, {out}, score double, toxic boolean")


def without_toxic(docs: DataFrame, train: DataFrame, categories: list[str], text: str = "text", **fitting) -> DataFrame:
    """`docs`, all columns, without the rows whose text is toxic.

    Rows with a null or empty text stay, repeated rows fare alike, and without labels all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned(train, categories, **fitting))

    clean = text_udf(lambda batch: pa.array(~_judged(shared.value, batch.column("text"), categories)[1]), "boolean")
    return docs.filter(clean(docs[text]))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """Training rows from documents and labels (doc_id, quality, toxic): toxic within junk, toxic within prose, toxic at all."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("any_toxic"), F.min("quality").alias("good")).select(
        F.col("doc_id").alias("id"), ((F.col("any_toxic") == 1) & (F.col("good") == 0)).alias("toxic_junk"),
        ((F.col("any_toxic") == 1) & (F.coalesce("good", F.lit(1)) == 1)).alias("toxic_prose"), (F.col("any_toxic") == 1).alias("any_toxic"))
    marks = marks.withColumn("toxic_junk", F.coalesce("toxic_junk", F.lit(False)))
    return docs.select(F.col("doc_id").alias("id"), "text").join(marks, "id"), ["toxic_junk", "toxic_prose", "any_toxic"]
