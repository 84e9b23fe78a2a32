"""Documents linked by the Jaccard similarity of their word shingles, and the classes the links form.

Equal sets are one *node*.  Tokens (shingles) are ordered: rare ones first, frequent ones last, by hash within.  If two sets are similar
enough, the prefixes of n - ceil(t n) + k tokens share k tokens at least.  The index keys of a set are

* its rare tokens in the prefix, each alone;
* for short sets the pairs of its frequent tokens in the prefix extended to k = 2 (two sets that share no rare prefix token share two
  frequent ones); long sets would have too many pairs and index their frequent prefix tokens alone.  Sets at the border are in both.

A token is frequent if it stands in the prefixes of more than 1 in `RARE` documents (64 at least): at most `RARE` times a mean prefix of them.

Sets with a common key are not paired off.  Each round compares every member of a key with one leader of its size band and of the bands beside
it; verified links join classes, and keys inside one class are done.  Rounds with other leaders follow while one pair in ten is a link; then the
pairs that are left, of a key but of different classes and not refuted by their sizes or by bits that bound how many tokens they differ in,
are verified one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.repeats import _filter, _passes, _signed
from hearth.llm.text import Fingerprint, U, batches, mix, parked, small_batches, text_bytes, word_spans

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORDS, SEQUENCES = Fingerprint(71), Fingerprint(72)
SHORT_PREFIX = 16
RARE = 4096
LEAST_FREQUENT = 64
PARITY, FIRSTS = 8, 8
BITS = [f"b{k}" for k in range(PARITY)]
GROUP = 256  # members of a leader that one task compares, about


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after another, each ordered by name, and where each begins (one number more than texts)."""
    starts, ends, first = word_spans(raw, at)
    names = WORDS.of(WORDS.over(LOWER[raw]), starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][text]
    tokens = SEQUENCES.of(SEQUENCES.over(names), start, start + np.minimum(n, width)[text])
    order = np.lexsort((tokens, text))
    tokens, text = tokens[order], text[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    tokens, text = tokens[new], text[new]
    return tokens, np.searchsorted(text, np.arange(len(n) + 1))


def set_names(tokens: np.ndarray, cut: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([U(0)], np.cumsum(mix(tokens + U(1)))))
    return mix(sums[cut[1:]] - sums[cut[:-1]] + np.diff(cut).astype(np.uint64))


def parity_words(tokens: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """PARITY 64-bit words of each set: every token turns one of 64 * PARITY bits over.

    Two sets that differ in d tokens differ in d bits at most.
    """
    place = mix(tokens + U(7)) % U(64 * PARITY)
    word, bit = (place >> U(6)).astype(np.int64), U(1) << (place & U(63))
    full = np.flatnonzero(np.diff(cut) > 0)
    out = []
    for w in range(PARITY):
        own = np.zeros(len(cut) - 1, dtype=np.uint64)
        if len(full):
            own[full] = np.bitwise_xor.reduceat(np.where(word == w, bit, U(0)), cut[:-1][full])
        out.append(own)
    return out


def wide_parity(tokens: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """For each set as many bits as it has tokens (a power of two, 64 at least); every token turns one over.

    A set of twice the size can be compared with: one half of its bits turned over by the other are the bits it would have had.
    """
    n = np.diff(cut)
    size = np.maximum(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64)
    first = np.concatenate(([0], np.cumsum(size)))
    which = np.repeat(np.arange(len(n)), n)
    place = first[which] + (mix(tokens[: int(cut[-1])] + U(9)) & (size[which] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(first[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many tokens two sets differ at least, by their wide parities."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_size(n: np.ndarray, pct: int, k: int) -> np.ndarray:
    return np.minimum(n, n + (-pct * n) // 100 + k)


def _heads(tokens: np.ndarray, cut: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` tokens of each set: (token, set)."""
    which = np.repeat(np.arange(len(size)), size)
    position = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return tokens[cut[:-1][which] + position], which


def index_keys(tokens: np.ndarray, cut: np.ndarray, frequent: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of all sets; `frequent` is ordered."""
    n = np.diff(cut)
    short = SHORT_PREFIX * 100 // (100 - pct)  # so that a short set has few pairs
    if len(frequent) and len(tokens):
        text = np.repeat(np.arange(len(n)), n)
        k = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[k] == tokens
        order = np.lexsort((tokens, common, text))
        tokens, common = tokens[order], common[order]
    else:
        common = np.zeros(len(tokens), dtype=bool)
    keys, sets = [], []
    small = np.where((n <= short) & (n > 1), prefix_size(n, pct, 2), 0)
    token, which = _heads(tokens, cut, small)
    often = _heads(common, cut, small)[0]
    keys.append(mix(token[~often]))
    sets.append(which[~often])
    token, which = token[often], which[often]
    for d in range(1, int(small.max()) if len(small) else 0):
        same = which[d:] == which[:-d]
        if not same.any():
            break
        keys.append(mix(mix(token[:-d][same]) * U(3) + token[d:][same]))
        sets.append(which[d:][same])
    large = np.where(100 * n > pct * short, prefix_size(n, pct, 1), 0)
    token, which = _heads(tokens, cut, large)
    keys.append(mix(token + U(0x5851F42D4C957F2D)))
    sets.append(which)
    return np.concatenate(keys), np.concatenate(sets)


def similar(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    """Whether two ordered sets have 100 * intersection >= pct * union."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < pct * len(b):
        return False
    k = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[k] == a).sum())
    return 100 * both >= pct * (len(a) + len(b) - both)


def _worth_comparing(pairs: DataFrame, texts: DataFrame, width: int, pct: int) -> DataFrame:
    """Pairs (leader, node) whose sets may be similar by as many bits as they have tokens: an eighth of a byte a token travels, not its text."""

    def parities(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            tokens, cut = shingle_sets(*text_bytes(batch.column("text")), width)
            yield pa.record_batch([batch.column("node"), pa.array(np.diff(cut).astype(np.int64)), pa.array(wide_parity(tokens, cut), pa.binary())], names=["node", "n", "odd"])

    def may_be(n: pa.Array, odd: pa.Array, m: pa.Array, its: pa.Array) -> pa.Array:
        rows = zip(n.to_pylist(), odd.to_pylist(), m.to_pylist(), its.to_pylist())
        return pa.array([(100 + pct) * bits_apart(x, y) <= (100 - pct) * (a + b) for a, x, b, y in rows], pa.bool_())

    own = parked(texts.mapInArrow(parities, "node long, n long, odd binary"), "parities")
    its = own.select(F.col("node").alias("leader"), F.col("n").alias("m"), F.col("odd").alias("its"))
    found = pairs.select("leader", "node").join(own, "node").join(its, "leader")
    return parked(found.filter(F.arrow_udf(may_be, "boolean")("n", "odd", "m", "its")).select("leader", "node"), "pairs")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, pct: int) -> DataFrame:
    """The pairs (node, leader) that are links.  The members of a leader are dealt to as many tasks as they need, the leader's text to each."""
    pairs = _worth_comparing(pairs, texts, width, pct)
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    members = parked(pairs.join(parts, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")), "members")
    leaders = members.select("leader", "part").distinct().join(texts.withColumnRenamed("node", "leader"), "leader").select("leader", "part", F.lit(None).cast("long").alias("node"), "text")
    rows = members.join(texts, "node").select("leader", "part", "node", "text").unionByName(leaders)

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: np.ndarray = np.zeros(0, dtype=np.uint64)
        for batch in batches(stream):
            tokens, cut = shingle_sets(*text_bytes(batch.column("text")), width)
            leader, node = batch.column("leader").to_pylist(), batch.column("node").to_pylist()
            hits = []
            for k in range(batch.num_rows):
                mine = tokens[cut[k] : cut[k + 1]]
                if node[k] is None:
                    own = mine.copy()
                elif similar(own, mine, pct):
                    hits.append(k)
            yield pa.record_batch([pa.array([node[k] for k in hits], pa.int64()), pa.array([leader[k] for k in hits], pa.int64())], names=["a", "b"])

    dealt = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node").asc_nulls_first())
    return dealt.select("leader", "node", "text").mapInArrow(compare, "a long, b long")


def classes(links: DataFrame, name: str = "classes") -> DataFrame:
    """(node, root): the least node of each node's component; nodes without a link are not there.

    Rounds of taking the least label of the neighbours and then that label's label; the number of rounds grows with the logarithm of
    the longest chain for the shapes that links have, and each starts from a written table.
    """
    both = parked(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = parked(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        later = parked(lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), name)
        if later.filter("old != root").isEmpty():
            return later.select("node", "root")
        labels = later.select("node", "root")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root): the classes `roots` joined by further links.

    The links are taken between classes, each pair of classes once: a group whose members are linked many times over costs what its classes do.
    """
    if roots is None:
        return classes(links)
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    between = ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    top = classes(between)
    higher = top.select(F.col("node").alias("root"), F.col("root").alias("next"))
    known = roots.join(higher, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return parked(known.unionByName(top.join(roots, "node", "left_anti")), "classes")


def jaccard_join(docs: DataFrame, width: int = 3, pct: int = 90, rounds: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles (size of its set of `width`-word shingles), component_id (the smallest doc_id reachable
    by links, itself included).

    A-Z are lower-cased; with fewer than `width` words the whole sequence is the one shingle.  Two sets link when 100 * intersection >=
    pct * union.  Null and empty texts have no shingle and link with nothing: they are their own component.  Null ids do not count as the
    smallest unless a component has no other; repeated rows are in one component; other columns are ignored; an empty table gives an empty
    one.  `pct` is below 100.  Tokens and sets are known by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    none = np.zeros(0, dtype=np.uint64)

    def heads(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            tokens, cut = shingle_sets(*text_bytes(batch.column("text")), width)
            token, _ = _heads(tokens, cut, prefix_size(np.diff(cut), pct, 1))
            token, n = np.unique(token, return_counts=True)
            yield pa.record_batch([_signed(token), pa.array(n)], names=["token", "n"])

    def sets_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            tokens, cut = shingle_sets(*text_bytes(batch.column("text")), width)
            yield pa.record_batch([batch.column("id"), batch.column("row"), pa.array(np.diff(cut).astype(np.int64)), _signed(set_names(tokens, cut)), *map(_signed, parity_words(tokens, cut))], names=["id", "row", "n", "node", *BITS])

    sets = parked(rows.withColumn("row", F.xxhash64("text")).mapInArrow(sets_of, f"id {kind}, row long, n long, node long, " + ", ".join(f"{b} long" for b in BITS)), "sets")
    size = sets.count()
    often = rows.select("text").mapInArrow(heads, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > max(LEAST_FREQUENT, size // RARE))
    frequent = sc.broadcast(np.sort(np.asarray(often.select("token").toArrow().column("token")).view(np.uint64)) if size else none)

    def keys_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            tokens, cut = shingle_sets(*text_bytes(batch.column("text")), width)
            key, which = index_keys(tokens, cut, frequent.value, pct)
            key, n = _distinct_sets(key, set_names(tokens, cut)[which])
            yield pa.record_batch([_signed(key), _signed(n)], names=["key", "node"])

    counted = rows.select("text").mapInArrow(keys_of, "key long, node long").groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = parked(counted.filter("low != high").select("key"), "keys")
    words = sc.broadcast(_filter(shared))

    def members_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            tokens, cut = shingle_sets(*text_bytes(batch.column("text")), width)
            key, which = index_keys(tokens, cut, frequent.value, pct)
            k = np.flatnonzero(_passes(words.value, key))
            key, which = key[k], which[k]
            yield pa.record_batch([_signed(key), _signed(set_names(tokens, cut)[which]), pa.array(np.diff(cut)[which].astype(np.int32))], names=["key", "node", "n"])

    found = rows.select("text").mapInArrow(members_of, "key long, node long, n int").join(shared, "key").groupBy("key", "node").agg(F.max("n").alias("n"))
    members = parked(found, "members")
    bits = parked(sets.join(members.select("node").distinct(), "node", "left_semi").select("node", *BITS).dropDuplicates(["node"]), "bits")
    roots, done = None, None
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / pct))).cast("int")
    for turn in range(rounds):
        open_rows = _open(members, roots).withColumn("band", band)
        leaders = open_rows.groupBy("key", "band").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(turn))).alias("leader"))
        beside = leaders.select("key", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), "leader")
        met = open_rows.join(beside, ["key", "band"]).filter("root != leader.root")
        met = met.select(F.col("leader.node").alias("leader"), "node", "n", F.col("leader.n").alias("m"), F.col("leader.root").alias("other"))
        # the pairs come together from many keys: counted in the tasks first, and what they differ in at least refutes most that are no links
        met = _sized(met, pct).groupBy("leader", "node", "n", "m", "other").agg(F.count("*").alias("keys"))
        met = met if done is None else met.join(done, ["leader", "node"], "left_anti")
        met = _not_refuted(met, bits, pct)
        # near copies meet under most of their keys; a pair that meets under few is left to the end
        near = met.filter(4 * F.col("keys") >= F.col("n") - F.ceil(F.col("n") * pct / 100) + 1)
        # one leader a class and round: whoever links with it is in its class, and a text travels once for that
        best = near.groupBy("node", "other").agg(F.max(F.struct("keys", "leader")).alias("best")).groupBy("node").agg(F.max("best").alias("best"))
        pairs = parked(best.select(F.col("best.leader").alias("leader"), "node"), "pairs")
        if pairs.isEmpty():
            break
        done = pairs if done is None else done.unionByName(pairs)
        new = parked(_verified(pairs, _texts(rows, sets, pairs), width, pct), "links")
        roots = merged(roots, new)
        if 10 * new.count() < pairs.count():
            break
    rest = parked(_open(members, roots), "open")
    firsts = rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRSTS).alias("firsts"))
    rest = rest.join(firsts.join(bits, "node"), "node")
    left, right = rest.alias("l"), rest.alias("r")
    pairs = left.join(right, F.col("l.key") == F.col("r.key")).filter("l.root < r.root")
    # a pair comes up under each key it shares: those after another one among the first keys of both add nothing
    news = F.coalesce(F.array_min(F.array_intersect("l.firsts", "r.firsts")) >= F.col("l.key"), F.lit(True))
    pairs = pairs.filter(F.when((100 + pct) * _apart("l.", "r.") <= (100 - pct) * (F.col("l.n") + F.col("r.n")), news).otherwise(False))
    pairs = pairs.select(F.col("l.node").alias("leader"), F.col("r.node").alias("node"), F.col("l.n").alias("n"), F.col("r.n").alias("m"))
    pairs = _sized(pairs, pct).select("leader", "node").distinct()
    if done is not None:
        other = done.select(F.col("node").alias("leader"), F.col("leader").alias("node"))
        pairs = pairs.join(done, ["leader", "node"], "left_anti").join(other, ["leader", "node"], "left_anti")
    pairs = parked(pairs, "pairs")
    if not pairs.isEmpty():
        new = parked(_verified(pairs, _texts(rows, sets, pairs), width, pct), "links")
        roots = merged(roots, new)
    named = sets.drop(*BITS).withColumn("root", F.col("node"))
    if roots is not None:
        named = sets.drop(*BITS).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.filter("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    return named.join(least, "root", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **joining) -> DataFrame:
    """`docs`, all columns, with one row of each component: the one with the smallest id (a null id is the largest).

    Rows that are equal in id and text stay once.  Rows without a shingle all stay: they link with nothing.
    """
    name = "".join(["row_", *(c for c in docs.columns)])  # no column is called so
    place = F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text).alias("c"))
    named = docs.withColumn(name, place)
    found = parked(jaccard_join(named, doc_id=name, text=text, **joining), "components")
    gone = found.filter("doc_id != component_id AND n_shingles > 0").select(F.col("doc_id.c").alias("c")).distinct()
    twice = found.filter("n_shingles > 0").groupBy(F.col("doc_id.c").alias("c")).agg(F.count("*").alias("n")).filter("n > 1").select("c")
    key = F.col(f"`{name}`.c")
    left = named.join(gone, key == gone.c, "left_anti")
    once = left.join(twice, key == twice.c, "left_anti")
    if not twice.isEmpty():
        again = left.join(twice, key == twice.c, "left_semi")
        once = once.unionByName(again.dropDuplicates([name]))
    return once.drop(name)


def _distinct_sets(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) without repetition: copies in a batch count once."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    return key[new], node[new]


def _apart(a: str, b: str) -> Column:
    """In how many tokens two sets differ at least."""
    return sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in BITS), F.lit(0))


def _not_refuted(pairs: DataFrame, bits: DataFrame, pct: int) -> DataFrame:
    """Pairs (leader, node, n, m, ...) that may be links by their bits."""
    own = bits.select("node", *(F.col(w).alias(f"r_{w}") for w in BITS))
    its = bits.select(F.col("node").alias("leader"), *(F.col(w).alias(f"l_{w}") for w in BITS))
    found = pairs.join(own, "node").join(its, "leader")
    return found.filter((100 + pct) * _apart("l_", "r_") <= (100 - pct) * (F.col("n") + F.col("m"))).select(*pairs.columns)


def _sized(pairs: DataFrame, pct: int) -> DataFrame:
    return pairs.filter(100 * F.least("n", "m") >= pct * F.greatest("n", "m"))


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members with their class, of keys that hold more than one class."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    return named.join(several, "key")


def _texts(rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of one document of each node of the pairs.

    A filter of fixed size keeps most other texts from being shuffled; the join decides.
    """
    nodes = pairs.select("node").union(pairs.select("leader")).distinct()
    # equal sets give equal answers, whichever text stands for them
    wanted = parked(sets.join(nodes, "node").groupBy("node").agg(F.min("row").alias("key")), "wanted")
    words = rows.sparkSession.sparkContext.broadcast(_filter(wanted))

    def passes(keys: pa.Array) -> pa.Array:
        return pa.array(_passes(words.value, np.asarray(keys)))

    named = rows.select(F.xxhash64("text").alias("key"), "text")
    named = named.filter(F.arrow_udf(passes, "boolean")("key"))
    once = named.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return parked(once.join(wanted, "key").select("node", "text"), "texts")
