"""A hash tree over a table of documents: what each document's hash is, what the whole is, and proof that the one belongs to the other.

Leaves stand in order inside their source; every three consecutive nodes have a parent until one node, the source's, is left; the sources' nodes
form the tree above in the same way.  A parent hashes its children one after another.  It keeps a copy of its hash state before each
child, so folding a leaf again, changed or not, resumes the state before its slot, adds the new child and those to the right of it, and goes up: what is
to the left is never hashed twice.

Spark numbers the leaves by a range sort (no source is sorted in one task) and deals them out in blocks of 3**6; a task builds the six levels above one
block at a time and hands one node per block to the next round, so a table of 10**11 documents takes four rounds.  The way back
passes each block the path from its top to the root: slots and siblings, from which a task makes the states once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hearth.llm.text import parked

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: How a level of a path is written: the siblings before the slot, this, the siblings behind it.
SLOT = "|"


def leaf_hash(*fields: Column) -> Column:
    """The digest of a row: '-' for each null, else the bytes of the value as text, ':' and the value."""
    def written(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)).cast("binary"), 256)


def heights(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Block:
    """Up to `levels` levels above some consecutive nodes, with the state each parent had before each child."""

    def __init__(self, nodes: list[str], levels: int):
        self.nodes, self.states = [nodes], []
        for _ in range(levels):
            below, above, states = self.nodes[-1], [], []
            for low in range(0, len(below), FAN):
                state = hashlib.sha256()
                for child in below[low : low + FAN]:
                    states.append(state.copy())
                    state.update(child.encode())
                above.append(state.hexdigest())
            self.nodes.append(above)
            self.states.append(states)

    @property
    def top(self) -> str:
        return self.nodes[-1][0]

    def fold(self, place: int, node: str) -> str:
        """The top if `node` stood at `place`."""
        for below, states in zip(self.nodes, self.states):
            state = states[place].copy()
            state.update(node.encode())
            for right in below[place + 1 : place - place % FAN + FAN]:
                state.update(right.encode())
            node, place = state.hexdigest(), place // FAN
        return node

    def path(self, place: int) -> list[str]:
        """The siblings of the node at `place` and of its ancestors, a text for each level."""
        out = []
        for below in self.nodes[:-1]:
            low = place - place % FAN
            out.append("".join(below[low:place]) + SLOT + "".join(below[place + 1 : low + FAN]))
            place //= FAN
        return out


class Path:
    """What is above a block: a kept state and the siblings to the right for each level."""

    def __init__(self, levels: list[str]):
        self.levels = levels
        self.siblings = "".join(levels).replace(SLOT, "").encode()
        self.steps = []
        for level in levels:
            left, right = level.split(SLOT)
            self.steps.append((hashlib.sha256(left.encode()), right.encode()))

    def fold(self, node: str) -> str:
        for kept, right in self.steps:
            state = kept.copy()
            state.update(node.encode())
            state.update(right)
            node = state.hexdigest()
        return node


def _blocks(stream: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of one block after another; they come in order and a block has 3**levels rows, and one for its path, at most."""
    rows: list[dict] = []
    for batch in stream:
        for row in batch.to_pylist():
            if rows and any(row[k] != rows[0][k] for k in key):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _lined(rows: DataFrame, tree: str | None, order: list[str]) -> DataFrame:
    """`rows` with `pos` (from 0) and `n` in their tree (a column that may be null, or None for one tree), in `order`, nulls first.

    A range sort deals them out, so that a tree of any size is spread over all tasks; rows that are equal in all of `order` may be too.
    """
    tree_of = F.col(tree) if tree else F.lit("")
    named = rows.withColumn("tree", tree_of).withColumn("tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "tie")]
    kept = [c for c in named.columns if c != "tie"]

    def number(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth = None, 0
        for batch in stream:
            out = []
            for value in batch.column("tree").to_pylist():
                nth = nth + 1 if (value,) == last else 0
                last = (value,)
                out.append(nth)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "nth"])

    sorted_rows = named.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept, F.spark_partition_id().alias("part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    placed = parked(sorted_rows.mapInArrow(number, schema + ", nth long"), "lined")
    parts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    # as many rows as there are partitions and trees together
    before = F.sum("rows").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select(F.col("tree").alias("t"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    joined = placed.join(starts, placed.tree.eqNullSafe(starts.t) & (placed.part == starts.p))
    return joined.withColumn("pos", F.col("before") + F.col("nth")).drop("t", "p", "part", "nth", "before")


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**levels))


def _climb(n: int, done: int, levels: int) -> int:
    """Levels that a block of a tree of n leaves climbs after `done` levels."""
    return min(levels, max(heights(n) - done, 0))


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (tree, n, pos, hash) of the leaves, and of the tops of the blocks of each round; the last has one node per tree."""

    def climb(stream: Iterator[pa.RecordBatch], done: int) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(stream, ("tree", "block")):
            first = rows[0]
            top = Block([r["hash"] for r in rows], _climb(first["n"], done, levels)).top
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip((first["tree"], first["n"], first["block"], top), shape)], schema=shape)

    shape = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("hash", pa.string())])
    rounds = [_blocked(nodes.select("tree", "n", "pos", "hash"), levels)]
    most = nodes.agg(F.max("n")).first()[0] or 0
    for done in range(0, heights(most), levels):
        tops = parked(_dealt(rounds[-1]).mapInArrow(lambda stream, done=done: climb(stream, done), "tree string, n long, pos long, hash string"), "tops")
        rounds.append(_blocked(tops, levels))
    return rounds


def _paths(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """(tree, block, path): of each block of the first round the path from its top to what `above` (tree, path) starts from."""
    down = above.withColumn("pos", F.lit(0).cast("long"))
    for done in reversed(range(1, len(rounds))):
        down = parked(_with_paths(rounds[done], down.select("tree", F.col("pos").alias("block"), "path")).mapInArrow(
            lambda stream, done=done: _lengthened(stream, done * levels, levels), "tree string, pos long, path array<string>"), "paths")
    return down.select("tree", F.col("pos").alias("block"), "path")


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of each block behind a row with its path."""
    return _dealt(nodes.unionByName(paths.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True))


def _lengthened(stream: Iterator[pa.RecordBatch], done: int, levels: int) -> Iterator[pa.RecordBatch]:
    for head, *rows in _blocks(stream, ("tree", "block")):
        block = Block([r["hash"] for r in rows], _climb(rows[0]["n"], done, levels))
        paths = [block.path(k) + head["path"] for k in range(len(rows))]
        yield pa.record_batch([pa.array([head["tree"]] * len(rows), pa.string()), pa.array([r["pos"] for r in rows], pa.int64()), pa.array(paths, pa.list_(pa.string()))],
                              names=["tree", "pos", "path"])


def merkle_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source",
                    with_path: bool = False, levels: int = 6) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot (of its source), root, proof_sha256 (digest of its path's siblings), folded_root, verified.

    The leaf hashes `fields`.  folded_root is what comes out if the row is replaced by what `changed` (column -> expression over `docs`) makes
    of it and its siblings stay; verified tells whether that is the root.  With `with_path` a column `path` holds the siblings of each level, those
    before and those behind the slot parted by '|', from the leaf to the root: `verifies` checks a document by it without the table.

    Leaves ascend by doc_id in their source, a null id first; rows with the same id by their hash; rows that are equal stand in any order.  A null source
    is a source of its own, the first.  Null and empty fields differ in the leaf.  Columns that are not in `fields` are ignored, whatever they
    are called; an empty table gives an empty one.  A task builds `levels` levels of a block of 3**levels leaves at a time.
    """
    spark = docs.sparkSession
    now = [docs[c] for c in fields]
    then = [(changed or {}).get(c, docs[c]) for c in fields]
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), leaf_hash(*now).alias("hash"), leaf_hash(*then).alias("folded") if changed else F.lit(None).cast("string").alias("folded"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # a source's name as the tree's, told apart from a null one
    rows = rows.withColumn("source", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit(":"), "source")))
    leaves = parked(_lined(rows, "source", ["doc_id", "hash"]), "leaves")
    rounds = _rounds(leaves, levels)
    subroots = rounds[-1].select(F.col("tree").alias("source"), "hash")
    # "-" sorts before ":" and names after it by their bytes
    sources = parked(_lined(subroots, None, ["source"]), "sources")
    top = _rounds(sources, levels)
    root = next((r.hash for r in top[-1].select("hash").collect()), None)  # one row, none of an empty table
    upper = parked(_paths(top, spark.createDataFrame([("", [])] if root else [], "tree string, path array<string>"), levels), "upper")
    named = _with_paths(_blocked(sources, levels), upper)

    def ways(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *nodes in _blocks(stream, ("tree", "block")):
            block = Block([r["hash"] for r in nodes], _climb(nodes[0]["n"], 0, levels))
            yield pa.record_batch([pa.array([r["source"] for r in nodes], pa.string()), pa.array([r["hash"] for r in nodes], pa.string()),
                                   pa.array([block.path(k) + head["path"] for k in range(len(nodes))], pa.list_(pa.string()))], names=["tree", "subroot", "path"])

    ends = parked(named.mapInArrow(ways, "tree string, subroot string, path array<string>"), "ends")
    below = _paths(rounds, ends.select("tree", "path"), levels).join(ends.select("tree", "subroot"), "tree")
    blocks = _with_paths(_blocked(leaves.select("tree", "n", "pos", "hash", "folded", "doc_id"), levels), below)

    def prove(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *nodes in _blocks(stream, ("tree", "block")):
            block = Block([r["hash"] for r in nodes], _climb(nodes[0]["n"], 0, levels))
            upper = Path(head["path"])
            out: dict[str, list] = {c: [] for c in ("proof", "folded", "path")}
            for k, r in enumerate(nodes):
                own = block.path(k)
                out["proof"].append(hashlib.sha256("".join(own).replace(SLOT, "").encode() + upper.siblings).hexdigest())
                out["folded"].append(upper.fold(block.fold(k, r["folded"] or r["hash"])))
                if with_path:
                    out["path"].append(own + upper.levels)
            n = len(nodes)
            columns = [pa.array([r["doc_id"] for r in nodes], of), pa.array([r["hash"] for r in nodes], pa.string()), pa.array([head["subroot"]] * n, pa.string()),
                       pa.array([root] * n, pa.string()), pa.array(out["proof"], pa.string()), pa.array(out["folded"], pa.string()), pa.array([f == root for f in out["folded"]], pa.bool_())]
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            if with_path:
                columns, names = [*columns, pa.array(out["path"], pa.list_(pa.string()))], [*names, "path"]
            yield pa.record_batch(columns, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    of = to_arrow_type(rows.schema["doc_id"].dataType)
    shape = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.mapInArrow(prove, shape + (", path array<string>" if with_path else ""))


def verifies(leaf: str, path: list[str], root: str) -> bool:
    """Whether a leaf with the siblings of its path has that root."""
    return Path(path).fold(leaf) == root


def tampered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Texts without their line feeds where 2 divides the CRC-32 of the id's decimals, as `changed` of `merkle_manifest`."""
    even = F.crc32(docs[doc_id].cast("string").cast("binary")) % 2 == 0
    return {text: F.when(even, F.replace(docs[text], F.lit("\n"), F.lit(""))).otherwise(docs[text])}


def comparison_sql(docs: str = "documents") -> str:
    """The query's result in DuckDB: levels by a recursive statement, another one folds every leaf."""
    field = lambda c: f"coalesce(cast(octet_length(encode(cast({c} AS varchar))) AS varchar) || ':' || cast({c} AS varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    # CRC-32 bit by bit; only its lowest bit matters
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    letters = "list_transform(string_split(cast(doc_id AS varchar), ''), lambda s: cast(ascii(s) AS bigint))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {letters}), lambda c, b: {step}), 4294967295)"
    levels = """
{t}_tree AS (SELECT tree, 0 AS level, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {t}_nodes
    UNION ALL SELECT * FROM (SELECT tree, level + 1 AS level, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (any_value(n) + 2) // 3 AS n FROM {t}_tree WHERE n > 1 GROUP BY tree, level, pos // 3)),
{t}_steps AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {t}_tree a JOIN {t}_tree b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL)"""
    return f"""WITH RECURSIVE rows AS (SELECT doc_id, source, {leaf('text')} AS leaf,
    {leaf("(CASE WHEN (" + crc + ") % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS folded FROM {docs}),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows),
low_nodes AS (SELECT tree, pos, leaf AS h FROM leaves),{levels.format(t="low")},
subroots AS (SELECT tree, h FROM low_tree WHERE n = 1),
top_nodes AS (SELECT 0 AS tree, tree AS pos, h FROM subroots),{levels.format(t="top")},
folds AS (SELECT tree, pos AS place, 0 AS level, pos, folded AS h, '' AS siblings, false AS above, doc_id, leaf, tree AS top_pos FROM leaves
    UNION ALL SELECT * FROM (SELECT f.tree, f.place, f.level + 1, f.pos // 3, sha256(s.l || f.h || s.r), f.siblings || s.l || s.r, f.above, f.doc_id, f.leaf, f.top_pos
        FROM folds f JOIN low_steps s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos)),
low_ends AS (SELECT f.* FROM folds f JOIN low_tree t ON t.tree = f.tree AND t.level = f.level AND t.pos = f.pos WHERE t.n = 1),
top_folds AS (SELECT tree, place, 0 AS level, top_pos AS pos, h, siblings, doc_id, leaf FROM low_ends
    UNION ALL SELECT * FROM (SELECT f.tree, f.place, f.level + 1, f.pos // 3, sha256(s.l || f.h || s.r), f.siblings || s.l || s.r, f.doc_id, f.leaf
        FROM top_folds f JOIN top_steps s ON s.level = f.level AND s.pos = f.pos))
SELECT f.doc_id, f.leaf, s.h AS subroot, t.h AS root, sha256(f.siblings) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM top_folds f JOIN top_tree t ON t.level = f.level AND t.n = 1 JOIN subroots s ON s.tree = f.tree"""
