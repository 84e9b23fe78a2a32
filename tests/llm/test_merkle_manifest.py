import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hearth.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def way(tree, place):
    out = []
    for below in tree[:-1]:
        low = place - place % 3
        out.append(("".join(below[low:place]), "".join(below[place + 1 : low + 3])))
        place //= 3
    return out


def plain(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda *r: sha("".join(map(field, r)))
    sources = {}
    for doc, source, lang, n, text in rows:
        other = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        sources.setdefault(source, []).append(((doc is not None, doc or 0), leaf(doc, source, lang, n, text), leaf(doc, source, lang, n, other), doc))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: r[:2])
    trees = {s: levels([r[1] for r in sources[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order]) if order else []
    out = []
    for k, s in enumerate(order):
        for place, (_, own, changed, doc) in enumerate(sources[s]):
            path = way(trees[s], place) + way(top, k)
            folded = changed
            for left, right in path:
                folded = sha(left + folded + right)
            root = top[-1][0]
            out.append((doc, own, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


ROWS = [
    (5, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (9, "b", "de", 0, ""), (None, "b", "de", 1, "x\n"), (9, "b", "de", 0, ""), (9, "b", "de", 0, "other"),
    (1, None, "en", 1, "y\n"), (3, "", "en", 1, "\n"), (4, "é", "en", 2, "日本\n語"), (6, "z", "", 5, "-"), (7, "-", "en", 1, "q\n\nq"), (8, ":", "en", 1, "t" * 300_000 + "\n"),
]


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 10, 28, 730, 2300])
def test_against_loops(spark, count):
    rows = (ROWS + [(100 + k, ("hot", "hot", f"s{k % 40}")[k % 3], "en", k, f"text {k}\nline") for k in range(2300)])[:count] if count else []
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS tree", "1 AS pos", "2 AS hash", "3 AS n", "4 AS block")
    found = M.merkle_manifest(docs, M.tampered(docs))
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_several_rounds(spark, levels):
    rows = ROWS + [(100 + k, ("hot", "hot", f"s{k % 40}")[k % 3], "en", k, f"text {k}\nline") for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = M.merkle_manifest(docs, M.tampered(docs), levels=levels)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_proofs_stand_alone(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], "en", k, f"text {k}\n") for k in range(60)], SCHEMA)
    found = M.merkle_manifest(docs, with_path=True).collect()
    assert all(r.verified and r.folded_root == r.root and M.verifies(r.leaf, r.path, r.root) for r in found)
    assert not M.verifies("0" * 64, found[0].path, found[0].root)
    other = M.merkle_manifest(docs.withColumn("text", F.when(F.col("doc_id") == 7, "changed").otherwise(F.col("text")))).collect()
    assert other[0].root != found[0].root


def test_states_resume():
    nodes = [sha(str(k)) for k in range(50)]
    tree = levels(nodes)
    block = M.Block(nodes, M.heights(50))
    assert block.nodes == tree
    for place in range(50):
        changed = nodes[:place] + [sha("new")] + nodes[place + 1 :]
        assert block.fold(place, sha("new")) == levels(changed)[-1][0]
        assert M.Path(block.path(place)).fold(sha("new")) == levels(changed)[-1][0]
