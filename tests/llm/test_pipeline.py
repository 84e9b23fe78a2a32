"""The pipeline stage by stage against plain versions, and what the driver's contract asks of the queries."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from test_jaccard_join import expected
from test_pii import base

import corpus_pipeline
from hearth.llm.queries import llm_queries
from hearth.llm.source_mix import comparison_sql
from hearth.llm.text import parked
from hearth.llm.toxicity import labelled, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = parked(stage(spark, docs, SF), name)
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "pii", "source_mix"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert outputs[name].columns == COLUMNS


def test_toxic_documents_go(spark, outputs):
    docs = outputs["documents"]
    judged = toxicity(docs, *labelled(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert set(texts(outputs["toxicity"])) == {r.doc_id for r in judged if not r.toxic}


def test_one_of_each_group_stays(outputs):
    rows = sorted(texts(outputs["toxicity"]).items())
    assert set(texts(outputs["jaccard_join"])) == {i for i, (_, c) in expected(rows, 5, 80).items() if i == c}


def test_benchmark_copies_go(spark, outputs):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fold = lambda t: re.sub(r"\s", " ", t.lower())
    before, after = texts(outputs["jaccard_join"]), texts(outputs["decontamination"])
    copies = {i for i, t in before.items() if any(fold(x) in fold(t) for x in items)}
    assert not copies & set(after) and len(before) - len(after) <= len(copies) + 1


def test_personal_data_gives_way(outputs):
    before, after = texts(outputs["decontamination"]), outputs["pii"].collect()
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        assert base(r.text) == [] and r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_mix(outputs):
    con = duckdb.connect()
    documents = outputs["pii"].toPandas()  # noqa: F841
    con.sql("CREATE TABLE d AS SELECT * FROM documents")
    want = sorted(con.sql(f"SELECT * FROM ({comparison_sql('d')}) WHERE taken > 0").fetchall())
    assert sorted(tuple(r) for r in outputs["source_mix"].collect()) == want


def test_run_is_the_stages(spark, outputs):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, outputs["source_mix"].collect()))


def test_odd_documents(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, no labels, no benchmark."""
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x " * 100, None, None, 200), (2, "x " * 100, None, None, 200), (3, None, "en", "b", None), (None, "mail a@b.cd", "en", "b", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    talk = [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "")]
    for name, rows, kind in (("documents", odd, schema), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string"),
                             ("conversations", talk, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == [("2", 100), ("None", 2)]
    counts = {"op1_decontamination": 0, "op13_chat_format": 3}  # a null conversation, one, and the one that is added
    for name, query in llm_queries().items():
        assert query(spark, str(tmp_path)).count() == counts.get(name, len(odd)), name


def test_entry_without_the_text_operators():
    """With the subpackage gone the entry still imports and names the other queries."""
    top = Path(__file__).resolve().parents[2]
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('hearth.llm'):\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "names = e.queries()\n"
            "assert 'month_categories' in names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names\n"
            "assert e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=60)
    names = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=top, check=True, capture_output=True, text=True, timeout=60).stdout
    assert all(re.search(rf"\bop{n}_", names) for n in range(1, 11)) and "pipeline" in names
