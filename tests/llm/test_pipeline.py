import os

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kalendarium.llm import catalog
from tests.llm.tables import documents, odd_rows, prose, rows, words
from tests.llm.test_simhash_groups import plain_fingerprint, plain_groups
from tests.llm.test_toxic_neighbours import BAD, LABELS, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with planted cases: toxic, copied and leaking documents among clean ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus(600)
    item = " ".join(words(31337, 30))
    docs = [(i, t, f"src{i % 4}") for i, t in docs]
    docs += [(2000 + i, docs[1][1], "src1") for i in range(40)] + [(3000, prose(1, 200) + " " + item + " " + prose(2, 50), "src2")]
    docs += [(4000 + i, " ".join(words(777 + i, 80)) + f" {BAD[i % 4]} {BAD[(i + 1) % 4]} {BAD[i % 4]}", "src3") for i in range(10)]
    documents(spark, docs + odd_rows()).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    steps = dict(corpus_pipeline.STAGES)

    clean = steps["toxicity"](spark, docs, folder)
    ids = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and not ids & set(range(4000, 4010)) and {i for i in range(600) if i % 8} <= ids

    unique = steps["simhash_near_dedup"](spark, docs, folder)
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    roots = plain_groups({plain_fingerprint(t) for _, t in given})
    least = {}
    for doc_id, text in given:
        g = roots[plain_fingerprint(text)]
        least[g] = min(least.get(g, (True, 0)), (doc_id is None, doc_id or 0))
    assert unique.columns == columns
    assert sorted(((r["doc_id"] is None), r["doc_id"] or 0) for r in unique.collect()) == sorted(least.values())

    apart = steps["benchmark_decontamination"](spark, docs, folder)
    assert apart.columns == columns and rows(apart, "doc_id", "text") == rows(docs.filter("doc_id is null or doc_id <> 3000"), "doc_id", "text")

    mixed = steps["source_mixing"](spark, docs, folder)
    taken = catalog.mixing.mix(docs).selectExpr("sum(epochs)").first()[0]
    assert mixed.columns == columns and mixed.count() == taken

    ids = steps["token_output"](spark, docs, folder)
    assert ids.count() == docs.count()


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)
    starts = sorted((r["start"], r["n_tokens"]) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_registered(spark):
    queries = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in queries if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in queries and "pipeline" not in entry.oracle_sql()
    assert os.path.exists(catalog.tokenizer_path())


def test_whole_tables_are_read(spark):
    given = pq.read_table("/root/testdata/sf0.001/documents.parquet").num_rows
    for name in ("op1_token_store", "op4_mixing", "op6_secret_ledger", "op7_pii_anchors", "op8_simhash_groups", "op10_toxic_neighbours"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == given, name


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    theirs = con.execute(catalog.ORACLE[name])
    columns = [d[0] for d in theirs.description]
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(columns)
    assert rows(df, *columns) == sorted(theirs.fetchall(), key=repr)


def test_a_worker_keeps_one_operators_object():
    from kalendarium.llm import common

    first = common.per_worker("one", list)
    assert common.per_worker("one", list) is first
    second = common.per_worker("two", list)
    assert common.per_worker("two", list) is second
    assert common.per_worker("one", list) is not first
    common.forget_others()
    assert common.per_worker("two", list) is not second
