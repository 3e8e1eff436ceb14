"""The pipeline's stages against brute force on small documents, with nulls, repeats and clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from graphloom.llm import contamination, queries
from tests.llm.conftest import DOC, prose
from tests.llm.test_texts import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    d = str(tmp_path_factory.mktemp("sf"))
    item = prose(rng, 30)
    rows, labels = [], []
    for i in range(260):
        good = i % 4 != 0
        text = (prose(rng, int(rng.integers(30, 200))) + ".") if good else " ".join("".join(rng.choice(list("zqxj$#!0189"), int(rng.integers(3, 14)))) for _ in range(60))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    texts = [rows[1][1], rows[1][1] + " more", "before " + item + " after", "mail jo.doe@example.org " + prose(rng, 60) + ".", prose(rng, 150) + "."]
    rows += [(1000 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    # repeated rows, copies and other texts without an id, another text of an id, null
    rows += [rows[5], (None, rows[2][1], None, None, None), (2000, None, None, None, None)]
    rows += [(i, t, "en", "s", len(t)) for i, t in ((None, prose(rng, 90) + "."), (3, prose(rng, 90) + "."))]
    docs = spark.createDataFrame(rows, DOC).withColumn("_text", F.lit(1)).withColumn("_keep", F.lit(2)).withColumn("_nth", F.lit(3)).withColumn("_score", F.lit(4.5))
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "personal data", "byte-pair encoding"]


def test_quality_keeps_what_scores_well(spark, docs, folder):
    from graphloom.llm import quality

    out = P.good_documents(spark, docs, folder)
    assert out.columns == docs.columns
    net = queries.quality_network(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r.doc_id for r in docs.collect() if net.probability(r.text or "") >= P.QUALITY]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect())
    kept = {r.doc_id for r in out.collect()}
    assert np.mean([(i in kept) == (i % 4 != 0) for i in range(260)]) > 0.95 and quality.CHUNK


def plain_one_of_each(rows):
    """(id, text) of the first row of each component, in the order of ids with null ids last."""
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    own = plain_components([plain_fingerprint(r.text) for r in rows])
    return [(r.doc_id, r.text) for i, r in enumerate(rows) if own[i] == i]


def test_one_of_each_group_stays(spark, docs, folder):
    out = P.one_of_each(spark, docs, folder)
    assert out.columns == docs.columns
    want = plain_one_of_each(docs.collect())
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))
    ids = [i for i, _ in want]
    assert 1000 not in ids and ids.count(None) == 1 and ids.count(3) == 2 and ids.count(5) == 1


def test_documents_with_items_go(spark, docs, folder):
    out = P.uncontaminated(spark, docs, folder)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    own = contamination.shingles(contamination.words_of(item), 5)
    hit = {r.doc_id for r in docs.collect() if len(own & contamination.shingles(contamination.words_of(r.text), 5)) >= 0.8 * len(own)}
    assert hit == {1002} and {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == hit and out.count() == docs.count() - 1


def test_private_data_and_tokens(spark, docs, folder):
    out = P.private(spark, docs, folder)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and "jo.doe@" not in got[1003].text and got[1003].n_chars == len(got[1003].text) and got[2000].text is None
    tokens = {r.doc_id: r for r in P.tokens(spark, docs, folder).collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[k].encode()).hexdigest() and r.n_tokens == len(r.ids) for k, r in tokens.items())


def test_run_applies_them_all(spark, folder):
    ids = [r.doc_id for r in P.run(spark, folder).collect()]
    good = P.good_documents(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    want = [i for i, _ in plain_one_of_each(good) if i != 1002]
    assert sorted(map(str, ids)) == sorted(map(str, want)) and not {1000, 1002} & set(ids) and len(want) > 180
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


@pytest.mark.parametrize("name", ["op3_warc", "op8_topk", "op10_contamination"])
def test_corpus_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(d):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    df = queries.queries()[name](spark, d)
    cols = sorted(df.columns)
    res = con.execute(queries.oracle_sql()[name])
    at = [[x[0] for x in res.description].index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)
