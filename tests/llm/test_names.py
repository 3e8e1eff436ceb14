"""Id columns named like a result column, and very long texts, in every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, contamination, langid, lm, quality, simhash, topk, toxicity
from graphloom.llm.queries import tokenizer_path
from tests.llm.conftest import prose

LONG = " ".join(["river stone"] * 60_000)


@pytest.fixture(scope="module")
def operators(spark):
    rng = np.random.default_rng(1)
    texts = [prose(rng, 40) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", i % 2, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, quality int, toxic int")
    vocab, net = lm.train(docs)
    tongue, tox, qual = langid.train(docs), toxicity.train(docs, docs), quality.train(docs, docs)
    items = spark.createDataFrame([(7, texts[3])], "item_id long, text string")
    return docs, {
        "ids": lambda d, c: bpe.encode_decode(d, tokenizer_path(), id_col=c),
        "fp": lambda d, c: simhash.near_duplicates(d, id_col=c),
        "component_id": lambda d, c: simhash.near_duplicates(d, id_col=c),
        "lang_pred": lambda d, c: langid.predict(d, tongue, id_col=c),
        "score": lambda d, c: toxicity.score(d, tox, id_col=c),
        "Score": lambda d, c: quality.score(d, qual, id_col=c),
        "n_tokens": lambda d, c: lm.score(d, vocab, net, id_col=c),
        "item_id": lambda d, c: contamination.contaminated(d, items, id_col=c),
    }


@pytest.mark.parametrize("name", ["ids", "fp", "component_id", "lang_pred", "score", "Score", "n_tokens", "item_id"])
def test_clashing_id_columns_and_long_texts(spark, operators, name):
    docs, of = operators
    docs = docs.unionByName(spark.createDataFrame([(99, LONG, None, None, None)], docs.schema))
    plain = of[name](docs, "doc_id")
    clash = of[name](docs.select(F.col("doc_id").alias(name), "text"), name)
    assert clash.columns[0] == name and len({c.lower() for c in clash.columns}) == len(clash.columns) == len(plain.columns)
    assert sorted(map(repr, map(tuple, clash.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    assert name == "item_id" or plain.where("doc_id = 99").count() == 1


def test_clashing_id_column_of_a_search(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "rank long, embedding array<double>")
    out = topk.exact_top_k(df, F.col("rank") == 0, k=2, id_col="rank")
    assert out.columns == ["query_id", "_rank", "rank", "score"] and [(r["_rank"], r["rank"]) for r in out.orderBy("_rank").collect()] == [(1, 1), (2, 2)]
