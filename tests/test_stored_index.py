from __future__ import annotations

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import counting, text
from quarry.operators import search, stored
from quarry.plans import search_queries as q
from tests.oracle import check


def test_counted_in_the_row_as_by_expressions(spark, small):
    """Of all documents and odd texts: the same tokens as text.tokens."""
    odd = ["userLogin HTTPServer2x a_b/c __ // _/ x__y", "İstanbul ǅabc ﬁ Straße ½cup 12ab ١٢x", None, "", " the ring\x0bs", "日本語テキスト naïve éte ᾳΣ"]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").unionAll(spark.createDataFrame([(t,) for t in odd], "text string"))
    count = counting.counter()
    for r in docs.select("text", text.tokens(F.col("text")).alias("tokens")).collect():
        assert count(r["text"]) == Counter(r["tokens"] or []), r["text"]


def documents(n: int) -> list[tuple]:
    rng = random.Random(1)
    rare = ["theren", "thereness", "there", "the", "answer", "ans", "answ", "zebra", "ring", "rings"]
    common = ["alpha", "beta", "gamma", "delta"]
    return [(i, " ".join(["everywhere", *(rng.choice(common) for _ in range(rng.randint(1, 30))), *(rng.choice(rare) for _ in range(rng.choice([0, 0, 0, 1, 3])))])) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("soft", [True, False])
def test_early_stop_is_exact(spark, tmp_path, soft):
    """Against an index in memory that scores all documents, for one, few and all blocks scored first."""
    docs = spark.createDataFrame(documents(900), "doc_id long, text string").repartition(4)
    whole = search.build(docs)
    stored.write(docs, f"{tmp_path}/i", rows=500, per_block=16)
    made = stored.Stored(spark, f"{tmp_path}/i")
    for asked in ("theren answ", "zebra alpha alpha", "ring everywhere", "everywhere", "nothing qqq", "an thereness zebras"):
        best = [(r["doc_id"], round(r["score"], 8)) for r in search.top(search.bm25(whole, asked, soft), 10).collect()]
        for first in (1, 5, 100):
            assert [(r["doc_id"], round(r["score"], 8)) for r in made.ranked(asked, 10, soft, first).collect()] == best, (asked, first)


def test_files_follow_the_rows_and_few_are_read(spark, tmp_path):
    docs = spark.createDataFrame(documents(900), "doc_id long, text string").repartition(4)
    stored.write(docs, f"{tmp_path}/i", rows=500, per_block=16)
    made = stored.Stored(spark, f"{tmp_path}/i")
    ranges = made.table("ranges").where("name = 'postings'")
    n = made.table("postings").count()
    assert n // 500 <= ranges.count() <= n // 500 + 2
    # a term in all documents is in several files, a rare one is not
    assert ranges.where("first <= 'everywhere' AND last >= 'everywhere'").count() >= 2
    made.ranked("zebra", 5, True)
    assert made.opened["postings"] < ranges.count() / 2 and made.opened["dictionary"] == 1
    widest = made.table("postings").groupBy(F.col("_metadata.file_name")).count().agg(F.max("count")).first()[0]
    assert widest <= 1500


def test_changed_documents_are_indexed_anew(spark, small, tmp_path):
    for size in ("documents",):
        spark.read.parquet(f"{small}/{size}.parquet").limit(150).write.parquet(f"{tmp_path}/{size}.parquet")
    first = q.bm25_topk(spark, str(tmp_path)).collect()
    folder = q._index(spark, str(tmp_path)).folder
    assert q._index(spark, str(tmp_path)).folder == folder
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    assert q.bm25_topk(spark, str(tmp_path)).collect() != first and q._index(spark, str(tmp_path)).folder != folder
    assert q.bm25_topk(spark, str(tmp_path)).collect() == q.bm25_topk(spark, small).collect()


@pytest.mark.parametrize("name", ["index_build", "bm25_topk", "bm25_soft_topk", "tokenize_tf", "term_df", "bm25_proximity_topk"])
def test_matches_sql(spark, small, name):
    check(spark, small.replace("sf0.001", "sf0.01"), q.QUERIES[name], q.ORACLES[name])


def test_frequencies_are_counted_before_anything_is_shuffled(spark):
    """The documents of each term, prefixes included, without a row of the shuffle for each document and term (before: dealt by doc_id and term)."""

    docs = spark.createDataFrame([(1, "walking walk walker"), (2, "walk the talk talk"), (3, None), (4, ""), (5, "Äpfel Äpfel")], "doc_id long, text string")
    found = stored.frequencies(docs)
    want = search.document_frequencies(search.postings(search.term_frequencies(docs)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "doc_id" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
