"""Ranked search: an inverted index in three tables, BM25 with a soft prefix match, graph proximity, n-gram cosine, keywords.

Documents have (doc_id, kind, name, detail, hint, path, text). Ties are broken by doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import counting, scores, text
from quarry.operators import stored
from quarry.sources.checkpoints import cut


@dataclass
class Index:
    """docs (doc_id, ..., dl), postings (doc_id, term, tf; tf may be 0), df (term, df), stats (n_docs, avg_dl: one row)."""

    docs: DataFrame
    postings: DataFrame
    df: DataFrame
    stats: DataFrame


def term_frequencies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, term, tf) of the tokens, counted inside each row: nothing is shuffled. An id names one row."""
    return stored.entries(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))


def postings(tf: DataFrame) -> DataFrame:
    """tf with a zero entry for the four-character prefix of every longer term that is no term of the document itself."""
    own = F.struct("term", "tf")
    prefix = F.struct(F.substring("term", 1, text.PREFIX).alias("term"), F.lit(0).cast("long").alias("tf"))
    both = F.when(F.length("term") >= text.PREFIX, F.array(own, prefix)).otherwise(F.array(own))
    return tf.select("doc_id", F.explode(both).alias("_entry")).select("doc_id", "_entry.*").groupBy("doc_id", "term").agg(F.max("tf").alias("tf"))


def document_frequencies(entries: DataFrame) -> DataFrame:
    return entries.groupBy("term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """docs and dl, the number of tokens and at least 1."""
    counted = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    return docs.join(counted, "doc_id", "left").withColumn("dl", F.greatest(F.coalesce("dl", F.lit(0)), F.lit(1)))


def build(docs: DataFrame) -> Index:
    """The index; its postings and lengths are made once, as every query reads them several times."""
    tf = cut(term_frequencies(docs))
    entries = postings(tf)
    sized = cut(lengths(docs.drop("text"), tf))
    return Index(sized, entries, document_frequencies(entries), sized.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")))


def bm25(index: Index, query: str, soft: bool = True) -> DataFrame:
    """(doc_id, score), score > 0. A document without a query term counts by its most frequent term that is a prefix of it or starts with it.

    For an index that is made for one query; a written one (stored.Stored) reads only what is asked.
    """
    asked = dict(counting.counter()(query))
    if not asked:
        return index.docs.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    times = lambda c: F.coalesce(*(F.when(c == t, F.lit(n)) for t, n in asked.items()))
    exact = index.postings.where("tf > 0").where(F.col("term").isin(list(asked))).join(F.broadcast(index.df.where(F.col("term").isin(list(asked)))), "term")
    hits = exact.select("doc_id", "term", times(F.col("term")).alias("n"), "tf", "df")
    if soft:
        meets = [F.col("term").startswith(t) | F.lit(t).startswith(F.col("term")) for t in asked]
        near = index.df.where(reduce(lambda a, b: a | b, meets))
        near = near.withColumn("asked", F.explode(F.array_compact(F.array(*(F.when(m, F.lit(t)) for t, m in zip(asked, meets, strict=True))))))
        near = cut(near.select("term", "asked", "df"))
        reach = near.groupBy("asked").agg(F.max("df").alias("df"))
        loose = index.postings.join(near.select("term", "asked"), "term").groupBy("doc_id", "asked").agg(F.max("tf").alias("tf"))
        loose = loose.join(hits.select("doc_id", F.col("term").alias("asked")), ["doc_id", "asked"], "left_anti").where("tf > 0")
        hits = hits.unionByName(loose.join(F.broadcast(reach), "asked").select("doc_id", F.col("asked").alias("term"), times(F.col("asked")).alias("n"), "tf", "df"))
    scored = hits.join(index.docs.select("doc_id", "dl"), "doc_id").join(F.broadcast(index.stats))
    each = F.col("n") * scores.idf(F.col("n_docs"), F.col("df")) * scores.saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    return scored.groupBy("doc_id").agg(F.sum(each).alias("score")).where("score > 0")


def top(ranked: DataFrame, limit: int = 10) -> DataFrame:
    return ranked.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(limit)


# Proximity weight and bonus by kind of document.
KIND_WEIGHT = {"package": 0.1, "file": 0.2, "symbol": 0.3, "hot_symbol": 0.0}
KIND_BONUS = {"hot_symbol": 0.15}


def with_proximity(index: Index, query: str, proximity: DataFrame, limit: int = 10) -> DataFrame:
    """The best documents by BM25 and the hop score of their path. proximity: (node, score)."""
    hits = bm25(index, query).withColumnRenamed("score", "bm25").join(index.docs, "doc_id")
    near = hits.join(proximity.select(F.col("node").alias("path"), F.col("score").alias("proximity")), "path", "left")
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in KIND_WEIGHT.items()), F.lit(0.0))
    bonus = F.coalesce(*(F.when(F.col("kind") == k, F.lit(b)) for k, b in KIND_BONUS.items()), F.lit(0.0))
    return top(near.withColumn("score", F.col("bm25") + F.coalesce("proximity", F.lit(0.1)) * weight + bonus), limit)


def gram_vectors(docs: DataFrame, id_column: str, text_column: str, n: int = 3) -> DataFrame:
    """(doc_id, gram, w) with unit length by document."""
    grams = docs.select(F.col(id_column).alias("doc_id"), F.explode(text.ngrams(F.col(text_column), n)).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("k"))
    norms = grams.groupBy("doc_id").agg(F.greatest(F.sqrt(F.sum((F.col("k") * F.col("k")).cast("double"))), F.lit(1e-6)).alias("norm"))
    return grams.join(norms, "doc_id").select("doc_id", "gram", (F.col("k") / F.col("norm")).alias("w"))


def semantic(docs: DataFrame, query: str, limit: int = 10, id_column: str = "doc_id", text_column: str = "text", least: float = 0.05) -> DataFrame:
    """The documents with the highest cosine of character n-grams."""
    asked = gram_vectors(docs.sparkSession.createDataFrame([(0, query)], "doc_id long, text string"), "doc_id", "text")
    asked = asked.select("gram", F.col("w").alias("q"))
    hits = gram_vectors(docs, id_column, text_column).join(F.broadcast(asked), "gram")
    return top(hits.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("score")).where(F.col("score") > least), limit)


def keywords(docs: DataFrame, query: str, limit: int = 10, id_column: str = "doc_id", heading: str | None = None, stale: str | None = None) -> DataFrame:
    """Share of the query's words that the text holds, 1/4 more if the heading holds the first, 1/20 more if it is stale.

    Words are runs of letters, numbers, _ and / of two bytes or more."""
    asked = [w for w in regex.findall(r"[\p{Alphabetic}\p{N}_/]+", query.lower()) if len(w.encode()) >= 2]
    hay = F.lower(F.concat_ws(" ", F.col(heading), F.col("text")) if heading else F.col("text"))
    hits = sum((F.contains(hay, F.lit(w)).cast("int") for w in asked), F.lit(0))
    score = hits / float(max(1, len(asked)))
    if heading and asked:
        score = score + F.when(F.contains(F.lower(heading), F.lit(asked[0])), 0.25).otherwise(0.0)
    if stale:
        score = score + F.when(F.col(stale), 0.05).otherwise(0.0)
    return top(docs.withColumns({"hits": hits, "score": score}).where("hits > 0").select(F.col(id_column).alias("doc_id"), "score"), limit)
