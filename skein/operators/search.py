"""Top-k search: literal, BM25 and vector, always over the eligible documents only.

Membership and facets are applied before anything is ranked, so an excluded document can neither
take a place in the top k nor move the statistics.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens

DEFAULT_LIMIT = 20
#: Okapi parameters.
K1, B = 1.2, 0.75


def limit_or_default(k: int) -> int:
    return k if k > 0 else DEFAULT_LIMIT


def eligible(docs: DataFrame, member: DataFrame | None = None, facets: list[DataFrame] | None = None, key: str = "doc_id") -> DataFrame:
    """The documents in ``member`` and in every facet (each a table with ``key``): semi joins only."""
    for table in [member, *(facets or [])]:
        if table is not None:
            docs = docs.join(table.select(key), key, "left_semi")
    return docs


def facet(table: DataFrame, namespace: str, key: str, value: str) -> DataFrame:
    """The rows of a facet table (namespace, key, value) of one facet."""
    return table.where((F.col("namespace") == namespace) & (F.col("key") == key) & (F.col("value") == value))


def literal(docs: DataFrame, query: str, k: int = DEFAULT_LIMIT, body: str = "body", key: str = "doc_id") -> DataFrame:
    """The first k documents, by key, whose body contains ``query`` as it stands; ``%`` and ``_`` are plain characters."""
    return docs.where(F.col(body).contains(query)).orderBy(key).limit(limit_or_default(k))


def trigrams(text: Column) -> Column:
    """The distinct runs of three code points, in time linear in the text."""
    points = F.split(text, "")
    n = F.greatest(F.size(points) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.zip_with(pairs, F.slice(points, 3, n), lambda a, b: F.concat(a, b)))


def trigram_index(docs: DataFrame, body: str = "body", key: str = "doc_id") -> DataFrame:
    """(trigram, key): postings that narrow a literal search down; to be stored sorted by trigram."""
    return docs.select(key, F.explode(trigrams(F.col(body))).alias("trigram"))


def query_trigrams(query: str) -> list[str]:
    return sorted({query[k : k + 3] for k in range(len(query) - 2)})


def trigram_postings(docs: DataFrame, wanted: list[str], body: str = "body", key: str = "doc_id") -> DataFrame:
    """The rows of ``trigram_index`` for ``wanted`` alone, found by looking for each: no other posting is ever built."""
    held = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col(body), t))
    return docs.select(key, F.explode(held).alias("trigram"))


def literal_by_trigrams(docs: DataFrame, index: DataFrame, query: str, body: str = "body", key: str = "doc_id") -> tuple[DataFrame, str]:
    """All documents that contain ``query``, and how they were found: ``trigram``, or ``scan`` for a query under three characters.

    ``index`` has (trigram, key) rows; a stored one that is sorted by trigram is read in part only.
    """
    wanted = query_trigrams(query)
    if not wanted:
        return docs.where(F.col(body).contains(query)), "scan"
    found = index.where(F.col("trigram").isin(wanted)).groupBy(key).agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted))
    return docs.join(found.select(key), key, "left_semi").where(F.col(body).contains(query)), "trigram"


def _once(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of ``value``, which is evaluated once, however often it is used and wherever the plan moves it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def postings(docs: DataFrame, body: str = "body", key: str = "doc_id", terms: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, term, tf, dl): term frequencies and document lengths in tokens, counted within each row, without a shuffle."""

    def runs(words: Column) -> Column:
        # Equal terms lie side by side: a term's run is cut where the next one begins, in time linear in the text.
        n = F.size(words)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get(words, k) != F.get(words, k - 1)))
        ends = lambda f: F.concat(F.slice(f, 2, F.size(f)), F.array(n))
        cut = _once(first, lambda f: F.zip_with(f, ends(f), lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).alias("tf"), n.alias("dl"))))
        return F.when(n > 0, cut)

    rows = docs.select(key, F.explode(_once(F.array_sort(terms(F.col(body))), runs)).alias("run"))
    return rows.select(key, "run.term", "run.tf", "run.dl")


def bm25_of_postings(index: DataFrame, docs: DataFrame, query: list[str], k: int = DEFAULT_LIMIT, key: str = "doc_id", length: str = "dl") -> DataFrame:
    """The k best (key, score) of ``docs`` (key, length in tokens) by stored ``postings``; only those of the query's terms are read."""
    hits = index.where(F.col("term").isin(query)).select(key, "term", "tf").join(docs.select(key, length), key)
    size, mean = docs.agg(F.count("*"), F.avg(length)).first()
    df = dict(hits.groupBy("term").count().collect())
    if not df:
        return hits.select(key, F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*[F.lit(x) for t in query if t in df for x in (t, math.log(1 + (size - df[t] + 0.5) / (df[t] + 0.5)))])
    tf, dl = F.col("tf").cast("double"), F.col(length).cast("double")
    part = F.element_at(weight, F.col("term")) * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / (mean or 1.0)))
    return hits.groupBy(key).agg((-F.sum(part)).alias("score")).orderBy("score", key).limit(limit_or_default(k))


#: How a text and a query are cut into terms.
Analyser = tuple[Callable[[Column], Column], Callable[[str], list[str]]]


def _scores(docs: DataFrame, query: list[str], body: str, key: str, terms: Callable[[Column], Column]) -> DataFrame:
    """(key, score, hit) of all documents; more negative is better."""
    words = docs.select(key, terms(F.col(body)).alias("words"))

    def count(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w == F.lit(term))).cast("double")

    counted = words.select(key, F.size("words").cast("double").alias("dl"), *[count(t).alias(f"tf{k}") for k, t in enumerate(query)])
    # One row of statistics reaches the driver; the documents are counted within their own rows.
    stats = counted.agg(
        F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(query))]
    ).first()
    score, mean = F.lit(0.0), stats["mean"] or 1.0
    for k in range(len(query)):
        tf = F.col(f"tf{k}")
        weight = math.log(1 + (stats["n"] - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5))
        score = score - F.lit(weight) * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("dl") / mean))
    hit = F.lit(False)
    for k in range(len(query)):
        hit = hit | (F.col(f"tf{k}") > 0)
    return counted.select(key, F.when(hit, score).otherwise(0.0).alias("score"), hit.alias("hit"))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


PLAIN: Analyser = (tokens, query_terms)


def bm25(docs: DataFrame, query: str, k: int = DEFAULT_LIMIT, body: str = "body", key: str = "doc_id", analyser: Analyser = PLAIN) -> DataFrame:
    """The k best (key, score) among the documents that hold a term of ``query``."""
    found = _scores(docs, analyser[1](query), body, key, analyser[0]).where("hit")
    return found.select(key, "score").orderBy("score", key).limit(limit_or_default(k))


def bm25_all(docs: DataFrame, query: str, k: int, body: str = "body", key: str = "doc_id", analyser: Analyser = PLAIN) -> DataFrame:
    """The k best (key, score) among all documents; one without a term has score 0."""
    if k <= 0:
        raise ValueError("k must be positive")
    return _scores(docs, analyser[1](query), body, key, analyser[0]).select(key, "score").orderBy("score", key).limit(k)


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], k: int = DEFAULT_LIMIT, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest (key, distance) by exact cosine distance."""
    probe = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine_distance(F.col(column), probe).alias("distance")).orderBy("distance", key).limit(limit_or_default(k))


def nearest_per_space(vectors: DataFrame, query: list[float], k: int, space: str, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest (space, key, distance, rank) within each embedding space.

    A space is cut in salts that are ranked on their own first, so that no task sorts a whole space.
    """
    probe = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(space, key, cosine_distance(F.col(column), probe).alias("distance"), F.pmod(F.xxhash64(key), F.lit(64)).alias("salt"))
    near = Window.partitionBy(space, "salt").orderBy("distance", key)
    best = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    last = Window.partitionBy(space).orderBy("distance", key)
    return best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("salt")


def hydrate(hits: DataFrame, docs: DataFrame, *details: DataFrame, key: str = "doc_id") -> DataFrame:
    """``hits`` (at most a search limit of rows) with the columns of ``docs`` and, where there are any, of ``details``."""
    out = docs.join(F.broadcast(hits), key)
    for table in details:
        out = out.join(table.join(F.broadcast(hits.select(key)), key, "left_semi"), key, "left")
    return out
