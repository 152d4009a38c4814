"""The registered queries, each an operator applied to whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import identity, text
from skein.operators import catalog, passages, search, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS = "license version public"
PROBE = 'thor'


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that checks it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, lang, source FROM documents WHERE contains(text, '{PROBE}') ORDER BY doc_id LIMIT 20")
def literal_topk(spark, sf_dir):
    return search.literal(table(spark, sf_dir, "documents"), PROBE, body="text").select("doc_id", "lang", "source")


@query(
    "SELECT count(*) FILTER (WHERE contains(text, '%')) AS percent, count(*) FILTER (WHERE contains(text, '_')) AS underscore, "
    "count(*) FILTER (WHERE contains(text, '\\')) AS backslash, count(*) FILTER (WHERE contains(text, 'THE')) AS upper_the FROM documents"
)
def literal_wildcards(spark, sf_dir):
    body = F.col("text")
    return table(spark, sf_dir, "documents").agg(
        *[F.count_if(body.contains(q)).alias(n) for q, n in (("%", "percent"), ("_", "underscore"), ("\\", "backslash"), ("THE", "upper_the"))]
    )


@query(f"SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND contains(text, '{PROBE}') ORDER BY doc_id LIMIT 20")
def literal_faceted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select("doc_id", "lang").where(F.col("lang") == "en")
    return search.literal(search.eligible(docs, facets=[wanted]), PROBE, body="text").select("doc_id", "source")


@query(
    f"SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) "
    f"AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND contains(text, '{PROBE}') ORDER BY doc_id LIMIT 20"
)
def literal_member_facet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    member = table(spark, sf_dir, "labels").where("quality = 1")
    found = search.eligible(docs, member, [docs.where(F.col("lang") == "en")])
    return search.literal(found, PROBE, body="text").select("doc_id", "source")


def _bm25_sql(where: str, matched: bool) -> str:
    terms = search.query_terms(WORDS)
    tf = ", ".join(f"cast(len(list_filter(words, lambda w: w = '{t}')) AS DOUBLE) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"cast(count(*) FILTER (WHERE tf{k} > 0) AS DOUBLE) AS df{k}" for k in range(len(terms)))
    score = " - ".join(
        f"ln(1e0 + (n - df{k} + 0.5e0) / (df{k} + 0.5e0)) * tf{k} * 2.2e0 / (tf{k} + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))" for k in range(len(terms))
    )
    hit = " OR ".join(f"tf{k} > 0" for k in range(len(terms)))
    return (
        f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS words FROM documents {where}), "
        f"c AS (SELECT doc_id, cast(len(words) AS DOUBLE) AS dl, {tf} FROM w), s AS (SELECT cast(count(*) AS DOUBLE) AS n, avg(dl) AS mean, {df} FROM c), "
        f"r AS (SELECT doc_id, 0e0 - {score} AS score FROM c, s {'WHERE ' + hit if matched else ''} ORDER BY score, doc_id LIMIT 20) SELECT doc_id, round(score, 4) + 0e0 AS score FROM r"
    )


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", (F.round("score", 4) + 0.0).alias("score"))


@query(_bm25_sql("", True))
def bm25_topk(spark, sf_dir):
    return _rounded(search.bm25(table(spark, sf_dir, "documents"), WORDS, body="text"))


@query(_bm25_sql("", False))
def bm25_rank_unfiltered(spark, sf_dir):
    return _rounded(search.bm25_all(table(spark, sf_dir, "documents"), WORDS, 20, body="text"))


@query(_bm25_sql("WHERE lang = 'en'", True))
def bm25_faceted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _rounded(search.bm25(search.eligible(docs, facets=[docs.where(F.col("lang") == "en")]), WORDS, body="text"))


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_DISTANCE = "list_cosine_distance(cast(e.embedding AS DOUBLE[]), cast(q.embedding AS DOUBLE[]))"


@query(f"SELECT vec_id, round(d, 4) + 0e0 AS distance FROM (SELECT e.vec_id, {_DISTANCE} AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY d, e.vec_id LIMIT 20)")
def vector_topk(spark, sf_dir):
    found = search.nearest(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir))
    return found.select("vec_id", (F.round("distance", 4) + 0.0).alias("distance"))


@query(
    f"SELECT label, vec_id, rank, round(d, 4) + 0e0 AS distance FROM (SELECT e.label, e.vec_id, {_DISTANCE} AS d, "
    f"row_number() OVER (PARTITION BY e.label ORDER BY {_DISTANCE}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE rank <= 3"
)
def vector_per_space(spark, sf_dir):
    found = search.nearest_per_space(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 3, "label")
    return found.select("label", "vec_id", F.col("rank").cast("long").alias("rank"), (F.round("distance", 4) + 0.0).alias("distance"))


@query(
    f"WITH hits AS (SELECT doc_id FROM documents WHERE contains(text, '{PROBE}') ORDER BY doc_id LIMIT 20) "
    "SELECT doc_id, lang, source, n_chars, quality, toxic FROM hits JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)"
)
def hydrate_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = search.literal(docs, PROBE, body="text").select("doc_id")
    return search.hydrate(hits, docs.select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'General Public')")
def trigram_prefilter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = "General Public"
    # Without a stored index: only the postings of the query's trigrams are built.
    index = search.trigram_postings(docs, search.query_trigrams(wanted), body="text")
    found, _ = search.literal_by_trigrams(docs, index, wanted, body="text")
    return found.select("doc_id")


@query(
    "SELECT c[k] || c[k + 1] || c[k + 2] AS trigram, count(DISTINCT doc_id) AS documents FROM "
    "(SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS k FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)) GROUP BY 1"
)
def trigram_document_counts(spark, sf_dir):
    index = search.trigram_index(table(spark, sf_dir, "documents"), body="text")
    return index.groupBy("trigram").agg(F.count("*").alias("documents"))


@query(
    "SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df, max(dl) AS longest FROM (SELECT doc_id, w AS term, count(*) AS tf, any_value(dl) AS dl FROM "
    "(SELECT doc_id, unnest(words) AS w, len(words) AS dl FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS words FROM documents)) "
    "GROUP BY ALL) GROUP BY 1"
)
def posting_counts(spark, sf_dir):
    rows = search.postings(table(spark, sf_dir, "documents"), body="text")
    return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.max("dl").cast("long").alias("longest"))


@query(_bm25_sql("", True))
def bm25_stored_postings(spark, sf_dir):
    docs, wanted = table(spark, sf_dir, "documents"), search.query_terms(WORDS)
    index = search.postings(docs, body="text")
    lengths = docs.select("doc_id", F.size(text.tokens(F.col("text"))).alias("dl"))
    return _rounded(search.bm25_of_postings(index, lengths, wanted))


# --- passages -------------------------------------------------------------------------------------

_KIND_SQL = "CASE role WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' WHEN 'developer' THEN 'system' ELSE 'user' END"


def _islands_sql(where: str, last: str) -> str:
    return (
        f"WITH r AS (SELECT conv_id, turn, text, {_KIND_SQL} AS kind FROM conversations WHERE text <> '' {where}), "
        "s AS (SELECT *, cast(kind <> 'assistant' OR coalesce(lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) <> 'assistant', true) AS BIGINT) AS starts FROM r), "
        f"p AS (SELECT *, cast(sum(starts) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passage FROM s) {last}"
    )


def _islands(spark: SparkSession, sf_dir: str, spoken: str = "true") -> DataFrame:
    """The islands of all turns; those that are not ``spoken`` have an empty text."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.expr(spoken), F.col("text")).otherwise(""))
    return passages.islands(turns, "conv_id", ["turn"], text.passage_kind(F.lit("message"), F.col("role")))


@query(_islands_sql("", "SELECT conv_id, turn, kind, passage FROM p"))
def passages_islands(spark, sf_dir):
    return _islands(spark, sf_dir).select("conv_id", "turn", "kind", "passage")


@query(_islands_sql("AND turn % 3 <> 1", "SELECT conv_id, passage, min(kind) AS kind, count(*) AS events FROM p GROUP BY conv_id, passage"))
def passages_skip_empty(spark, sf_dir):
    return passages.bodies(_islands(spark, sf_dir, "turn % 3 <> 1"), "conv_id", "turn").select("conv_id", "passage", "kind", "events")


@query(f"SELECT {_KIND_SQL} AS kind, count(*) AS n FROM conversations GROUP BY 1")
def passage_kinds(spark, sf_dir):
    kind = text.passage_kind(F.lit("message"), F.col("role")).alias("kind")
    return table(spark, sf_dir, "conversations").groupBy(kind).agg(F.count("*").alias("n"))


@query(_islands_sql("AND turn % 3 <> 1", "SELECT conv_id, passage, sha256(string_agg(text, chr(10) ORDER BY turn)) AS body_sha256 FROM p GROUP BY conv_id, passage"))
def passage_body(spark, sf_dir):
    made = passages.bodies(_islands(spark, sf_dir, "turn % 3 <> 1"), "conv_id", "turn")
    return made.select("conv_id", "passage", F.sha2("body", 256).alias("body_sha256"))


_BYTE = "hex(array_slice(data, {0} + 1, {0} + 1)) BETWEEN '80' AND 'BF'"


def _stop_sql(at: str, most: int = 4096) -> str:
    """Where the part that begins at byte ``at`` ends: at the last line end within reach, else between two code points."""
    back = " ".join(f"WHEN NOT ({_BYTE.format(f'({at} + {most - k})')}) THEN {k}" for k in range(3))
    return (
        f"CASE WHEN size <= {most} THEN size ELSE coalesce(list_max(list_filter(stops, lambda s: s > {at} AND s <= {at} + {most})), {at} + {most} - CASE {back} ELSE 3 END) END"
    )


@query(
    "WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), "
    "x AS (SELECT doc_id, cast(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM l), "
    "g AS (SELECT doc_id, list(stop) AS stops FROM x GROUP BY doc_id), "
    "d AS (SELECT doc_id, encode(text) AS data, strlen(text) AS size, list_transform(stops, lambda s: least(s, strlen(text))) AS stops FROM documents JOIN g USING (doc_id)), "
    f"p AS (SELECT doc_id, 0 AS part, 0::BIGINT AS start, {_stop_sql('0')} AS stop FROM d UNION ALL "
    f"SELECT p.doc_id, part + 1, p.stop, {_stop_sql('p.stop')} FROM p JOIN d USING (doc_id) WHERE p.stop < size) "
    "SELECT doc_id, part, count(*) OVER (PARTITION BY doc_id) AS parts, stop - start AS bytes FROM p"
)
def split_parts_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return text.split_bodies(docs, 4096).select("doc_id", "part", "parts", F.octet_length("body").alias("bytes"))


@query("SELECT doc_id, cast(strlen(t) - strlen(replace(t, chr(0), '')) AS BIGINT) AS removed, sha256(replace(t, chr(0), '')) AS body_sha256 FROM (SELECT doc_id, replace(text, ' the ', chr(0)) AS t FROM documents)")
def nul_removal(spark, sf_dir):
    injected = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" the "), F.lit("\0")).alias("t"))
    return injected.select("doc_id", text.removed_nul(F.col("t")).alias("removed"), F.sha2(text.without_nul(F.col("t")), 256).alias("body_sha256"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN t[1:80] || '...' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def display_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.display(F.col("text"), 80).alias("excerpt"))


# --- identities -----------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(encode('v1') || unhex('00') || encode('user') || unhex('00') || encode('0') || unhex('00') || encode(text)) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.content_hash("v1", "user", F.lit(0), F.col("text")).alias("content_hash"))


def _framed_sql(*values: str) -> str:
    return " || ".join(f"unhex(printf('%08x', octet_length(encode({v})))) || encode({v})" for v in values)


@query(f"SELECT doc_id, 'session:sha256:' || sha256({_framed_sql(chr(39) + identity.ID_VERSION + chr(39), chr(39) + 'session' + chr(39), 'source', 'lang', 'cast(doc_id AS VARCHAR)')}) AS id FROM documents")
def derived_ids(spark, sf_dir):
    made = identity.derived_id("session", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("id"))


# --- catalog --------------------------------------------------------------------------------------


@query(
    "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) UNION ALL "
    "SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)"
)
def generation_counts(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    tables = {"orders": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key"), "customer": customer}
    return catalog.counts(customer.where("c_nationkey < 5"), tables, "key")


@query(
    "WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 5), b AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey BETWEEN 3 AND 8), "
    "d AS (SELECT k, 1 AS sign FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, -1 FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) "
    "SELECT 'orders' AS name, cast(coalesce(sum(sign), 0) AS BIGINT) AS n FROM orders JOIN d ON o_custkey = k UNION ALL "
    "SELECT 'customer', cast(coalesce(sum(sign), 0) AS BIGINT) FROM customer JOIN d ON c_custkey = k"
)
def delta_counts(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    change = catalog.delta(customer.where("c_nationkey < 5").select("key"), customer.where("c_nationkey between 3 and 8").select("key"))
    return catalog.delta_counts(change, {"orders": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key"), "customer": customer}, "key")


@query(
    "WITH u AS (SELECT lang, source, n_chars FROM documents GROUP BY ALL HAVING count(DISTINCT doc_id) = 1) "
    "SELECT count(*) AS relations, count(*) FILTER (WHERE u.lang IS NOT NULL) AS resolved, count(*) FILTER (WHERE u.lang IS NULL) AS unresolved "
    "FROM documents d LEFT JOIN u USING (lang, source, n_chars)"
)
def relation_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return catalog.resolution(docs.drop("doc_id"), docs, ["lang", "source", "n_chars"], "doc_id")


@query("SELECT c.conv_id, c.turn, p.turn AS parent FROM conversations c LEFT JOIN (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) = 1) p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def reply_parent_unique(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return catalog.unique_parents(turns, "turn", F.col("turn") - 1, "conv_id").withColumnRenamed("parent_found", "parent")


@query(
    "SELECT user_id, k, min(event_id) FILTER (WHERE event_type = 'click') AS call, min(event_id) FILTER (WHERE event_type = 'view') AS result "
    "FROM (SELECT *, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id, k "
    "HAVING count(*) FILTER (WHERE event_type = 'click') = 1 AND count(*) FILTER (WHERE event_type = 'view') = 1"
)
def tool_pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return catalog.tool_pairs(events, ["user_id", "k"], F.col("event_type") == "click", F.col("event_type") == "view", "event_id")


@query(
    "SELECT n_nationkey AS generation, CASE WHEN n_regionkey = 0 THEN 'failed' ELSE 'superseded' END AS state, count(*) AS rows FROM nation JOIN customer ON c_nationkey = n_nationkey "
    "WHERE n_regionkey IN (0, 1) AND n_nationkey <> 1 GROUP BY ALL"
)
def unreclaimed_generations(spark, sf_dir):
    state = F.when(F.col("n_regionkey") == 0, "failed").when(F.col("n_regionkey") == 1, "superseded").otherwise("building")
    generations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("generation"), state.alias("state"))
    return catalog.unreclaimed(generations, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("generation")), 1)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.missing(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


@query(
    "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 7 WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 1 ELSE 0 END AS disappeared_at FROM customer"
)
def tombstones(spark, sf_dir):
    # What was gone before keeps its time.
    known = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, 7).alias("disappeared_at"))
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.tombstoned(known, seen, "c_custkey", F.lit(1)).select("c_custkey", F.coalesce("disappeared_at", F.lit(0)).alias("disappeared_at"))


@query(
    "SELECT count(*) FILTER (WHERE p.doc_id IS NULL) AS added, count(*) FILTER (WHERE l.doc_id IS NULL) AS removed, "
    "count(*) FILTER (WHERE l.doc_id = p.doc_id AND l.r <> p.r) AS changed FROM (SELECT doc_id, n_chars % 7 AS r FROM documents WHERE lang <> 'es') l "
    "FULL JOIN (SELECT doc_id, n_chars % 5 AS r FROM documents WHERE lang <> 'fr') p USING (doc_id)"
)
def freshness_behind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    now, before = docs.where("lang <> 'es'").withColumn("r", F.expr("n_chars % 7")), docs.where("lang <> 'fr'").withColumn("r", F.expr("n_chars % 5"))
    return catalog.behind(now, before, "doc_id", "r")


@query(
    "WITH v AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN left(text, 40) WHEN doc_id % 7 = 2 THEN text || 'x' "
    "WHEN doc_id % 7 IN (3, 4) THEN 'y' || text ELSE text END AS a, text AS b, doc_id % 7 = 4 AS moved FROM documents), "
    "w AS (SELECT doc_id, encode(a) AS a, encode(b) AS b, moved FROM v) "
    "SELECT doc_id, CASE WHEN a IS NULL THEN 'initial' WHEN sha256(a) = sha256(b) THEN 'unchanged' WHEN moved THEN 'replaced' "
    "WHEN octet_length(b) > octet_length(a) AND sha256(array_slice(b, 1, octet_length(a))) = sha256(a) THEN 'grown' "
    "WHEN octet_length(b) < octet_length(a) AND sha256(array_slice(a, 1, octet_length(b))) = sha256(b) THEN 'truncated' ELSE 'rewritten' END AS change_kind FROM w"
)
def change_classify(spark, sf_dir):
    # A file of another identity in the same place.
    moved = F.when(F.expr("doc_id % 7 = 4"), "j").otherwise("i")
    return _versions(spark, sf_dir).select("doc_id", catalog.change_kind(F.col("a"), F.col("b"), F.lit("i"), moved).alias("change_kind"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text before (some unseen, cut, longer or different) and now."""
    old = F.expr(
        "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN left(text, 40) WHEN 2 THEN concat(text, 'x') WHEN 3 THEN concat('y', text) WHEN 4 THEN concat('y', text) ELSE text END"
    )
    return table(spark, sf_dir, "documents").select("doc_id", old.cast("binary").alias("a"), F.col("text").cast("binary").alias("b"))


@query(
    "WITH v AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN left(text, 40) WHEN doc_id % 7 = 2 THEN text || 'x' WHEN doc_id % 7 IN (3, 4) THEN 'y' || text ELSE text END AS a, text AS b, doc_id % 7 = 4 AS moved FROM documents) "
    "SELECT CASE WHEN a IS NULL THEN 'initial' WHEN a = b THEN 'unchanged' WHEN moved THEN 'replaced' WHEN starts_with(b, a) THEN 'grown' WHEN starts_with(a, b) THEN 'truncated' ELSE 'rewritten' END AS change_kind, count(*) AS n FROM v GROUP BY 1"
)
def change_histogram(spark, sf_dir):
    return change_classify(spark, sf_dir).groupBy("change_kind").agg(F.count("*").alias("n"))


@query(
    "SELECT c.c_custkey AS occurrence, CASE WHEN o.d = c.c_nationkey AND c.c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'reuse' "
    "WHEN o.d = c.c_nationkey THEN 'rebuild' ELSE 'read' END AS action FROM customer c "
    "LEFT JOIN (SELECT o_custkey, min(c_nationkey) AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.o_custkey = c.c_custkey"
)
def reuse_split(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("occurrence"), F.col("c_nationkey").alias("discovery"), "c_acctbal")
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("occurrence")).distinct()
    checkpoints = customer.join(ordered, "occurrence").select("occurrence", "discovery", F.col("occurrence").alias("revision"))
    return catalog.reuse(customer.select("occurrence", "discovery"), checkpoints, customer.where("c_acctbal > 0").select(F.col("occurrence").alias("revision")))


@query(
    "SELECT coalesce(k.c_custkey, s.c_custkey) AS key, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_mktsegment ELSE k.c_mktsegment END AS locator, "
    "CASE WHEN k.c_custkey IS NULL THEN 2 ELSE 1 END AS first_seen, CASE WHEN s.c_custkey IS NULL THEN 1 ELSE 2 END AS last_seen, "
    "CASE WHEN s.c_custkey IS NULL AND k.c_custkey % 2 = 0 THEN 1 END AS disappeared_at "
    "FROM (SELECT * FROM customer WHERE c_nationkey < 15) k FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 10) s ON k.c_custkey = s.c_custkey"
)
def upsert_observe(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("locator"), "c_nationkey")
    known = customer.where("c_nationkey < 15").select("key", "locator", F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"), F.expr("CASE WHEN key % 2 = 0 THEN 1 END").alias("disappeared_at"))
    return catalog.observed(known, customer.where("c_nationkey > 10"), "key", ["locator"], F.lit(2))


@query("SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id")
def checkpoint_latest(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT namespace, key, value, count(*) AS n FROM (SELECT 'document' AS namespace, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT 'document', 'source', source FROM documents) GROUP BY ALL")
def facet_counts(spark, sf_dir):
    return catalog.facet_counts(table(spark, sf_dir, "documents"), [("document", "lang"), ("document", "source")])


@query(
    "SELECT 'orders' AS name, count(*) AS dangling FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey <> 3) UNION ALL "
    "SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)"
)
def referential_check(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders")
    lost = catalog.missing(orders, customer, ["o_custkey"]).agg(F.count("*").alias("dangling")).withColumn("name", F.lit("orders"))
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    lines = catalog.missing(table(spark, sf_dir, "lineitem"), keys, ["l_orderkey"]).agg(F.count("*").alias("dangling")).withColumn("name", F.lit("lineitem"))
    return lost.unionByName(lines).select("name", "dangling")


@query(
    "SELECT count(*) AS documents, count(*) FILTER (WHERE h IN (SELECT sha256(text) FROM documents WHERE lang = 'en')) AS cached FROM (SELECT sha256(text) AS h FROM documents)"
)
def embedding_cache_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("space"), F.sha2("text", 256).alias("content_hash"))
    cache = docs.where("lang = 'en'").groupBy("space", "content_hash").agg(F.min("doc_id").alias("embedding"))
    return catalog.with_cached_embeddings(docs, cache).agg(F.count("*").alias("documents"), F.count_if("cached").alias("cached"))


# --- sessions -------------------------------------------------------------------------------------


@query("SELECT user_id, epoch_us(m) AS activity FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY 1) WHERE m BETWEEN TIMESTAMP '2024-01-30 10:00:00' AND TIMESTAMP '2024-01-30 20:00:00'")
def activity_filter(spark, sf_dir):
    active = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("m"))
    since, until = (F.lit(f"2024-01-30 {t}").cast("timestamp_ntz").cast("timestamp") for t in ("10:00:00", "20:00:00"))
    return sessions.activity_between(active, since, until, F.col("m")).select("user_id", F.unix_micros("m").alias("activity"))


@query("SELECT doc_id, coalesce(a, -1) AS a, row_number() OVER (ORDER BY a DESC NULLS LAST, source, doc_id) AS place FROM (SELECT doc_id, source, CASE WHEN n_chars % 4 <> 0 THEN n_chars END AS a FROM documents) ")
def session_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr("CASE WHEN n_chars % 4 <> 0 THEN n_chars END").alias("a"))
    found = sessions.listed(docs, "a", "source", "doc_id")
    # The place of each row in the sorted output: all of them are listed.
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).select("doc_id", F.coalesce("a", F.lit(-1)).alias("a"), "place")


@query(
    "SELECT conv_id AS session, coalesce(arg_max(text, turn) FILTER (WHERE role = 'system' AND text <> ''), arg_max(text, turn) FILTER (WHERE role = 'user' AND text <> '')) AS title FROM conversations GROUP BY 1"
)
def title_precedence(spark, sf_dir):
    kinds = F.when(F.col("role") == "system", "custom-title").when(F.col("role") == "user", "ai-title")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", kinds.alias("kind"), "text")
    return sessions.titles(rows, "session", "turn", "kind", "text")


@query("SELECT url FROM pages WHERE starts_with(url, 'https://www') OR starts_with(string_split(url, ':')[-1], 'https://www')")
def prefix_selector(spark, sf_dir):
    return sessions.selected(table(spark, sf_dir, "pages").select("url"), "https://www", "url")
