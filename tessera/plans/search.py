"""Search queries over ``documents`` (chunks), ``embeddings`` (vectors) and ``benchmark`` (query texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code_tokens, sanitized, token_estimate
from ..operators import bm25, fusion, store, vector_index, vectors
from ..sources.shared import spread, spread_few
from . import stored

QUERY = "the onthe and tionStation the"
SPACED = "regexp_replace(regexp_replace(coalesce({0}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')"
TOKENS = "list_filter(string_split(lower(" + SPACED + "), ' '), lambda t: length(t) > 1)"
INDEX = f"""tok AS (SELECT doc_id AS id, {TOKENS.format('text')} AS ts FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
 facts AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
 post AS (SELECT id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM tok) GROUP BY ALL),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM dfs, facts),
 wts AS (SELECT term, avgdl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS w FROM raw)"""
PART = "times * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"
ASKED, RARE = "['the', 'onthe', 'and', 'tion', 'station', 'the']", "['tion', 'station', 'onthe']"
SCORES = INDEX + f""",
 ask AS (SELECT term, count(*) AS times FROM (SELECT unnest({ASKED}) AS term) GROUP BY term),
 hit AS (SELECT id, sum({PART}) AS s FROM ask JOIN wts USING (term) JOIN post USING (term) GROUP BY id),
 bm AS (SELECT id, round(coalesce(s, 0), 6) AS score FROM tok LEFT JOIN hit USING (id))"""
COSINE = """vs AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM vs WHERE id = 0),
 cs AS (SELECT id, label, round(list_cosine_similarity(v, q), 6) AS score FROM vs, q)"""


def docs(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return bm25.tokenized(spread(docs(spark, d).select("doc_id", "text"), "doc_id"))


def query_vector(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def tokenize_counts(spark, d):
    # the tokens are made once: both numbers come from one struct
    cut = spread(docs(spark, d).select("doc_id", "text")).select("doc_id", F.inline(F.array(F.struct(code_tokens(F.col("text")).alias("t")))))
    return cut.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def token_df_top(spark, d):
    return bm25.document_frequency(tokens(spark, d)).orderBy(F.desc("df"), "term").limit(50)


def token_estimates(spark, d):
    return docs(spark, d).select("doc_id", token_estimate(F.col("text")).alias("token_count"))


def bm25_index(spark, d):
    return bm25.postings(tokens(spark, d)).select("id", "term", "tf", "dl")


def bm25_scores(spark, d):
    return bm25.scores(tokens(spark, d), QUERY)


def bm25_topk(spark, d):
    return bm25.search(tokens(spark, d), QUERY, 10)


def bm25_multi_query(spark, d):
    rows = bm25.tokenized(spread_few(docs(spark, d).select("doc_id", "text"), "doc_id"))
    return bm25.search_many(rows, docs(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)


def multi_query_merge(spark, d):
    return fusion.merged_queries(bm25_multi_query(spark, d), 20)


def index_size(spark, d):
    return tokens(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("dl"), 6).alias("avg_length"))


def cosine_scores(spark, d):
    return vectors.scores(docs(spark, d, "embeddings"), query_vector(spark, d))


def knn_cosine_topk(spark, d):
    return vectors.search(docs(spark, d, "embeddings"), query_vector(spark, d), 10)


def knn_filtered_label(spark, d):
    return vectors.search(docs(spark, d, "embeddings"), query_vector(spark, d), 10, where=F.col("label") == 3)


def knn_min_similarity(spark, d):
    return vectors.search(docs(spark, d, "embeddings"), query_vector(spark, d), 50, 0.2)


def similar_pairs(spark, d):
    return vectors.similar_within(docs(spark, d, "embeddings"), "label", 0.25, folder=stored.folder(spark))


def asked_vector(spark: SparkSession, d: str) -> list[float] | None:
    """The query's vector: that of vec_id 0."""
    found = query_vector(spark, d).first()
    return list(found["q"]) if found and found["q"] else None


def rrf(mode, lang: str | None = None):
    """Hybrid search over the stored indexes; a language limits both sides."""

    def search(spark, d):
        allowed = docs(spark, d).where(F.col("lang") == lang).select("doc_id") if lang else None
        return fusion.stored_hybrid(stored.keyword_index(spark, d), stored.vector_index(spark, d), QUERY, asked_vector(spark, d), 10, mode, allowed=allowed)

    return search


def rrf_unstored(spark, d):
    """Hybrid search without indexes."""
    return fusion.hybrid(tokens(spark, d), docs(spark, d, "embeddings"), QUERY, query_vector(spark, d), 10)


def keyword_filtered(spark, d):
    """Keyword search among the documents of some sources."""
    allowed = docs(spark, d).where("source IN ('src1', 'src2', 'src3')").select("doc_id")
    return stored.keyword_index(spark, d).search(QUERY, 10, allowed)


def keyword_filtered_zeros(spark, d):
    """The same with a query of rare words, filled up with documents that hold none."""
    allowed = docs(spark, d).where("lang = 'es'").select("doc_id")
    return stored.keyword_index(spark, d).search("tionStation onthe", 15, allowed, zeros=True)


def knn_index_topk(spark, d):
    """The exact way of the vector index."""
    return stored.vector_index(spark, d).search(asked_vector(spark, d) or [], 10, exact=True)


def knn_index_filtered(spark, d):
    return stored.vector_index(spark, d).search(asked_vector(spark, d) or [], 10, where=F.col("label").isin(3, 5), exact=True)


def knn_index_changed(spark, d):
    """Search after an insert, a replacement and a delete: each writes only its own rows."""
    rows = docs(spark, d, "embeddings")
    index = vector_index.VectorIndex(spark, stored.folder(spark))
    index.build(rows.where("vec_id % 3 > 0").withColumn("embedding", F.when(F.col("vec_id") % 3 == 1, F.reverse("embedding")).otherwise(F.col("embedding"))))
    index.insert(rows.where("vec_id % 3 < 2"))
    index.delete(rows.where("vec_id % 7 = 1").select("vec_id"))
    return index.search(asked_vector(spark, d) or [], 25, exact=True)


def knn_recall(spark, d):
    """Whether the pruned search finds 0.95 of the ten nearest, over the first 20 vectors whose id is divisible by 40 (a report, against the exact way)."""
    index, rows = stored.vector_index(spark, d), docs(spark, d, "embeddings")
    asked = rows.where("vec_id % 40 = 0").orderBy("vec_id").limit(20).collect()
    hits = sum(len({r["id"] for r in index.search(q["embedding"], 10, -1.0).collect()} & {r["id"] for r in index.search(q["embedding"], 10, -1.0, exact=True).collect()}) for q in asked)
    return spark.createDataFrame([(len(asked), hits / max(1, 10 * len(asked)) >= 0.95)], "queries long, enough boolean")


def similar_banded(spark, d):
    return vector_index.similar_pairs(docs(spark, d, "embeddings"), 0.5, recall=0.9999, bits=8, folder=stored.folder(spark))


def hybrid_payload(spark, d):
    found = rrf("hybrid")(spark, d)
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "lang", "source", F.length("text").cast("long").alias("chars"))
    return rows.join(F.broadcast(found), "id").select("id", "score", "lang", "source", "chars")


def sanitize_text(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(sanitized(F.col("text")), 256).alias("digest"))


def metadata_filter(spark, d):
    found = store.metadata_search(docs(spark, d), {"lang": "en", "source": "src3"}, 50, key="doc_id")
    return found.select("doc_id", "lang", "source", "score")


def metadata_by_layer(spark, d):
    return store.metadata_search(docs(spark, d, "embeddings").select("vec_id", "label"), {"label": 3}, 100, key="vec_id")


def content_hash_dedup(spark, d):
    key = F.sha2("text", 256)
    return docs(spark, d).groupBy(key.alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def point_lookup(spark, d):
    return docs(spark, d).where("doc_id = 7").select("doc_id", "lang", "source").limit(1)


def embed_hash(spark, d):
    done = vectors.embed_distinct(docs(spark, d).select("doc_id", F.col("text").alias("content")), vectors.hashed_embedder(16))
    return done.select("doc_id", "embedding_status", F.size("embedding").alias("dims"))


def rrf_sql(alpha: float, only: str = "true") -> str:
    return f"""WITH {SCORES}, {COSINE},
 kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rk FROM (SELECT id, score FROM bm WHERE {only} ORDER BY score DESC, id LIMIT 20)),
 se AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rs FROM (SELECT id, score FROM cs WHERE {only} ORDER BY score DESC, id LIMIT 20) WHERE score >= -1),
 f AS (SELECT id, round(coalesce({alpha}::DOUBLE / (60 + rs), 0) + coalesce({1 - alpha}::DOUBLE / (60 + rk), 0), 9) AS score FROM se FULL OUTER JOIN kw USING (id))
 SELECT id, score FROM f ORDER BY score DESC, id LIMIT 10"""


MULTI = INDEX + f""",
 ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
 hit AS (SELECT query_id, id, round(sum({PART}), 6) AS score FROM ask JOIN wts USING (term) JOIN post USING (term) GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit QUALIFY rank <= 5)"""
CLEAN = "regexp_replace(regexp_replace(regexp_replace(text, '[^\\n\\t\\r\\x20-\\x7E\\x{A0}-\\x{10FFFF}]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
QUERIES = {
    "tokenize_counts": (tokenize_counts, f"SELECT doc_id, len({TOKENS.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOKENS.format('text')}))::BIGINT AS n_terms FROM documents"),
    "token_df_top": (token_df_top, f"WITH {INDEX} SELECT term, df FROM dfs ORDER BY df DESC, term LIMIT 50"),
    "token_estimate": (token_estimates, "SELECT doc_id, (length(text) // 4)::BIGINT AS token_count FROM documents"),
    "bm25_index": (bm25_index, f"WITH {INDEX} SELECT id, term, tf, dl::BIGINT AS dl FROM post"),
    "bm25_scores": (bm25_scores, f"WITH {SCORES} SELECT id, score FROM bm"),
    "bm25_topk": (bm25_topk, f"WITH {SCORES} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10"),
    "bm25_multi_query": (bm25_multi_query, f"WITH {MULTI} SELECT query_id, id, score, rank::INT AS rank FROM top"),
    "multi_query_merge": (multi_query_merge, f"WITH {MULTI} SELECT id, max(score) AS score, count(*) AS n_queries FROM top GROUP BY id ORDER BY score DESC, id LIMIT 20"),
    "index_size": (index_size, f"WITH {INDEX} SELECT n AS documents, round(avgdl, 6) AS avg_length FROM facts"),
    "cosine_scores": (cosine_scores, f"WITH {COSINE} SELECT id, score FROM cs"),
    "knn_cosine_topk": (knn_cosine_topk, f"WITH {COSINE} SELECT id, score FROM (SELECT id, score FROM cs ORDER BY score DESC, id LIMIT 10) WHERE score >= 0"),
    "knn_filtered_label": (knn_filtered_label, f"WITH {COSINE} SELECT id, score FROM (SELECT id, score FROM cs WHERE label = 3 ORDER BY score DESC, id LIMIT 10) WHERE score >= 0"),
    "knn_min_similarity": (knn_min_similarity, f"WITH {COSINE} SELECT id, score FROM (SELECT id, score FROM cs ORDER BY score DESC, id LIMIT 50) WHERE score >= 0.2"),
    "similar_pairs": (similar_pairs, "WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM v x JOIN v y ON x.label = y.label AND x.id < y.id WHERE round(list_cosine_similarity(x.v, y.v), 6) >= 0.25"),
    "rrf_hybrid": (rrf("hybrid"), rrf_sql(0.5)),
    "rrf_semantic_only": (rrf("semantic"), rrf_sql(1.0)),
    "rrf_keyword_only": (rrf("keyword"), rrf_sql(0.0)),
    "rrf_unstored": (rrf_unstored, rrf_sql(0.5)),
    "hybrid_filtered": (rrf("hybrid", "en"), rrf_sql(0.5, "id IN (SELECT doc_id FROM documents WHERE lang = 'en')")),
    "keyword_filtered": (keyword_filtered, f"WITH {SCORES} SELECT id, score FROM bm WHERE score <> 0 AND id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')) ORDER BY score DESC, id LIMIT 10"),
    "keyword_filtered_zeros": (keyword_filtered_zeros, f"WITH {SCORES.replace(ASKED, RARE)} SELECT id, score FROM bm WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'es') ORDER BY score DESC, id LIMIT 15"),
    "knn_index_topk": (knn_index_topk, f"WITH {COSINE} SELECT id, score FROM (SELECT id, score FROM cs ORDER BY score DESC, id LIMIT 10) WHERE score >= 0"),
    "knn_index_filtered": (knn_index_filtered, f"WITH {COSINE} SELECT id, score FROM (SELECT id, score FROM cs WHERE label IN (3, 5) ORDER BY score DESC, id LIMIT 10) WHERE score >= 0"),
    "knn_index_changed": (knn_index_changed, f"WITH {COSINE} SELECT id, score FROM (SELECT id, score FROM cs WHERE id % 7 <> 1 ORDER BY score DESC, id LIMIT 25) WHERE score >= 0"),
    "similar_pairs_banded": (similar_banded, "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT x.id AS a, y.id AS b, 1::BIGINT AS a_copies, 1::BIGINT AS b_copies, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM v x JOIN v y ON x.id < y.id WHERE round(list_cosine_similarity(x.v, y.v), 6) >= 0.5"),
    "hybrid_payload": (hybrid_payload, f"SELECT id, score, lang, source, length(text)::BIGINT AS chars FROM ({rrf_sql(0.5)}) JOIN documents ON id = doc_id"),
    "sanitize_text": (sanitize_text, f"SELECT doc_id, sha256(regexp_replace(substring({CLEAN}, 1, 8000), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) AS digest FROM documents"),
    "metadata_filter": (metadata_filter, "SELECT doc_id, lang, source, 1.0::DOUBLE AS score FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY doc_id LIMIT 50"),
    "metadata_by_layer": (metadata_by_layer, "SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 100"),
    "content_hash_dedup": (content_hash_dedup, "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "point_lookup": (point_lookup, "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7"),
    "embed_hash": (embed_hash, None),
    "knn_recall": (knn_recall, "SELECT least(20, count(*))::BIGINT AS queries, true AS enough FROM embeddings WHERE vec_id % 40 = 0"),
}
