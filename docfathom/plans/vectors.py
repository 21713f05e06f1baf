"""Queries of vector search, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyword as K
from ..operators import vectors as V
from .keyword import TOK, WORDS
from .registry import query, table

D = "list_transform(embedding, lambda x: x::DOUBLE)"
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
SEM = f"""e AS (SELECT vec_id, label, {D} AS v FROM embeddings), sem AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS r
  FROM (SELECT a.vec_id // 100 AS query_id, b.vec_id AS id, {COS} AS score FROM e a, e b WHERE a.vec_id % 100 = 0) QUALIFY r <= 20)"""


def kw_sql() -> str:
    from .keyword import IDF, LITERALS, STOP_SQL

    return rf"""{TOK}, q AS ({LITERALS}), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM q)
  WHERE length(term) >= 2 AND term NOT IN ({STOP_SQL}) GROUP BY 1, 2),
kw AS (SELECT query_id, doc_id AS id, round(sum(times * greatest(0.25, {IDF}) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avg_length))), 9) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(sum(times * greatest(0.25, {IDF}) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avg_length))), 9) DESC, doc_id) AS r
  FROM post JOIN df USING (term) JOIN qt USING (term) CROSS JOIN stats GROUP BY query_id, doc_id QUALIFY r <= 20)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def semantic(spark, sf, k=20):
    """Every row whose id is divisible by 100 is a query, against all rows; query_id is that hundredth."""
    rows = vectors(spark, sf)
    found = V.knn_join(rows, k, queries=rows.where("id % 100 = 0"), same=False)
    return found.select((F.col("query_id") / 100).cast("long").alias("query_id"), "id", F.col("similarity").alias("score"))


def keyword(spark, sf, k=20):
    found = K.bm25(table(spark, sf, "documents"), K.literal_queries(spark, WORDS), 2 * k).withColumn("score", F.round("score", 9))
    return K.top(found.drop("rank"), ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", F.col("doc_id").alias("id"), "score")


@query("knn_cosine_topk", f"WITH {SEM} SELECT query_id, id, round(score, 6) AS similarity, round(1 - score, 6) AS distance FROM sem WHERE r <= 10")
def knn_topk(spark, sf):
    """J08, V02, X36"""
    return semantic(spark, sf, k=10).select("query_id", "id", F.round("score", 6).alias("similarity"), F.round(1 - F.col("score"), 6).alias("distance"))


@query("knn_join", f"""WITH e AS (SELECT vec_id, {D} AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS} AS s FROM e a, e b WHERE a.vec_id <> b.vec_id)
  SELECT query_id, id, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) <= 5""")
def knn_join(spark, sf):
    """The five nearest of every vector"""
    return V.knn_join(vectors(spark, sf), 5).withColumn("similarity", F.round("similarity", 6))


def fusion_sql(score: str, where: str = "") -> str:
    return f"""WITH {SEM}, {kw_sql()}, m AS (SELECT query_id, id, a.score AS sa, a.r AS ra, b.score AS sb, b.r AS rb, a.na, b.nb FROM
  (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS na FROM sem WINDOW w AS (PARTITION BY query_id)) a
  FULL JOIN (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS nb FROM kw WINDOW w AS (PARTITION BY query_id)) b USING (query_id, id)),
f AS (SELECT query_id, id, round({score}, 12) AS score, CASE WHEN sb IS NULL THEN 'vector' WHEN sa IS NULL THEN 'keyword' ELSE 'hybrid' END AS method FROM m)
SELECT query_id, id, round(score, 6) AS score, method, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM f QUALIFY rank <= 10"""


def shown(df):
    return df.select("query_id", "id", F.round("score", 6).alias("score"), "method", F.col("rank").cast("long").alias("rank"))


@query("rrf_fusion", fusion_sql("coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0)"))
def rrf(spark, sf):
    """V03, V05, U02"""
    return shown(V.fused(semantic(spark, sf), keyword(spark, sf), 10, "rrf", (1.0, 1.0)))


@query("weighted_rrf", fusion_sql("0.6 * coalesce(1.0 / (60 + ra), 0) + 0.4 * coalesce(1.0 / (60 + rb), 0)"))
def weighted_rrf(spark, sf):
    """V07"""
    return shown(V.fused(semantic(spark, sf), keyword(spark, sf), 10, "rrf", (0.6, 0.4)))


@query("linear_fusion", fusion_sql("0.5 * coalesce(na, 0) + 0.5 * coalesce(nb, 0)"))
def linear(spark, sf):
    """V04, X35"""
    return shown(V.fused(semantic(spark, sf), keyword(spark, sf), 10, "linear"))


@query("weighted_sum", fusion_sql("0.6 * coalesce(sa, 0) + 0.4 * coalesce(sb, 0)"))
def weighted_sum(spark, sf):
    """V06"""
    return shown(V.fused(semantic(spark, sf), keyword(spark, sf), 10, "sum", (0.6, 0.4)))


@query("topk_merge", f"""WITH {SEM}, {kw_sql()}, m AS (SELECT query_id, id, coalesce(a.score, b.score) AS score, a.r AS ra, b.r AS rb FROM (SELECT * FROM sem WHERE r <= 6) a FULL JOIN (SELECT * FROM kw WHERE r <= 4) b USING (query_id, id))
  SELECT query_id, id, round(score, 6) AS score, CASE WHEN rb IS NULL THEN 'vector' WHEN ra IS NULL THEN 'keyword' ELSE 'hybrid' END AS method,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(ra, 1073741824 + rb))::BIGINT AS rank FROM m QUALIFY rank <= 10""")
def topk_merge(spark, sf):
    """V08"""
    return shown(V.fused(semantic(spark, sf), keyword(spark, sf), 10, "top_k", (0.6, 0.4)))


@query("combined_results", f"""WITH {SEM}, {kw_sql()}, u AS (SELECT query_id, 'vector' AS method, 1 AS p, id, greatest(0, 1 - 0.1 * (r - 1)) AS score, r FROM sem UNION ALL SELECT query_id, 'keyword', 2, id, greatest(0, 1 - 0.1 * (r - 1)), r FROM kw)
  SELECT query_id, id, round(score, 6) AS score, method FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY p) = 1""")
def combined(spark, sf):
    """Positional scores, each result once, vector results first"""
    parts = [V.ranked(x).select("query_id", "id", "r", F.lit(m).alias("method"), F.lit(p).alias("p")) for p, m, x in ((1, "vector", semantic(spark, sf)), (2, "keyword", keyword(spark, sf)))]
    once = K.top(parts[0].unionByName(parts[1]), ["query_id", "id"], [F.asc("p")], 1)
    return once.select("query_id", "id", F.round(F.greatest(F.lit(0.0), 1 - 0.1 * (F.col("r") - 1)), 6).alias("score"), "method")


LINK = f"""{SEM}, hits AS (SELECT query_id, id, 1 - score AS distance, text, lower(text) AS low FROM sem JOIN documents ON doc_id = id)"""


@query("rerank_light", f"""WITH {LINK}, w AS (SELECT *, list_filter(regexp_split_to_array(low, '\\s+'), lambda x: x <> '') AS words FROM hits),
  s AS (SELECT query_id, id, greatest(0, 1 - distance / 2) + 0.2 * len(list_intersect(['api', 'de', 'en', 'of'], words)) / 4.0 + CASE WHEN id % 3 = 1 THEN 0.1 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 0.15 ELSE 0 END
    + CASE WHEN len(words) BETWEEN 300 AND 600 THEN 0.05 WHEN len(words) < 100 THEN -0.05 ELSE 0 END AS score FROM w) SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10""")
def rerank_light(spark, sf):
    """V11"""
    hits = semantic(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    score = V.rerank_score(F.col("text"), 1 - F.col("score"), "api of de en", F.col("id") % 3, F.col("id") % 2 == 0, F.lit(False), F.lit(False))
    best = K.top(hits.select("query_id", "id", score.alias("score")), ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"))


@query("explain_retrieval", f"""WITH {SEM}, s AS (SELECT query_id, id, label, round(1 - least(1 - score, 1), 3) AS sim FROM sem JOIN e ON vec_id = id WHERE r <= 5)
  SELECT query_id, round(avg(sim), 6) AS avg_similarity, CASE WHEN avg(sim) >= 0.7 THEN 'high' WHEN avg(sim) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS facets, count(*) AS n FROM s GROUP BY 1""")
def explain_retrieval(spark, sf):
    """V15"""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = semantic(spark, sf, k=5).join(labels, "id").withColumn("sim", F.round(1 - F.least(1 - F.col("score"), F.lit(1.0)), 3))
    avg = F.avg("sim")
    return rows.groupBy("query_id").agg(F.round(avg, 6).alias("avg_similarity"), F.when(avg >= 0.7, "high").when(avg >= 0.5, "medium").otherwise("low").alias("confidence"),
                                        F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("facets"), F.count(F.lit(1)).alias("n"))


REFS = """refs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'academic_reference' ELSE 'web' END AS source_category,
  CASE o_orderkey % 4 WHEN 0 THEN 'academic' WHEN 1 THEN 'report' WHEN 2 THEN 'preprint' ELSE 'blog' END AS reference_type, CASE WHEN o_orderkey % 5 = 0 THEN 'stale_404' ELSE 'available' END AS link_status,
  (o_orderkey % 100) / 100.0::DOUBLE AS quality_score, (o_custkey % 150)::INT AS citation_count, (o_custkey % 10) / 10.0::DOUBLE AS domain_relevance_score, (o_orderkey % 17) / 10.0::DOUBLE AS distance, year(o_orderdate)::INT AS year FROM orders)"""


def references(spark, sf):
    o, m = table(spark, sf, "orders"), lambda c, n: F.col(c) % n
    kind = F.element_at(F.array(*map(F.lit, ("academic", "report", "preprint", "blog"))), (m("o_orderkey", 4) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.when(m("o_orderkey", 11) == 0, "academic_reference").otherwise("web").alias("source_category"), kind.alias("reference_type"),
                    F.when(m("o_orderkey", 5) == 0, "stale_404").otherwise("available").alias("link_status"), (m("o_orderkey", 100) / 100).alias("quality_score"),
                    m("o_custkey", 150).cast("int").alias("citation_count"), (m("o_custkey", 10) / 10).alias("domain_relevance_score"), (m("o_orderkey", 17) / 10).alias("distance"),
                    F.year("o_orderdate").alias("year"))


def persona_sql(name, quality, citations, types, stale, verifiable, penalty, bias) -> str:
    kinds = ", ".join(f"'{t}'" for t in types)
    link = "" if stale and not verifiable else "AND link_status = 'available'"
    return f"""WITH {REFS}, s AS (SELECT id, 0.5 * greatest(0, 1 - distance) + 0.2 * quality_score + 0.15 * domain_relevance_score + 0.1 * least(1, citation_count / 100.0) + {0.05 + bias} * greatest(0, 1 - greatest(0, 2000 - year) / 10.0)
  - CASE WHEN link_status <> 'available' THEN {penalty} ELSE 0 END AS score FROM refs WHERE source_category = 'academic_reference' OR (reference_type IN ({kinds}) {link} AND quality_score >= {quality} AND citation_count >= {citations}))
  SELECT id, round(score, 6) AS persona_score FROM s ORDER BY round(score, 9) DESC, id LIMIT 25"""


for _p in V.PERSONAS:

    def _persona(spark, sf, name=_p[0]):
        """F11, V13, X33, X51"""
        found = V.persona_ranked(references(spark, sf), name, 1 << 30, 2000)
        return found.select("id", F.round("persona_score", 9).alias("s")).orderBy(F.desc("s"), "id").limit(25).select("id", F.round("s", 6).alias("persona_score"))

    query(f"persona_{_p[0]}", persona_sql(*_p))(_persona)


@query("label_mean_vectors", f"""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY 1, 2),
  v AS (SELECT label, list(m ORDER BY pos) AS v FROM m GROUP BY 1), n AS (SELECT label, v, lead(v) OVER (ORDER BY label) AS w FROM v)
  SELECT label, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS to_next FROM n WHERE w IS NOT NULL""")
def label_means(spark, sf):
    """Mean vector of each section and the cosine to the next one's; few sections, so one window holds them"""
    from pyspark.sql import Window

    means = V.mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding")
    pairs = means.withColumn("next", F.lead("mean").over(Window.orderBy("label"))).where("next is not null")
    return pairs.select("label", F.round(V.cosine(F.col("mean"), F.col("next")), 6).alias("to_next"))


@query("vector_scalars", f"""WITH e AS (SELECT vec_id, {D} AS v FROM embeddings), a AS (SELECT v FROM e WHERE vec_id = 0)
  SELECT vec_id, round(1 - sqrt(list_sum(list_transform(list_zip(e.v, a.v), lambda p: (p[1] - p[2]) ** 2))) / nullif(sqrt(list_sum(list_transform(list_zip(e.v, a.v), lambda p: (p[1] + p[2]) ** 2))), 0), 6) AS norm_ratio,
  100::BIGINT AS padded, round(list_sum(list_slice(e.v, 1, 8)), 5) AS head FROM e, a""")
def vector_scalars(spark, sf):
    """X37, X38"""
    e = table(spark, sf, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("o"))
    head = F.aggregate(V.resized(F.col("embedding"), 8), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(V.norm_ratio(F.col("embedding"), F.col("o")), 6).alias("norm_ratio"),
                                                F.size(V.resized(F.col("embedding"), 100)).cast("long").alias("padded"), F.round(head, 5).alias("head"))


@query("synonym_pairs", f"""WITH e AS (SELECT vec_id, {D} AS v FROM embeddings) SELECT a.vec_id AS id, string_agg(b.vec_id::VARCHAR, ',' ORDER BY b.vec_id) AS synonyms FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE {COS} >= 0.8 GROUP BY 1""")
def synonym_pairs(spark, sf):
    """Each vector with those of cosine 0.8 or more"""
    near = V.close_pairs(vectors(spark, sf), 0.8)
    return near.groupBy(F.col("query_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("synonyms"))


@query("semantic_expansion", f"""WITH e AS (SELECT vec_id, {D} AS v FROM embeddings), p AS (SELECT a.vec_id AS term, b.vec_id AS other, 1 - sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2)))
  / nullif(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] + p[2]) ** 2))), 0) AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  SELECT term, other, round(s, 6) AS similarity FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(s, 12) DESC, other) <= 3) WHERE s >= 0.2""")
def semantic_expansion(spark, sf):
    """For every hundredth vector as a term its three nearest candidates over a threshold, by norm ratio"""
    rows = vectors(spark, sf)
    found = V.expansions(rows.where("id % 100 = 0"), rows, 3, 0.2)
    return found.select("term", "other", F.round("similarity", 6).alias("similarity"))
