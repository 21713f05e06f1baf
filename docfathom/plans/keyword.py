"""Queries of keyword search and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..operators import keyword as K
from ..session import new_folder
from ..sources.stores import KeywordIndex
from .registry import query, table

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOK = rf"""tok AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents)
  WHERE length(term) >= 2 AND term NOT IN ({STOP_SQL})),
lens AS (SELECT doc_id, count(*) AS doc_length FROM tok GROUP BY 1),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(doc_length) AS doc_length FROM tok JOIN lens USING (doc_id) GROUP BY 1, 2),
stats AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(doc_length) FROM lens) / (SELECT count(*) FROM documents)::DOUBLE AS avg_length),
df AS (SELECT term, count(*) AS df, sum(tf) AS occurrences FROM post GROUP BY 1)"""
WORDS = ["la de enten", "erint thon reeston", "mit license", "the and"]


def bm25_sql(queries: str, k: int, floor: str) -> str:
    return rf"""WITH {TOK}, q AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM q)
  WHERE length(term) >= 2 AND term NOT IN ({STOP_SQL}) GROUP BY 1, 2),
scored AS (SELECT query_id, doc_id, sum(times * {floor} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avg_length))) AS score
  FROM post JOIN df USING (term) JOIN qt USING (term) CROSS JOIN stats GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM ranked WHERE rank <= {k}"""


LITERALS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, '{w}' AS query" for i, w in enumerate(WORDS))
IDF = "ln((n_docs - df + 0.5) / (df + 0.5) + 1)"


def rounded(df, k):
    best = K.top(df.drop("rank").withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_topk", bm25_sql(LITERALS, 10, f"greatest(0.25, {IDF})"))
def bm25_topk(spark, sf):
    """B01-B04, X01, G01, G02"""
    return rounded(K.bm25(table(spark, sf, "documents"), K.literal_queries(spark, WORDS), 20), 10)


@query("bm25_stored_idf_topk", bm25_sql(LITERALS, 10, IDF))
def bm25_stored(spark, sf):
    """Idf as stored, without a floor"""
    return rounded(K.bm25(table(spark, sf, "documents"), K.literal_queries(spark, WORDS), 20, None), 10)


@query("bm25_benchmark_batch", bm25_sql("SELECT item_id AS query_id, text AS query FROM benchmark", 3, f"greatest(0.25, {IDF})"))
def bm25_batch(spark, sf):
    """B04 for a table of queries"""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rounded(K.bm25(table(spark, sf, "documents"), queries, 6), 3)


CHANGED = "changed AS (SELECT doc_id, CASE WHEN lang = 'es' THEN source || ' thon ' || text ELSE text END AS text FROM documents WHERE lang <> 'fr'), "


@query("keyword_index_topk", bm25_sql(LITERALS, 10, f"greatest(0.25, {IDF})").replace("WITH tok", f"WITH {CHANGED} tok").replace("FROM documents)", "FROM changed)"), writes=True)
def keyword_index_topk(spark, sf):
    """A persisted index of all documents, then those of one language changed and those of another deleted, each written as a segment; a search of its blocks"""
    docs = table(spark, sf, "documents")
    index = KeywordIndex(spark, new_folder(spark, "keyword-index"))
    index.build(docs)
    index.put(docs.where("lang = 'es'").select("doc_id", F.concat_ws(" ", "source", F.lit("thon"), "text").alias("text")))
    index.delete(docs.where("lang = 'fr'"))
    return rounded(index.search(K.literal_queries(spark, WORDS), 20), 10)


@query("keyword_index_stats", f"""WITH {CHANGED} {TOK}, t AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM tok GROUP BY 1)
  SELECT term, df, occurrences::BIGINT AS occurrences FROM t""".replace("FROM documents)", "FROM changed)"), writes=True)
def keyword_index_stats(spark, sf):
    """Term statistics of the index after changes, deletes and compaction"""
    docs = table(spark, sf, "documents")
    index = KeywordIndex(spark, new_folder(spark, "keyword-index"))
    index.build(docs.where("lang <> 'es'"))
    index.put(docs.where("lang = 'es'").select("doc_id", F.concat_ws(" ", "source", F.lit("thon"), "text").alias("text")))
    index.delete(docs.where("lang = 'fr'"))
    index.compact()
    return index.term_stats().select("term", "df", F.col("occurrences").cast("long").alias("occurrences"))


@query("term_stats", f"WITH {TOK} SELECT term, df, occurrences::BIGINT AS occurrences, round({IDF}, 6) AS idf FROM df CROSS JOIN stats")
def term_stats(spark, sf):
    """G01, G03, B08"""
    docs = table(spark, sf, "documents")
    return K.term_stats(K.postings(docs), docs.count()).withColumn("idf", F.round("idf", 6))


@query("corpus_stats", f"WITH {TOK} SELECT n_docs, round(avg_length, 6) AS avg_length, (SELECT count(*) FROM df) AS n_terms, (SELECT sum(tf)::BIGINT FROM post) AS n_tokens FROM stats")
def corpus_stats(spark, sf):
    """G02, G04, B06"""
    docs = table(spark, sf, "documents")
    post = K.postings(docs).agg(F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return K.corpus_stats(docs).withColumn("avg_length", F.round("avg_length", 6)).crossJoin(F.broadcast(post))


@query("docs_for_term_page", f"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE term = 'de' ORDER BY doc_id LIMIT 20 OFFSET 10")
def docs_for_term(spark, sf):
    """A page of the documents of a term, in order"""
    return K.postings(table(spark, sf, "documents")).where("term = 'de'").select("doc_id").distinct().orderBy("doc_id").offset(10).limit(20)


@query("and_count", f"WITH {TOK}, hit AS (SELECT doc_id FROM post WHERE term IN ('la', 'de', 'en') GROUP BY 1 HAVING count(DISTINCT term) = 3) SELECT count(*) AS docs FROM hit")
def and_count(spark, sf):
    """G06"""
    return K.docs_for_all(K.postings(table(spark, sf, "documents")), ["la", "de", "en"]).agg(F.count(F.lit(1)).alias("docs"))


@query("counts_by_source", f"""WITH {TOK} SELECT lower(coalesce(source, 'unknown')) AS category, count(DISTINCT p.doc_id) AS docs FROM post p JOIN documents d ON p.doc_id = d.doc_id
  WHERE term = 'en' GROUP BY 1 ORDER BY docs DESC, category LIMIT 10""")
def counts_by_source(spark, sf):
    """G05, J01"""
    docs = table(spark, sf, "documents")
    return K.by_category(K.postings(docs), docs.select("doc_id", F.col("source").alias("source_category")), "en", 10)


@query("term_summary", f"""WITH {TOK} SELECT t.term, coalesce(df.df, 0) AS docs, coalesce(df.occurrences, 0)::BIGINT AS occurrences, n_docs AS total,
  coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM post WHERE term = t.term ORDER BY doc_id LIMIT 5)), '') AS samples
  FROM (SELECT unnest(['la', 'ent', 'zzz']) AS term) t LEFT JOIN df USING (term) CROSS JOIN stats""")
def term_summary(spark, sf):
    """G07, B10"""
    docs = table(spark, sf, "documents")
    wanted = spark.createDataFrame([("la",), ("ent",), ("zzz",)], "term string")
    post = K.postings(docs).join(F.broadcast(wanted), "term", "left_semi")
    first = K.top(post, ["term"], [F.asc("doc_id")], 5).groupBy("term").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("samples"))
    counts = post.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))
    total = F.broadcast(docs.agg(F.count(F.lit(1)).alias("total")))
    return wanted.join(counts, "term", "left").join(first, "term", "left").crossJoin(total).fillna({"docs": 0, "occurrences": 0, "samples": ""})


@query("parent_counts", """SELECT 'p' || (l_partkey % 7) AS term, count(DISTINCT coalesce(o_orderkey, l_orderkey)) AS parents
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE coalesce(o_orderkey, l_orderkey) IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def parent_counts(spark, sf):
    """Lines stand for chunks, orders for their parents"""
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    post = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("doc_id"), F.concat(F.lit("p"), F.col("l_partkey") % 7).alias("term"))
    chunks = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").cast("string").alias("parent_id"))
    return K.parent_counts(post, chunks, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("doc_id")))


FREQ = f"""WITH {TOK}, f AS (SELECT term AS word, sum(tf)::BIGINT AS frequency, count(*) AS doc_count FROM post WHERE regexp_matches(term, '[a-z]') GROUP BY 1)"""


@query("word_frequency_top", f"{FREQ} SELECT word, frequency, doc_count FROM f WHERE frequency >= 2 ORDER BY frequency DESC, word LIMIT 50")
def word_frequency_top(spark, sf):
    """G08, W03"""
    return K.word_frequency(table(spark, sf, "documents")).where("frequency >= 2").orderBy(F.desc("frequency"), "word").limit(50)


@query("word_frequency_stats", f"{FREQ} SELECT count(*) AS unique_words, sum(frequency)::BIGINT AS total_words, round(sum(frequency) / nullif(count(*), 0)::DOUBLE, 2) AS avg_frequency FROM f")
def word_frequency_stats(spark, sf):
    """G09"""
    f = K.word_frequency(table(spark, sf, "documents"))
    return f.agg(F.count(F.lit(1)).alias("unique_words"), F.sum("frequency").alias("total_words"), F.round(F.try_divide(F.sum("frequency"), F.count(F.lit(1))), 2).alias("avg_frequency"))


@query("word_cloud_weighted", f"{FREQ}, t AS (SELECT word, frequency FROM f ORDER BY frequency DESC, word LIMIT 30) SELECT word, round(frequency / (SELECT max(frequency) FROM t)::DOUBLE, 6) AS size FROM t")
def word_cloud(spark, sf):
    """X46"""
    best = K.word_frequency(table(spark, sf, "documents")).orderBy(F.desc("frequency"), "word").limit(30)
    most = best.agg(F.max("frequency").alias("most"))
    return best.crossJoin(F.broadcast(most)).select("word", F.round(F.col("frequency") / F.col("most"), 6).alias("size"))


@query("tf_fallback_topk", """WITH s AS (SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'ment', ''))) / 4.0 + (length(lower(text)) - length(replace(lower(text), 'enten', ''))) / 5.0)::BIGINT AS score FROM documents),
  t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, score, round(0.9 - 0.6 * score / (SELECT max(score) FROM t), 6) AS distance FROM t""")
def tf_fallback(spark, sf):
    """B09"""
    return K.tf_fallback(table(spark, sf, "documents"), "ment of enten", 10).withColumn("distance", F.round("distance", 6))


@query("counts_branch_summary", f"""WITH {TOK}, s AS (SELECT coalesce(sum(df), 0)::BIGINT AS docs, coalesce(sum(occurrences), 0)::BIGINT AS n FROM df WHERE term = 'license')
  SELECT 'license' AS term, 'count' AS intent, 'The corpus holds ' || docs || ' documents with license (' || n || ' occurrences) of ' || n_docs || '.' AS summary FROM s CROSS JOIN stats""")
def counts_branch(spark, sf):
    """The question's longest word that is no question word, answered by counts"""
    docs = table(spark, sf, "documents")
    ask = spark.createDataFrame([("how many documents mention license",)], "q string")
    # Words of questions about counts.
    asking = ["how", "many", "much", "count", "number", "list", "which", "documents", "docs", "document", "mention", "mentions", "contain", "total", "corpus"]
    toks = F.array_except(F.split("q", " "), F.array(*map(F.lit, asking)))
    longest = F.element_at(F.array_sort(toks, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)), 1)
    intent = F.when(F.col("q").rlike("how many|number of|count"), "count").when(F.col("q").rlike("list|which"), "list").otherwise("none")
    asked = ask.select(longest.alias("term"), intent.alias("intent"))
    post = K.postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    both = asked.join(post, "term", "left").crossJoin(F.broadcast(total)).fillna(0)
    text = F.format_string("The corpus holds %d documents with %s (%d occurrences) of %d.", "docs", "term", "n", "total")
    return both.select("term", "intent", text.alias("summary"))


@query("token_lengths", rf"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND NOT list_contains([{STOP_SQL}], x)))::BIGINT AS n_tokens,
  floor(length(text) / 4)::BIGINT AS estimate FROM documents""")
def token_lengths(spark, sf):
    """X01, X23"""
    return table(spark, sf, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.floor(F.length("text") / 4).alias("estimate"))
