"""Queries of retrieval end to end and of small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as H
from ..operators import retrieval as R
from ..operators import vectors as V
from ..operators import weights as L
from .registry import query, table
from .vectors import SEM, kw_sql, persona_sql, references, semantic


def docs(spark, sf):
    return table(spark, sf, "documents")


ASKED = ("python flask endpoint", "security patterns", "thesis methodology in java", "rest api for orders", "setting of the table", "what governs it", "list of design options", "phd microservice in golang")


@query("detect_filters", """SELECT q || ' ' || c_custkey AS q, language, source_category, is_api_reference, is_configuration, contains_table FROM customer, (VALUES ('python flask endpoint', 'python', 'code', false, false, false), ('security patterns', NULL, 'governance', false, false, false), ('thesis methodology in java', NULL, NULL, false, false, false),
  ('rest api for orders', NULL, 'code', true, false, false), ('setting of the table', NULL, NULL, false, true, true), ('what governs it', 'go', 'code', false, false, false), ('list of design options', NULL, 'patterns', false, false, true), ('phd microservice in golang', 'go', 'code', false, false, false))
  t(q, language, source_category, is_api_reference, is_configuration, contains_table)""")
def detect_filters(spark, sf):
    """questions of every customer"""
    rows = table(spark, sf, "customer").select(F.explode(F.array(*map(F.lit, ASKED))).alias("q"), "c_custkey").select(F.concat_ws(" ", "q", "c_custkey").alias("q"))
    return rows.select("q", R.detected_filters(F.col("q")).alias("f")).select("q", "f.*")


def retrieve_sql(where: str = "true") -> str:
    """Keyword (10) and semantic (20) lists of the first query, fused by weighted ranks, the ten best reranked; five stay."""
    return f"""WITH {SEM}, {kw_sql()}, docs AS (SELECT * FROM documents WHERE {where}), a AS (SELECT id, row_number() OVER (ORDER BY r) AS ra FROM sem WHERE query_id = 0 AND id IN (SELECT doc_id FROM docs)),
  b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rb FROM kw WHERE query_id = 0 AND r <= 10), f AS (SELECT id, round(0.6 * coalesce(1.0 / (60 + ra), 0) + 0.4 * coalesce(1.0 / (60 + rb), 0), 12) AS s,
  CASE WHEN rb IS NULL THEN 'vector' WHEN ra IS NULL THEN 'keyword' ELSE 'hybrid' END AS method FROM a FULL JOIN b USING (id) QUALIFY row_number() OVER (ORDER BY s DESC, id) <= 10),
  w AS (SELECT f.*, s / max(s) OVER () AS share, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS words FROM f JOIN docs ON doc_id = id),
  x AS (SELECT id, method, greatest(0, share) + 0.2 * len(list_intersect(['de', 'enten', 'la'], words)) / 3.0 + CASE WHEN len(words) BETWEEN 300 AND 600 THEN 0.05 WHEN len(words) < 100 THEN -0.05 ELSE 0 END AS score FROM w)
  SELECT id, round(score, 6) AS score, method, row_number() OVER (ORDER BY round(score, 9) DESC, id)::BIGINT AS rank FROM x QUALIFY rank <= 5"""


def first_query(spark, sf):
    return semantic(spark, sf).where("query_id = 0")


def shown(found):
    return found.select("id", F.round("score", 6).alias("score"), "method", F.col("rank").cast("long").alias("rank"))


@query("retrieve", retrieve_sql())
def retrieve(spark, sf):
    """Keyword and semantic lists, fused and reranked"""
    return shown(R.retrieve(docs(spark, sf), "la de enten", first_query(spark, sf)))


@query("retrieve_filtered", retrieve_sql("lang = 'de'").replace("FROM documents)\n  WHERE length(term)", "FROM documents WHERE lang = 'de')\n  WHERE length(term)").replace("(SELECT count(*) FROM documents)", "(SELECT count(*) FROM documents WHERE lang = 'de')"))
def retrieve_filtered(spark, sf):
    """A filter on both sides; term weights are those of the filtered documents"""
    return shown(R.retrieve(docs(spark, sf), "la de enten", first_query(spark, sf), where=F.col("lang") == "de"))


@query("retrieve_neighbours", f"""WITH r AS ({retrieve_sql()}), p AS (SELECT r.*, unnest([id - 1, id, id + 1]) AS near, unnest(['prev', 'main', 'next']) AS part FROM r) SELECT near AS id, part, score, method, rank, md5(text) AS hash FROM p JOIN documents ON doc_id = near""")
def retrieve_neighbours(spark, sf):
    """Each result with the texts before and after it"""
    d = docs(spark, sf)
    near = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") > 0, F.col("doc_id") - 1).alias("prev_id"), (F.col("doc_id") + 1).alias("next_id"), "text")
    found = R.retrieve(d, "la de enten", first_query(spark, sf), neighbours=near)
    return found.where("text is not null").select("id", "part", F.round("score", 6).alias("score"), "method", F.col("rank").cast("long").alias("rank"), F.md5("text").alias("hash"))


@query("retrieve_graph", f"""WITH r AS ({retrieve_sql()}), e AS (SELECT doc_id AS a, doc_id + 7 AS b, doc_id % 10 / 10.0 AS s FROM documents UNION SELECT doc_id, doc_id + 11, doc_id % 7 / 10.0 FROM documents), d AS (SELECT a AS u, b AS v, s FROM e UNION ALL SELECT b, a, s FROM e),
  n AS (SELECT v, max(score) / 2 AS score FROM (SELECT v, score FROM d JOIN r ON u = id QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC, v) <= 5) GROUP BY 1)
  SELECT id, round(score, 5) AS score, method FROM r UNION ALL SELECT v, round(score, 5), 'graph' FROM n JOIN documents ON doc_id = v WHERE v NOT IN (SELECT id FROM r)""")
def retrieve_graph(spark, sf):
    """Results with their neighbours in a graph"""
    d = docs(spark, sf)
    k = F.col("doc_id")
    edges = d.select(k.alias("a"), (k + 7).alias("b"), (k % 10 / 10).alias("severity")).union(d.select(k, k + 11, k % 7 / 10)).distinct()
    found = R.retrieve(d, "la de enten", first_query(spark, sf), edges=edges)
    return found.select("id", F.round(F.round("score", 6), 5).alias("score"), "method")


P = V.PERSONAS[-1]
# (term, acronym, weight) of a domain's vocabulary, and the terms that "la de enten" becomes with it
VOCABULARY = (("enten", "der", 2.0), ("mentenon", "que", 1.5), ("tion", "ing", 3.0))
EXPANDED = (("la", 1.0), ("de", 1.0), ("enten", 2.0), ("der", 1.0), ("mentenon", 1.5), ("que", 1.0))
RETRIEVED = retrieve_sql()
ASKED_TERMS = RETRIEVED[RETRIEVED.index("qt AS (") : RETRIEVED.index("kw AS (")]


EXPANDED_SQL = RETRIEVED.replace(ASKED_TERMS, f"qt AS (SELECT 0::BIGINT AS query_id, * FROM (VALUES {', '.join(map(str, EXPANDED))}) t(term, times)),\n")
FUSED = EXPANDED_SQL[EXPANDED_SQL.index(" a AS (") : EXPANDED_SQL.index("  w AS (")]


@query("retrieve_expanded", EXPANDED_SQL.replace(FUSED, " f AS (SELECT id, score AS s, 'keyword' AS method FROM kw WHERE query_id = 0 AND r <= 10),\n"))
def retrieve_expanded(spark, sf):
    """Keywords with what they expand to in a vocabulary, by its weights"""
    words = spark.createDataFrame(VOCABULARY, "term string, acronym string, weight double")
    return shown(R.retrieve(docs(spark, sf), "la de enten", None, expand=True, vocabulary=words))


@query("retrieve_scored", RETRIEVED[: RETRIEVED.index("  x AS (")] + """  x AS (SELECT id, method, (length(text) * 7919) % 1000 / 1000.0::DOUBLE AS score FROM f JOIN docs ON doc_id = id)
  SELECT id, round(score, 6) AS score, method, row_number() OVER (ORDER BY score DESC, id)::BIGINT AS rank FROM x QUALIFY rank <= 5""")
def retrieve_scored(spark, sf):
    """The fused list ordered by an injected scorer of query and text; a function of the text's length stands for the model"""
    return shown(R.retrieve(docs(spark, sf), "la de enten", first_query(spark, sf), scorer=lambda query, text: (F.length(text) * 7919) % 1000 / 1000))


PERSONA_SQL = persona_sql(*P)[len("WITH ") :].split("\n  SELECT id, round(score, 6) AS persona_score")[0]


@query("retrieve_persona", f"""WITH r AS ({RETRIEVED}), {PERSONA_SQL}
  SELECT r.id, round(r.score, 6) AS score, method, row_number() OVER (ORDER BY round(s.score, 9) DESC, r.id)::BIGINT AS rank FROM r JOIN s ON s.id = r.id + 1""")
def retrieve_persona(spark, sf):
    """Results that a persona's rules let through, ordered by its scores; an order stands for a document's reference"""
    refs = references(spark, sf).withColumn("id", F.col("id") - 1)
    return shown(R.retrieve(docs(spark, sf), "la de enten", first_query(spark, sf), persona=(refs, P[0], 2000)))


@query("bm25_chunk_lookup", f"WITH {SEM} SELECT id, round(score * 9, 6) AS score, round(greatest(0, least(1, 1 - score * 9 / 10)), 6) AS distance, lang, query_id FROM sem JOIN documents ON doc_id = id")
def bm25_chunk_lookup(spark, sf):
    """J17"""
    hits = semantic(spark, sf).select("query_id", "id", (F.col("score") * 9).alias("score"))
    found = R.bm25_to_chunks(hits, docs(spark, sf).select(F.col("doc_id").alias("id"), "lang"))
    return found.select("id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), "lang", "query_id")


@query("parent_texts", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NULL THEN l_returnflag ELSE o_orderstatus END AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem) LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON l_orderkey = o_orderkey")
def parent_texts(spark, sf):
    """J05, with the child's own text where the parent is gone"""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").distinct()
    child = line.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("id"), F.col("l_orderkey").alias("parent_id"), F.col("l_returnflag").alias("text"))
    parent = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderstatus").alias("text"))
    return R.with_parents(child.select("id"), child, parent).select("id.l_orderkey", "id.l_linenumber", "id.l_partkey", "text")


@query("service_calls", """WITH n AS (SELECT s_name AS node, CASE WHEN s_suppkey % 2 = 0 THEN 'svc' || (s_suppkey % 10) END AS service FROM supplier), c AS (SELECT s_name AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'svc' || (s_suppkey % 10) ELSE '00' || (s_suppkey % 9) END AS called FROM supplier),
  s AS (SELECT source, called, coalesce((SELECT min(node) FROM n WHERE service = called), (SELECT min(node) FROM n WHERE contains(node, called))) AS target FROM c) SELECT DISTINCT source, target FROM s WHERE target IS NOT NULL AND source <> target""")
def service_calls(spark, sf):
    """J12"""
    s = table(spark, sf, "supplier")
    nodes = s.select(F.col("s_name").alias("node"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("svc"), F.col("s_suppkey") % 10)).alias("service"))
    called = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("svc"), F.col("s_suppkey") % 10)).otherwise(F.concat(F.lit("00"), F.col("s_suppkey") % 9))
    return R.service_calls(nodes, s.select(F.col("s_name").alias("source"), called.alias("called"))).select("source", "target")


@query("span_sections", """WITH c AS (SELECT doc_id, k * 500 AS start, k * 500 + 400 AS "end" FROM (SELECT doc_id, unnest(range(0, (length(text) + 499) // 500)) AS k FROM documents)), s AS (SELECT doc_id, k AS place, k * 700 AS s, k * 700 + 700 AS e FROM (SELECT doc_id, unnest(range(0, (length(text) + 699) // 700)) AS k FROM documents))
  SELECT c.doc_id, start, "end", 'part ' || min(place) AS title FROM c JOIN s ON c.doc_id = s.doc_id AND NOT ("end" < s OR start >= e) GROUP BY 1, 2, 3""")
def span_sections(spark, sf):
    """J18"""
    upto = lambda step: F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.floor(F.length("text") / step)), lambda k: k * step < F.length("text")))
    spans = docs(spark, sf).select("doc_id", upto(500).alias("k")).select("doc_id", (F.col("k") * 500).alias("start"), (F.col("k") * 500 + 400).alias("end"))
    parts = docs(spark, sf).select("doc_id", upto(700).alias("place"))
    parts = parts.select("doc_id", "place", (F.col("place") * 700).alias("start"), (F.col("place") * 700 + 700).alias("end"), F.concat(F.lit("part "), "place").alias("title"))
    return R.spans_to_sections(spans, parts)


@query("sampled_edges", "WITH e AS (SELECT n_regionkey AS a, n_nationkey + 100 AS b, 1.0::DOUBLE AS c FROM nation), m AS (SELECT n_nationkey + 10 AS node, n_regionkey AS s FROM nation) SELECT a, b, c AS confidence FROM e UNION ALL SELECT node, b, c * 0.8 FROM m JOIN e ON s = a WHERE node <> b")
def sampled_edges(spark, sf):
    """J16"""
    n = table(spark, sf, "nation")
    edges = n.select(F.col("n_regionkey").alias("a"), (F.col("n_nationkey") + 100).alias("b"), F.lit(1.0).alias("confidence"))
    return R.sampled_edges(edges, n.select((F.col("n_nationkey") + 10).alias("node"), F.col("n_regionkey").alias("sampled")))


@query("vocabulary_merge", """WITH t AS (SELECT p_brand AS term, p_size AS weight, 1::BIGINT AS f, 0 AS p FROM part WHERE p_size <= 25 UNION ALL SELECT p_brand, p_size, 2, 1 FROM part WHERE p_size > 15),
  u AS (SELECT term, min(weight) AS weight, sum(f) AS f, p FROM t GROUP BY term, p) SELECT term, arg_min(weight, p) AS weight, sum(f)::BIGINT AS frequency FROM u GROUP BY 1""")
def vocabulary_merge(spark, sf):
    """U06"""
    part = table(spark, sf, "part")
    side = lambda w, f: part.where(w).groupBy(F.col("p_brand").alias("term")).agg(F.min("p_size").alias("weight"), F.sum(F.lit(f).cast("long")).alias("frequency"))
    return R.merged_vocabulary(side("p_size <= 25", 1), side("p_size > 15", 2))


@query("dependency_cycles", """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS u, n_nationkey % 7 AS v FROM nation), p(path, last) AS (SELECT [u], u FROM e UNION SELECT list_append(path, v), v FROM p JOIN e ON u = last WHERE v > path[1] AND NOT list_contains(path, v)),
  c AS (SELECT DISTINCT path FROM p JOIN e ON u = last AND v = path[1]) SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM c""")
def dependency_cycles(spark, sf):
    """All simple cycles of a directed graph of regions and nations"""
    arcs = table(spark, sf, "nation").select(F.col("n_regionkey").alias("u"), (F.col("n_nationkey") % 7).alias("v"))
    return R.simple_cycles(arcs).select(F.array_join("cycle", ">").alias("cycle"), F.size("cycle").alias("length"))


@query("child_parents", "SELECT l_orderkey, l_linenumber, l_partkey, any_value(o_orderstatus) AS parent_text FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1, 2, 3")
def child_parents(spark, sf):
    """Children without a parent are left out"""
    line = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("parent_id")).distinct()
    parent = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderstatus").alias("text"))
    return R.children_with_parents(line.select("id"), line, parent).select("id.l_orderkey", "id.l_linenumber", "id.l_partkey", "parent_text")


@query("chapter_labels", "SELECT p_partkey, number, CASE WHEN number = 'n' THEN 'Chapter ' || p_size ELSE label END AS label FROM part, (VALUES ('one', 'Chapter 1'), (' IV ', 'Chapter 4'), ('n', ''), ('A', 'Annex'), ('B', 'Chapter B')) t(number, label)")
def chapter_labels(spark, sf):
    """Chapters of every part, one of them numbered by its size"""
    forms = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(t).cast("string").alias("title")) for n, t in (("one", ""), (" IV ", None), ("n", "x"), ("A", "Annex"), ("B", ""))])
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.explode(forms).alias("f"))
    number = F.when(F.col("f.number") == "n", F.col("size")).otherwise(F.col("f.number"))
    return rows.select("p_partkey", "f.number", R.chapter_label(number, F.col("f.title")).alias("label"))


@query("human_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size FROM (SELECT doc_id, (n_chars * 1000 + 7)::DOUBLE AS n FROM documents)")
def human_sizes(spark, sf):
    """X49"""
    return docs(spark, sf).select("doc_id", R.human_size(F.col("n_chars") * 1000 + 7).alias("size"))


@query("json_blocks", """SELECT doc_id, id, replace(found, '#', doc_id::VARCHAR) AS found FROM documents, (VALUES (0, '{"a": #}'), (1, '[1, #]'), (2, NULL), (3, '{"a": {"b#": "}"}}')) t(id, found)""")
def json_blocks(spark, sf):
    """Four answers about every document"""
    answers = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(t).alias("t")) for k, t in enumerate(('Sure: {"a": #,} done', "x [1, #", "none", '```{"a": {"b#": "}"}}```'))])
    rows = docs(spark, sf).select("doc_id", F.explode(answers).alias("x")).select("doc_id", "x.id", F.replace("x.t", F.lit("#"), F.col("doc_id").cast("string")).alias("t"))
    return rows.select("doc_id", "id", R.json_of("t").alias("found"))


@query("prompts", "SELECT conv_id, 'Context:' || chr(10) || string_agg('[' || i || '] ' || text, chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: why?' || chr(10) || 'Answer:' AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations) GROUP BY 1")
def prompts(spark, sf):
    """X54"""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("c"))
    return turns.select("conv_id", R.prompt(F.lit("why?"), F.transform("c", lambda x: x["t"])).alias("prompt"))


@query("table_stats")
def table_stats(spark, sf):
    """Tables that pages hold, marked as text"""
    return H.html_text(table(spark, sf, "pages")).select("page_id", R.table_stats(F.col("text")).alias("s")).select("page_id", "s.*")


@query("term_clusters")
def term_clusters(spark, sf):
    """Average linkage within the vocabulary of each label, with size, mean-pair confidence, categories and mean weight"""
    from ..operators import clusters as C

    rows = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.get("embedding", F.lit(0)).cast("double").alias("w"))
    label = C.linked(rows, 0.6, "average", "label")
    return label.join(C.cluster_facts(rows, label, "label", "w").drop("centroid"), "cluster")


@query("term_clusters_single", """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a, e b WHERE a.vec_id <> b.vec_id
  AND round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) >= 0.8),
  r(id, reach) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, p.y FROM r JOIN p ON r.reach = p.x) SELECT id, min(reach) AS cluster FROM r GROUP BY 1""")
def term_clusters_single(spark, sf):
    """Single linkage of all terms"""
    from ..operators import clusters as C

    return C.linked(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.8, "single")


@query("knn_cells", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id)
  SELECT query_id, id, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) <= 10""")
def knn_cells(spark, sf):
    """The 10 nearest of every row through an index of cells, exact"""
    from ..operators import clusters as C

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return C.CellIndex(rows).nearest(rows, 10, exact=True).withColumn("similarity", F.round("similarity", 6))


@query("sampled_graph", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, md5(vec_id::VARCHAR) < '4ccccccc' AS chosen FROM embeddings),
  p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y, a.chosen AS cx, b.chosen AS cy, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id),
  k AS (SELECT CASE WHEN n < 100 THEN 20 WHEN n < 500 THEN 15 WHEN n < 2000 THEN 10 ELSE 5 END AS k FROM (SELECT count(*) AS n FROM embeddings)),
  g AS (SELECT x AS a, y AS b, s FROM (SELECT * FROM p WHERE cx AND cy QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(s, 12) DESC, y) <= (SELECT k FROM k)) WHERE x < y AND s BETWEEN 0.5 AND 0.9),
  near AS (SELECT * FROM p WHERE NOT cx QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(s, 12) DESC, y) <= 4),
  f AS (SELECT * FROM near WHERE cy QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(s, 12) DESC, y) = 1)
  SELECT a, b, round(s, 6) AS confidence FROM g UNION ALL SELECT x, b, round(g.s * 0.8, 6) FROM f JOIN g ON y = a WHERE x <> b""")
def sampled_graph(spark, sf):
    """A graph built on nodes sampled by hash, with as many neighbours as its size allows, and edges of the others from the nearest sampled one"""
    from ..operators import clusters as C

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return C.sampled_graph(rows, 0.3, C.neighbours_for(rows.count())).withColumn("confidence", F.round("confidence", 6))


def rated(spark, sf):
    """Lines as rated queries: prices rate them, and quantities, discounts and parts are their features."""
    kind = F.when(F.col("l_returnflag") == "A", "technical").when(F.col("l_returnflag") == "N", "natural").otherwise("mixed")
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("created_at"), (F.col("l_linenumber") / 10).alias("vector_weight"),
                                               (1 - F.col("l_linenumber") / 10).alias("keyword_weight"), kind.alias("query_type"), (F.col("l_partkey") % 200).alias("query_length"), (F.col("l_discount") * 10).cast("double").alias("embedding_similarity"),
                                               (F.col("l_quantity") / 50).cast("double").alias("bm25_score"), (F.col("l_extendedprice") / 100000).cast("double").alias("relevancy"))


@query("adaptive_weights")
def adaptive_weights(spark, sf):
    """Weights of vector and keyword search for each status of lines, by least squares on six features over all lines, older ones counting less; tested against a solver"""
    found = L.learned_weights(rated(spark, sf), "l_linestatus", "1997-01-01 00:00:00", "1997-02-01 00:00:00")
    return found.select("l_linestatus", "samples", "vector_weight", F.round("keyword_weight", 6).alias("keyword_weight"), F.round("confidence", 6).alias("confidence"), F.round("improvement", 6).alias("improvement"), "recommended")
