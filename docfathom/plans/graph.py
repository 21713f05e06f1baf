"""Queries of the consistency graph and its analytics: suppliers of the same parts make the edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drawing as W
from ..operators import graph as G
from ..operators import keyword as K
from ..session import with_checkpoints
from .registry import query, table

DAY = "l_partkey || '@' || strftime(l_shipdate, '%Y-%m-%d')"


def edges_sql(value: str) -> str:
    return f"""line AS MATERIALIZED (SELECT DISTINCT l_suppkey AS node, {value} AS value FROM lineitem), edges AS MATERIALIZED (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM line a JOIN line b ON a.value = b.value AND a.node < b.node GROUP BY 1, 2),
nodes AS (SELECT s_suppkey AS node FROM supplier), d AS MATERIALIZED (SELECT a AS u, b AS v, shared FROM edges UNION ALL SELECT b, a, shared FROM edges), deg AS (SELECT u, count(*) AS d FROM d GROUP BY 1)"""


EDGES, PARTS = edges_sql(DAY), edges_sql("l_partkey")


def deliveries(spark, sf, together: bool = False):
    """(node, value): suppliers, and the parts that they delivered; together: the parts and days."""
    value = F.concat_ws("@", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd")) if together else F.col("l_partkey")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"), value.alias("value"))


def graph(spark, sf):
    """(nodes, edges) for graph analytics: suppliers, joined where they delivered the same part on the same day, over all lines. Shared parts
    alone join nearly every two suppliers, and analytics of a complete graph say nothing; the joins on all shared parts are queries of their
    own. The edges are checkpointed: what reads them does not join again."""
    with_checkpoints(spark)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")), G.shared_value_edges(deliveries(spark, sf, together=True)).checkpoint()


@query("shared_value_edges", f"WITH {PARTS} SELECT * FROM edges")
def shared_value(spark, sf):
    """All pairs of suppliers that share a part, and how many they share"""
    return G.shared_value_edges(deliveries(spark, sf))


@query("shared_delivery_edges", f"WITH {EDGES} SELECT * FROM edges")
def shared_delivery(spark, sf):
    """The edges of graph()"""
    return graph(spark, sf)[1]


@query("dependency_overlap", f"""WITH {PARTS}, n AS (SELECT node AS s, count(*) AS n FROM line GROUP BY 1)
  SELECT a, b, round(shared / greatest(x.n, y.n)::DOUBLE, 9) AS weight FROM edges JOIN n x ON a = x.s JOIN n y ON b = y.s""")
def dependency_overlap(spark, sf):
    """J11"""
    return G.value_overlap(deliveries(spark, sf)).withColumn("weight", F.round("weight", 9))


D = "list_transform(embedding, lambda x: x::DOUBLE)"
REL = "CASE WHEN (a + b) % 4 = 0 THEN 'Partially conflicting' WHEN (a + b) % 4 = 1 THEN 'contradictory claims' WHEN (a + b) % 4 = 2 THEN 'duplicates' ELSE 'n/a' END"
BUILD = f"""e AS (SELECT vec_id, label, {D} AS v FROM embeddings), p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(s, 12) DESC, y) <= 8), c AS (SELECT x AS a, y AS b, greatest(0, least(1, s)) AS similarity FROM k WHERE x < y AND s >= 0.5 AND s <= 0.9),
g AS (SELECT a, b, round(similarity, 9) AS similarity, CASE WHEN (a + b) % 4 = 0 THEN 'partial_conflict' WHEN (a + b) % 4 = 1 THEN 'conflict' WHEN (a + b) % 4 = 2 THEN 'duplicate' ELSE 'consistent' END AS relationship FROM c),
s AS (SELECT *, similarity * 0.8 * CASE relationship WHEN 'conflict' THEN 1.0 WHEN 'partial_conflict' THEN 0.6 WHEN 'duplicate' THEN 0.3 ELSE 0 END AS severity FROM g)"""


def similarity_edges(spark, sf):
    """An edge lives if the smaller id has the larger among its neighbours; a rule stands in for the model"""
    from ..operators import vectors as V
    from .vectors import vectors

    near = V.knn_join(vectors(spark, sf), 8).where("query_id < id")
    pairs = near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))), 9).alias("similarity"), "similarity").toDF("a", "b", "similarity", "raw")
    plain = {"category": F.lit("text"), "language": F.lit(""), "deps": F.array().cast("array<string>"), "type": F.lit("")}
    pairs = pairs.where(G.worth_checking(F.col("raw"), plain, plain))
    label = F.expr(REL)
    rel = G.relationship(label)
    edges = pairs.select("a", "b", "similarity", rel.alias("relationship")).withColumn("severity", G.severity(F.col("relationship"), F.lit(0.8), F.col("similarity")))
    return G.canonical(edges)


@query("graph_edges_build", f"WITH {BUILD} SELECT a, b, relationship, round(similarity, 6) AS similarity, round(severity, 6) AS severity FROM s")
def graph_edges_build(spark, sf):
    """N17"""
    return similarity_edges(spark, sf).select("a", "b", "relationship", F.round("similarity", 6).alias("similarity"), F.round("severity", 6).alias("severity"))


@query("edge_counts", f"WITH {BUILD} SELECT relationship, count(*) AS n, round(max(severity), 6) AS most FROM s GROUP BY 1")
def edge_counts(spark, sf):
    """G37, G23"""
    return similarity_edges(spark, sf).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("severity"), 6).alias("most"))


@query("conflict_score", f"WITH {BUILD}, u AS (SELECT a AS n, severity FROM s UNION ALL SELECT b, severity FROM s) SELECT vec_id AS node, round(coalesce(sum(severity), 0), 6) AS conflict FROM embeddings LEFT JOIN u ON vec_id = n GROUP BY 1")
def conflict(spark, sf):
    """G21, U01"""
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"))
    return G.conflict_score(nodes, similarity_edges(spark, sf)).withColumn("conflict", F.round("conflict", 6))


@query("heatmap_matrix", f"""WITH {BUILD}, u AS (SELECT a AS u, b AS v, severity FROM s UNION ALL SELECT b, a, severity FROM s), t AS (SELECT u AS node FROM u GROUP BY 1 ORDER BY round(max(severity), 9) DESC, u LIMIT 8)
  SELECT x.node AS a, y.node AS b, round(coalesce(severity, 0), 6) AS severity FROM t x CROSS JOIN t y LEFT JOIN u ON u.u = x.node AND u.v = y.node""")
def heatmap(spark, sf):
    """The eight nodes of worst edges, each with each"""
    both = G.directed(similarity_edges(spark, sf).select("a", "b", "severity"))
    best = both.groupBy("u").agg(F.round(F.max("severity"), 9).alias("s")).orderBy(F.desc("s"), "u").limit(8).select("u")
    grid = best.toDF("a").crossJoin(F.broadcast(best.toDF("b")))  # eight by eight
    cells = both.toDF("a", "b", "severity")
    return grid.join(cells, ["a", "b"], "left").select("a", "b", F.round(F.coalesce("severity", F.lit(0.0)), 6).alias("severity"))


@query("ranked_neighbours", f"WITH {EDGES} SELECT u AS seed, v AS neighbour, row_number() OVER (PARTITION BY u ORDER BY shared DESC, v)::BIGINT AS rank FROM d QUALIFY rank <= 3")
def ranked_neighbours(spark, sf):
    """W13, V24, N11, N15"""
    both = G.directed(graph(spark, sf)[1])
    return K.top(both, ["u"], [F.desc("shared"), F.asc("v")], 3).select(F.col("u").alias("seed"), F.col("v").alias("neighbour"), F.col("rank").cast("long").alias("rank"))


@query("bfs_two_hop", f"""WITH {EDGES}, h1 AS (SELECT DISTINCT v AS n FROM d WHERE u = 1 AND v <> 1), h2 AS (SELECT DISTINCT v AS n FROM d WHERE u IN (SELECT n FROM h1) AND v <> 1 AND v NOT IN (SELECT n FROM h1))
  SELECT 1::BIGINT AS node, 0 AS hop UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2""")
def bfs(spark, sf):
    """N10"""
    nodes, edges = graph(spark, sf)
    return G.neighbourhood(edges, nodes.where("node = 1"), 2)


@query("induced_subgraph", f"WITH {EDGES} SELECT a, b, shared FROM edges WHERE a % 3 = 0 AND b % 3 = 0")
def induced(spark, sf):
    """J14, J15, F07"""
    nodes, edges = graph(spark, sf)
    return G.induced(edges, nodes.where("node % 3 = 0"))


@query("degree_top", f"WITH {EDGES} SELECT u AS node, d AS degree FROM deg ORDER BY d DESC, u LIMIT 10")
def degree_top(spark, sf):
    """W15"""
    return G.directed(graph(spark, sf)[1]).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


@query("graph_components", f"""WITH RECURSIVE {EDGES}, r(node, reach) AS (SELECT node, node FROM nodes UNION SELECT r.node, d.v FROM r JOIN d ON r.reach = d.u) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    """Single linkage is the components of the pairs over a threshold"""
    return G.components(*graph(spark, sf))


def pagerank_sql(rounds: int) -> str:
    steps = ", ".join(f"""r{k + 1} AS MATERIALIZED (SELECT n.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce((SELECT sum(r.rank / deg.d) FROM d JOIN r{k} r ON r.node = d.u JOIN deg ON deg.u = d.u WHERE d.v = n.node), 0)
  + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT u FROM deg)) / (SELECT count(*) FROM nodes)) AS rank FROM nodes n)""" for k in range(rounds))
    return f"WITH {EDGES}, r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes), {steps} SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query("pagerank_fixed_iter", pagerank_sql(6))
def pagerank(spark, sf):
    """A fixed number of rounds"""
    return G.pagerank(*graph(spark, sf), rounds=6).withColumn("rank", F.round("rank", 6))


@query("influence_rank", pagerank_sql(6).replace("SELECT node, round(rank, 6) AS rank FROM r6", "SELECT node, row_number() OVER (ORDER BY round(rank, 9) DESC, node)::BIGINT AS place FROM r6 QUALIFY place <= 10"))
def influence_rank(spark, sf):
    """W01, W02"""
    return _placed(G.pagerank(*graph(spark, sf), rounds=6).orderBy(F.desc(F.round("rank", 9)), "node").limit(10).withColumn("g", F.lit(0)))


def _placed(best):
    from pyspark.sql import Window

    return best.select("node", F.row_number().over(Window.partitionBy("g").orderBy(F.desc(F.round("rank", 9)), "node")).cast("long").alias("place"))


def label_sql(rounds: int) -> str:
    steps = ", ".join(f"""l{k + 1} AS MATERIALIZED (SELECT n.node, coalesce(b.label, n.label) AS label FROM l{k} n LEFT JOIN (SELECT u, label FROM (SELECT u, label, count(*) AS n FROM d JOIN l{k} l ON l.node = d.v GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, label) = 1) b ON b.u = n.node)""" for k in range(rounds))
    return f"WITH {EDGES}, l0 AS (SELECT node, node AS label FROM nodes), {steps} SELECT node, label FROM l{rounds}"


@query("label_prop_fixed_iter", label_sql(3))
def label_prop(spark, sf):
    """N05"""
    return G.label_propagation(*graph(spark, sf), rounds=3)


def eigen_sql(rounds: int) -> str:
    steps = ", ".join(f"""y{k} AS MATERIALIZED (SELECT n.node, n.x + coalesce((SELECT sum(o.x) FROM d JOIN x{k} o ON o.node = d.v WHERE d.u = n.node), 0) AS y FROM x{k} n), x{k + 1} AS MATERIALIZED (SELECT node, y / (SELECT sqrt(sum(y * y)) FROM y{k}) AS x FROM y{k})""" for k in range(rounds))
    return f"WITH {EDGES}, x0 AS (SELECT node, 1.0::DOUBLE AS x FROM nodes), {steps} SELECT node, round(x, 6) AS centrality FROM x{rounds}"


@query("eigenvector", eigen_sql(5))
def eigenvector(spark, sf):
    """N03"""
    return G.eigenvector(*graph(spark, sf), rounds=5).withColumn("centrality", F.round("centrality", 6))


TRI = f"""{EDGES}, tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM edges x JOIN edges y ON x.b = y.a JOIN edges z ON z.a = x.a AND z.b = y.b), t AS (SELECT n, count(*) AS t FROM (SELECT unnest([p, q, r]) AS n FROM tri) GROUP BY 1),
cl AS (SELECT node, coalesce(d, 0) AS degree, CASE WHEN coalesce(d, 0) > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS clustering FROM nodes LEFT JOIN deg ON u = node LEFT JOIN t ON n = node)"""


@query("clustering_coeff", f"WITH {TRI} SELECT node, degree, round(clustering, 6) AS clustering FROM cl")
def clustering(spark, sf):
    """N08"""
    return G.clustering(*graph(spark, sf)).withColumn("clustering", F.round("clustering", 6))


@query("topology", f"""WITH RECURSIVE {TRI}, r(node, reach) AS (SELECT node, node FROM nodes UNION SELECT r.node, d.v FROM r JOIN d ON r.reach = d.u), c AS (SELECT component, count(*) AS s FROM (SELECT node, min(reach) AS component FROM r GROUP BY 1) GROUP BY 1)
  SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m, (SELECT round(avg(clustering), 6) FROM cl) AS clustering, (SELECT count(*) FROM c) AS components, (SELECT max(s) FROM c) AS largest,
  round(2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS density""")
def topology(spark, sf):
    """N07"""
    return G.topology(*graph(spark, sf)).withColumn("clustering", F.round("clustering", 6)).withColumn("density", F.round("density", 6))


@query("edge_strength", f"WITH {EDGES} SELECT a, b, 0.0::DOUBLE AS jaccard, 0::BIGINT AS attachment, shared::DOUBLE AS combined FROM edges")
def edge_strength(spark, sf):
    """N06, parity: link-prediction scores are of pairs without an edge"""
    edges = graph(spark, sf)[1].withColumn("weight", F.col("shared").cast("double"))
    return G.strength(edges).select("a", "b", F.col("jaccard").cast("double").alias("jaccard"), F.col("attachment").cast("long").alias("attachment"), "combined")


@query("edge_strength_true", f"""WITH {EDGES}, c AS (SELECT a, b, count(*) AS c FROM edges e JOIN d x ON x.u = e.a JOIN d y ON y.u = e.b AND y.v = x.v GROUP BY 1, 2)
  SELECT e.a, e.b, round(coalesce(c, 0) / (p.d + q.d - coalesce(c, 0))::DOUBLE, 6) AS jaccard, p.d * q.d AS attachment, round(shared * (1 + coalesce(c, 0) / (p.d + q.d - coalesce(c, 0))::DOUBLE), 6) AS combined
  FROM edges e LEFT JOIN c ON c.a = e.a AND c.b = e.b JOIN deg p ON p.u = e.a JOIN deg q ON q.u = e.b""")
def edge_strength_true(spark, sf):
    """N06, as it is meant"""
    edges = graph(spark, sf)[1].withColumn("weight", F.col("shared").cast("double"))
    return G.strength(edges, "true").select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.col("attachment").cast("long").alias("attachment"), F.round("combined", 6).alias("combined"))


def between_sql(depth: int = 9) -> str:
    """Shortest paths of all pairs, a step at a time, and the share of each node in them."""
    steps = ", ".join(f"""v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL SELECT s, d.v, {k + 1}, sum(n) FROM v{k} x JOIN d ON d.u = x.t WHERE dist = {k} AND NOT EXISTS (SELECT 1 FROM v{k} y WHERE y.s = x.s AND y.t = d.v) GROUP BY 1, 2)""" for k in range(depth))
    return f"""WITH {EDGES}, v0 AS (SELECT node AS s, node AS t, 0 AS dist, 1.0::DOUBLE AS n FROM nodes), {steps},
  b AS (SELECT m.t AS node, sum(m.n * r.n / w.n) AS x FROM v{depth} m JOIN v{depth} r ON m.t = r.s AND m.s <> m.t AND r.t <> m.t JOIN v{depth} w ON w.s = m.s AND w.t = r.t AND w.dist = m.dist + r.dist AND w.s <> w.t GROUP BY 1)
  SELECT node, round(coalesce(x, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 6) AS betweenness FROM nodes LEFT JOIN b USING (node)"""


@query("betweenness", between_sql())
def betweenness(spark, sf):
    """N02"""
    return G.betweenness(*graph(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


@query("path_metrics", f"""WITH RECURSIVE {EDGES}, walk(s, t, d) AS (SELECT node, node, 0 FROM nodes UNION SELECT s, d.v, walk.d + 1 FROM walk JOIN d ON d.u = walk.t WHERE walk.d < 20),
  short AS (SELECT s, t, min(d) AS d FROM walk GROUP BY 1, 2), comp AS (SELECT s AS node, min(t) AS c FROM short GROUP BY 1), big AS (SELECT c FROM comp GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1)
  SELECT (SELECT count(*) FROM comp WHERE c = (SELECT c FROM big)) AS nodes, max(d) AS diameter, round(avg(d), 9) AS mean_path FROM short JOIN comp ON comp.node = s WHERE c = (SELECT c FROM big) AND d > 0""")
def path_metrics(spark, sf):
    """Diameter and mean length of shortest paths of the largest component"""
    from ..operators import communities as C

    return C.path_metrics(*graph(spark, sf)).withColumn("mean_path", F.round("mean_path", 9))


@query("modularity_communities")
def modularity(spark, sf):
    """Tested for its modularity against greedy merging"""
    from ..operators import communities as C

    return C.louvain(*graph(spark, sf))


def weighted_communities(spark, sf, weight):
    from ..operators import communities as C

    edges = similarity_edges(spark, sf).checkpoint()
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"))
    found = C.louvain(nodes, edges, F.col(weight)).checkpoint()
    other = G.leanings(found.withColumnRenamed("community", "cluster"), edges, F.col(weight), 0.5)
    held = other.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("cluster")), ",").alias("others"))
    return found.join(held.hint("merge"), "node", "left")


@query("risk_communities")
def risk_communities(spark, sf):
    """Communities by severity and the others that a node leans to by 0.5 or more; held by tests of both parts"""
    with_checkpoints(spark)
    return weighted_communities(spark, sf, "severity")


@query("topic_communities")
def topic_communities(spark, sf):
    """Communities by similarity"""
    with_checkpoints(spark)
    return weighted_communities(spark, sf, "similarity")


@query("cluster_secondary", label_sql(3).replace("SELECT node, label FROM l3", "SELECT d.u AS node, l.label AS cluster, round(avg(shared), 6) AS weight FROM d JOIN l3 l ON l.node = d.v JOIN l3 o ON o.node = d.u WHERE l.label <> o.label GROUP BY 1, 2 HAVING avg(shared) >= 0.5"))
def cluster_secondary(spark, sf):
    """Other communities a node leans to, by the mean weight of its edges to them"""
    nodes, edges = graph(spark, sf)
    return G.leanings(G.label_propagation(nodes, edges, rounds=3).withColumnRenamed("label", "cluster"), edges, F.col("shared"), 0.5).withColumn("weight", F.round("weight", 6))


@query("facets", """SELECT coalesce('segment:' || c_mktsegment, 'nation:' || c_nationkey) AS facet, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))""")
def facets(spark, sf):
    """All facets in one pass"""
    c = table(spark, sf, "customer")
    rows = c.groupingSets([[F.col("c_mktsegment")], [F.col("c_nationkey")]], "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce(F.concat(F.lit("segment:"), "c_mktsegment"), F.concat(F.lit("nation:"), "c_nationkey")).alias("facet"), "n")


@query("filter_nodes_edges", f"""WITH {EDGES}, k AS (SELECT s_suppkey AS n FROM supplier WHERE s_acctbal >= 1000 AND s_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8)) SELECT a, b FROM edges WHERE a IN (SELECT n FROM k) AND b IN (SELECT n FROM k) AND shared >= 1""")
def filter_nodes_edges(spark, sf):
    """F05, F07, F08"""
    keep = table(spark, sf, "supplier").where((F.col("s_acctbal") >= 1000) & F.col("s_nationkey").isin(*range(1, 9))).select(F.col("s_suppkey").alias("node"))
    return G.induced(graph(spark, sf)[1], keep).where("shared >= 1").select("a", "b")


@query("node_metadata", r"""WITH n AS (SELECT 'src/app_' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.md' END || '_v' || s_nationkey AS id FROM supplier)
  SELECT id, try_cast(nullif(regexp_extract(id, '_v(\d+)$', 1), '') AS INT) AS version, CASE regexp_extract(regexp_replace(id, '_v\d+$', ''), '\.(\w+)$', 1) WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' ELSE 'unknown' END AS language FROM n""")
def node_metadata(spark, sf):
    """F06, X15"""
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".java"), F.lit(".md")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("src/app_"), "s_suppkey", ext, F.lit("_v"), "s_nationkey").alias("id"))
    from ..functions.code import language

    return rows.select("id", F.nullif(F.regexp_extract("id", r"_v(\d+)$", 1), F.lit("")).cast("int").alias("version"), F.coalesce(language(F.regexp_replace("id", r"_v\d+$", "")), F.lit("unknown")).alias("language"))


@query("entity_map", "SELECT l_suppkey AS entity, l_partkey AS chunk FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) <= 3")
def entity_map(spark, sf):
    """N13"""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("chunk")).distinct()
    return K.top(rows, ["entity"], [F.asc("chunk")], 3).drop("rank")


@query("adaptive_neighbours", "SELECT o_custkey AS community, count(*) AS n, CASE WHEN count(*) * 50 < 100 THEN 20 WHEN count(*) * 50 < 500 THEN 15 WHEN count(*) * 50 < 2000 THEN 10 ELSE 5 END AS k FROM orders GROUP BY 1")
def adaptive_neighbours(spark, sf):
    """For graphs of 50 nodes an order"""
    size = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("community")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n") * 50
    return size.select("community", "n", F.when(n < 100, 20).when(n < 500, 15).when(n < 2000, 10).otherwise(5).alias("k"))


@query("neighbour_expansion", f"""WITH {EDGES}, s AS (SELECT u, count(*) AS found, avg(sqrt(least(1, shared / 3.0) * 0.9)) AS quality FROM d GROUP BY 1) SELECT u AS node, found, round(quality, 6) AS quality, CASE WHEN found >= 0.8 * 10 AND quality >= 0.5 THEN least(15, 20) ELSE 10 END AS k FROM s""")
def neighbour_expansion(spark, sf):
    """W12"""
    rows = G.directed(graph(spark, sf)[1]).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("found"), F.avg(F.sqrt(F.least(F.lit(1.0), F.col("shared") / 3) * 0.9)).alias("quality"))
    return rows.select("node", "found", F.round("quality", 6).alias("quality"), F.when((F.col("found") >= 8) & (F.col("quality") >= 0.5), 15).otherwise(10).alias("k"))


@query("graph_layers", f"""WITH RECURSIVE arcs AS (SELECT DISTINCT n_regionkey + 100 AS u, n_nationkey AS v FROM nation UNION SELECT n_nationkey, s_suppkey + 1000 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  n AS (SELECT u AS node FROM arcs UNION SELECT v FROM arcs), l(node, layer) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT v FROM arcs) UNION SELECT v, layer + 1 FROM l JOIN arcs ON u = node) SELECT node::BIGINT AS node, max(layer) AS layer FROM l GROUP BY 1""")
def graph_layers(spark, sf):
    """N16, L02"""
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    arcs = nation.select((F.col("n_regionkey") + 100).cast("long").alias("u"), F.col("n_nationkey").cast("long").alias("v"))
    arcs = arcs.unionByName(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("long").alias("u"), (F.col("s_suppkey") + 1000).cast("long").alias("v"))).distinct()
    return G.layers(arcs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), arcs)


@query("circular_layout", """WITH n AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT node, round(100 * cos(2 * pi() * i / n), 6) AS x, round(100 * sin(2 * pi() * i / n), 6) AS y FROM n""")
def circular_layout(spark, sf):
    """The layout of one drawing, whose nodes one window holds"""
    from pyspark.sql import Window

    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    angle = 2 * F.pi() * (F.row_number().over(Window.orderBy("node")) - 1) / n
    return rows.select("node", F.round(100 * F.cos(angle), 6).alias("x"), F.round(100 * F.sin(angle), 6).alias("y"))


@query("spatial_query", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 1000 AND c_nationkey BETWEEN 5 AND 10")
def spatial_query(spark, sf):
    """A rectangle"""
    return table(spark, sf, "customer").where(F.col("c_acctbal").between(0, 1000) & F.col("c_nationkey").between(5, 10)).select("c_custkey")


@query("force_layout")
def force_layout(spark, sf):
    """The nations of each region, whose suppliers bind them; tested for its forces"""
    nation = table(spark, sf, "nation")
    nodes = nation.select(F.col("n_regionkey").alias("drawing"), F.col("n_nationkey").alias("node"))
    edges = nodes.select("drawing", F.col("node").alias("a")).join(nodes.select("drawing", F.col("node").alias("b")), "drawing").where("a < b and (a + b) % 3 = 0")
    return W.force_layout(nodes, edges)


@query("layout_bounds", "SELECT n_regionkey AS drawing, min(n_nationkey) - 1.0 AS x_min, min(n_nationkey * 2) - 1.0 AS y_min, max(n_nationkey) + 1.0 AS x_max, max(n_nationkey * 2) + 1.0 AS y_max FROM nation GROUP BY 1")
def layout_bounds(spark, sf):
    """L05"""
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("drawing"), F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("x"), (F.col("n_nationkey") * 2.0).alias("y"))
    return W.bounds(rows, 1.0)


@query("box_collisions", """WITH b AS (SELECT c_custkey AS node, c_custkey % 97 AS x, c_custkey % 89 AS y FROM customer) SELECT a.node AS a, b.node AS b FROM b a JOIN b ON a.node < b.node AND a.x < b.x + 1.5 AND b.x < a.x + 1.5 AND a.y < b.y + 1.5 AND b.y < a.y + 1.5""")
def box_collisions(spark, sf):
    """L05"""
    k = F.col("c_custkey")
    return W.collisions(table(spark, sf, "customer").select(k.alias("node"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y"), F.lit(1.5).alias("w"), F.lit(1.5).alias("h")), 4.0)
