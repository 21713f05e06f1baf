"""Queries of assessment, links, structure and model steps: turns of a conversation stand for the chunks of a thesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stem import preprocessed, stemmed
from ..operators import academic as A
from ..operators import answers as N
from ..operators import citations as C
from ..operators import retrieval as R
from ..sources import stores as S
from .documents import REFS, refs
from .registry import query, table

PARTS = ("introduction", "methodology", "results", "discussion", "conclusion", "limitations")
CHUNKS = f"""ch AS (SELECT conv_id AS doc_id, turn AS place, [{", ".join(f"'{p}'" for p in PARTS)}][turn % 6 + 1] AS section, text FROM conversations)"""


def chunks(spark, sf):
    part = F.element_at(F.array(*map(F.lit, PARTS)), (F.col("turn") % 6 + 1).cast("int"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), part.alias("section"), "text")


def section_sql(name: str, *keys: str) -> str:
    hit = " OR ".join(f"contains(section, '{k}')" for k in keys)
    return f"""{name} AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY place, text) AS text FROM (SELECT *, {hit} AS hit, bool_or({hit}) OVER (PARTITION BY doc_id) AS anyone FROM ch) WHERE hit OR NOT anyone GROUP BY 1)"""


@query("section_texts", f"WITH {CHUNKS}, {section_sql('r', 'results', 'findings')} SELECT doc_id, md5(text) AS hash FROM r")
def section_texts(spark, sf):
    """A23"""
    return A.section_text(chunks(spark, sf), ("results", "findings")).select("doc_id", F.md5("text").alias("hash"))


LABELS = ("Abstract", "Chapter 3 Results", "chapter 14", "References", "Findings and analysis", "N Mean SD", "Appendix B")


@query("section_types", f"""SELECT o_orderkey, CASE WHEN label IN ('Abstract') THEN 'pre-matter' WHEN label IN ('References', 'Appendix B') THEN 'post-matter' WHEN label IN ('Chapter 3 Results', 'Findings and analysis') THEN 'main-matter' ELSE 'unknown' END AS part
  FROM (SELECT o_orderkey, [{", ".join(f"'{x}'" for x in LABELS)}][o_orderkey % {len(LABELS)} + 1] AS label FROM orders)""")
def section_types(spark, sf):
    """A23, C18"""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("o_orderkey") % len(LABELS) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", A.matter(label).alias("part"))


def any_sql(column: str, keys) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{k}')" for k in keys) + ")"


WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query("thesis_flags", f"""WITH {CHUNKS}, {section_sql('r', 'results', 'findings')}, {section_sql('c', 'conclusion', 'discussion')}, s AS (SELECT doc_id, bool_or(contains(section, 'limitation')) AS limits,
  coalesce(sum(CASE WHEN section = 'conclusion' THEN {WORDS} END), 0) AS e, coalesce(sum(CASE WHEN section = 'results' THEN {WORDS} END), 0) AS m FROM ch GROUP BY 1), x AS (SELECT s.*, {any_sql('c.text', A.STRONG_MARKERS)} AS claimed, {any_sql('r.text', A.FIGURES)} AS shown FROM s JOIN r USING (doc_id) JOIN c USING (doc_id))
  SELECT doc_id, 'data_conclusion_mismatch' AS flag, 'warning' AS severity FROM x WHERE claimed AND NOT shown UNION ALL SELECT doc_id, 'citation_misrepresentation', 'warning' FROM x WHERE claimed AND doc_id % 2 = 1
  UNION ALL SELECT doc_id, 'missing_limitations', 'critical' FROM x WHERE NOT limits UNION ALL SELECT doc_id, 'scope_creep', 'warning' FROM x WHERE m > 0 AND e / m::DOUBLE > 1.5""")
def thesis_flags(spark, sf):
    """Even ones have references"""
    rows = chunks(spark, sf)
    return A.thesis_flags(rows, rows.where("doc_id % 2 = 0").select("doc_id"))


TOK_SQL = r"regexp_extract_all(lower(q), '[\p{L}\p{N}''-]+')"


@query("question_alignment", rf"""WITH {CHUNKS}, {section_sql('f', 'results', 'findings', 'discussion', 'conclusion')}, q AS (SELECT doc_id, unnest([first(text ORDER BY place, text), last(text ORDER BY place, text)]) AS q FROM ch GROUP BY 1),
  t AS (SELECT q.doc_id, list_filter({TOK_SQL}, lambda x: length(x) > 4 AND NOT list_contains([{", ".join(f"'{w}'" for w in A.QUESTION_COMMON)}], x)) AS terms, lower(f.text) AS low FROM q JOIN f USING (doc_id)),
  m AS (SELECT doc_id, len(terms) AS n, len(list_filter(terms, lambda x: contains(low, x))) AS hits FROM t) SELECT doc_id, round(avg((coalesce(hits / nullif(n, 0)::DOUBLE, 0) >= 0.4)::INT), 6) AS score, count(*) FILTER (n > 0 AND hits / n::DOUBLE < 0.4) AS unaddressed FROM m GROUP BY 1""")
def question_alignment(spark, sf):
    """A text's first and last chunk stand for its questions"""
    rows = chunks(spark, sf)
    order = F.struct("place", "text")
    asked = rows.groupBy("doc_id").agg(F.array(F.min_by("text", order), F.max_by("text", order)).alias("q"))
    both = asked.join(A.section_text(rows, ("results", "findings", "discussion", "conclusion")), "doc_id")
    found = both.select("doc_id", A.question_alignment(F.col("q"), F.col("text")).alias("a"))
    return found.select("doc_id", F.round("a.score", 6).alias("score"), F.size("a.unaddressed").cast("long").alias("unaddressed"))


QUESTION = r"""regexp_matches(low, '\\b(how|what|why|when|where|which|who)\\b')::INT + regexp_matches(low, '^(how|what|why|when|where|which|who)\\b')::INT + (low LIKE '%?')::INT + regexp_matches(lower(label), '\\brq ?[0-9]|question')::INT"""
ODD = " OR ".join(f"contains(low, '{w}')" for w in (*A.NOT_QUESTIONS, *A.NOT_SENTENCES))


@query("research_questions", rf"""WITH d AS (SELECT doc_id, text || ' RQ1: How do trees grow in dry soils over time? In short, what makes forests resilient to fire?' AS t FROM documents),
  p AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.?!])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS raw, unnest(range(length(t) + 9)) AS i FROM d),
  l AS (SELECT doc_id, i, raw, regexp_extract(raw, '^(.*:[ \t]+)?[ \t*•-]*(\(?[Qq]?[0-9]+[.):][ \t]*)?') AS label FROM p WHERE raw IS NOT NULL),
  s AS (SELECT doc_id, i, label, trim(raw[length(label) + 1:]) AS s, lower(trim(raw[length(label) + 1:])) AS low FROM l),
  q AS (SELECT doc_id, s AS question, min(i) AS i FROM s WHERE {QUESTION} >= 2 AND NOT ({ODD}) AND length(s) BETWEEN 20 AND 400 AND len(regexp_extract_all(low, '[a-z0-9]{{4,}}')) >= 3 GROUP BY 1, 2)
  SELECT doc_id, question FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 10""".replace("\\\\", "\\"))
def research_questions(spark, sf):
    """A17"""
    asked = F.concat("text", F.lit(" RQ1: How do trees grow in dry soils over time? In short, what makes forests resilient to fire?"))
    return A.research_questions(table(spark, sf, "documents").select("doc_id", asked.alias("text"))).select("doc_id", F.explode("questions").alias("question"))


WORDS_SQL = "list_filter(regexp_split_to_array(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: len(w) > 2)"


@query("chapter_alignment", f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest([1, 2, 3, 4, 5]) AS k, w FROM w),
  t AS (SELECT doc_id, k, 'Title' || k || coalesce(' ' || w[k], '') || coalesce(' ' || w[k + 5], '') AS title, NOT (doc_id % 3 = 0 AND k = 2) AS there FROM c)
  SELECT doc_id, k::VARCHAR AS number, title, CASE WHEN there THEN 5 + 2 * (k - 1) - CASE WHEN doc_id % 3 = 0 AND k > 2 THEN 2 ELSE 0 END + 0 END AS heading_line FROM t""")
def chapter_alignment(spark, sf):
    """A thesis of five chapters from the words of every document, with wrong page numbers; every third lacks one chapter and all say the first heading again"""
    from ..operators import chapters as C

    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda w: F.length(w) > 2)
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", words.alias("w"))
    name = lambda k: F.concat_ws(" ", F.lit(f"Title{k}"), F.get("w", F.lit(k - 1)), F.get("w", F.lit(k + 4)))
    listed = [F.concat(F.lit(f"Chapter {k}: "), name(k), F.lit(f" ..... {90 - 7 * k}")) for k in range(1, 6)]
    body = [F.when(~((F.col("doc_id") % 3 == 0) & F.lit(k == 2)), F.concat(F.lit(f"Chapter {k}: "), name(k), F.lit("\nwords of it"))) for k in range(1, 6)]
    theses = rows.select("doc_id", F.concat_ws("\n", *listed, *body, F.concat(F.lit("Chapter 1: "), name(1))).alias("text"))
    return C.located(C.contents(theses), C.headings(theses)).select("doc_id", "number", "title", "heading_line")


@query("concept_progression")
def concept_progression(spark, sf):
    """Tested on a small thesis"""
    return A.concept_progression(chunks(spark, sf).select("doc_id", "place", F.concat_ws(" ", "section", "place").alias("name"), "text"), stemmed)


@query("stems")
def stems(spark, sf):
    """Tested against the algorithm's published examples"""
    return table(spark, sf, "documents").select("doc_id", F.array_join(preprocessed(F.col("text"), "porter", twice=True), " ").alias("stems"))


@query("node_look", f"""WITH {REFS} SELECT id, CASE WHEN id % 10 = 0 THEN '#9333ea' WHEN source = 'crossref' THEN '#10b981' WHEN source = 'arxiv' THEN '#3b82f6' ELSE '#6b7280' END AS colour,
  round(CASE WHEN id % 10 = 0 THEN 30 ELSE 10 + 30 * coalesce(confidence, 0.5) END, 6) AS size, CASE WHEN id % 10 = 0 THEN 'diamond' WHEN oa THEN 'circle' ELSE 'square' END AS shape, CASE WHEN id % 10 = 0 OR link = 'available' THEN 1.0 ELSE 0.7 END AS opacity FROM refs""")
def node_look(spark, sf):
    """A24"""
    kind = F.when(F.col("id") % 10 == 0, "primary").otherwise("reference")
    look = A.node_look(F.col("source"), F.col("confidence"), kind, F.lit("academic"), F.col("link"), F.col("oa"))
    return refs(spark, sf).select("id", look.alias("l")).select("id", "l.colour", F.round("l.size", 6).alias("size"), "l.shape", "l.opacity")


@query("persona_applies", f"""WITH {REFS} SELECT id, citations > 10 AS supervisor, (link = 'available' AND paywall = FALSE AND (oa OR link = 'available')) AS assessor, year(o_orderdate) >= 2020 AS researcher,
  round(0.4 * CASE link WHEN 'stale_404' THEN 1.0 WHEN 'stale_moved' THEN 0.25 ELSE 0 END, 6) AS penalty FROM refs""")
def persona_applies(spark, sf):
    """F12, X51"""
    c = F.col
    args = (c("link"), c("citations"), ~c("paywall"), c("oa"), F.year("o_orderdate"))
    return refs(spark, sf).select("id", A.applies("supervisor", *args).alias("supervisor"), A.applies("assessor", *args, verifiable=True).alias("assessor"), A.applies("researcher", *args).alias("researcher"),
                                  F.round(A.stale_penalty(c("link"), 0.4), 6).alias("penalty"))


@query("thesis_summary", """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 3 AS missing, (o_orderkey % 11) / 10.0::DOUBLE AS coherence, (o_orderkey % 4) / 4.0::DOUBLE AS recency, o_orderkey % 2 AS unsupported, o_orderkey % 5 AS gaps FROM orders)
  SELECT id, concat_ws(' | ', CASE WHEN missing > 0 THEN missing || ' required sections missing' ELSE 'All required sections present' END, CASE WHEN coherence >= 0.7 THEN 'Strong' WHEN coherence >= 0.5 THEN 'Moderate' ELSE 'Weak' END || ' chapter flow (' || printf('%.2f', coherence) || ')',
  CASE WHEN recency >= 0.5 THEN 'Good citation recency (' ELSE 'Stale citations (' END || round(100 * recency)::INT || '% recent)', CASE WHEN unsupported > 0 THEN unsupported || ' sections with unsupported claims' END, CASE WHEN gaps > 0 THEN gaps || ' methodology items missing' END) AS summary FROM s""")
def thesis_summary(spark, sf):
    """A21"""
    k, none = F.col("o_orderkey"), F.lit(0)
    return table(spark, sf, "orders").select(k.alias("id"), A.summary(k % 3, (k % 11) / 10, (k % 4) / 4, k % 2, k % 5, none, none).alias("summary"))


@query("clean_ids", r"""SELECT doc_id, CASE WHEN c = '' THEN 'unknown' WHEN length(c) <= 150 THEN c WHEN contains(left(c, 150), ' ') AND length(left(c, 150)) - length(string_split(left(c, 150), ' ')[-1]) - 1 > 75 THEN left(c, length(left(c, 150)) - length(string_split(left(c, 150), ' ')[-1]) - 1) ELSE left(c, 150) END AS id
  FROM (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '(\d)([A-Z])', '\1 \2', 'g'), ' '), '\s+', ' ', 'g'), '[<>:"|?*\\]', '', 'g') AS c FROM documents)""")
def clean_ids(spark, sf):
    """X14"""
    return table(spark, sf, "documents").select("doc_id", A.clean_id(F.col("text")).alias("id"))


@query("git_urls", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://h/projects/' || p_brand || '/repos/r/browse/' || p_name || '?at=refs/heads/main' WHEN 1 THEN 'https://h/' || p_brand || '/r/blob/main/' || p_name
  WHEN 2 THEN 'https://h/' || p_brand || '/r/-/blob/main/' || p_name WHEN 3 THEN 'https://h/' || p_brand || '/_git/r?path=/' || p_name || '&version=GBmain' END AS url FROM part""")
def git_urls(spark, sf):
    """X48"""
    provider = F.element_at(F.array(*map(F.lit, ("Bitbucket", "github", "gitlab", "azure", "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    url = N.git_file_url(provider, F.lit("https://h/"), F.col("p_brand"), F.lit("r"), F.lit(None).cast("string"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", url.alias("url"))


@query("answer_links", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'A' || chr(10) || chr(10) || '**References:**' || chr(10) || '- u' || (o_orderkey % 2) || chr(10) END AS answer FROM orders""")
def answer_links(spark, sf):
    """X55"""
    u = F.concat(F.lit("u"), F.col("o_orderkey") % 2)
    urls = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(u, F.lit(None).cast("string"), u))
    return table(spark, sf, "orders").select("o_orderkey", N.with_links(F.lit("A"), urls).alias("answer"))


@query("academic_majority", """SELECT l_orderkey AS q, avg((l_returnflag = 'N')::INT) > 0.5 AS academic, arg_min(l_shipdate_language, l_linenumber) AS language FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'java' END AS l_shipdate_language FROM lineitem) GROUP BY 1""")
def academic_majority(spark, sf):
    """X53"""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("place"), F.when(F.col("l_returnflag") == "N", "academic_reference").alias("source_category"), F.when(F.col("l_linestatus") == "O", "java").alias("language"))
    return N.mostly_academic(rows, "q")


ASKED_CODE = (("python flask endpoint", True), ("thesis methodology in java", False), ("what is governance", True), ("rest api of a microservice", True))


@query("code_queries", f"SELECT q || ' ' || c_custkey AS q, is_code FROM customer, (VALUES {', '.join(map(str, ASKED_CODE))}) t(q, is_code)")
def code_queries(spark, sf):
    """Questions of every customer"""
    rows = table(spark, sf, "customer").select(F.explode(F.array(*[F.lit(q) for q, _ in ASKED_CODE])).alias("q"), "c_custkey").select(F.concat_ws(" ", "q", "c_custkey").alias("q"))
    return rows.select("q", F.coalesce(R.detected_filters(F.col("q"))["source_category"] == "code", F.lit(False)).alias("is_code"))


@query("code_chunks", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND lang = 'de' AND doc_id % 5 = 0")
def code_chunks(spark, sf):
    """F04"""
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "code").otherwise("text").alias("source_category"), F.col("lang").alias("language"),
                                                F.lit(True).alias("has_dependencies"), (F.col("doc_id") % 5 == 0).alias("has_endpoints"), F.lit(None).cast("boolean").alias("is_service"))
    return rows.where(N.code_filters("DE", dependencies=True, endpoints=True)).select("doc_id")


@query("heading_paths", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' > Part ' || lang ELSE source || ' > Other' END AS path FROM documents")
def heading_paths(spark, sf):
    """W16"""
    other = F.when(F.col("doc_id") % 2 == 1, "## Other\n").otherwise("")
    head = F.concat(F.lit("# Old\n### deep\n# "), "source", F.lit("\n## Part "), "lang", F.lit("\n### x\n## "), F.when(F.col("doc_id") % 2 == 1, "Other").otherwise(F.concat(F.lit("Part "), "lang")), F.lit("\n"))
    return table(spark, sf, "documents").select("doc_id", N.heading_path(F.concat(head, "text"), F.length(head)).alias("path"))


@query("document_structure", """WITH b AS (SELECT doc_id, regexp_replace(text, '\\n', ' ', 'g') AS t FROM documents), p AS (SELECT doc_id, length(t) AS n FROM b)
  SELECT doc_id, 0::BIGINT AS place, 1 AS level, '1' AS number, 'Start' AS title, 0::BIGINT AS start, 17 + n AS "end" FROM p UNION ALL SELECT doc_id, 1, 2, '1.2', 'Middle', 17 + n, 29 + 2 * n FROM p
  UNION ALL SELECT doc_id, 2, 1, 'II', 'End', 29 + 2 * n, 63 + 2 * n FROM p""")
def document_structure(spark, sf):
    """Headings are put around each text, which is made one line"""
    t = F.regexp_replace("text", "\n", " ")
    whole = F.concat(F.lit("Chapter 1 Start\n"), t, F.lit("\n1.2 Middle\n"), t, F.lit("\nChapter II End\n1.3 Contents .... 7"))
    return N.structure(table(spark, sf, "documents").select("doc_id", whole.alias("text")))


@query("cache_models", "SELECT event_type AS model, count(*) AS entries, count(*) FILTER (value >= 250) AS hits, count(*) FILTER (NOT value >= 250) AS misses, round(count(*) FILTER (value >= 250) / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY 1")
def cache_models(spark, sf):
    """G40"""
    return N.usage(table(spark, sf, "events"), F.col("value") >= 250, F.col("event_type")).withColumn("hit_rate", F.round("hit_rate", 6))


AGE = "date_diff('day', ts::DATE, DATE '2024-05-01')"


@query("sample_statistics", f"SELECT count(*) AS samples, count(*) FILTER ({AGE} <= 90) AS active, count(*) FILTER ({AGE} > 90) AS stale, round(avg(CASE WHEN {AGE} > 90 THEN 0 ELSE greatest(0.1, exp(-{AGE} / 30.0)) END), 6) AS mean_weight FROM events")
def sample_statistics(spark, sf):
    """G41, X34"""
    age = F.date_diff(F.lit("2024-05-01").cast("date"), F.col("ts").cast("date"))
    return N.sample_statistics(table(spark, sf, "events"), age).withColumn("mean_weight", F.round("mean_weight", 6))


@query("topic_drift", """WITH v AS (SELECT o_custkey AS doc_id, o_orderkey AS version, list_distinct([o_orderpriority, o_orderstatus]) AS topics FROM orders), p AS (SELECT *, lag(topics) OVER (PARTITION BY doc_id ORDER BY version) AS before FROM v),
  s AS (SELECT doc_id, version, len(list_intersect(topics, before)) / len(list_distinct(list_concat(topics, before)))::DOUBLE AS s FROM p WHERE before IS NOT NULL) SELECT doc_id, version, round(s, 6) AS similarity, s < 0.5 AS drifted FROM s""")
def topic_drift(spark, sf):
    """C14: overlap of topics stands in for the model"""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("version"), F.array_distinct(F.array("o_orderpriority", "o_orderstatus")).alias("topics"))
    return N.drift(rows).withColumn("similarity", F.round("similarity", 6))


@query("cached_model_step", "SELECT doc_id, length(text)::BIGINT AS result, doc_id % 2 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 1) OR text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS cached FROM documents")
def cached_model_step(spark, sf):
    """The length of a text stands for a model's output; even documents are in the cache"""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("result"))
    return N.cached_step(docs, cache, "text", lambda t: t.map(len), "long").select("doc_id", "result", "cached")


@query("candidate_terms", """WITH k AS (SELECT p_brand AS term, p_type AS domain, count(*) AS f, CASE WHEN max(p_size) > 45 THEN 'approved' ELSE 'pending' END AS status FROM part WHERE p_size <= 50 GROUP BY 1, 2), s AS (SELECT p_brand AS term, p_type AS domain, 2 * count(*) AS f FROM part GROUP BY 1, 2)
  SELECT term, domain, sum(f)::BIGINT AS frequency, CASE WHEN term = 'Brand#11' THEN 'rejected' ELSE coalesce(max(status), 'pending') END AS status FROM (SELECT * FROM k UNION ALL SELECT term, domain, f, NULL FROM s) GROUP BY 1, 2""")
def candidate_terms(spark, sf):
    """C19"""
    part = table(spark, sf, "part").withColumnsRenamed({"p_brand": "term", "p_type": "domain"})
    known = part.where("p_size <= 50").groupBy("term", "domain").agg(F.count(F.lit(1)).alias("frequency"), F.when(F.max("p_size") > 45, "approved").otherwise("pending").alias("status"))
    seen = part.groupBy("term", "domain").agg((2 * F.count(F.lit(1))).alias("frequency"))
    found = N.recorded_candidates(known, seen)
    return N.decided(found, found.where("term = 'Brand#11'"), "rejected").select("term", "domain", "frequency", "status")


@query("cited_works", """SELECT DISTINCT s_suppkey AS node_id, s_name AS title FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = 1""")
def cited_works(spark, sf):
    """An order cites the suppliers of its lines"""
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("title"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), F.col("l_suppkey").alias("target"), F.lit("cites").alias("relation"))
    return S.cited_by(nodes, edges, "1")


@query("versioned_documents", """SELECT 'd' || doc_id AS id, (doc_id % 3 + 1)::INT AS version, CASE WHEN doc_id % 5 = 0 THEN 'code' ELSE 'unknown' END AS doc_type, (doc_id % 100)::DOUBLE AS health_score FROM documents""")
def versioned_documents(spark, sf):
    """S09, X40"""
    k = F.col("doc_id")
    meta = F.create_map(F.lit("version"), (k % 3 + 1).cast("string"), F.lit("language"), F.when(k % 5 == 0, "java"), F.lit("health"), F.format_string('{"health_score": %d}', k % 100))
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), k).alias("id"), meta.alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"))
    return S.versioned_documents(rows).select("id", "version", "doc_type", "health.health_score")


@query("node_page", "SELECT s_suppkey AS node, s_name FROM supplier ORDER BY s_suppkey LIMIT 10 OFFSET 20")
def node_page(spark, sf):
    """S16"""
    return S.node_page(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), "s_name"), 2, 10)


@query("benchmark_report", """SELECT '# Benchmark report' || chr(10) || chr(10) || '| model | queries | seconds | tokens | rating |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' | ' || printf('%.2f', s) || ' | ' || printf('%.1f', t) || ' | ' || printf('%.2f', r) || ' |', chr(10) ORDER BY event_type) AS report
  FROM (SELECT event_type, count(*) AS n, round(avg(value), 4) AS s, round(avg(user_id), 4) AS t, round(avg(event_id % 5), 4) AS r FROM events GROUP BY 1)""")
def benchmark_report(spark, sf):
    """S26"""
    stats = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("value"), 4).alias("seconds"), F.round(F.avg("user_id"), 4).alias("tokens"), F.round(F.avg(F.col("event_id") % 5), 4).alias("rating"))
    return S.benchmark_report(stats)


@query("redirect_pages", """SELECT page_id FROM pages WHERE length(html) < 5000 AND regexp_matches(lower(html), 'http-equiv=["'']?refresh|window\\.location|document\\.location|you are being redirected|click here if you are not redirected')""")
def redirect_pages(spark, sf):
    """S28"""
    return table(spark, sf, "pages").where(S.is_redirect_page(F.col("html"))).select("page_id")




# what a document's list looks like, and what is found in it, by its key (d)
LISTED = ("\nContents\nReferences ........ 9\n1 On trees\nReferences\nEarly, E. (1990). A note that stands alone here. Wiley.\n" + "plain prose goes on and on in lines\n" * 45
          + "References\nSmith, J., & Doe, A. ({y}). On trees of kind {d} and\ntheir many leaves. Journal of Wood, {v}(2), 11-19.\nC. (2017). Without a surname at great length.\n"
          "World Tree Council. (2011). Report {d} on trees. https://trees.example.org/r{d}\n[7] Race, Ethnicity and Education, 19(4), 784-807.\nBrown, K. (2005). A toolkitAustralianHealthNetwork\nof {d}. Journal of Words, "
          "2(1), 3-9. doi:10.1234/ab.{d} Green, L. M. (2006). Second of a line. Review of Lines, 4(4), 5-8.\nReferences\nVan Last, Z., Other, P. Q., & Third, R. (2010). The end of {d}. In Books of ends. Wiley.\n"
          "Appendix A\nclosing words in small letters follow here\n")  # fmt: skip
# (text, number, DOI, year, authors, title) of the entries found
LISTED_ENTRIES = (
    ("Smith, J., & Doe, A. ({y}). On trees of kind {d} and their many leaves. Journal of Wood, {v}(2), 11-19.", None, "{y}", "Smith, J.; Doe, A.", "On trees of kind {d} and their many leaves"),
    ("World Tree Council. (2011). Report {d} on trees. https://trees.example.org/r{d}", None, "2011", "World Tree Council", "Report {d} on trees"),
    ("Brown, K. (2005). A toolkit Australian Health Network of {d}. Journal of Words, 2(1), 3-9. doi:10.1234/ab.{d}", "10.1234/ab.{d}", "2005", "Brown, K.", "A toolkit Australian Health Network of {d}"),
    ("Green, L. M. (2006). Second of a line. Review of Lines, 4(4), 5-8.", None, "2006", "Green, L. M.", "Second of a line"),
    ("Van Last, Z., Other, P. Q., & Third, R. (2010). The end of {d}. In Books of ends. Wiley.", None, "2010", "Van Last, Z.; Other, P. Q.; Third, R.", "The end of {d}"),
)


def listed_sql(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "replace(replace(replace('" + text.replace("'", "''") + "', '{d}', doc_id::VARCHAR), '{y}', (1990 + doc_id % 20)::VARCHAR), '{v}', (1 + doc_id % 9)::VARCHAR)"


ENTRIES_SQL = " UNION ALL ".join(f"SELECT doc_id, {k}::INT AS place, {listed_sql(raw)} AS raw, {listed_sql(doi)} AS doi, {listed_sql(year)}::INT AS year, '{people}' AS authors, {listed_sql(name)} AS title FROM documents"
                                 for k, (raw, doi, year, people, name) in enumerate(LISTED_ENTRIES))


def listed_entries(spark, sf):
    text = F.lit(LISTED)
    for mark, value in (("{d}", F.col("doc_id")), ("{y}", 1990 + F.col("doc_id") % 20), ("{v}", 1 + F.col("doc_id") % 9)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return C.reference_entries(table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), text).alias("text")))


@query("reference_lists", ENTRIES_SQL)
def reference_lists(spark, sf):
    """After each text come a contents line, a list of one entry, a long gap, and a list with wrapped and joined entries, joined words, a page header and two entries that are none"""
    return listed_entries(spark, sf).select("doc_id", "place", "raw", "doi", "year", F.array_join("authors", "; ").alias("authors"), "title")


@query("cited_references", f"""WITH e AS ({ENTRIES_SQL}), n AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) ELSE 'ref:' || sha256(lower(title)) END AS ref_id FROM e)
  SELECT ref_id, min(raw) AS raw, count(*) AS citations, min(doc_id) AS first_doc FROM n GROUP BY 1""")
def cited_references(spark, sf):
    """Works of all lists, each once, with the documents that cite them"""
    from ..session import with_checkpoints

    with_checkpoints(spark)
    works, pairs = C.cited(listed_entries(spark, sf).checkpoint())
    return works.select("ref_id", "raw").join(pairs.groupBy("ref_id").agg(F.count(F.lit(1)).alias("citations"), F.min("doc_id").alias("first_doc")), "ref_id")


BOOKS = (("{n}, A. B. 2004. The book of {p}. Routledge, London", "The book of {p}", "{n}, A. B."), ("Ann {n}, Bob Stone (2011): The book of {p}. Sage", "The book of {p}", "Ann {n}; Bob Stone"),
         ("Ann {n} 1999. The book of {p}", "The book of {p}", "Ann {n}"), ("A study of {p}", "A study of {p}", ""))


@query("reviewed_books", "WITH b(t, title, authors) AS (VALUES " + ", ".join(map(str, BOOKS)) + """), p AS (SELECT p_partkey, p_partkey::VARCHAR AS p, CASE WHEN p_partkey % 2 = 0 THEN 'Kerr' ELSE 'Silva' END AS n FROM part)
  SELECT p_partkey, replace(replace(t, '{n}', n), '{p}', p) AS cited, replace(replace(title, '{n}', n), '{p}', p) AS title, replace(replace(authors, '{n}', n), '{p}', p) AS authors FROM b, p""")
def reviewed_books(spark, sf):
    """Titles about every part, three of which cite a book"""
    name = F.when(F.col("p_partkey") % 2 == 0, "Kerr").otherwise("Silva")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), name), F.lit("{p}"), F.col("p_partkey").cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.array(*[fill(t) for t, _, _ in BOOKS])).alias("cited"))
    book = C.reviewed_book(F.col("cited"))
    return rows.select("p_partkey", "cited", book["title"].alias("title"), F.array_join(book["authors"], "; ").alias("authors"))
