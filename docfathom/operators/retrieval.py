"""Retrieval end to end, query understanding, and small rules of dashboards and documents."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import keyword as K
from . import vectors as V
from ..functions.text import tokens
from ..session import with_checkpoints
from .terms import expanded

# Words of queries that set filters. A language's words are substrings, tried in this order.
LANGUAGE_WORDS = (
    ("groovy", ("groovy", "spock")), ("java", ("java", "spring", "maven", "junit", "gradle")), ("kotlin", ("kotlin", "kotlinx")), ("python", ("python", "django", "flask", "pytest")),
    ("go", ("go", "golang", "goroutine")), ("rust", ("rust", "cargo", "tokio")), ("javascript", ("javascript", "nodejs", "npm", "ts", "typescript")), ("sql", ("sql", "plsql", "tsql", "hive")),
    ("xml", ("xml", "xpath", "xsd")), ("yaml", ("yaml", "yml", "helm")), ("json", ("json", "jsonpath")),
)
ACADEMIC_WORDS = (
    "thesis", "phd", "dissertation", "methodology", "methodologies", "method", "methods", "literature review", "research question", "research questions", "findings", "discussion", "conclusion", "chapter",
    "abstract", "supervisor", "assessor", "academic", "citation", "citations", "reference", "references", "bibliography", "document", "feedback", "quality", "analysis",
)
CODE_WORDS = (
    "microservice", "/api/", "rest api", "soap api", "graphql", "endpoint", "controller class", "java class", "python class", "function definition", "code snippet", "implementation code", "service class",
)
# Words that mean code, services, dependencies, endpoints and calls; any of them asks for the category code.
CODE_EXAMPLE_WORDS = ("source code", "code snippet", "code example", "implementation code", "microservice", "api endpoint")
SERVICE_WORDS = ("microservice", "web service", "rest service", "api service")
DEPENDENCY_WORDS = ("maven dependency", "npm package", "pip install", "gradle", "library import", "package import")
ENDPOINT_WORDS = ("/api/", "rest api", "soap endpoint", "graphql", "http request", "http response", "api controller")
CALL_WORDS = ("function call", "method invocation", "api call", "service invocation")
GOVERNANCE_WORDS = ("security", "mfa", "authentication", "authorization", "authorisation")
PATTERN_WORDS = ("pattern", "architecture", "design")
API_WORDS = ("/api/", "rest api", "soap api", "api endpoint", "http request", "http response")
CONFIG_WORDS = ("config", "setting", "parameter", "option", "configuration")
TABLE_WORDS = ("table", "list", "matrix", "comparison")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def detected_filters(query: Column) -> Column:
    """Struct of the filters a query asks for: language, source_category, is_api_reference, is_configuration, contains_table."""
    q = F.lower(query)
    code_like = any_of(q, CODE_WORDS)
    code_allowed = ~any_of(q, ACADEMIC_WORDS) | code_like
    lang = F.lit(None).cast("string")
    for name, words in reversed(LANGUAGE_WORDS):
        lang = F.when(any_of(q, words), name).otherwise(lang)
    lang = F.when(code_allowed, lang)
    code = code_allowed & (lang.isNotNull() | any_of(q, CODE_EXAMPLE_WORDS + SERVICE_WORDS + DEPENDENCY_WORDS + ENDPOINT_WORDS + CALL_WORDS) | code_like)
    category = F.when(code, "code").when(any_of(q, GOVERNANCE_WORDS), "governance").when(any_of(q, PATTERN_WORDS), "patterns")
    return F.struct(lang.alias("language"), category.alias("source_category"), (any_of(q, API_WORDS) & code_allowed).alias("is_api_reference"),
                    (any_of(q, CONFIG_WORDS) & category.isNull()).alias("is_configuration"), any_of(q, TABLE_WORDS).alias("contains_table"))


def retrieve(docs: DataFrame, query: str, semantic: DataFrame | None, k: int = 5, weights: tuple[float, float] = (0.6, 0.4), scorer=None, where: Column | None = None, expand: bool = False,
             vocabulary: DataFrame | None = None, domain: str | None = None, edges: DataFrame | None = None, neighbours: DataFrame | None = None, persona: tuple[DataFrame, str, int] | None = None) -> DataFrame:
    """(id, text, score, method, rank): keyword search of docs (doc_id, text, ...) joined with an injected semantic list
    (query_id 0, id, score), fused, reranked by the light rules or an injected scorer(query, text).

    where: only documents of this filter are searched, on both sides. expand: the query's terms are searched with what they
    expand to in the domain and its vocabulary (term, acronym, weight), each by its weight. edges (a, b, severity): results bring in the neighbours of their worst edges at half their score. persona (references,
    persona, year): what its rules let through, ordered by its scores. neighbours (id, prev_id, next_id, text): each result comes with
    the chunks before and after it, `part` says which is which.
    """
    spark = docs.sparkSession
    docs = docs if where is None else docs.where(where)
    asked = K.literal_queries(spark, [query])
    terms = weighted_terms(asked, domain, vocabulary) if expand else K.query_terms(asked)
    words = K.bm25_terms(docs, terms, 2 * k).select("query_id", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    if semantic is not None and where is not None:
        semantic = semantic.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    top = words.select("query_id", "id", "score", F.lit("keyword").alias("method")) if semantic is None else V.fused(semantic, words, 2 * k, "rrf", weights).drop("rank")
    rows = top.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    if scorer is not None:
        rows = V.cross_encoded(rows.withColumn("query", F.lit(query)).drop("score"), scorer, k)
    else:
        no = F.lit(False)
        rows = rows.withColumn("score", V.rerank_score(F.col("text"), 2 * (1 - F.col("score") / F.max("score").over(Window.partitionBy("query_id"))), query, F.lit(0), no, no, no))
        rows = K.top(rows, ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], k)
    rows = rows.select("id", "text", "score", "method", "rank")
    if edges is not None:
        more = with_graph(rows, edges, k).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
        rows = rows.unionByName(more.select("id", "text", "score", F.lit("graph").alias("method"), F.lit(None).cast("int").alias("rank")))
    if persona is not None:
        references, name, year = persona
        kept = V.persona_scored(references, name, year).select("id", "persona_score")
        rows = rows.join(kept, "id").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("persona_score", 9)), "id"))).drop("persona_score")  # at most a few times k rows
    return rows if neighbours is None else with_neighbours(rows, neighbours)


def weighted_terms(queries: DataFrame, domain: str | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, term, times) of the tokens of queries (query_id, query) and of what they expand to: how often a token is asked, by the greatest
    weight of an expansion that holds it."""
    own = K.query_terms(queries).select("query_id", "term", F.col("times").cast("double").alias("times"), F.lit(1.0).alias("weight"))
    more = expanded(queries, domain, vocabulary).select("query_id", F.explode(tokens(F.col("term"))).alias("term"), F.lit(1.0).alias("times"), F.col("weight").cast("double").alias("weight"))
    return own.unionByName(more).groupBy("query_id", "term").agg((F.max("times") * F.max("weight")).alias("times"))


def with_graph(rows: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, score): up to k neighbours of each result (id, score) by severity that are no results themselves, at half the best score that led to them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "severity").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "severity"))
    near = K.top(both.join(rows.select(F.col("id").alias("u"), "score"), "u"), ["u"], [F.desc("severity"), F.asc("v")], k)
    return near.groupBy(F.col("v").alias("id")).agg((F.max("score") / 2).alias("score")).join(rows.select("id"), "id", "left_anti")


def with_neighbours(rows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """rows with a row for the chunk before and after each (id, prev_id, next_id), in the order prev, main, next."""
    named = rows.join(neighbours.select("id", "prev_id", "next_id"), "id", "left")
    parts = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(name).alias("part"), F.col(c).alias("at")) for n, name, c in ((0, "prev", "prev_id"), (1, "main", "id"), (2, "next", "next_id"))])
    every = named.withColumn("p", F.explode(parts)).where("p.at is not null").select(F.col("p.at").alias("id"), "p.part", "p.place", "score", "method", "rank", F.when(F.col("p.part") == "main", F.col("text")).alias("own"))
    return every.join(neighbours.select("id", F.col("text").alias("_text")), "id", "left").withColumn("text", F.coalesce("own", "_text")).drop("own", "_text")


def bm25_to_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (id, score) that have a chunk, with distance 1 - score / 10 between 0 and 1."""
    return hits.join(chunks, "id").withColumn("distance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("score") / 10)))


def with_parents(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (id, ...) with the parent's text where there is one, else their own; children_with_parents() leaves the others out."""
    rows = hits.join(children.select("id", "parent_id", "text"), "id").join(parents.select("parent_id", F.col("text").alias("whole")), "parent_id", "left")
    return rows.withColumn("text", F.coalesce("whole", "text")).drop("whole")


def children_with_parents(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (id, ...) with parent_id and the parent's text, of children that have a parent."""
    return hits.join(children.select("id", "parent_id"), "id").join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id")


def prompt(query: Column, chunks: Column) -> Column:
    """A numbered context and the question."""
    return F.concat(F.lit("Context:\n"), F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n"), F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def service_calls(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(source, target, called) of nodes (node, service) and calls (source, called): the first node whose service or id says the
    called name, by node. Equal services join by key; only names that match no service look into ids, in blocks of distinct names."""
    named = calls.join(nodes.where("service is not null").groupBy(F.col("service").alias("called")).agg(F.min("node").alias("target")), "called", "left")
    lost = named.where("target is null").select("called").distinct()
    inside = lost.join(nodes.select("node"), F.col("node").contains(F.col("called"))).groupBy("called").agg(F.min("node").alias("other"))
    rows = named.join(inside, "called", "left").select("source", F.coalesce("target", "other").alias("target"), "called")
    return rows.where("target is not null and source <> target").dropDuplicates(["source", "target"])


def spans_to_sections(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end) with the first section (doc_id, place, start, end, title) of their text they overlap."""
    s = sections.select("doc_id", F.col("place"), F.col("start").alias("s"), F.col("end").alias("e"), "title")
    hit = spans.join(s, "doc_id").where(~((F.col("end") < F.col("s")) | (F.col("start") >= F.col("e"))))
    return hit.groupBy("doc_id", "start", "end").agg(F.min_by("title", "place").alias("title"))


def sampled_edges(edges: DataFrame, nearest: DataFrame, factor: float = 0.8) -> DataFrame:
    """Edges (a, b, confidence) of sampled nodes, and copies of them for every other node (node, sampled) at less confidence."""
    copies = nearest.join(edges, F.col("sampled") == F.col("a")).select(F.col("node").alias("a"), "b", (F.col("confidence") * factor).alias("confidence")).where("a <> b")
    return edges.select("a", "b", "confidence").unionByName(copies)


def merged_vocabulary(target: DataFrame, source: DataFrame) -> DataFrame:
    """(term, weight, frequency) of both: frequencies add up, the target's weight wins."""
    both = target.withColumn("p", F.lit(0)).unionByName(source.withColumn("p", F.lit(1)))
    return both.groupBy("term").agg(F.min_by("weight", "p").alias("weight"), F.sum("frequency").alias("frequency"))


def simple_cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(cycle): all simple cycles of a directed graph (u, v), each once, from its smallest node on; of at most `longest` arcs if given.

    Nodes that no cycle can pass are peeled off first. Paths begin at a cycle's smallest node and never go below it; they
    grow by a join a step until none is left, so the tables are as large as the paths are many.
    """
    with_checkpoints(edges.sparkSession)
    arcs, n = edges.select("u", "v").distinct().checkpoint(), -1
    while (m := arcs.count()) != n:  # only arcs between nodes that are entered and left
        n = m
        arcs = arcs.join(arcs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(arcs.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v").checkpoint()
    out = arcs.where("u = v").select(F.array("u").alias("cycle"))
    paths, length = arcs.where("u < v").select(F.array("u", "v").alias("path")), 2
    while (longest is None or length <= longest) and not paths.isEmpty():
        step = paths.withColumn("u", F.element_at("path", -1)).join(arcs, "u").checkpoint()
        out = out.unionAll(step.where(F.col("v") == F.col("path")[0]).select(F.col("path").alias("cycle")))
        paths = step.where((F.col("v") > F.col("path")[0]) & ~F.array_contains("path", F.col("v"))).select(F.concat("path", F.array("v")).alias("path"))
        length += 1
    return out


# Numbers of chapters in words and Roman figures.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def chapter_label(number: Column, title: Column) -> Column:
    n = F.trim(number)
    word = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(n))
    roman = F.array_position(F.array(*map(F.lit, ROMAN)), F.upper(n))
    label = lambda x: F.concat(F.lit("Chapter "), x.cast("string"))
    return F.when(word > 0, label(word)).when(roman > 0, label(roman)).when(n.rlike(r"^\d+$"), label(n)).when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.concat(F.lit("Chapter "), number))


def human_size(n: Column) -> Column:
    out, size = None, n.cast("double")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        text = F.concat(F.format_string("%.1f", size / 1024**k), F.lit(f" {unit}"))
        out = F.when(size < 1024 ** (k + 1), text).otherwise(F.concat(F.format_string("%.1f", size / 1024**4), F.lit(" TB")) if out is None else out)
    return out


def first_json(text: str | None) -> str | None:
    """The first JSON object or array in a model's answer, mended where a comma trails or an end is missing; null if there is none."""
    found = re.search(r"[\[{]", text or "")
    if not found:
        return None
    body, depth, quoted, escaped = text[found.start() :], [], False, False
    end = len(body)
    for k, c in enumerate(body):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth.append("]" if c == "[" else "}")
        elif c in "]}":
            if depth:
                depth.pop()
            if not depth:
                end = k + 1
                break
    body = re.sub(r",\s*([\]}])", r"\1", body[:end] + '"' * quoted + "".join(reversed(depth)))
    try:
        return json.dumps(json.loads(body), sort_keys=True)
    except ValueError:
        return None


def json_of(text: str) -> Column:
    """first_json() as an Arrow-batched column."""
    return F.pandas_udf(lambda s: s.map(first_json).astype(object), "string")(text)


def table_stats(text: Column) -> Column:
    """Struct of the number of tables marked in a text, and characters in them."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)(\[TABLE \d+\]\n(?:[^\n]*\|[^\n]*\n?)+)"), F.lit(1))
    return F.struct(F.size(blocks).alias("tables"), F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b)).alias("chars"))
