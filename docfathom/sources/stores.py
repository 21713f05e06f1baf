"""Stores on a shared folder: collections of chunks, the keyword index, graph and citation tables, caches by settings.

Collections and the keyword index are logs of segments (sources.segments): a put or delete writes what it is given alone. The others are
folders of versions published by files.publish(). Either way a reader sees a whole version and a writer that is lost leaves the last one.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import keyword as K
from .files import current, publish, published
from .segments import Segments, Table

COLLECTION = "id string, document string, embedding array<float>, metadata map<string,string>"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Collections:
    """Named collections of rows (id, document, embedding, metadata) below a folder, each a log of segments."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self) -> list[str]:
        fs, where = _fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def log(self, name: str) -> Segments:
        return Segments(self.spark, f"{self.root}/{name}", "id", {"rows": Table()})

    def create(self, name: str) -> None:
        if name not in self.names():
            self.log(name).build({"rows": self.spark.createDataFrame([], COLLECTION)})

    def rows(self, name: str) -> DataFrame:
        found = self.log(name).read("rows")
        if found is None:
            raise FileNotFoundError(f"no collection {name}")
        return found

    def count(self, name: str) -> int:
        return self.rows(name).count()

    def drop(self, name: str) -> None:
        fs, where = _fs(self.spark, f"{self.root}/{name}")
        fs.delete(where, True)

    def add(self, name: str, rows: DataFrame, batch_rows: int = 100_000) -> None:
        """Upsert by id, in files of at most batch_rows rows; only the rows given are written. Of rows of one id the greatest stays, by document, embedding and metadata."""
        order = [F.desc("document"), F.desc("embedding"), F.desc(F.array_sort(F.map_entries("metadata")))]
        one = F.row_number().over(Window.partitionBy("id").orderBy(*order))
        rows = rows.select("id", "document", "embedding", "metadata").withColumn("_n", one).where("_n = 1").drop("_n")
        self.log(name).write({"rows": rows}, rows.select("id"), batch_rows)

    def delete(self, name: str, ids: DataFrame) -> None:
        """Only the ids are written."""
        self.log(name).delete(ids.select("id"))

    def compact(self, name: str) -> None:
        self.log(name).compact()

    def state(self) -> DataFrame:
        """(name, rows) of every collection."""
        return self.spark.createDataFrame([(n, self.count(n)) for n in self.names()], "name string, rows long")

    def clear(self, dry_run: bool = False) -> list[str]:
        """Drop all collections; with dry_run only say which."""
        names = self.names()
        for name in [] if dry_run else names:
            self.drop(name)
        return names


def versioned_documents(rows: DataFrame, health: str = "health_score double, valid_chunks int") -> DataFrame:
    """Documents of a collection (id, document, embedding, metadata) with their version, type and health: the type is code where a language is named, else unknown."""
    meta = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    kind = F.coalesce(meta("doc_type"), F.when(meta("language").isNotNull(), "code"), F.lit("unknown"))
    return rows.select("id", meta("doc_id").alias("doc_id"), F.coalesce(meta("version").try_cast("int"), F.lit(1)).alias("version"), kind.alias("doc_type"), F.from_json(meta("health"), health).alias("health"), "embedding")


class KeywordIndex:
    """A persisted keyword index: blocks of postings in PARTS folders by the hash of the term, and lengths of documents, as a log of segments.

    A search bounds each window of documents by the most that each of its terms adds there, without looking at documents, scores the windows of the
    highest bounds, and then those alone whose bound
    reaches the k-th best score found: documents of other windows can't be among the k best. It tokenises nothing but the query.
    """

    PARTS = 64
    #: Documents of a window, and windows of documents that a task counts the tokens of.
    WINDOW, TASK = 64, 64
    #: Terms of all queries of a search, which are collected.
    MOST_TERMS = 100_000

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        lengths = Table(facts={"tokens": F.sum("doc_length")})
        self.log = Segments(spark, root, "doc_id", {"postings": Table(lambda df: df, K.unblocked, ("part",)), "lengths": lengths})

    @staticmethod
    def part(term):
        return F.pmod(F.xxhash64(term), F.lit(KeywordIndex.PARTS)).cast("int")

    def _tables(self, docs: DataFrame, text: str, key: str) -> dict[str, DataFrame]:
        docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        windows = -(-docs.count() // self.WINDOW)
        # texts are shuffled by document, in tasks of a bounded number of them, and their tokens are counted where they are
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-windows // self.TASK))
        texts = docs.where("text is not null").repartition(tasks, "doc_id")
        lengths = docs.groupBy("doc_id").agg(F.sum(F.size(K.tokens(F.coalesce("text", F.lit(""))))).alias("doc_length"))
        return {"postings": self._blocks(K.text_postings(texts), windows), "lengths": lengths}

    def _blocks(self, post: DataFrame, windows: int) -> DataFrame:
        return K.blocks(post, windows, self.part("term"), self.PARTS)

    def build(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> None:
        self.log.build(self._tables(docs, text, key))

    def put(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> None:
        """Index documents, in place of those with their ids; only theirs is written."""
        self.log.write(self._tables(docs, text, key), docs.select(F.col(key).alias("doc_id")))

    def delete(self, ids: DataFrame) -> None:
        """Only the ids are written."""
        self.log.delete(ids.select("doc_id"))

    def compact(self) -> None:
        """Rewrite all segments as one. Blocks are made anew, so windows fit the documents there are."""
        post, lengths = self.log.read("postings"), self.log.read("lengths")
        if post is not None:
            windows = -(-lengths.count() // self.WINDOW)
            self.log.build({"postings": self._blocks(post.select("doc_id", "term", "tf", "doc_length"), windows), "lengths": lengths})

    def _of(self, terms: list[str]):
        """Keeps the blocks of terms: their folders, then their rows."""
        parts = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self.part("t")).collect()}) if terms else []
        return lambda rows: rows.where(F.col("part").isin(parts) & F.col("term").isin(terms))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self.log.read("postings", self._of(terms) if terms is not None else None)
        return rows.select("doc_id", "term", "tf", "doc_length")

    def lengths(self) -> DataFrame:
        return self.log.read("lengths")

    def stats(self, live: list[dict] | None = None) -> tuple[int, float]:
        """Number and mean length of the documents: as the manifest says where no segment hides rows of another."""
        live = self.log.segments() if live is None else live
        if len(live) == 1 and "lengths" in live[0]["tables"]:
            facts = live[0]["tables"]["lengths"]["facts"]
            n, tokens = facts["rows"], facts["tokens"] or 0
            return n, tokens / n if n else 0.0
        row = self.log.read("lengths", live=live).agg(F.count(F.lit(1)), F.avg("doc_length")).first()
        return row[0], row[1] or 0.0

    def term_stats(self, terms: list[str] | None = None) -> DataFrame:
        live = self.log.segments()
        if self.log.hidden(live) is None:  # all documents of all blocks are there
            return K.block_stats(self.log.raw("postings", live, self._of(terms) if terms is not None else None), self.stats(live)[0])
        return K.term_stats(self.postings(terms), self.stats(live)[0])

    def search(self, queries: DataFrame, k: int, floor: float | None = K.EPSILON) -> DataFrame:
        """(query_id, doc_id, score, rank) of rows (query_id, query), a bounded list: the k best documents of each, ties by doc_id."""
        return self._search(queries, k, floor)[0]

    def work(self, queries: DataFrame, k: int, floor: float | None = K.EPSILON) -> DataFrame:
        """(query_id, postings, scored): postings of a query's terms, and those of them that a search scores."""
        return self._search(queries, k, floor)[1]

    def _search(self, queries: DataFrame, k: int, floor: float | None) -> tuple[DataFrame, DataFrame]:
        asked = K.query_terms(queries).limit(self.MOST_TERMS + 1).collect()
        if len(asked) > self.MOST_TERMS:
            raise ValueError("more terms than a search takes; ask in parts")
        wanted, live = sorted({r.term for r in asked}), self.log.segments()
        of, hidden = self._of(wanted), self.log.hidden(live)
        n, mean = self.stats(live)
        rows = self.log.raw("postings", live, of)
        if hidden is None:
            df = rows.groupBy("term").agg(F.sum("n").alias("df"))
        else:  # documents of a block can be hidden
            seen = self.log.visible(rows.select("term", "_seg", F.explode("doc_id").alias("doc_id")), hidden)
            df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        found = {r.term: r.df for r in df.collect()}
        weights = self.spark.createDataFrame([(r.query_id, r.term, r.times, found[r.term]) for r in asked if r.term in found], "query_id long, term string, times long, df long")
        avg = F.lit(mean or 1.0)
        weights = F.broadcast(weights.select("query_id", "term", (K.idf(F.lit(n), F.col("df"), floor) * F.col("times")).alias("weight")))
        value = F.col("weight") * K.term_weight(F.col("tf"), F.col("doc_length"), avg)
        held = K.unblocked(rows.select("term", "_seg", "n", "window", "tf", "doc_length"), ("window", "tf", "doc_length")).join(weights, "term")
        most = held.groupBy("query_id", "term", "_seg", "window").agg(F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))
        tops = most.groupBy("query_id", "_seg", "window").agg(F.sum("most").alias("most"), F.sum("n").alias("n")).persist()

        def scored(windows: DataFrame) -> DataFrame:
            there = K.unblocked(rows).join(windows.select("query_id", "_seg", "window"), ["_seg", "window"]).join(weights, ["query_id", "term"])
            post = self.log.visible(there, hidden)
            return post.groupBy("query_id", "doc_id").agg(F.sum(value).alias("score"))

        first = K.top(tops, ["query_id"], [F.desc("most"), F.asc("_seg"), F.asc("window")], k)
        best = K.top(scored(first), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
        least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        # a bound is a sum in another order than a score, so a hair's breadth is left
        able = tops.join(F.broadcast(least), "query_id", "left").where("least is null or most >= least * (1 - 1e-9)")
        result = K.top(scored(able), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
        work = tops.groupBy("query_id").agg(F.sum("n").alias("postings")).join(able.groupBy("query_id").agg(F.sum("n").alias("scored")), "query_id", "left")
        return result, work


def write_graph(root: str, nodes: DataFrame, edges: DataFrame, clusters: DataFrame, metadata: dict[str, str]) -> str:
    """Publish a graph's tables: nodes (node, ...), edges (a, b, ...) with a < b, clusters (node, cluster), metadata as key and value."""
    ordered = edges.withColumn("_b", F.greatest("a", "b")).withColumn("a", F.least("a", "b")).withColumn("b", F.col("_b")).drop("_b").where("a < b")
    facts = nodes.sparkSession.createDataFrame(sorted(metadata.items()) or [("", "")], "key string, value string").where("key <> ''")
    return publish({"nodes": nodes, "edges": ordered, "clusters": clusters, "metadata": facts}, root)


def node_page(nodes: DataFrame, page: int, size: int) -> DataFrame:
    return nodes.orderBy("node").offset(page * size).limit(size)


def edges_directed(edges: DataFrame) -> DataFrame:
    """(source, target, ...): both directions of each edge."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("source"), F.col("b").alias("target"), *rest).unionByName(edges.select(F.col("b").alias("source"), F.col("a").alias("target"), *rest))


def write_citations(root: str, nodes: DataFrame, edges: DataFrame) -> str:
    """Publish a citation graph and its JSON form: node rows and edge rows, each once, first ones winning."""
    nodes, edges = nodes.dropDuplicates(["node_id"]), edges.dropDuplicates(["source", "target"])
    version = publish({"nodes": nodes, "edges": edges}, root)
    nodes.write.json(f"{root}/{version}/json/nodes")
    edges.write.json(f"{root}/{version}/json/edges")
    return version


def cited_by(nodes: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """The distinct nodes that a document cites."""
    return edges.where((F.col("source") == source) & (F.col("relation") == "cites")).join(nodes, F.col("target") == F.col("node_id")).select(*[F.col(c) for c in nodes.columns]).distinct()


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


class GraphCache:
    """Graphs by the settings they were built with."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, settings: dict) -> str:
        return f"{self.root}/{settings_hash(settings)}"

    def put(self, settings: dict, nodes: DataFrame, edges: DataFrame) -> None:
        publish({"nodes": nodes, "edges": edges}, self.path(settings))

    def get(self, settings: dict) -> tuple[DataFrame, DataFrame] | None:
        if current(self.spark, self.path(settings)) is None:
            return None
        return tuple(published(self.spark, self.path(settings), name) for name in ("nodes", "edges"))

    def purge(self, keep: int = 0) -> int:
        """Delete all but the `keep` newest graphs; says how many went."""
        fs, where = _fs(self.spark, self.root)
        found = sorted(fs.listStatus(where), key=lambda s: -s.getModificationTime()) if fs.exists(where) else []
        for status in found[keep:]:
            fs.delete(status.getPath(), True)
        return len(found[keep:])


def results_csv(rows: DataFrame, path: str) -> None:
    """A results table in one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def url_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a JSON list of seeds; those without an address are left out."""
    return spark.read.schema("name string, url string").option("multiLine", True).json(path).where("url is not null and url <> ''")


def is_redirect_page(html):
    """Whether a downloaded page only sends its reader on."""
    low = F.lower(html)
    return (F.length(html) < 5000) & low.rlike(r"""http-equiv=["']?refresh|window\.location|document\.location|you are being redirected|click here if you are not redirected""")


def benchmark_report(stats: DataFrame) -> DataFrame:
    """One row with a Markdown report of rows (model, queries, seconds, tokens, rating)."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "model", F.col("queries").cast("string"), F.format_string("%.2f", "seconds"), F.format_string("%.1f", "tokens"), F.format_string("%.2f", "rating")), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model", line.alias("line")))), lambda r: r["line"]), "\n")
    head = F.lit("# Benchmark report\n\n| model | queries | seconds | tokens | rating |\n|---|---|---|---|---|\n")
    return stats.agg(F.concat(head, rows).alias("report"))
