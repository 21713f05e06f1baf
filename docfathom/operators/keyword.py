"""Keyword search: postings, corpus statistics, BM25, counts and word frequencies.

Postings are one row per (term, doc_id), made by a map and one aggregation; searches join them with the terms of a
batch of queries, so a batch costs one pass over the postings of its terms. Query sets are bounded lists and are
broadcast only as such; a table of queries joins by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import with_checkpoints

K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_QUERIES = 1000
#: Terms that are looked for token by token; more of them join as rows.
MAX_TERMS = 2000
#: Postings of a row of an index, windows of documents for each share of a part, and windows of a term that go to one task.
BLOCK, SHARE, SPAN = 1024, 4096, 16384


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id", toks=tokens) -> DataFrame:
    """(doc_id, term, tf, doc_length): tf counts the term, doc_length all tokens of the document."""
    rows = docs.select(F.col(key).alias("doc_id"), toks(F.col(text)).alias("t")).select("doc_id", F.size("t").alias("doc_length"), F.explode_outer("t").alias("term"))
    # explode() would have texts without a token left out before, by tokenising all texts once more
    return rows.where("term is not null").groupBy("doc_id", "term", "doc_length").agg(F.count(F.lit(1)).alias("tf"))


def text_postings(docs: DataFrame, text: str = "text", key: str = "doc_id", toks=tokens) -> DataFrame:
    """postings() counted where the texts are, with no shuffle: those of rows that repeat are not added up."""
    rows = docs.select(F.col(key).alias("doc_id"), toks(F.col(text)).alias("t"))
    return rows.mapInArrow(_counted, f"doc_id {dict(rows.dtypes)['doc_id']}, term string, tf bigint, doc_length int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int32)
        coded = batch.column(1).flatten().dictionary_encode()
        if len(coded):
            words = len(coded.dictionary)
            found, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * words + coded.indices.to_numpy(), return_counts=True)
            for at in range(0, len(found), 1 << 16):
                doc, word = np.divmod(found[at : at + (1 << 16)], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), coded.dictionary.take(pa.array(word)), pa.array(tf[at : at + (1 << 16)]), pa.array(sizes[doc])], names=["doc_id", "term", "tf", "doc_length"])


def corpus_stats(docs: DataFrame, text: str = "text", toks=tokens) -> DataFrame:
    """One row: n_docs, avg_length, over documents with a token or not."""
    return docs.select(F.size(toks(F.coalesce(text, F.lit("")))).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_length"))


def idf(n_docs: Column, df: Column, floor: float | None = EPSILON) -> Column:
    value = F.ln((n_docs - df + 0.5) / (df + 0.5) + 1)
    return value if floor is None else F.greatest(F.lit(floor), value)


def term_stats(post: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, occurrences, idf), idf as stored: without a floor."""
    return with_idf(post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")), n_docs)


def block_stats(rows: DataFrame, n_docs: int) -> DataFrame:
    """term_stats() of blocks, which are not taken apart."""
    held = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)
    return with_idf(rows.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"), F.sum(held).alias("occurrences")), n_docs)


def with_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    return counts.withColumn("idf", idf(F.lit(n_docs), F.col("df"), None))


def query_terms(queries: DataFrame, toks=tokens) -> DataFrame:
    """(query_id, term, times) of rows (query_id, query); a term that repeats counts as often as it is there."""
    return queries.select("query_id", F.explode(toks(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def literal_queries(spark, texts: list[str]) -> DataFrame:
    if len(texts) > MAX_QUERIES:
        raise ValueError("a list of queries is bounded; use a table")
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def matched_postings(docs: DataFrame, terms: DataFrame, toks=tokens) -> DataFrame:
    """(doc_id, term, tf, doc_length) of the terms (term) alone, and a row of the empty term for each document, so that one pass over
    the texts gives the counts of the corpus too. Up to MAX_TERMS terms are looked for before tokens become rows."""
    known = [r.term for r in terms.limit(MAX_TERMS + 1).collect()]
    rows = docs.select("doc_id", toks(F.coalesce("text", F.lit(""))).alias("t"))
    held = F.filter("t", lambda x: x.isin(known)) if len(known) <= MAX_TERMS else F.col("t")
    rows = rows.select("doc_id", F.size("t").alias("doc_length"), F.explode(F.concat(F.array(F.lit("")), held)).alias("term"))
    if len(known) > MAX_TERMS:
        rows = rows.join(terms.unionAll(terms.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi")
    return rows.groupBy("doc_id", "term", "doc_length").agg(F.count(F.lit(1)).alias("tf"))


def ranked(post: DataFrame, terms: DataFrame, n_docs: Column, avg_length: Column, k: int, floor: float | None) -> DataFrame:
    """(query_id, doc_id, score, rank) of postings and query terms (query_id, term, times): the k best documents of each query, ties by doc_id."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = post.join(df.join(terms, "term"), "term")
    weight = idf(n_docs, F.col("df"), floor) * term_weight(F.col("tf"), F.col("doc_length"), avg_length)
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("times")).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def window_of(key: str, windows: int) -> Column:
    """A window is the documents of one hash."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, windows))).cast("int")


def blocks(post: DataFrame, windows: int, part: Column, parts: int) -> DataFrame:
    """Postings laid out in rows of up to BLOCK postings of a term, in the order of their windows and documents: (part, term, n, window, doc_id, tf, doc_length),
    the last four arrays. Most terms are rare, so that they take one row and not one a window.

    Postings are shuffled once. A task gets those of some terms of one of the `parts` parts (`part`, a column of numbers from 0), and of a term no more than
    SPAN windows, so none is too frequent for it.
    """
    windows = max(1, windows)
    shares = -(-windows // SHARE)
    rows = post.select("term", window_of("doc_id", windows).alias("window"), "doc_id", F.col("doc_length").cast("int").alias("doc_length"), F.col("tf").cast("long").alias("tf"))
    share = F.pmod(F.xxhash64("term", F.lit(1)) + F.floor(F.col("window") / SPAN), F.lit(shares)).cast("int")
    tasks = min(parts * shares, windows)  # few documents need few
    held = rows.repartitionById(tasks, F.pmod(part.cast("int") * shares + share, F.lit(tasks)).cast("int")).sortWithinPartitions("term", "window", "doc_id", "doc_length")
    schema = f"term string, n int, window array<int>, doc_id array<{dict(post.dtypes)['doc_id']}>, doc_length array<int>, tf array<bigint>"
    return held.mapInArrow(_grouped, schema).withColumn("part", part.cast("int")).sortWithinPartitions("part", "term")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in blocks; those of the last block, which the next batch may go on with, are held back."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        if rows.num_rows:
            rows = _merged(rows)
            first = _firsts(rows)
            if first[-1]:
                yield _block_rows(rows.slice(0, first[-1]), first[:-1])
            rest = rows.slice(first[-1]).combine_chunks().to_batches()[0]
    if rest is not None:
        yield _block_rows(pa.Table.from_batches([rest]), np.zeros(1, np.int64))


def _new(column: pa.ChunkedArray) -> np.ndarray:
    """Which rows differ from those before."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), False, pc.fill_null(pc.not_equal(a, b), True))
    return np.append(True, differs.to_numpy()).astype(bool)


def _merged(rows: pa.Table) -> pa.Table:
    """Rows of equal term, document and length, as of documents that repeat, are one."""
    first = np.flatnonzero(_new(rows.column("doc_id")) | _new(rows.column("doc_length")) | _new(rows.column("term")))
    if len(first) == rows.num_rows:
        return rows
    tf = np.add.reduceat(rows.column("tf").to_numpy(), first)
    return rows.take(pa.array(first)).set_column(rows.schema.get_field_index("tf"), "tf", pa.array(tf)).combine_chunks()


def _firsts(rows: pa.Table) -> np.ndarray:
    """Where blocks begin: at a new term, and after BLOCK rows of one."""
    runs, n = np.flatnonzero(_new(rows.column("term"))), rows.num_rows
    inside = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
    return np.flatnonzero(inside % BLOCK == 0)


def _block_rows(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    rows, ends = rows.combine_chunks(), np.append(first, rows.num_rows)
    terms, at = rows.column("term").take(pa.array(first)).combine_chunks(), pa.array(ends, pa.int32())
    columns = {"term": terms, "n": pa.array(np.diff(ends), pa.int32())} | {c: pa.ListArray.from_arrays(at, rows.column(c).chunk(0)) for c in ("window", "doc_id", "doc_length", "tf")}
    return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))


def unblocked(rows: DataFrame, columns: tuple[str, ...] = ("window", "doc_id", "tf", "doc_length")) -> DataFrame:
    """Blocks as postings, with some or all of `columns`, and the other columns of the blocks."""
    arrays = ("window", "doc_id", "tf", "doc_length")
    zipped = rows.withColumn("_p", F.explode_outer(F.arrays_zip(*columns))).drop(*arrays, "n")
    return zipped.withColumns({c: F.col(f"_p.{c}") for c in columns}).drop("_p")


def term_weight(tf: Column, length: Column, avg_length: Column) -> Column:
    """What a term's frequency adds to a score, for each unit of idf: more for a higher tf, less for a longer document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def bm25(docs: DataFrame, queries: DataFrame, k: int, floor: float | None = EPSILON, toks=tokens) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, ties by doc_id.

    The texts are read and tokenised once; the postings of the queries' terms are checkpointed and give all counts. A
    persisted index (sources.stores.KeywordIndex) saves that pass too.
    """
    return bm25_terms(docs, query_terms(queries, toks), k, floor, toks)


def bm25_terms(docs: DataFrame, terms: DataFrame, k: int, floor: float | None = EPSILON, toks=tokens) -> DataFrame:
    """bm25() of queries given as weighted terms (query_id, term, times)."""
    with_checkpoints(docs.sparkSession)
    post = matched_postings(docs, terms.select("term").distinct(), toks).checkpoint()
    n, mean = post.where("term = ''").agg(F.count(F.lit(1)), F.avg("doc_length")).first()
    return ranked(post.where("term <> ''"), terms, F.lit(n), F.lit(mean or 1.0), k, floor)


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def tf_fallback(docs: DataFrame, query: str, k: int) -> DataFrame:
    """(doc_id, score, distance): occurrences of the query's words of over two characters as substrings, k best."""
    keys = list(dict.fromkeys(w for w in query.lower().split() if len(w) > 2))
    low = F.lower("text")
    hits = sum((((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)) for w in keys), F.lit(0.0))
    best = docs.select("doc_id", hits.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("distance", 0.9 - 0.6 * F.col("score") / F.max("score").over(Window.partitionBy(F.lit(0))))


def docs_for_all(post: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of documents that hold every term."""
    return post.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(terms))).select("doc_id")


def by_category(post: DataFrame, meta: DataFrame, term: str, n: int) -> DataFrame:
    """Documents of a term by category in lower case, missing ones as unknown: the n most frequent."""
    rows = post.where(F.col("term") == term).join(meta, "doc_id")
    return (rows.groupBy(F.lower(F.coalesce("source_category", F.lit("unknown"))).alias("category")).agg(F.count_distinct("doc_id").alias("docs"))
            .orderBy(F.desc("docs"), "category").limit(n))


def parent_counts(post: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """(term, parents): distinct parent documents of a term's chunks; a chunk without a parent is its own."""
    whole = post.join(chunks.select(F.col("chunk_id").alias("doc_id"), "parent_id"), "doc_id", "left").withColumn("doc", F.coalesce("parent_id", "doc_id"))
    return whole.join(meta.select(F.col("doc_id").alias("doc")), "doc").groupBy("term").agg(F.count_distinct("doc").alias("parents"))


def word_frequency(docs: DataFrame, toks=tokens) -> DataFrame:
    """(word, frequency, doc_count) of words with an ASCII letter."""
    rows = docs.select("doc_id", F.explode(toks(F.col("text"))).alias("word")).where(F.col("word").rlike("[a-z]"))
    per_doc = rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("doc_count"))
