"""SimHash near-duplicates by multi-index hashing.

fingerprints() makes a 64-bit SimHash of word shingles per document. near_fingerprints() links fingerprints within two
bits: each fingerprint is cut into segments, the ball of radius one is enumerated within every segment, and the table
is asked for each point of the ball together with the untouched segments. Two fingerprints within two bits have a
point in common, and points of one bucket are at most two bits apart, so a bucket's first fingerprint stands for all
its pairs: the number of links grows with the fingerprints and not with the square of a group of copies. Plain
segment tables would gather every fingerprint that shares a segment, which near copies by the thousand all do.

similar_documents() serves a similarity of word shingles, such as 0.8 over five words, which two bits of a SimHash
cannot: such texts differ in about ten of 64 bits. It links all texts whose fingerprints are within two bits, and besides
those that MinHash bands, alike at every table size, make candidates and whose whole sets decide by exact Jaccard similarity.

Defined results: null text counts as empty; texts without a word have fingerprint zero and are linked like any other;
rows that repeat get equal answers; an empty table gives no rows; other columns never meet internal names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BANDS, LANES, components, cut, discard, linked_components, merged, shared, sorted_distinct

SEED = 42
SHINGLE = 3
_random = random.Random(21)
MASKS = np.array([_random.getrandbits(64) for _ in range(LANES)], np.uint64)
#: Hashes of a text that are unpacked at once.
BLOCK = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Words without the six ASCII spaces, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than n: of the whole sequence; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    return np.array([digest(b" ".join(s), seed) for s in zip(*[words[k:] for k in range(n)], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[k : k + BLOCK].astype(">u8")).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(majority(shingle_hashes(words_of(t), shingle, seed))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, fp long")


def ball(value, bits: int, offset: int = 0) -> list:
    """The points within one bit of a long column in the `bits` bits from `offset`, without the centre."""
    masks = [1 << k for k in range(offset, offset + bits)]
    return [value.bitwiseXOR(F.lit(signed(m))) for m in masks]


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, such that fingerprints within two bits of each other are connected, and no others."""
    fp = F.col("fp")
    halves = [ball(fp, 32, 0), ball(fp, 32, 32)]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").repartition(parts, "fp").distinct()  # a number keeps the partitions apart: each row becomes 65
    keyed = distinct.select("fp", F.explode(F.array(fp, *halves[0], *halves[1])).alias("z"))
    # a point has at most 65 fingerprints; a join would broadcast a side, which Spark sizes as if nothing had been exploded
    met = keyed.withColumn("a", F.min("fp").over(Window.partitionBy("z")))
    return met.where("a < fp and bit_count(a ^ fp) <= 2").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable over links of two bits."""
    fps = cut(fingerprints(docs, shingle), "fingerprints", large=True)
    groups = components(near_fingerprints(fps)).hint("merge")  # tables of a row a fingerprint or group: none goes through the driver
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    own = own.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    own = cut(own, "groups")
    names = own.groupBy("comp").agg(F.min("least").alias("component_id")).hint("merge")
    return fps.join(own.join(names, "comp").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def distinct_hashes(text: str | None, shingle: int) -> np.ndarray:
    return sorted_distinct(shingle_hashes(words_of(text), shingle))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the low 16 bits of its MinHashes, four to a column; an empty set is one of its own."""
    every = np.concatenate([np.append(h, np.uint64(0)) if not len(h) else h for h in sets])
    edges = np.cumsum([0, *(max(1, len(h)) for h in sets[:-1])])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, mask in enumerate(MASKS):
        least = np.minimum.reduceat(every ^ mask, edges)
        out[:, k // 4] |= (least & np.uint64(0xFFFF)) << np.uint64(16 * (k % 4))
    return out.view(np.int64)


def signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, s0, ...) of each text (id, text), as linked_components() takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = min_hashes([distinct_hashes(t, shingle) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["id", *(f"s{k}" for k in range(BANDS))])

    return texts.select("id", "text").mapInArrow(run, ", ".join(["id long", *(f"s{k} long" for k in range(BANDS))]))


def jaccard(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of text ids whose sets of shingles have at least this similarity; texts without a word are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = distinct_hashes(x, shingle), distinct_hashes(y, shingle)
                both = len(shared(a, b))
                keep.append(both >= least * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def fingerprint_links(texts: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) of ids of texts (id, text) that connect all whose fingerprints are within two bits: texts of one fingerprint by its smallest id."""
    fps = cut(fingerprints(texts.select(F.col("id").alias("doc_id"), "text"), shingle), "fingerprints", large=True)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    same = fps.join(first, "fp").where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    of = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"id_{side}"))
    near = near_fingerprints(fps).join(of("a"), "a").join(of("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    links = cut(same.unionAll(near), "links", large=True)
    discard(fps)
    return links


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(id, comp) of the texts that are linked to another: id is xxhash64 of the text, comp the smallest linked id.

    Texts are linked by SimHash, whose links are complete, and by exact Jaccard similarity of those that linked_components() makes candidates.
    """
    text = F.coalesce("text", F.lit(""))
    texts = cut(docs.select(F.xxhash64(text).alias("id"), text.alias("text")).dropDuplicates(["id"]), "texts", bucket_by="id")
    links = fingerprint_links(texts, shingle)
    sigs = cut(signatures(texts, shingle), "signatures", bucket_by="id")
    found = linked_components(sigs, lambda pairs: jaccard(pairs, texts, shingle, least))
    discard(sigs)
    discard(texts)
    found = found if links.isEmpty() else merged(found, links)
    discard(links)
    return found.withColumnRenamed("node", "id")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs without those near-duplicate to a kept one: of each group the row of the smallest doc_id stays.

    Rows that repeat (same doc_id and text) count as one text; one of them stays. Rows without a doc_id come last.
    """
    names = docs.columns
    tagged = docs.withColumn("_df_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = similar_documents(docs, shingle, least)
    owners = (tagged.groupBy("_df_id").agg(F.min("doc_id").alias("_df_least"))
              .join(groups.select(F.col("id").alias("_df_id"), F.col("comp").alias("_df_comp")), "_df_id", "left")
              .withColumn("_df_comp", F.coalesce("_df_comp", "_df_id")))
    owners = cut(owners, "owners")
    best = owners.groupBy("_df_comp").agg(F.min("_df_least").alias("_df_best"))
    stay = owners.join(best, "_df_comp").where(F.col("_df_least").eqNullSafe(F.col("_df_best")))
    stay = stay.groupBy("_df_comp", F.col("_df_best")).agg(F.min("_df_id").alias("_df_id")).select("_df_id", "_df_best")
    rows = tagged.join(stay, "_df_id").where(F.col("doc_id").eqNullSafe(F.col("_df_best")))
    return rows.dropDuplicates(["_df_id"]).select(*[F.col(f"`{n}`") for n in names])
