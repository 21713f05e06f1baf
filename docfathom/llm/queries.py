"""The queries op1 to op13 over whole tables, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anomaly, automaton, compaction, decontam, importance, langid, licenses, lines, lm, packing, pii, quality, simhash
from .common import cut, documents, new_path, remainder


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(documents(spark, sf_dir))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_df_lines").cast("long").alias("n_lines"), F.size("_df_drop").cast("long").alias("n_dropped"),
                       F.array_join("_df_drop", ",").alias("dropped"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, model, ["doc_id"]).withColumnRenamed("_df_score", "score")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = cut(anomaly.measured(docs, []), "statistics", large=True)
    return anomaly.judged(stats, anomaly.fitted(stats, labels))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    model, width = lm.fit(docs.where(~held_out).select("text"))
    scored = lm.score(docs, model, width)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = automaton.decode(automaton.encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = importance.resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact_clicks(spark.read.parquet(f"{sf_dir}/clicks.parquet"), new_path(spark, "compacted"))


QUERIES = {
    "op1_lines": op1_lines,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_decontam": op5_decontam,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_rules": op9_rules,
    "op10_lm": op10_lm,
    "op11_automaton": op11_automaton,
    "op12_importance": op12_importance,
    "op13_compaction": op13_compaction,
}
ORACLES: dict[str, str] = {}
