"""Queries of ingest, text scalars and chunk quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest as I
from ..operators import telemetry as T
from .registry import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


def sqlist(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query("content_hash_dedupe", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hash(spark, sf):
    """X10"""
    return docs(spark, sf).groupBy(I.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))


@query("settings_hash", """SELECT doc_id, sha256('[{"key":"lang","value":"' || lang || '"},{"key":"source","value":"' || source || '"}]') AS hash FROM documents""")
def settings_hash(spark, sf):
    """X11: the hash of sorted settings"""
    settings = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return docs(spark, sf).select("doc_id", F.sha2(F.to_json(F.array_sort(F.map_entries(settings))), 256).alias("hash"))


@query("version_state", """WITH n AS (SELECT doc_id, sha256(text) AS hash FROM documents), s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'x' END AS hash, 1 + doc_id % 4 AS version FROM documents WHERE doc_id % 5 <> 0)
  SELECT doc_id, CASE WHEN s.version IS NULL THEN 'new' WHEN n.hash = s.hash THEN 'skip' ELSE 'update' END AS status, CASE WHEN n.hash = s.hash THEN s.version ELSE coalesce(s.version, 0) + 1 END AS version FROM n LEFT JOIN s USING (doc_id)""")
def version_state(spark, sf):
    """C09, W10"""
    new = docs(spark, sf).select("doc_id", I.content_hash(F.col("text")).alias("hash"))
    state = new.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise("x").alias("hash"), (1 + F.col("doc_id") % 4).alias("version"))
    return I.check_hash(new, state).select("doc_id", "status", "version")


@query("prune_versions", "SELECT l_orderkey AS doc_id, l_linenumber AS version, l_partkey FROM lineitem QUALIFY l_linenumber > max(l_linenumber) OVER (PARTITION BY l_orderkey) - 2")
def prune_versions(spark, sf):
    """The last two versions"""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("version"), "l_partkey")
    return I.prune(rows, 2)


@query("previous_version", "SELECT l_orderkey AS doc_id, max(l_partkey) AS part FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber = m - 1 GROUP BY 1")
def previous_version(spark, sf):
    """G28"""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("version"), "l_partkey")
    last = rows.groupBy("doc_id").agg((F.max("version") - 1).alias("version"))
    return rows.join(last, ["doc_id", "version"]).groupBy("doc_id").agg(F.max("l_partkey").alias("part"))


LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index, unnest(string_split(text, chr(10))) AS text FROM documents)"


def line_chunks(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))


@query("chunk_idempotency", f"""WITH {LINES}, n AS (SELECT doc_id, chunk_index, sha256(text) AS hash FROM lines), o AS (SELECT doc_id, chunk_index, hash FROM n WHERE chunk_index % 3 <> 0),
  a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY chunk_index) AS k FROM n), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY chunk_index) AS k FROM o)
  SELECT doc_id, count(*) AS fresh FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.hash = a.hash AND b.k = a.k) GROUP BY 1""")
def chunk_idempotency(spark, sf):
    """U04, C10"""
    new = line_chunks(spark, sf).withColumn("hash", I.content_hash(F.col("text"))).drop("text")
    return I.new_chunks(new, new.where("chunk_index % 3 <> 0")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("fresh"))


@query("merge_small_chunks", f"""WITH {LINES}, m AS (SELECT *, sum(CASE WHEN length(text) >= 100 OR contains(text, '[TABLE') OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS island
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS rn FROM lines))
  SELECT doc_id, min(chunk_index)::INT AS chunk_index, sha256(string_agg(text, chr(10) ORDER BY chunk_index)) AS hash, count(*)::INT AS parts FROM m GROUP BY doc_id, island""")
def merge_small(spark, sf):
    """C06"""
    return I.merge_small(line_chunks(spark, sf)).select("doc_id", "chunk_index", F.sha2("text", 256).alias("hash"), "parts")


FREQ = sqlist(X.FREQUENT_WORDS)
QUALITY = f"""w AS (SELECT doc_id, text, length(text) AS len, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS words FROM documents),
h AS (SELECT doc_id, -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) AS entropy FROM (SELECT doc_id, any_value(n) AS n, c, count(*) AS k FROM (SELECT doc_id, length(text) AS n, unnest(string_split(lower(text), '')) AS c FROM documents) GROUP BY doc_id, c) GROUP BY 1),
q AS (SELECT doc_id, len, len(words) AS n, len(list_filter(words, lambda x: list_contains([{FREQ}], x))) / nullif(len(words), 0)::DOUBLE AS ratio, {' + '.join(f"contains(lower(text), '{p}')::INT" for p in X.BOILERPLATE)} AS hits, entropy FROM w JOIN h USING (doc_id)),
r AS (SELECT *, CASE WHEN len < 100 THEN 'too_short' WHEN len > 2000 THEN 'too_long' WHEN n < 10 THEN 'too_few_words' WHEN ratio < 0.15 THEN 'low_stopword_ratio' WHEN hits >= 3 THEN 'boilerplate_detected' WHEN entropy < 3 THEN 'low_entropy' ELSE 'heuristic_pass' END AS reason FROM q)"""


@query("chunk_quality", f"""WITH {QUALITY} SELECT doc_id, reason = 'heuristic_pass' AS clean, reason, round(CASE reason WHEN 'too_short' THEN 0.2 WHEN 'too_long' THEN 0.3 WHEN 'too_few_words' THEN 0.3 WHEN 'low_stopword_ratio' THEN 0.4
  WHEN 'boilerplate_detected' THEN 0.3 WHEN 'low_entropy' THEN 0.5 ELSE least(0.95, 0.5 + 0.5 * ratio + (entropy - 3) / 10) END, 6) AS confidence FROM r""")
def chunk_quality(spark, sf):
    """C07, X41"""
    return I.chunk_quality(docs(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query("chunk_quality_reasons", f"WITH {QUALITY} SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM r GROUP BY 1")
def chunk_quality_reasons(spark, sf):
    """G35, C08"""
    all_rows = docs(spark, sf).agg(F.count(F.lit(1)).alias("all"))
    rows = I.chunk_quality(docs(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(all_rows)).select("reason", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("truncation_stats", """SELECT lang, count(*) AS n, count(*) FILTER (length(text) > 709) AS truncated, round(avg(CASE WHEN length(text) > 709 THEN 100.0 * (length(text) - 709) / length(text) END), 6) AS loss, sum(greatest(0, length(text) - 709))::BIGINT AS chars_lost FROM documents GROUP BY 1""")
def truncation_stats(spark, sf):
    """G27, X22"""
    n = F.length("text")
    return T.rollup(docs(spark, sf), ["lang"], n=F.count(F.lit(1)), truncated=F.count_if(n > 709), loss=F.round(F.avg(F.when(n > 709, 100.0 * (n - 709) / n)), 6), chars_lost=F.sum(F.greatest(F.lit(0), n - 709)))


@query("truncated_texts", """SELECT doc_id, length(CASE WHEN length(text) <= 709 THEN text WHEN instr(text[:709], ' ') > 0 AND 709 - instr(reverse(text[:709]), ' ') > 567.2 THEN text[:709 - instr(reverse(text[:709]), ' ')] ELSE text[:709] END) AS n FROM documents""")
def truncated_texts(spark, sf):
    """X22"""
    return docs(spark, sf).select("doc_id", F.length(X.truncate(F.col("text"), 709)).cast("long").alias("n"))


@query("doc_health", """WITH l AS (SELECT l_orderkey AS doc_id, count(*) AS total, count(*) FILTER (l_returnflag = 'N') AS valid, count(*) FILTER (l_returnflag = 'A') AS repaired, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_quantity > 40) AS truncated, avg(l_discount) AS loss FROM lineitem GROUP BY 1)
  SELECT doc_id, round(greatest(0, 0.4 * 75 + 30 * valid / total + 20 * (1 - failed / total) + 10 * (1 - repaired / total) - 10 * truncated / total * loss) + 1e-7, 3) AS health FROM l""")
def doc_health(spark, sf):
    """Lines of an order stand for chunks of a document"""
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    rows = T.rollup(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), ["doc_id"], total=F.count(F.lit(1)), valid=flag("N"), repaired=flag("A"), failed=flag("R"), truncated=F.count_if(F.col("l_quantity") > 40), loss=F.avg("l_discount"))
    return rows.select("doc_id", F.round(I.health(F.lit(75), *[F.col(c) for c in ("total", "valid", "repaired", "failed", "truncated", "loss")]) + 1e-7, 3).alias("health"))


@query("row_validation", """SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 20 THEN 'text' END, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 5 THEN 'words' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang' END) AS errors FROM documents""")
def row_validation(spark, sf):
    """F20"""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return I.validated(docs(spark, sf), {"text": F.length("text") >= 20, "words": words >= 5, "lang": F.col("lang").isin("en", "fr")}).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("collection_upsert", """WITH n AS (SELECT doc_id, 'new' AS text FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id + 1000000, 'new' FROM documents WHERE doc_id % 50 = 0)
  SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, md5(text) FROM n""")
def collection_upsert(spark, sf):
    """S05, S06, S07"""
    rows = docs(spark, sf).select("doc_id", "text")
    new = rows.where("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("text")).unionByName(rows.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("text")))
    return I.upsert(rows, new, "doc_id").select("doc_id", F.md5("text").alias("hash"))


@query("collection_log", """SELECT doc_id::VARCHAR AS id, md5(CASE WHEN lang = 'es' THEN 'new ' || text ELSE text END) AS hash FROM documents WHERE lang <> 'fr' OR source = 'src2'""", writes=True)
def collection_log(spark, sf):
    """A collection as a log of segments; an upsert and a delete write what they are given, and what is deleted can be put again"""
    from ..session import new_folder
    from ..sources.stores import Collections

    rows = docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.array().cast("array<float>").alias("embedding"), F.create_map(F.lit("source"), "source").alias("metadata"), "lang")
    store = Collections(spark, new_folder(spark, "collections"))
    store.create("chunks")
    store.add("chunks", rows)
    store.add("chunks", rows.where("lang = 'es'").withColumn("document", F.concat(F.lit("new "), "document")))
    store.delete("chunks", rows.where("lang = 'fr'"))
    store.add("chunks", rows.where("lang = 'fr' and metadata['source'] = 'src2'"))
    return store.rows("chunks").select("id", F.md5("document").alias("hash"))


@query("stream_ingest", """SELECT doc_id::VARCHAR AS doc_id, 1::BIGINT AS version, md5(text) AS hash FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id::VARCHAR, 2, md5('new ' || text) FROM documents WHERE lang = 'es' AND text IS NOT NULL""", writes=True)
def stream_ingest(spark, sf):
    """Documents as a stream of files; some come again as they were, some changed, and the last batch is run twice"""
    from ..session import new_folder
    from ..streaming.ingest import Library

    at = new_folder(spark, "library")
    rows = docs(spark, sf).select("doc_id", "text", "lang")
    library = Library(spark, f"{at}/store")
    again = rows.where("lang in ('es', 'fr')").withColumn("text", F.when(F.col("lang") == "es", F.concat(F.lit("new "), "text")).otherwise(F.col("text")))
    for part in (rows, again):
        part.drop("lang").write.mode("append").parquet(f"{at}/in")
        library.follow(spark.readStream.schema("doc_id long, text string").parquet(f"{at}/in"), f"{at}/marks").awaitTermination()
    library.ingest(again.withColumn("text", F.lit("lost batch")), library.log.marked("ingest"))
    return library.documents().select("doc_id", "version", F.md5("text").alias("hash"))


@query("collection_page", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND n_chars <= 2000 AND source <> 'src1' ORDER BY doc_id LIMIT 20 OFFSET 40")
def collection_page(spark, sf):
    """A compiled filter, in order"""
    from ..functions.filters import compiled

    where = {"$and": [{"lang": "en"}, {"n_chars": {"$lte": 2000}}, {"source": {"$ne": "src1"}}]}
    return docs(spark, sf).where(compiled(where)).select("doc_id", "lang").orderBy("doc_id").offset(40).limit(20)


@query("file_changes", """WITH a AS (SELECT 'f' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS hash FROM documents WHERE doc_id % 6 <> 0)
  SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash""")
def file_changes(spark, sf):
    """U07"""
    rows = docs(spark, sf).select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.md5("text").alias("hash"))
    after = rows.where("doc_id % 6 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("hash")))
    return I.file_changes(rows.where("doc_id % 7 <> 0"), after)


@query("redact", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+', '[REDACTED]', 'g'), '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', '[REDACTED]', 'g'), '\b(?:sk_|pk_|api_|token_|secret_)[a-zA-Z0-9+/=_-]{15,35}\b', '[REDACTED]', 'g')) AS hash FROM documents""")
def redact(spark, sf):
    """X24, X27; the tables hold no grouped cards, so SQL leaves Luhn out"""
    return docs(spark, sf).select("doc_id", F.md5(X.redact(F.col("text"))).alias("hash"))


@query("dlp_counts", rf"""SELECT doc_id, len(regexp_extract_all(text, '{X.EMAIL}')) AS emails, len(regexp_extract_all(text, '{X.AWS_KEY}')) AS aws_keys, len(regexp_extract_all(text, '{X.API_KEY}')) AS api_keys FROM documents WHERE contains(text, '@')""")
def dlp_counts(spark, sf):
    """X25"""
    n = lambda p: F.size(X.found(F.col("text"), p)).cast("long")
    return docs(spark, sf).where(F.col("text").contains("@")).select("doc_id", n(X.EMAIL).alias("emails"), n(X.AWS_KEY).alias("aws_keys"), n(X.API_KEY).alias("api_keys"))


@query("boilerplate_strip", r"""SELECT doc_id, md5(coalesce(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '(?i)^(copyright|all rights|licensed under|page \d+)') AND length(trim(x)) >= 5), 'string_agg', chr(10)), '')) AS hash FROM documents""")
def boilerplate(spark, sf):
    """X19, X20"""
    return docs(spark, sf).select("doc_id", F.md5(X.strip_lines(F.col("text"), r"(?i)^(copyright|all rights|licensed under|page \d+)", 5)).alias("hash"))


@query("clean_whitespace", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, chr(9), '    '), '[ ]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS hash FROM documents""")
def clean_whitespace(spark, sf):
    """X21"""
    return docs(spark, sf).select("doc_id", F.md5(X.clean_whitespace(F.col("text"))).alias("hash"))


@query("technical_entities")
def technical_entities(spark, sf):
    """DuckDB's word ends know ASCII only, so that a test holds this against plain patterns"""
    return docs(spark, sf).select("doc_id", F.array_join(X.entities(F.col("text")), ",").alias("entities"))


@query("content_flags", r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '```')) >= 2 THEN 'code' WHEN regexp_matches(text, '(?m)^\s*(?:\||[-*] |\d+\. )') THEN 'structured' WHEN contains(text, '`') THEN 'mixed' ELSE 'text' END AS kind, regexp_matches(text, 'https?://') AS has_link, contains(text, 'token') AS has_token,
  CASE WHEN regexp_matches(text, '```\w+') THEN regexp_extract(text, '```(\w+)', 1) WHEN NOT contains(text, '`') THEN NULL WHEN regexp_matches(text, 'def |import |class |self\.|print\(') THEN 'python'
  WHEN regexp_matches(text, 'const |let |var |function\(|=>|console\.log') THEN 'javascript' WHEN regexp_matches(upper(text), 'SELECT |FROM |WHERE |INSERT INTO') THEN 'sql' WHEN regexp_matches(text, '(?m)^\w+:\s*$') THEN 'yaml' END AS language FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '`import x`' ELSE text END AS text FROM documents)""")
def content_flags(spark, sf):
    """X18, X16"""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("`import x`"))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", X.content_type(t).alias("kind"), t.rlike("https?://").alias("has_link"), t.contains("token").alias("has_token"), X.code_language(t).alias("language"))


SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.?!]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query("readability", rf"""WITH w AS (SELECT doc_id, len({SENT}) AS s, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}''-]+') AS words FROM documents),
  y AS (SELECT doc_id, s, len(words) AS n, list_sum(list_transform(words, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS syl, len(list_filter(words, lambda x: length(x) >= 12)) AS long FROM w),
  f AS (SELECT *, CASE WHEN s = 0 OR n = 0 THEN 0 ELSE greatest(0, least(100, 206.835 - 1.015 * n / s - 84.6 * syl / n)) END AS flesch FROM y)
  SELECT doc_id, round(flesch, 6) AS flesch, round(long / nullif(n, 0)::DOUBLE, 6) AS jargon, CASE WHEN flesch >= 90 THEN '5th grade' WHEN flesch >= 80 THEN '6th grade' WHEN flesch >= 70 THEN '7th grade' WHEN flesch >= 60 THEN '8th-9th grade' WHEN flesch >= 50 THEN '10th-12th grade' WHEN flesch >= 30 THEN 'undergraduate' ELSE 'postgraduate' END AS level FROM f""")
def readability(spark, sf):
    """X05, X06, X42, X43, X45, A15"""
    rows = docs(spark, sf).select("doc_id", F.size(X.sentences(F.col("text"))).alias("s"), X.words(F.col("text")).alias("w"))
    syl = F.aggregate(F.transform("w", X.syllables), F.lit(0), lambda a, b: a + b)
    score = X.flesch(F.col("s"), F.col("n"), F.col("syl"))
    rows = rows.select("doc_id", "s", F.size("w").alias("n"), syl.alias("syl"), F.size(F.filter("w", lambda w: F.length(w) >= 12)).alias("long"))
    return rows.select("doc_id", F.round(score, 6).alias("flesch"), F.round(F.try_divide(F.col("long"), F.col("n")), 6).alias("jargon"), X.education_level(score).alias("level"))


@query("passive_ratio", rf"""WITH s AS (SELECT doc_id, unnest({SENT}) AS s FROM documents), w AS (SELECT doc_id, regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}''-]+') AS w FROM s),
  p AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: list_contains([{sqlist(X.BE_VERBS)}], w[i]) AND (w[i + 1] LIKE '%ed' OR list_contains(['known', 'shown', 'seen'], w[i + 1])))) > 0 AS passive FROM w)
  SELECT doc_id, round(avg(passive::INT), 6) AS ratio FROM p GROUP BY 1""")
def passive_ratio(spark, sf):
    """X44"""
    s = docs(spark, sf).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.round(F.avg(X.passive(F.col("s")).cast("int")), 6).alias("ratio"))


@query("entropy", "SELECT doc_id, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 6) AS entropy FROM (SELECT doc_id, any_value(n) AS n, c, count(*) AS k FROM (SELECT doc_id, length(text) AS n, unnest(string_split(lower(text), '')) AS c FROM documents) GROUP BY doc_id, c) GROUP BY 1")
def entropy(spark, sf):
    """X41"""
    return I.entropy(docs(spark, sf), "doc_id", "text").withColumn("entropy", F.round("entropy", 6))


@query("doi_year_extract", r"""SELECT doc_id, nullif(regexp_extract(text || ' doi 10.1234/AB.' || doc_id || ' of 19' || lpad((doc_id % 100)::VARCHAR, 2, '0'), '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'), '') AS doi, try_cast(nullif(regexp_extract(' doi 10.1234/AB.' || doc_id || ' of 19' || lpad((doc_id % 100)::VARCHAR, 2, '0'), '\b(19\d{2}|20\d{2})\b', 1), '') AS INT) AS year FROM documents""")
def doi_year(spark, sf):
    """X29, X31, X13"""
    cited = F.concat(F.lit(" doi 10.1234/AB."), "doc_id", F.lit(" of 19"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"))
    none = lambda c: F.nullif(c, F.lit(""))
    return docs(spark, sf).select("doc_id", none(F.regexp_extract(F.concat("text", cited), X.DOI, 0)).alias("doi"), none(F.regexp_extract(cited, r"\b(19\d{2}|20\d{2})\b", 1)).cast("int").alias("year"))
