"""Terminology and query expansion."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, ngrams, query_tokens
from ..session import cut
from .keyword import EPSILON, K1

STOPS = frozenset(STOP_WORDS)

MIN_FREQUENCY, MOST_TERMS, LONGEST = 2, 500, 4
# Parts of addresses, and words that tell a term's type.
ADDRESS = r"\.com|\.org|\.edu|\.net|\.gov|http|www"
TYPES = (("method", "method|algorithm|approach|technique|analysis"), ("tool", "tool|software|framework|library|platform"), ("dataset", "dataset|corpus|database|collection"), ("metric", "metric|score|measure|accuracy|rate"))
#: A text is its own corpus of one document: a word's rank weight there, as keyword search floors it.
ONE_DOCUMENT_IDF = max(EPSILON, math.log((1 - 1 + 0.5) / (1 + 0.5) + 1))
TOKENS = re.compile(r"\w+")
EXTRACTED = "term string, words int, frequency long, bm25 double, relevance double, tf_idf double"


def term_type(term: Column) -> Column:
    out = F.lit("concept")
    for name, pattern in reversed(TYPES):
        out = F.when(term.rlike(pattern), name).otherwise(out)
    return out


def plausible(word: str) -> bool:
    """Of four ASCII letters or more, a quarter to 65 in 100 are vowels."""
    letters = sum("a" <= c <= "z" for c in word)
    return letters < 4 or 0.25 <= sum(c in "aeiou" for c in word) / letters <= 0.65


def counted_terms(text: str, least: int = 1) -> Counter:
    """Runs of one to LONGEST words and how often each is there: stop words are left out before runs are made, and runs with an implausible word after,
    or with a word that is there less than `least` times."""
    toks = [t for t in TOKENS.findall(text.lower()) if len(t) >= 2 and "a" <= t[0] <= "z" and t not in STOPS]
    held = Counter(toks)
    fine = {t for t, f in held.items() if f >= least and plausible(t) and not re.search(ADDRESS, t)}
    out = Counter({t: held[t] for t in fine if len(t) >= 3})
    run: list[str] = []
    for t in [*toks, ""]:
        if t in fine:
            run.append(t)
            continue
        if len(run) > 1:
            for n in range(2, LONGEST + 1):
                out.update(map(" ".join, zip(*[run[k:] for k in range(n)], strict=False)))
        run = []
    return out


def scored_terms(text: str, least: int = MIN_FREQUENCY, most: int = MOST_TERMS) -> list[tuple]:
    """(term, words, frequency, bm25, relevance, tf_idf) of a text's terms, the `most` frequent ones, equal ones by name.

    A term counts that is there `least` times, or a phrase all of whose words are frequent. Relevance is 0.85 of the
    frequency against the most frequent term and 0.15 of the keyword rank, less for long terms and for words that phrases
    hold, more for phrases. The keyword rank is that of a search for the term among the text's own terms, each there up to
    three times.
    """
    found = counted_terms(text, least)  # a term that counts has no rarer word
    common = {t for t, f in found.items() if " " not in t and f >= max(3, least)}
    kept = {t: f for t, f in found.items() if f >= least or " " in t and all(w in common for w in t.split(" "))}
    if not kept:
        return []
    tf: Counter = Counter()
    inside: dict[str, int] = {}
    for term, f in kept.items():
        words = term.split(" ")
        for w in words:
            tf[w] += min(f, 3)
            if len(words) > 1:
                inside[w] = max(inside.get(w, 0), f)
    rank = {t: sum(ONE_DOCUMENT_IDF * tf[w] * (K1 + 1) / (tf[w] + K1) for w in t.split(" ")) for t in kept}
    best, top, total = max(0.1, max(rank.values())), max(kept.values()), sum(kept.values())
    out = []
    for term, f in sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:most]:
        n, share, ratio = term.count(" ") + 1, f / top, f / least
        value = 0.85 * share + 0.15 * min(rank[term] / best, 1.0) * share
        if n > 2 and ratio < 3:
            value *= 0.95
        if n == 1 and inside.get(term, 0) >= least:
            value *= max(0.3, 1 - 0.7 * inside[term] / top)
        if n > 1:
            value += (0.15 if n == 2 else 0.2) * min(ratio / 3, 1.0)
        out.append((term, n, f, rank[term], max(0.0, min(1.0, value)), f / total / (1 + f / len(kept))))
    return out


def extract(docs: DataFrame, key: str = "doc_id", least: int = MIN_FREQUENCY, most: int = MOST_TERMS) -> DataFrame:
    """(key, term, words, frequency, bm25, relevance, tf_idf, type): the terms of each text.

    All counts are within a text, so one map does it and nothing is shuffled.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *row) for k, text in frame.itertuples(index=False) for row in scored_terms(text or "", least, most)]
            yield pd.DataFrame(rows, columns=[key, "term", "words", "frequency", "bm25", "relevance", "tf_idf"])

    found = docs.select(key, "text").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {EXTRACTED}")
    return found.withColumn("type", term_type(F.col("term")))


def without_parts(terms: DataFrame, by: list[str]) -> DataFrame:
    """Terms (by..., term, rank) that are no run of words of a higher-ranked term."""
    long = terms.where(F.col("term").contains(" "))
    parts = F.flatten(F.array(*[ngrams(F.split("term", " "), n) for n in range(1, LONGEST)]))
    inside = long.select(*by, F.explode(F.array_distinct(parts)).alias("term"), F.col("rank").alias("over"), F.col("term").alias("whole")).where("term <> whole")
    best = inside.groupBy(*by, "term").agg(F.min("over").alias("over"))
    return terms.join(best, [*by, "term"], "left").where("over is null or over >= rank").drop("over")


def related(terms: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """(by..., term, related): up to k other terms that share a word, in order of name."""
    words = terms.select(*by, "term", F.explode(F.split("term", " ")).alias("word")).distinct()
    # of the terms of a word one more than k are enough: one of them may be the term itself
    same = Window.partitionBy(*by, "word").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = words.select(*by, "term", F.array(*[F.nth_value("term", n).over(same) for n in range(1, k + 2)]).alias("others"))
    others = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("others")))))
    found = near.groupBy(*by, "term").agg(others.alias("others"))
    return found.select(*by, "term", F.slice(F.filter("others", lambda x: x != F.col("term")), 1, k).alias("related")).where(F.size("related") > 0)


#: A score halves with each later text: those before the last so many weigh nothing in a double.
LAST = 64


def store(found_terms: DataFrame) -> DataFrame:
    """(term, frequency, docs, score) over texts: frequencies add up, scores meet pairwise in order of doc_id, docs counts texts."""
    found_terms = cut(found_terms.select("term", "doc_id", "frequency", "relevance"))  # made once, and gone through twice
    order = Window.partitionBy("term").orderBy(F.desc("doc_id"))
    late = found_terms.select("term", "doc_id", "relevance", F.row_number().over(order).alias("j")).where(F.col("j") <= LAST)
    rows = found_terms.groupBy("term").agg(F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("docs"))
    weight = F.pow(F.lit(0.5), F.when(F.col("j") == F.col("docs"), F.col("docs") - 1).otherwise(F.col("j")))
    score = late.join(rows, "term").groupBy("term").agg(F.sum(F.col("relevance") * weight).alias("score"))
    return rows.join(score, "term")


def top_by_domain(found_terms: DataFrame, k: int) -> DataFrame:
    """(domain, term, frequency, relevance) of rows (domain, term, frequency, relevance): each domain's k best by relevance, then frequency, then name."""
    rows = found_terms.groupBy("domain", "term").agg(F.sum("frequency").alias("frequency"), F.max("relevance").alias("relevance"))
    order = Window.partitionBy("domain").orderBy(F.desc(F.round("relevance", 6)), F.desc("frequency"), "term")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


# Spellings of the United States and Britain, and the domains a pair is bound to.
VARIANTS = {
    "aluminum": "aluminium", "analyze": "analyse", "authorize": "authorise", "authorization": "authorisation", "behavior": "behaviour", "catalog": "catalogue", "categorize": "categorise",
    "categorization": "categorisation", "centralize": "centralise", "centralization": "centralisation", "center": "centre", "check": "cheque", "color": "colour", "criticize": "criticise",
    "customize": "customise", "customization": "customisation", "dialog": "dialogue", "emphasize": "emphasise", "favor": "favour", "favorite": "favourite", "fiber": "fibre", "finalize": "finalise",
    "flavor": "flavour", "harbor": "harbour", "gray": "grey", "initialize": "initialise", "initialization": "initialisation", "labor": "labour", "license": "licence", "liter": "litre",
    "maximize": "maximise", "meter": "metre", "minimize": "minimise", "mobilize": "mobilise", "mobilization": "mobilisation", "mom": "mum", "neighbor": "neighbour", "normalize": "normalise",
    "normalization": "normalisation", "optimize": "optimise", "optimization": "optimisation", "organize": "organise", "organization": "organisation", "parameterize": "parameterise",
    "parameterization": "parameterisation", "practice": "practise", "prioritize": "prioritise", "prioritization": "prioritisation", "realize": "realise", "realization": "realisation",
    "recognize": "recognise", "sanitize": "sanitise", "sanitization": "sanitisation", "serialize": "serialise", "serialization": "serialisation", "specialize": "specialise",
    "specialization": "specialisation", "standardize": "standardise", "standardization": "standardisation", "summarize": "summarise", "tokenize": "tokenise", "utilize": "utilise",
    "utilization": "utilisation", "visualize": "visualise", "visualization": "visualisation",
}
BOUND = {"fiber": ("network", "nutrition")}
# Related terms of security and governance, and what abbreviations stand for.
RELATED = {
    "auth": ("authentication", "authorize", "authorise", "access", "login", "credential"), "authentication": ("auth", "login", "credential", "authorize", "identity"),
    "authenticate": ("auth", "login", "credential", "identity", "mtls", "mfa", "sso"), "authorize": ("auth", "permission", "access", "grant"), "access_control": ("iam", "identity", "permission", "rbac"),
    "identity": ("iam", "authentication", "user", "account"), "security": ("confidentiality", "integrity", "protection", "encryption", "control", "access", "availability", "audit"),
    "encryption": ("cipher", "crypto", "secure", "protection", "tls", "ssl", "certificate", "data", "confidentiality"), "compliance": ("regulation", "policy", "audit", "governance"),
    "audit": ("compliance", "log", "trace", "record"), "threat": ("risk", "vulnerability", "attack", "exploit"), "secret": ("credential", "password", "key", "token", "certificate", "sensitivity"),
    "vpn": ("virtual", "private", "network", "tunnel", "ipsec", "ike", "l2tp", "wireguard", "openvpn", "pptp"), "firewall": ("network", "protection", "filter", "rule"),
    "gateway": ("proxy", "edge", "filter", "transit"), "dlp": ("data", "loss", "prevention", "protection"), "backup": ("restore", "recovery", "redundancy", "snapshot"),
    "classification": ("label", "sensitivity", "category", "tag"), "iam": ("identity", "access", "management", "authentication", "authorization"), "mfa": ("multi-factor authentication", "authentication"),
    "sso": ("single sign-on", "authentication"), "rbac": ("role-based access control", "authorization", "permission"),
    "saml": ("authentication", "authorization", "security assertion markup language", "standard"), "oauth": ("authentication", "authorization", "protocol"),
}
ABBREVIATIONS = {
    "auth": "authentication", "auth.": "authentication", "dlp": "data loss prevention", "iam": "identity and access management", "mfa": "multi-factor authentication", "sso": "single sign-on",
    "rbac": "role-based access control", "saml": "security assertion markup language", "oauth": "open authorization", "api": "application programming interface", "http": "hypertext transfer protocol",
    "https": "hypertext transfer protocol secure", "vpn": "virtual private network", "url": "uniform resource locator", "xml": "extensible markup language", "json": "javascript object notation",
    "jwt": "json web token", "mtls": "mutual tls", "tls": "transport layer security", "ssl": "secure sockets layer", "ldap": "lightweight directory access protocol", "ad": "active directory",
    "okta": "okta identity platform", "siem": "security information and event management", "soar": "security orchestration automation response", "casb": "cloud access security broker",
    "fwass": "firewall as a service",
}


def expansions_of(domain: str | None = None) -> list[tuple[str, str, str]]:
    """(term, other, kind) of all dictionaries; spellings go both ways, and those bound to domains count in these only."""
    pairs = [(a, b) for a, b in VARIANTS.items() if a not in BOUND or (domain or "").lower() in BOUND[a]]
    out = [(x, y, "variant") for a, b in pairs for x, y in ((a, b), (b, a))]
    out += [(a, b, "synonym") for a, words in RELATED.items() for b in words]
    return out + [(a, w, "abbreviation") for a, text in ABBREVIATIONS.items() for w in text.replace("-", " ").replace("_", " ").split() if len(w) > 2]


#: Names of a vocabulary that goes to each worker.
MOST_NAMES = 100_000


def expanded(queries: DataFrame, domain: str | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, term, weight, kind): a query's terms and what they expand to, each once, of several kinds the first of term, variant, synonym, abbreviation, domain.

    vocabulary (term, acronym, weight) is that of the domain: its terms that hold a query's term, or whose acronym it is, come in with
    their acronyms, and its weights count for all; others weigh 1. A vocabulary of a domain is a list of at most MOST_NAMES.
    """
    if vocabulary is not None and vocabulary.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError("a vocabulary too large for each worker to hold")
    spark = queries.sparkSession
    kinds = ("term", "variant", "synonym", "abbreviation", "domain")
    table = F.broadcast(spark.createDataFrame(expansions_of(domain), "term string, other string, kind string"))
    own = queries.select("query_id", F.explode(F.array_distinct(query_tokens(F.col("query")))).alias("term"))
    rows = own.select("query_id", "term", F.lit("term").alias("kind")).unionByName(own.join(table, "term").select("query_id", F.col("other").alias("term"), "kind"))
    if vocabulary is not None:
        v = F.broadcast(vocabulary.select(F.col("term").alias("name"), "acronym"))
        hit = F.lower("name").contains(F.col("term")) | (F.lower("acronym") == F.col("term"))
        rows = rows.unionByName(own.join(v, hit).select("query_id", F.explode(F.array_compact(F.array("name", "acronym"))).alias("term"), F.lit("domain").alias("kind")))
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(order))).where("_n = 1").drop("_n")
    if vocabulary is None:
        return once.select("query_id", "term", F.lit(1.0).alias("weight"), "kind")
    boost = vocabulary.groupBy(F.lower("term").alias("low")).agg(F.max("weight").alias("boost"))
    return once.join(F.broadcast(boost), F.lower("term") == F.col("low"), "left").select("query_id", "term", F.coalesce("boost", F.lit(1.0)).alias("weight"), "kind")
