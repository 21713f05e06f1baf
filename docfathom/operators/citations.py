"""Lists of references in whole texts: where they stand, where each entry begins and ends, and what an entry names.

Lines are scored by column expressions for three states: outside a list, the first line of an entry, and a further line of one. The best path
of states through a text's lines (Viterbi) parts the list, so that one odd line doesn't part an entry or end a list.

Defined results: null and empty texts, and texts without a heading of a list, have no entries; texts are read whole; rows that repeat give
their entries again; an empty table gives no rows; of lists of as many entries the first in the text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import DOI

# Headings of lists, headings that end one, the shortest entry and candidate line, lines without an entry that end a list, and
# characters from which a word counts as joined ones.
HEADINGS = ("references", "reference list", "bibliography", "works cited")
ENDINGS = ("appendix", "acknowledgement", "acknowledgment", "table", "figure", "author biograph", "about the author", "supplementary material")
SHORTEST_ENTRY, SHORTEST_LINE, GAP, JOINED = 25, 15, 40, 18
# Publishers that end a book's title, words that begin what stands after a work's title, characters after the year up to which any first
# sentence is the title, and authors that are kept.
PUBLISHERS = ("Sage", "Springer", "Wiley", "Oxford", "Cambridge", "Routledge", "Pearson", "McGraw", "Elsevier", "Academic Press", "MIT Press", "Londres")
VENUE_WORDS = ("In", "Journal", "Review", "Harvard", "Oxford", "Springer", "Wiley", "Proceedings", "American", "British", "International")
SHORT_REST, MOST_AUTHORS = 200, 5

NUMBER = r"^\s*(?:\[\d+\]|\d{1,3}\.|\d+\))\s+"
YEAR = r"\b(?:19|20)\d{2}(?![\d/])"
DATED = r"\((?:19|20)\d{2}[a-z]?\)"
IDENTIFIER = r"(?i)doi|https?://|arxiv\.org|\b10\.\d{4,9}/"
PARTICLE, NAME, INITIALS = r"(?:(?:[Vv]an|[Vv]on|[Dd]er?|[Dd]el|[Dd]a|[Dd]i|[Ll]e|[Ll]a) )*", r"\p{Lu}[\p{L}'’-]+", r"\p{Lu}\.(?:[ -]?\p{Lu}\.)*"
AUTHOR = rf"{PARTICLE}{NAME}(?: {NAME})?,? \p{{Lu}}\."
BODY = rf"\p{{L}}[\p{{L}} &'’-]{{3,150}}?(?:,? ?\([A-Za-z&]{{2,}}\))?[.,]? ?{DATED}"
TAIL = r"\d+ ?\(\d+\)|\bpp?\. ?\d+|\d+ ?[-–] ?\d+\."

OUTSIDE, FIRST, FURTHER = 0, 1, 2
#: Scores of a step from a state (row) to the next line's (column): a list begins and ends seldom, entries are short, and only entries go on.
STEPS = np.array([[0.0, -1.0, -np.inf], [-2.0, 0.0, 0.0], [-2.0, 0.0, -0.4]])


def numberless(entry: Column) -> Column:
    return F.regexp_replace(entry, NUMBER, "")


def identified(text: Column) -> Column:
    return text.rlike(IDENTIFIER) | text.rlike(YEAR)


def reference_like(entry: Column) -> Column:
    """Whether an entry has a year or an identifier, and begins with a number, an author or a body."""
    return (F.length(entry) >= SHORTEST_ENTRY) & identified(entry) & entry.rlike(f"{NUMBER}|^(?:{AUTHOR}|{BODY})")


def malformed_author(entry: Column) -> Column:
    """Whether an entry begins with an initial and the year, or with a surname and initials and no comma before the year."""
    clean = numberless(entry)
    return clean.rlike(rf"^[A-Z]\.\s*\((?:19|20)\d{{2}}") | clean.rlike(rf"^[A-Z][A-Za-z-]+\s+[A-Z]\.\s+[A-Z]\.[^,(]{{0,80}}\((?:19|20)\d{{2}}")


def orphan_journal(entry: Column) -> Column:
    """Whether an entry begins with a journal and its volume, without an author."""
    clean = numberless(entry)
    return clean.rlike(r"^[A-Z][A-Za-z,&\s-]+,\s*\d+\(") & ~clean.rlike(rf"^(?:{NAME},\s+\p{{Lu}}\.|{BODY})")


def candidate_line(line: Column) -> Column:
    """Whether a line can be a reference where a list has no entries."""
    return (F.length(line) >= SHORTEST_LINE) & identified(line)


def spaced(text: Column) -> Column:
    """Spaces put back in words that ran together: words of JOINED characters or more are parted before capitals that follow small letters, closing
    marks or an acronym. Addresses and identifiers stay as they are. Runs of blanks become one."""
    part = lambda w, pattern: F.regexp_replace(w, pattern, "$1 $2")
    patterns = ("([a-z])([A-Z])", r"([)\],.:;])([A-Z][a-z]{2,})", "([A-Z]{2,})([A-Z][a-z])")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) >= JOINED) & ~w.rlike(r"(?i)://|^doi:|\b10\.\d{4,9}/"), reduce(part, patterns, w)).otherwise(w)), " ")


def parted(text: Column) -> Column:
    """Lines broken where an entry ends and the next one begins within a line: before a number in brackets, after an address or identifier before an
    author or body, whether a blank is between or not, and after a stop before authors and their year."""
    text = F.regexp_replace(text, r"([.\d/\p{L}]) *(\[\d{1,4}\] +\p{Lu})", "$1\n$2")
    one = rf"{PARTICLE}{NAME}(?: {NAME})?, {INITIALS}"
    text = F.regexp_replace(text, rf"((?:https?://|doi:|\b10\.\d{{4,9}}/)[^\s]*?)(?:(?<=[\d.])(?={one}(?:,| ?&| ?\())| +(?={one}(?:,| ?&| ?\()|{BODY}))", "$1\n")
    return F.regexp_replace(text, rf"([.\d/]) +(?=(?:{one}(?:,? ?& ?|, ?| and | )?){{1,40}}{DATED})", "$1\n")


def heading(line: Column) -> Column:
    """Whether a line is the heading of a list; lines of a contents list have a page and are none."""
    return F.lower(F.trim(line)).rlike(rf"^(?:#+ *|\d+(?:\.\d+)*\.? +|chapter \d+[.: ]+)?(?:{'|'.join(HEADINGS)})\s*:?$")


def line_marks(lines: Column) -> Column:
    """Of each line which of the tests that line_scores() takes hold, a bit each: every pattern is tried once a line."""

    def marks(line: Column) -> Column:
        number, author, year, name = line.rlike(NUMBER), line.rlike(f"^\\s*(?:{AUTHOR})"), line.rlike(DATED), line.rlike(IDENTIFIER)
        body, small, going = line.rlike(f"^\\s*(?:{BODY})"), line.rlike(r"^\s*[\p{Ll}\d&(]"), line.rlike(r"(?:[,&;:-]|\band|\bIn)\s*$")
        dated, blank, tail, unfinished = line.rlike(YEAR), F.trim(line) == "", line.rlike(TAIL), ~line.rlike(r"[.!?)\]\d/]\s*$")
        ending = F.lower(F.trim(line)).rlike(rf"^(?:{'|'.join(ENDINGS)})(?:s|y|ies)?\b(?!,)") & (F.length(line) <= 60)
        tests = (number, author, year, name, body, small, going, dated, blank, tail, unfinished, ending, heading(line))
        return reduce(lambda x, y: x + y, [F.when(test, 1 << n).otherwise(0) for n, test in enumerate(tests)])

    return F.transform(lines, marks)


def line_scores(marks: np.ndarray) -> np.ndarray:
    """Of line_marks() the scores of each line for the states OUTSIDE, FIRST and FURTHER, and what it costs to leave an entry before it."""
    number, author, year, name, body, small, ends_going, dated, blank, tail, ends_open, ending, head = (marks >> np.arange(13)[:, None] & 1).astype(bool)
    after = lambda x: np.append(False, x[:-1])  # noqa: E731  of the line before
    going, unfinished = after(ends_going), after(ends_open & ~blank)
    undated = after((number | author) & ~dated & ~name)  # the entry before can't end here
    ended = ending & ~name & ~year
    outside = 1.0 * (~dated & ~name & ~number & ~author & ~tail) + 6 * (ended | head) + 2 * blank - 2 * year - 3 * name
    first = 4.0 * number + 3 * author + 3 * body + 2 * year + dated - 4 * (small & ~number) - 5 * going - 3 * (undated & ~number) - 20 * blank - 20 * head - 2
    further = 1.0 * ((small | unfinished) & ~number) + 2 * (name & ~author & ~number) + tail + 3 * going - 4 * number - 3 * (author & ~going) - 3 * (body & ~going) - 20 * head
    return np.stack([outside, first, further, 3.0 * (unfinished & ~ended & ~head)], axis=1)


def best_path(scores: np.ndarray) -> np.ndarray:
    """The states of the lines (n by 4: scores, and what leaving an entry costs) whose sum is highest; it begins outside, and of paths alike the one of smaller states."""
    (oo, of, _), (fo, ff, fg), (go, gf, gg) = STEPS.tolist()
    back, a, b, c = [], 0.0, -np.inf, -np.inf  # the best sums of paths that end outside, on a first and on a further line
    for outside, first, further, leave in scores.tolist():
        x, y, z = (a + oo, b + fo - leave, c + go - leave), (a + of, b + ff, c + gf), (-np.inf, b + fg, c + gg)
        m, n, p = max(x), max(y), max(z)
        back.append((x.index(m), y.index(n), z.index(p)))
        a, b, c = m + outside, n + first, p + further
    path = np.zeros(len(back), np.int8)
    state = (a, b, c).index(max(a, b, c))
    for k in range(len(back) - 1, -1, -1):
        path[k], state = state, back[k][state]
    return path


@F.pandas_udf(ArrayType(StructType().add("first", "integer").add("last", "integer")))
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def spans(scores) -> list[dict]:
        if scores is None or not len(scores):
            return []
        path = best_path(line_scores(np.asarray(scores, np.int64)))
        starts = np.flatnonzero(path == FIRST)
        ends = np.flatnonzero((path != FURTHER) & (np.arange(len(path)) > 0))
        after = np.append(ends, len(path))[np.searchsorted(ends, starts, side="right")]
        return [{"first": int(a), "last": int(b) - 1} for a, b in zip(starts, after, strict=True)]

    for batch in batches:
        yield batch.map(spans)


def chosen(entries: Column, headings: Column) -> Column:
    """Of entries (first, last, raw) those of the best list: a list goes from a heading to the first gap of GAP lines without an entry, and the
    one of most entries is the best, the first one of those alike."""
    of = F.transform(entries, lambda e: F.struct(e["first"].alias("first"), e["last"].alias("last"), e["raw"].alias("raw"), F.size(F.filter(headings, lambda h: h < e["first"])).alias("heads")))
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best_at"), F.lit(0).alias("best_n"), F.lit(-1).alias("last"), F.lit(0).alias("heads"), F.lit(0).alias("i"))

    def step(s: Column, e: Column) -> Column:
        ended = (s["n"] == 0) | (e["first"] - s["last"] - 1 >= GAP)
        fresh = e["heads"] > s["heads"]  # a heading stands between: a list may begin
        at = F.when(ended, s["i"]).otherwise(s["at"])
        n = F.when(~ended, s["n"] + 1).when(fresh, 1).otherwise(0)
        better = n > s["best_n"]
        return F.struct(at.alias("at"), n.alias("n"), F.when(better, at).otherwise(s["best_at"]).alias("best_at"), F.when(better, n).otherwise(s["best_n"]).alias("best_n"),
                        e["last"].alias("last"), e["heads"].alias("heads"), (s["i"] + 1).alias("i"))

    best = F.aggregate(of, none, step, lambda s: F.struct(s["best_at"].alias("at"), s["best_n"].alias("n")))
    return F.when(F.size(of) == 0, of).otherwise(F.slice(of, best["at"] + 1, best["n"]))


def reference_entries(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, raw, number, doi, year, authors, title) of the entries of each text's best list of references.

    Entries that don't look like references, whose author is malformed or that name a journal alone are left out. Where a heading is there but no
    entry, the lines after it with a year or an identifier stand for entries. Words that ran together are parted.
    """
    # what comes before the first heading is never split into lines; texts without one go no further
    any_heading = rf"(?im)^[ \t]*(?:#+ *|\d+(?:\.\d+)*\.?[ \t]+|chapter \d+[.: ]+)?(?:{'|'.join(HEADINGS)})[ \t]*:?[ \t]*$"
    headed = docs.select(key, F.col("text").alias("_t")).where(F.col("_t").rlike(any_heading))
    at = F.regexp_instr("_t", F.lit(any_heading))
    lines = F.split(parted(F.replace(F.substring(F.col("_t"), at, F.length("_t")), F.lit("\r"), F.lit(""))), "\n")
    rows = headed.select(key, lines.alias("_lines"))
    rows = rows.withColumn("_spans", _spans(line_marks(F.col("_lines"))))
    entry = lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), spaced(F.array_join(F.slice("_lines", s["first"] + 1, s["last"] - s["first"] + 1), " ")).alias("raw"))
    fine = lambda e: reference_like(e["raw"]) & ~malformed_author(e["raw"]) & ~orphan_journal(e["raw"])
    heads = F.filter(F.transform("_lines", lambda line, i: F.when(heading(line), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_entries", F.filter(F.transform("_spans", entry), fine)).withColumn("_best", chosen(F.col("_entries"), heads))
    single = F.transform(F.filter(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))), lambda line: candidate_line(F.trim(line))), lambda line: spaced(line))
    raw = F.when(F.size("_best") > 0, F.transform("_best", lambda e: e["raw"])).otherwise(single)
    rows = rows.select(key, F.posexplode(raw).alias("place", "raw"))
    none = lambda c: F.nullif(c, F.lit(""))
    number = none(F.regexp_extract("raw", r"^\[?(\d+)[\].)]", 1)).try_cast("int")
    return rows.select(key, "place", "raw", number.alias("number"), none(F.regexp_replace(F.regexp_extract("raw", DOI, 0), r"[.,;]+$", "")).alias("doi"),
                       none(F.regexp_extract("raw", YEAR, 0)).try_cast("int").alias("year"), authors(F.col("raw")).alias("authors"), title(F.col("raw")).alias("title"))


def authors(citation: Column, most: int = MOST_AUTHORS) -> Column:
    """The authors before the year in brackets, surnames with their initials: the first alone where "et al." follows, none without a year."""
    before = F.regexp_replace(F.regexp_extract(numberless(citation), r"^(.*?)\((?:1[89]|20)\d{2}", 1), r"\([^)]*\)", "")
    first = F.regexp_extract(before, r"(?i)^(.+?)[.,;: ]*\bet\s+al\b", 1)
    names = F.regexp_extract_all(F.regexp_replace(before, r"\band\b(?= *\p{Lu}[\p{L}'’-]+, *\p{Lu}\.)", "&"), F.lit(r"(\p{L}[^,&]+(?:, *\p{Lu}\.?(?:[ -]*\p{Lu}\.?)*(?![\p{Ll}'’]))?)"), F.lit(1))
    tidy = F.transform(names, lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r",\s*", ", "), r"(?<=\p{L}{2})[.\s]+$", "")))
    good = F.filter(tidy, lambda n: n.rlike(rf"^{PARTICLE}\p{{Lu}}.+"))
    nobody = F.array().cast("array<string>")
    return F.when(F.trim(before) == "", nobody).when(F.length(first) > 1, F.array(F.trim(first))).when(before.rlike(r"(?i)\bet\s+al\b"), nobody).otherwise(F.slice(good, 1, most))


def title(citation: Column) -> Column:
    """The first sentence after the year in brackets, up to "In" and an editor, where a venue or volume follows it or little text stands after the
    year; else null. The stop of an initial ends no sentence."""
    rest = F.regexp_extract(citation, r"\(\s*(?:1[89]|20)\d{2}[a-z]?\s*\)[., ]*(.*)$", 1)
    end = r"(?<!\b\p{Lu})\.(?:\s+|$)"
    first = F.trim(F.regexp_replace(F.regexp_extract(rest, rf"^(.+?){end}", 1), rf",? In {NAME}, \p{{Lu}}\..*$", ""))
    venue = F.regexp_extract(rest, rf"^.+?{end}(.*)$", 1).rlike(rf"(?i)^(?:{'|'.join(VENUE_WORDS)})\b|^\d+\(")
    return F.when((venue | (F.length(rest) < SHORT_REST)) & (F.length(first) > 3) & ~first.rlike(r"^[\d\s]+$"), first)


def reviewed_book(title: Column) -> Column:
    """Struct (title, authors) of a title that cites the book it reviews: "Surname, I. Year. Title. Publisher", "First Last, First Last (Year): Title" or
    "First Last Year. Title". Other titles stay, without authors."""
    surname, full = rf"{NAME}(?: {NAME})*,? (?:\p{{Lu}}\.? ?)+", rf"{NAME}(?: {NAME})+(?:, {NAME}(?: {NAME})+)*"
    led = rf"^({surname}|{full})\.? ?\(?(\d{{4}})\)? ?[.:] +(.+)$"
    by, rest = F.trim(F.regexp_extract(title, led, 1)), F.trim(F.regexp_extract(title, led, 3))
    clean = F.regexp_replace(rest, rf"(?i)^(.+?)\. +(?:{'|'.join(PUBLISHERS)}).*$", "$1")
    people = F.when(by.rlike(rf"^(?:{full})$"), F.split(by, ", *")).otherwise(F.array(by))
    return F.when(rest == "", F.struct(title.alias("title"), F.array().cast("array<string>").alias("authors"))).otherwise(F.struct(clean.alias("title"), people.alias("authors")))


def cited(entries: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Of reference_entries() the works (ref_id, raw, doi, year, authors, title), each once, and citations (key, ref_id, raw), each pair once: of
    entries of one work the least raw text stays. A work is known by its DOI, else by its title, else by its text."""
    name = F.coalesce(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("ref:"), F.sha2(F.lower(F.coalesce("title", numberless(F.col("raw")))), 256)))
    rows = entries.withColumn("ref_id", name)
    least = F.min(F.struct("raw", "doi", "year", "authors", "title")).alias("w")
    return rows.groupBy("ref_id").agg(least).select("ref_id", "w.*"), rows.groupBy(key, "ref_id").agg(F.min("raw").alias("raw"))
