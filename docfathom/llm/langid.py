"""Language identification by words first, then shorter and shorter character n-grams.

A word the training texts hold often enough scores by its smoothed log frequency in each language. An unseen word
scores by the longest character n-grams (with word ends marked) of which the model knows any, the mean of their log
frequencies. A text's word scores add up; the score given is the softmax of their mean, sharpened by the number of
words up to a limit, so that one odd word doesn't decide like a thousand.

Fitting reads a bounded sample: about `per_language` documents of each language, chosen by the hash of doc_id, with
counts summed in Spark; the model keeps the `entries` most frequent words and n-grams of each length, with their counts
in every language. Rows without a language are not learned from. A prediction sees the text alone.

Defined results: `und` and score 0 for null text, text without a letter, or a model without a language; of languages
that score alike the first by name; long texts are read whole; rows that repeat get equal answers; an empty table gives
no rows; columns but doc_id, text and (in training) lang are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_LANGUAGE = 1_000
#: Words, and n-grams of each length, in the model, each with its counts in all languages: about as many rows as 60,000 pairs with a language.
ENTRIES = 25_000
ORDERS = (5, 4, 3, 2, 1)
MIN_COUNT = 2
CERTAIN = 12
MEMO = 300_000
WORD = re.compile(r"[^\W\d_]+")
#: n-grams of a word that are held at once: a run of letters without spaces can be as long as its text.
BLOCK = 10_000
#: Counts that a task holds before it hands them on.
HELD = 500_000


def words_of(text: str | None) -> Counter:
    """Runs of letters. Numbers that the pattern lets through (fractions, circled and Roman numerals) part them."""
    out = Counter(WORD.findall((text or "").lower()))
    for w in [w for w in out if not w.isalpha()]:
        n = out.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            out[part] += n
    return out


def grams(word: str, n: int) -> list[list[str]] | Iterator[list[str]]:
    """All n-grams of a whole word, in blocks."""
    marked = f"<{word}>"
    last = len(marked) - n + 1
    if last <= BLOCK:
        return [[marked[k : k + n] for k in range(last)]]
    return ([marked[k : k + n] for k in range(at, min(at + BLOCK, last))] for at in range(0, last, BLOCK))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, kind, gram, n): kind 0 for words, else the length of the n-gram. Each word of a text adds its n-grams once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, kind, gram, n) for lang, c in seen.items() for (kind, gram), n in c.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = seen.setdefault(lang, Counter())
                for word, n in words_of(text).items():
                    c[0, word] += n
                    for k in ORDERS:
                        for part in grams(word, k):
                            for g in part:
                                c[k, g] += 1
                            if len(part) == BLOCK and sum(map(len, seen.values())) > HELD:
                                yield out()
                                seen.clear()
                                c = seen.setdefault(lang, Counter())
            if sum(map(len, seen.values())) > HELD:
                yield out()
                seen.clear()
        yield out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language: known[kind][gram] is a row of `table`."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.known: dict[int, dict[str, int]] = {k: {} for k in (0, *ORDERS)}
        index: list[tuple[int, str]] = []
        for _, kind, gram, _ in rows:
            if gram not in self.known[kind]:
                self.known[kind][gram] = len(index)
                index.append((kind, gram))
        count = np.zeros((len(index), len(self.langs)))
        for lang, kind, gram, n in rows:
            count[self.known[kind][gram], at[lang]] = n
        sums = np.array([[totals.get((lang, kind), 0) for lang in self.langs] for kind, _ in index]).reshape(len(index), len(self.langs))
        sizes = np.array([len(self.known[kind]) for kind, _ in index]).reshape(-1, 1)
        self.table = np.log((count + 0.1) / (sums + 0.1 * (sizes + 1)))

    def word(self, word: str) -> np.ndarray:
        row = self.known[0].get(word)
        if row is not None:
            return self.table[row]
        for n in ORDERS:
            total, held = np.zeros(len(self.langs)), 0
            for part in grams(word, n):
                rows = [r for g in part if (r := self.known[n].get(g)) is not None]
                if rows:
                    total += self.table[rows].sum(axis=0)
                    held += len(rows)
            if held:
                return total / held
        return np.zeros(len(self.langs))

    def predict(self, words: Counter, memo: Memo) -> tuple[str, float]:
        if not words or not self.langs:
            return "und", 0.0
        total, held, part = np.zeros(len(self.langs)), 0, {}
        for w, n in words.items():  # a part of the words at a time: a text may hold more than the memory
            part[w] = n
            if len(part) == MEMO:
                total, held, part = total + memo.weighed(self, part), held + sum(part.values()), {}
        held += sum(part.values())
        mean = (total + memo.weighed(self, part)) / held
        power = np.exp((mean - mean.max()) * min(held, CERTAIN))
        best = int(power.argmax())
        return self.langs[best], float(power[best] / power.sum())


class Memo:
    """Scores of words seen before, one row each; emptied when it is full."""

    def __init__(self, languages: int):
        self.at: dict[str, int] = {}
        self.rows = np.empty((1024, languages))

    def weighed(self, model: Model, words: dict[str, int]) -> np.ndarray:
        """The words' scores, each as often as the word is there, summed."""
        at = self.at
        new = [w for w in words if w not in at]  # a difference of the keys would go through the whole memory
        if len(at) + len(new) > MEMO:
            at.clear()
            new = list(words)
        while len(at) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        for w in new:
            self.rows[len(at)] = model.word(w)
            at[w] = len(at)
        place = np.fromiter((at[w] for w in words), np.int64, len(words))
        return np.fromiter(words.values(), float, len(words)) @ self.rows[place]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, entries: int = ENTRIES) -> Model:
    """From rows (doc_id, text, lang). All languages of the rows are learned; what is read of each and the table's entries are bounded by the parameters."""
    docs = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").count()
    share = F.broadcast(sizes.select(F.col("lang"), (F.lit(float(per_language)) / F.col("count")).alias("share")))  # a row a language
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    chosen = docs.join(share, "lang").where(chance < F.col("share")).select("lang", "text")
    count = counted(chosen).where(f"n >= {MIN_COUNT}").persist()
    totals = {(r[0], r[1]): r[2] for r in count.groupBy("lang", "kind").agg(F.sum("n")).collect()}
    rows: list[tuple] = []
    for kind in (0, *ORDERS):
        part = count.where(F.col("kind") == kind)
        best = part.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(entries)
        rows += part.join(F.broadcast(best), "gram").select("lang", "kind", "gram", "n").orderBy("gram", "lang").collect()  # `entries` n-grams, with their counts in all languages
    count.unpersist()
    return Model([tuple(r) for r in rows], totals)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(len(shared.value.langs))
        for batch in batches:
            found = [shared.value.predict(words_of(t), memo) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double")
