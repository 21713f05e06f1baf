"""Lists of references: where entries begin and end, what they name, and the best path against all paths."""

import itertools
import textwrap

import numpy as np
from pyspark.sql import functions as F

from docfathom.operators import citations as C

ENTRIES = [
    "Abel, T. H., Stone, G. L., & Solis, S. L. (2021). The weight of soft skills in a hard world: learning from talks with leaders. Medical Learning, 21(1), 1-7. http://dx.doi.org/10.1186/s12909-021-0",
    "Health and Research Council, (H&RC). (2023). Submit an application. Retrieved from https://www.council.org/submit-an-application/",
    "Abu Bakar, H., Jian, G., & Hurst, G. (2014). Where do I stand? The meeting of leader– member exchange and ratings. Business & Management, 13(2), 143-170. https://doi.org/10.1057/abm.2014.3",
    "AbuJbara, N. K., & Worley, J. A. (2018). Toward new horizons. On the Horizon, 26(3), 247–259. https://doi.org/10.1108/oth-10-2017-0085",
    "Adeel, A., & Peng, Z. (2016). How are they winning such places? European Journal of Management, 8(2), 81-89.",
    "Boateng-Ako, R., Pole, F. H., O'Reilly, B., Purcell, I. P., & Ruga, R. O. (2003). Barriers to leaders: Gravity in Ghana. Developing Societies, 15(2), 201-221. 10.1177/0971333603015002",
    "Al Khan, E.H. (2018). Styles of leadership. Journal of Resources, 2018 (2166-0018). Retrieved from: https://example.com/up",
    "Tony, S., & Antony, J. (2020), Academic Leaders – Their Culture, In Antony, J. (Ed.) Six Sigma in Learning (pp.62-79). Emerald Publishing.",
    "Hale, D. W. (1998). Of rivers. Third edition. Review of Waters, 4(1), 5-9.",
]
NUMBERED = [f"[{k + 1}] {e}" for k, e in enumerate(ENTRIES)]


def found(spark, **texts):
    docs = spark.createDataFrame(list(texts.items()) or [], "doc_id string, text string")
    out = {k: [] for k in texts}
    for r in C.reference_entries(docs).orderBy("doc_id", "place").collect():
        out[r.doc_id].append(r)
    return out


def wrap(entry, width=60):
    return "\n".join(textwrap.wrap(entry, width, break_long_words=False, break_on_hyphens=False))


def test_entries_whole_wrapped_and_joined(spark):
    after = "\nAppendix A\nWhat follows is prose.\n"
    got = found(spark, lines="Text.\n\nREFERENCES\n" + "\n".join(ENTRIES) + after, numbered="x\n7. Bibliography:\n" + "\n".join(NUMBERED) + after, wrapped="References\n" + "\n".join(map(wrap, ENTRIES)) + after,
                wrapped_numbers="Works cited\r\n" + "\r\n\r\n".join(map(wrap, NUMBERED)).replace("\r\n", "\n") + after, one_line="a\nReferences\n" + " ".join(NUMBERED), bare_line="a\nReferences\n" + " ".join(ENTRIES))
    for name, rows in got.items():
        assert [r.raw for r in rows] == (NUMBERED if "number" in name or name == "one_line" else ENTRIES), name
    assert [r.number for r in got["one_line"]] == list(range(1, 10)) and {r.number for r in got["lines"]} == {None}
    assert [r.year for r in got["lines"]] == [2021, 2023, 2014, 2018, 2016, 2003, 2018, 2020, 1998]
    assert [r.doi for r in got["lines"]] == ["10.1186/s12909-021-0", None, "10.1057/abm.2014.3", "10.1108/oth-10-2017-0085", None, "10.1177/0971333603015002", None, None, None]
    assert got["lines"][0].authors == ["Abel, T. H.", "Stone, G. L.", "Solis, S. L."] and got["lines"][1].authors == ["Health and Research Council"] and got["lines"][6].authors == ["Al Khan, E.H."]
    assert got["lines"][2].title == "Where do I stand? The meeting of leader– member exchange and ratings" and got["lines"][7].title == "Academic Leaders – Their Culture"


def test_choice_of_list(spark):
    few, many = "\n".join(ENTRIES[:2]), "\n".join(ENTRIES[2:6])
    prose = "\n".join(["and so it goes on for many a line"] * 60)
    got = found(spark, later=f"References\n{few}\n{prose}\nReferences\n{many}\n", earlier=f"References\n{many}\n{prose}\nReferences\n{few}\n", header=f"References\n{few}\nReferences\n{many}\n",
                contents=f"References ..... 12\n{few}\nText\n{prose}\nReferences\n{many}\n", no_heading_between=f"References\n{few}\n{prose}\n{many}\n", tie=f"References\n{few}\n{prose}\nReferences\n" + "\n".join(ENTRIES[4:6]),
                inline=f"See the references in\n{few}\n")
    raws = {k: [r.raw for r in v] for k, v in got.items()}
    assert raws["later"] == raws["earlier"] == raws["contents"] == ENTRIES[2:6]
    assert raws["header"] == ENTRIES[:6] and raws["no_heading_between"] == raws["tie"] == ENTRIES[:2] and raws["inline"] == []


def test_odd_texts(spark):
    long = "word " * 200_000 + "\nReferences\n" + ENTRIES[4] + "\n"
    got = found(spark, null=None, empty="", heading="References", bare="References\nno year or address here\nsee 2019 for what it says\nhttp://a.b/c is short but long\n1999 short\n", long=long, nothing="a\n")
    assert got["null"] == got["empty"] == got["heading"] == got["nothing"] == []
    assert [r.raw for r in got["bare"]] == ["see 2019 for what it says", "http://a.b/c is short but long"] and [r.raw for r in got["long"]] == [ENTRIES[4]]
    clash = spark.createDataFrame([(1, "References\n" + ENTRIES[4], "a", 5), (1, "References\n" + ENTRIES[4], "b", 6)], "doc_id int, text string, raw string, place int")
    assert [r.raw for r in C.reference_entries(clash).collect()] == [ENTRIES[4]] * 2
    assert C.reference_entries(clash.limit(0)).count() == 0


def test_predicates(spark):
    cases = [("[2] C. (2017). Missing a surname", True, True, False), ("Lastname I. I. (2017). No comma here", True, True, False), ("Race, Ethnicity and Education, 19(4), 784-807. https://a.b", False, False, True),
             ("Smith, J. (2001). Of stones and rivers", True, False, False), ("short 2001", False, False, False), ("Smith, J. Of stones and rivers without", False, False, False),
             ("3. Chapter three of the book from 2003", True, False, False), ("Bureau of Rivers. (2011a). Year book", True, False, False)]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = rows.select("k", C.reference_like(F.col("t")), C.malformed_author(F.col("t")), C.orphan_journal(F.col("t"))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in cases]


def test_authors_titles_and_joined_words(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    text = F.lit
    assert one(C.authors(text("Smith et al. (2020). On trees."))) == ["Smith"] and one(C.authors(text("Smith, J. and Doe, A. B. (2020). On trees."))) == ["Smith, J.", "Doe, A. B."]
    assert one(C.authors(text("Smith, J. 2020. On trees."))) == [] and one(C.authors(text(""))) == [] and one(C.authors(text("A, B., " * 3 + "Bo, C., Di, E., Fo, G., Ho, I., Jo, K., Lo, M. (1999)"))) != []
    assert one(F.size(C.authors(text("Bo, C., Di, E., Fo, G., Ho, I., Jo, K., & Lo, M. (1999). X.")))) == 5
    assert one(C.title(text("Smith, J. (2020)."))) is None and one(C.title(text("Smith, J. (2020). 12 34."))) is None and one(C.title(text("no year. A title."))) is None
    assert one(C.title(text("S, J. (2020). A title of use. " + "Long words follow. " * 20))) is None and one(C.title(text("S, J. (2020). A title of use. Journal of X. " + "Long words follow. " * 20))) == "A title of use"
    assert one(C.spaced(text("the  AustralianBureauOfRivers and AbuJbara"))) == "the Australian Bureau Of Rivers and AbuJbara"
    assert one(C.spaced(text("https://a.org/SomePageOfManyWords aLongMethodologyABCParser"))) == "https://a.org/SomePageOfManyWords a Long Methodology ABC Parser"


def test_works_once(spark):
    rows = [(1, "b", "10.1/AB", "T"), (2, "a", "10.1/ab", None), (2, "a", "10.1/ab", None), (3, "c", None, "Of Stones"), (4, "d", None, "of stones"), (5, "[1] e", None, None), (6, "[2] e", None, None)]
    entries = spark.createDataFrame(rows, "doc_id int, raw string, doi string, title string").withColumn("year", F.lit(2000)).withColumn("authors", F.array().cast("array<string>"))
    works, pairs = C.cited(entries)
    assert sorted(r.raw for r in works.collect()) == ["[1] e", "a", "c"] and pairs.count() == 6


def test_best_path():
    random = np.random.default_rng(5)
    for n in (1, 2, 5, 6):
        scores = random.normal(0, 2, (n, 4))

        def value(path, scores=scores):
            return sum(C.STEPS[a, b] + scores[k, b] - (scores[k, 3] if a and not b else 0) for k, (a, b) in enumerate(zip((0, *path), path, strict=False)))

        best = max(itertools.product(range(3), repeat=n), key=value)
        assert tuple(C.best_path(scores)) == best
    assert len(C.best_path(np.zeros((0, 4)))) == 0


def test_patterns_are_tried_once_a_line(spark):
    assert C.line_marks(F.col("lines"))._jc.toString().lower().count("rlike") <= 13
    lines = spark.createDataFrame([(["References", "Smith, J. (1999). On", "trees. Wiley, 3(1).", ""],)], "lines array<string>")
    scores = C.line_scores(np.array(lines.select(C.line_marks(F.col("lines"))).first()[0]))
    assert scores.shape == (4, 4) and list(C.best_path(scores)) == [0, 1, 2, 0]
