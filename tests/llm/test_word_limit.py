"""The common-word half of the distribution rules decides on its own."""

import random

from tessellar.llm import quality_rules

COMMON = {"en": "the of and to in is that it for was with as".split(), "de": "der die und in den von zu das mit sich des auf".split()}


def test_texts_without_common_words_go(spark):
    """Of the same letters and lengths: sound texts stay; word salad and another language's text under the label go."""
    rng = random.Random(1)
    noun = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda lang: " ".join(rng.choice(COMMON[lang]) if lang and rng.random() < 0.2 else noun() for _ in range(300))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de"] * 40)]
    rows += [(100, text(None), "en"), (101, text(None), "de"), (102, text("de"), "en"), (103, text("en"), "de"), (104, " ".join(noun() for _ in range(50)), "en")]
    got = {r["doc_id"]: r for r in quality_rules.divergence_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(80)) and got[104]["kept"]
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(100, 104))


def test_common_words(spark):
    """Lists are learned from whole texts of enough characters, ties by the word; null and empty lang are one; languages of few texts have no word distance."""
    long = " ".join(["The the ab"] * 30 + ["cd"] * 40 + ["ef"] * 30)
    rows = [(1, long, "xx"), (2, "zz " * 20, "xx"), (3, long, None), (4, "cd " * 100, ""), (5, None, "yy"), (6, "", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["of"]: r["list"] for r in quality_rules.common_words(docs, n_common=3).collect()}
    assert got == {"xx": ["the", "cd", "ab"], "": ["cd", "the", "ab"]}
    out = quality_rules.divergence_rules(docs).collect()
    assert len(out) == 6 and all(r["word_distance"] is None for r in out)


def test_whole_texts_are_scanned_once_for_classes(spark):
    """Classes are counted in what one pass over the text leaves; counts are those of a count by character."""
    text = "Ab c\tÑñ 42 #|x\n\x0b\r\x0c é$ Zz-Z.\U0001f600 <q>"
    docs = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "abc", "en")], "doc_id long, text string, lang string")
    rows = quality_rules.histograms(quality_rules.base_rules(docs), quality_rules.common_words(docs))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(text") == 1
    got = {r["doc_id"]: r for r in rows.collect()}
    white, signs = " \t\n\x0b\x0c\r", "#*$%&|<>"
    counts = [sum("a" <= c <= "z" for c in text), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text), sum(c > "\x7f" for c in text), sum(c in white for c in text), sum(c in signs for c in text)]
    assert got[1]["classes"] == [x / len(text) for x in [*counts, len(text) - sum(counts)]]
    assert (got[1]["word_chars"], got[1]["n_symbols"]) == (len(text) - counts[4], counts[5])
    assert got[2]["classes"] == [0.0] * 7 and got[3]["classes"] == [1.0] + [0.0] * 6 and got[3]["word_chars"] == 3
