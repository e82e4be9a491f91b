"""Quality rules, with DataFrame functions only: distribution divergence.

Each text has two histograms: of character classes (small and capital letters, digits, white space, signs, symbols, others), and of
its language's common words and all other words. The common words of a language are learned: the `n_common` that occur most often, in small letters, in its
whole texts of at least `min_chars` characters (ties by the word). Each language's reference is the mean histogram, over the whole corpus, of its texts that pass the base rules
and the length guards. A text is rejected if a base rule fails, or if the Jensen-Shannon distance (base 2, so 0 to 1) of a
histogram from its language's reference is over its limit. The limit of words is `common_share` of the distance at which a text without
any common word of its language lies from the reference (`max_common` at most), so lacking them is enough to be rejected. Guards: characters count from `min_chars` on, words from
`min_words` on; shorter texts have no reliable histogram and pass. A language of fewer than `min_texts` texts in its reference has none of words, as words of single texts would pass for common ones.

Everything but the references is within a row. Histograms are written once (a few numbers a text); their sums are combined before the
shuffle, as are the counts of words (of which each task passes on only its most frequent ones of a language), and a list or reference is one row a language, broadcast only if there are at most MAX_LANGUAGES of them.

Repeated 5-word windows are found within a row by sorting the windows' 64-bit hashes with their places. Null or empty texts have no words and fail
the base rule. A null or empty lang is a language of its own. Repeated rows each give theirs, an empty table none;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MAX_LANGUAGES = 1000
_SPLIT = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeated(windows: Column) -> Column:
    """Of sorted (hash, place): the places whose hash stands twice or more, sorted."""
    flagged = F.transform(windows, lambda x, k: F.when((F.get(windows, k - 1)["hash"] == x["hash"]) | (F.get(windows, k + 1)["hash"] == x["hash"]), x["place"]))
    return F.array_sort(F.filter(flagged, lambda p: p.isNotNull()))


def base_rules(docs: DataFrame, window: int = 5) -> DataFrame:
    """(doc_id, lang, text, words, bare, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each row. bare: the text without a-z and white space, in which other characters are counted; it is short."""
    rows = shared.one_pass(docs, {"doc_id": "long", "lang": "string", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", F.filter(F.split("text", _SPLIT), lambda w: w != ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("rest", F.regexp_replace("text", "[a-z]+", "")).withColumn("bare", _without(F.col("rest"), _SPACES))
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))) > 0)
    rows = rows.withColumn("lines", F.when(F.contains("text", F.lit("\n")), lines))
    places = F.when(F.col("n_words") >= window, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (window - 1)), lambda i: F.xxhash64(F.slice("words", i, window))))
    rows = rows.withColumn("hashes", places)
    twice = F.size("hashes") > F.size(F.array_distinct("hashes"))
    rows = rows.withColumn("windows", F.when(twice, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))))
    zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(_repeated(F.col("windows")), zero, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(window), p - s["last"])).cast("long").alias("n")), lambda s: s["n"])
    rows = rows.select(
        "doc_id",
        "lang",
        "text",
        "words",
        "n_words",
        "bare",
        (F.length("text") - F.length("rest") + F.length("bare")).cast("long").alias("word_chars"),
        (F.length("bare") - F.length(_without(F.col("bare"), _SYMBOLS))).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def common_words(docs: DataFrame, n_common: int = 12, min_chars: int = 200) -> DataFrame:
    """(of, list): each language's most frequent words, the most frequent first."""
    texts = shared.one_pass(docs, {"lang": "string", "text": "string"}).filter(F.length("text") >= min_chars)
    words = texts.select(F.coalesce("lang", F.lit("")).alias("of"), F.explode(F.split(F.lower("text"), _SPLIT)).alias("word")).filter("word != ''")
    ranked = words.groupBy("of", "word").count().withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("count"), "word")))
    lists = ranked.filter(F.col("rank") <= n_common).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("list"))
    return lists.select("of", F.col("list.word").alias("list"))


def _small(frame: DataFrame) -> DataFrame:
    """A table with a row a language, written; to be broadcast only where it is known to be small."""
    frame = shared.cut(frame)
    return F.broadcast(frame) if frame.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES else frame


def histograms(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds `classes`, shares of character classes, and `common`, shares of all other words and of each of the language's common ones, to what base_rules gives."""
    kept = lambda others: F.length(F.regexp_replace("bare", others, "")).cast("long")
    n = F.length("text").cast("long")
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit(""))).join(lists, F.col("lang") == F.col("of"), "left").drop("of")
    rows = rows.withColumns({"n_chars": n, "small": F.col("word_chars") - F.length("bare"), "capital": kept("[^A-Z]+"), "digits": kept("[^0-9]+"), "others": kept(r"[\x00-\x7F]+"), "white": n - F.col("word_chars")})
    rows = rows.withColumn("listed", F.filter(F.transform("words", F.lower), lambda w: F.array_contains("list", w)))
    rows = rows.withColumn("counts", F.transform("list", lambda c: (F.size("listed") - F.size(F.array_remove("listed", c))).cast("double")))
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    signs = F.col("n_chars") - F.col("small") - F.col("capital") - F.col("digits") - F.col("others") - F.col("white") - F.col("n_symbols")
    parts = [F.col(c).cast("double") for c in ("small", "capital", "digits", "others", "white", "n_symbols")]
    share = lambda x, of: F.transform(x, lambda v: v / F.greatest(of.cast("double"), F.lit(1.0)))
    rows = rows.withColumn("classes", share(F.array(*parts, signs.cast("double")), F.col("n_chars")))
    return rows.withColumn("common", share(F.concat(F.array(F.col("n_words") - total), "counts"), F.col("n_words"))).drop("text", "words", "bare", "list", "listed", "counts", "small", "capital", "digits", "others", "white")


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two histograms, base 2: 0 if equal, 1 if nothing is shared, null if one of them is null."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    whole = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.when(whole > 0, whole).when(whole <= 0, F.lit(0.0)))


def divergence_rules(docs: DataFrame, max_classes: float = 0.28, max_common: float = 0.45, min_chars: int = 200, min_words: int = 60, common_share: float = 0.9, n_common: int = 12, min_texts: int = 30) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance) of each row; distances are null where a guard holds."""
    rows = shared.cut(histograms(base_rules(docs), _small(common_words(docs, n_common, min_chars))))
    sound = rows.filter(~F.col("base_failed") & (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words))
    means = lambda name, size: F.array(*(F.avg(F.get(name, F.lit(k))) for k in range(size)))
    refs = sound.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"), means("classes", 7).alias("ref_classes"), means("common", n_common + 1).alias("ref_common"))
    refs = refs.withColumn("ref_common", F.when(F.col("n") >= min_texts, F.filter("ref_common", lambda x: x.isNotNull()))).drop("n")
    none = F.transform("ref_common", lambda x, k: F.when(k == 0, 1.0).otherwise(0.0))  # of a text without common words
    refs = _small(refs.withColumn("word_limit", F.least(F.lit(max_common), F.lit(common_share) * distance(none, F.col("ref_common")))))
    out = rows.join(refs, F.col("lang") == F.col("of"), "left")
    out = out.withColumn("class_distance", F.when(F.col("n_chars") >= min_chars, distance(F.col("classes"), F.col("ref_classes"))))
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= min_words, distance(F.col("common"), F.col("ref_common"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_classes) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the rules over every whole text of `documents`; distances are shown to six digits, verdicts use them in full."""
    out = divergence_rules(shared.table(spark, sf_dir, "documents"))
    return out.withColumns({name: F.round(name, 6) for name in ("class_distance", "word_distance")})
