"""Secret scans, with DataFrame functions only: corpus-wide ownership frequency.

Candidates are found by patterns in each whole text, with their places: a text is split at a pattern, and the lengths of the pieces
and of the matches between them add up to where each match starts and ends. The base kinds (assign, access, hex) are always
reported. Two more kinds, vendor-prefixed tokens and long runs that mix digits with small and capital letters, are only
candidates. Every candidate's value is hashed, and over the whole corpus each hash's distinct repositories and owners are
counted: values of `wide` or more owners, or in `copied` or more repositories, are widely copied examples; others are owner-specific and look live. Candidates of the further kinds
are added as spans if they look live and overlap no candidate of a kind before theirs.

Only candidates leave the text's row: places and hashes, in the shared folder. Distinct pairs of hash and owner are combined before the
shuffle, so a value that a third of all rows hold is no one task's work. Counts are written as a table of their own before they meet candidates again, so that join has a
shuffle of its own, in which the skew join can split a frequent value. Texts and values themselves are never shuffled.

A null or empty text has no spans. Rows are apart even if they share a doc_id. A null owner, or repository, counts as one, apart from an empty one. An empty table gives no
rows; further columns are not read. Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: kind: (pattern, group of the value, length that the value needs, what a text needs for the pattern to be tried)
_VALUE = "[A-Za-z0-9+/_.=-]+"
KINDS = {
    "assign": (rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?({_VALUE})", 1, 12, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14}"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
    "vendor": (r"(?:gh[opsu]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|ya29\.|npm_|hf_|SG\.|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20, r"(?:gh[opsu]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|ya29\.|npm_|hf_|SG\.|eyJ)[A-Za-z0-9_.-]{16}"),
    "mixed": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9A-Z+/_=-]*[a-z])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}", 0, 24, "[A-Za-z0-9+/_=-]{24}"),
}
BASE = ("assign", "access", "hex")
_SPAN = "array<struct<start: long, end: long, rank: int, hash: long>>"


def located(text: Column, kind: str) -> Column:
    """The kind's matches in text, as an array of (start, end, rank of the kind, hash of the value)."""
    pattern, group, least, needed = KINDS[kind]
    rank = F.lit([*KINDS].index(kind))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), rank.alias("rank"), F.xxhash64(part["value"]).alias("hash"))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(part["value"]) >= least, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.when(text.rlike(needed), F.aggregate(parts, zero, step, lambda state: state["spans"])).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, owner, repository, spans) of each row, written to the shared folder; row tells rows apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository"), F.col("`text`").cast("string").alias("text"), *keep)
    spans = F.concat(*(located(text, kind) for kind in KINDS))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", *keep, spans.alias("spans"))


def ownership(found: DataFrame, wide: int = 3, copied: int = 10) -> DataFrame:
    """(hash, owners, repositories, live): how many distinct owners and repositories hold each candidate value."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c)
    each = found.select(named("owner"), named("repository"), F.explode("spans").alias("x")).select("owner", "repository", F.col("x.hash").alias("hash"))
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = each.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash").withColumn("live", (F.col("owners") < wide) & (F.col("repositories") < copied))


def verdicts(found: DataFrame, wide: int = 3, copied: int = 10) -> DataFrame:
    """found with spans that tell (start, end, rank, live) in order, candidates of the further kinds dropped where they count for nothing."""
    each = found.filter(F.size("spans") > 0).select(F.col("row").alias("of"), F.explode("spans").alias("x")).select("of", "x.*")
    judged = each.join(shared.cut(ownership(found, wide, copied)), "hash")
    lists = judged.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "live", "owners", "repositories"))).alias("judged"))
    added = lambda x: (x["rank"] >= len(BASE)) & x["live"] & ~F.exists("judged", lambda b: (b["rank"] < x["rank"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]))
    lists = lists.select("of", F.filter("judged", lambda x: (x["rank"] < len(BASE)) | added(x)).alias("judged"))
    return found.drop("spans").join(lists, F.col("row") == F.col("of"), "left").drop("of")


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.coalesce(F.array_join(listed, ","), F.lit(""))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = 3, copied: int = 10) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples) of each row."""
    judged = F.coalesce("judged", F.array().cast("array<struct<start: long, rank: int, end: long, live: boolean, owners: long, repositories: long>>"))
    out = verdicts(shared.cut(scan(docs, owner, repository)), wide, copied).select("doc_id", judged.alias("judged"))
    of_rank = lambda k: lambda x: x["rank"] == k
    counted = lambda test: F.size(F.filter("judged", test)).cast("long")
    return out.select(
        "doc_id",
        *(counted(of_rank(k)).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(_text(F.filter("judged", lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"),
        _text(F.col("judged")).alias("spans"),
        counted(lambda x: x["live"]).alias("n_live"),
        counted(lambda x: ~x["live"]).alias("n_examples"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = 3, copied: int = 10, mark: str = "[secret]") -> DataFrame:
    """docs with every span that looks live replaced by mark in text, and n_chars (where docs has it) counted anew; other rows as they were."""
    columns = docs.columns
    found = shared.cut(scan(docs.withColumn("_hash", F.xxhash64("text")), owner, repository, keep=("_hash",)))
    live = F.filter("judged", lambda x: x["live"])
    cuts = verdicts(found, wide, copied).filter(F.size(live) > 0).groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of")).agg(F.first(live).alias("_live"))  # rows alike in both have the same spans
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(state: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - state["at"]).cast("int"))
        fresh = F.when(x["start"] >= state["at"], F.concat(state["text"], before, F.lit(mark))).otherwise(state["text"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), fresh.alias("text"))

    rest = lambda s: F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    joined = docs.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_of")), "left")
    text = F.when(F.col("_live").isNull(), F.col("text")).otherwise(F.aggregate("_live", zero, step, rest))
    out = joined.withColumn("_text", text)
    chars = F.when(F.col("_live").isNull(), F.col("n_chars")).otherwise(F.length("_text")).cast("long") if "n_chars" in columns else None
    return out.select(*(F.col("_text").alias("text") if c == "text" else chars.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: secrets in every whole text of `documents`, owned by their source."""
    return secrets(shared.table(spark, sf_dir, "documents"))
