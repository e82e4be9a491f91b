"""Rows that share an id, values at the edge of ownership, markup that is odd and long, runs of select, scratch folders."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from tessellar.llm import components, decontaminate, html_extract, near_copies, secret_scan, shared, simhash, token_files, tokens


def test_rows_that_share_an_id(spark):
    """Hits are a row's own, whatever other rows have its doc_id."""
    window = "a b c d e f g h"
    rows = [(1, f"x {window} y"), (1, "one two three four five six"), (1, f"x {window} y"), (None, window), (None, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, window), (8, window), (None, "x")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == [(0, 0, 0, 0, False), (0, 8, 8, 2, True), (1, 6, 0, 0, False), (1, 10, 8, 2, True), (1, 10, 8, 2, True), (2, 0, 0, 0, False)]
    kept = decontaminate.keep_clean(docs, items)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (1, "one two three four five six"), (2, "")]


def test_ownership(spark):
    """Owners, repositories, verdicts and added spans against sets of plain Python; values at one to three owners and up to twelve repositories."""
    rng = random.Random(6)
    value = lambda: "ghp_" + "".join(rng.choice("abcdefghijkmnopqrstuvwxyz0123456789") for _ in range(20)) + "Q"
    rows, owners, repositories = [], collections.defaultdict(set), collections.defaultdict(set)
    for n_owners, copies in [(1, 1), (2, 2), (3, 3), (1, 9), (1, 10), (2, 12), (4, 4)]:
        v = value()
        for k in range(copies):
            owner = [None, "", "o1", "o2"][k % n_owners]
            owners[v].add(owner)
            repositories[v].add(len(rows))
            rows.append((len(rows), f"use {v} now" + f" AKIAABCDEFGHIJKLMN{len(rows) % 2}" * (k == 0), owner))
    got = {r["doc_id"]: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        v = text.split()[1]
        live = len(owners[v]) < 3 and len(repositories[v]) < 10
        spans = [m for m in got[i]["spans"].split(",") if m.startswith("vendor")]
        assert spans == ([f"vendor:4:{4 + len(v)}"] if live else []), (i, len(owners[v]), len(repositories[v]))
        starts = [int(s.split(":")[1]) for s in got[i]["spans"].split(",") if s]
        assert starts == sorted(starts) and got[i]["n_access"] == text.count("AKIA")
        base = ",".join(f"access:{m.start()}:{m.end()}" for m in re.finditer("AKIA[A-Z0-9]+", text))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert len({len(o) for o in owners.values()}) == 4


def test_between():
    """Surges and dives by their definition, line by line."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        masses = rng.choice([0, 0, 3, 40, 300, 900], rng.integers(0, 30)).astype(float)
        window, floor, lead = int(rng.integers(1, 5)), float(rng.choice([0, 30])), float(rng.choice([0, 10]))
        threshold = max(floor, float(rng.choice([0, 50, 600])))
        block = [sum(masses[i : i + window]) for i in range(len(masses))]
        want, inside, run = [False] * len(masses), False, []
        for i, m in enumerate(masses):
            if inside and block[i] <= floor:
                inside = False
            if not inside and m > lead and block[i] > threshold and block[i] > floor:
                inside, run = True, []
            if inside:
                run.append(i)
                if m > lead:
                    for k in run:
                        want[k] = True
                    run = []
        assert html_extract.between(masses, window, threshold, floor, lead).tolist() == want


def test_marks_are_a_prior():
    story = "".join(f"<p>{w * 60}</p>" for w in ("alpha ", "beta ", "gamma "))
    assert html_extract.extract(f"<div>{story}</div><article class='card'><p>See also</p></article>").startswith("alpha")  # cards say nothing
    assert html_extract.extract(f"<div>Short note</div><main><h1>T</h1>{story}<p>S.</p></main><div>Odd end</div>").split("\n")[0::4] == ["T", "S."]
    assert html_extract.extract(f"<article>{story}</article><article class='comment'><p>{'no ' * 50}</p></article>").count("\n") == 2
    page = f"<main><p>tiny</p><p>{'long ' * 90}</p><p>{'long ' * 90}</p><p>tiny</p></main>"
    assert html_extract.extract(page) != html_extract.extract(page, window=1, share=0.9)


@pytest.mark.parametrize("page", ["<a " * 100_000, "</div>" * 100_000, "<div>" * 30_000 + "</x>" * 100_000, "<i>" * 30_000 + "<h1></h1>" * 30_000, "<a '\">" * 50_000, "<b><article>" + "<i>" * 30_000 + "</b>" * 50_000, '<a "' * 100_001 + ">", "<li><i>" * 20_000])
def test_odd_markup_takes_linear_time(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 4  # some tenths of a second, of a machine that is not busy


def test_select_of_runs():
    rng = random.Random(8)
    for n in (1, 255, 256, 257, 3000):
        numbers = np.cumsum([rng.choice([0, 0, 2, 9, 70_000]) for _ in range(n)]).astype(np.uint64)
        coded = token_files.EliasFano.of(numbers)
        for _ in range(30):
            a = rng.randrange(0, n + 1)
            b = rng.randrange(a, n + 1)
            assert coded.span(a, b).tolist() == numbers[a:b].tolist()


def test_pivots_link_altered_copies(spark):
    """Each altered copy is like the text it is made of and unlike other copies; all end in one group, by candidates in proportion to rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(160)]
    texts = [" ".join(base)]
    for _ in range(150):
        other = list(base)
        for at in rng.sample(range(4, 156, 8), 3):
            other[at] = word()
        texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    like = lambda a, b: len(a & b) / len(a | b)
    near = {i for i, g in enumerate(grams) if like(g, grams[0]) >= 0.8}
    assert len(near) > 100 and sum(like(grams[i], grams[j]) >= 0.8 for i in range(1, 40) for j in range(1, i)) < 39 * 19 / 4
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert {i for i, c in got.items() if c == 0} >= near


def test_scratch(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert shared.written(spark.range(3), path).count() == 3
    shared.remove(spark, path)
    assert not (tmp_path / "t").exists()

    class Elsewhere:
        master = "spark://somewhere:7077"
        getConf = lambda self: self
        get = lambda self, *_: None
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = conf = Elsewhere()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.scratch_dir(Session())


def test_no_link_is_left_out(spark):
    """Texts under 0.8 to most others, in whose buckets others are the pivots, and copies each like only the text it is made of: the groups of a comparison of all pairs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(160)]
    made = []
    for k in range(280):
        other = list(base if k < 250 else made[k - 250])
        for at in rng.sample(range(2, 157, 5), 2 if k < 250 else 3):
            other[at] = word()
        made.append(other)
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in made]
    group = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            n = len(grams[i] & grams[j])
            if 5 * n >= 4 * (len(grams[i]) + len(grams[j]) - n) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(made)], "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(made))] == group


def test_prefixes_and_sketches():
    """Sets at the similarity share a key, whatever is known as frequent; their sketches differ in no more bits than the sets in shingles."""
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 500]:
        for similarity in (0.5, 0.8, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = int(rng.integers(0, n + 1))
            b = np.unique(np.concatenate((a[: n - gone], rng.integers(0, 1 << 63, int(rng.integers(0, n))).astype(np.uint64))))
            known = np.sort(rng.permutation(a)[: n // 2])
            counts = rng.integers(3, 9, len(known))
            common, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if common >= similarity * either and common:
                assert len(np.intersect1d(near_copies.prefix_of(a, similarity, known, counts), near_copies.prefix_of(b, similarity, known, counts)))
            bits = near_copies.sketch_of(a) ^ near_copies.sketch_of(b)
            assert sum(int(x).bit_count() for x in bits.view(np.uint64)) <= either - common


def test_estimates_do_not_grow_with_steps(spark):
    """A long chain takes many steps; what the driver holds of a plan stays as it is after one."""
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long").repartition(8, "a")
    roots = components.components(links)
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(i, 0) for i in ids}
    assert roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


def test_kept_words_have_one_limit():
    """Words at a line's start, behind a space and of odd white space count together; ids are the same after a new start."""
    encode, plain = tokens.Encoder(tokens.default_path(), keep_words=40), tokens.Encoder(tokens.default_path())
    for k in range(60):
        text = "\n".join(f"h{k}{i} t{k}{i}" for i in range(6)) + "  x" * (k % 3 == 0)
        assert encode.raw(text) == plain.raw(text)
        assert sum(map(len, (encode.heads, encode.tails, encode.chunks))) <= 40 + 13


def test_keys_of_the_same_nodes_are_one_bucket(spark):
    """Texts that share a passage share all its keys: one bucket with their number, whatever the passage's length; and a key that other nodes have stands by itself."""
    members = spark.createDataFrame([(k, node, 9) for k in range(50) for node in (1, 2, 3)] + [(50, 1, 9), (50, 2, 9), (51, 1, 9), (52, 4, 9), (52, 5, 9)], "key long, node long, size long")
    got = sorted((r["key"], r["node"], r["n"], r["weight"]) for r in near_copies.merged_buckets(members).collect())
    assert got == [(0, node, 3, 50) for node in (1, 2, 3)] + [(50, 1, 2, 1), (50, 2, 2, 1), (52, 4, 2, 1), (52, 5, 2, 1)]


def test_sample_grows_with_texts(spark, monkeypatch):
    """A passage in a tenth of the texts is known as frequent however many texts there are for each of the least sample."""
    monkeypatch.setattr(near_copies, "SAMPLE", 5)
    line = "this line stands in one text of ten"
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(20)) + f" {line}" * (k % 10 == 0)) for k in range(800)], "doc_id long, text string")
    keys, counts = near_copies.frequent_shingles(docs, docs, 5)
    passage = near_copies.shingle_sets([line.encode()], 5)[0]
    assert len(passage) == 4 and np.isin(passage, keys).all() and counts.min() >= near_copies.LEAST


def rows_of_joins(frame):
    """How many rows each inner join in the frame's plan makes."""
    frame.collect()
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if name in ("SortMergeJoinExec", "ShuffledHashJoinExec", "BroadcastHashJoinExec") and plan.joinType().toString() == "Inner":
                found.append(plan.metrics().apply("numOutputRows").value())
            todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return found


def test_open_buckets_make_rows_of_early_keys(spark, monkeypatch):
    """Long texts with sentences from one pool that no sample shows to be frequent: two texts make a row only where a shared key has as many shingles behind it as they must have in common; counted keys then leave no pair."""
    monkeypatch.setattr(near_copies, "LEAST", 1000)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    pool = [[word() for _ in range(8)] for _ in range(60)]
    texts = [" ".join([w for s in rng.sample(pool, 30) for w in s] + [word() for _ in range(800)]) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = near_copies.prints_of(docs, 5)
    members = near_copies.bucket_members(docs, prints, 5, 0.8)
    none = spark.createDataFrame([], "node long, root long")
    pairs = near_copies.open_candidates(members, prints, none, 0.8)
    sets = [near_copies.shingle_sets([t.encode()], 5)[0] for t in texts]
    firsts = [{k: r for r, k in enumerate(near_copies.prefix_of(x, 0.8, np.zeros(0, np.uint64), np.zeros(0, np.int64)).tolist())} for x in sets]
    buckets = {}
    for k in {k for x in firsts for k in x}:
        held = tuple(i for i, x in enumerate(firsts) if k in x)
        buckets.setdefault(held, []).append(k)
    every, early, either = 0, 0, set()
    for held, keys in buckets.items():
        first = min(keys, key=lambda k: firsts[held[0]][k])
        for i, j in itertools.combinations(held, 2):
            every += 1
            if min(len(sets[i]) - firsts[i][first], len(sets[j]) - firsts[j][first]) >= (len(sets[i]) + len(sets[j])) * 4 / 9 - 1e-6:
                early += 1
                either.add((i, j))
    assert 0 < early < 0.7 * every and pairs.count() == len(either)
    assert max(rows_of_joins(pairs)) == early
    assert near_copies.sharing_enough(pairs, members, 0.8).count() == 0


def test_shared_keys_are_counted_by_weight(spark):
    """Of two texts of 100 shingles, 89 are in common at 0.8; 79 stand behind the keys of one, so ten keys decide, in however many buckets they are."""
    pairs = spark.createDataFrame([(1, 100, 2, 100), (1, 100, 3, 100), (2, 100, 3, 100), (3, 100, 4, 100)], "a long, size_a long, b long, size_b long")
    rows = [(7, 1, 9), (7, 2, 9), (-8, 1, 1), (-8, 2, 1), (9, 1, 9), (9, 3, 9), (5, 2, 4), (5, 3, 4), (6, 2, 6), (6, 3, 6)]
    members = spark.createDataFrame(rows, "key long, node long, weight long")
    assert sorted(map(tuple, near_copies.sharing_enough(pairs, members, 0.8).collect())) == [(1, 2), (2, 3)]


def test_replicas_are_not_broadcast(spark):
    """Spark takes all replicas of the fingerprints for about as many rows as there are fingerprints, so their join must be dealt out however small it looks; the links stay right."""
    rng = random.Random(4)
    fps = {rng.getrandbits(63) for _ in range(40)}
    fps |= {x ^ (1 << k) for x in fps for k in (3, 40)}
    prints = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long").groupBy("fp").count()
    found = simhash.links(prints)
    assert sorted({tuple(r) for r in found.collect()}) == [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 2]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
