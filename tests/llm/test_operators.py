"""The operators against brute force, round trips and held-out rows."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import common, graph, language_id, mixing, near_dedup, pii, quality, substrings, topk, warc, words
from parley.llm.common import Workspace, attach, spread_join
from parley.llm.decontam import SuffixAutomaton, find_items, merged, scan, shards
from parley.llm.graph import components
from parley.llm.line_dedup import LineRuns, batches_of, drop_frequent_lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall(text.translate(LOWER))


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB9 é ß_-\n中") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    known: dict[str, int] = {}
    for first, hashes, offsets in words.Hasher().texts([t.encode() for t in texts] + [None]):
        for d in range(len(offsets) - 1):
            own = words_of(texts[first + d]) if first + d < len(texts) else []
            assert len(own) == offsets[d + 1] - offsets[d]
            for w, h in zip(own, hashes[offsets[d] : offsets[d + 1]].tolist(), strict=True):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(5000)).encode()
    (whole,) = [h for _, h, _ in words.Hasher().texts([text])]
    monkeypatch.setattr(words, "BLOCK", 1000)
    assert (words.Hasher().long(text) == whole).all()


def brute_windows(text, items, window):
    w, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(name)
    return len(w), len(hit), found


@pytest.mark.parametrize("seed", range(8))
def test_suffix_automaton(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(str(i), say(rng.randint(0, 9))) for i in range(12)]
    one = SuffixAutomaton([(n, [x.encode() for x in words_of(t)]) for n, t in items], 4)
    two = [SuffixAutomaton([(n, [x.encode() for x in words_of(t)]) for n, t in half], 4) for half in (items[:5], items[5:])]
    for _ in range(60):
        text = say(rng.randint(0, 25))
        n, spans, found = scan(one, text.encode())
        assert (n, sum(e - b for b, e in spans), found) == brute_windows(text, items, 4)
        parts = [scan(a, text.encode()) for a in two]
        assert merged([x for _, own, _ in parts for x in own]) == spans and set().union(*(names for *_, names in parts)) == found


def test_many_shards_and_spans_that_stay(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(str(i), say(rng.randint(0, 40))) for i in range(40)] + [("long", say(400)), ("short", "w1 w2 w3")]
    docs = [(i, " ".join([say(30), items[rng.randrange(42)][1][:120], say(20)])) for i in range(80)] + [(80, None), (81, "w1 w2 w3"), (81, "w1 w2 w3")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    ask = lambda n: sorted(map(repr, find_items(d, b, window=8, shard_words=n, min_span=5).collect()))
    few = find_items(d, b, window=8, shard_words=300, min_span=5).collect()
    assert shards(b, "item_id", "text", 8, 300, Workspace(spark, "t"))[1] > 4 and sorted(map(repr, few)) == ask(10**6)
    for r in few:
        assert (r["n_words"], r["n_hit"]) == brute_windows(r["text"] or "", items, 8)[:2]
        # Spans below the limit stay in the text, all others are cut.
        assert (r["clean_text"] is None) == all(y - x < 5 for x, y in r["spans"])
        if r["clean_text"]:
            assert len(words_of(r["clean_text"])) == r["n_words"] - sum(y - x for x, y in r["spans"] if y - x >= 5)


def test_line_runs_compact(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    rng, counts = random.Random(0), Counter()
    for _ in range(5):
        batch = [rng.randint(0, 12) for _ in range(12)]
        counts.update(batch)
        runs.add(spark.createDataFrame([(bytes([x]),) for x in batch], "hash binary"))
    assert all(len(level) < 2 for level in runs.levels)
    assert {bytes(r["hash"])[0] for r in runs.settled().collect()} == {x for x, n in counts.items() if n >= 3}


def test_every_batch_meets_all_runs(spark):
    runs = LineRuns(spark, min_docs=2, fanout=3)
    for b in range(6):
        runs.add(spark.createDataFrame([(bytes([7]),)] * 3 + [(bytes([100 + b]),)], "hash binary"))
    # One, two, then one merged run of three, and so on.
    assert runs.met == [0, 1, 2, 1, 2, 3]
    # The line was settled by the first batch; no later one counted it.
    assert [r["n"] for r in runs.settled().collect()] == [3]
    plan = runs.runs()[0].groupBy("hash").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_batches_grow_with_the_table():
    assert batches_of([(0, 4, 2), (1, 4, 1), (2, 9, 3), (3, 0, 0), (5, 1, 1)], 8) == [(0, 1 << 33), (2 << 33, (2 << 33) + 2), (3 << 33, 5 << 33)] and batches_of([], 5) == []
    assert len(batches_of([(i, 10, 5) for i in range(100)], 20)) == 50
    # One task's rows are cut too.
    assert batches_of([(0, 100, 10)], 25) == [(0, 1), (2, 4), (5, 6), (7, 9)]


def test_the_query_meets_runs(spark, monkeypatch):
    from parley.llm import line_dedup, queries

    made = []
    monkeypatch.setattr(line_dedup, "LineRuns", lambda *a: made.append(LineRuns(*a)) or made[-1])
    assert queries.op3_line_dedup(spark, "/root/testdata/sf0.01").count() == 1000
    assert len(made[0].met) >= 4 and made[0].met[:4] == [0, 1, 2, 3]


def test_lines_of_many_equal_rows(spark):
    rows = [(None, "Same\nown")] * 2500 + [(7, "same\nother"), (8, None)]
    got = Counter(map(tuple, drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2501, bucket_rows=1).select("doc_id", "text", "n_dropped").collect()))
    assert got == {(None, "own", 1): 2500, (7, "other", 1): 1, (8, "", 0): 1}


def test_bag_min_hash_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    agree = want = 0.0
    for t in range(60):
        values = rng.integers(1, 2**62, 30).astype(np.uint64)
        x, y = rng.integers(0, 7, 30), rng.integers(0, 7, 30)
        x[0] = y[0] = 3
        a = near_dedup.bag_min_hash(values[x > 0], x[x > 0], 128)
        b = near_dedup.bag_min_hash(values[y > 0], y[y > 0], 128)
        agree += (a == b).mean()
        want += np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs(agree - want) / 60 < 0.015


def bag_of(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: bag_of(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and bags[i] and bags[j]:
                n = (bags[i] & bags[j]).total()
                if n >= 0.8 * (bags[i] | bags[j]).total():
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    return {i: top(i) for i in texts}


def near_texts():
    rng = random.Random(4)
    texts, n = {}, 0
    for _ in range(25):
        base = [rng.choice("abcdefghijkl") + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 7)):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else "new" + str(rng.randint(0, 999)) for w in base]
            texts[n] = " ".join(copy)
            n += 1
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["id"]: r["class_id"] for r in got} == classes(texts)
    first = {}
    for i, t in texts.items():
        first.setdefault(tuple(words_of(t)), i)
    assert {r["id"]: r["copy_of"] for r in got} == {i: first[tuple(words_of(t))] for i, t in texts.items()}


def test_links_that_no_pivot_shows(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**62, 400).astype(np.uint64)
    edits = rng.integers(1, 2**62, (3, 60)).astype(np.uint64)
    # 1 is far from 2 and 3, which are near each other; 4 has nothing in common.
    bags = {1: base, 2: np.concatenate([base[60:], edits[0]]), 3: np.concatenate([base[60:], edits[0][:50], edits[1][:10]]), 4: edits[2]}
    members = spark.createDataFrame([(i, i, 0, 7, len(b)) for i, b in bags.items()], "id long, label long, k int, v long, size long")
    known = spark.createDataFrame([(i, np.sort(b).tobytes()) for i, b in bags.items()], "id long, bag binary")
    for block in (1 << 20, 800):
        near_dedup.BLOCK_BYTES, old = block, near_dedup.BLOCK_BYTES
        assert {(r["a"], r["b"]) for r in near_dedup.verify_groups(members, known, 0.8).collect()} == {(2, 3)}
        near_dedup.BLOCK_BYTES = old


def test_large_groups_of_boilerplate(spark, monkeypatch):
    """Documents that are alike in most of their text, in groups beyond the size of a block, against brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 6)
    rng = random.Random(9)
    say = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    line, texts = say(60), {}
    for i in range(90):
        own = say(rng.randint(18, 40))
        texts[3 * i] = " ".join(line + own)
        for j in range(rng.randint(0, 2)):
            texts[3 * i + j + 1] = " ".join(line + [w if rng.random() > 0.03 else "x" + w for w in own] + say(rng.randint(0, 3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == classes(texts)


def test_batches_are_bounded_in_rows_and_bytes(spark):
    bound = common.bound_batches
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    bound(spark)
    assert [int(spark.conf.get(k).removesuffix("b")) for k in keys] == [1000, 16 << 20]
    sizes = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) < 24 << 20


def test_overlaps_against_counters():
    rng = np.random.default_rng(5)
    bags = [np.sort(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    got = near_dedup.overlaps(bags, dense=6, width=16)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == (Counter(bags[i].tolist()) & Counter(bags[j].tolist())).total()


@pytest.mark.parametrize("bound", [0, 200_000])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "ONE_TASK", bound)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "x").collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components_beyond_one_task(spark):
    """More edges than one task takes: a long path, a star, a label of a third of all edges, and many small groups."""
    rng = random.Random(60)
    path = rng.sample(range(10**9), 2000)
    edges = list(zip(path, path[1:], strict=False))
    edges += [(2 * 10**9, 2 * 10**9 + 1 + i) for i in range(75_000)]
    hot = [3 * 10**9 + i for i in range(75_000)]
    edges += [(hot[rng.randrange(i)], hot[i]) for i in range(1, len(hot))]
    edges += [(4 * 10**9 + 3 * i + j, 4 * 10**9 + 3 * i + j + 1) for i in range(30_000) for j in range(2)]
    assert len(edges) > graph.ONE_TASK
    rng.shuffle(edges)
    a, b = np.array(edges).T
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    got = {(r["label"], r["node"]) for r in components(df, Workspace(spark, "cc"), "big").collect()}
    want = {(min(path), x) for x in path} | {(2 * 10**9, 2 * 10**9 + i) for i in range(75_001)} | {(hot[0], x) for x in hot} | {(4 * 10**9 + 3 * i, 4 * 10**9 + 3 * i + j) for i in range(30_000) for j in range(3)}
    assert got == want


def test_joins_of_frequent_keys(spark, monkeypatch):
    from parley.llm import common

    monkeypatch.setattr(common, "HEAVY_KEYS", 5)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    table = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("k < 30")
    want = sorted(tuple(r) for r in left.join(table.drop("n"), "k").collect())
    assert sorted(tuple(r) for r in attach(left, table, ["k"], 1000).collect()) == want
    assert sorted(tuple(r) for r in spread_join(left, table.drop("n"), "k", "id", 1000, share=20).collect()) == want


def test_language_of_held_out_texts(spark):
    rng = random.Random(7)
    alphabets = {"aa": "abcde é", "bb": "efghi j", "cc": "abklm z"}
    docs = [(i, "".join(rng.choices(alphabets[lang := rng.choice(list(alphabets))], k=rng.randint(30, 300))), lang) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(df.filter(~language_id.held_out()), per_language=60)
    got = language_id.identify(df, model).filter(language_id.held_out())
    assert got.filter("lang <> lang_pred").count() <= 0.02 * got.count()
    assert {r["doc_id"] for r in df.filter(language_id.held_out()).collect()} == {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_score_is_the_best_cosine():
    rng = np.random.default_rng(8)
    idf = rng.random(language_id.DIMS).astype(np.float32) + 1
    c = rng.random((3, language_id.DIMS)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    text = "some words in a row".encode()
    tf = np.bincount(language_id.codes(text), minlength=language_id.DIMS)
    v = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * idf, 0)
    lang, score = language_id.Model(["x", "y", "z"], idf, c).predict(text)
    assert abs(score - (c @ v / np.linalg.norm(v)).max()) < 1e-5 and lang == "xyz"[int((c @ v).argmax())]


def test_long_texts_count_as_short_ones(monkeypatch):
    text = "".join(random.Random(9).choices("abc é", k=5000)).encode()
    want = language_id.term_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 700)
    got = language_id.term_counts(text)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_quality_on_held_out_rows(spark):
    rng = random.Random(10)
    plain = [f"w{i}" for i in range(300)]

    def text(grade):
        own = rng.choices(plain, k=60) + (["vile"] * 2 if grade == 0 else []) + (["dull%%%"] * 25 if grade == 1 else [])
        rng.shuffle(own)
        return " ".join(own)

    docs = [(i, text(i % 3), i % 3) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, grade int")
    model = quality.fit(df, df.filter("doc_id < 600").select("doc_id", "grade"), 2)
    assert (np.diff(model.thresholds) >= 0).all()
    got = quality.rate(df.filter("doc_id >= 600"), model, 2)
    assert got.filter((F.col("grade") == 2) != F.col("keep")).count() <= 6
    means = [r[1] for r in got.groupBy("grade").agg(F.avg("expected_grade")).orderBy("grade").collect()]
    assert means == sorted(means)


def test_gradient_of_the_ordinal_model():
    rng = np.random.default_rng(0)
    x, y, theta = quality.Indicators([np.flatnonzero(r < 0.5) for r in rng.random((40, 3))], 3), rng.integers(0, 4, 40), rng.normal(0, 0.5, 6)
    _, slope = quality.objective(theta, x, y, 3, 0.5)
    for i in range(6):
        e = np.eye(6)[i] * 1e-6
        assert abs((quality.objective(theta + e, x, y, 3, 0.5)[0] - quality.objective(theta - e, x, y, 3, 0.5)[0]) / 2e-6 - slope[i]) < 1e-4


def test_quality_against_a_plain_version(spark):
    """Scores from the fitted weights by loops, and the fitted likelihood against steps away from it."""
    rng = random.Random(40)
    vocabulary = ["a" + chr(97 + i) + chr(97 + j) for i in range(10) for j in range(4)]
    docs = []
    for i in range(400):
        grade = rng.randint(0, 2)
        docs.append((i, " ".join(rng.choices(vocabulary[grade * 8 : grade * 8 + 24], k=rng.randint(1, 30))) + "!" * rng.randint(0, 3) * (grade == 0), grade))
    df = spark.createDataFrame(docs, "doc_id long, text string, grade int")
    model = quality.fit(df, df.select("doc_id", "grade"), 2, sample_rows=10**6, least=2.0)
    assert (model.weights != 0).sum() > 10 and model.thresholds[0] < model.thresholds[1]
    hasher = words.Hasher()
    bucket = {w: int(hasher.block(w.encode())[0][0] >> np.uint64(46)) for w in vocabulary}

    def ranges(text):
        said = words_of(text)
        shares = [sum(c.isupper() for c in text) / len(text), sum(c == "!" for c in text) / len(text), 1 - len(set(said)) / len(said), sum(x == y for x, y in zip(said, said[1:])) / (len(said) - 1) if len(said) > 1 else 0]
        return [quality.DIMS + i * 16 + sum(r <= x for r in quality.RANGES) for i, x in enumerate(shares)]

    sets = [sorted({bucket[w] for w in words_of(t)}) + ranges(t) for _, t, _ in docs]
    got = {r["doc_id"]: r for r in quality.rate(df, model, 2).collect()}
    for (i, *_), own in zip(docs, sets, strict=True):
        tails = [1 / (1 + math.exp(-(sum(float(model.weights[b]) for b in own) - float(t)))) for t in model.thresholds]
        assert abs(got[i]["expected_grade"] - sum(tails)) < 1e-4 and abs(got[i]["tail"] - tails[1]) < 1e-4

    def loss(weights, t):
        out = 0.1 * float((weights.astype(float) ** 2).sum())
        for (_, _, g), own in zip(docs, sets, strict=True):
            tail = [1.0, *(1 / (1 + math.exp(-(float(weights[own].sum()) - x))) for x in t), 0.0]
            out -= math.log(tail[g] - tail[g + 1])
        return out

    best, used = loss(model.weights, model.thresholds), np.flatnonzero(model.weights)
    noise = np.random.default_rng(3)
    for _ in range(15):
        w = model.weights.copy()
        w[used] += noise.normal(0, 0.05, len(used)).astype(np.float32)
        assert loss(w, model.thresholds + noise.normal(0, 0.02, 2)) > best - 1e-3


def test_rejection_is_by_the_training_scores_of_a_size(spark):
    rows = [("aa", 5, 0.4, 30), ("aa", 7, 0.8, 30), ("aa", 8, 0.1, 3), ("bb", 7, 0.6, 2)]
    least = language_id.least_scores(rows, [(5, 0.3, 60), (7, 0.7, 40)], ["aa", "bb", "aa"])
    assert np.allclose(least["aa"][4:9], np.array([0, 0.4, 0.4, 0.8, 0.8]) * language_id.REJECT) and np.allclose(least["bb"][4:9], np.array([0, 0.3, 0.3, 0.7, 0.7]) * language_id.REJECT)
    rng = random.Random(41)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))
    docs = [(i, say("abcd" if i % 2 else "efgh", 80), "aa" if i % 2 else "bb") for i in range(200)]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    # As far away as a text that mixes in letters never seen, though its cosine is well above 0.
    judged = [model.judge(t.encode()) for t in (say("abcd", 80), say("efgh", 80), say("abcdwxyz", 80), say("wxyz", 80))]
    assert [far for *_, far in judged] == [False, False, True, True] and judged[2][1] > 0.05


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(i * 250 + j, " ".join(letters[(j // 10) % 26] + letters[(j % 10) * 2] + letters[j % 25] for _ in range(4)), f"l{j:03}") for i in range(2) for j in range(250)]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), per_language=5, clusters=1)
    assert len(set(model.langs)) == 250


def test_mixing_against_a_plain_version(spark):
    rng = random.Random(42)
    docs = [(i if i % 11 else None, rng.choice(["a", "a", "a", "b", "b", None]), "w " * rng.randint(0, 12) + f"t{i}") for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    seed, size = 7, 90
    tokens = defaultdict(int)
    for _, source, text in docs:
        tokens[source] += max(1, len(text.split()))
    whole = sum(tokens.values())

    def repeated(t):
        total = sum(n**t for n in tokens.values())
        return max(n**t / total * 1.5 * whole / n for n in tokens.values())

    t = next(x for x in np.linspace(0, 1, 20_001) if repeated(x) <= 1.8)  # the flattest weights within the limit
    share = {s: n**t / sum(m**t for m in tokens.values()) * 1.5 * whole for s, n in tokens.items()}
    plan = [(s, n, int(share[s] // n), round(share[s] % n), -(-n // size)) for s, n in tokens.items()]
    own = df.withColumn("unit", mixing.unit_of("doc_id", "source", "text")).join(spark.createDataFrame(plan, "src string, n long, full int, rest long, blocks long"), F.col("source").eqNullSafe(F.col("src")))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    own = own.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(seed)), F.col("blocks"))).withColumn("bk", F.xxhash64(F.lit(seed), "full", name, "block")).withColumn("dk", F.xxhash64(F.lit(seed), "full", "unit"))
    rows, want = own.collect(), Counter()
    for s, _, full, rest, _ in plan:
        at = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["bk"], r["block"], r["dk"], r["unit"])):
            want[r["doc_id"], r["source"], r["text"]] += full + (at < rest)
            at += max(1, len(r["text"].split()))
    got = Counter(tuple(r) for r in mixing.mixed_documents(df, max_repetition=1.8, budget=1.5, block_tokens=size).select("doc_id", "source", "text").collect())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_mixing_exponent():
    tokens = [900.0, 50.0, 50.0]
    t = mixing.exponent(tokens, 0.8, None, 1000.0)
    assert abs(mixing.entropy_of(mixing.weights(tokens, t)) - 0.8 * np.log(3)) < 1e-6
    t = mixing.exponent(tokens, None, 2.0, None)
    q = mixing.weights(tokens, t)
    assert abs(max(mixing.budget_of(tokens, q) * x / n for x, n in zip(q, tokens, strict=True)) - 2) < 1e-6
    assert mixing.exponent(tokens, None, 1.0, 1000.0) == 1.0


def test_mixing_meets_its_budgets(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 > 0, "mid").otherwise("small").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"))
    plan = mixing.mix(docs, entropy=0.99, budget=0.7, block_tokens=500).cache()
    total = docs.agg(F.sum(F.col("doc_id") % 9 + 1)).first()[0]
    for r in plan.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.first("weight").alias("w")).collect():
        assert 0 <= r["n"] - r["w"] * total * 0.7 < 10
    again = mixing.mix(docs.repartition(7), entropy=0.99, budget=0.7, block_tokens=500)
    assert plan.exceptAll(again).count() == 0 and again.exceptAll(plan).count() == 0
    cover = mixing.mix(docs, max_repetition=3.0)
    per = cover.groupBy("id").count()
    assert per.count() == 2000 and per.agg(F.max("count")).first()[0] <= 3


def test_partial_epoch_is_a_prefix_of_its_order(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    full = {r["id"]: (r["block_key"], r["block"], r["doc_key"]) for r in mixing.mix(docs, budget=1.0, block_tokens=90).collect()}
    part = mixing.mix(docs, budget=0.4, block_tokens=90).collect()
    order = sorted(full, key=full.get)
    assert {r["id"] for r in part} == set(order[:120])


def brute_chain(m, k):
    best = [float(k)] * len(m)
    for i, (p, h) in enumerate(m):
        for j, (q, g) in enumerate(m[:i]):
            if q < p and g < h:
                best[i] = max(best[i], best[j] + k - substrings.GAP * ((p - q) + (h - g)))
    return max(best)


@pytest.mark.parametrize("seed", range(10))
def test_chaining(seed):
    rng = random.Random(seed)
    m = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)})
    top = substrings.chains(m, 4)[0]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(top, top[1:], strict=False))
    score = 4.0
    for (q, g), (p, h) in zip(top, top[1:], strict=False):
        score += 4 - substrings.GAP * ((p - q) + (h - g))
    assert abs(score - brute_chain(m, 4)) < 1e-9


def test_lcs():
    rng = random.Random(11)
    for _ in range(50):
        x, y = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
        assert substrings.lcs(x, y) == d[-1][-1]


def test_extents_against_single_rows():
    rng = np.random.default_rng(12)
    x, y = rng.integers(1, 3, (300, 40)).astype(np.uint32), rng.integers(1, 3, (300, 40)).astype(np.uint32)
    y[:200] = np.where(rng.random((200, 40)) < 0.85, x[:200], 9)
    ends = rng.integers(0, 41, (300, 2))
    for i, (a, b) in enumerate(ends):
        x[i, a:], y[i, b:] = 0, 0
    n, same = substrings.extents(x, y)
    for i, (a, b) in enumerate(ends):
        assert (n[i], same[i]) == substrings.outwards(x[i, :a], y[i, :b])[:2]


def test_minimisers():
    rng = np.random.default_rng(12)
    for n in (0, 1, 5, 16, 200):
        g = rng.integers(0, 2**63, n).astype(np.uint64)
        want = sorted({s + int(g[s : s + 16].argmin()) for s in range(max(1, n - 15))}) if n else []
        assert substrings.minimisers(g, 16).tolist() == want
    assert substrings.minimisers(np.full(100, 7, np.uint64), 16).tolist() == [0, 16, 32, 48, 64, 80]


def test_texts_that_repeat_themselves(spark):
    line, word = " ".join(f"w{i}" for i in range(31)), "der "
    docs = spark.createDataFrame([(1, f"{line} " * 12), (2, f"a b {line} " + f"{line} " * 11), (3, word * 700), (4, "x y " + word * 600)], "doc_id long, text string")
    got = {(r["id"], r["rep_id"], r["start_word"], r["end_word"]) for r in substrings.repeated_passages(docs).collect()}
    assert {i for i, *_ in got} == {1, 2, 3, 4} and len(got) < 150
    assert all(not (i == j and rep == own and (s, e) != (b, c) and s >= b and e <= c) for i, rep, s, e in got for j, own, b, c in got)


def test_planted_passages(spark):
    rng = random.Random(13)
    noise = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    passages = [noise(rng.randint(51, 200)) for _ in range(12)]
    docs, want = [], defaultdict(set)
    for i in range(80):
        p = rng.randrange(12)
        own = [w if rng.random() > 0.02 else "edit" for w in passages[p]] if i % 2 else passages[p]
        docs.append((i, " ".join(noise(rng.randint(0, 150)) + own + noise(rng.randint(0, 150)))))
        want[p].add(i)
    docs += [(100 + i, " ".join(noise(300))) for i in range(20)]
    got = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r["id"] for r in got}
    exact = {i for i in range(0, 80, 2) if sum(j % 2 == 0 for j in next(v for v in want.values() if i in v)) > 1}
    assert exact <= found and max(found) < 80
    assert all(next(p for p, v in want.items() if r["id"] in v) == next(p for p, v in want.items() if r["rep_id"] in v) for r in got)


def shared_windows(texts, size=50):
    """Places (id, word) of windows that texts of several ids have exactly, by window."""
    own = defaultdict(set)
    for i, t in texts:
        w = words_of(t)
        for p in range(len(w) - size + 1):
            own[tuple(w[p : p + size])].add((i, p))
    return [x for x in own.values() if len({i for i, _ in x}) > 1]


def test_passages_against_all_shared_windows(spark):
    """Every window of 50 words that several documents share lies in a passage of each, but for a few words at its end where their common hub
    has fewer; their documents are linked, and every passage is one."""
    rng = random.Random(18)
    noise = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    pool = [noise(rng.randint(12, 140)) for _ in range(30)]
    docs = []
    for i in range(220):
        parts = [rng.choice([noise(rng.randint(0, 60)), rng.choice(pool), rng.choice(pool)[rng.randint(0, 10) :]]) for _ in range(rng.randint(1, 6))]
        docs.append((i, " ".join(w for x in parts for w in x)))
    docs += [(220 + j, docs[j][1]) for j in range(8)]
    got = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    spans, root = defaultdict(set), {i: i for i, _ in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    said = {i: words_of(t) for i, t in docs}
    for r in got:
        spans[r["id"]].add((r["start_word"], r["end_word"]))
        root[top(r["id"])] = top(r["rep_id"])
        x, y = said[r["id"]][r["start_word"] : r["end_word"]], said[r["rep_id"]][r["rep_start"] : r["rep_end"]]
        row = [0] * (len(y) + 1)
        for u in x:
            last = 0
            for j, v in enumerate(y):
                row[j + 1], last = last + 1 if u == v else max(row[j + 1], row[j]), row[j + 1]
        assert min(len(x), len(y)) >= 50 and r["n_matched"] <= row[-1] and r["similarity"] >= 0.8 and abs(r["similarity"] - r["n_matched"] / max(len(x), len(y))) < 1e-9
    found = shared_windows(docs)
    assert len(found) > 500
    inside = [max((min(e, p + 50) - max(b, p) for b, e in spans[i]), default=0) for x in found for i, p in x]
    assert min(inside) >= 40 and sum(n == 50 for n in inside) >= 0.99 * len(inside)
    assert all(len({top(i) for i, _ in x}) == 1 for x in found)


def test_fuzzy_passages_are_found(spark):
    """Passages of which a fifth to a tenth of the words are changed, against nothing else in common."""
    rng = random.Random(14)
    noise = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    docs, n = [], 100
    for i in range(n):
        p = noise(rng.randint(60, 120))
        changed = set(rng.sample(range(len(p)), int(len(p) * rng.uniform(0.1, 0.18))))
        docs += [(i, " ".join(noise(80) + p + noise(80))), (n + i, " ".join(noise(70) + [w if j not in changed else "x" + w for j, w in enumerate(p)] + noise(90)))]
    got = {(r["id"], r["rep_id"]) for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i % n == rep % n for i, rep in got} == {True}
    assert sum((i, n + i) in got or (n + i, i) in got for i in range(n)) >= 0.85 * n


def test_seeds_are_shared_whatever_stands_around():
    rng = np.random.default_rng(15)
    for _ in range(30):
        core = rng.integers(0, 2**63, 50).astype(np.uint64)
        seeds = []
        for _ in range(2):
            x = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64), core, rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])
            grams, at = words.ngrams(x, np.array([0, len(x)]), 3)
            seed, first, gap = substrings.pairs_of(grams, at, 6)
            assert ((gap >= substrings.NEAR) & (gap < substrings.FAR)).all() and (first + gap < len(grams)).all()
            seeds.append(set(seed.tolist()))
        assert seeds[0] & seeds[1]


def test_first_places_over_batches():
    rng = random.Random(16)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 3), p, 20) for p in range(80))
    want = {(s, i, p, *min((j, q) for t, j, q, _ in rows if t == s)) for s, i, p, _ in rows if len({j for t, j, *_ in rows if t == s}) > 1}
    for size in (1, 2, 7, 100):
        batches = [substrings.rows_of([np.array(c) for c in zip(*rows[b : b + size], strict=True)], substrings.SEED) for b in range(0, len(rows), size)]
        got = [r for x in substrings.first_places(iter(batches)) for r in zip(*(x.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True)]
        assert len(got) == len(set(got)) and want <= set(got)


def test_frequent_seeds_meet_within_a_task(spark):
    rng = random.Random(17)
    noise = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    p = noise(70)
    docs = spark.createDataFrame([(i, " ".join(noise(10) + p + noise(10))) for i in range(300)], "doc_id long, text string").repartition(3)
    got = substrings.repeated_passages(docs).collect()
    assert {(r["id"], r["start_word"], r["end_word"]) for r in got} == {(i, 10, 80) for i in range(300)}
    assert len({r["rep_id"] for r in got}) <= 10 and len(got) < 600  # no pairs of all


def test_texts_of_one_id_and_copies(spark):
    """Rows that share an id count with each of their texts; copies are rows of the smallest id."""
    words = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:300])), (2, " ".join(f"v{i}" for i in range(60))), (5, "short"), (6, "short"), (7, " ".join(words)), (8, " ".join(words)), (9, " ".join(f"v{i}" for i in range(60)))]
    got = {(r["id"], r["start_word"], r["end_word"], r["rep_id"]) for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(7, 0, 400, 1), (8, 0, 400, 1), (9, 0, 60, 2)} <= got and {i for i, *_ in got} == {1, 2, 7, 8, 9}
    assert (1, 0, 300, 2) in got or (2, 0, 300, 1) in got


def test_warc_pushdown_and_plain_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 5}</p>" * 2000) for i in range(40)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_pages(pages, path)
    responses = warc.read_warc(spark, path, verify=True).filter("type = 'response'")
    assert sorted(bytes(r["payload"]).decode() for r in responses.collect()) == sorted(f"<p>{i}</p>" * 2000 for i in range(5))
    assert warc.read_warc(spark, path, payload=False).filter("payload is not null").count() == 0
    plan = responses._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan)
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("type",), "response"), EqualTo(("payload_length",), 5)])) == [EqualTo(("payload_length",), 5)]
    # The same records, uncompressed, and in gzip members without lengths.
    import gzip

    packed = [gzip.decompress(m.read_bytes()) for m in sorted((tmp_path / "a").glob("*.warc.gz"))]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(b"".join(packed))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records(b"".join(packed))))
    want = sorted(map(str, warc.read_warc(spark, path).collect()))
    assert sorted(map(str, warc.read_warc(spark, f"{tmp_path}/b").collect())) == want
    assert sorted(map(str, warc.read_warc(spark, f"{tmp_path}/c").collect())) == want


@pytest.mark.parametrize("kind", ["sized", "gzip", "plain"])
def test_truncated_archives_are_errors(spark, tmp_path, kind):
    rows = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:x:{i}>"}, f"page {i} ".encode() * 50, False) for i in range(4)]
    pack = {"sized": lambda x: warc.member(x, 6), "gzip": gzip.compress, "plain": bytes}[kind]
    whole = b"".join(map(pack, rows))
    name = "a.warc" if kind == "plain" else "a.warc.gz"
    (tmp_path / name).write_bytes(whole)
    assert warc.read_warc(spark, str(tmp_path)).count() == 4
    for cut in (len(whole) - 20, len(whole) - len(pack(rows[-1])) + 5):
        (tmp_path / name).write_bytes(whole[:cut])
        with pytest.raises(Exception, match="ends within|no WARC headers"):
            warc.read_warc(spark, str(tmp_path)).collect()


def records(data):
    while data:
        head, begin = warc.headers_of(data)
        end = begin + int(head["content-length"]) + 4
        yield data[:end]
        data = data[end:]


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(x):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(x)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(x) if 14 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(x) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15])


def test_base_spans():
    rng = random.Random(14)
    for alphabet in ("ab1@.-+ ()255", "0123456789 -+.", "a.@b-"):
        for _ in range(4000):
            x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(x) == brute_pii(x)
    assert pii.base_spans("card 4111 1111 1111 1111.") == [(5, 2, 24)]


@pytest.fixture(scope="module")
def field():
    return pii.learn([])


def test_added_spans(field):
    rng = random.Random(15)
    seen = [(0, "jo.5@mail.example.net"), (1, "10.9.200.30"), (2, "4111111111111111"), (3, "+1 (317) 555-7008")]
    hit = 0
    for i in range(200):
        kind, span = seen[i % 4]
        new = pii.rewritten(kind, span, rng)
        text = f"le mot {new} et la"
        hit += (7, kind, 7 + len(new)) in pii.base_spans(text) + pii.added_spans(text, pii.base_spans(text), field)
    wrong = sum(bool(pii.added_spans(f"le mot {pii.harmless(rng)} et la", [], field)) for _ in range(200))
    assert hit >= 120 and wrong <= 4


def test_recall_of_each_kind_and_precision(field):
    """Spans in other spellings, planted in prose with ``at``, dots, dates and numbers of its own."""
    rng = random.Random(50)
    prose = "he was at home. Then at 12.30 on 2019-04-05 the team met at the station . It cost 1,299.00 for order 445566 and version 1.2.3 of the tool".split(" ")
    hits, n = Counter(), 400
    for i in range(n):
        kind = i % 4
        span, at = pii.rewritten(kind, pii.made_up(kind, rng), rng), rng.randint(0, len(prose))
        before = " ".join(prose[:at] + ["x", ""])
        text = before + span + " y " + " ".join(prose[at:])
        base = pii.base_spans(text)
        new = pii.added_spans(text, base, field)
        hits[kind] += (len(before), kind, len(before) + len(span)) in base + new
        hits["wrong"] += sum(b < len(before) - 1 or e > len(before) + len(span) + 1 for b, _, e in base + new)
    assert all(hits[kind] >= 0.9 * n / 4 for kind in range(4)) and hits["wrong"] <= 0.02 * n, hits


def test_semi_markov_gradient():
    rng = np.random.default_rng(16)
    row = pii.example("call 555 0123 4567 or a@b.co now", [(5, 3, 18)])
    f = pii.Field()
    f.w[:], f.pair[:] = rng.normal(0, 0.3, pii.DIMS), rng.normal(0, 0.3, (5, 5))

    def likelihood():
        n, segs, truth = row
        total, own = [], {(i, j, y): float(f.w[x].sum()) for i, j, y, x in segs}

        def walk(at, last, score, cut):
            if at == n:
                total.append((score, tuple(cut)))
                return
            walk(at + 1, 4, score + f.pair[last, 4], cut)
            for (i, j, y), s in own.items():
                if i == at:
                    walk(j, y, score + s + f.pair[last, y], [*cut, (i, j, y)])

        walk(0, 4, 0.0, [])
        whole = np.logaddexp.reduce([s for s, _ in total])
        best = max(total)[1]
        return next(s for s, c in total if c == tuple(truth)) - whole, best

    parts, d_pair = f.gradient(*row)
    value, best = likelihood()
    assert tuple(f.decode(row[0], row[1])) == best
    f.pair[4, 3] += 1e-5
    assert abs((likelihood()[0] - value) / 1e-5 - d_pair[4, 3]) < 1e-3
    f.pair[4, 3] -= 1e-5
    at = int(parts[0][0][0])
    f.w[at] += 1e-5
    want = sum(c * int((x == at).sum()) for x, c in parts)
    assert abs((likelihood()[0] - value) / 1e-5 - want) < 1e-3


def test_masking():
    assert pii.mask("to a@b.co, 1.2.3.4", "email:3:9,ip:11:18") == "to <email>, <ip>"


def brute_top(ids, v, queries, k):
    out = []
    for q in queries:
        rows = sorted((-int(v[i] @ v[q]), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q])[:k]
        out += [(int(ids[q]), r + 1, d, -s) for r, (s, d) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("wide", [1.0, 1e4, 1e7])
def test_top_k_against_brute_force(spark, wide):
    rng = np.random.default_rng(17)
    x = (rng.normal(0, 0.2, (500, 12)) * wide).round(2)
    x[50] = x[70]
    v = np.floor(64 * x).astype(np.int64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), k=7, block_rows=130, query_rows=9).collect())
    assert got == brute_top(np.arange(500), v, range(0, 500, 20), 7)


def test_segments_descend_and_proofs_stop_early():
    rng = np.random.default_rng(18)
    v = rng.integers(-60, 60, (3000, 6))
    index = topk.Index(np.arange(3000), v)
    pairs = list(zip(index.dim.tolist(), index.level.tolist(), strict=True))
    assert pairs == sorted(pairs, key=lambda x: (x[0], -x[1])) and len(set(pairs)) == len(pairs)
    for (d, level), b, n in zip(pairs, index.starts, index.counts, strict=True):  # a posting per vector with this impact, and no other
        assert sorted((index.cells[b : b + n] // 6).tolist()) == np.flatnonzero(np.abs(v[:, d]) >> index.shift == level).tolist()
    for row, (ids, scores) in enumerate(index.search(v[:20], np.arange(20), 5, np.full(20, topk.NONE))):
        want = sorted((-int(v[i] @ v[row]), i) for i in range(3000) if i != row)[:5]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == want
    assert 0 < index.read < 0.8 * index.postings


def test_scores_so_far_spare_later_blocks():
    rng = np.random.default_rng(19)
    near, far = rng.integers(20, 60, (200, 8)), rng.integers(-3, 4, (2000, 8))
    blocks = [topk.Index(np.arange(200), near), topk.Index(np.arange(200, 2200), far)]
    [(ids, scores)] = topk.searched(blocks, near[:1], np.zeros(1, np.int64), 10)
    assert sorted(ids.tolist()) == sorted(sorted(range(1, 200), key=lambda i: (-int(near[i] @ near[0]), i))[:10])
    assert blocks[1].read <= 0.5 * blocks[1].postings + 2000  # one look


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest() == pii.NOTHING


def test_passages_whose_pieces_occur_before(spark):
    rng = random.Random(21)
    noise = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    docs, n = [], 20
    for i in range(n):  # every seed of a passage of 60 words has its first place in a text with 38 of them
        p = noise(60)
        own = [p[:38], p[22:], p, p]
        docs += [(j * n + i, " ".join(noise(40) + x + noise(40))) for j, x in enumerate(own)]
    got = {(r["id"], r["rep_id"], r["start_word"], r["end_word"]) for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(i, s, e) for i, _, s, e in got} == {(j * n + i, 40, 100) for i in range(n) for j in (2, 3)}
    assert all(rep % n == i % n and rep >= 2 * n for i, rep, *_ in got) and len(got) == 2 * n


def test_passages_far_beyond_their_seeds(spark):
    p = " ".join(f"w{i}" for i in range(60))
    docs = [(1, "x " + f"{p} " * 33), (2, "y z " + f"{p} " * 33), (3, "der " * 5000), (4, "der " * 3000)]
    got = {(r["id"], r["start_word"], r["end_word"]) for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(1, 1, 1981), (2, 2, 1982)} <= got and {(3, 0, 3000), (4, 0, 3000)} <= got


def test_every_place_of_a_passage(spark):
    rng = random.Random(22)
    noise = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    p = noise(60)
    twice, once = " ".join(p + noise(440) + p + noise(30)), " ".join(noise(20) + p + noise(20))
    for a, b in ((1, 2), (2, 1)):
        got = {(r["id"], r["start_word"], r["end_word"]) for r in substrings.repeated_passages(spark.createDataFrame([(a, twice), (b, once)], "doc_id long, text string")).collect()}
        assert {(a, 0, 60), (a, 500, 560), (b, 20, 80)} == got


@pytest.mark.parametrize("at", ["@", " @ ", " at ", " (at) ", " [at] ", " AT ", " (AT) "])
@pytest.mark.parametrize("dot", [".", " . ", " dot ", " [dot] ", " DOT ", " punkt "])
def test_addresses_without_digits_are_in_zones(at, dot):
    text = f"please write to john{at}example{dot}org today"
    tokens = [m.group() for m in pii._TOKEN.finditer(text)]
    assert pii.segments(tokens) and list(pii.zones(text)) == [(0, len(text))]


def test_addresses_without_digits_are_found(field):
    for new in ("ab.cd (AT) mail.example.com", "ab.cd (AT) mail punkt example punkt com"):
        assert pii.added_spans(f"mail {new} today and la", [], field) == [(5, 0, 5 + len(new))]
