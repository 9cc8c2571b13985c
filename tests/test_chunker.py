"""Chunks and their weights against loops, and precision against runs of capitals."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parley.operators import chunker, sentences, stats

NAMES = ["Ann Miller", "Bank of England", "Kathy", "London", "New York", "Thomas", "University of York"]


@pytest.fixture(scope="module")
def talk(spark):
    draw = random.Random(3)
    verbs, nouns = ["went to", "saw", "met", "spoke with"], ["the river", "a house", "the old bridge", "some friends"]
    texts = []
    for _ in range(300):
        name, k = draw.choice(NAMES), draw.random()
        if k < 0.3:
            texts.append(f"{name} {draw.choice(verbs)} {draw.choice(nouns)}.")
        elif k < 0.6:
            texts.append(f"{draw.choice(['Yesterday', 'However', 'The man', 'My friend', 'Fishing', 'Nobody'])} {draw.choice(verbs)} {name} near {draw.choice(nouns)}.")
        else:
            texts.append(f"We liked fishing, and a friend of {name} {draw.choice(verbs)} {draw.choice(nouns)} (I saw it).")
    u = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "doc_id long, pos long, text string").cache()
    return u, sentences.word_tokens(sentences.sentences(u)).cache()


def plain_spans(words):
    """(begin, end, depth, parent) of one sentence."""
    cap = [bool(re.match("[A-Z]", w)) and w not in ("I", "A") for w in words]
    inside = [c or (w.lower() in chunker.CONNECTORS and 0 < i < len(words) - 1 and cap[i - 1] and cap[i + 1]) for i, (w, c) in enumerate(zip(words, cap, strict=True))]
    out, i = [], 0
    while i < len(words):
        if not inside[i]:
            i += 1
            continue
        e = i
        while e < len(words) and inside[e]:
            e += 1
        out.append((i, e, 0, None))
        b = i
        while b < e:
            if cap[b]:
                f = b
                while f < e and cap[f]:
                    f += 1
                if (b, f) != (i, e):
                    out.append((b, f, 1, i))
                b = f
            b += 1
        i = e
    return out


def test_spans_and_weights_by_loops(talk):
    _, tokens = talk
    lines = defaultdict(dict)
    for r in tokens.collect():
        lines[r["doc_id"], r["pos"], r["sent"]][r["i"]] = r["token"]
    lines = {k: [v[i] for i in range(len(v))] for k, v in lines.items()}
    found = chunker.spans(tokens).cache()
    got = sorted((r["doc_id"], r["pos"], r["sent"], r["begin"], r["end"], r["depth"], -1 if r["parent_begin"] is None else r["parent_begin"], r["entity"], r["left"], r["right"]) for r in found.collect())
    want, met, firsts = [], Counter(), Counter()
    for k, w in lines.items():
        for b, e, depth, parent in plain_spans(w):
            entity, left, right = " ".join(w[b:e]), w[b - 1].lower() if b else "^", w[e].lower() if e < len(w) else "$"
            want.append((*k, b, e, depth, -1 if parent is None else parent, entity, left, right))
            met[entity, "<", left] += 1
            met[entity, ">", right] += 1
            firsts[entity] += b == 0
    assert got == sorted(want)
    n = Counter(x[7] for x in want)
    own = {x: 1 - firsts[x] / n[x] for x in n}
    weight = dict(own)
    beside = {k: c for k, c in met.items() if k[1:] not in (("<", "^"), (">", "$"))}
    for _ in range(3):
        top, size = Counter(), Counter()
        for (x, *c), k in beside.items():
            top[tuple(c)] += k * weight[x]
            size[tuple(c)] += k
        told, seen = Counter(), Counter()
        for (x, *c), k in beside.items():
            told[x] += k * top[tuple(c)] / (size[tuple(c)] + 1)
            seen[x] += k
        weight = {x: (own[x] + told[x]) / (1 + seen[x]) for x in n}
    for r in chunker.weights(found).collect():
        assert r["n"] == n[r["entity"]] and abs(r["weight"] - weight[r["entity"]]) < 1e-9


def test_more_precise_than_runs_of_capitals(talk):
    u, tokens = talk
    true = {*NAMES, "Bank", "England", "University", "York"}
    share = lambda rows: sum(n for x, n in rows if x in true) / sum(n for _, n in rows)
    runs = share([(r["entity"], r["n"]) for r in stats.entity_counts(u).collect()])
    got = [(r["entity"], r["n"]) for r in chunker.entity_counts(tokens).collect()]
    assert set(NAMES) <= {x for x, _ in got} and share(got) > runs + 0.2 and share(got) > 0.85


def test_nested_names(talk):
    _, tokens = talk
    tree = chunker.entity_tree(tokens, least=0.0).filter("entity IN ('Bank of England', 'Bank', 'England')").groupBy("entity").agg(F.max("depth").alias("d"), F.count(F.lit(1)).alias("n"), F.count("parent_begin").alias("p")).collect()
    by = {r["entity"]: r for r in tree}
    assert by["Bank of England"]["d"] == 0 and by["Bank"]["d"] == by["England"]["d"] == 1
    assert by["Bank"]["p"] == by["England"]["p"] == by["Bank of England"]["n"]
