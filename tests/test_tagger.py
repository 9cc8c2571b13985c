"""The tagger against sums and maxima over all taggings, and on sentences with known names."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parley.operators import tagger as G


def taggings(left, slots, right, pairs):
    """(tags, chance) of every way to tag a piece."""
    for tags in itertools.product(*[(G.NAME, s[2]) for s in slots]):
        way = [left, *tags, right]
        chance = math.prod(pairs.get(p, 0.0) for p in itertools.pairwise(way))
        yield tags, chance * math.prod(s[0] if t == G.NAME else s[1] for s, t in zip(slots, tags, strict=True))


@pytest.fixture(scope="module")
def pieces():
    draw = random.Random(6)
    out = []
    for _ in range(200):
        pairs = {(a, b): draw.random() for a in G.FROM for b in G.TO}
        slots = [(draw.random(), draw.random(), draw.choice("WF")) for _ in range(draw.randrange(1, 8))]
        out.append((draw.choice(G.FROM), slots, draw.choice(G.TO), pairs))
    return out


def test_forward_backward_against_enumeration(pieces):
    for left, slots, right, pairs in pieces:
        ways = list(taggings(left, slots, right, pairs))
        whole = sum(c for _, c in ways)
        z, chances, seen = G.forward_backward(left, slots, right, pairs)
        assert math.isclose(z, math.log(whole), abs_tol=1e-9)
        for k, (as_name, as_small) in enumerate(chances):
            assert math.isclose(as_name, sum(c for t, c in ways if t[k] == G.NAME) / whole, abs_tol=1e-9) and math.isclose(as_name + as_small, 1, abs_tol=1e-9)
        want = defaultdict(float)
        for t, c in ways:
            for p in itertools.pairwise([left, *t, right]):
                want[p] += c / whole
        assert all(math.isclose(seen.get(p, 0), x, abs_tol=1e-9) for p, x in want.items())


def test_viterbi_against_enumeration(pieces):
    for left, slots, right, pairs in pieces:
        ways = dict(taggings(left, slots, right, pairs))
        assert math.isclose(ways[tuple(G.viterbi(left, slots, right, pairs))], max(ways.values()))


def test_long_pieces():
    pairs = {(a, b): 0.2 for a in G.FROM for b in G.TO}
    z, chances, _ = G.forward_backward("<", [(1e-5, 1e-6, "W")] * 5000, ">", pairs)
    assert math.isfinite(z) and len(chances) == 5000 and len(G.viterbi("<", [(1e-5, 1e-6, "W")] * 5000, ">", pairs)) == 5000


PEOPLE = ["Ann Miller", "Robert Brown", "Kathy", "London", "New York", "Thomas"]


@pytest.fixture(scope="module")
def found(spark):
    draw = random.Random(1)
    verbs, nouns = ["went to", "saw", "met", "spoke with"], ["the river", "a house", "the old bridge", "some friends"]
    texts, planted = [], Counter()
    for _ in range(400):
        name, k = draw.choice(PEOPLE), draw.random()
        planted[name] += 1
        if k < 0.4:
            texts.append(f"{name} {draw.choice(verbs)} {draw.choice(nouns)}.")
        elif k < 0.7:
            texts.append(f"{draw.choice(['Yesterday', 'However', 'The man', 'My friend', 'Fishing'])} {draw.choice(verbs)} {name} near {draw.choice(nouns)}.")
        else:
            texts.append(f"We liked fishing yesterday, however the friend of {name} {draw.choice(verbs)} {draw.choice(nouns)} (I saw 3).")
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate([*texts, "", "...", "no capitals here"])], "doc_id long, pos long, text string").cache()
    return df, G.reduced(df), planted


def test_names_are_found_and_the_likelihood_rises(found):
    df, corpus, planted = found
    fitted = G.fit(corpus, 3)
    assert all(b >= a - 1e-6 * abs(a) for a, b in itertools.pairwise(fitted.likelihoods)) and fitted.likelihoods[1] > fitted.likelihoods[0]
    got = {r["entity"]: r["n"] for r in G.decoded(corpus.slots, fitted).select("n", F.explode(G.names(F.col("tokens"), F.col("tags"))).alias("entity")).groupBy("entity").agg(F.sum("n").alias("n")).collect()}
    assert got == dict(planted)
    mentions = Counter(r["entity"] for r in G.entity_mentions(df, fitted).collect())
    assert mentions == planted


def test_chances_sum_up_to_one(found):
    """Over words that are only ever tagged for certain, and over those of pieces."""
    df, corpus, _ = found
    one = G.fit(corpus, 1)
    words = {(r["word"], r["tag"]): r for r in one.words.collect()}
    marked = F.transform(G.K.tokens(F.col("text")), lambda x, i: F.struct(F.lower(x).alias("w"), G.certain_tag(x, i).alias("t")))
    small = Counter(tuple(r) for r in df.select(F.explode(marked).alias("s")).select("s.*").filter("t IN ('W', 'F')").collect())
    for t in "WF":
        alone = sum(n for k, n in small.items() if k[1] == t and k not in words)
        in_pieces = sum(w["as_small"] for k, w in words.items() if k[1] == t)
        assert 0 <= in_pieces < 1 and alone / (1 - in_pieces) >= sum(n for k, n in small.items() if k[1] == t) - 1e-6
    assert math.isclose(sum(w["as_name"] for w in words.values()), 1, abs_tol=1e-9)
    for a in G.FROM:
        assert math.isclose(sum(one.pairs[a, b] for b in G.TO), 1, abs_tol=1e-9)


def test_nothing_to_tag(spark):
    none = spark.createDataFrame([], "doc_id long, pos long, text string")
    assert G.entity_counts(none, 1).count() == 0
