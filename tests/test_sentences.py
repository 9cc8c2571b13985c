"""Word tokens, sentences, and the tables that tell abbreviations."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.functions import tokenise as K
from parley.operators import segment
from parley.operators import sentences as S
from parley.plans.asof import around

TALK = [
    "Mr. Smith met Dr. Jones at 5 p.m. yesterday. They left.", "Dr. Smith of the U.S. Army came. It was Mr. Brown. He said no.", "I saw Mr. White and Dr. Green. Why? The end... maybe. And so... it goes.",
    "J. Smith walked away. Then he left!", "we met mr. smith. they saw him", 'He said "Stop." Then left. (It was late.) Done',
]


@pytest.mark.parametrize(("text", "want"), [
    ("Don't say \"we can't, really\" -- it's $5.50, or 1,000,000 (approx.) at 10:30!", ["Do", "n't", "say", '"', "we", "ca", "n't", ",", "really", '"', "--", "it", "'s", "$", "5.50", ",", "or", "1,000,000", "(", "approx.", ")", "at", "10:30", "!"]),
    ("Mr. O'Neil's dogs' house... can't wait, eh?", ["Mr.", "O'Neil", "'s", "dogs", "'", "house", "...", "ca", "n't", "wait", ",", "eh", "?"]),
    ("Cannot! 'Tis gonna be,, fine.", ["Can", "not", "!", "'T", "is", "gon", "na", "be", ",", ",", "fine", "."]),
    ("He lives in the U.S.", ["He", "lives", "in", "the", "U.S", "."]),
    ("a b c’s “quoted.”", ["a", "b", "c", "’s", "“", "quoted", ".", "”"]),
    ("", []), (" \t ", []), ("\x1f", []),
])
def test_word_tokens(spark, text, want):
    row = spark.createDataFrame([(text,)], "s string").select(K.tokens(F.col("s")).alias("t"), K.pieces(F.col("s")).alias("p")).first()
    assert row["t"] == want and "".join(row["p"]) == text.replace("\x1f", " ")


def test_offsets_give_the_text_back(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice(["word", "don't", " ", "  ", ".", "...", ",", "'", '"', "U.S.", "5:30", "(", ")", "\t", "é", "?!", "--"]) for _ in range(60)) for _ in range(80)]
    u = spark.createDataFrame(list(enumerate([*texts, *TALK])), "doc_id long, text string").withColumn("pos", F.lit(0).cast("long"))
    found = S.sentences(u).cache()
    at = {r["doc_id"]: r["text"] for r in u.collect()}
    for r in found.collect():
        assert at[r["doc_id"]][r["begin"] : r["begin"] + len(r["text"])] == r["text"]
    got = S.word_tokens(found).collect()
    kept = Counter()
    for r in got:
        assert at[r["doc_id"]][r["begin"] : r["begin"] + len(r["token"])] == r["token"]
        kept[r["doc_id"]] += len(r["token"])
    assert all(kept[i] == len(re.sub(r"\s", "", t)) for i, t in at.items())


def talk(spark):
    return spark.createDataFrame([(i, 0, x) for i, x in enumerate(TALK * 3)], "doc_id long, pos long, text string")


def test_sentences_with_abbreviations(spark):
    u = talk(spark)
    learned = S.learn(u)
    short = {r["type"] for r in learned.abbreviations.filter("is_abbreviation").collect()}
    assert {"mr", "dr", "p.m", "u.s"} <= short and not {"left", "brown", "goes"} & short
    got = [[r["text"] for r in S.split(u, learned).filter(f"doc_id = {i}").orderBy("sent").collect()] for i in (0, 2, 3, 4, 5)]
    assert got[0] == ["Mr. Smith met Dr. Jones at 5 p.m. yesterday.", "They left."]
    assert got[1][:2] == ["I saw Mr. White and Dr. Green.", "Why?"] and "And so... it goes." in got[1]
    assert got[2] == ["J. Smith walked away.", "Then he left!"]
    assert got[3] == ["we met mr. smith.", "they saw him"]
    assert got[4] == ['He said "Stop."', "Then left.", "(It was late.)", "Done"]


def test_ratios_by_hand(spark):
    u = talk(spark)
    counts = {r["type"]: r for r in S.type_counts(S.profile(u)).collect()}
    n = sum(r["n_dotted"] + r["n_plain"] for r in counts.values())
    stops = sum(r["n_dotted"] for r in counts.values())
    for r in S.abbreviations(S.type_counts(S.profile(u))).collect():
        a, b = r["n_dotted"], r["n_plain"]
        ll = lambda p, a=a, b=b: a * math.log(p) + (b * math.log(1 - p) if b else 0)
        inner = r["type"].count(".")
        letters = len(r["type"]) - inner
        assert math.isclose(r["score"], 2 * (ll(0.99) - ll(stops / n)) * math.exp(-letters) * (inner + 1) * letters**-b, rel_tol=1e-9, abs_tol=1e-12)


def test_as_of(spark):
    draw = random.Random(4)
    left = [(draw.randrange(3), i, draw.randrange(50)) for i in range(60)]
    right = [(draw.randrange(3), draw.randrange(50)) for _ in range(20)]
    got = around(spark.createDataFrame(left, "k int, i int, at int"), spark.createDataFrame(right, "k int, at int"), ["k"], "at").collect()
    assert len(got) == 60
    for r in got:
        own = [x for k, x in right if k == r["k"]]
        assert r["before"] == max((x for x in own if x <= r["at"]), default=None) and r["after"] == min((x for x in own if x > r["at"]), default=None)


def test_ranks_of_sentences(spark):
    """The gain orders sentences as the decomposition with all its directions does."""
    draw = random.Random(9)
    for _ in range(6):
        found = [" ".join(draw.choice(["sun", "moon", "tide", "rock", "Sun"]) for _ in range(draw.randrange(1, 12))) for _ in range(9)]
        got = [r[0] for r in spark.createDataFrame(list(enumerate(found)), "i int, s string").orderBy("i").select(segment.gain(F.col("s"))).collect()]
        rank = segment.lsa_rank(found, 99, 0.4)
        assert max(abs((rank[i] ** 2 - rank[j] ** 2) - (got[i] - got[j])) for i in range(9) for j in range(9)) < 1e-9
    assert spark.createDataFrame([("...",)], "s string").select(segment.gain(F.col("s"))).first()[0] == -1


def test_summaries(spark):
    rows = [(1, 0, "Mr. Hill saw the sea. The sea saw Mr. Hill and the sea and the hill. No. | Yes"), (1, 1, ""), (2, 0, "Only one")]
    segmented = spark.createDataFrame(rows, "doc_id long, seg long, text string")
    for topics in (None, 3):
        got = {(r["doc_id"], r["seg"]): r["sentence"] for r in segment.summaries(segmented, topics=topics).collect()}
        assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[1, 1] == "" and got[2, 0] == "Only one" and "sea" in got[1, 0]
