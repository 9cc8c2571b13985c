"""The compressed index against a plain look-up, by batches and merged."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.operators import postings as P
from parley.sources import transcripts as sources


@pytest.fixture(scope="module")
def talk(spark):
    draw = random.Random(2)
    rows = [(d, p, "K", " ".join(draw.choice(["the", "river", "of", "old", "stone", "a"]) for _ in range(draw.randrange(12))), "f") for d in range(60) for p in range(draw.randrange(9))]
    return sources.from_rows(spark, [*rows, (1 << 40, 3, "K", "the river", "f")]).cache()


def plain(talk):
    out = defaultdict(set)
    for r in talk.collect():
        words = [w for w in r["tokenized"].split() if len(w) > 1]
        for t in [*words, *(" ".join(x) for x in zip(words, words[1:], strict=False))]:
            out[t].add((r["doc_id"], r["pos"]))
    return out


def test_batches_and_merged(spark, talk, tmp_path):
    want = plain(talk)
    index = P.PostingIndex(spark, f"file://{tmp_path}/index")
    for part in (F.col("doc_id") < 20, F.col("doc_id").between(20, 40), F.col("doc_id") > 40):
        index.add(talk.filter(part))
    merged = index.merge(f"file://{tmp_path}/merged")
    rebuilt = P.packed(P.postings(talk))
    everything = sorted((t, *x) for t, own in want.items() for x in own)
    for blocks in (index.blocks(), merged.blocks(), rebuilt):
        assert sorted(map(tuple, P.unpacked(blocks).collect())) == everything
        assert blocks.filter(F.col("n") > 128).isEmpty() and blocks.agg(F.sum("n")).first()[0] == len(everything)
    assert merged.blocks().count() <= index.blocks().count()
    for x in (index, merged):
        assert sorted(map(tuple, x.find("The river").collect())) == sorted(want["the river"])
        assert sorted(map(tuple, x.find("the", 10, 30).collect())) == sorted(h for h in want["the"] if 10 <= h[0] <= 30)
        assert x.find("unheard").count() == 0


def test_a_look_up_reads_its_blocks(spark, talk, tmp_path):
    index = P.PostingIndex(spark, f"file://{tmp_path}/index")
    index.add(talk)
    whole, own = index.blocks(), index.blocks().filter("term = 'the river'")
    assert 0 < own.count() < whole.count()
    plan = index.find("the river", 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,the river)" in plan and "GreaterThanOrEqual(last_doc,5)" in plan
