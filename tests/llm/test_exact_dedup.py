"""Exact dedup against a plain grouping, and what its plan does."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.llm.common import Workspace
from parley.llm.exact_dedup import WORDS, deduplicated, exact_duplicates, group_filter, passed


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    base = [" ".join(draw.choice(["tür", "a", "bb", " ", "c\x0b", "long" * 30]) for _ in range(draw.randrange(1, 30))) for _ in range(150)]
    rows = [(i, draw.choice(base).replace(" ", draw.choice([" ", "  ", "\n", "\t\r"]))) for i in range(600)]
    # Equal lengths and beginnings, other ends; one text that a third of all rows have.
    rows += [(600 + i, "same beginning " * 40 + f"{i % 7:03d}") for i in range(60)] + [(700 + i, "hot \n text") for i in range(400)]
    return [*rows, (-1, None), (-2, ""), (-3, " \n "), (2000, "x" * 300_000), (2001, "x" * 300_000 + " "), (2002, "x" * 299_999 + "y")]


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i))
    return {i: (min(groups[bare(t)])[1], len(groups[bare(t)]), min(groups[bare(t)])[1] == i, hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("bits", [1 << 26, 64 * WORDS])
def test_against_plain_groups(spark, texts, bits):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = exact_duplicates(docs, digest=True, filter_bits=bits)
    assert got.columns == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()} == plain(texts)
    one = exact_duplicates(docs.coalesce(1), digest=True, texts=False, prefix=3)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in one.collect()} == plain(texts)
    assert deduplicated(docs).count() == len({bare(t) for _, t in texts})


def test_filter_has_every_group_and_few_others(spark):
    rows = spark.range(20_000).withColumn("size", F.col("id").cast("int"))
    some = group_filter(rows.filter("id % 40 = 0").select("size"), ["size"], 1 << 22)
    some = Workspace(spark, "filter-test").table(some, "f")
    assert some.count() <= (1 << 22) // (64 * WORDS)
    told = passed(rows, some, ["size"], 1 << 22, "ok").filter("ok")
    assert told.filter("id % 40 = 0").count() == 500 and told.count() < 510


def test_only_rows_of_groups_are_hashed_and_none_moves_alone(spark):
    rows = [(i, f"text number {i} " * (i % 50 + 1)) for i in range(500)] + [(1000 + i, "copies") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_duplicates(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    # Rows that are alone come from a scan by a broadcast; only suspects, which were written, are exchanged.
    assert all("text" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert got.filter("NOT kept").count() == 2


def test_edges(spark):
    schema = "doc_id long, text string, keep_id string, kept string, _size string, n string"
    rows = [(1, "a b", "x", "x", "x", "x")] * 3 + [(None, "ab", "x", "x", "x", "x"), (2, "a\tb ", "y", "x", "x", "x"), (None, None, "z", "x", "x", "x"), (5, "ab", "z", "x", "x", "x")]
    docs = spark.createDataFrame(rows, schema)
    got = exact_duplicates(docs).collect()
    by = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["group_size"]), r["keep_id"], r["kept"]) for r in got)
    assert by == [((False, 1, 6), 2, False)] * 3 + [((False, 2, 6), 2, True), ((False, 5, 6), 2, False), ((True, 0, 1), None, True), ((True, 0, 6), 2, False)]
    # Of equal rows one stays.
    same = exact_duplicates(spark.createDataFrame(rows[:3], schema)).select("kept").collect()
    assert sorted(r[0] for r in same) == [False, False, True]
    assert exact_duplicates(docs.limit(0)).count() == 0
    assert deduplicated(docs).columns == docs.columns
    assert {tuple(r) for r in deduplicated(docs).select("doc_id", "keep_id").collect()} == {(2, "y"), (None, "z")}
