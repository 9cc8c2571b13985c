"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import language_id, pii, quality, warc
from parley.llm.common import Workspace
from parley.llm.decontam import decontaminate, find_items
from parley.llm.line_dedup import drop_frequent_lines
from parley.llm.mixing import mix, mixed_documents
from parley.llm.near_dedup import near_duplicates
from parley.llm.substrings import repeated_passages
from parley.llm.topk import top_k

CLASHES = "n_lines n_words spans lang_pred score keep tail rejected n_email batch hash id text2 hits key bags label rep n epoch mix_epoch _raw _text".split()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])
LONG = "wort " * 300_000


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    same = "the quick brown fox jumps over the lazy dog again and again"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, same, "en", "a", 1), (3, same, "en", "a", 1), (4, same, "en", None, None), (None, same, "en", "b", 3),
        (5, LONG, "de", "b", len(LONG)), (6, "\n\n \n", None, "b", 4), (7, "!!! ??? 123", "fr", "c", 5), (8, "ein kurzer satz über häuser", "de", "c", 6), (-9, "x" * 2_000_000, "en", "c", 7), (10, "\x00 \U0001f600 emoji", "en", "d", 8),
    ]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_line_dedup(spark, odd, none):
    got = drop_frequent_lines(odd, min_docs=4).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_lines"], by[1]["text"], by[6]["n_lines"], by[6]["text"]) == (1, "", 4, "\n\n \n")
    assert by[3]["n_dropped"] == by[4]["n_dropped"] == by[None]["n_dropped"] == 1 and by[4]["text"] == ""
    assert drop_frequent_lines(none).count() == 0
    assert drop_frequent_lines(odd, report=False).columns == odd.columns


def test_decontamination(spark, odd, none):
    bench = items(spark, [(1, "brown fox jumps"), (2, None), (3, ""), (4, "brown fox jumps"), (None, "the quick brown"), (1, "brown fox jumps"), (5, "wort " * 12)])
    got = {r["doc_id"]: r for r in find_items(odd, bench).select("doc_id", "n_words", "n_hit", "n_items", "contaminated", "spans").collect()}
    assert (got[3]["n_hit"], got[3]["n_items"], got[3]["n_words"]) == (3, 2, 12)
    assert got[5]["n_hit"] == got[5]["n_words"] == 300_000 and got[5]["spans"] == [[0, 300_000]]
    assert got[1]["n_words"] == got[2]["n_words"] == 0 and got[-9]["n_words"] == 1
    assert find_items(none, bench).count() == 0 and not find_items(odd, items(spark, [])).filter("contaminated").count()
    kept = decontaminate(odd, bench, min_span=1)
    assert kept.columns == odd.columns and kept.count() == 11  # the long text is hit all over
    assert kept.filter("doc_id = 4").first()["text"] == "the quick  over the lazy dog again and again"
    assert find_items(odd, bench, shard_words=5).select("doc_id", "n_hit", "n_items").exceptAll(find_items(odd, bench).select("doc_id", "n_hit", "n_items")).count() == 0


def test_language_id(spark, odd, none):
    model = language_id.fit(odd)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model, 0.01).select("doc_id", "lang_pred", "score", "rejected").collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[6]["lang_pred"] == got[7]["lang_pred"] == "und" and got[7]["rejected"]
    assert got[8]["lang_pred"] == "de" and got[3]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    empty = language_id.fit(none)
    assert {r[0] for r in language_id.identify(odd, empty).select("lang_pred").collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_quality(spark, odd, none):
    ratings = spark.createDataFrame([(3, 2), (4, 0), (8, 1), (None, 2), (5, None), (3, 2), (99, 1)], "doc_id long, grade int")
    model = quality.fit(odd, ratings, 2)
    got = quality.rate(odd, model, 2).select("doc_id", "expected_grade", "tail", "keep").collect()
    assert len(got) == 12 and all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    assert quality.rate(none, model, 2).count() == 0
    unfit = quality.fit(none, spark.createDataFrame([], "doc_id long, grade int"), 2)
    assert {r[0] for r in quality.rate(odd, unfit, 2).select("tail").collect()} == {0.5}


def test_near_dedup(spark, odd, none):
    got = {r["id"]: r for r in near_duplicates(odd).collect()}
    assert got[4]["class_id"] == got[3]["class_id"] == 3 and got[None]["class_id"] is None
    assert all(got[i]["class_id"] == i for i in (1, 2, 5, 6, 7, 8, -9, 10))
    assert near_duplicates(none).count() == 0


def test_near_dedup_links_all_texts_of_an_id(spark):
    words = [f"w{i}" for i in range(200)]
    base, other = " ".join(words), " ".join(f"v{i}" for i in range(150))
    near = " ".join([*words[:100], "x", *words[101:]])
    rows = [(3, base), (2, near), (2, other), (2, other), (9, other), (9, None), (4, "alone"), (None, base)]
    got = {r["id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 2, 2: 2, 9: 2, 4: 4, None: None}


def test_mixing(spark, odd, none):
    plan = mix(odd, max_repetition=2.0)
    assert {r[0] for r in plan.select("id").distinct().collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8, -9, 10}
    every = mixed_documents(odd, max_repetition=1.0)
    assert every.count() == 12 and set(every.columns) > set(odd.columns) - {"mix_epoch"}
    noted = odd.withColumn("mix_note", F.lit("mine"))
    assert {r[0] for r in mixed_documents(noted, max_repetition=1.0).select("mix_note").collect()} == {"mine"}
    assert mix(none, max_repetition=2.0).count() == 0
    assert mixed_documents(odd, max_repetition=1.0).count() > 0


def test_substrings(spark, odd, none):
    assert repeated_passages(none).count() == 0
    assert repeated_passages(odd).count() == 0
    base = " ".join(f"w{i}" for i in range(120))
    docs = table(spark, [(1, base, "en", "a", 1), (2, "other words " + base + " tail", "en", "a", 1), (2, None, "en", "a", 1), (None, base, "en", "a", 1), (3, base, None, None, None)])
    got = repeated_passages(docs)
    rows = got.collect()
    assert {(r["id"], r["start_word"], r["end_word"]) for r in rows} == {(1, 0, 120), (2, 2, 122), (3, 0, 120)} and {r["rep_id"] for r in rows} <= {1, 2}
    # Texts of one id, of which one is a part of another document.
    words = [f"v{i}" for i in range(400)]
    docs = table(spark, [(1, " ".join(words), None, None, None), (2, " ".join(words[50:350]), None, None, None), (2, " ".join(f"u{i}" for i in range(60)), None, None, None)])
    assert {(r["id"], r["start_word"], r["end_word"]) for r in repeated_passages(docs).collect()} == {(1, 50, 350), (2, 0, 300)}


def test_warc(spark, odd):
    path = Workspace(spark, "warc-test").path + "/a"
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/\r\nX: y", "", "x"), (3, "u", "é<p>", "x"), (None, "u", "é<p>", "x"), (3, "u", "é<p>", "x"), (-4, "v", "é<p>", "x"), (5, "w", LONG, "x")], "page_id long, url string, html string, type string")
    warc.write_pages(pages, path)
    got = warc.read_warc(spark, path, verify=True).select(warc.page_id(F.col("record_id")).alias("p"), "type", warc.page_id(F.col("refers_to")).alias("r"), "payload_length", "target_uri").collect()
    assert sorted((r["p"] is None, r["p"] or 0, r["type"], r["r"]) for r in got if r["p"] != 3) == [(False, -4, "response", None), (False, 1, "response", None), (False, 2, "revisit", 1), (False, 5, "response", None), (True, 0, "response", None)]
    assert [(r["type"], r["r"], r["payload_length"]) for r in got if r["p"] == 3] == [("revisit", -4, 5)] * 2
    assert {r["payload_length"] for r in got if r["p"] in (1, 2)} == {0} and "X: y" in next(r["target_uri"] for r in got if r["p"] == 2)
    warc.write_pages(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_pii(spark, odd, none):
    field = pii.fit(odd)
    got = {r["doc_id"]: r for r in pii.find_pii(odd, field).select("doc_id", "spans", "base_sha256", "n_email").collect()}
    assert got[1]["spans"] == got[2]["spans"] == got[7]["spans"] == "" and got[1]["base_sha256"] == pii.NOTHING
    assert pii.find_pii(none, pii.fit(none)).count() == 0
    hard = table(spark, [(1, "1" * 100_000 + " " + "+1" * 50_000 + "@" * 1000 + "a" * 200_000 + "@b", "en", "a", 1)])
    assert pii.find_pii(hard, field).first()["n_email"] == 0


def test_top_k(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], None), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [float("inf"), 0.0], 1), (7, [-1.0], 1), (None, [1.0, 1.0], 1), (1, [0.0, 0.0], 1), (20, [], 1)]
    v = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in top_k(v, v.filter("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5120), (0, 2, 2, 5120), (0, 3, 1, 0), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 1, 0)]
    clashing = v.withColumns({c: F.lit("x") for c in ("rank", "score", "id", "query_id")})
    assert [tuple(r) for r in top_k(clashing, clashing.filter("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()] == got
    assert top_k(v.limit(0), v.limit(0)).count() == 0
