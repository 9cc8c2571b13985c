"""The pipeline against a plain version of it, and on odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import language_id
from tests.llm.test_edges import LONG, table
from tests.llm.test_operators import LOWER, WORD, classes, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    alphabets = {"aa": "abcdeg", "bb": "hijklm"}
    items = [" ".join("".join(rng.choices("abcdeg", k=4)) for _ in range(14)) for _ in range(3)]
    docs, shared = [], ["Common Line here", "another common line"]
    for i in range(120):
        lang = rng.choice(list(alphabets))
        lines = [" ".join("".join(rng.choices(alphabets[lang], k=rng.randint(2, 6))) for _ in range(12)) for _ in range(rng.randint(2, 8))]
        if i % 4 == 0:
            lines.insert(1, shared[0].upper() if i % 8 else f"  {shared[0]}\r")
        if i % 30 == 0:
            lines.append(shared[1])
        if i % 17 == 0:
            lines[-1] += " x " + items[i % 3].title() + "! y"
        docs.append([i, "\n".join(lines), lang, f"s{min(3, i % 7)}", 0])
    for i in range(120, 150):
        words = docs[i - 100][1].split(" ")
        words[len(words) // 2] = "edited"
        docs.append([i, " ".join(words), docs[i - 100][2], "s1", 0])
    docs += [[150, items[0], "aa", "s1", 0], [151, "1234 !!", "aa", "s1", 0], [152, None, "aa", "s1", 0]]
    return [tuple(d) for d in docs], [(n, t) for n, t in enumerate(items)]


def plain(docs, items, model):
    kept = {d[0]: d for d in docs if d[1] is not None and re.search(r"[^\W\d_]", d[1]) and model.predict(re.sub(r"[^a-zA-Z]+", " ", d[1].lower()).encode())[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    have = defaultdict(set)
    for i, d in kept.items():
        for line in d[1].split("\n"):
            have[key(line)].add(i)
    texts = {i: "\n".join(x for x in d[1].split("\n") if not key(x) or len(have[key(x)]) < 10) for i, d in kept.items()}
    own = classes(texts)
    texts = {i: t for i, t in texts.items() if own[i] == i}
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words_of(t)] for i in range(len(w) - 9)}
    out = {}
    for i, t in texts.items():
        found = list(WORD.finditer(t.translate(LOWER)))
        w, hit = words_of(t), set()
        for j in range(len(w) - 9):
            if tuple(w[j : j + 10]) in windows:
                hit.update(range(j, j + 10))
        if len(hit) > 0.5 * len(w):
            continue
        cut, at = "", 0
        for j in sorted(hit):
            if j - 1 not in hit:
                cut += t[at : found[j].start()]
            at = found[j].end() if j + 1 not in hit else at
        out[i] = cut + t[at:]
    return out, kept


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_against_a_plain_version(spark, sf_dir):
    docs, items = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    want, kept = plain(docs, items, language_id.fit(df.filter(~language_id.held_out())))
    assert set(range(150)) <= set(kept) and len(want) < len(kept) and any(want[i] != dict((d[0], d[1]) for d in docs)[i] for i in want)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    copies = Counter(r["doc_id"] for r in got)
    assert max(copies.values()) <= 2
    for r in got:
        assert sorted(x["mix_epoch"] for x in got if x["doc_id"] == r["doc_id"]) == list(range(copies[r["doc_id"]]))


def test_stages_on_odd_tables(spark, sf_dir):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words of a text", "en", "a", 1), (3, "some words of a text", "en", "a", 1), (3, "Other text", "en", "a", 1), (None, "a text without id", "en", "b", 3), (5, LONG, "de", "b", 9), (7, "!!!", "fr", "c", 5)]
    for rows in (odd, []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf_dir)
            assert got.columns == docs.columns, name
            n = got.count()
            assert n == {"language_id": 5, "line_dedup": 8, "near_dedup": 7, "decontamination": 8}[name] if rows else n == 0, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert set(map(tuple, last.select("doc_id", "text").collect())) == {r[:2] for r in rows}


def test_no_stage_drops_what_it_did_not_decide_on(spark, sf_dir):
    """Different texts that share an id, or have none, are documents of their own."""
    rng = random.Random(5)
    say = lambda: " ".join("".join(rng.choices("abcdeg", k=5)) for _ in range(60))
    a, b, c, d = (say() for _ in range(4))
    near = a.replace(a.split()[30], "other")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (None, c, "en", "s", 1), (None, d, "en", "s", 1), (None, d, "en", "s", 1), (None, near, "en", "s", 1), (2, near + " end", "en", "t", 1)]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        if name != "language_id":
            docs = stage(spark, docs, sf_dir).select(*docs.columns)
    assert set(map(tuple, docs.select("doc_id", "text").collect())) == {(1, a), (1, b), (None, c), (None, d)}


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
