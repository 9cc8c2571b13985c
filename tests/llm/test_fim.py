"""Fill-in-the-middle against a version by regular expressions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from parley.llm import fim

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(key, text, seed=1, rate=90, spm_rate=20):
    text = text or ""
    toks = TOKEN.findall(text)
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest())[:4]]
    a, b = sorted(x % (len(toks) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (toks[:a], toks[a:b], toks[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(toks), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(toks), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(toks), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_masks():
    draw = random.Random(5)
    for _ in range(500):
        text = "".join(draw.choice("abZ é😀́\n.1") for _ in range(draw.randrange(60)))
        data, toks = text.encode(), TOKEN.findall(text)
        starts = fim.token_starts(data)
        assert starts.bit_count() == len(toks)
        assert [fim.place_of(starts, k, len(data)) for k in range(len(toks) + 1)] == [len("".join(toks[:k]).encode()) for k in range(len(toks) + 1)]


def test_against_regular_expressions(spark):
    draw = random.Random(7)
    rows = [(i, "".join(draw.choice(["word", " ", "é", "\n", "<", "S>", "x", "😀", "9"]) for _ in range(draw.randrange(80)))) for i in range(400)]
    rows += [(400, None), (401, ""), (None, "no id here"), (402, "a <P> b"), (403, "long text, " * 200_000), (404, "<" * 50), (404, "<" * 50), (-5, "P>S>M>" * 9), (405, " " * 300)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, form string, _raw string")
    made = fim.fill_in_middle(docs)
    assert sorted(made.columns) == sorted({*docs.columns, *fim.ADDED})
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    told = sorted((repr(r["doc_id"]), r["text"] or "", r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got)
    key = lambda x: [repr(y) for y in x]
    assert sorted(told, key=key) == sorted(((repr(i), t or "", *plain(i, t)) for i, t in rows), key=key)
    assert all(r["again"] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert {r[0] for r in fim.fill_in_middle(docs, seed=2, rate=0).select("form").collect()} == {"plain"}
    assert "psm" not in {r[0] for r in fim.fill_in_middle(docs, rate=100, spm_rate=100).select("form").collect()}
