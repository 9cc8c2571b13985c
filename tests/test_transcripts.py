"""Golden values of the two-file transcript."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import centroid, cluster, corpus, graph, keynet, lexrank, segment, stats, vectors
from parley.operators.search import Search
from parley.oracles import TILE
from parley.sources import transcripts as sources
from parley.streaming import running_speakers, stream_lines, stream_search


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_load(transcripts):
    got = rows(transcripts, "doc_id", "pos", "line_no", "speaker", "text")
    assert [g[:3] for g in got] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (1, 2, 5)]
    assert [g[3] for g in got] == ["K", "J", "UNK", "K", "M", "M"]
    assert got[3][4] == "River fishing: we don't stop."
    assert rows(transcripts, "tokenized")[0] == ("fishing the river",)


def test_lines_as_other_editors_end_them(spark, tmp_path):
    (tmp_path / "x_2020.txt").write_text("K: a\x0bb\rJ: c\r\n\nno colon\x85z\u2028y\n", newline="", encoding="utf-8")
    got = sources.read_transcripts(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["speaker"], r["text"]) for r in got] == [("K", "a"), ("UNK", "b"), ("J", "c"), ("UNK", ""), ("UNK", "no colon"), ("UNK", "z"), ("UNK", "y")]


@pytest.mark.parametrize("size", ["29b"])
def test_files_in_ranges(spark, tmp_path, size):
    """As read as a whole, wherever ranges end."""
    ends = ["\r\n", "\r", "\x85", "\n\n", ""]
    for i, end in enumerate(ends):
        (tmp_path / f"{i}_2020.txt").write_text("K: a longer line that crosses é ranges\x0bb\rJ: c\r\n\nno colon\x85z\u2028y\n\r\nM: x" + end, newline="", encoding="utf-8")
    (tmp_path / "bom_2021.txt").write_text("\ufeffK: a\nb", newline="", encoding="utf-8")
    (tmp_path / "bom_2022.txt").write_text("\ufeffK: a\nb\n", newline="", encoding="utf-8")
    for name, text in (("one", "\n"), ("none", ""), ("open", "x")):
        (tmp_path / f"{name}.txt").write_text(text, newline="")
    whole = rows(sources.read_transcripts(spark, str(tmp_path)), *sources.SCHEMA.fieldNames()[:7])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        ranged = rows(sources.read_split_transcripts(spark, str(tmp_path)), *sources.SCHEMA.fieldNames()[:7])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ranged == whole and len(whole) > 45


def test_clean(spark):
    df = spark.createDataFrame([("It's the water that's gone.",), ("River fishing: we don't stop.",), ("a b Naïve",), ("\t Hi there\n",)], "t string")
    got = [r[0] for r in df.select(X.strip(X.clean(F.col("t")))).collect()]
    assert got == ["it s the water that s gone", "river fishing we don t stop", "a b nave", "hi there"]


def test_raw_tokens(spark):
    df = spark.createDataFrame([("e\u0301x \u00bd a\u203fb caf\u00e9_1",), ("",)], "t string")
    got = [r[0] for r in df.select(X.raw_tokens(F.col("t"))).collect()]
    assert got == [["e", "x", "\u00bd", "a", "b", "caf\u00e9_1"], []]
    assert df.select(F.size(X.words(F.col("t")))).collect()[1][0] == 0


def test_counts(transcripts):
    assert rows(stats.doc_words(transcripts), "doc_id", "n_words", "n_distinct") == [(0, 13, 12), (1, 11, 8)]
    assert rows(stats.corpus_words(transcripts), "n_words", "n_distinct") == [(24, 19)]
    assert rows(stats.utterance_percentiles(transcripts, (25, 50, 75, 100)), "pct", "value") == [(25, 3), (50, 4), (75, 5), (100, 5)]
    assert rows(stats.corpus_speakers(transcripts), "speaker", "n_utterances") == [("J", 1), ("K", 2), ("M", 2), ("UNK", 1)]
    assert rows(stats.speaker_total(transcripts, ["K"]), "n_utterances") == [(2,)]
    assert rows(stats.speaker_total(transcripts, ["nobody"]), "n_utterances") == [(0,)]
    assert rows(stats.count_docs(transcripts), "n_docs") == [(2,)]
    assert rows(stats.doc_speakers(transcripts, True).filter("rank = 1"), "doc_id", "speaker") == [(0, "K"), (1, "M")]


def test_speakers(transcripts):
    main, others = corpus.parse_speakers(transcripts, ["K"])
    assert rows(main, "doc_id", "pos", "speaker") == [(0, 0, "K"), (1, 0, "K")]
    assert rows(others, "doc_id", "pos", "speaker") == [(0, 0, "J"), (0, 1, "UNK"), (1, 0, "M"), (1, 1, "M")]


def test_years(transcripts):
    got = rows(sources.year_groups(transcripts.select("file").distinct()), "year", "file")
    assert [(y, f[-10:]) for y, f in got] == [("2015", "a_2015.txt"), ("2016", "b_2016.txt")]


@pytest.mark.parametrize(("term", "found"), [("river", [(0, 1), (1, 0), (1, 1), (1, 2)]), ("The River", [(0, 1), (1, 1), (1, 2)]), ("it the", [(0, 0)]), ("don't", []), ("unheard", [])])
def test_search(transcripts, term, found):
    assert rows(Search(transcripts)(term), "doc_id", "pos") == found


def test_saved_index(transcripts):
    s = Search(transcripts)
    s.save("terms", 4)
    assert rows(s.grouped("river"), "n") == [(1,), (3,)]


def test_lexrank_overlaps(transcripts):
    assert rows(lexrank.overlaps(transcripts), "doc_id", "i", "j", "overlap") == [(0, 0, 1, 2), (1, 0, 1, 2), (1, 0, 2, 2), (1, 1, 2, 3)]


def test_lexrank_scores(transcripts):
    got = {(r["doc_id"], r["node"]): r["score"] for r in lexrank.scores(transcripts).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {(0, 0): 0.4651, (0, 1): 0.4651, (0, 2): 0.0698, (1, 0): 0.3509, (1, 1): 0.6491}
    for method in lexrank.METHODS:
        assert rows(lexrank.keyphrases(transcripts, method=method), "doc_id", "rank", "text") == rows(lexrank.keyphrases(transcripts), "doc_id", "rank", "text")


def test_pagerank_frames(transcripts, spark):
    nodes, edges = lexrank.graph(transcripts)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    a = graph.pagerank(nodes.select("doc_id", "node"), edges, rounds=7)
    b = graph.pagerank_frames(nodes.select("doc_id", "node"), edges, 7, lambda df: df.checkpoint())
    assert np.allclose([r[2] for r in rows(a, "doc_id", "node", "score")], [r[2] for r in rows(b, "doc_id", "node", "score")])


def test_large_documents_are_ranked_by_joins(transcripts, spark, tmp_path):
    made = []

    def keep(df):
        made.append(f"{tmp_path}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    nodes, edges = lexrank.graph(transcripts, "tfidf", weighted=True)
    nodes = nodes.select("doc_id", "node")
    want = {(r["doc_id"], r["node"]): r["score"] for r in graph.pagerank(nodes, edges, 30).collect()}
    for most in (0, 1, 100):  # both documents are large, one of them, none
        got = {(r["doc_id"], r["node"]): r["score"] for r in graph.pagerank(nodes, edges, 30, keep, most).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


@pytest.mark.parametrize(("window", "found"), [(2, {("fishing", "river"): (7, 311.1111), ("river", "water"): (2, 88.8889)}), (10, {("fishing", "river"): (9, 327.2727), ("river", "water"): (2, 72.7273)}), (1, {("fishing", "river"): (3, 300.0), ("river", "water"): (1, 100.0)})])
def test_network(spark, transcripts, window, found):
    terms = spark.createDataFrame([("fishing",), ("river",), ("water",)], "term string")
    assert {(a, b): c for a, b, c in rows(keynet.cooccurrences(transcripts, terms, window), "k1", "k2", "c")} == {k: c for k, (c, _) in found.items()}
    assert {(a, b): round(w, 4) for a, b, w in rows(keynet.network(transcripts, terms, window), "k1", "k2", "weight")} == {k: w for k, (_, w) in found.items()}


def test_centrality(spark, transcripts):
    x = graph.eigenvector(np.array([[0, 3, 1], [3, 0, 2], [1, 2, 0]], float))
    assert abs((x * x).sum() - 1) < 1e-6
    # A chain of heavy edges does not converge in time: degrees.
    terms = spark.createDataFrame([("fishing",), ("river",), ("water",)], "term string")
    assert rows(graph.centrality(terms, keynet.network(transcripts, terms)), "term", "centrality") == [("fishing", 0.5), ("river", 1.0), ("water", 0.5)]


def test_vectors_have_length_one(transcripts):
    got = vectors.utterance_vectors(transcripts).groupBy("doc_id", "pos").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in got.collect())


def test_greedy_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        m = rng.random((rng.integers(1, 8), 5)) * (rng.random((1, 5)) > 0.2)
        c = m.sum(0)
        total, want = np.zeros(5), []
        for _ in range(4):
            cos = [(c @ (total + r)) / (np.linalg.norm(c) * np.linalg.norm(total + r)) if np.linalg.norm(c) * np.linalg.norm(total + r) > 1e-12 else 0 for r in m]
            want.append(int(np.flatnonzero(np.array(cos) >= max(cos) - 1e-12)[0]))
            total = total + m[want[-1]]
        assert centroid.greedy(m @ c, m @ m.T, float(np.linalg.norm(c)), 4) == want


@pytest.mark.parametrize("method", centroid.METHODS)
def test_summaries(transcripts, method):
    got = centroid.summarize(transcripts, method, n=2, length=2, threshold=0.0).collect()
    assert len(got) == 4 and {r["doc_id"] for r in got} == {0, 1}


def test_ward_on_a_line():
    merges = cluster.ward(np.array([[0.0], [1.0], [10.0], [12.0]]))
    assert [(a, b, n) for a, b, _, n in merges] == [(0, 1, 2), (2, 3, 2), (4, 5, 4)]
    assert np.allclose([h for _, _, h, _ in merges], [1, 2, np.sqrt(2 * 2 * 2 / 4) * 10.5])


def test_smacof_keeps_a_triangle():
    d = np.array([[0, 3, 4], [3, 0, 5], [4, 5, 0]], float)
    p = cluster.smacof(d, eps=1e-9, rounds=2000)
    assert np.allclose(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), d, atol=0.05)


def test_snapping_of_any_gaps(spark):
    """Every gap of a text with uneven paragraphs, against a walk over its characters."""
    rng = np.random.default_rng(8)
    w = 3
    texts = {i: "".join(rng.choice(["word ", "a", " ", "\t", "\n", "\n\n\t ", "long sentence here "], 150)) for i in range(8)} | {8: "", 9: "x", 10: " \n\n y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = spark.createDataFrame([(i, list(range(12))) for i in texts], "doc_id long, taken array<long>")
    got = {(r["doc_id"], r["gap"]): (r["at"], r["paragraph"]) for r in segment.snapped(docs, found, w).collect()}
    breaks = defaultdict(list)
    for r in segment.paragraphs(docs).orderBy("doc_id", "at").collect():
        breaks[r["doc_id"]].append(r["at"])
    want = {}
    for doc, text in texts.items():
        own = [0]
        for m in re.finditer(segment.BREAK, text):
            if m.start() - own[-1] >= 100:
                own.append(m.start())
        assert breaks[doc] == own
        chars = words = gap = 0
        seen = False
        for c in text:
            chars += 1
            if c in " \t\n" and seen:
                seen, words = False, words + 1
            elif c not in " \t\n":
                seen = True
            if gap < 12 and words > max(gap * w, w):
                best = min(own, key=lambda b: (abs(b - chars), b))
                if abs(best - chars) < len(text):
                    want[doc, gap] = (chars, best)
                gap += 1
    assert got == want


def test_boundaries_are_apart(spark):
    rng = np.random.default_rng(1)
    for doc in range(3):
        x = rng.random(60).round(2)
        scores = spark.createDataFrame([(doc, i, 60, float(v)) for i, v in enumerate(x)], "doc_id long, gap long, gaps long, score double")
        deep = segment.depths(scores)
        got = {r["gap"]: r["depth"] for r in deep.collect()}
        for i in range(5, 55):
            left = right = i
            while left and x[left - 1] >= x[left]:
                left -= 1
            while right < 59 and x[right + 1] >= x[right]:
                right += 1
            assert abs(got[i] - (x[left] + x[right] - 2 * x[i])) < 1e-9
        cut = np.mean(list(got.values())) - np.std(list(got.values())) / 2
        want = []
        for d, g in sorted(((round(d, 12), g) for g, d in got.items() if d > cut), reverse=True):
            if all(abs(g - y) >= 4 for y in want):
                want.append(g)
        assert sorted(r["gap"] for r in segment.boundaries(deep).collect()) == sorted(want)


def test_short_documents_are_one_segment(transcripts):
    assert segment.segments(transcripts).count() == 2
    assert segment.summaries(segment.segments(transcripts)).count() == 2


def test_entities_with_another_recogniser(transcripts):
    import pandas as pd

    got = stats.entity_counts(transcripts, recogniser=lambda texts: pd.Series([["River"] if "iver" in x else [] for x in texts], index=texts.index))
    assert rows(got, "entity", "n") == [("River", 4)]


def test_partitioning_does_not_matter(transcripts):
    want = rows(lexrank.keyphrases(transcripts), "doc_id", "rank", "text")
    for n in (1, 17):
        assert rows(lexrank.keyphrases(transcripts.repartition(n)), "doc_id", "rank", "text") == want


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("K: The river.\nJ: No.\nK: Of the river\n")
    lines = stream_lines(spark, str(tmp_path / "in"))
    for name, df, mode in (("said", running_speakers(lines), "complete"), ("hits", stream_search(lines, "the river"), "append")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    assert rows(spark.table("said"), "speaker", "n_utterances") == [("J", 1), ("K", 2)]
    assert spark.table("hits").count() == 2


def test_offsets_over_many_keys(spark):
    from parley.plans.numbering import offsets

    got = offsets(spark.range(1000).select(F.col("id").alias("k"), F.lit(2).alias("n")), "k", "n", "start")
    assert got.filter("start <> 2 * k").count() == 0 and got.count() == 1000


def test_lsa_against_eigenvectors():
    """Ranks by the leading directions, from products of the matrix alone."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        found = [" ".join(rng.choice(["sun", "moon", "tide", "rock", "salt", "wind", "rain"], rng.integers(1, 9))) for _ in range(rng.integers(1, 9))]
        words = sorted({w for x in found for w in x.split()})
        counts = np.array([[x.split().count(w) for x in found] for w in words], float)
        a = 0.4 + 0.6 * counts / counts.max(0)
        values, vectors_ = np.linalg.eigh(a.T @ a)
        order = np.argsort(-values)[:3]
        if len(values) > 3 and np.sort(values)[-3] - np.sort(values)[-4] < 1e-9:
            continue  # which direction is the third is open
        assert np.allclose(segment.lsa_rank(found, 3, 0.4), np.sqrt((np.maximum(values[order], 0) * vectors_[:, order] ** 2).sum(1)), atol=1e-7)
    assert segment.lsa_rank([""], 3, 0.4).tolist() == [0.0]


@pytest.fixture(scope="module")
def talks(spark):
    """Twelve talks of three topics."""
    rng = np.random.default_rng(7)
    topics = [[f"{a}{b}" for a in start for b in "abcdefgh"] for start in ("kl", "mn", "pq")]
    rows = [(d, p, "A", " ".join(rng.choice(topics[d % 3], 9)) + " " + rng.choice(["north", "south", "east"]), f"talk_{2010 + d % 3}.txt") for d in range(12) for p in range(5)]
    from parley.sources.transcripts import from_rows

    return from_rows(spark, rows)


def plain_distances(talks):
    """The matrix of distances, by loops over the vectors."""
    own = defaultdict(dict)
    for r in vectors.cluster_vectors(talks).collect():
        own[r["doc_id"]][r["term"]] = r["w"]
    return np.array([[0.0 if i == j else 1 - sum(w * own[j].get(t, 0) for t, w in own[i].items()) for j in range(12)] for i in range(12)]), own


@pytest.mark.parametrize(("docs", "terms", "strip"), [(4096, 1024, 256), (5, 3, 2), (1, 1000, 1)])
def test_distances_in_blocks(spark, talks, monkeypatch, docs, terms, strip):
    """No row for a pair and a term is made, and no pair is moved; a document without terms is at distance 1 from all others."""
    from parley.sources.transcripts import from_rows

    for name, value in (("BLOCK_DOCS", docs), ("BLOCK_TERMS", terms), ("STRIP", strip), ("BLOCKS", 1)):
        monkeypatch.setattr(cluster, name, value)
    want, own = plain_distances(talks)
    got = cluster.distances(vectors.cluster_vectors(talks), talks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[a#" not in plan and "Join" not in plan
    found = {(r["a"], r["b"]): r["dist"] for r in got.collect()}
    assert set(found) == {(i, j) for i in range(12) for j in range(i + 1, 12) if set(own[i]) & set(own[j])}
    assert all(abs(d - want[k]) < 1e-12 for k, d in found.items())
    more = talks.unionByName(from_rows(spark, [(12, 0, "A", "", "talk_2013.txt")]).select(talks.columns))
    assert {r["doc_id"]: [round(x, 9) for x in r["distances"]][12] for r in cluster.distance_matrix(more).collect()} == dict.fromkeys(range(12), 1.0) | {12: 0.0}


def test_distance_matrix_of_many_documents(talks, monkeypatch):
    """The number of documents has no bound."""
    monkeypatch.setattr(cluster, "MAX_DENSE", 3)
    monkeypatch.setattr(cluster, "BLOCK_DOCS", 5)
    want, _ = plain_distances(talks)
    got = {r["doc_id"]: r["distances"] for r in cluster.distance_matrix(talks).collect()}
    assert np.allclose([got[i] for i in range(12)], want)


def test_k_means_is_at_rest(talks):
    labels, top = cluster.k_means(talks, clusters=3, starts=5)
    label = {r["doc_id"]: r["label"] for r in labels.collect()}
    _, own = plain_distances(talks)
    terms = sorted({t for x in own.values() for t in x})
    x = np.array([[own[d].get(t, 0) for t in terms] for d in range(12)])
    means = {c: x[[d for d in range(12) if label[d] == c]].mean(0) for c in set(label.values())}
    assert all(min(means, key=lambda c: ((x[d] - means[c]) ** 2).sum()) == label[d] for d in range(12))
    assert all((label[i] == label[j]) == (i % 3 == j % 3) for i in range(12) for j in range(12))
    for c, m in means.items():
        want = sorted(range(len(terms)), key=lambda t: (-m[t], t))[:3]
        got = sorted((r["rank"], r["term"], r["weight"]) for r in top.collect() if r["label"] == c)
        assert [t for _, t, _ in got] == [terms[t] for t in want] and np.allclose([w for *_, w in got], m[want])


def plain_seeds(x, clusters, seed):
    """Rows drawn by squared distance, each draw the first of exponential clocks."""
    import hashlib

    picked, near = [], None
    for label in range(clusters):
        u = [(int(hashlib.md5(f"{seed}:{label}:{d}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for d in range(len(x))]
        rate = np.ones(len(x)) if near is None else near
        picked.append(min((-math.log(u[d]) / rate[d], d) for d in range(len(x)) if rate[d] > 1e-9)[1])
        apart = ((x - x[picked[-1]]) ** 2).sum(1)
        near = apart if near is None else np.minimum(near, apart)
    return picked


def test_k_means_by_loops(talks):
    """From the same draws to the same labels, however the rows are dealt."""
    _, own = plain_distances(talks)
    terms = sorted({t for x in own.values() for t in x})
    x = np.array([[own[d].get(t, 0) for t in terms] for d in range(12)])
    for clusters, seed, parts in ((4, 5, 1), (3, 2, 7)):
        centres = x[plain_seeds(x, clusters, seed)]
        label = None
        while True:
            new = np.round((centres**2).sum(1) - 2 * x @ centres.T, 9).argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            centres = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(clusters)])
        got = {r["doc_id"]: r["label"] for r in cluster.k_means(talks.repartition(parts), clusters, seed)[0].collect()}
        assert got == dict(enumerate(label.tolist()))


def test_layout_and_frame(talks):
    d, _ = plain_distances(talks)
    got = {r["doc_id"]: (r["x"], r["y"]) for r in cluster.layout(talks).collect()}
    p = np.array([got[i] for i in range(12)])
    apart = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    stress = ((apart - d) ** 2).sum() / 2
    # No small step of any point lowers the stress by much: majorisation came to rest.
    for i in range(12):
        for step in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)):
            q = p.copy()
            q[i] += step
            assert ((np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1)) - d) ** 2).sum() / 2 > stress - 0.02
    alike = np.arange(12)[:, None] % 3 == np.arange(12) % 3
    assert apart[alike & ~np.eye(12, dtype=bool)].mean() < apart[~alike].mean()
    frame = {r["doc_id"]: r for r in cluster.cluster_frame(talks, clusters=3).collect()}
    label = {r["doc_id"]: r["label"] for r in cluster.k_means(talks, clusters=3)[0].collect()}
    assert {i: (r["x"], r["y"], r["label"], r["title"]) for i, r in frame.items()} == {i: (*got[i], label[i], str(2010 + i % 3)) for i in range(12)}


def test_layout_of_many_documents(talks, monkeypatch):
    """By squares of the matrix: a stress as low as that of the whole matrix."""
    d, _ = plain_distances(talks)
    stress = lambda p: ((np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) - d) ** 2).sum() / 2
    whole = stress(cluster.smacof(d))
    for name, value in (("MAX_DENSE", 3), ("BLOCK_DOCS", 5), ("STRIP", 3)):
        monkeypatch.setattr(cluster, name, value)
    got = {r["doc_id"]: (r["x"], r["y"]) for r in cluster.layout(talks).collect()}
    assert stress(np.array([got[i] for i in range(12)])) < 1.05 * whole + 0.01


def test_layout_by_squares_goes_on(spark):
    """The first step brings places around 0 and so nearer to it, which is no reason to stop: three groups far from each other come apart."""
    from parley.sources.transcripts import from_rows

    groups = ["bako dalo fama gano", "kepi lemi nepi repi", "sotu votu zutu moru"]
    talks = from_rows(spark, [(i, 0, "A", groups[i % 3], "talk_2010.txt") for i in range(24)])
    d = 1.0 * (np.arange(24)[:, None] % 3 != np.arange(24) % 3)
    got = np.array([r[1:] for r in sorted(cluster.layout_by_squares(talks).collect())])
    assert len(got) == 24 and ((np.sqrt(((got[:, None] - got[None]) ** 2).sum(-1)) - d) ** 2).sum() / 2 < 0.5


def test_frame_of_many_documents(talks, monkeypatch):
    """More documents than a task takes whole have a place, a label and a title each."""
    monkeypatch.setattr(cluster, "MAX_DENSE", 3)
    monkeypatch.setattr(cluster, "layout_by_squares", lambda u, seed: u.groupBy("doc_id").agg(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    frame = cluster.cluster_frame(talks, clusters=3).collect()
    assert sorted((r["doc_id"], r["title"]) for r in frame) == [(i, str(2010 + i % 3)) for i in range(12)] and {r["y"] for r in frame} == {1.0}


def test_ward_against_variances(talks):
    """Merges of least increase of the sum of squares, from the members of the clusters."""
    x, _ = plain_distances(talks)
    groups, want = {i: [i] for i in range(12)}, []
    for step in range(11):
        def cost(pair):
            a, b = (x[groups[g]].mean(0) for g in pair)
            n, m = (len(groups[g]) for g in pair)
            return n * m / (n + m) * ((a - b) ** 2).sum()

        pair = min(((a, b) for a in groups for b in groups if a < b), key=cost)
        want.append((*pair, np.sqrt(2 * cost(pair)), sum(len(groups[g]) for g in pair)))
        groups[12 + step] = groups.pop(pair[0]) + groups.pop(pair[1])
    got = sorted(tuple(r) for r in cluster.ward_linkage(talks).collect())
    assert [(a, b, n) for _, a, b, _, n in got] == [(a, b, n) for a, b, _, n in want] and np.allclose([h for *_, h, _ in got], [h for *_, h, _ in want])


@pytest.mark.parametrize("most", [2])
def test_ward_of_many_documents(spark, talks, monkeypatch, most):
    """In rounds of pairs that are each other's nearest: the tree of the whole matrix, copies and documents without terms among the rest."""
    from parley.operators.layout import dendrogram_links
    from parley.sources.transcripts import from_rows

    more = [(d, 0, "A", text, "talk_2013.txt") for d, text in ((12, ""), (13, ""), (14, "ka na pa"), (15, "ka na pa"), (16, "ka na pa"))]
    more = talks.unionByName(from_rows(spark, more).select(talks.columns))
    leaves = lambda linkage, n: {frozenset(x): h for x, h in members(linkage, n)}

    def members(linkage, n):
        held = {i: {i} for i in range(n)}
        for step, a, b, height, size in linkage:
            held[n + step] = held[a] | held[b]
            assert len(held[n + step]) == size == len(held[a]) + len(held[b])
            yield held[n + step], height

    read = lambda u: sorted(tuple(r) for r in cluster.ward_linkage(u).collect())
    whole, many = read(talks), read(more)
    for name, value in (("MAX_DENSE", most), ("BLOCK_DOCS", 5), ("BLOCKS", 2)):
        monkeypatch.setattr(cluster, name, value)
    got, want = leaves(read(talks), 12), leaves(whole, 12)
    assert set(got) == set(want) and all(abs(h - want[x]) < 1e-6 for x, h in got.items())
    found = read(more)
    assert np.allclose([h for *_, h, _ in found], [h for *_, h, _ in many], atol=1e-6) and len(found) == 16
    assert leaves(found, 17) and dendrogram_links(spark.createDataFrame(found, "step long, a long, b long, height double, size long")).count() == 16


def plain_blocks(tokens, w, k, stop):
    """Gap scores by counting the words of both blocks anew for each gap."""
    rows = [Counter(t for t in tokens[i : i + w] if t not in stop) for i in range(0, len(tokens), w)]
    gaps, out = len(rows) - 1, []
    for g in range(gaps):
        size = g + 1 if g < k - 1 else gaps - g if g > gaps - k else k
        a, b = (sum(rows[max(0, x) : y], Counter()) for x, y in ((g - size + 1, g + 1), (g + 1, g + 1 + size)))
        bottom = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        out.append(sum(v * b[t] for t, v in a.items()) / bottom if bottom else 0.0)
    return out


def plain_smooth(x, smoothing):
    """A flat window over the series, which goes on at either end as its reflection through the end point."""
    n = smoothing + 1
    if len(x) < n:
        return []
    left = [2 * x[0] - x[i] for i in range(min(n, len(x) - 1), 1, -1)]
    s = left + x + [2 * x[-1] - x[-1 - i] for i in range(n - 1)]
    middle = (n - 1) // 2
    whole = [sum(s[max(0, i - n + 1) : i + 1]) / n for i in range(len(s))] + [sum(s[-j:]) / n for j in range(n - 1, 0, -1)]
    return whole[middle : middle + len(s)][n - 1 : len(s) - n + 1]


@pytest.mark.parametrize("smoothing", [1, 2, 3, 4, 7])
def test_gap_scores_and_smoothing_by_loops(spark, monkeypatch, smoothing):
    monkeypatch.setattr(segment, "CELLS", 40)
    rng = np.random.default_rng(5)
    texts = {i: " ".join(rng.choice([f"w{j}" for j in range(25)] + ["the", "of"], n)) for i, n in enumerate([0, 3, 9, 31, 40, 33, 200, 77])}
    t = segment.Tiling(w=8, k=3, smoothing=smoothing)
    scores = segment.gap_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), t).cache()
    got, smooth = defaultdict(dict), defaultdict(dict)
    for r in scores.collect():
        got[r["doc_id"]][r["gap"]] = r["score"]
    for r in segment.smoothed(scores, smoothing).collect():
        smooth[r["doc_id"]][r["gap"]] = r["score"]
        assert r["gaps"] == len(plain_smooth(plain_blocks(texts[r["doc_id"]].split(), 8, 3, t.stop), smoothing)) or smoothing < 2
    for i, text in texts.items():
        want = plain_blocks(text.split(), 8, 3, t.stop)
        assert np.allclose([got[i][g] for g in range(len(want))], want) and len(got[i]) == len(want)
        want = plain_smooth(want, smoothing) if smoothing >= 2 else want
        assert np.allclose([smooth[i][g] for g in range(len(want))], want) and len(smooth[i]) == len(want)


def test_ties_with_the_cutoff_as_in_sql(spark):
    """Of series of five depths all but one are 0, and the cutoff is 0 but for the rounding; both sides round alike."""
    import duckdb

    rng = np.random.default_rng(3)
    scores = [(d, g, 5, float(s)) for d in range(300) for g, s in enumerate(rng.integers(0, 50, 5) / np.sqrt(rng.integers(2000, 9000, 5)))]
    con = duckdb.connect()
    con.execute("CREATE TABLE gs (doc_id BIGINT, gap BIGINT, gaps BIGINT, score DOUBLE)")
    con.executemany("INSERT INTO gs VALUES (?, ?, ?, ?)", scores)
    smooth_on = TILE[TILE.index("sm0 AS"):]
    want = con.sql(f"WITH {smooth_on} SELECT doc_id, gap FROM ca ORDER BY ALL").fetchall()
    got = segment.candidates(segment.depths(segment.smoothed(spark.createDataFrame(scores, "doc_id long, gap long, gaps long, score double").repartition(3)))).select("doc_id", "gap")
    assert sorted(map(tuple, got.collect())) == want and any(g != 2 for _, g in want)


def test_segments_by_a_walk_over_the_text(talks):
    """Cuts at the paragraph break nearest to the end of the word where a boundary lies."""
    t = segment.Tiling(w=6, k=2)
    docs = {r["doc_id"]: r["text"] for r in segment.joined(talks).collect()}
    marks = defaultdict(set)
    for r in segment.boundaries(segment.depths(segment.smoothed(segment.gap_scores(segment.joined(talks), t)))).collect():
        marks[r["doc_id"]].add(r["gap"])
    got = defaultdict(dict)
    for r in segment.segments(talks, t).collect():
        got[r["doc_id"]][r["seg"]] = r["text"]
    assert any(marks.values())
    for doc, text in docs.items():
        breaks = [0]
        for m in re.finditer(segment.BREAK, text):
            if m.start() - breaks[-1] >= 100:
                breaks.append(m.start())
        ends, cuts = [], []
        for i in range(1, len(text)):  # after each word's blank
            if text[i] in " \t\n" and text[i - 1] not in " \t\n":
                ends.append(i + 1)
        for gap in sorted(marks[doc]):
            if max(gap, 1) * t.w < len(ends):
                at = ends[max(gap, 1) * t.w]
                best = min(breaks, key=lambda b: (abs(b - at), b))
                if best not in cuts:
                    cuts.append(best)
        want, done = [], 0
        for c in cuts:
            if c:
                want.append(text[done:c])
                done = c
        want.append(text[done:])
        assert [got[doc][i] for i in range(len(got[doc]))] == [x.replace("\n\n\t ", " | ") for x in want]


def test_callable_analyses(transcripts):
    from parley.operators import analyses

    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(analyses.Keyphrases("tfidf", weighted=True)(transcripts, top=2), lexrank.keyphrases(transcripts, top=2, method="tfidf", weighted=True))
    assert same(analyses.Summary("best", n=2)(transcripts, length=2), centroid.summarize(transcripts, "best", n=2, length=2))
    assert same(analyses.Segmentation()(transcripts), segment.segments(transcripts))
    assert [r["rank"] for r in analyses.Entities()(transcripts).orderBy("rank").collect()][0] == 1
    nodes, edges = analyses.KeywordNetwork()(transcripts, window=2)
    assert set(nodes.columns) == {"term", "centrality", "node_size"} and "edge_width" in edges.columns


def test_ranks_of_all_rows(spark):
    """More rows than a task's share, ties by first appearance, none left out."""
    from parley.plans.numbering import ranked

    rng = np.random.default_rng(3)
    said = [(int(d), int(p), f"s{rng.zipf(1.5) % 1500}") for d in range(40) for p in range(60)]
    u = spark.createDataFrame(said, "doc_id long, pos long, speaker string").repartition(6)
    first, n = {}, Counter()
    for d, p, s in said:
        first.setdefault(s, (d, p))
        n[s] += 1
    want = [(s, n[s], i + 1) for i, s in enumerate(sorted(n, key=lambda s: (-n[s], first[s])))]
    assert [tuple(r) for r in stats.corpus_speakers(u, ranked=True).orderBy("rank").collect()] == want
    assert [tuple(r) for r in stats.corpus_speakers(u, ranked=True, top=7).orderBy("rank").collect()] == want[:7]
    assert ranked(u.limit(0), "pos").count() == 0
    assert {r["rank"] for r in ranked(u, "doc_id", "pos").collect()} == set(range(1, 2401))


def test_a_pattern_of_words(transcripts):
    """With words of four letters or more, "the water" and "the river" share nothing."""
    assert lexrank.overlaps(transcripts).filter("doc_id = 0 AND i = 0 AND j = 1").first()["overlap"] == 2
    assert lexrank.overlaps(transcripts, "[a-z]{4,}").filter("doc_id = 0 AND i = 0 AND j = 1").first()["overlap"] == 1
    assert lexrank.keyphrases(transcripts, top=3, pattern="[a-z]{20,}").count() == 5


def test_term_products(talks, monkeypatch):
    """Products of every two terms over the documents, by stripes of terms."""
    docs, _, _ = cluster.blocks(vectors.cluster_vectors(talks), talks)
    rows = docs.collect()
    width = max(t for r in rows for t in r["terms"]) + 1
    w = np.zeros((len(rows), width))
    for r in rows:
        for t, x in zip(r["terms"], r["weights"], strict=True):
            if t >= 0:
                w[r["number"], t] = x
    got = np.array([np.frombuffer(r["row"]) for r in cluster.term_products(docs, width).orderBy("number").collect()])
    assert np.allclose(got, w.T @ w)
    # Only some clusters look for their nearest, by rows of products instead of documents.
    x, state = w @ w.T @ w @ w.T, docs.select("number", F.lit(1.0).alias("size"), F.lit(0.0).alias("norm"), "terms", "weights")
    norms = {i: x[i, i] for i in range(len(x))}
    state = state.withColumn("norm", F.element_at(F.create_map(*(F.lit(v) for pair in norms.items() for v in pair)), F.col("number").cast("int")))
    apart = np.diag(x)[:, None] + np.diag(x) - 2 * x
    np.fill_diagonal(apart, np.inf)
    found = cluster.ward_squares(state, state.filter("number < 5"), cluster.term_products(docs, width), 5, width, "near", True).collect()
    assert sorted(r["number"] for r in found) == [0, 1, 2, 3, 4]
    assert all(abs(r["square"] - apart[r["number"]].min()) < 1e-9 and abs(apart[r["number"], r["other"]] - r["square"]) < 1e-9 for r in found)


def test_layout_of_a_start_in_a_task(talks, monkeypatch):
    """A task that has all squares for a start gives the places that rounds over all tasks give."""
    got = []
    for most in (8192, 0):
        monkeypatch.setattr(cluster, "MAX_LAID", most)
        got.append(np.array([r[1:] for r in sorted(cluster.layout_by_squares(talks, rounds=2).collect())]))
    assert got[0].shape == (12, 2) and np.allclose(*got, atol=1e-5)
