"""A hidden Markov tagger that tells names from other words, fitted to the corpus itself by expectation maximisation.

Tags are punctuation (P), digits (D), function words (F, the stop list), other words (W) and names (N). Most tokens can have one tag only; one that
begins with a capital may be a name or what it is in small letters. So a sentence's lattice falls apart into pieces: the capitalised
tokens between two whose tags are certain. As the model is of first order, pieces do not depend on each other given these two tags, and
equal pieces count once with their number: the corpus is reduced to a table of pieces, and every round works on that.

A round joins the pieces' words with their emission probabilities, runs forward and backward over each piece and sums expected counts
in Spark: of tag pairs, of words per tag, and of capitals per tag at the beginning of a sentence and within. Only the pairs and capitals,
some dozens of numbers, come to the driver; the words' counts stay a table.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import tokenise as K
from parley.plans.settle import settled

NAME, WORD, FUNCTION, DIGITS, MARKS, BEGIN, END = "N", "W", "F", "D", "P", "<", ">"
FROM, TO = (BEGIN, MARKS, DIGITS, FUNCTION, WORD, NAME), (MARKS, DIGITS, FUNCTION, WORD, NAME, END)
#: A slot of a piece: emission probabilities as a name and as what it is else, and the tag of the latter.
Slot = tuple[float, float, str]
Pairs = dict[tuple[str, str], float]


def small_tag(token: Column) -> Column:
    """F or W, by the stop list."""
    return F.when(F.lower(token).isin(*X.STOP_BASE), FUNCTION).otherwise(WORD)


def certain_tag(token: Column, at: Column) -> Column:
    """The only tag that a token can have, or null. A word of the stop list may be a name within a sentence, but not at its beginning."""
    first = F.left(token, F.lit(1))
    single = (F.length(token) == 1) & F.lower(token).isin("i", "a")
    return (
        F.when(~token.rlike(r"[\p{L}\p{N}]"), MARKS).when(first.rlike(r"\p{N}"), DIGITS).when(token.rlike(r"\A[^\p{L}]*'"), FUNCTION).when(single, FUNCTION)
        .when(~first.rlike(r"\p{Lu}"), small_tag(token)).when((at == 0) & (small_tag(token) == FUNCTION), FUNCTION)
    )


def lattices(sentences: DataFrame, *keys: str) -> DataFrame:
    """(keys, left, run, right): the pieces of each sentence (keys, text). ``run`` are the tokens between two certain tags, often none, each with whether
    it begins the sentence."""
    rows = sentences.select(*keys, K.tokens(F.col("text")).alias("t")).filter("size(t) > 0")
    rows = rows.select(*keys, "t", F.concat(F.array(F.lit(BEGIN)), F.transform("t", certain_tag), F.array(F.lit(END))).alias("tags"))
    rows = rows.select(*keys, "t", "tags", F.filter(F.transform("tags", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()).alias("at"))
    run = lambda a, b: F.transform(F.slice("t", a + 1, b - a - 1), lambda x, i: F.struct(x.alias("token"), ((a == 0) & (i == 0)).alias("first")))
    pieces = F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda a, j: F.struct(F.get("tags", a).alias("left"), run(a, F.get("at", j + 1)).alias("run"), F.get("tags", F.get("at", j + 1)).alias("right")))
    return rows.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")


def forward_backward(left: str, slots: list[Slot], right: str, pairs: Pairs) -> tuple[float, list[tuple[float, float]], dict[tuple[str, str], float]]:
    """ln of the piece's probability, each slot's chances of being a name and not, and expected tag pairs."""
    tags = [(NAME, s[2]) for s in slots]
    go = lambda a, b: pairs.get((a, b), 0.0)
    ahead, total = [], 0.0
    for k, (as_name, as_small, _) in enumerate(slots):
        own = [(go(left, t) if k == 0 else sum(ahead[-1][i] * go(tags[k - 1][i], t) for i in (0, 1))) * e for t, e in zip(tags[k], (as_name, as_small), strict=True)]
        size = sum(own)
        if size <= 0:
            return -math.inf, [(0.5, 0.5)] * len(slots), {}
        ahead.append([x / size for x in own])
        total += math.log(size)
    back = [go(t, right) for t in tags[-1]]
    last = sum(a * b for a, b in zip(ahead[-1], back, strict=True))
    if last <= 0:
        return -math.inf, [(0.5, 0.5)] * len(slots), {}
    seen: dict[tuple[str, str], float] = defaultdict(float)
    chances = [(0.0, 0.0)] * len(slots)
    for k in range(len(slots) - 1, -1, -1):
        both = [a * b for a, b in zip(ahead[k], back, strict=True)]
        size = sum(both)
        chances[k] = (both[0] / size, both[1] / size)
        if k == len(slots) - 1:
            for i in (0, 1):
                seen[tags[k][i], right] += chances[k][i]
        if k == 0:
            for i in (0, 1):
                seen[left, tags[0][i]] += chances[0][i]
            break
        step = [[ahead[k - 1][i] * go(tags[k - 1][i], tags[k][j]) * slots[k][j] * back[j] for j in (0, 1)] for i in (0, 1)]
        size = sum(map(sum, step))
        for i in (0, 1):
            for j in (0, 1):
                seen[tags[k - 1][i], tags[k][j]] += step[i][j] / size
        back = [sum(go(tags[k - 1][i], tags[k][j]) * slots[k][j] * back[j] for j in (0, 1)) for i in (0, 1)]
        size = sum(back)
        back = [x / size for x in back]
    return total + math.log(last), chances, dict(seen)


def viterbi(left: str, slots: list[Slot], right: str, pairs: Pairs) -> list[str]:
    """The likeliest tags of a piece; of equals, names."""
    log = lambda x: math.log(x) if x > 0 else -1e9
    best, came = [(0.0, left)], []
    for as_name, as_small, tag in slots:
        here = []
        for t, e in ((NAME, as_name), (tag, as_small)):
            score, i = max((s + log(pairs.get((a, t), 0.0)) + log(e), -i) for i, (s, a) in enumerate(best))
            here.append((score, t, -i))
        came.append([(t, i) for _, t, i in here])
        best = [(s, t) for s, t, _ in here]
    _, i = max((s + log(pairs.get((t, right), 0.0)), -i) for i, (s, t) in enumerate(best))
    out, i = [], -i
    for step in reversed(came):
        out.append(step[i][0])
        i = step[i][1]
    return out[::-1]


@dataclass
class Tagger:
    """Chances of tag pairs and of capitals by tag and place, ``words`` (word, tag, as_name, as_small), and the log-likelihood before every round."""

    pairs: Pairs
    capitals: dict[tuple[str, bool], float]
    words: DataFrame
    likelihoods: list[float] = field(default_factory=list)


def _filled(slots: DataFrame, tagger: Tagger) -> DataFrame:
    """(piece, left, right, n, run): ``run`` has for each slot its token, whether it is first, and the words' chances."""
    met = slots.join(tagger.words, "word")
    return met.groupBy("piece").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "token", "word", "first", "as_name", "as_small", "tag"))).alias("run"))


def _slots(run: list[dict], capitals: dict[tuple[str, bool], float]) -> list[Slot]:
    return [(s["as_name"], s["as_small"] * capitals[s["tag"], s["first"]], s["tag"]) for s in run]


def _expected(pieces: DataFrame, tagger: Tagger) -> DataFrame:
    """(kind, a, b, x) summed: ``t`` tag pairs, ``e`` words as names (N) and else (-), ``c`` capitals by tag and place, ``l`` the likelihood."""
    pairs, capitals = tagger.pairs, tagger.capitals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str, str], float] = defaultdict(float)
            for p in batch.to_pylist():
                z, chances, seen = forward_backward(p["left"], _slots(p["run"], capitals), p["right"], pairs)
                sums["l", "", ""] += z * p["n"]
                for (a, b), x in seen.items():
                    sums["t", a, b] += x * p["n"]
                for s, (as_name, as_small) in zip(p["run"], chances, strict=True):
                    sums["e", s["word"], NAME] += as_name * p["n"]
                    sums["e", s["word"], "-"] += as_small * p["n"]
                    sums["c", s["tag"], "first" if s["first"] else "within"] += as_small * p["n"]
                    sums["c", NAME, ""] += as_name * p["n"]
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.string()) for i in range(3)), pa.array(list(sums.values()), pa.float64())], names=["kind", "a", "b", "x"])

    return pieces.mapInArrow(run, "kind string, a string, b string, x double").groupBy("kind", "a", "b").agg(F.sum("x").alias("x"))


@dataclass
class Corpus:
    """What the rounds work on. ``slots`` (piece, k, token, word, first, left, right, n) are the pieces' tokens, ``fixed`` (word, tag, f) how often a word
    of a piece also occurs in small letters; ``pairs``, ``small`` and ``rest`` are sums over certain tokens."""

    slots: DataFrame
    fixed: DataFrame
    pairs: Pairs
    small: dict[tuple[str, bool], float]
    rest: dict[str, float]


def reduced(sentences: DataFrame) -> Corpus:
    pieces = settled(lattices(sentences).groupBy("left", "run", "right").agg(F.count(F.lit(1)).alias("n")))
    pairs = {(r["left"], r["right"]): float(r["n"]) for r in pieces.filter("size(run) = 0").collect()}  # pairs of tags
    named = settled(pieces.filter("size(run) > 0").withColumn("piece", F.monotonically_increasing_id()))
    slots = settled(named.select("piece", "left", "right", "n", F.posexplode("run").alias("k", "s")).select("piece", "left", "right", "n", "k", "s.*").withColumn("word", F.lower("token")))
    marked = F.transform(K.tokens(F.col("text")), lambda x, i: F.struct(F.lower(x).alias("word"), certain_tag(x, i).alias("tag"), (i == 0).alias("first")))
    certain = sentences.select(F.explode(marked).alias("s")).select("s.*").filter(F.col("tag").isin(WORD, FUNCTION))
    counts = settled(certain.groupBy("word", "tag", "first").agg(F.count(F.lit(1)).alias("n")))
    small = {(r["tag"], r["first"]): float(r["n"]) for r in counts.groupBy("tag", "first").agg(F.sum("n").alias("n")).collect()}  # four rows at most
    fixed = counts.groupBy("word", "tag").agg(F.sum("n").alias("f"))
    both = slots.select("word").distinct().withColumn("tag", small_tag(F.col("word"))).join(fixed, ["word", "tag"], "left").select("word", "tag", F.coalesce("f", F.lit(0)).alias("f"))
    # Words in small letters only: their share of the likelihood but for the sizes of the tags, which change.
    alone = fixed.join(both.select("word", "tag"), ["word", "tag"], "left_anti").groupBy("tag").agg(F.sum(F.col("f") * F.ln("f")).alias("x"))
    return Corpus(slots, settled(both), pairs, small, {r["tag"]: r["x"] for r in alone.collect()})


def fit(corpus: Corpus, rounds: int = 5) -> Tagger:
    """Rounds of expectation maximisation. At the start a capital within a sentence makes a name, more likely so for words that are not on the stop
    list; at a sentence's beginning a word is one as often as it is a capital within sentences, and not in small letters."""
    tags = (WORD, FUNCTION)
    whole = {t: corpus.small.get((t, True), 0.0) + corpus.small.get((t, False), 0.0) for t in tags}
    within = F.sum(F.when(F.col("first"), 0).otherwise(F.col("n")))
    start = corpus.slots.groupBy("word").agg(within.alias("within"), F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("begins")).join(corpus.fixed, "word")
    listed = F.col("tag") == FUNCTION
    share = (F.col("within") + F.when(listed, 0.1).otherwise(0.5)) / (F.col("within") + F.col("f") + 1)
    e_name = F.col("within") * F.when(listed, 0.5).otherwise(0.9) + F.col("begins") * share
    words = start.select("word", "tag", "f", e_name.alias("e_name"), (F.col("within") + F.col("begins") - e_name).alias("e_small"))
    pairs: Pairs = {(a, b): 1 / len(TO) for a in FROM for b in TO}
    capitals = {(t, first): 0.9 if first else 0.1 for t in tags for first in (True, False)}
    likelihoods: list[float] = []

    def chances(counts: DataFrame) -> tuple[DataFrame, dict[str, float], float, dict[str, float]]:
        """From expected counts to emission probabilities, the sizes of the tags, and the fixed words' share of the likelihood."""
        sums = {r["tag"]: r for r in counts.groupBy("tag").agg(F.sum("e_name").alias("n"), F.sum("e_small").alias("s"), F.sum(F.when(F.col("f") > 0, F.col("f") * F.ln(F.col("f") + F.col("e_small"))).otherwise(0.0)).alias("x")).collect()}
        names = max(sum(r["n"] for r in sums.values()), 1e-300)
        sizes = {t: max(whole[t] + (sums[t]["s"] if t in sums else 0.0), 1e-300) for t in tags}
        size = F.when(F.col("tag") == WORD, sizes[WORD]).otherwise(sizes[FUNCTION])
        fixed = {t: corpus.rest.get(t, 0.0) + (sums[t]["x"] if t in sums else 0.0) for t in tags}
        return counts.select("word", "tag", (F.col("e_name") / names).alias("as_name"), ((F.col("f") + F.col("e_small")) / size).alias("as_small")), sizes, names, fixed

    for _ in range(rounds):
        table, sizes, _, fixed = chances(words)
        tagger = Tagger(pairs, capitals, table, likelihoods)
        found = settled(_expected(_filled(corpus.slots, tagger), tagger))
        sums = {(r["kind"], r["a"], r["b"]): r["x"] for r in found.filter("kind <> 'e'").collect()}  # some dozens of rows
        certain = sum(n * math.log(pairs[p]) for p, n in corpus.pairs.items() if n) + sum(fixed[t] - whole[t] * math.log(sizes[t]) for t in tags if whole[t])
        certain += sum(n * math.log(max(1 - capitals[k], 1e-300)) for k, n in corpus.small.items() if k != (FUNCTION, True))
        likelihoods.append(certain + sums.get(("l", "", ""), 0.0))
        counts = {(a, b): corpus.pairs.get((a, b), 0.0) + sums.get(("t", a, b), 0.0) for a in FROM for b in TO}
        rows = {a: sum(counts[a, b] for b in TO) for a in FROM}
        pairs = {(a, b): n / rows[a] if rows[a] else 1 / len(TO) for (a, b), n in counts.items()}
        place = {True: "first", False: "within"}
        upper = {k: sums.get(("c", k[0], place[k[1]]), 0.0) for k in capitals}
        capitals = {k: upper[k] / (upper[k] + corpus.small.get(k, 0.0)) if upper[k] + corpus.small.get(k, 0.0) else capitals[k] for k in capitals}
        own = found.filter("kind = 'e'").groupBy(F.col("a").alias("word")).agg(F.sum(F.when(F.col("b") == NAME, F.col("x")).otherwise(0.0)).alias("e_name"), F.sum(F.when(F.col("b") != NAME, F.col("x")).otherwise(0.0)).alias("e_small"))
        words = corpus.fixed.join(own, "word")
    return Tagger(pairs, capitals, settled(chances(words)[0]), likelihoods)


def decoded(slots: DataFrame, tagger: Tagger) -> DataFrame:
    """(piece, n, tokens, tags): the likeliest tags of every piece."""
    pairs, capitals = tagger.pairs, tagger.capitals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            tags = [viterbi(p["left"], _slots(p["run"], capitals), p["right"], pairs) for p in rows]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array([[s["token"] for s in p["run"]] for p in rows], pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string()))], names=["piece", "n", "tokens", "tags"])

    return _filled(slots, tagger).mapInArrow(run, "piece long, n long, tokens array<string>, tags array<string>")


def names(tokens: Column, tags: Column) -> Column:
    """Runs of names, each joined by blanks. ``tokens`` hold neither blanks nor line ends."""
    marked = F.array_join(F.zip_with(tokens, tags, lambda x, t: F.when(t == NAME, x).otherwise("\n")), " ")
    return F.filter(F.transform(F.split(marked, "\n"), F.trim), lambda x: x != "")


def entity_counts(sentences: DataFrame, rounds: int = 5) -> DataFrame:
    """(entity, n) of sentences (text). A name never leaves its piece, so pieces with their numbers are all it takes."""
    corpus = reduced(settled(sentences.select("text")))
    found = decoded(corpus.slots, fit(corpus, rounds))
    return found.select("n", F.explode(names(F.col("tokens"), F.col("tags"))).alias("entity")).groupBy("entity").agg(F.sum("n").alias("n"))


def entity_mentions(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, pos, entity), from sentences (doc_id, pos, text)."""
    own = settled(lattices(sentences, "doc_id", "pos").filter("size(run) > 0").withColumn("piece", F.monotonically_increasing_id()).withColumn("n", F.lit(1).cast("long")))
    slots = own.select("piece", "left", "right", "n", F.posexplode("run").alias("k", "s")).select("piece", "left", "right", "n", "k", "s.*").withColumn("word", F.lower("token"))
    found = decoded(slots, tagger).select("piece", F.explode(names(F.col("tokens"), F.col("tags"))).alias("entity"))
    return own.select("piece", "doc_id", "pos").join(found, "piece").select("doc_id", "pos", "entity")
