"""Sentences, with abbreviations learned from the corpus itself (Kiss and Strunk, 2006).

A full stop ends a sentence unless its word is an abbreviation, an initial or a number, or the stop belongs to an ellipsis; then the next word
tells. What is learned:

* ``abbreviations``: a type that mostly comes with a full stop, by the log-likelihood ratio of that against the share of stops in the corpus,
  scaled by the type's length, its inner stops and how often it comes without one.
* ``followers``: of neighbours with sentence punctuation between, which go together although an abbreviation, an initial or a number comes first
  (collocations), and which words begin sentences more often than chance has it (starters).
* How often a type begins with a small letter anywhere, and with a capital within a sentence.

All of it are aggregations by type over one table of counts. The second pass looks only at doubtful stops: these few get the next word's
counts by joins, and the stops that turn out to end nothing go back to their utterances as lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import tokenise as K
from parley.plans.settle import settled

# Fixed values of the published method.
ABBREVIATION = 0.3
COLLOCATION = 7.88
STARTER = 30.0
DOTTED_SHARE = 0.99
#: What may close behind a sentence's last stop.
CLOSERS = "\"'”’»)\\]}"
ENDS = rf"[.?!…][{CLOSERS}]*[{K.SPACE}]*\z"
NUMBER = "##"


def core(unit: Column) -> Column:
    """A unit without what opens it and closes it; full stops at its end stay."""
    return F.regexp_replace(F.regexp_replace(unit, r"\A[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}.]+\z", "")


def kind(core: Column) -> Column:
    """The type: lower case, without stops at the end; numbers are one type; empty where there is no letter or digit."""
    bare = F.rtrim(F.lower(core), F.lit("."))
    return F.when(F.left(bare, F.lit(1)).between("0", "9") & bare.rlike(r"\A[0-9.,:-]+\z"), NUMBER).otherwise(bare)


def is_dotted(core: Column) -> Column:
    """Whether the type is followed by one full stop."""
    return core.endswith(".") & ~core.endswith("..")


def is_small(core: Column) -> Column:
    return F.left(core, F.lit(1)).rlike(r"\p{Ll}")


def is_large(core: Column) -> Column:
    return F.left(core, F.lit(1)).rlike(r"\p{Lu}")


def log_chance(k: Column, n: Column, p: Column) -> Column:
    """ln of the chance of k of n at p, without the binomial coefficient; 0 ln 0 is 0."""
    return F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.ln(1 - p)).otherwise(0.0)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of ``second`` following ``first``; 0 where it does so less often than chance has it."""
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    ratio = log_chance(both, first, p1) + log_chance(second - both, total - first, p2) - log_chance(both, first, p) - log_chance(second - both, total - first, p)
    return F.when((total > first) & (both * total > first * second), 2 * ratio).otherwise(0.0)


def profile(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, dotted, small, capital, follower, n): the corpus by type, with or without a full stop, with a small first letter, with a capital within
    a sentence, and the next type where sentence punctuation lies between. All that is learned comes from this table."""
    own = texts.select(K.units(F.col(text)).alias("u")).select(F.transform("u", core).alias("c"), F.transform("u", lambda x: x.rlike(ENDS)).alias("e"))
    one = F.transform("c", lambda x, i: F.struct(x.alias("core"), ((i > 0) & ~F.get("e", i - 1)).alias("within"), F.when(F.get("e", i), F.get("c", i + 1)).alias("next")))
    rows = own.select(F.explode(one).alias("x")).select("x.*")
    rows = rows.select(kind(F.col("core")).alias("type"), is_dotted(F.col("core")).alias("dotted"), is_small(F.col("core")).alias("small"), (is_large(F.col("core")) & F.col("within")).alias("capital"), kind(F.col("next")).alias("follower"))
    return rows.groupBy("type", "dotted", "small", "capital", "follower").agg(F.count(F.lit(1)).alias("n"))


def type_counts(seen: DataFrame) -> DataFrame:
    """(type, n_dotted, n_plain, n_small, n_capital) from a ``profile``."""
    sums = {"n_dotted": F.col("dotted"), "n_plain": ~F.col("dotted"), "n_small": F.col("small"), "n_capital": F.col("capital")}
    return seen.filter("type != ''").groupBy("type").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(n) for n, c in sums.items()))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, n_dotted, n_plain, score, is_abbreviation) of the types that come with a full stop, from ``type_counts``."""
    rows = counts.filter((F.col("n_dotted") > 0) & (F.col("type") != NUMBER))
    share = counts.agg(F.sum("n_dotted") / F.sum(F.col("n_dotted") + F.col("n_plain"))).scalar()
    n = (F.col("n_dotted") + F.col("n_plain")).cast("double")
    dotted = F.col("n_dotted").cast("double")
    ratio = 2 * (log_chance(dotted, n, F.lit(DOTTED_SHARE)) - log_chance(dotted, n, share))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("n_plain"))
    return rows.select("type", "n_dotted", "n_plain", score.alias("score")).withColumn("is_abbreviation", F.col("score") >= ABBREVIATION)


def is_initial(kind: Column) -> Column:
    return kind.rlike(r"\A\p{L}\z")


def followers(seen: DataFrame, counts: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collocations (first, second, n, ratio) and starters (type, n, ratio), those over their thresholds."""
    pairs = seen.filter("follower != ''").groupBy(F.col("type").alias("first"), "dotted", F.col("follower").alias("second")).agg(F.sum("n").alias("n"))
    known = scored.filter("is_abbreviation").select(F.col("type").alias("first"), F.lit(True).alias("short"))
    doubtful = F.col("dotted") & (F.coalesce("short", F.lit(False)) | is_initial(F.col("first")) | (F.col("first") == NUMBER))
    marked = pairs.join(known, "first", "left").withColumn("doubtful", doubtful).drop("short")
    sizes = counts.select("type", (F.col("n_dotted") + F.col("n_plain")).cast("double").alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    close = marked.filter(F.col("doubtful") & (F.col("n") > 1)).join(sizes.withColumnsRenamed({"type": "first", "size": "x"}), "first").join(sizes.withColumnsRenamed({"type": "second", "size": "y"}), "second")
    close = close.select("first", "second", "n", association(F.col("n").cast("double"), F.col("x"), F.col("y"), total).alias("ratio")).filter(F.col("ratio") >= COLLOCATION)
    begun = marked.filter(~F.col("doubtful")).groupBy(F.col("second").alias("type")).agg(F.sum("n").alias("n"))
    stops = begun.agg(F.sum("n").cast("double")).scalar()
    starts = begun.join(sizes, "type").select("type", "n", association(F.col("n").cast("double"), stops, F.col("size"), total).alias("ratio"))
    return close, starts.filter(F.col("ratio") >= STARTER)


@dataclass(frozen=True)
class Learned:
    """What a corpus tells about its sentences. ``types`` (type, short, starter, n_small, n_capital) and ``collocations`` are for the second pass."""

    counts: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    types: DataFrame
    collocations: DataFrame


def learn(texts: DataFrame, text: str = "text") -> Learned:
    """One pass over the texts; what comes of it is by type, and written for all plans that use it."""
    seen = settled(profile(texts, text))
    counts = settled(type_counts(seen))
    scored = abbreviations(counts)
    close, starts = followers(seen, counts, scored)
    short = scored.filter("is_abbreviation").select("type", F.lit(True).alias("short"))
    types = counts.select("type", "n_small", "n_capital").join(short, "type", "left").join(starts.select("type", F.lit(True).alias("starter")), "type", "left").na.fill(False)
    return Learned(counts, scored, starts, settled(types), settled(close))


def no_ends(texts: DataFrame, learned: Learned, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keys, places): units that end in a full stop and yet end no sentence, for the texts that have any."""
    own = texts.select(*keys, K.units(F.col(text)).alias("u"))
    stops = F.filter(F.transform("u", lambda x, i: F.struct(i.alias("i"), x.alias("unit"), F.get("u", i + 1).alias("next"))), lambda x: x["next"].isNotNull() & x["unit"].rlike(rf"[.…][{CLOSERS}]*[{K.SPACE}]*\z"))
    rows = own.select(*keys, F.explode(stops).alias("x")).select(*keys, "x.*").select(*keys, "i", "unit", core(F.col("unit")).alias("a"), core(F.col("next")).alias("b"))
    ellipsis = F.col("a").endswith("..") | F.col("unit").rlike(rf"(\.\.|…)[{CLOSERS}]*[{K.SPACE}]*\z")
    rows = rows.select(*keys, "i", kind(F.col("a")).alias("first"), is_dotted(F.col("a")).alias("dotted"), ellipsis.alias("ellipsis"), kind(F.col("b")).alias("second"), is_small(F.col("b")).alias("small"), is_large(F.col("b")).alias("large"))
    types = learned.types
    rows = rows.join(types.select(F.col("type").alias("first"), "short"), "first", "left").withColumn("short", F.col("dotted") & F.coalesce("short", F.lit(False)))
    rows = rows.withColumn("lone", F.col("dotted") & (is_initial(F.col("first")) | (F.col("first") == NUMBER))).filter("short OR ellipsis OR lone")
    rows = rows.join(types.select(F.col("type").alias("second"), "starter", "n_small", "n_capital"), "second", "left").join(learned.collocations.select("first", "second", F.lit(True).alias("close")), ["first", "second"], "left")
    n_small, n_capital, starts = F.coalesce("n_small", F.lit(0)), F.coalesce("n_capital", F.lit(0)), F.coalesce("starter", F.lit(False))
    # By spelling: a capital where the word is small elsewhere and never capital within a sentence begins one; a small letter begins none.
    spelt = F.when(F.col("close").isNotNull(), False).when(F.col("large") & (n_small > 0) & (n_capital == 0), True).when(F.col("small"), False)
    ends = (
        spelt.when(F.col("lone") & ~F.col("short"), ((F.col("first") != NUMBER) & F.col("large") & (n_small > 0)) | starts)
        .when(F.col("short"), F.col("large") & starts)
        .otherwise(F.col("large"))
    )
    return rows.filter(~ends).groupBy(*keys).agg(F.collect_list("i").alias("places"))


def split(texts: DataFrame, learned: Learned, keys: tuple[str, ...] = ("doc_id", "pos"), text: str = "text", empty: bool = False) -> DataFrame:
    """(keys, sent, begin, text): the sentences of every text, and where they begin in it. A text without words has none, or with ``empty`` a row of nulls."""
    own = texts.select(*keys, K.units(F.col(text)).alias("u"), F.regexp_extract(text, rf"\A[{K.SPACE}]*", 0).alias("lead"))
    own = own.join(no_ends(texts, learned, keys, text), list(keys), "left")
    n, none = F.size("u"), F.array().cast("array<int>")
    # A unit ends a sentence by its punctuation, or as the last.
    ended = F.filter(F.transform("u", lambda x, i: F.when((i == n - 1) | (x.rlike(ENDS) & ~F.array_contains(F.coalesce("places", none), i)), i)), lambda x: x.isNotNull())
    cut = own.withColumn("ends", ended)
    whole = F.transform("ends", lambda e, j: F.array_join(F.slice("u", F.coalesce(F.get("ends", j - 1) + 2, F.lit(1)), e - F.coalesce(F.get("ends", j - 1), F.lit(-1))), ""))
    sized = cut.select(*keys, "lead", whole.alias("s"))
    begin = F.transform("s", lambda x, j: F.struct(F.aggregate(F.slice("s", F.lit(1), j), F.length("lead"), lambda acc, y: acc + F.length(y)).cast("long").alias("begin"), F.regexp_replace(x, rf"[{K.SPACE}]+\z", "").alias("text")))
    explode = F.posexplode_outer if empty else F.posexplode
    return sized.select(*keys, explode(begin).alias("sent", "x")).select(*keys, F.col("sent").cast("long").alias("sent"), "x.begin", "x.text")


def sentences(utterances: DataFrame) -> DataFrame:
    """(doc_id, pos, sent, begin, text), by what the utterances themselves tell."""
    return split(utterances, learn(utterances))


def word_tokens(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos", "sent")) -> DataFrame:
    """(keys, i, token, begin) of sentences (keys, begin, text): ``begin`` is the place in the text that the sentence was cut from."""
    rows = found.select(*keys, F.col("begin").alias("_from"), F.posexplode(K.pieces(F.col("text"))).alias("_p", "token"))
    before = Window.partitionBy(*keys).orderBy("_p")
    blank = K.is_space(F.col("token"))
    rows = rows.withColumn("begin", F.col("_from") + F.coalesce(F.sum(F.length("token")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("i", (F.sum((~blank).cast("long")).over(before) - 1)).filter(~blank)
    return rows.select(*keys, "i", "token", "begin")
