"""Cleaning, tokenisers, n-grams and stop lists as column expressions, all within the JVM.

Patterns say ``(?U)`` where Unicode whitespace counts, as the default of the JVM is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The basic stop list, in its natural order.
STOP_BASE = (
    "em gonna huh yep goin hi inaudible crosstalk laughter i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
# What clustering adds to the basic list.
STOP_CLUSTER = [*STOP_BASE, *"thats um uh im ppl pause".split()]
# What keyword networks add to the basic list.
STOP_KEYWORDS = [*STOP_BASE, *"well im ill ive thats hes yeah yup youre ok hey good".split()]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Lower case; everything but a-z, whitespace and apostrophes goes; runs of apostrophes become a space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^a-z\s']", ""), "'+", " ")


def clean_term(text: Column) -> Column:
    """As ``clean``, but apostrophes go without a trace. Search terms are cleaned this way."""
    return F.regexp_replace(F.lower(text), r"(?U)[^a-z\s]", "")


def words(text: Column) -> Column:
    """Runs of anything but whitespace, case and punctuation kept."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1)


#: Words of a cleaned text.
TOKEN = "[a-z]+"


def tokens(tokenized: Column, pattern: str = TOKEN) -> Column:
    """What matches ``pattern`` in a cleaned text: its words."""
    return F.regexp_extract_all(tokenized, F.lit(pattern), 0)


def long_tokens(tokenized: Column) -> Column:
    """Words of two letters or more of a cleaned text."""
    return F.regexp_extract_all(tokenized, F.lit("([a-z]{2,})"), 1)


def raw_tokens(text: Column) -> Column:
    """Letters, digits and underscores, case kept."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def without(toks: Column, stop: list[str]) -> Column:
    """The tokens that are not on the stop list, in order, repeats kept."""
    return F.filter(toks, lambda t: ~t.isin(*stop))


def bigrams(toks: Column) -> Column:
    """Neighbours, over what is left of the tokens."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, F.lit(1), n), F.slice(toks, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def unigrams_and_bigrams(toks: Column) -> Column:
    return F.concat(toks, bigrams(toks))


def year(path: Column) -> Column:
    """The four characters before an extension of three."""
    return F.substring(path, -8, 4)


def naive_edge(overlap: Column) -> Column:
    """Overlap over its decimal logarithm; 0 where that is 0."""
    return F.when(overlap != 1, overlap / F.log10(overlap.cast("double"))).otherwise(F.lit(0.0))


def entities(text: Column) -> Column:
    """Runs of capitalised words: a heuristic in place of a trained recogniser."""
    return F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*)"), 1)


def shown(speaker: Column, text: Column) -> Column:
    """An utterance in print."""
    return F.format_string("%s: %s", speaker, text)


def segment_text(text: Column) -> Column:
    """Utterance separators of a joined document become bars."""
    return F.replace(text, F.lit("\n\n\t "), F.lit(" | "))
