"""Word tokens with punctuation and contractions apart, as a cascade of rewriting rules.

A rule puts marks around what it takes for a token and changes nothing else, so what lies between marks, put together, is the text again, and
the place of a token in the text is the length of all that stands before it. Patterns look neither ahead nor behind: where matches may
share a character, a rule is applied twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Unicode has it, as characters of a class.
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARK = "\x1f"
_M = r"\x{1F}"
_APOSTROPHE = "['’]"
_FUSED = (("can", "not"), ("gon", "na"), ("wan", "na"), ("got", "ta"), ("gim", "me"), ("lem", "me"), ("d", f"{_APOSTROPHE}ye"), ("more", f"{_APOSTROPHE}n"), (f"{_APOSTROPHE}t", "is"), (f"{_APOSTROPHE}t", "was"))

#: (pattern, what it becomes, how often), in order. ``#`` stands for a mark in the replacement.
RULES: tuple[tuple[str, str, int], ...] = (
    (f"([{SPACE}]+)", "#$1#", 1),
    (r"(\.\.+|…)", "#$1#", 1),
    (r"(--+|—|–)", "#$1#", 1),
    (r'(["“”„«»‘(){}\[\]<>]|``)', "#$1#", 1),
    (r"('')", "#$1#", 1),
    (r"([;@#$%&*?!¿¡=|/])", "#$1#", 1),
    (r"([:,])([^0-9])", "#$1#$2", 2),
    (r"([:,])\z", "#$1#", 1),
    # The last full stop is a token of its own, any other belongs to its word.
    (rf"([^.{_M}])(\.)([{_M}\]\)}}>\"'”’»{SPACE}]*)\z", "$1#$2#$3", 1),
    (rf"(?i)([^{_M}])({_APOSTROPHE}(?:ll|re|ve|s|m|d)|n{_APOSTROPHE}t)(\x{{1F}}|\z)", "$1#$2#$3", 1),
    (rf"([^{_M}nN])({_APOSTROPHE})(\x{{1F}}|\z)", "$1#$2#$3", 1),
    *((rf"(?i)(\A|\x{{1F}})({a})({b})(\x{{1F}}|\z)", "$1$2#$3$4", 1) for a, b in _FUSED),
)


def pieces(sentence: Column) -> Column:
    """Tokens and the whitespace between them, in order; put together they are the sentence."""
    marked = F.translate(sentence, MARK, " ")
    for pattern, becomes, times in RULES:
        for _ in range(times):
            marked = F.regexp_replace(marked, pattern, becomes.replace("#", MARK))
    return F.filter(F.split(marked, MARK, -1), lambda x: x != "")


def is_space(piece: Column) -> Column:
    return piece.rlike(rf"\A[{SPACE}]+\z")


def tokens(sentence: Column) -> Column:
    return F.filter(pieces(sentence), lambda x: ~is_space(x))


def units(text: Column) -> Column:
    """Runs of anything but whitespace, each with the whitespace behind it."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+[{SPACE}]*"), 0)
