"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans are those of four fixed patterns, each searched leftmost and without overlap, with a test on the match (``base_spans``). They
always stay. The field adds spans that the patterns miss, such as ``name at host dot com``, a telephone number that begins with 00, or a
card number in groups with odd separators.

A text's zones are the surroundings of digits, at signs, bracketed ``at``, the word ``dot``, and the word ``at`` in any case before a word and a dot, hyphen
or word for dot; elsewhere no segment but ``other`` is possible. A zone is cut into
tokens: letter runs, digit runs, single marks. A segment is up to ``MAX_TOKENS`` tokens under one of the labels email, ip, card, phone, or
a single token under ``other``. A segment's features look at the whole span: number and grouping of digits, Luhn's test, parts at most
255, separators, at signs and dots, what stands before. Bounded-entity dynamic programming finds the best cut and labels together, with
weights of the segments' features and of neighbouring labels.

Weights maximise the exact conditional likelihood (forward-backward over segments, AdaGrad) on zones of a bounded sample of documents,
labelled by the patterns, on rewritten copies of these and of made-up spans in other spellings, and on numbers and phrases that are no personal data. The sample is
``sample_docs`` documents in expectation, by a hash of the id; every text is searched as a whole.

Defined results: null and empty texts have no spans; an added span overlaps no base span, and has ``MAX_TOKENS`` tokens at most, an address
8 before the at sign and ``REACH`` after it: longer ones are left to the patterns; repeated rows get a row each; an empty table
trains on the rewritten copies of made-up spans alone; other columns stay, but for those named like an added one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import Workspace, free_name, others

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digit runs are taken whole: a match that fails at a run's first digit fails at the others too, so these forms find the same matches
# as the plain patterns, in linear time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_NUMBERS = re.compile(r"[0-9]")
#: Of the zones that the field learns from.
_LEARNED = re.compile(r"[0-9@]|[(\[]at[)\]]| dot ")
# All that ``segments`` can make a segment of has a digit, an at sign, or the word ``at`` before a word and a dot, a hyphen or a word for dot.
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]| dot |(?<![^\W\d_])[Aa][Tt](?![^\W\d_])(?=[\s)\]]*+[^\W_]++[\s()\[\]]*+(?:[.-]|(?i:dot|punkt|point|punto)(?![^\W\d_])))")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield begin, 0, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _NUMBERS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                own = m.group().rstrip(" ().-")
                n = sum(c.isdigit() for c in own)
                # A plus, a digit, one or more of the class and a digit at the end: three characters at least.
                if len(own) >= 4 and 10 <= n <= 15:
                    found.append((m.start(), 3, m.start() + len(own)))
    return sorted(found)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)


# ---- the field

MAX_TOKENS = 34
MARGIN = 64
#: Tokens after an at sign that an address takes at most.
REACH = 25
OTHER = 4
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_DOTS = frozenset(("dot", "punkt", "point", "punto"))
# Common last parts of host names.
ENDINGS = frozenset("com org net edu gov info io eu de es fr it uk us ch at nl br mx".split())
_SEPARATORS = frozenset(" .-()[]+/\t\xa0")
DIMS = 1 << 12


def zones(text: str, trigger: re.Pattern = _TRIGGER) -> Iterator[tuple[int, int]]:
    begin = end = -1
    for m in trigger.finditer(text):
        i = m.start()
        if i < end:
            end = i + MARGIN
            continue
        if begin >= 0:
            yield begin, min(end, len(text))
        begin, end = max(0, i - MARGIN, end), i + MARGIN
    if begin >= 0:
        yield begin, min(end, len(text))


def _at_words(tokens: list[str]) -> list[int]:
    return [i for i, t in enumerate(tokens) if t == "@" or t.lower() == "at"]


def segments(tokens: list[str]) -> list[tuple[int, int, int, np.ndarray]]:
    """All segments (first token, end, label, features) that could be of a kind."""
    out: list[tuple[int, int, int, np.ndarray]] = []
    n = len(tokens)
    digits = [t.isdigit() and t.isascii() for t in tokens]
    # Numbers: from one digit run to another, over separators only; a leading plus or bracket may belong to it.
    for i in range(n):
        if not digits[i] or (i and digits[i - 1]):
            continue
        groups, seps, j = [tokens[i]], [], i + 1
        while True:
            total = sum(map(len, groups))
            if total > 19:
                break
            if total >= 4 and j - i <= MAX_TOKENS:
                for label, extra in _numbers(tokens, i, j, groups, seps, total):
                    out.append((i - extra, j, label, _features(tokens, i - extra, j, label, groups, seps, total)))
            k = j
            while k < n and k - j < 4 and tokens[k] and all(c in _SEPARATORS for c in tokens[k]) and len(tokens[k]) <= 2:
                k += 1
            if k == j or k >= n or not digits[k] or k + 1 - i > MAX_TOKENS:
                break
            seps.append("".join(tokens[j:k]))
            groups.append(tokens[k])
            j = k + 1
    # Addresses: around an at sign or the word, with a dot sign or the word on the right.
    for a in _at_words(tokens):
        out += _addresses(tokens, a)
    return out


def _numbers(tokens: list[str], i: int, j: int, groups: list[str], seps: list[str], total: int) -> Iterator[tuple[int, int]]:
    if len(groups) == 4 and all(len(g) <= 3 for g in groups):
        yield 1, 0
    if 13 <= total <= 19:
        yield 2, 0
    if 7 <= total <= 15:
        extra = 0
        while extra < 2 and i - extra and tokens[i - extra - 1] in ("+", "("):
            extra += 1
        yield 3, extra


def _addresses(tokens: list[str], a: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    n = len(tokens)
    left = a
    while left and (tokens[left - 1].isspace() or tokens[left - 1] in "([") and a - left < 2:
        left -= 1
    begins, k = [], left
    while k and left - k < 8 and not tokens[k - 1].isspace() and (tokens[k - 1].isalnum() or tokens[k - 1] in "._%+-"):
        k -= 1
        if tokens[k].isalnum():
            begins.append(k)
    right = a + 1
    while right < n and (tokens[right].isspace() or tokens[right] in ")]") and right - a < 3:
        right += 1
    ends, dots, k = [], 0, right
    while k < n and tokens[k].isalnum() and k - a < REACH:
        if dots:
            ends.append((k + 1, dots))
        k += 1
        m, seen = k, False
        while m < n and m - k < 5 and (tokens[m].isspace() or tokens[m] in "()[].-" or tokens[m].lower() in _DOTS):
            seen |= tokens[m] in ".-" or tokens[m].isalpha()
            m += 1
        if not seen:
            break
        dots, k = dots + 1, m
    for b in begins:
        for e, d in ends:
            if e - b <= MAX_TOKENS:
                yield b, e, 0, _address_features(tokens, b, a, e, d, right)


def _hashed(label: int, names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{label}|{x}".encode(), digest_size=4).digest()) % DIMS for x in names], np.int64)


def _before(tokens: list[str], i: int) -> str:
    k = i - 1
    while k >= 0 and not tokens[k].isalpha() and i - k < 4:
        k -= 1
    return tokens[k].lower() if k >= 0 and tokens[k].isalpha() else ""


#: Words that announce personal data; others count as one.
CUES = frozenset("mail email e-mail phone tel telephone call fax mobile card visa mastercard ip host server address isbn order version invoice page year".split())


def _edges(tokens: list[str], i: int, j: int) -> list[str]:
    left, right = tokens[i - 1][-1:] if i else "^", tokens[j][:1] if j < len(tokens) else "$"
    kind = lambda c: "s" if c.isspace() or c in "^$" else "a" if c.isalnum() else c if c in "+-./@" else "p"
    cue = _before(tokens, i)
    return [f"left {kind(left)}", f"right {kind(right)}", f"cue {cue if cue in CUES else ''}", "bias"]


def _features(tokens: list[str], i: int, j: int, label: int, groups: list[str], seps: list[str], total: int) -> np.ndarray:
    names = _edges(tokens, i, j)
    kinds = sorted({"".join(sorted(set(s))) for s in seps})
    lead = "".join(t for t in tokens[i:j] if t in "+(")[:2]
    names += [f"groups {min(len(groups), 6)}", f"seps {'|'.join(kinds)}", f"lead {lead[:1] if tokens[i] in '+(' else groups[0][:2] if groups[0][:2] == '00' else ''}"]
    if label == 1:
        names.append(f"parts {all(int(g) <= 255 for g in groups)}")
        names.append(f"digits {total >= 6}")
        # Version numbers and dates are mostly of one-digit parts.
        names.append(f"wide {sum(len(g) > 1 for g in groups)}")
    elif label == 2:
        names += [f"luhn {luhn(''.join(groups))}", f"digits {total}", f"luhn {luhn(''.join(groups))} {total >= 14}"]
    else:
        names += [f"digits {total}", f"longest {max(map(len, groups))}", f"last {len(groups[-1])}"]
    return _hashed(label, names)


def _address_features(tokens: list[str], b: int, a: int, e: int, dots: int, right: int) -> np.ndarray:
    names = _edges(tokens, b, e)
    sign = "@" if tokens[a] == "@" else "(at)" if a and tokens[a - 1] in "([" else "at"
    inner = tokens[right:e]
    spelt = any(t.lower() in _DOTS for t in inner)
    # What stands between the words of the host: a sentence that ends has a dot and a blank there.
    shapes, k = set(), right
    while k < e - 1:
        m = k + 1
        while m < e - 1 and not (tokens[m].isalnum() and tokens[m].lower() not in _DOTS):
            m += 1
        shapes.add("".join("w" if t.isalpha() else " " if t.isspace() else t for t in tokens[k + 1 : m]))
        k = m
    last = tokens[e - 1]
    names += [f"between {'|'.join(sorted(shapes))}", f"case {last.islower()}", f"common {last.lower() in ENDINGS}", f"common {last.lower() in ENDINGS} sign {sign}"]
    names += [f"sign {sign}", f"dots {min(dots, 3)}", f"sign {sign} spelt {spelt}", f"last {min(len(tokens[e - 1]), 5)} {tokens[e - 1].isalpha()}", f"gap {right - a > 1}", f"plain {'.' in inner}"]
    return _hashed(0, names)


class Field:
    """Weights of hashed features, and of pairs of neighbouring labels."""

    def __init__(self, w: np.ndarray | None = None, pair: np.ndarray | None = None):
        self.w = np.zeros(DIMS) if w is None else w
        self.pair = np.zeros((5, 5)) if pair is None else pair

    def _by_end(self, n: int, segs: list) -> list[list[tuple[int, int, int]]]:
        ends: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        for s, (i, j, label, _) in enumerate(segs):
            ends[j].append((i, label, s))
        return ends

    def decode(self, n: int, segs: list) -> list[tuple[int, int, int]]:
        """The best segments other than ``other``."""
        if not segs:
            return []
        score = [float(self.w[f].sum()) for *_, f in segs]
        ends, pair = self._by_end(n, segs), self.pair
        best = np.full((n + 1, 5), -np.inf)
        best[0, OTHER] = 0
        back: list[list] = [[None] * 5 for _ in range(n + 1)]
        for j in range(1, n + 1):
            k = int((best[j - 1] + pair[:, OTHER]).argmax())
            best[j, OTHER], back[j][OTHER] = best[j - 1, k] + pair[k, OTHER], (j - 1, k)
            for i, label, s in ends[j]:
                k = int((best[i] + pair[:, label]).argmax())
                v = best[i, k] + pair[k, label] + score[s]
                if v > best[j, label]:
                    best[j, label], back[j][label] = v, (i, k)
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i, k = back[j][y]
            if y != OTHER:
                out.append((i, j, y))
            j, y = i, k
        return out[::-1]

    def gradient(self, n: int, segs: list, truth: list[tuple[int, int, int]]) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
        """Of the log-likelihood of ``truth``: coefficients of segments' features, and of pairs."""
        score = [float(self.w[f].sum()) for *_, f in segs]
        ends, pair = self._by_end(n, segs), self.pair
        fore, rear = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        fore[0, OTHER] = 0
        for j in range(1, n + 1):
            fore[j, OTHER] = np.logaddexp.reduce(fore[j - 1] + pair[:, OTHER])
            for i, label, s in ends[j]:
                fore[j, label] = np.logaddexp(fore[j, label], np.logaddexp.reduce(fore[i] + pair[:, label]) + score[s])
        whole = np.logaddexp.reduce(fore[n])
        rear[n] = 0
        d_pair, coefficients = np.zeros((5, 5)), [0.0] * len(segs)
        for j in range(n, 0, -1):
            flow = fore[j - 1] + pair[:, OTHER] + rear[j, OTHER]
            rear[j - 1] = np.logaddexp(rear[j - 1], pair[:, OTHER] + rear[j, OTHER])
            d_pair[:, OTHER] -= np.exp(flow - whole)
            for i, label, s in ends[j]:
                flow = np.exp(fore[i] + pair[:, label] + score[s] + rear[j, label] - whole)
                rear[i] = np.logaddexp(rear[i], pair[:, label] + score[s] + rear[j, label])
                d_pair[:, label] -= flow
                coefficients[s] -= float(flow.sum())
        known = {(i, j, y): s for s, (i, j, y, _) in enumerate(segs)}
        at, last = 0, OTHER
        for i, j, y in [*truth, (n, n, -1)]:
            for _ in range(at, i):
                d_pair[last, OTHER] += 1
                last = OTHER
            if y >= 0:
                d_pair[last, y] += 1
                coefficients[known[i, j, y]] += 1
                at, last = j, y
        return [(segs[s][3], c) for s, c in enumerate(coefficients) if abs(c) > 1e-6], d_pair


def example(text: str, spans: list[Span]) -> tuple[int, list, list[tuple[int, int, int]]] | None:
    """Tokens, segments and true segments of a zone; None where a span is no segment."""
    tokens = [m.group() for m in _TOKEN.finditer(text)]
    starts = np.cumsum([0] + [len(t) for t in tokens]).tolist()
    place = {c: i for i, c in enumerate(starts)}
    segs = segments(tokens)
    known = {(i, j, y) for i, j, y, _ in segs}
    truth, end = [], 0
    for b, k, e in spans:
        if b not in place or e not in place or (place[b], place[e], k) not in known or b < end:
            return None
        truth.append((place[b], place[e], k))
        end = e
    return (len(tokens), segs, truth) if segs else None


def rewritten(kind: int, span: str, rng: random.Random) -> str:
    """Another spelling of a span."""
    if kind == 0:
        at = rng.choice(["@", " @ ", " at ", " (at) ", " [at] "])
        dot = rng.choice([".", " dot ", " [dot] "]) if at != "@" else rng.choice([" dot ", " . "])
        local, _, domain = span.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", rng.choice(["[.]", " . ", "-", " "]))
    digits = re.sub(r"\D", "", span)
    if kind == 2:
        return rng.choice([".", "  ", " - ", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    code = digits[:-10] or "1"
    return rng.choice([f"00{code} {area} {first} {last}", f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{code}-{area}-{first}-{last}", f"+{code}/{area}/{first} {last}"])


def made_up(kind: int, rng: random.Random) -> str:
    """A span in its plain spelling."""
    def word(least: int, most: int) -> str:
        return "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(least, most)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    if kind == 0:
        name = rng.choice([word(3, 8), f"{word(2, 6)}.{word(2, 8)}", f"{word(2, 6)}_{digits(2)}", f"{word(1, 1)}.{word(3, 8)}", f"{word(2, 5)}{digits(2)}"])
        return f"{name}@{rng.choice(['', f'{word(3, 6)}.'])}{word(3, 10)}.{rng.choice(sorted(ENDINGS) + ['com', 'org', 'net'] * 4 + [word(2, 4)] * 3)}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        while not luhn(long := rng.choice("3456") + digits(rng.randint(14, 15))):
            pass
        return long
    return f"+{rng.randint(1, 99)} {rng.randint(200, 999)} {rng.randint(200, 999)} {digits(4)}"


def harmless(rng: random.Random) -> str:
    """A number or a phrase that is no personal data."""
    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    while luhn(long := digits(rng.randint(13, 19))):
        pass
    return rng.choice([
        long, f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2099)}", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{digits(3)}.{digits(3)}", digits(rng.randint(4, 12)), f"{digits(3)},{digits(3)}.{digits(2)}", f"{rng.randint(1900, 2099)} {rng.randint(1900, 2099)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        f"{rng.choice(NOUNS)} at {rng.choice(NOUNS)}. {rng.choice(NOUNS).title()}", f"{rng.choice(NOUNS)} at {rng.choice(NOUNS)} . {rng.choice(NOUNS).title()}", f"{rng.choice(NOUNS)} at {rng.choice(NOUNS)}-{rng.choice(NOUNS)}",
        "look at the station . Then", "at home. The", f"at {rng.randint(1, 12)} . It", "meet at noon dot by dot", f"{digits(2)} {digits(2)} {digits(2)}", "v1.2.3.4 at once",
    ])


NOUNS = "look station home noon house work school dinner night people once least last first all arrive stay meet smile price".split()


def training_zones(docs: list[str], rng: random.Random, sample_spans: int = 1500) -> list:
    words = ["mail", "the", "call", "of", "und", "la", "que", "number", "a", "tel", "write", "to", "in"]
    out, seen = [], []
    for text in docs:
        spans = base_spans(text)
        for b, e in zones(text, _LEARNED):
            own = [(x - b, k, y - b) for x, k, y in spans if b <= x and y <= e]
            out.append(example(text[b:e], own))
        seen += [(k, text[x:y]) for x, k, y in spans]
    # Spans of the documents, and as many of each kind that are made up: what the documents hold decides on none.
    rng.shuffle(seen)
    made = [(kind, made_up(kind, rng)) for kind in range(len(KINDS)) for _ in range(sample_spans // len(KINDS))]
    for kind, span in [*seen[:sample_spans], *made]:
        for new in (rewritten(kind, span, rng), span):
            before, after = " ".join(rng.choices(words, k=3)) + " ", rng.choice([" ", ". ", ", "]) + " ".join(rng.choices(words, k=3))
            out.append(example(before + new + after, [(len(before), kind, len(before) + len(new))]))
    for _ in range(1500):
        out.append(example(" ".join(rng.choices(words, k=3)) + " " + harmless(rng) + " " + " ".join(rng.choices(words, k=3)), []))
    return [x for x in out if x]


def learn(docs: list[str], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4, sample_spans: int = 1500) -> Field:
    rng = random.Random(11)
    field, rows = Field(), training_zones(docs, rng, sample_spans)
    g2, p2 = np.full(DIMS, 1e-2), np.full((5, 5), 1e-2)
    for _ in range(epochs):
        rng.shuffle(rows)
        for row in rows:
            parts, d_pair = field.gradient(*row)
            for f, c in parts:
                g = c - l2 * field.w[f]
                np.add.at(g2, f, g * g)
                np.add.at(field.w, f, rate * g / np.sqrt(g2[f]))
            p2 += d_pair * d_pair
            field.pair += rate * d_pair / np.sqrt(p2)
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds beside the base spans."""
    out: list[Span] = []
    for b, e in zones(text):
        zone = text[b:e]
        tokens = [m.group() for m in _TOKEN.finditer(zone)]
        segs = segments(tokens)
        if not segs:
            continue
        starts = np.cumsum([0] + [len(t) for t in tokens]).tolist()
        for i, j, y in field.decode(len(tokens), segs):
            span = (b + starts[i], y, b + starts[j])
            if all(span[2] <= x or z <= span[0] for x, _, z in base) and all(span[2] <= x or z <= span[0] for x, _, z in out[-1:]):
                out.append(span)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, sample_zones: int = 1500, sample_spans: int = 1500) -> Field:
    """Fitted in one task on a bounded sample: only the zones travel, ``sample_zones`` of them at most, and ``sample_spans`` of their spans, and as
    many made-up ones, are rewritten."""
    spark = docs.sparkSession
    n = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[b:e] for x in batch.column(0).to_pylist() for b, e in zones(x, _LEARNED)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["zone"])

    space = Workspace(spark, "pii")
    sample = space.table(docs.filter((draw < F.lit(sample_docs / n)) & F.col(text_col).rlike(_LEARNED.pattern)).select(F.col(text_col).alias("t")).mapInArrow(cut, "zone string").orderBy(F.md5("zone")).limit(sample_zones), "zones")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = learn(sorted(x for batch in batches for x in batch.column(0).to_pylist()), sample_spans=sample_spans)
        yield pa.RecordBatch.from_arrays([pa.array([field.w.tobytes()], pa.binary()), pa.array([field.pair.tobytes()], pa.binary())], names=["w", "pair"])

    row = sample.coalesce(1).mapInArrow(train, "w binary, pair binary").first()
    field = Field()
    if row:
        field.w, field.pair = np.frombuffer(row["w"]).copy(), np.frombuffer(row["pair"]).reshape(5, 5).copy()
    return field


ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def find_pii(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` plus the numbers of base spans by kind, their digest, all spans, and the number of added ones."""
    keep = others(docs, *ADDED)
    own = docs.select(*(F.col(f"`{c}`") for c in keep))
    shared = docs.sparkSession.sparkContext.broadcast((field.w, field.pair))  # DIMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            rows = []
            for text in batch.column(len(keep)).to_pylist():
                if not text or not _TRIGGER.search(text):
                    rows.append((0, 0, 0, 0, NOTHING, "", 0))
                    continue
                base = base_spans(text)
                new = added_spans(text, base, own)
                n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(sorted([*base, *new])), len(new)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keep, *ADDED])

    kinds = [T.LongType()] * 4 + [T.StringType(), T.StringType(), T.LongType()]
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, t) for c, t in zip(ADDED, kinds, strict=True))])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias(free_name(docs, "_text"))).mapInArrow(run, schema)


#: The digest of no spans.
NOTHING = hashlib.sha256(b"").hexdigest()


def mask(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, done = [], 0
    for kind, b, e in (x.split(":") for x in spans.split(",") if x):
        if int(b) >= done:
            out += [text[done : int(b)], f"<{kind}>"]
            done = int(e)
    return "".join([*out, text[done:]])
