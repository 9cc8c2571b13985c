"""Benchmark decontamination: a generalised suffix automaton of the normalised test items, through which the training texts stream.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The automaton holds all
substrings of all items. A text's words run through it with the length of the longest match that ends at each word; where that length
reaches a window's, the state (or the one suffix link above that still covers the window) tells the items, and the words are hit.

Items are dealt into shards of at most ``shard_words`` words, long ones in pieces that overlap by a window less one word. Shards have their
turn one after the other: one is broadcast, the texts stream through its automaton, their hits are written, and it is given up before the
next one comes. So neither the driver nor a task ever holds more than one shard, whatever the size of the benchmark. Hits of all shards are united
by the texts' digests; with a single shard this is spared. A text is read in pieces, so its length does not matter.

Defined results: null and empty texts have no words and no hits, null and empty items no windows; a repeated item counts under each of
its ids, and a repeated (id, text) row once; a repeated document row gives a row each; an empty table gives an empty table or no hits;
other columns stay, but for those named like an added one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import Workspace, free_name, others, spread_left
from parley.llm.words import BLOCK, SPACE, TABLE


class SuffixAutomaton:
    """Of several sequences of word numbers. Built online: each sequence begins at the root again."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words)))
        self._windows(items)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.next) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """A copy of ``to`` for the strings of ``state`` plus ``word`` and shorter ones."""
        copy = self._new(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (to := self.next[last].get(word)) is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            to = self.next[last][word]
            self.link[new] = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        return new

    def _windows(self, items: list[tuple[str, list[bytes]]]) -> None:
        """``found[state]``: (length, item ids) of each window that the strings of a state can end with, but for those of its link."""
        ends: dict[tuple[int, int], set[str]] = {}
        for name, words in items:
            size = min(self.window, len(words))
            if not size:
                continue
            state = length = 0
            for i, w in enumerate(words):
                state, length = self.next[state][self.words[w]], length + 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                length = min(length, size)
                if i + 1 >= size:
                    ends.setdefault((state, size), set()).add(name)
        self.found: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        for (state, size), names in ends.items():
            self.found.setdefault(state, []).append((size, tuple(sorted(names))))
        self.least = min((size for _, size in ends), default=1 << 60)
        # Where to look next on the way up the suffix links, past states without windows.
        self.up = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[s]
            self.up[s] = above if above in self.found else self.up[above]

    def stream(self, words: list[bytes], at: int, state: int, length: int, spans: list[list[int]], items: set[str]) -> tuple[int, int]:
        """Run ``words``, the first of which is word number ``at``; hits extend ``spans`` (ascending, disjoint). Returns where it stands."""
        moves, link, longest, found, up, least = self.next, self.link, self.length, self.found, self.up, self.least
        for i, w in enumerate(map(self.words.get, words), at + 1):
            if w is None:
                state = length = 0
                continue
            while (to := moves[state].get(w)) is None and state:
                state = link[state]
                length = longest[state]
            if to is None:
                continue
            state, length = to, length + 1
            if length >= least:
                s, most = state if state in found else up[state], 0
                while s:
                    for size, names in found[s]:
                        if size <= length:
                            most = max(most, size)
                            items.update(names)
                    s = up[s]
                if most:
                    begin = i - most
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append([begin, i])
        return state, length


def pieces_of(text: bytes | None) -> Iterator[bytes]:
    """Normalised pieces of a text, cut between words."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and TABLE[text[end]] != SPACE:
            end += 1
        yield text[at:end].translate(TABLE)
        at = end


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Ascending and disjoint; spans that touch are one."""
    out: list[list[int]] = []
    for begin, end in sorted(map(tuple, spans)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def scan(automaton: SuffixAutomaton, text: bytes | None) -> tuple[int, list[list[int]], set[str]]:
    """Number of words, spans of hit words and the items found."""
    n, items, spans, at = 0, set(), [], (0, 0)
    for piece in pieces_of(text):
        words = piece.split()
        at = automaton.stream(words, n, *at, spans, items)
        n += len(words)
    return n, spans, items


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans, and without what stands between the words of a span."""
    out, done, n, at, k = [], 0, 0, 0, 0
    for piece in pieces_of(text):
        inside = piece.split()
        if k >= len(spans):
            break
        if spans[k][0] >= n + len(inside):  # no span begins or ends here
            n += len(inside)
            at += len(piece)
            continue
        pos = 0
        for w in inside:
            begin = piece.index(w, pos)
            pos = begin + len(w)
            if k < len(spans) and n == spans[k][0]:
                out.append(text[done : at + begin])
            if k < len(spans) and n == spans[k][1] - 1:
                done = at + pos
                k += 1
            n += 1
        at += len(piece)
    return b"".join([*out, text[done:]])


def item_pieces(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> DataFrame:
    """(id, piece, words: normalised, n) of ``most`` words at most. Any window of an item lies in one of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.translate(TABLE).split()
                for i, at in enumerate(range(0, max(1, len(words) - window + 1), most - window + 1)):
                    own = words[at : at + most]
                    if own:
                        rows.append((name, i, b" ".join(own), len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["id", "piece", "words", "n"])

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.encode(F.col(text_col), "utf-8").alias("text")).filter("id is not null and text is not null")
    return rows.distinct().mapInArrow(run, "id string, piece int, words binary, n long")


def shards(items: DataFrame, id_col: str, text_col: str, window: int, shard_words: int, space: Workspace) -> tuple[DataFrame, int]:
    """The pieces with the number of their shard, and how many shards there are. By hash, to half of ``shard_words`` on the average."""
    pieces = space.table(item_pieces(items, id_col, text_col, window, max(2 * window, shard_words // 16)), "pieces")
    whole = pieces.agg(F.sum("n")).first()[0] or 0
    n = 1 if whole <= shard_words else -(-2 * whole // shard_words)
    return pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(n))), n


ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


COLUMNS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int64())), pa.string())


def told(text: bytes | None, n: int, spans: list[list[int]], names: set[str], min_span: int) -> tuple:
    """The added columns of a text."""
    long = [x for x in spans if x[1] - x[0] >= min_span]
    clean = cut(text, long).decode() if long else None
    return n, sum(e - b for b, e in spans), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(spans), spans, clean


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, item_id: str = "item_id", text_col: str = "text", shard_words: int = 2_000_000, min_span: int = 1) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words, end exclusive) and ``clean_text``: the
    text without the hit spans of ``min_span`` words or more, null where it has none."""
    spark = docs.sparkSession
    space = Workspace(spark, "decontam")
    pieces, n_shards = shards(items, item_id, text_col, window, shard_words, space)
    keep = others(docs, *ADDED, "clean_text")
    raw = free_name(docs, "_raw")
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.encode(F.col(text_col), "utf-8").alias(raw))
    schema = T.StructType([*docs.select(*(F.col(f"`{c}`") for c in keep)).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("clean_text", T.StringType())])

    def shard(number: int):
        """One shard, which is bounded, by way of the driver."""
        rows = pieces.filter(F.col("shard") == number).orderBy("id", "piece").select("id", "words").collect()
        return spark.sparkContext.broadcast([(r["id"], bytes(r["words"]).split()) for r in rows])

    def out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(v, t) for v, t in zip(list(zip(*rows, strict=True)) or [[]] * len(COLUMNS), COLUMNS, strict=True))], names=[*keep, *ADDED, "clean_text"])

    if n_shards == 1:
        only = shard(0)

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(only.value, window)
            for batch in batches:
                yield out(batch, [told(x, *scan(automaton, x), min_span) for x in (y.as_py() for y in batch.column(len(keep)))])

        return own.mapInArrow(direct, schema)

    unit = free_name(docs, "_unit")
    own = own.withColumn(unit, F.unhex(F.md5(raw)))
    found = None
    for number in range(n_shards):
        one = shard(number)

        def hits(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(one.value, window)
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    _, spans, names = scan(automaton, text.as_py())
                    if spans:
                        rows.append((key, spans, sorted(names)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.binary(), COLUMNS[5], pa.list_(pa.string())), strict=True)], names=["unit", "spans", "names"])

        part = space.table(own.select(unit, raw).mapInArrow(hits, "unit binary, spans array<array<long>>, names array<string>"), f"hits{number}")
        one.destroy()
        found = part if found is None else found.unionByName(part)
    n_found = found.count()
    some = found.withColumnRenamed("unit", unit)
    table = some.groupBy(unit).agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias(f"{unit}s"), F.array_distinct(F.flatten(F.collect_set("names"))).alias(f"{unit}n"))
    rows = spread_left(own, table, unit, some.groupBy(unit).agg(F.count(F.lit(1)).alias("n")), n_found, space).select(*keep, raw, f"{unit}s", f"{unit}n")

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, names in zip(*(batch.column(len(keep) + i) for i in range(3)), strict=True):
                text = text.as_py()
                rows.append(told(text, sum(len(p.split()) for p in pieces_of(text)), merged(spans.as_py() or []), set(names.as_py() or []), min_span))
            yield out(batch, rows)

    return rows.mapInArrow(united, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_id: str = "item_id", shard_words: int = 2_000_000) -> DataFrame:
    """Texts lose their hit spans of ``min_span`` words or more, the length limit; a shorter one stays. A text of whose words more than
    ``max_coverage`` are hit goes altogether, the coverage limit."""
    marked = "_decontam"
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(marked), F.col(text_col).alias("text"))
    found = find_items(own, items, window, item_id, "text", shard_words, min_span)
    found = found.filter(~F.col("contaminated") | (F.col("n_hit") <= max_coverage * F.col("n_words")))
    text = F.coalesce("clean_text", "text")
    return found.select(*(text.alias(c) if c == text_col else F.col(f"{marked}.`{c}`").alias(c) for c in docs.columns))
