"""Conversation structure repair: the cheapest edits that give a conversation the turns ``(s?(ua)+)?`` of system, user and assistant.

A turn can be kept (0), given the role user or assistant (R, 3) or deleted (D, 4), and an empty turn of either role can be inserted anywhere
(I, 3). Blank turns and repeats must be deleted; a truncated turn that is not deleted costs 3 more. The state of the grammar is what came
last: nothing, system, user or assistant, and every edit leads to one state only. A backward pass gives the cost to go from every turn and
state; a forward walk takes the ASCII-least edit of those whose cost and cost to go make up that sum, which yields the least audit of all
cheapest ones, as the rest of the way depends on turn and state alone.

Conversations of any length are cut into blocks of ``BLOCK`` turns:

1. Turns are dealt by ranges of conversation and turn, sorted, numbered in that order and written. Repeats are found by the first number of
   each different turn of a conversation, joined back with frequent ones spread.
2. A block's part of a conversation has a matrix: least costs from any state before it to any state behind it.
3. Per conversation, its matrices give backward the cost to go behind each part; a stream with four numbers in hand.
4. Each part is walked from all four states, in parallel, and a forward stream takes the walk that begins where the one before it ended.
5. Edits are joined with their turns by number, and repaired turns come out.

So no task holds a conversation, but the digest of a conversation is one SHA-256, which can only be made by one task; it streams.

Defined results: a null role or text is one space; turns are taken by number, nulls first, and turns of one number by the MD5 of
conversation, role and text; a null id is a conversation of its own; an empty role begins with no letter and cannot be kept; equal rows repeat
each other; an empty table gives an empty table; other columns, whatever their names, are not read. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import Workspace, spread_left

BLANKS = " \t\n\x0b\x0c\r"
#: Turns of a block, as a power of two.
BLOCK_BITS = 10
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = 1 << 40
#: States: nothing yet, after system, after user, after assistant. The role that an inserted or re-roled turn has, and where it leads.
MADE = ("u", "u", "a", "u")
NEXT = (2, 2, 3, 2)
#: Where a kept turn leads, by state and initial.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LEGAL = {"su", "ua", "au"}
Vector = list[int]


def relaxed(costs: Vector) -> Vector:
    """With turns inserted first: two at most, as a third leads back to the state after the first."""
    return [min(costs[s], INSERT + costs[NEXT[s]], 2 * INSERT + costs[NEXT[NEXT[s]]]) for s in range(4)]


#: Cost to go behind the last turn: nothing and after assistant are ends.
END = relaxed([0, FAR, FAR, 0])


def stayed(code: str, s: int, after: Vector) -> tuple[int, int]:
    """Cost to go by keeping the turn and by giving it a role. ``code`` is the initial of its role and its fault."""
    initial, fault = code
    if fault in "bd":
        return FAR, FAR
    more = TRUNCATED if fault == "t" else 0
    to = KEPT[s].get(initial)
    return FAR if to is None else more + after[to], REROLE + more + after[NEXT[s]]


def before(code: str, after: Vector) -> Vector:
    return relaxed([min(DELETE + after[s], *stayed(code, s, after)) for s in range(4)])


def costs_to_go(codes: list[str], end: Vector) -> list[Vector]:
    out = [end]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def matrix(codes: list[str]) -> list[Vector]:
    """Least costs from a state before the turns (row) to a state behind the last (column)."""
    columns = [costs_to_go(codes, [0 if s == e else FAR for s in range(4)])[0] for e in range(4)]
    return [[min(columns[e][s], FAR) for e in range(4)] for s in range(4)]


def walk(codes: list[str], costs: list[Vector], s: int, last: bool) -> tuple[str, int]:
    """Edits with the roles that they give, and the state behind them; behind the ``last`` turn of a conversation turns are inserted too."""
    out = []
    for i, code in enumerate(codes):
        here, after = costs[i], costs[i + 1]
        while here[s] != DELETE + after[s] and here[s] == INSERT + here[NEXT[s]]:
            out.append("I" + MADE[s])
            s = NEXT[s]
        keep, rerole = stayed(code, s, after)
        if here[s] == DELETE + after[s]:
            out.append("D")
        elif here[s] == keep:
            out.append("K")
            s = KEPT[s][code[0]]
        else:
            out.append("R" + MADE[s])
            s = NEXT[s]
    while last and s in (1, 2):
        out.append("I" + MADE[s])
        s = NEXT[s]
    return "".join(out), s


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, role, text, print, seq) to be written; ``seq`` ascends by conversation and turn."""
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    whole = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit("|"), F.length("role"), F.lit(":"), F.col("role"), F.col("text"))
    # Equal rows are dealt by where they were read, as their order among each other does not matter.
    order = ["conv", "turn", "print", "_spread"]
    own = own.withColumn("print", F.md5(whole)).withColumn("_spread", F.monotonically_increasing_id())
    return own.repartitionByRange(*order).sortWithinPartitions(*order).drop("_spread").withColumn("seq", F.monotonically_increasing_id())


def coded(rows: DataFrame, space: Workspace) -> DataFrame:
    """Rows (conv, seq, code): the initial of the role and the first fault, ``b`` blank, ``d`` seen earlier, ``t`` truncated, ``.`` none."""
    ends = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    initial = F.when(F.length("role") == 0, "-").otherwise(F.left("role", F.lit(1)))
    slim = rows.select("conv", "seq", "print", initial.alias("initial"), ends.alias("ends"))
    counts = space.table(rows.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).filter("n > 1"), "repeats")
    met = spread_left(slim, counts.select("print", "first"), "print", counts.select("print", "n"), rows.count(), space)
    fault = F.when(F.col("ends") == "", "b").when(F.col("seq") > F.col("first"), "d").when(~F.col("ends").isin(".", "!", "?"), "t").otherwise(".")
    return met.select("conv", "seq", F.concat("initial", fault).alias("code"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


def _schema(conv: T.DataType, fields: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(fields).fields])
    return spark, to_arrow_schema(spark)


def parts(codes: DataFrame) -> DataFrame:
    """The turns of a conversation within a block: ``seg`` is the number of the first; with its codes, matrix and counts."""
    out, arrow = _schema(codes.schema["conv"].dataType, "seg long, codes array<string>, matrix array<long>, blank long, duplicate long, truncated long, illegal long")

    def block(table: pa.Table) -> pa.Table:
        rows, held = [], []
        names, seqs, marks = (table.column(c).to_pylist() for c in ("conv", "seq", "code"))
        for i in sorted(range(len(seqs)), key=seqs.__getitem__):
            if not held or held[-1][0] != names[i]:
                held.append((names[i], seqs[i], []))
            held[-1][2].append(marks[i])
        for name, seg, own in held:
            faults = "".join(c[1] for c in own)
            illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(own, own[1:], strict=False))
            rows.append((name, seg, own, [x for v in matrix(own) for x in v], faults.count("b"), faults.count("d"), faults.count("t"), illegal))
        return pa.Table.from_batches([_batch(rows, arrow)])

    return codes.groupBy(F.shiftright("seq", BLOCK_BITS).alias("block")).applyInArrow(block, out)


def behind(segments: DataFrame) -> DataFrame:
    """Cost to go behind each part (seg, after, last), from the last part of a conversation to its first."""
    out = T.StructType.fromDDL("seg long, after array<long>, last boolean, cost long")
    arrow = pa.schema([("seg", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("cost", pa.int64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, costs = object(), END
        for batch in batches:
            rows = []
            for name, seg, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = name != now
                if last:
                    now, costs = name, END
                after = costs
                costs = [min(m[4 * s + e] + after[e] for e in range(4)) for s in range(4)]
                rows.append((seg, after, last, costs[0]))
            yield _batch(rows, arrow)

    return segments.select("conv", "seg", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("seg")).mapInArrow(stream, out)


def walks(segments: DataFrame, space: Workspace) -> DataFrame:
    """Per part (conv, seg) the edits ``plan``, the cost of the conversation from here on, and counts, with pairs across parts among the illegal ones."""
    ways, ways_arrow = _schema(segments.schema["conv"].dataType, "seg long, plans array<string>, ends array<long>, cost long, blank long, duplicate long, truncated long, illegal long, head string, tail string")
    out, arrow = _schema(segments.schema["conv"].dataType, "seg long, plan string, cost long, blank long, duplicate long, truncated long, illegal long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                costs = costs_to_go(r["codes"], r["after"])
                found = [walk(r["codes"], costs, s, r["last"]) for s in range(4)]
                rows.append((r["conv"], r["seg"], [x for x, _ in found], [s for _, s in found], *(r[c] for c in ("cost", "blank", "duplicate", "truncated", "illegal")), r["codes"][0][0], r["codes"][-1][0]))
            yield _batch(rows, ways_arrow)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s, tail = object(), 0, ""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                first = r["conv"] != now
                if first:
                    now, s = r["conv"], 0
                rows.append((now, r["seg"], r["plans"][s], r["cost"] if first else 0, r["blank"], r["duplicate"], r["truncated"], r["illegal"] + (not first and tail + r["head"] not in LEGAL)))
                s, tail = r["ends"][s], r["tail"]
            yield _batch(rows, arrow)

    found = segments.join(behind(segments).hint("merge"), "seg").select("conv", "seg", "codes", "after", "last", "cost", "blank", "duplicate", "truncated", "illegal").mapInArrow(each, ways)
    return space.table(found.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(chosen, out), "walks")


class Repair:
    """``turns()`` are the repaired turns, ``report()`` has a row for each conversation."""

    def __init__(self, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv, self.space = conv, Workspace(conversations.sparkSession, "structure")
        self.rows = self.space.table(numbered(conversations, conv, turn, role, text), "rows")
        self.segments = self.space.table(parts(coded(self.rows, self.space)), "parts")
        self.walks = walks(self.segments, self.space)

    def turns(self) -> DataFrame:
        """Rows (conv, seq, k, turn, role, text, edit) in the order of ``seq`` and ``k``; ``turn`` is that of the turn that was kept or given another
        role, or beside which one was inserted."""
        tokens = F.regexp_extract_all("plan", F.lit("(?:I[ua])*(?:D|K|R[ua])(?:(?:I[ua])+$)?"), F.lit(0))
        edits = self.walks.select("seg", F.posexplode(tokens).alias("at", "edits")).select((F.col("seg") + F.col("at")).alias("seq"), F.regexp_extract_all("edits", F.lit("[IR][ua]|D|K"), F.lit(0)).alias("edits"))
        # Plans are written small and unfold to far more: not for a broadcast.
        made = self.rows.join(edits.hint("merge"), "seq").select("conv", "seq", "turn", "role", "text", F.posexplode("edits").alias("k", "edit")).filter("edit != 'D'")
        given = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit").endswith("u"), "user").otherwise("assistant")
        return made.select("conv", "seq", "k", "turn", given.alias("role"), F.when(F.col("edit").startswith("I"), "").otherwise(F.col("text")).alias("text"), F.left("edit", F.lit(1)).alias("edit"))

    def digests(self) -> DataFrame:
        """SHA-256 of the lines ``role:text`` of each conversation that has turns left, joined by newlines."""
        out, arrow = _schema(self.rows.schema["conv"].dataType, "digest string")

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, any_yet = None, None, False
            for batch in batches:
                rows = []
                for name, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if not any_yet or name != now:
                        if any_yet:
                            rows.append((now, state.hexdigest()))
                        now, state, any_yet = name, hashlib.sha256(), True
                    else:
                        state.update(b"\n")
                    state.update(line.as_py())
                yield _batch(rows, arrow)
            if any_yet:
                yield _batch([(now, state.hexdigest())], arrow)

        lines = self.turns().select("conv", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"), "seq", "k")
        return lines.repartition("conv").sortWithinPartitions("conv", "seq", "k").select("conv", "line").mapInArrow(stream, out)

    def report(self, ids: DataFrame | None = None) -> DataFrame:
        """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. ``ids`` may name conversations that have no turns."""
        turn = F.col("turn").cast("long")
        gaps = self.rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        told = F.transform(F.array_sort(F.collect_list(F.struct("seg", F.translate("plan", "ua", "").alias("audit")))), lambda x: x["audit"])
        audits = self.walks.groupBy("conv").agg(*sums, F.array_join(told, "").alias("audit"))
        united = gaps.unionByName(audits, allowMissingColumns=True).unionByName(self.digests(), allowMissingColumns=True)
        if ids is not None:
            united = united.unionByName(ids.select(F.col(self.conv).alias("conv")).distinct(), allowMissingColumns=True)
        # By grouping, and not by joins, as the id may be null.
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        merged = united.groupBy("conv").agg(*(F.max(c).alias(c) for c in [*counts, "audit", "digest"]))
        return merged.select(F.col("conv").alias(self.conv), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with known faults, drawn by the CRC-32 of ``conv:turn`` modulo 20, nulls taken for one space: 0 is dropped, 1 loses its text, 2 its
    ``[.!?]``, 3 is repeated and 4 becomes the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw: Column = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    own = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), draw.alias("draw"))
    changed = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = own.filter("draw != 0").select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).drop("copy")
