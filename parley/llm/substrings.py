"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

A seed is a pair of k-mers of words, so that a short line that many texts hold makes none: the first is the smallest, by hash, of ``window``
consecutive ones, the second the smallest of those that begin ``NEAR`` to ``FAR`` words after it. Texts that share ``window + k + FAR + k`` words
in a row share a seed; ``k`` is small, as either k-mer of a fuzzy passage must be intact. A passage of ``min_words`` words must hold a seed whole.

Rows with equal texts are one unit, so copies cost nothing; of all places of a seed the first, by (unit, position), is its hub, and every
place in another unit is a match with the hub; so a seed of n places gives n - 1 matches, not all pairs. Where a task meets a seed more than
``LOCAL`` times, its places there are matched with the first of them, and only that one meets the places of other tasks: so no seed, however
frequent, gathers its places in one task. The matches of a unit with a hub are gathered in one row, which its own length bounds. They
are chained: a chain ascends in both texts, and its score is k for every k-mer less a gap cost for every word that it advances in
either. As that cost is linear, the best predecessor of a match is a prefix maximum over positions in the hub, which a Fenwick tree keeps.

What the hub leaves is gone on with: a place of a seed that no passage covers is compared with the seed's other places too, ``ROUND`` of them
in a first round, and if no passage covers it then, with all others. The places of a seed meet in
blocks; bags of words rule most pairs out, the others are aligned in place, many at once, and the first that has a passage with it is a
place's match. So a group of texts that share a passage gives a match for each, not all pairs.

Chains are then aligned on the words: gaps between seeds by the longest common subsequence, the ends outwards along the diagonal while the
score does not drop too far; on slices of both texts, and where an end came to the end of a slice, all chains of these two texts once more on slices
``WIDER`` times as wide, until none does. Passages of ``min_words`` words or more in both texts, of which ``similarity`` or more match, stay.

Result: a row per passage of a unit's smallest id, with the place of the hub's passage, and one for each hub's passage itself (its own
representative); for every other id of a unit a row that says that its whole text is that of the smallest. Passages that many documents share
thus have one representative, or one per task that is linked to the others, and as many rows.

Defined results: null, empty and short texts have no passages; repeats within one text alone are not looked for; of rows that share an id each text
counts; a null id takes no part; an empty table gives no rows. Units are told apart by a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import Workspace, attach, spread_join
from parley.llm.words import Hasher, mix, ngrams

GAP = 0.02
#: Words between the beginnings of a seed's two k-mers; the latter less the former is a power of 2.
NEAR, FAR = 16, 32
#: Places of a seed within ``CHUNK`` seeds of a task beyond which it is matched there.
LOCAL, CHUNK = 64, 1 << 21
#: Words beyond the chains in the first slices.
REACH = 96
#: By how much slices grow where a passage goes on beyond them.
WIDER = 64
#: Places of a seed that a place left by the hub is compared with in the first round; the second takes all others.
ROUND = 32
#: Places of either side of a seed whose pairs are looked at together, and width of the bags of words that rule most out.
BLOCK = 500
BAG = 2048


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of each ``window`` consecutive values, the first of equals; of fewer values, of all."""
    if not len(grams):
        return np.zeros(0, np.int64)
    width = min(window, len(grams))
    low = np.uint64(22)
    out = []
    step = (1 << 22) - width
    for at in range(0, len(grams), step):  # the position shares a word with the hash
        part = grams[at : at + step + width - 1]
        if len(part) < width:
            break
        value = (part >> low << low) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach < width:
            hop = min(reach, width - reach)
            value = np.minimum(value[: len(value) - hop], value[hop:])
            reach += hop
        picked = (value & np.uint64((1 << 22) - 1)).astype(np.int64) + at
        out.append(picked[np.concatenate([[True], picked[1:] != picked[:-1]])])
    picked = np.unique(np.concatenate(out))
    # In a stretch of one repeated value every position is picked; one in ``width`` is enough there.
    fresh = np.concatenate([[True], (grams[picked[1:]] != grams[picked[:-1]]) | (np.diff(picked) > 1)])
    nth = np.arange(len(picked)) - np.maximum.accumulate(np.where(fresh, np.arange(len(picked)), 0))
    return picked[nth % width == 0]


def pairs_of(grams: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of texts whose k-mers begin at ``at``: hash, position among ``grams`` and distance of the second k-mer."""
    picked = minimisers(grams, window)
    end = at[np.searchsorted(at, picked, side="right")] if len(picked) else picked
    picked = picked[picked + FAR <= end]
    if not len(picked):
        return np.zeros(0, np.uint64), picked, picked
    # Smallest of FAR - NEAR values from each place on, with the place modulo their number in the lowest bits.
    low = np.uint64(FAR - NEAR - 1)
    value = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    reach = 1
    while reach < FAR - NEAR:
        value = np.minimum(value[:-reach], value[reach:])
        reach *= 2
    second = value[picked + NEAR]
    gap = NEAR + (((second & low).astype(np.int64) - picked - NEAR) % (FAR - NEAR))
    with np.errstate(over="ignore"):
        return mix(grams[picked] * np.uint64(0x9E3779B97F4A7C15) + (second | low)), picked, gap


SEED = "seed long, id long, pos int, gap int"
PLACE = f"{SEED}, rep long, rep_pos int, rep_gap int"


def rows_of(columns: list[np.ndarray], schema: str, valid: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of whole numbers; columns from the fifth on are null where not ``valid``."""
    names = [x.split() for x in schema.split(", ")]
    arrays = [pa.array(c, {"long": pa.int64(), "int": pa.int32()}[t], mask=None if valid is None or i < 4 else ~valid) for i, (c, (_, t)) in enumerate(zip(columns, names, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in names])


def matched_locally(seed: np.ndarray, unit: np.ndarray, pos: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    """The places, with the first of its seed where that has more than ``LOCAL`` of them here. Of these seeds repeated places go."""
    order = np.argsort(seed, kind="stable")
    seed, unit, pos, gap = seed[order], unit[order], pos[order], gap[order]

    def runs() -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        return first, np.diff(np.append(first, len(seed)))

    first, n = runs()
    hot = np.flatnonzero(np.repeat(n > LOCAL, n))
    if len(hot):
        own = hot[np.lexsort((pos[hot], unit[hot], seed[hot]))]
        seed[hot], unit[hot], pos[hot], gap[hot] = seed[own], unit[own], pos[own], gap[own]
        same = np.zeros(len(seed), bool)
        same[hot[1:]] = (seed[hot[1:]] == seed[hot[:-1]]) & (unit[hot[1:]] == unit[hot[:-1]]) & (pos[hot[1:]] == pos[hot[:-1]])
        seed, unit, pos, gap = seed[~same], unit[~same], pos[~same], gap[~same]
        first, n = runs()
    hub, many = np.repeat(first, n), np.repeat(n > LOCAL, n)
    return rows_of([seed, unit, pos, gap, unit[hub], pos[hub], gap[hub]], PLACE, many & (hub != np.arange(len(seed))))


def seeds(docs: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """``PLACE`` of (id, text bytes); rep is null where a seed is not matched within the task. Texts shorter than a passage have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[list[np.ndarray]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, hashes, offsets in hasher.texts(batch.column(1).to_pylist()):
                grams, at = ngrams(hashes, offsets, k)
                seed, picked, gap = pairs_of(grams, at, window)
                doc = np.searchsorted(at, picked, side="right") - 1
                long = np.diff(offsets)[doc] >= min_words
                seed, picked, gap, doc = seed[long], picked[long], gap[long], doc[long]
                held.append([seed.view(np.int64), ids[first + doc].astype(np.int64), picked - at[doc], gap])
                if sum(len(x[0]) for x in held) >= CHUNK:
                    yield matched_locally(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
        if sum(len(x[0]) for x in held):
            yield matched_locally(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return docs.mapInArrow(run, PLACE)


def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places sorted by (seed, id, pos) those whose seed has several, with the first of them."""
    held: list[np.ndarray] | None = None  # the first place of the seed that the last batch ended with
    shown = False  # it came out already
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            own = [np.concatenate([h, c]) for h, c in zip(held, own, strict=True)]
        seed = own[0]
        first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        n = np.diff(np.append(first, len(seed)))
        hub = np.repeat(first, n)
        # Seeds of one unit alone go, but for those that other batches may go on with.
        several = np.add.reduceat(own[1] != own[1][hub], first) > 0
        several[-1] = True
        several[0] |= held is not None
        keep = np.repeat((n > 1) & several, n)
        if held is not None and shown:
            keep[0] = False
        shown = bool(n[-1] > 1) or (shown and len(first) == 1)
        held = [c[first[-1] : first[-1] + 1] for c in own]
        yield rows_of([c[keep] for c in own] + [own[i][hub][keep] for i in (1, 2, 3)], PLACE)


def chains(matches: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """Disjoint chains, best first, of matches (position, position in the hub) sorted by position."""
    n = len(matches)
    ranks = {h: r + 1 for r, h in enumerate(sorted({h for _, h in matches}))}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and matches[j][0] == matches[i][0]:  # matches at one position cannot follow each other
            p, h = matches[j]
            r, best = ranks[h] - 1, (float("-inf"), -1)
            while r > 0:
                best = max(best, tree[r])
                r &= r - 1
            score[j] = float(k)
            if best[1] >= 0:
                gain = k + best[0] - GAP * (p + h)
                if gain > score[j]:
                    score[j], back[j] = gain, best[1]
            j += 1
        for m in range(i, j):
            p, h = matches[m]
            entry, r = (score[m] + GAP * (p + h), m), ranks[h]
            while r < len(tree):
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    used, out = [False] * n, []
    for e in sorted(range(n), key=lambda x: (-score[x], x)):
        own, m = [], e
        while m >= 0 and not used[m]:
            used[m] = True
            own.append(matches[m])
            m = back[m]
        if own:
            out.append(own[::-1])
    return out


def lcs(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit in long integers."""
    at: dict[int, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        u = row & at.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def outwards(x: np.ndarray, y: np.ndarray) -> tuple[int, int, bool]:
    """How many words of both to add, how many of them match, and if a text ended first: +1 for a match, -2 else, up to a drop of 12."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0, True
    same = x[:n] == y[:n]
    total = np.cumsum(np.where(same, 1, -2))
    low = np.flatnonzero(total < np.maximum.accumulate(np.maximum(total, 0)) - 12)
    end = int(low[0]) if len(low) else n
    if not end or total[:end].max() <= 0:
        return 0, 0, not len(low)
    best = int(total[:end].argmax()) + 1
    return best, int(same[:best].sum()), not len(low)


def extents(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``outwards`` for many rows: words to add, and matches among them. A text ends at 0."""
    inside = (x > 0) & (y > 0)
    same = (x == y) & inside
    total = np.cumsum(np.where(inside, np.where(same, 1, -2), -(1 << 16)), 1, dtype=np.int64)
    over = np.logical_or.accumulate(total < np.maximum.accumulate(np.maximum(total, 0), 1) - 12, 1)
    total[over] = -1
    best, row = total.argmax(1), np.arange(len(total))
    some = total[row, best] > 0
    return np.where(some, best + 1, 0), np.where(some, np.cumsum(same, 1)[row, best], 0)


def align(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int]], k: int, begins: tuple[bool, bool] = (True, True), ends: tuple[bool, bool] = (True, True)) -> tuple[int, int, int, int, int, bool]:
    """Start and end in both, and matching words, of the passage that a chain lies in; and if it is open, that is, came to an end of
    ``x`` or ``y`` that is none of the text's, as ``begins`` and ``ends`` tell."""
    (b, g), matched = chain[0], 0
    e, h = b, g
    for p, q in chain:
        p, q = max(p, e), max(q, h)
        if p - e == q - h and (x[e:p] == y[h:q]).all():
            matched += p - e
        elif p > e and q > h:
            matched += lcs(x[e:p].tolist(), y[h:q].tolist())
        new = max(0, min(k, len(x) - p, len(y) - q))
        run = int(np.argmin(np.append(x[p : p + new] == y[q : q + new], False)))
        matched += run
        e, h = p + run, q + run
    def stopped(u: int, v: int, whole: tuple[bool, bool]) -> bool:
        return u <= v and whole[0] or v <= u and whole[1]

    more, same, over = outwards(x[e:], y[h:])
    is_open = over and not stopped(len(x) - e, len(y) - h, ends)
    e, h, matched = e + more, h + more, matched + same
    more, same, over = outwards(x[:b][::-1], y[:g][::-1])
    return b - more, e, g - more, h, matched + same, is_open or over and not stopped(b, g, begins)


def outermost(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Without spans that lie within another of the same keys. A group is bounded by the length of a text."""
    before = Window.partitionBy(*keys).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(end).over(before)).filter(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).drop("_reach")


def uncovered(places: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``places`` (seed, id, pos, gap, n) that lie in no passage of their text, on either side of ``found``."""
    spans = found.select("id", "start_word", "end_word").union(found.select("rep_id", "rep_start", "rep_end")).distinct()
    rows = spans.select("id", F.col("start_word").cast("int").alias("pos"), F.col("end_word").alias("_end"))
    rows = rows.unionByName(places, allowMissingColumns=True)
    so_far = Window.partitionBy("id").orderBy("pos", F.col("_end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    left = rows.withColumn("_reach", F.max("_end").over(so_far)).filter(F.col("n").isNotNull() & (F.coalesce("_reach", F.lit(0)) < F.col("pos") + F.col("gap") + k))
    return left.select(*places.columns)


def repeated_passages(docs: DataFrame, k: int = 3, window: int = 6, min_words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, rep_id, rep_start, rep_end, n_matched, similarity)."""
    space = Workspace(docs.sparkSession, "substrings", broadcasts=False)
    text = F.encode(F.col(text_col), "utf-8")
    raw = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("id"), text.alias("text")).filter("doc is not null and text is not null")
    # Ids by unit: from here on an id is that of a unit.
    units = space.table(raw.groupBy("id").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")), "units")
    found = space.table(seeds(raw.select("id", "text"), k, window, min_words), "seeds")
    loose = found.filter("rep is null").select("seed", "id", "pos", "gap").repartition("seed").sortWithinPartitions("seed", "id", "pos")
    places = loose.mapInArrow(first_places, PLACE).unionByName(found.filter("rep is not null"))
    places = space.table(places, "places")
    space.drop("seeds")
    n_places = places.count()
    counts = space.table(places.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 2"), "counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    matches = places.filter("id <> rep").select("id", "rep", "pos", "gap", "rep_pos", "rep_gap")

    # A passage of min_words words has this many words at most, and so many that match; there are so many before and after a place in it.
    longest, least = int(np.ceil(min_words / similarity)), int(np.ceil(min_words * similarity - 1e-9))
    width = 2 * longest + 1

    def chain(batches: Iterator[pa.RecordBatch], each: bool = False) -> Iterator[pa.RecordBatch]:
        """Chains of each two texts; with ``each`` also every seed by itself after them."""
        for batch in batches:
            out: list[tuple] = []
            for i, rep, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                pos, gap, rep_pos, rep_gap = (own.values.field(c).to_numpy().astype(np.int64) for c in range(4))
                pairs = np.unique(np.stack([np.concatenate([pos, pos + gap]), np.concatenate([rep_pos, rep_pos + rep_gap])], 1), axis=0)
                own = [c for c in chains(list(map(tuple, pairs.tolist())), k) if c[-1][0] + k - c[0][0] >= NEAR]
                if each:
                    own += [[(p, q), (p + g, q + h)] for p, g, q, h in sorted(zip(pos.tolist(), gap.tolist(), rep_pos.tolist(), rep_gap.tolist(), strict=True))]
                if own:
                    ends = min(c[0][0] for c in own), max(c[-1][0] for c in own) + k, min(c[0][1] for c in own), max(c[-1][1] for c in own) + k
                    out.append((i, rep, *ends, [[x for m in c for x in m] for c in own]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.list_(pa.list_(pa.int64()))], strict=True)], names=["id", "rep", "b", "e", "rb", "re", "chains"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = []
            for _, hashes, offsets in hasher.texts(batch.column(1).to_pylist()):
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                found += [short[b:e].tobytes() for b, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "words"])

    copied = units.filter("doc <> last").select("id")
    known = raw.join(places.select("id").union(copied).distinct(), "id", "left_semi").select("id", "text").mapInArrow(words, "id long, words binary").groupBy("id").agg(F.max("words").alias("words"))
    known = space.table(known, "words")

    def part(words: str, at: str, end: str, reach: int):
        return F.substring(F.col(words), (F.col(at) * 4 + 1).cast("int"), ((F.col(end) + reach - F.col(at)) * 4).cast("int"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages; or, where a chain is open, one row without numbers for the two texts."""
        for batch in batches:
            out: list[tuple] = []
            for i, rep, at, rep_at, own, x, y, x_ends, y_ends in zip(*(c if j in (4, 5, 6) else c.to_pylist() for j, c in enumerate(batch.columns)), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                known: list[tuple[int, int, int, int]] = []
                rows: list[tuple] = []
                for chain in own.as_py():
                    c = [(p - at, h - rep_at) for p, h in zip(chain[::2], chain[1::2], strict=True)]
                    (b, g), (e, h) = c[0], c[-1]
                    # The ends of a better chain went over this one.
                    if any(s <= b and e + k <= t and u <= g and h + k <= v for s, t, u, v in known):
                        continue
                    s, t, u, v, n, is_open = align(x, y, c, k, (at == 0, rep_at == 0), (x_ends, y_ends))
                    if is_open:
                        rows = [(i, None, None, rep, None, None, None, None)]
                        break
                    share = n / max(1, t - s, v - u)
                    if len(c) == 2 and (min(t - s, v - u) < min_words or share < similarity):
                        # Its surroundings, as far as a place is looked at where it is matched.
                        cut, rep_cut = max(0, b - longest), max(0, g - longest)
                        own_x, own_y = x[cut : b + longest + 1], y[rep_cut : g + longest + 1]
                        s, t, u, v, n, _ = align(own_x, own_y, [(p - cut, q - rep_cut) for p, q in c], k)
                        s, t, u, v = s + cut, t + cut, u + rep_cut, v + rep_cut
                        share = n / max(1, t - s, v - u)
                    if min(t - s, v - u) >= min_words and share >= similarity:
                        known.append((s, t, u, v))
                        rows.append((i, s + at, t + at, rep, u + rep_at, v + rep_at, n, share))
                out += rows
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.float64()], strict=True)], names=["id", "start_word", "end_word", "rep_id", "rep_start", "rep_end", "n_matched", "similarity"])

    def passages(matches: DataFrame, name: str, each: bool = False) -> DataFrame:
        """The passages that matches (id, rep, pos, gap, rep_pos, rep_gap) lie in."""
        rows = matches.groupBy("id", "rep").agg(F.collect_set(F.struct("pos", "gap", "rep_pos", "rep_gap")).alias("m"))
        linked = space.table(rows.mapInArrow(lambda batches: chain(batches, each), "id long, rep long, b long, e long, rb long, re long, chains array<array<long>>"), f"chains-{name}")
        whole, reach = None, REACH
        while True:
            n_chains = linked.count()
            placed = linked.withColumn("at", F.greatest(F.lit(0), F.col("b") - reach)).withColumn("rep_at", F.greatest(F.lit(0), F.col("rb") - reach))
            sides = spread_join(placed, known, "id", "rep", n_chains).withColumn("x", part("words", "at", "e", reach)).withColumn("x_ends", F.octet_length("words") <= (F.col("e") + reach) * 4).drop("words")
            sides = spread_join(sides, known.withColumnRenamed("id", "rep"), "rep", "id", n_chains, counted=linked).withColumn("y", part("words", "rep_at", "re", reach)).withColumn("y_ends", F.octet_length("words") <= (F.col("re") + reach) * 4).drop("words")
            found = sides.select("id", "rep", "at", "rep_at", "chains", "x", "y", "x_ends", "y_ends").mapInArrow(aligned, "id long, start_word long, end_word long, rep_id long, rep_start long, rep_end long, n_matched long, similarity double")
            found = space.table(found, f"found-{name}-{reach}")
            closed, more = found.filter("n_matched is not null"), found.filter("n_matched is null").select("id", F.col("rep_id").alias("rep"))
            whole = closed if whole is None else whole.unionByName(closed)
            if more.isEmpty():
                return whole.distinct()
            reach *= WIDER
            linked = space.table(linked.join(more, ["id", "rep"], "left_semi"), f"chains-{name}-{reach}")

    def around(rows: DataFrame, n: int, counted: DataFrame) -> DataFrame:
        """Plus the words around a place, as ``near``, with zeros where there are none."""
        begin = F.greatest(F.lit(0), F.col("pos") - longest)
        near = F.substring(F.col("words"), (begin * 4 + 1).cast("int"), ((F.col("pos") + longest + 1 - begin) * 4).cast("int"))
        near = F.lpad(near, (F.octet_length(near) + (longest - (F.col("pos") - begin)) * 4).cast("int"), F.lit(b"\0"))
        return spread_join(rows, known, "id", "pos", n, counted=counted).withColumn("near", F.rpad(near, width * 4, F.lit(b"\0"))).drop("words")

    def bags(near: np.ndarray) -> np.ndarray:
        """Numbers of the words of each row by their hash in ``BAG``."""
        at = (np.arange(len(near), dtype=np.int64)[:, None] * BAG + near % BAG)[near > 0]
        return np.bincount(at, minlength=len(near) * BAG).reshape(-1, BAG).astype(np.float32)

    def hold(u: np.ndarray, v: np.ndarray, gap: np.ndarray, other: np.ndarray) -> np.ndarray:
        """If the seeds in the middle of the rows lie in passages, as far as the rows go: as ``align`` has it, for many pairs at once."""
        before, same_before = extents(u[:, :longest][:, ::-1], v[:, :longest][:, ::-1])
        after = np.arange(longest + 1)
        right = [np.take_along_axis(np.pad(x, ((0, 0), (0, FAR + k))), longest + g[:, None] + k + after, 1) for x, g in ((u, gap), (v, other))]
        more, same_more = extents(*right)
        length, wide = before + np.minimum(gap, other) + k + more, before + np.maximum(gap, other) + k + more
        # Between the k-mers all words may match at most; where that decides, the longest common subsequence is counted.
        known = same_before + 2 * k + same_more
        maybe = (length >= min_words) & (known + np.minimum(gap, other) - k >= similarity * wide)
        for i in np.flatnonzero(maybe & (known < similarity * wide)):
            x, y = (r[i, longest + k : longest + g[i]].tolist() for r, g in ((u, gap), (v, other)))
            maybe[i] = known[i] + lcs(x, y) >= similarity * wide[i]
        return maybe

    def alike(ours: list[tuple], theirs: list[tuple]) -> Iterator[pa.RecordBatch]:
        """For each of ``ours`` the first of ``theirs``, in another unit, with which it has a passage."""
        theirs = sorted(theirs, key=lambda r: r[:2])
        u, v = (np.frombuffer(b"".join(x[3] for x in own), np.uint32).reshape(-1, width) for own in (ours, theirs))
        ids, reps = (np.array([x[0] for x in own]) for own in (ours, theirs))
        gaps, others = (np.array([x[2] for x in own]) for own in (ours, theirs))
        maybe = ids[:, None] != reps
        if maybe.size > 64:  # a bound from above, as different words may meet in one place of a bag
            maybe &= bags(u) @ (bags(v) > 0).astype(np.float32).T >= least
        open_rows, size, rows = {i: np.flatnonzero(row) for i, row in enumerate(maybe) if row.any()}, 4, []
        while open_rows:
            own = np.concatenate([np.full(min(size, len(x)), i) for i, x in open_rows.items()])
            other = np.concatenate([x[:size] for x in open_rows.values()])
            for at in range(0, len(own), 4000):
                i, j = own[at : at + 4000], other[at : at + 4000]
                good = hold(u[i], v[j], gaps[i], others[j])
                for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                    if open_rows.pop(x, None) is not None:
                        rows.append((*ours[x][:3], *theirs[y][:3]))
            open_rows = {i: x[size:] for i, x in open_rows.items() if len(x) > size}
            size *= 4
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [pa.int64(), pa.int32(), pa.int32()] * 2, strict=True)], names=["id", "pos", "gap", "rep", "rep_pos", "rep_gap"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, ([], [])
        for batch in batches:
            for *key, side, i, pos, gap, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if group[0] and group[1]:
                        yield from alike(*group)
                    last, group = key, ([], [])
                group[side].append((i, pos, gap, near))
        if group[0] and group[1]:
            yield from alike(*group)

    found = space.table(passages(matches, "0"), "all-0")
    turn = F.col("n") * F.pmod(F.xxhash64("seed", "id", "pos"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    left = pool = None
    low, high = 0, ROUND
    while low < most:
        if left is None:
            rest = attach(places.select("seed", "id", "pos", "gap"), counts.withColumn("m", F.col("n")), ["seed"], n_places, few=1000).withColumnRenamed("m", "n")
            left = space.table(uncovered(rest, found, k), "left-0")
            pool = space.table(rest.join(left.select("seed").distinct(), "seed", "left_semi"), "pool")
        else:  # what is covered stays so
            left = space.table(uncovered(left.filter(F.col("n") > low), found, k), f"left-{low}")
        n_left = left.count()
        if not n_left:
            break
        # A seed's places on either side are dealt into blocks, and each block meets each of the other side.
        blocks = lambda rows, name: rows.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        theirs = space.table(pool.filter((turn >= low) & (turn < high)).join(left.select("seed").distinct(), "seed", "left_semi"), f"others-{high}")
        n_theirs = theirs.count()
        dealt = space.table(blocks(left, "m").join(blocks(theirs, "o"), "seed"), f"blocks-{high}")
        sides = []
        for side, (rows, n_rows, own, other) in enumerate(((left, n_left, "m", "o"), (theirs, n_theirs, "o", "m"))):
            near = around(rows.join(dealt, "seed"), n_rows, rows)
            near = near.withColumn(f"{own}_at", F.pmod(F.xxhash64("id", "pos"), own).cast("int")).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            sides.append(near.select("seed", "m_at", "o_at", F.lit(side).alias("side"), "id", "pos", "gap", "near"))
        pairs = sides[0].unionByName(sides[1]).repartition("seed", "m_at", "o_at").sortWithinPartitions("seed", "m_at", "o_at")
        pairs = space.table(pairs.mapInArrow(meet, "id long, pos int, gap int, rep long, rep_pos int, rep_gap int"), f"pairs-{high}")
        place, other = F.struct("id", "pos", "gap"), F.struct(F.col("rep").alias("id"), F.col("rep_pos").alias("pos"), F.col("rep_gap").alias("gap"))
        pairs = pairs.select(F.greatest(place, other).alias("x"), F.least(place, other).alias("y"))
        pairs = pairs.select("x.id", F.col("y.id").alias("rep"), "x.pos", "x.gap", F.col("y.pos").alias("rep_pos"), F.col("y.gap").alias("rep_gap"))
        found = space.table(found.unionByName(passages(pairs, str(high), each=True)).distinct(), f"all-{high}")
        low, high = high, max(most, high + 1)
    kept = space.table(outermost(found, ["id", "rep_id"], "start_word", "end_word"), "passages")
    own = outermost(found.groupBy("rep_id", "rep_start").agg(F.max("rep_end").alias("rep_end")), ["rep_id"], "rep_start", "rep_end")
    own = own.select(F.col("rep_id").alias("id"), F.col("rep_start").alias("start_word"), F.col("rep_end").alias("end_word"), "rep_id", "rep_start", "rep_end", (F.col("rep_end") - F.col("rep_start")).alias("n_matched"), F.lit(1.0).alias("similarity"))
    # From units to ids.
    kept = space.table(kept.unionByName(own), "rows")
    names = units.select("id", "doc")
    mine, theirs = names.select("id", F.col("doc").alias("own")), names.select(F.col("id").alias("rep_id"), F.col("doc").alias("rep"))
    per = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(mine, "id")
    n_kept = kept.count()
    kept = attach(kept, per, ["id"], n_kept, few=1000)
    per = kept.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n")).join(theirs, "rep_id")
    kept = attach(kept, per, ["rep_id"], n_kept, few=1000).select(F.col("own").alias("id"), "start_word", "end_word", F.col("rep").alias("rep_id"), "rep_start", "rep_end", "n_matched", "similarity")
    # Copies: the whole text, on either side.
    whole = units.filter("doc <> last").join(known.select("id", (F.octet_length("words") / 4).cast("long").alias("size")), "id").filter(F.col("size") >= min_words)
    whole = space.table(whole.select("id", F.col("doc").alias("rep"), "size", "n"), "copied")
    copies = attach(raw.select("doc", "id"), whole, ["id"], units.agg(F.sum("n")).first()[0] or 0, few=1000).select("doc", "rep", "size")
    zero = F.lit(0).cast("long")
    copies = copies.select(F.col("doc").alias("id"), zero.alias("start_word"), F.col("size").alias("end_word"), F.col("rep").alias("rep_id"), zero.alias("rep_start"), F.col("size").alias("rep_end"), F.col("size").alias("n_matched"), F.lit(1.0).alias("similarity"))
    return kept.unionByName(copies).distinct()
