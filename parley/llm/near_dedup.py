"""Near-duplicate documents by BagMinHash, banding and an exact multiset check.

A document is the multiset of its shingles, ``k`` consecutive words each; one of fewer words, but not none, is a single shingle. Two are
near-duplicates if the weighted Jaccard similarity of their multisets, sum of minima over sum of maxima, is ``similarity`` or more.

Signature. For every shingle a Poisson process of rate 1 runs over (weight, time); a document sees the points whose weight is within the
shingle's multiplicity, every point falls into one of the registers, and a register keeps the earliest. Two registers then agree with
probability exactly equal to the similarity. The weight axis is discretised into dyadic levels [0,1), [1,2), [2,4), [4,8), ...: each is
a process of its own, seeded by (shingle, level), that is generated only as far as a multiplicity reaches, and a level that is reached
in part is thinned by its points' positions. Points come by increasing time and are generated up to a limit that the registers need,
which does not depend on the document's length; where a register stays empty, the limit is doubled and the signature made anew.

Groups. Every row has a number. Equal word sequences fall together first, by a 128-bit key; the smallest row among them is their node, and nodes
are banded. In every bucket the smallest
document is the pivot, each other member is a candidate with it, and candidates are verified on the whole multisets. Verified pairs make
components. Where a bucket still holds several components, its documents may have links that no pivot showed. They are grouped anew by each
of ``SINGLES`` single registers, groups are cut into blocks of bounded size, and every pair of blocks is verified at once: overlaps of all
their documents are a product of two membership matrices, and only links that join two components come out. So every pair that shares
a bucket ends in one component or was compared, but for the chance (1 - similarity) ** SINGLES that it shares no single register.

The processes of all levels are made one by one. There is no splitting of one process into levels of finer weights, as in the first form
of the method; the points that a document sees have the same distribution either way.

Defined results: a null text, or one without words, is a class of its own; rows that share an id are one document, with the links of
all their texts; ties go to the smallest id; a null id takes no part in links (its class is null); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Workspace, attach, spread_join
from parley.llm.graph import components
from parley.llm.words import Hasher, mix, ngrams

BANDS, ROWS = 28, 4
#: Registers by which documents are grouped a second time; rows and bytes of multisets in a block of such a group.
SINGLES, BLOCK_ROWS, BLOCK_BYTES = 6, 1000, 4 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted shingle hashes of each text, repeats included."""
    grams, at = ngrams(hashes, offsets, k)
    out = []
    for d in range(len(offsets) - 1):
        own = grams[at[d] : at[d + 1]]
        if not len(own) and offsets[d + 1] > offsets[d]:
            short = hashes[offsets[d] : offsets[d + 1]]
            with np.errstate(over="ignore"):
                own = mix(np.array([np.bitwise_xor.reduce(mix(short + _GOLDEN * np.arange(1, len(short) + 1, dtype=np.uint64)))]))
        out.append(np.sort(own))
    return out


def bag_min_hash(values: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """The signature of a multiset of 64-bit values: for each register the identity of its earliest point."""
    low, rate, owner = [np.zeros(len(values))], [np.ones(len(values))], [np.arange(len(values))]
    most, start = int(counts.max()), 1
    while start < most:  # level [start, 2 start)
        reached = np.flatnonzero(counts > start)
        low.append(np.full(len(reached), float(start)))
        rate.append(np.full(len(reached), float(start)))
        owner.append(reached)
        start *= 2
    low, rate, owner = map(np.concatenate, (low, rate, owner))
    with np.errstate(over="ignore"):
        seed = mix(values[owner] + _GOLDEN * (low.astype(np.uint64) + np.uint64(1)))
    limit = registers / float(counts.sum()) * (np.log(registers) + 3)
    while True:
        who, when, ident = [], [], []
        alive, time, made = np.arange(len(seed)), np.zeros(len(seed)), 0
        while len(alive):
            mean = limit * float(rate[alive].max())
            width = int(min(4096, max(1, np.ceil(mean + 2 * np.sqrt(mean)) if mean > 0.5 else 1)))
            with np.errstate(over="ignore"):
                h = mix(seed[alive][:, None] + _GOLDEN * np.arange(made + 1, made + width + 1, dtype=np.uint64))
            gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            times = time[alive][:, None] + np.cumsum(gaps / rate[alive][:, None], axis=1)
            early = times <= limit
            row, col = np.nonzero(early)
            who.append(alive[row])
            when.append(times[row, col])
            ident.append(h[row, col])
            time[alive] = times[:, -1]
            alive, made = alive[early[:, -1]], made + width
        who, when, ident = map(np.concatenate, (who, when, ident))
        with np.errstate(over="ignore"):
            second = mix(ident ^ _GOLDEN)
        place = low[who] + rate[who] * ((second >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        seen = (place < counts[owner[who]]) | (rate[who] + low[who] <= counts[owner[who]])
        register = (second & np.uint64(0xFFFFFFFF)) % np.uint64(registers)
        order = np.flatnonzero(seen)
        order = order[np.argsort(-when[order], kind="stable")]
        signature = np.zeros(registers, np.uint64)
        filled = np.zeros(registers, bool)
        signature[register[order]] = ident[order]
        filled[register[order]] = True
        if filled.all():
            return signature
        limit *= 2


def bands_of(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature.reshape(BANDS, ROWS)
        acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN
        for i in range(ROWS):
            acc = mix(acc * np.uint64(0x100000001B3) + parts[:, i])
    return acc.view(np.int64)


def keys_of(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits of each text's word sequence; None without words."""
    with np.errstate(over="ignore"):
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
        start = np.zeros(1, np.uint64)
        one = np.concatenate([start, np.cumsum(mix(hashes + place * _GOLDEN))])
        two = np.concatenate([start, np.cumsum(mix((hashes ^ _GOLDEN) * (place * np.uint64(2) + np.uint64(1))))])
        return [(one[e] - one[b]).tobytes() + (two[e] - two[b]).tobytes() if e > b else None for b, e in zip(offsets[:-1], offsets[1:], strict=True)]


def prints(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, key: word sequence or null if it has no words, size, bands, singles). To be written once, as rows are numbered by the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keys, sizes, bands, singles = [], [], [], []
            for _, hashes, offsets in hasher.texts(batch.column(1).to_pylist()):
                keys += keys_of(hashes, offsets)
                for own in shingles(hashes, offsets, k):
                    sizes.append(len(own))
                    if not len(own):
                        bands.append(None)
                        singles.append(None)
                        continue
                    values, counts = np.unique(own, return_counts=True)
                    signature = bag_min_hash(values, counts, BANDS * ROWS)
                    bands.append(bands_of(signature))
                    singles.append(signature[:: BANDS * ROWS // SINGLES][:SINGLES].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(singles, pa.list_(pa.int64()))], names=["id", "key", "size", "bands", "singles"])

    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "utf-8").alias("text"))
    return raw.mapInArrow(run, "id long, key binary, size long, bands array<long>, singles array<long>").withColumn("row", F.monotonically_increasing_id())


def bags(docs: DataFrame, k: int) -> DataFrame:
    """(key, bag) of (id, text): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keys, found = [], []
            for _, hashes, offsets in hasher.texts(batch.column(1).to_pylist()):
                keys += keys_of(hashes, offsets)
                found += [own.tobytes() for own in shingles(hashes, offsets, k)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["key", "bag"])

    return docs.select("id", F.encode("text", "utf-8").alias("text")).mapInArrow(run, "key binary, bag binary").filter("key is not null")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Sum over the values of the smaller multiplicity; both are sorted."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    if len(both) < 2 or not (both[1:] == both[:-1]).any():
        return 0
    vx, cx = np.unique(x, return_counts=True)
    vy, cy = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(vx, vy, assume_unique=True, return_indices=True)
    return int(np.minimum(cx[i], cy[j]).sum())


def verify(pairs: DataFrame, bag_table: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose multisets are similar enough, as (a, b, similarity).

    A document that is in many pairs is dealt over as many tasks as it has thousands of pairs; its multiset is copied to each.
    """
    n_pairs = pairs.count()
    joined = spread_join(pairs.select("a", "b"), bag_table.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a", "b", n_pairs)
    joined = spread_join(joined, bag_table.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b", "a", n_pairs, counted=pairs).select("a", "b", "bag_a", "bag_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    score.append(0.0)
                    continue
                n = overlap(x, y)
                score.append(n / (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return joined.mapInArrow(run, "a long, b long, similarity double").filter(F.col("similarity") >= similarity)


def elements(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets: (element, row), where the n-th copy of a value is an element of its own; sorted."""
    values = np.concatenate(bags)
    rows = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
    fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])
    nth = np.arange(len(values)) - np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    with np.errstate(over="ignore"):
        values = np.where(nth > 0, mix(values + _GOLDEN * nth.astype(np.uint64)), values)
    order = np.lexsort((rows, values))
    return values[order], rows[order]


def overlaps(bags: list[np.ndarray], dense: int = 24, width: int = 2048) -> np.ndarray:
    """Multiset overlap of every two of ``bags``. Elements of few rows are counted pair by pair, those of many by matrix products."""
    n = len(bags)
    values, rows = elements(bags)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(starts, len(values)))
    many = np.repeat(counts > dense, counts)
    out = np.zeros((n, n), np.float32)
    few_v, few_r = values[~many], rows[~many]
    flat = np.zeros(0, np.int64)
    for lag in range(1, dense):
        same = np.flatnonzero(few_v[lag:] == few_v[:-lag]) if len(few_v) > lag else flat
        if not len(same):
            break
        np.add.at(out.reshape(-1), few_r[same].astype(np.int64) * n + few_r[same + lag], 1)
    out += out.T
    columns = np.repeat(np.cumsum(counts > dense) - 1, counts)[many]
    for at in range(0, int((counts > dense).sum()), width):
        own = (columns >= at) & (columns < at + width)
        member = np.zeros((n, width), np.float32)
        member[rows[many][own], columns[own] - at] = 1
        out += member @ member.T
    return out


def joining(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sides: np.ndarray, found: np.ndarray, similarity: float) -> list[tuple[int, int, float]]:
    """Similar pairs that join different labels, no more than it takes to join them; ``sides``: of both blocks or within one."""
    # In counts: n >= similarity * (x + y - n), row by row to keep the temporary arrays small.
    apart = sides.max() != sides.min()
    a, b = [], []
    for i in range(len(ids) - 1):
        n = found[i, i + 1 :]
        near = (n >= similarity * (sizes[i] + sizes[i + 1 :] - n)) & (labels[i + 1 :] != labels[i])
        j = np.flatnonzero(near & (sides[i + 1 :] != sides[i]) if apart else near) + i + 1
        a += [i] * len(j)
        b += j.tolist()
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for i, j in zip(a, b, strict=True):
        x, y = top(int(labels[i])), top(int(labels[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j]), float(found[i, j] / (sizes[i] + sizes[j] - found[i, j]))))
    return out


def verify_groups(members: DataFrame, bag_table: DataFrame, similarity: float) -> DataFrame:
    """``members``: (id, label, k, v, size). Links (a, b, similarity) between members of the same (k, v) that have different labels."""
    groups = members.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    groups = groups.select("k", "v", "n", F.greatest(F.ceil(F.col("size") * 8 / BLOCK_BYTES), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias("blocks"))
    rows = attach(members.select("id", "label", "k", "v"), groups, ["k", "v"], members.count())
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "label", "k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own").join(bag_table, "id")
    dealt = rows.select("k", "v", "i", "j", "own", "id", "label", "bag").repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []

        def links() -> pa.RecordBatch:
            bags = [np.frombuffer(x, np.uint64) for *_, x in group]
            own, ids, labels = (np.array([x[c] for x in group]) for c in range(3))
            found = joining(ids, labels, np.array([len(x) for x in bags]), own, overlaps(bags), similarity) if len(set(labels.tolist())) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*found, strict=True)) or [[], [], []], (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
            for key, *row in zip(keys, *(batch.column(c).to_pylist() for c in range(4, 8)), strict=True):
                if key != last and group:
                    yield links()
                    group = []
                last = key
                group.append(row)
        if group:
            yield links()

    return dealt.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, copy_of, n_joining): the smallest id of its component; of the documents with the same words; and how many of
    the links that joined the component go out from its words. These are enough to join it, not all that there are."""
    space = Workspace(docs.sparkSession, "near-dedup")
    known = space.table(prints(docs, k, id_col, text_col), "prints")
    n_docs = known.count()
    some = known.filter("key is not null and id is not null")
    # Equal word sequences: one node each.
    several = some.groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = space.table(attach(some.select("row", "id", "key"), space.table(several, "several"), ["key"], n_docs).select("row", "id", "node", "rep"), "copies")
    gone = copies.filter("row <> node").select("row")
    # (band, bucket) entries of the nodes, which are ``id`` from here on; a bucket with one of them says nothing.
    entries = space.table(some.join(gone, "row", "left_anti").select(F.col("row").alias("id"), F.posexplode("bands").alias("band", "bucket")).distinct(), "entries")
    n_entries = entries.count()
    full = entries.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).filter("n > 1")
    full = space.table(full, "full")
    entries = space.table(attach(entries, full, ["band", "bucket"], n_entries), "entries-full")
    space.drop("entries")
    pairs = space.table(entries.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    wanted = space.table(some.select("row", "id", "key").join(entries.select(F.col("id").alias("row")).distinct(), "row", "left_semi"), "wanted")
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted.select("id").distinct(), "id", "left_semi")
    bag_table = space.table(bags(raw, k).groupBy("key").agg(F.max("bag").alias("bag")).join(wanted.select("key", F.col("row").alias("id")), "key").select("id", "bag"), "bags")
    edges = space.table(verify(pairs, bag_table, similarity), "edges")
    # Texts that share an id are one document.
    again = space.table(some.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    shared = None
    if not again.isEmpty():
        own = attach(some.select("row", "id"), again, ["id"], n_docs).join(copies.select("row", "node"), "row", "left").select("id", F.coalesce("node", "row").alias("b")).distinct()
        least = own.groupBy("id").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n"))
        shared = space.table(attach(own, least, ["id"], n_docs).filter("a <> b").select("a", "b", F.lit(0.0).alias("similarity")), "shared-ids")
    ends = edges if shared is None else edges.unionByName(shared)
    labels = components(ends, space, "cc0")
    # Documents of buckets that hold several components.
    tagged = space.table(entries.drop("pivot").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id")), "tagged")
    mixed = tagged.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("band", "bucket", "n")
    left = space.table(attach(tagged, space.table(mixed, "mixed"), ["band", "bucket"], tagged.count()).select("id", "label").distinct(), "left")
    members = left.join(some.select(F.col("row").alias("id"), "size", "singles"), "id").select("id", "label", "size", F.posexplode("singles").alias("k", "v")).distinct()
    more = space.table(verify_groups(space.table(members, "members"), bag_table, similarity), "more-edges")
    if not more.isEmpty():
        more = more.dropDuplicates(["a", "b"])
        edges, ends = edges.unionByName(more), ends.unionByName(more)
        labels = components(ends, space, "cc1")
    links = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_joining"))
    # The smallest id of each component, and of each node's copies.
    whole = space.table(known.select("row", "id").join(copies.select("row", "node", "rep"), "row", "left").select("row", "id", F.coalesce("node", "row").alias("node"), F.coalesce("rep", "id").alias("rep")), "whole")
    linked = labels.join(whole.groupBy("node").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n")), "node")
    classes = linked.groupBy("label").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("m"))
    linked = space.table(linked, "linked")
    told = attach(linked, space.table(classes, "classes"), ["label"], linked.count(), n="m").join(links, "node", "left").select("node", "class_id", "n", F.coalesce("n_joining", F.lit(0)).cast("long").alias("n_joining"))
    told = space.table(told, "told")
    inside = attach(whole, told, ["node"], n_docs)
    # A node without a link is a class with its copies.
    rest = whole.join(inside.select("row"), "row", "left_anti").withColumn("class_id", F.col("rep")).withColumn("n_joining", F.lit(0).cast("long"))
    columns = ["id", "class_id", "rep", "n_joining"]
    found = inside.select(*columns).unionByName(rest.select(*columns))
    return found.groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("rep").alias("copy_of"), F.max("n_joining").alias("n_joining"))
