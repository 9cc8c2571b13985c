"""What charts of keyword networks and of dendrograms show: places of nodes and of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.keynet import MOST
from parley.plans.settle import settled

ROUNDS = 100
#: Distances and displacements below this count as this much.
NEAR = 0.01
#: The layout stands still once nodes move less than this on average.
STILL = 1e-4


def start_at(term: Column, axis: int) -> Column:
    """Between 0 and 1, from eight hex digits of the term's MD5, so that a layout can be repeated."""
    return F.conv(F.substring(F.md5(term), 1 + 8 * axis, 8), 16, 10).cast("double") / 2.0**32


def network_layout(terms: DataFrame, edges: DataFrame, force: float = 1.5, rounds: int = ROUNDS) -> DataFrame:
    """(term, x, y) between -1 and 1, by forces: all nodes repel each other, edges (k1, k2, weight) attract, and steps get shorter with every round.

    ``force`` is the distance at which both are equal for a weight of 1 (Fruchterman and Reingold, 1991). The network is bounded by the number
    of keywords (``keynet.MOST``) and is one row; the rounds are a fold over its arrays.
    """
    if terms.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} keywords")
    nodes = terms.groupBy().agg(F.array_sort(F.collect_set("term")).alias("names"))
    both = edges.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat("k1", F.lit("\t"), "k2"), "weight"))).alias("w"))
    weight = lambda a, b: F.coalesce(F.try_element_at("w", F.concat(a, F.lit("\t"), b)), F.try_element_at("w", F.concat(b, F.lit("\t"), a)), F.lit(0.0))
    row = nodes.join(both).select("names", F.transform("names", lambda a: F.transform("names", lambda b: weight(a, b))).alias("pull"), F.transform("names", lambda a: F.struct(start_at(a, 0).alias("x"), start_at(a, 1).alias("y"))).alias("start"))  # one row each
    spread = lambda c: F.array_max(F.transform("start", lambda p: p[c])) - F.array_min(F.transform("start", lambda p: p[c]))
    # Written, as the optimizer would put the matrix into the fold and make it anew for every pair.
    row = settled(row.withColumn("heat", 0.1 * F.greatest(spread("x"), spread("y"))))

    def moved(at: Column, heat: Column, i: Column) -> Column:
        """Where node i goes: the sum of its forces, as long as the heat is."""
        own, pull = F.get(at, i), F.get("pull", i)

        def add(acc: Column, j: Column) -> Column:
            dx, dy = own["x"] - F.get(at, j)["x"], own["y"] - F.get(at, j)["y"]
            d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(NEAR))
            f = force * force / (d * d) - F.get(pull, j) * d / force
            return F.struct((acc["x"] + dx * f).alias("x"), (acc["y"] + dy * f).alias("y"))

        def step(acc: Column) -> Column:
            size = F.greatest(F.sqrt(acc["x"] * acc["x"] + acc["y"] * acc["y"]), F.lit(NEAR))
            return F.struct((own["x"] + acc["x"] * heat / size).alias("x"), (own["y"] + acc["y"] * heat / size).alias("y"))

        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), zero, add, step)

    def once(acc: Column, r: Column) -> Column:
        heat = F.col("heat") * (1 - (r - 1) / (rounds + 1))
        new = F.transform(acc["at"], lambda p, i: moved(acc["at"], heat, i))
        # What moved is told in the next round, from this one's places and those before.
        way = F.aggregate(F.zip_with(acc["at"], acc["last"], lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])), F.lit(0.0), lambda s, x: s + x)
        # Multiplied, as the optimizer may take the fold to a row without nodes before it is filtered.
        still = (r > 1) & (F.sqrt(way) < STILL * F.size(acc["at"]))
        return F.struct(F.when(still, acc["at"]).otherwise(new).alias("at"), acc["at"].alias("last"))

    first = F.struct(F.col("start").alias("at"), F.col("start").alias("last"))
    done = row.filter("size(names) > 0").select("names", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, once)["at"].alias("at"))
    placed = done.select(F.posexplode("at").alias("i", "p"), "names").select(F.get("names", F.col("i")).alias("term"), "p.x", "p.y")
    middle = placed.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    centred = placed.join(middle).select("term", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    size = centred.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("s"))
    scale = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return centred.join(size).select("term", (F.col("x") / scale).alias("x"), (F.col("y") / scale).alias("y"))


def dendrogram_links(linkage: DataFrame) -> DataFrame:
    """(step, height, left_x, right_x, left_height, right_height) of every merge, and with it the order of the leaves: leaf number r stands at 10 r + 5.

    ``linkage`` (step, a, b, height, size) numbers leaves from 0 and the cluster of step s as s more than the number of leaves. A cluster stands in
    the middle between its two parts. What comes before a node is the sum of what its left neighbours on the way to the root hold, and
    where it stands within is a sum over all below it, halved with every level. Both come by pointer doubling: every node knows the one 2^k levels
    above and the sum up to there, so a chain of n merges takes log2 n rounds.
    """
    nodes = dendrogram_nodes(linkage).select("node", "x", "node_height")
    part = lambda side: nodes.select(F.col("node").alias(side), F.col("x").alias("left_x" if side == "a" else "right_x"), F.col("node_height").alias("left_height" if side == "a" else "right_height"))
    return linkage.join(part("a"), "a").join(part("b"), "b").select("step", "height", "left_x", "right_x", "left_height", "right_height")


def dendrogram_nodes(linkage: DataFrame) -> DataFrame:
    """(node, before, x, node_height): leaves left of the node, where it stands, and how high."""
    linkage = settled(linkage)
    top = linkage.agg(F.max("step")).first()[0]
    leaves = 0 if top is None else top + 2
    root = 2 * leaves - 2
    merged = linkage.select((F.col("step") + leaves).alias("node"), "a", "b", F.col("height").alias("node_height"), F.col("size").alias("held"))
    sizes = merged.select("node", "held")
    left = merged.join(sizes.select(F.col("node").alias("a"), F.col("held").alias("first")), "a", "left").withColumn("first", F.coalesce("first", F.lit(1).cast("long")))
    ups = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).cast("long").alias("before")), F.struct(F.col("b").alias("node"), F.col("first").alias("before")))).alias("x"), F.col("node").alias("up")).select("x.*", "up")
    local = left.select("node", (5.0 * F.col("first")).alias("inner"), "node_height")
    rows = ups.unionByName(linkage.filter(F.col("step") == top).select(F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("up")))
    state = settled(rows.join(local, "node", "left").na.fill({"inner": 5.0, "node_height": 0.0}))
    levels = 1
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        # Halved so often, what is further below is nothing.
        below = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg((F.sum("inner") * 2.0**-levels if levels < 1024 else F.lit(0.0)).alias("more"))
        # The root has nothing before it and nothing above, so nodes just below need no join with it.
        above = state.filter(F.col("node") != root).select(F.col("node").alias("up"), F.col("before").alias("step_before"), F.col("up").alias("next"))
        deep, done = state.filter(F.col("up") != root), state.filter(F.col("up").isNull() | (F.col("up") == root))
        jumped = deep.join(above, "up").select("node", (F.col("before") + F.col("step_before")).alias("before"), F.col("next").alias("up"), "inner", "node_height")
        rows = jumped.unionByName(done.withColumn("up", F.lit(None).cast("long")))
        state = settled(rows.join(below, "node", "left").withColumn("inner", F.col("inner") + F.coalesce("more", F.lit(0.0))).drop("more"))
        levels *= 2
    return state.select("node", "before", (10.0 * F.col("before") + F.col("inner")).alias("x"), "node_height")
