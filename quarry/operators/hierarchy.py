"""Problem 2: parent-child links to full hierarchies.

Method: a few rounds of peeling leaves gather subtree sizes and leave the core; in the core,
pointers that double their reach expose every cycle; then Euler tours of the core's trees are
threaded as linked lists (down and up of each node, peeled subtrees counted by their size) and
ranked in parallel by pointer jumping. Positions on the tour give each node's entry and exit,
and with weights +1 and -1 its depth; peeled nodes take their places below their parents. Rounds
grow with the logarithm of a tree's size, not with its depth.

Every node has at most one parent; where rows give it several, the smallest counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import cut

#: Rounds of peeling before lists take over, and siblings' sums are taken in this many buckets.
PEELS, BUCKETS = 5, 16


def counting_edges(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("CONTAINS", "INHERITS")) -> DataFrame:
    """(kind, parent, child) of the edges that count: kind whatever its case and padding, both
    ends among the nodes, each edge once. CONTAINS leads from parent to child, INHERITS from
    child to parent. Nulls in kind or ends never count."""
    kind = F.upper(F.trim("kind"))
    ids = nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    wanted = edges.select(kind.alias("kind"), F.col("source_id").cast("long").alias("s"), F.col("target_id").cast("long").alias("t")).where(F.col("kind").isin(*kinds))
    up = F.col("kind") == "INHERITS"
    pairs = wanted.select("kind", F.when(up, F.col("t")).otherwise(F.col("s")).alias("parent"), F.when(up, F.col("s")).otherwise(F.col("t")).alias("child")).distinct()
    return pairs.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("id", "child"), "child", "left_semi").select("kind", "parent", "child")


def parents(links: DataFrame) -> DataFrame:
    """(kind, id, parent) of every node on a link; parent is null for roots."""
    both = links.select("kind", F.col("child").alias("id"), "parent").unionByName(links.select("kind", F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent")))
    return both.groupBy("kind", "id").agg(F.min("parent").alias("parent"))


def peel(tree: DataFrame, rounds: int = PEELS) -> tuple[DataFrame, list[DataFrame]]:
    """The core (kind, id, parent, below) and what each round peeled (kind, id, parent, size).

    A round takes the nodes without children in the core; ``below`` adds up the sizes of the
    subtrees that were peeled from a node."""
    core = cut(tree.withColumn("below", F.lit(0).cast("long")))
    peeled: list[DataFrame] = []
    for _ in range(rounds):
        inner = core.where("parent is not null").select("kind", F.col("parent").alias("id")).distinct()
        marked = cut(core.join(inner.withColumn("inner", F.lit(True)), ["kind", "id"], "left"))
        leaves = marked.where("inner is null").select("kind", "id", "parent", (F.col("below") + 1).alias("size"))
        gone = leaves.where("parent is not null").groupBy("kind", F.col("parent").alias("id")).agg(F.sum("size").alias("more"))
        rest = marked.where("inner").drop("inner").join(gone, ["kind", "id"], "left").select("kind", "id", "parent", (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"))
        peeled.append(leaves)
        core = cut(rest)
        if core.isEmpty():
            break
    return core, peeled


def cycles(core: DataFrame) -> DataFrame:
    """(kind, id, cycle, on_cycle) of the core's nodes that are on a cycle or below one; cycle is
    the smallest id on it.

    Each round doubles how far up a node looks and drops the nodes that see a root. When a round
    drops none, what is left leads to cycles; when the set of nodes reached and the smallest ids
    seen no longer change, the nodes reached are the cycles."""
    look = cut(core.where("parent is not null").select("kind", "id", F.col("parent").alias("far"), F.least("id", "parent").alias("least")))
    left = look.count()
    reached = smallest = -1
    while left:
        far = look.select("kind", F.col("id").alias("far"), F.col("far").alias("farther"), F.col("least").alias("far_least"))
        look = cut(look.join(far, ["kind", "far"]).select("kind", "id", F.col("farther").alias("far"), F.least("least", "far_least").alias("least")))
        row = look.agg(F.count("*").alias("n"), F.countDistinct("kind", "far").alias("reached"), F.coalesce(F.sum(F.col("least").cast("decimal(38,0)")), F.lit(0)).alias("smallest")).first()
        if (row["n"], row["reached"], row["smallest"]) == (left, reached, smallest):
            break
        left, reached, smallest = row["n"], row["reached"], row["smallest"]
    on = look.select("kind", F.col("far").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    named = cut(look.join(on, ["kind", "id"], "left"))
    own = named.where("on_cycle").select("kind", F.col("id").alias("far"), F.col("least").alias("cycle"))
    return cut(named.join(own, ["kind", "far"]).select("kind", "id", "cycle", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")))


def before(value: Column, *keys: str) -> tuple[Column, Column]:
    """Window sums for prefix sums over siblings in two steps: within a bucket, and of buckets."""
    inside = Window.partitionBy(*keys, "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(inside), F.lit(0)), F.coalesce(F.sum("bucket_sum").over(across), F.lit(0))


def sibling_offsets(children: DataFrame) -> DataFrame:
    """``children`` (kind, id, parent, size) with ``offset``: the sizes of the siblings before it.
    A parent with very many children is summed bucket by bucket."""
    salted = children.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    inside, across = before(F.col("size"), "kind", "parent")
    sums = salted.groupBy("kind", "parent", "bucket").agg(F.sum("size").alias("bucket_sum"))
    sums = sums.select("kind", "parent", "bucket", across.alias("bucket_offset"))
    return salted.withColumn("inside", inside).join(sums, ["kind", "parent", "bucket"]).select("kind", "id", "parent", "size", (F.col("inside") + F.col("bucket_offset")).alias("offset"))


def tour_list(core: DataFrame) -> DataFrame:
    """The Euler tours of the core's trees as linked lists: (kind, id, up, next_id, next_up,
    positions, levels). An element is a node's way down or up; down counts for itself and for two
    positions of each peeled node below it."""
    salted = core.where("parent is not null").select("kind", "id", "parent", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket"))
    row = Window.partitionBy("kind", "parent", "bucket").orderBy("id")
    linked = salted.select("kind", "id", "parent", "bucket", F.lead("id").over(row).alias("next"))
    firsts = salted.groupBy("kind", "parent", "bucket").agg(F.min("id").alias("first"))
    across = Window.partitionBy("kind", "parent").orderBy("bucket")
    chained = firsts.select("kind", "parent", "bucket", "first", F.lead("first").over(across).alias("next_first"), F.row_number().over(across).alias("place"))
    siblings = linked.join(chained, ["kind", "parent", "bucket"]).select("kind", "id", F.coalesce("next", "next_first").alias("sibling"))
    first_child = chained.where("place = 1").select("kind", F.col("parent").alias("id"), F.col("first").alias("child"))
    known = core.join(first_child, ["kind", "id"], "left").join(siblings, ["kind", "id"], "left")
    down = known.select(
        "kind", "id", F.lit(False).alias("up"), F.coalesce("child", "id").alias("next_id"), F.col("child").isNull().alias("next_up"),
        (1 + 2 * F.col("below")).alias("positions"), F.lit(1).cast("long").alias("levels"),
    )
    up = known.select(
        "kind", "id", F.lit(True).alias("up"), F.coalesce("sibling", "parent").alias("next_id"), F.when(F.coalesce("sibling", "parent").isNotNull(), F.col("sibling").isNull()).alias("next_up"),
        F.lit(1).cast("long").alias("positions"), F.lit(-1).cast("long").alias("levels"),
    )
    return down.unionByName(up)


def ranked(elements: DataFrame) -> DataFrame:
    """List ranking by pointer jumping: (kind, id, up, positions, levels, last) where positions and
    levels are sums from the element to its list's end and last is the node at the end. Elements
    that have reached their end leave the joins' left side."""
    done: list[DataFrame] = []
    active = cut(elements.withColumn("last", F.when(F.col("next_id").isNull(), F.col("id"))))
    while True:
        done.append(active.where("next_id is null"))
        going = active.where("next_id is not null")
        if going.isEmpty():
            break
        known = reduce(DataFrame.unionByName, done, going)  # what is finished is looked up, never written again
        after = known.select(
            "kind", F.col("id").alias("next_id"), F.col("up").alias("next_up"), F.col("next_id").alias("n_id"), F.col("next_up").alias("n_up"),
            F.col("positions").alias("p"), F.col("levels").alias("l"), F.col("last").alias("n_last"),
        )
        active = cut(
            going.join(after, ["kind", "next_id", "next_up"]).select(
                "kind", "id", "up", F.col("n_id").alias("next_id"), F.col("n_up").alias("next_up"), (F.col("positions") + F.col("p")).alias("positions"), (F.col("levels") + F.col("l")).alias("levels"), F.col("n_last").alias("last")
            )
        )
    return reduce(DataFrame.unionByName, done).select("kind", "id", "up", "positions", "levels", "last")


def forest(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("CONTAINS", "INHERITS")) -> DataFrame:
    """(kind, node_id, parent_id, tree_id, level, entry, exit, cycle_id, on_cycle) of every node
    that occurs in a counting edge.

    tree_id and level are the topmost node and the number of edges to it after every cycle has
    been taken apart into single roots; entry and exit are positions on the tree's Euler tour,
    from 0. A node d lies below a exactly when it has the same kind and tree and
    a.entry < d.entry < a.exit. cycle_id is null unless the node is on or below a cycle. Empty
    tables give no rows; rows that repeat change nothing."""
    tree = parents(counting_edges(edges, nodes, kinds))
    core, peeled = peel(tree)
    found = cycles(core)
    trees = core.join(found.select("kind", "id", "on_cycle", "cycle"), ["kind", "id"], "left").withColumn("parent", F.when(F.coalesce("on_cycle", F.lit(False)), F.lit(None).cast("long")).otherwise(F.col("parent")))
    trees = cut(trees)
    ends = ranked(tour_list(trees.select("kind", "id", "parent", "below")))
    ways = ends.groupBy("kind", "id").agg(
        F.max(F.when(~F.col("up"), F.col("positions"))).alias("down_sum"), F.max(F.when(F.col("up"), F.col("positions"))).alias("up_sum"),
        F.max(F.when(~F.col("up"), -F.col("levels"))).alias("level"), F.max("last").alias("tree"),
    )
    total = ways.where("id = tree").select("kind", "tree", F.col("down_sum").alias("total"))
    placed = ways.join(total, ["kind", "tree"]).join(trees, ["kind", "id"]).select(
        "kind", "id", "parent", "tree", "level", (F.col("total") - F.col("down_sum")).alias("entry"), (F.col("total") - F.col("up_sum")).alias("exit"), "cycle", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")
    )
    placed = cut(placed)
    # Peeled nodes lie right after their parent's entry, one subtree after another.
    lost = None
    for round_no, part in enumerate(peeled):
        tagged = part.withColumn("round", F.lit(round_no))
        lost = tagged if lost is None else lost.unionByName(tagged)
    if lost is None:
        rows = placed
    else:
        hung = cut(sibling_offsets(lost.where("parent is not null").select("kind", "id", "parent", "size")).join(lost.select("kind", "id", "round"), ["kind", "id"]))
        alone = lost.where("parent is null").select(
            "kind", "id", "parent", F.col("id").alias("tree"), F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("entry"), (2 * F.col("size") - 1).alias("exit"), F.lit(None).cast("long").alias("cycle"), F.lit(False).alias("on_cycle"), "round"
        )
        rows = placed.unionByName(alone.drop("round"))
        layer = rows
        layers = [rows]
        for round_no in range(len(peeled) - 2 if len(peeled) == 1 else len(peeled) - 1, -1, -1):
            above = layer.select("kind", F.col("id").alias("parent"), "tree", F.col("level").alias("above"), F.col("entry").alias("start"), "cycle")
            new = hung.where(F.col("round") == round_no).join(above, ["kind", "parent"]).select(
                "kind", "id", "parent", "tree", (F.col("above") + 1).alias("level"), (F.col("start") + 1 + 2 * F.col("offset")).alias("entry"),
                (F.col("start") + 2 * F.col("offset") + 2 * F.col("size")).alias("exit"), "cycle", F.lit(False).alias("on_cycle"),
            )
            new = cut(new) if round_no else new
            layers.append(new)
            layer = layer.unionByName(new)
        rows = layer
    return rows.select("kind", F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), F.col("tree").alias("tree_id"), "level", "entry", "exit", F.col("cycle").alias("cycle_id"), "on_cycle")


def hierarchy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, node_id, root_id, depth): depth -1 on a cycle and -2 below one, with the smallest
    id of the cycle as root."""
    depth = F.when(F.col("on_cycle"), -1).when(F.col("cycle_id").isNotNull(), -2).otherwise(F.col("level"))
    return forest(edges, nodes).select("kind", "node_id", F.coalesce("cycle_id", "tree_id").alias("root_id"), depth.cast("long").alias("depth"))


def tours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, node_id, tree_id, entry, exit): places on the Euler tour of each tree. One node lies below
    another exactly when its entry lies between the other's entry and exit in the same tree."""
    return forest(edges, nodes).select("kind", "node_id", "tree_id", "entry", "exit")


def descendant_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, node_id, descendants), from entry and exit alone. A node of a cycle has the nodes
    that hang below it; the rest of its cycle is not counted."""
    return forest(edges, nodes).select("kind", "node_id", F.expr("(exit - entry - 1) div 2").alias("descendants"))


def descendant_totals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, node_id, descendants): how many rows ``descendants`` has for each node. Off cycles
    entry and exit tell; a node on a cycle has all other nodes on and below its cycle."""
    rows = cut(forest(edges, nodes).select("kind", "node_id", "entry", "exit", "cycle_id", "on_cycle"))
    round_about = rows.where("cycle_id is not null").groupBy("kind", "cycle_id").agg((F.count("*") - 1).alias("others"))
    below = F.expr("(exit - entry - 1) div 2")
    return rows.join(round_about, ["kind", "cycle_id"], "left").select("kind", "node_id", F.when(F.col("on_cycle"), F.col("others")).otherwise(below).alias("descendants"))


def descendants(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, node_id, descendant_id): every node below each node, each pair once, never the node
    itself. The members of a cycle reach each other and all that hangs below any of them. Pairs
    come from the finished paths, so the work is that of the output; only cycles are joined."""
    rows = cut(forest(edges, nodes))
    walked = cut(climbed(rows))
    pairs = walked.select("kind", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node_id"), F.col("node_id").alias("descendant_id"))
    placed = rows.where("cycle_id is not null").select("kind", "node_id", "cycle_id").join(walked, ["kind", "node_id"])
    members = rows.where("on_cycle").select("kind", "cycle_id", F.col("node_id").alias("member"))
    # The path begins at one member; the others reach the node around the cycle.
    around = placed.join(members, ["kind", "cycle_id"]).where(F.col("member") != F.col("path")[0]).select("kind", F.col("member").alias("node_id"), F.col("node_id").alias("descendant_id"))
    return pairs.unionByName(around)


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, node_id, path): ids from the topmost node down to the node itself; for nodes on or
    below a cycle the path begins at the cycle's node above it. Arrays double in each round, so
    the rounds are logarithmic in the depth and the work is that of the output."""
    return climbed(forest(edges, nodes))


def climbed(rows: DataFrame) -> DataFrame:
    """The paths of a forest's rows."""
    known = rows.select("kind", "node_id", F.when(F.col("on_cycle"), F.lit(None).cast("long")).otherwise(F.col("parent_id")).alias("far"))
    look = cut(known.withColumn("path", F.array("node_id")))
    while not look.where("far is not null").isEmpty():
        above = look.select("kind", F.col("node_id").alias("far"), F.col("far").alias("farther"), F.col("path").alias("upper"))
        going = look.where("far is not null").join(above, ["kind", "far"]).select("kind", "node_id", F.col("farther").alias("far"), F.concat("upper", "path").alias("path"))
        look = cut(going.unionByName(look.where("far is null")))
    return look.select("kind", "node_id", "path")
