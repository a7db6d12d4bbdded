"""Call trees, closures, paths and renderings over edges(src, dst).

Trees are rows (root, node, parent, depth, trail, ord, node_type), one for each place
in the tree; ord is the depth-first sort key.  Where `by` names columns, there is a
graph for each of their values (one for each file, say), and all are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpath import fixed
from runpath.functions import text as T
from runpath.operators.storage import Scratch

Keys = tuple[str, ...]


def call_edges(functions: DataFrame, by: Keys = ()) -> DataFrame:
    """One row for each function and distinct callee."""
    return functions.select(*by, F.col("name").alias("src"), F.explode(F.array_sort(F.array_distinct("calls"))).alias("dst"))


def unify_edges(edges: DataFrame, kind: str = "call_type") -> DataFrame:
    """edges with the group of their kind and whether the callee is known at the call (D4); a kind of no language is Generic."""
    rows = {k: (g, d) for k, g, d in fixed.CALL_KINDS}
    known = F.when(F.col(kind).isin(list(rows)), F.col(kind)).otherwise("Generic")
    groups = F.lit("async")
    direct = F.lit(True)
    for k, (g, d) in rows.items():
        groups, direct = F.when(known == k, F.lit(g)).otherwise(groups), F.when(known == k, F.lit(d)).otherwise(direct)
    return edges.withColumns({"call_kind": known, "call_group": groups, "is_direct": direct})


def order_key(trail: Column) -> Column:
    return F.array_join(trail, "\u0001")


def flow_tree(spark: SparkSession, edges: DataFrame, roots: DataFrame, known: DataFrame, max_depth: int = fixed.TREE_DEPTH, by: Keys = ()) -> DataFrame:
    """Depth-first expansion from roots(name).

    A callee that is on its own path is a Ref leaf; a callee that is not known(name) is a KernelApi leaf; an unknown root
    is an External leaf; nothing is deeper than max_depth.  Children are in order of their names.

    Each level is one join with the edges, written to the shared folder, so a lost executor repeats one level at most.
    """
    known = known.select(*by, F.col("name").alias("node"), F.lit(True).alias("__known")).distinct()
    level = roots.select(*by, F.col("name").alias("node")).distinct().join(known, [*by, "node"], "left")
    level = level.select(
        *by, F.col("node").alias("root"), "node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("node").alias("trail"),
        F.when(F.col("__known").isNull(), "External").otherwise("Function").alias("node_type"),
    )
    links = edges.select(*by, F.col("src").alias("parent"), F.col("dst").alias("node")).distinct()
    kind = F.when(F.array_contains("trail", F.col("node")), "Ref").when(F.col("__known").isNull(), "KernelApi").otherwise("Function")
    with Scratch(spark) as scratch:
        # Each link with whether its callee is known, worked out once for all levels.
        steps = scratch.write(links.join(known, [*by, "node"], "left").repartition(*by, "parent"))
        out = level = scratch.write(level)
        for d in range(1, max_depth + 1):
            grown = level.where("node_type = 'Function'").select(*by, "root", F.col("node").alias("parent"), "trail").join(steps, [*by, "parent"])
            level = scratch.write(grown.select(*by, "root", "node", "parent", F.lit(d).alias("depth"), F.concat("trail", F.array("node")).alias("trail"), kind.alias("node_type")))
            if level.isEmpty():
                break
            out = out.union(level)
        return scratch.keep(out.withColumn("ord", order_key(F.col("trail"))))


def _cycle_bound(links: DataFrame, rounds: int, by: Keys, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes that may still reach a cycle, nodes that may lie on one): what is left when nodes without a callee, then also
    those without a caller, are taken away so many times.  Long chains that are not used up only make more nodes count.
    """

    def peel(left: DataFrame, end: str, other: str) -> DataFrame:
        for _ in range(rounds):
            ends = left.select(*by, F.col(end).alias(other)).distinct()
            fewer = scratch.write(left.join(ends, [*by, other], "left_semi").select(*by, "parent", "node"))
            if fewer.count() == left.count():
                break
            left = fewer
        return left

    reaching = peel(scratch.write(links.select(*by, "parent", "node")), "parent", "node")
    on = peel(reaching, "node", "parent")
    return reaching.select(*by, F.col("parent").alias("node")).distinct(), on.select(*by, F.col("parent").alias("node")).distinct()


def shared_tree(spark: SparkSession, edges: DataFrame, roots: DataFrame, known: DataFrame, max_depth: int = fixed.TREE_DEPTH, by: Keys = ()) -> DataFrame:
    """The trees of flow_tree() with equal subtrees kept once: (*by, root, node, depth, inside, node_type, paths, first).

    What stands below a place depends on the function, its depth, and those callers on the way that may be met again:
    inside holds these, none where no cycle can be reached.  Places that agree are one row with the number of paths to it
    and the first of them in depth-first order, so a graph of n functions without cycles has n * max_depth rows at most
    for a root, however many paths it has.
    """
    known = known.select(*by, F.col("name").alias("node"), F.lit(True).alias("__known")).distinct()
    with Scratch(spark) as scratch:
        links = scratch.write(edges.select(*by, F.col("src").alias("parent"), F.col("dst").alias("node")).distinct())
        reaching, on = _cycle_bound(links, max_depth, by, scratch)
        marks = reaching.withColumn("__reaches", F.lit(True)).join(on.withColumn("__on", F.lit(True)), [*by, "node"], "left")
        # Each link with what is known of the callee, worked out once for all levels.
        steps = scratch.write(links.join(known, [*by, "node"], "left").join(marks, [*by, "node"], "left"))
        none = F.array().cast("array<string>")
        level = roots.select(*by, F.col("name").alias("node")).distinct().join(known, [*by, "node"], "left").join(marks, [*by, "node"], "left")
        level = level.select(
            *by, F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.when(F.col("__on"), F.array("node")).otherwise(none).alias("inside"),
            F.when(F.col("__known").isNull(), "External").otherwise("Function").alias("node_type"), F.lit(1).cast("decimal(38,0)").alias("paths"), F.array("node").alias("first"),
        )
        out = level = scratch.write(level)
        kind = F.when(F.array_contains("inside", F.col("node")), "Ref").when(F.col("__known").isNull(), "KernelApi").otherwise("Function")
        inside = F.when(F.col("__reaches").isNull(), none).when(F.col("__on") & ~F.array_contains("inside", F.col("node")), F.array_sort(F.concat("inside", F.array("node")))).otherwise(F.col("inside"))
        for d in range(1, max_depth + 1):
            grown = level.where("node_type = 'Function'").withColumnRenamed("node", "parent").join(steps, [*by, "parent"])
            placed = grown.select(*by, "root", "node", inside.alias("next"), kind.alias("node_type"), "paths", F.concat("first", F.array("node")).alias("first"))
            merged = placed.groupBy(*by, "root", "node", F.col("next").alias("inside"), "node_type").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"), F.min_by("first", order_key(F.col("first"))).alias("first"))
            level = scratch.write(merged.select(*by, "root", "node", F.lit(d).alias("depth"), "inside", "node_type", "paths", "first"))
            if level.isEmpty():
                break
            out = out.union(level)
        return scratch.keep(out)


def tree_sizes(shared: DataFrame, by: Keys = ()) -> DataFrame:
    """(*by, root, node_type, places, deepest): how many places of each type the whole tree of a root has."""
    return shared.groupBy(*by, "root", "node_type").agg(F.sum("paths").cast("decimal(38,0)").alias("places"), F.max("depth").alias("deepest"))


def shared_paths(shared: DataFrame, by: Keys = ()) -> DataFrame:
    """(*by, root, node, paths, first): the number of places of each function below a root, and the first path to it."""
    return shared.groupBy(*by, "root", "node").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"), F.min_by("first", order_key(F.col("first"))).alias("first"))


def inject_chain(tree: DataFrame, chains: DataFrame, entries: DataFrame, by: Keys = ()) -> DataFrame:
    """Trees below the kernel chain that leads to their root.

    entries(*by, root, chain_id); chains(chain_id, ord, function, trigger).  The trigger stands at the top, then the nodes
    of the chain, the last of which stands for the place that calls the user's function; rows of the tree move below it.
    Roots without a chain stay as they are.
    """
    key = [*by, "root"]
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "function"))), lambda s: s["function"])
    tops = chains.groupBy("chain_id").agg(F.concat(F.array(F.first("trigger")), nodes).alias("top"))
    placed = entries.select(*key, "chain_id").join(F.broadcast(tops), "chain_id").select(*key, "top")  # chains are a fixed table
    n = F.coalesce(F.size("top"), F.lit(0))
    moved = tree.join(placed, key, "left").select(
        *key, "node", F.when(F.col("depth") == 0, F.element_at("top", -1)).otherwise(F.col("parent")).alias("parent"), (F.col("depth") + F.when(F.col("top").isNull(), 0).otherwise(n)).cast("int").alias("depth"),
        F.when(F.col("top").isNull(), F.col("trail")).otherwise(F.concat("top", "trail")).alias("trail"), "node_type", F.lit(False).alias("kernel_internal"),
    )
    at = F.col("at")
    above = placed.select(*key, "top", F.posexplode("top").alias("at", "node")).select(
        *key, "node", F.when(at > 0, F.get("top", at - 1)).alias("parent"), at.alias("depth"), F.slice("top", F.lit(1), at + 1).alias("trail"),
        F.when(at == 0, "External").otherwise("KernelApi").alias("node_type"), F.lit(True).alias("kernel_internal"),
    )
    return moved.unionByName(above).withColumn("ord", order_key(F.col("trail")))


def entry_points(functions: DataFrame, module: DataFrame, by: Keys = ("path",)) -> DataFrame:
    """(*by, ord, name): module init and exit, then callbacks by line; without any, functions that are not static, or all.

    functions(*by, name, line, is_callback, is_static); module(*by, name, rank) of the functions named as init and exit.
    Entries are numbered within each unit (`by`), so no task holds those of all units.
    """
    line = F.coalesce(F.col("line"), F.lit(2147483647))
    ranked = functions.join(module.groupBy(*by, "name").agg(F.min("rank").alias("rank")), [*by, "name"], "left")
    main = F.when(F.col("rank").isNotNull(), F.col("rank")).when(F.col("is_callback"), 10)
    levels = ranked.withColumn("level", F.when(main.isNotNull(), 1).when(~F.col("is_static"), 2).otherwise(3)).withColumn("main", F.coalesce(main, F.lit(10)))
    # With no entry among the first, the open functions; with none of these, all are of the last level.
    unit = Window.partitionBy(*by)
    best = levels.withColumn("best", F.min("level").over(unit)).where("level = best")
    return best.select(*by, F.row_number().over(unit.orderBy("main", line, "name")).alias("ord"), "name")


def closure(edges: DataFrame, start: DataFrame, reverse: bool = False, max_rounds: int = fixed.SOLVER_ROUNDS) -> DataFrame:
    """(name, hops) reachable from start(name), shortest number of hops (G7, D13); only what is new is joined in each round."""
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    links = edges.select(F.col(src).alias("name"), F.col(dst).alias("__to")).distinct()
    with Scratch(edges.sparkSession) as scratch:
        links = scratch.write(links)
        seen = front = scratch.write(start.select("name").distinct().withColumn("hops", F.lit(0)))
        for hop in range(1, max_rounds + 1):
            if hop % 16 == 0:  # keeps plans short however long the way is
                seen = scratch.write(seen)
            found = front.select("name").join(links, "name").select(F.col("__to").alias("name")).distinct()
            front = scratch.write(found.join(seen.select("name"), "name", "left_anti").withColumn("hops", F.lit(hop)))
            if front.isEmpty():
                break
            seen = seen.union(front)
        return scratch.keep(seen)


def maintain_closure(seen: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame, start: DataFrame, reverse: bool = False, max_rounds: int = fixed.SOLVER_ROUNDS) -> DataFrame:
    """closure() of edges after a change, from what it was before.

    seen(name, hops) is the closure before the change; edges are those after it, removed and added the difference.  Delete
    and derive again: names whose shortest way may have used a removed edge go, along edges by which the ways went on; then
    they, and what added edges reach, are reached again from those that stay, only improvements being joined in each round.
    The work follows the names that the change concerns, not the closure.
    """
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    turned = lambda df: df.select(F.col(src).alias("name"), F.col(dst).alias("__to")).distinct()
    with Scratch(edges.sparkSession) as scratch:
        links, before = scratch.write(turned(edges)), scratch.write(seen.select("name", "hops"))
        at = before.select(F.col("name").alias("__to"), F.col("hops").alias("__h"))
        gone = front = scratch.write(before.join(turned(removed), "name").join(at, "__to").where("__h = hops + 1").select(F.col("__to").alias("name"), F.col("__h").alias("hops")).distinct())
        for n in range(max_rounds):  # along edges of shortest ways
            if n % 16 == 15:
                gone = scratch.write(gone)
            found = front.join(links, "name").join(at, "__to").where("__h = hops + 1").select(F.col("__to").alias("name"), F.col("__h").alias("hops")).distinct()
            front = scratch.write(found.join(gone, "name", "left_anti"))
            if front.isEmpty():
                break
            gone = gone.union(front)
        roots = start.select("name").distinct().withColumn("hops", F.lit(0))
        kept = scratch.write(before.join(gone, "name", "left_anti").unionByName(roots.join(before, "name", "left_anti")))
        lost = scratch.write(gone.select("name").distinct())
        # Ways into what went, and along what is new.
        new = links.join(lost.withColumnRenamed("name", "__to"), "__to", "left_semi").select("name", "__to").union(turned(added).join(links, ["name", "__to"], "left_semi").select("name", "__to")).distinct()
        offers = kept.join(new, "name").groupBy(F.col("__to").alias("name")).agg((F.min("hops") + 1).alias("hops"))
        for n in range(max_rounds):
            better = scratch.write(offers.join(kept.withColumnRenamed("hops", "__h"), "name", "left").where("__h is null or hops < __h").select("name", "hops"))
            if better.isEmpty():
                break
            kept = kept.join(better, "name", "left_anti").unionByName(better)
            if n % 8 == 7:
                kept = scratch.write(kept)
            offers = better.join(links, "name").groupBy(F.col("__to").alias("name")).agg((F.min("hops") + 1).alias("hops"))
        return scratch.keep(kept.select("name", "hops"))


def shortest_path(edges: DataFrame, a: str, b: str, max_depth: int = fixed.TREE_DEPTH) -> DataFrame:
    """One row (path, hops): the shortest, of equal ones the first by name; each node keeps one path, so it does not blow up."""
    spark = edges.sparkSession
    links = edges.select(F.col("src").alias("name"), F.col("dst").alias("__to")).distinct()
    with Scratch(spark) as scratch:
        links = scratch.write(links)
        seen = front = scratch.write(spark.range(1).select(F.lit(a).alias("name"), F.array(F.lit(a)).alias("path")))
        for _ in range(max_depth):
            step = front.join(links, "name").groupBy(F.col("__to").alias("name")).agg(F.min(F.concat("path", F.array("__to"))).alias("path"))
            front = scratch.write(step.join(seen.select("name"), "name", "left_anti").select("name", "path"))
            seen = seen.union(front)
            if front.isEmpty() or not front.where(F.col("name") == b).isEmpty():
                break
        return scratch.keep(seen.where(F.col("name") == b).select("path", (F.size("path") - 1).alias("hops")))


def first_path(tree: DataFrame, name: str) -> DataFrame:
    """Path to a node, first in depth-first order."""
    return tree.where(F.col("node") == name).groupBy("root").agg(F.min_by("trail", "ord").alias("path"))


def up_to_depth(tree: DataFrame, k: int) -> DataFrame:
    return tree.where(F.col("depth") < k)


def graph_of(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges of trees."""
    nodes = tree.groupBy("node").agg(F.min("depth").alias("depth"), F.min("node_type").alias("node_type"))
    return nodes, tree.where("parent is not null").select("parent", "node").distinct()


def last_child(tree: DataFrame) -> DataFrame:
    """Whether a node is its parent's last (W6), and its number of children."""
    place = Window.partitionBy("root", F.slice("trail", 1, F.size("trail") - 1)).orderBy("ord")
    return tree.withColumn("is_last", F.lead("ord").over(place).isNull())


def child_counts(tree: DataFrame) -> DataFrame:
    return tree.where("parent is not null").groupBy("root", "parent").agg(F.count("*").alias("n_children"))


def fold(tree: DataFrame) -> DataFrame:
    """Repeated callees of a parent as one row with their number."""
    return tree.where("parent is not null").groupBy("parent", "node", "node_type").agg(F.count("*").alias("times"))


def render(tree: DataFrame, style: str = "tree") -> DataFrame:
    """(root, ord, text): one line for each node, by depth-first order.

    tree: indented with connectors; trace: braces around functions with children and a padded type column;
    markdown: nested list.
    """
    if style == "markdown":
        return tree.select("root", "ord", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- `"), F.col("node"), F.lit("`")).alias("text"))
    if style == "trace":
        kids = tree.where("parent is not null").select("root", F.array_join(F.slice("trail", 1, F.size("trail") - 1), "\u0001").alias("ord")).distinct().withColumn("opens", F.lit(True))
        row = tree.join(kids, ["root", "ord"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
        pad, indent = T.pad_end("node_type", 14), F.repeat(F.lit("  "), F.col("depth"))
        head = row.select("root", "ord", F.concat(pad, F.lit("| "), indent, F.col("node"), F.when(F.col("opens"), "() {").otherwise("();")).alias("text"))
        tail = row.where("opens").select("root", F.concat("ord", F.lit("\u0001￿")).alias("ord"), F.concat(F.repeat(F.lit(" "), 14), F.lit("| "), indent, F.lit("}")).alias("text"))
        return head.union(tail)
    marked = last_child(tree)
    mark = F.when(F.col("depth") == 0, "").when(F.col("is_last"), "└─ ").otherwise("├─ ")
    return marked.select("root", "ord", F.concat(F.repeat(F.lit("   "), F.greatest(F.col("depth") - 1, F.lit(0))), mark, F.col("node")).alias("text"))


def dot(edges: DataFrame) -> DataFrame:
    """Graphviz lines."""
    return edges.select(F.format_string('  "%s" -> "%s";', "src", "dst").alias("text")).distinct()


def reachability(tree: DataFrame, blocked: DataFrame) -> DataFrame:
    """tree with reachable: no ancestor or self among blocked(node)."""
    off = blocked.select(F.col("node").alias("__b")).distinct()
    hit = tree.select("root", "ord", F.explode("trail").alias("__b")).join(off, "__b", "left_semi").select("root", "ord").distinct().withColumn("__off", F.lit(True))
    return tree.join(hit, ["root", "ord"], "left").withColumn("reachable", F.col("__off").isNull()).drop("__off")


def as_json(tree: DataFrame) -> DataFrame:
    """(root, ord, text): each node as a JSON object; children follow by path, as a nested object can't grow with the depth."""
    fields = F.struct("node", "parent", "depth", "node_type", F.array_join("trail", "/").alias("path"))
    return tree.select("root", "ord", F.to_json(fields).alias("text"))


def cytoscape(tree: DataFrame, max_nodes: int, include_collapsed: bool = True, shown_depth: int = fixed.SHOWN_DEPTH) -> DataFrame:
    """(ord, text): elements of a Cytoscape graph, nodes first.

    The max_nodes nodes of least depth, then name, are exported with the edges among them; without include_collapsed,
    nothing from shown_depth on.
    """
    seen = tree if include_collapsed else up_to_depth(tree, shown_depth)
    nodes, edges = graph_of(seen)
    kept = nodes.orderBy("depth", "node").limit(max_nodes).withColumn("node_class", T.node_class("node_type"))
    ends = kept.select("node")
    inside = edges.join(ends.withColumnRenamed("node", "parent"), "parent", "left_semi").join(ends, "node", "left_semi")
    rows = kept.select(F.concat_ws("|", F.lit("0"), "node").alias("ord"), F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct(F.col("node").alias("id"), F.col("node_class").alias("class")).alias("data"))).alias("text"))
    lines = inside.select(F.concat_ws("|", F.lit("1"), "parent", "node").alias("ord"), F.to_json(F.struct(F.lit("edges").alias("group"), F.struct(F.col("parent").alias("source"), F.col("node").alias("target")).alias("data"))).alias("text"))
    return rows.union(lines)


def layered_layout(tree: DataFrame) -> DataFrame:
    """(root, node, rank, place, x, y): nodes of a tree from left to right by their least depth, those of one rank below one another by name."""
    nodes = tree.groupBy("root", "node").agg(F.min("depth").alias("rank"))
    place = F.row_number().over(Window.partitionBy("root", "rank").orderBy("node")) - 1
    across, down = fixed.NODE_WIDTH + fixed.RANK_SPACING, fixed.NODE_HEIGHT + fixed.NODE_SPACING
    return nodes.withColumn("place", place).select("root", "node", "rank", "place", (F.col("rank") * across).alias("x"), (F.col("place") * down).alias("y"))


def svg(layout: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, ord, text): a drawing of a layout as SVG elements, edges(root, parent, node) below the nodes."""
    w, h = fixed.NODE_WIDTH, fixed.NODE_HEIGHT
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    a = layout.select("root", F.col("node").alias("parent"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    lines = edges.select("root", "parent", "node").distinct().join(a, ["root", "parent"]).join(layout.select("root", "node", "x", "y"), ["root", "node"])
    drawn = lines.select("root", F.concat_ws("|", F.lit("0"), "parent", "node").alias("ord"), F.format_string(f'<line x1="%d" y1="%d" x2="%d" y2="%d"/>', F.col("x1") + w, F.col("y1") + h // 2, F.col("x"), F.col("y") + h // 2).alias("text"))
    boxes = layout.select("root", F.concat_ws("|", F.lit("1"), "node").alias("ord"), F.format_string(f'<g><rect x="%d" y="%d" width="{w}" height="{h}"/><text x="%d" y="%d">%s</text></g>', "x", "y", F.col("x") + 8, F.col("y") + h // 2, safe(F.col("node"))).alias("text"))
    return drawn.union(boxes)


def folding(tree: DataFrame) -> DataFrame:
    """tree with the state in which a node is first shown (D6): few children open, many fold, and so does all at the shown depth."""
    kids = child_counts(tree).withColumnRenamed("parent", "node")
    n = F.coalesce("n_children", F.lit(0))
    state = F.when(n == 0, "leaf").when((F.col("depth") + 1 >= fixed.SHOWN_DEPTH) | (n > fixed.COLLAPSE_ABOVE), "folded").when(n < fixed.EXPAND_BELOW, "open").otherwise("shown")
    return tree.join(kids, ["root", "node"], "left").withColumn("state", state).drop("n_children")


def flow_lines(tree: DataFrame, edges: DataFrame, functions: DataFrame, name: str) -> DataFrame:
    """(ord, text): the tree of one function; without one its callees; for an unknown name a line that says so (M2)."""
    own = tree.where(F.col("root") == name).select("ord", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("node"), F.lit("()")).alias("text"))
    callees = edges.where(F.col("src") == name).select(F.col("dst").alias("ord"), F.concat(F.lit("  └── "), F.col("dst"), F.lit("()")).alias("text")).distinct()
    head = functions.where(F.col("name") == name).select(F.lit("").alias("ord"), F.lit(f"{name}()").alias("text")).distinct()
    none = tree.sparkSession.range(1).select(F.lit("").alias("ord"), F.lit(f"Function '{name}' not found").alias("text"))
    known = F.broadcast(functions.where(F.col("name") == name).agg(F.count("*").alias("__n")))  # one row
    has = F.broadcast(tree.where(F.col("root") == name).agg(F.count("*").alias("__t")))  # one row
    if_none = head.union(callees).crossJoin(has).where("__t = 0").drop("__t")
    return own.union(if_none).union(none.crossJoin(known).crossJoin(has).where("__n = 0 and __t = 0").drop("__n", "__t"))
