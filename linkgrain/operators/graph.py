"""Bounded graph iteration: walks, impact, provenance paths, review closure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CURRENT, REVIEWED, SEMANTIC, STALE, STRUCTURAL
from ..scratch import kept

WHY_PREDICATES = ("work", "satisfies", "implements", "addresses", "derived_from")
# What a path is worth for the types on it, and their order from intent to code.
PRESENCE = {"work": 100, "requirement": 90, "decision": 80, "plan": 70}
POSITION = {"work": 0, "requirement": 1, "decision": 2, "plan": 3, "implementation": 4}


def steps(edges: DataFrame, direction: str, predicates=None) -> DataFrame:
    """(here, there, p, f, t) moves along the edges."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction is {direction!r}")
    edges = edges if predicates is None else edges.filter(F.col("p").isin(*predicates))
    out = edges.select(F.col("f").alias("here"), F.col("t").alias("there"), "p", "f", "t")
    back = edges.select(F.col("t").alias("here"), F.col("f").alias("there"), "p", "f", "t")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def walk(start: DataFrame, nodes: DataFrame, edges: DataFrame, *, direction: str = "out", predicates=None, depth: int = 5, max_nodes: int | None = 500) -> DataFrame:
    """(trace_id, depth) of nodes first reached from ``start`` (trace_id), itself at depth 0.

    Breadth first over all edges, whatever their status; nodes that are not in
    ``nodes`` are not entered.  ``max_nodes`` keeps the first by depth and id;
    once so many are reached no deeper one can be among them, and the walk ends.
    Each hop joins the frontier, a written table of known size, with the moves
    and leaves out what is visited; a small frontier is broadcast by its size, a
    large one shuffles the moves by ``here``, the plan's one large exchange.
    """
    if depth < 0 or (max_nodes is not None and max_nodes < 1):
        raise ValueError("depth and max_nodes must be positive")
    moves = steps(edges, direction, predicates).select("here", "there")
    there = nodes.select("trace_id")
    frontier = seen = kept(start.select("trace_id").distinct().join(there, "trace_id", "left_semi").withColumn("depth", F.lit(0)), "hop")
    for hop in range(1, depth + 1):
        if max_nodes is not None and seen.count() >= max_nodes:
            break
        reached = frontier.select(F.col("trace_id").alias("here")).join(moves, "here").select(F.col("there").alias("trace_id")).distinct()
        reached = reached.join(seen.select("trace_id"), "trace_id", "left_anti").join(there, "trace_id", "left_semi")
        frontier = kept(reached.withColumn("depth", F.lit(hop)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if max_nodes is not None:
        seen = seen.orderBy("depth", "trace_id").limit(max_nodes)
    return seen


def subgraph_edges(reached: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges of expanded nodes: those at depth 0 to ``depth`` - 1."""
    inner = reached.filter(F.col("depth") < depth).select("trace_id")
    a = edges.join(inner.withColumnRenamed("trace_id", "f"), "f", "left_semi")
    b = edges.join(inner.withColumnRenamed("trace_id", "t"), "t", "left_semi")
    return a.unionByName(b).distinct()


def impact(start: DataFrame, nodes: DataFrame, edges: DataFrame, *, depth: int = 3, max_nodes: int | None = 500, predicates=SEMANTIC) -> DataFrame:
    """Dependents of ``start``: (trace_id, depth, node_type, is_test, stale)."""
    found = walk(start, nodes, edges, direction="in", predicates=predicates, depth=depth, max_nodes=max_nodes).filter("depth > 0")
    kinds = nodes.select("trace_id", "node_type", "status")
    return found.join(kinds, "trace_id").select("trace_id", "depth", "node_type", (F.col("node_type") == "test").alias("is_test"), (F.col("status") != "current").alias("stale"))


def impact_summary(start: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame | None = None, *, depth: int = 3, max_nodes: int | None = 500, most_commits: int = 20) -> DataFrame:
    """What a change of ``start`` touches: (part, trace_id, depth, detail).

    ``semantic`` and ``structural`` dependents come from two walks over their
    kinds of edges, ``test`` from the semantic ones; ``stale`` has what of them is
    not current, once, with its status.  ``history``, with ``commits`` (of
    ``history.last_commits``), has the last commits of the starts' own files: the
    path, the rank for depth, and the commit.
    """
    walks = {kind: walk(start, nodes, edges, direction="in", predicates=of, depth=depth, max_nodes=max_nodes).filter("depth > 0") for kind, of in (("semantic", SEMANTIC), ("structural", STRUCTURAL))}
    kinds = nodes.select("trace_id", "node_type", "status")
    reached = {kind: kept(rows.join(kinds, "trace_id"), f"impact-{kind}") for kind, rows in walks.items()}
    out = None
    for kind, rows in reached.items():
        part = rows.select(F.lit(kind).alias("part"), "trace_id", "depth", F.col("node_type").alias("detail"))
        out = part if out is None else out.unionByName(part)
    out = out.unionByName(reached["semantic"].filter("node_type = 'test'").select(F.lit("test").alias("part"), "trace_id", "depth", F.col("status").alias("detail")))
    either = reached["semantic"].unionByName(reached["structural"]).filter(F.col("status") != CURRENT)
    out = out.unionByName(either.groupBy("trace_id", "status").agg(F.min("depth").alias("depth")).select(F.lit("stale").alias("part"), "trace_id", "depth", F.col("status").alias("detail")))
    if commits is not None:
        from .history import last_commits

        paths = nodes.join(start.select("trace_id").distinct(), "trace_id", "left_semi").filter("path is not null").select("path").distinct()
        past = last_commits(paths, commits, most_commits)
        out = out.unionByName(past.select(F.lit("history").alias("part"), F.col("path").alias("trace_id"), F.col("rank").cast("int").alias("depth"), F.col("sha").alias("detail")))
    return out


def _ways(start: str, kind: str, known: dict, hops: int, expansions: int, candidates: int) -> tuple[list, list]:
    """(paths, nodes to be told of) of a depth-first search over ``known``: node to its moves (there, kind) in order.

    At most ``candidates`` paths come from a node, and ``expansions`` moves are
    made in all; a path that meets a bound ends where it is.  A node that is not
    known yet counts as an end.
    """
    wanted, spent, out = {}, 0, []
    # A frame: node, its remaining moves, its paths so far.
    chain, frames = [(start, kind)], [[iter(known.get(start) or ()), []]]
    if start not in known:
        return [], [start]
    while frames:
        moves, own = frames[-1]
        step = None if len(own) >= candidates else next((m for m in moves if all(m[0] != c[0] for c in chain)), None)
        if step is None:
            frames.pop()
            paths = own or [[]]
            at = chain.pop()
            if frames:
                above = frames[-1][1]
                above.extend([[at, *p] for p in paths][: candidates - len(above)])
            else:
                out = [[at, *p] for p in own]
            continue
        spent += 1
        chain.append(step)
        if len(chain) > hops or spent >= expansions:
            frames.append([iter(()), []])
        else:
            if step[0] not in known:
                wanted[step[0]] = None
            frames.append([iter(known.get(step[0]) or ()), []])
    return out, list(wanted)


def why_paths(start: DataFrame, nodes: DataFrame, edges: DataFrame, *, hops: int = 8, max_paths: int = 5, expansions: int = 200, factor: int = 4) -> DataFrame:
    """Best simple paths from each start to its origins: (trace_id, chain root first, hops, score, rank).

    A start's paths are found depth first, work before requirements before
    plans, with ``expansions`` moves in all and ``factor * max_paths`` paths a
    node.  The searches of all starts go on together: each round every start
    searches what it knows of the graph, as grouped state, and asks for the moves
    of nodes that it came to; those join with the edges.  As a node's paths are
    bounded, so are the moves that a search can make from it, and only these are
    told.  Rounds end when no search asks, about one a hop.  Score, length and
    chain order the paths of each start.
    """
    from ..functions.ids import node_uid

    candidates = factor * max(1, max_paths)
    most = candidates + len(WHY_PREDICATES) * (hops + 1)  # moves to nodes on the path are passed over
    rank = F.array_position(F.array(*[F.lit(p) for p in WHY_PREDICATES]), F.col("p"))
    kinds = nodes.select(F.col("trace_id").alias("there"), F.col("node_type").alias("kind"))
    moves = edges.filter(F.col("p").isin(*WHY_PREDICATES) & (F.col("f") != F.col("t"))).select(F.col("f").alias("at"), F.col("t").alias("there"), rank.alias("turn")).distinct()
    first = start.select("trace_id").distinct().join(nodes.select("trace_id", "node_type"), "trace_id").select("trace_id", F.col("node_type").alias("kind"))
    first = kept(first, "why-starts")
    wanted, known, done = first.select("trace_id", F.col("trace_id").alias("at")), None, None

    def search(group: pd.DataFrame) -> pd.DataFrame:
        steps = {at: [] if m is None else [(x["there"], x["kind"]) for x in m] for at, m in zip(group["at"], group["moves"], strict=True)}
        own = group["trace_id"].iloc[0]
        paths, asked = _ways(own, group["kind"].iloc[0], steps, hops, expansions, candidates)
        rows = [(own, None, [x[0] for x in p], [x[1] for x in p]) for p in ([] if asked else paths)] + [(own, x, None, None) for x in asked]
        return pd.DataFrame(rows, columns=["trace_id", "at", "chain", "types"])

    while True:
        # Each wanted node's moves once, however many starts ask.
        told = moves.join(wanted.select("at").distinct(), "at", "left_semi").join(kinds, "there")
        told = told.withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy("turn", node_uid(F.col("there"))))).filter(F.col("n") <= most)
        told = told.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("n", "there", "kind"))).alias("moves"))
        fresh = kept(wanted.join(told, "at", "left").select("trace_id", "at", "moves"), "why-known")
        known = fresh if known is None else known.unionByName(fresh)
        open_ = known.join(wanted.select("trace_id").distinct(), "trace_id", "left_semi").join(first, "trace_id")
        found = kept(open_.groupBy("trace_id").applyInPandas(search, "trace_id string, at string, chain array<string>, types array<string>"), "why-found")
        ended = found.filter("at is null").select("trace_id", "chain", "types")
        done = ended if done is None else done.unionByName(ended)
        wanted = found.filter("at is not null").select("trace_id", "at")
        if wanted.isEmpty():
            break
    done = done.filter(F.size("chain") > 1).select("trace_id", F.reverse("chain").alias("chain"), F.reverse("types").alias("types"))
    place = F.transform("types", lambda t: F.coalesce(*[F.when(t == k, v) for k, v in POSITION.items()], F.lit(5)))
    score = F.lit(0)
    for kind, worth in PRESENCE.items():
        score = score + F.when(F.array_contains("types", kind), worth).otherwise(0)
    ordered = F.aggregate("place", F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("before")), lambda a, x: F.struct((a["n"] + F.size(F.filter(a["before"], lambda y: y < x))).alias("n"), F.concat(a["before"], F.array(x)).alias("before")), lambda a: a["n"])
    done = done.withColumn("place", place).withColumn("hops", F.size("chain") - 1)
    done = done.withColumn("score", score + 2 * ordered - F.col("hops")).withColumn("chain", F.array_join("chain", "-"))
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("score").desc(), "hops", "chain"))
    return done.select("trace_id", "chain", "hops", "score").distinct().withColumn("rank", rank).filter(F.col("rank") <= max(1, max_paths))


def review(start: DataFrame, nodes: DataFrame, edges: DataFrame, *, depth: int = 5) -> DataFrame:
    """Nodes with the status after a review of ``start``: what is stale and within ``depth`` hops either way awaits verification."""
    near = walk(start, nodes, edges, direction="both", depth=depth, max_nodes=None).select("trace_id", F.lit(True).alias("near"))
    return nodes.join(near, "trace_id", "left").withColumn("status", F.when(F.col("near") & (F.col("status") == STALE), REVIEWED).otherwise(F.col("status"))).drop("near")


def tree(root: str, reached: DataFrame, moves: DataFrame) -> str:
    """Text tree of a bounded subgraph, each node shown once."""
    own = {r["trace_id"] for r in reached.select("trace_id").toLocalIterator()}
    below: dict[str, list] = {}
    for r in moves.join(reached.select(F.col("trace_id").alias("here")), "here", "left_semi").select("here", "there", "p").distinct().orderBy("here", "p", "there").toLocalIterator():
        below.setdefault(r["here"], []).append((r["p"], r["there"]))
    out, seen, todo = [], set(), [(root, "", 0)]
    while todo:
        node, label, level = todo.pop()
        again = node in seen
        out.append("  " * level + (f"{label} " if label else "") + node + (" *" if again else ""))
        seen.add(node)
        if not again and node in own:
            todo += [(there, p, level + 1) for p, there in reversed(below.get(node, []))]
    return "\n".join(out)


def mermaid(edges: DataFrame) -> DataFrame:
    """Lines of a mermaid graph in a fixed order."""
    return edges.orderBy("f", "p", "t").select(F.concat(F.lit("  "), "f", F.lit(" -->|"), "p", F.lit("| "), "t").alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a Graphviz graph in a fixed order."""
    return edges.orderBy("f", "p", "t").select(F.concat(F.lit('  "'), "f", F.lit('" -> "'), "t", F.lit('" [label="'), "p", F.lit('"];')).alias("value"))
