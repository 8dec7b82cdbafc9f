"""Graph operators over all projects at once, keyed by ``project``.

Frames: edges(project, src, dst), modules(project, source), file_stats(project,
path, loc, complexity, ord), nodes(project, node, loc, complexity, fan_in,
fan_out), scc(project, node, comp) with comp the least node of a component,
depth(project, comp, depth).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.scratch import Rounds, discard, materialize

#: Projects with at most so many edges are handled by one task each.
GROUPED_EDGES = 2_000_000


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("project", "src", "dst").distinct()


def build_nodes(modules: DataFrame, edges: DataFrame, file_stats: DataFrame) -> DataFrame:
    """Modules and both ends of edges, with their file's size and their degrees.

    Files count for nodes of exactly their path; the last of files with one
    path counts. A self-edge adds one to both degrees.
    """
    e = distinct_edges(edges)
    ends = modules.select("project", F.col("source").alias("node"), F.lit(0).alias("o"), F.lit(0).alias("i"))
    ends = ends.unionByName(e.select("project", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")))
    ends = ends.unionByName(e.select("project", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    # One shuffle on (project, node) serves the distinct, both degrees and the join.
    nodes = ends.groupBy("project", "node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    last = file_stats.groupBy("project", F.col("path").alias("node")).agg(F.max_by(F.struct("loc", "complexity"), "ord").alias("s"))
    return nodes.join(last, ["project", "node"], "left").select(
        "project", "node",
        F.coalesce("s.loc", F.lit(0.0)).alias("loc"), F.coalesce("s.complexity", F.lit(0.0)).alias("complexity"),
        "fan_in", "fan_out",
    )


# --- one task a project -----------------------------------------------------


def components(out: dict[str, list[str]]) -> dict[str, str]:
    """Least node of each node's strongly connected component, by depth-first search with two stacks (Gabow)."""
    order: dict[str, int] = {}
    comp: dict[str, str] = {}
    for start in out:
        if start in order:
            continue
        path, bounds = [], []
        todo: list[tuple[str, Iterator[str]]] = []

        def enter(v: str) -> None:
            order[v] = len(order)
            path.append(v)
            bounds.append(v)
            todo.append((v, iter(out[v])))

        enter(start)
        while todo:
            v, rest = todo[-1]
            for w in rest:
                if w not in order:
                    enter(w)
                    break
                if w not in comp:
                    while order[bounds[-1]] > order[w]:
                        bounds.pop()
            else:
                todo.pop()
                if bounds[-1] == v:
                    bounds.pop()
                    members = []
                    while not members or members[-1] != v:
                        members.append(path.pop())
                    least = min(members)
                    comp.update(dict.fromkeys(members, least))
    return comp


def depths(out: dict[str, list[str]], comp: dict[str, str]) -> dict[str, int]:
    """Modules on the longest chain of components that arrives at each; 1 where none does."""
    next_of: dict[str, set[str]] = {c: set() for c in comp.values()}
    waiting = dict.fromkeys(next_of, 0)
    for v, ws in out.items():
        for w in ws:
            a, b = comp[v], comp[w]
            if a != b and b not in next_of[a]:
                next_of[a].add(b)
                waiting[b] += 1
    depth = dict.fromkeys(next_of, 1)
    ready = [c for c, n in waiting.items() if not n]
    while ready:
        a = ready.pop()
        for b in next_of[a]:
            depth[b] = max(depth[b], depth[a] + 1)
            waiting[b] -= 1
            if not waiting[b]:
                ready.append(b)
    return depth


def _one_project(pdf: pd.DataFrame) -> pd.DataFrame:
    out: dict[str, list[str]] = {v: [] for v in pd.unique(pd.concat([pdf.src, pdf.dst]))}
    for a, b in zip(pdf.src, pdf.dst, strict=True):
        out[a].append(b)
    comp = components(out)
    depth = depths(out, comp)
    return pd.DataFrame({"project": pdf.project.iloc[0], "node": list(comp), "comp": list(comp.values()), "depth": [depth[c] for c in comp.values()]})


def grouped_structure(edges: DataFrame) -> DataFrame:
    """(project, node, comp, depth) of all nodes with edges; a project is one task's."""
    return edges.groupBy("project").applyInPandas(_one_project, "project string, node string, comp string, depth int")


# --- a graph over all tasks -------------------------------------------------


def scc_distributed(edges: DataFrame) -> DataFrame:
    """Components of the nodes with edges, for graphs of any size: trim, colour forward, collect backward.

    Nodes without incoming or outgoing edges are components of their own and
    are trimmed until none is left. In the rest each node takes the least node
    that reaches it as its colour; what reaches a colour's own node within the
    colour is its component. These go, and the rest is done again. Each round is
    a linear number of rows; all state is written to the shared scratch folder.
    """
    e = materialize(distinct_edges(edges))
    found = e.select("project", F.explode(F.array("src", "dst")).alias("node")).distinct()
    live = materialize(e.where("src <> dst"))
    parts = Rounds(e.sparkSession, "project string, node string, c string")
    n = live.count()
    while n:
        live, n = _trimmed(live, n)
        if not n:
            break
        colour = _spread_least(live)
        same = live.join(colour.withColumnsRenamed({"node": "src", "label": "c1"}), ["project", "src"]).join(colour.withColumnsRenamed({"node": "dst", "label": "c2"}), ["project", "dst"]).where("c1 = c2").select("project", "src", "dst", F.col("c1").alias("c"))
        same = materialize(same)
        members = parts.add(_reaching_roots(same))
        gone = members.select("project", "node")
        rest = live.join(gone.withColumnRenamed("node", "src"), ["project", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["project", "dst"], "left_anti")
        old, live = live, materialize(rest)
        n = live.count()
        for df in (old, colour, same):
            discard(df)
    discard(live)
    # A node is in one component, so all rounds together are joined once.
    return found.join(parts.every(), ["project", "node"], "left").select("project", "node", F.coalesce("c", "node").alias("comp"))


def _trimmed(live: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``live``, of ``n`` edges, without those from nodes that none arrives at, and to nodes that none leaves; and their number."""
    while True:
        kept = live.join(live.select("project", F.col("dst").alias("src")).distinct(), ["project", "src"], "left_semi")
        kept = kept.join(live.select("project", F.col("src").alias("dst")).distinct(), ["project", "dst"], "left_semi").select("project", "src", "dst")
        old, live = live, materialize(kept)
        discard(old)
        before, n = n, live.count()
        if n in (0, before):
            return live, n


def _spread_least(live: DataFrame) -> DataFrame:
    """(project, node, label): the least node that reaches each. A round adds the labels that fell, and nothing else."""
    labels = Rounds(live.sparkSession, "project string, node string, label string")
    changed = labels.add(live.select("project", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not changed.isEmpty():
        sent = live.join(changed.select("project", F.col("node").alias("src"), "label"), ["project", "src"]).groupBy("project", F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        known = sent.join(labels.every(), ["project", "node"]).groupBy("project", "node", "new").agg(F.min("label").alias("label"))
        changed = labels.add(known.where("new < label").select("project", "node", F.col("new").alias("label")))
    least = materialize(labels.every().groupBy("project", "node").agg(F.min("label").alias("label")))
    labels.discard()
    return least


def _reaching_roots(same: DataFrame) -> DataFrame:
    """(project, node, c): what reaches the colour's own node. A round adds what the one before it leads back to."""
    members = Rounds(same.sparkSession, "project string, node string, c string")
    front = members.add(same.select("project", F.col("c").alias("node"), "c").distinct())
    while not front.isEmpty():
        step = same.join(front.select("project", F.col("node").alias("dst"), "c"), ["project", "dst", "c"]).select("project", F.col("src").alias("node"), "c").distinct()
        front = members.add(step.join(members.every(), ["project", "node", "c"], "left_anti"))
    return members.every()


def condense(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Distinct edges between different components: dag(project, src_comp, dst_comp)."""
    s = scc.select("project", F.col("node").alias("src"), F.col("comp").alias("src_comp"))
    d = scc.select("project", F.col("node").alias("dst"), F.col("comp").alias("dst_comp"))
    return distinct_edges(edges).join(s, ["project", "src"]).join(d, ["project", "dst"]).where("src_comp <> dst_comp").select("project", "src_comp", "dst_comp").distinct()


def longest_path(dag: DataFrame, scc: DataFrame) -> DataFrame:
    """depth(project, comp, depth): the last level at which a component is in the frontier that starts at the roots.

    Each level is added to those before it; the last one of a component is taken once, at the end.
    """
    dag = materialize(dag)
    levels = Rounds(dag.sparkSession, "project string, comp string")
    roots = scc.select("project", "comp").distinct().join(dag.select("project", F.col("dst_comp").alias("comp")).distinct(), ["project", "comp"], "left_anti")
    front = levels.add(roots)
    while not front.isEmpty():
        front = levels.add(dag.join(front.withColumnRenamed("comp", "src_comp"), ["project", "src_comp"]).select("project", F.col("dst_comp").alias("comp")).distinct())
    return levels.every("depth").groupBy("project", "comp").agg(F.max("depth").alias("depth"))


def depth_range(structure: DataFrame) -> DataFrame:
    """(project, max_depth, n_depths): the greatest depth of a project's graph, and how many different ones there are."""
    return structure.groupBy("project").agg(F.max("depth").alias("max_depth"), F.count_distinct("depth").alias("n_depths"))


def structure(edges: DataFrame, nodes: DataFrame | None = None, grouped_edges: int = GROUPED_EDGES) -> DataFrame:
    """(project, node, comp, depth), of each project by the way that its size allows.

    Both ways give the same rows. With ``nodes``, those without edges are
    components of their own at depth 1.
    """
    e = distinct_edges(edges)
    large = materialize(e.groupBy("project").count().where(F.col("count") > grouped_edges).select("project"))
    if large.isEmpty():
        out = grouped_structure(e)
    else:
        out = grouped_structure(e.join(large, "project", "left_anti"))
        most = materialize(e.join(large, "project", "left_semi"))
        scc = materialize(scc_distributed(most))
        depths_of = longest_path(condense(most, scc), scc)
        out = out.unionByName(scc.join(depths_of, ["project", "comp"]).select("project", "node", "comp", "depth"))
    if nodes is None:
        return out
    return nodes.select("project", "node").join(out, ["project", "node"], "left").select("project", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("depth", F.lit(1)).alias("depth"))


def cycle_sizes(scc: DataFrame) -> DataFrame:
    """(project, comp, size) of components with more than one node."""
    return scc.groupBy("project", "comp").agg(F.count("*").alias("size")).where("size > 1")
