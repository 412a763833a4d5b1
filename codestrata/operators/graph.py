"""The import graph: its edges, strongly connected components, cycles and orphans.

edges: (src, dst); nodes: (file), those without edges included. Edges to files that aren't nodes are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import findings
from codestrata.plans.lineage import written

#: Fixed value: files that tools read by name, so that nothing has to import them.
ORPHAN_EXEMPT = r"(?:^|/)(?:\.[^/]+|[^/]+\.config)\.[cm]?tsx?$"


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between known files, self edges left out."""
    known = nodes.select("file").distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    return e.join(known.withColumnRenamed("file", "src"), "src", "left_semi").join(known.withColumnRenamed("file", "dst"), "dst", "left_semi").select("src", "dst")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges that lie on no cycle because an end has no edge in or no edge out, again and again."""
    n = edges.count()
    while n:
        into, out_of = edges.select(F.col("dst").alias("v")).distinct(), edges.select(F.col("src").alias("v")).distinct()
        both = into.join(out_of, "v", "left_semi")
        edges = written(edges.join(both.withColumnRenamed("v", "src"), "src", "left_semi").join(both.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def strongly_connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, component): each node with the least file of its strongly connected component.

    Edges that lie on no cycle are trimmed. Each node then takes the greatest colour that leads to it; the nodes from
    which the colour's own node is reached within the colour are its component. They are removed, and the rest goes on.
    All state is in tables; a round is a few joins, whatever the graph's size.
    """
    known = nodes.select("file").distinct()
    rest = _trimmed(written(clean_edges(edges, nodes)))
    found: DataFrame | None = None
    while not rest.isEmpty():
        colours = written(rest.select(F.col("src").alias("v")).union(rest.select("dst")).distinct().withColumn("colour", F.col("v")))
        while True:
            reach = rest.join(colours.withColumnRenamed("v", "src"), "src").groupBy("dst").agg(F.max("colour").alias("reach"))
            new = written(colours.join(reach.withColumnRenamed("dst", "v"), "v", "left").select("v", F.greatest("colour", "reach").alias("colour"), (F.col("reach") > F.col("colour")).alias("changed")))
            changed = not new.where("changed").isEmpty()
            colours = new.select("v", "colour")
            if not changed:
                break
        a, b = (colours.select(F.col("v").alias(x), F.col("colour").alias(f"{x}_colour")) for x in ("src", "dst"))
        inside = written(rest.join(a, "src").join(b, "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        done = written(colours.where("v = colour"))
        front = done
        while True:
            front = inside.join(front.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v"), "colour").distinct().join(done, "v", "left_anti")
            front = written(front)
            if front.isEmpty():
                break
            done = written(done.unionByName(front))
        found = done if found is None else found.unionByName(done)
        left = rest.join(done.select(F.col("v").alias("src")), "src", "left_anti").join(done.select(F.col("v").alias("dst")), "dst", "left_anti").select("src", "dst")
        rest = _trimmed(written(left))
    if found is None:
        return known.select("file", F.col("file").alias("component"))
    least = found.groupBy("colour").agg(F.min("v").alias("component"))
    members = found.join(least, "colour").select(F.col("v").alias("file"), F.col("component").alias("own"))
    return known.join(members, "file", "left").select("file", F.coalesce("own", "file").alias("component"))


def cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, size, files) of components of more than one file, or of one that imports itself; the largest first."""
    components = strongly_connected(edges, nodes)
    own = edges.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("self", F.lit(True))
    sized = components.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("file")).alias("files"))
    return sized.join(own, "component", "left").where((F.col("size") > 1) | F.col("self")).select("component", "size", "files").orderBy(F.desc("size"), "component")


def runtime_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that survive the removal of types and aren't dynamic, of files on a cycle of the full graph only.

    refs: (src, dst, survives_emit, kind). Taking edges away makes no cycle, so other files needn't be looked at.
    """
    suspects = cycles(refs, nodes).select(F.explode("files").alias("src"))
    return refs.join(suspects, "src", "left_semi").where(F.col("survives_emit") & (F.col("kind") != "dynamic")).select("src", "dst").distinct()


def orphans(edges: DataFrame, nodes: DataFrame, imported_elsewhere: DataFrame | None = None) -> DataFrame:
    """Files with no edge in or out, that no test imports, and that no tool reads by name."""
    e = clean_edges(edges, nodes)
    linked = e.select(F.col("src").alias("file")).union(e.select("dst"))
    if imported_elsewhere is not None:
        linked = linked.union(imported_elsewhere.select("file"))
    return nodes.select("file").distinct().join(linked.distinct(), "file", "left_anti").where(~F.col("file").cast("string").rlike(ORPHAN_EXEMPT))


def summarize(found: DataFrame, lonely: DataFrame) -> DataFrame:
    """One row: how many cycles and orphans, and the largest cycle."""
    a = found.agg(F.count("*").alias("cycles"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_cycle"))
    return a.crossJoin(lonely.agg(F.count("*").alias("orphans")))  # one row each


def cycle_findings(found: DataFrame) -> DataFrame:
    text = F.concat(F.lit("import cycle: "), F.array_join("files", " -> "))
    return findings.make(found, "depcruise", "cycle", F.col("component"), text, key=F.array_join("files", "|"), value=F.col("size"), threshold=F.lit(1.0))


def orphan_findings(lonely: DataFrame) -> DataFrame:
    return findings.make(lonely, "depcruise", "orphan", F.col("file"), F.lit("no file imports it and it imports none"), severity=F.lit("minor"))
