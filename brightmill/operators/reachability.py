"""Which findings a language model can reach: enclosing functions, bounded closure, states.

The closure keeps one row per function, not one per (entry point, function): at the level where a function is
first met its path is as short as any, and the best entry point there is the least (name, order) among its
predecessors' best, because those predecessors are themselves met for the first time one level before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, sized, stored
from .call_graph import MODULE

DEPTH, SHOWN = 8, 5


def enclosing(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (project, rel, lineno, ...) with ``qual``: the innermost function around the line, the module,
    or NULL where the file has no facts or the line is NULL.

    Spans nest, so a file is swept once, in order of lines: the number of open spans is a running sum, and the innermost
    of them is the last one that was opened at that depth. No line meets all spans of its file.
    """
    file = ["project", "rel"]
    shape = dict(spans.dtypes)["qual"]
    event = lambda at, kind, delta, qual: [F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"), F.lit(delta).alias("delta"), qual.cast(shape).alias("qual")]
    none = F.lit(None)
    asked = rows.select(*file, F.struct("*").alias("row"), *event("lineno", 2, 0, none))
    # what ends on the line before is closed first, then what begins on a line is opened, then the line is looked up
    ends = spans.filter("stop is not null").withColumn("after", F.col("stop") + 1).select(*file, *event("after", 0, -1, none))
    sweep = asked.unionByName(spans.select(*file, *event("line", 1, 1, F.col("qual"))), allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    running = lambda *keys: Window.partitionBy(*file, *keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sweep = sweep.withColumn("open", F.sum("delta").over(running()))
    sweep = sweep.withColumn("qual", F.last("qual", ignorenulls=True).over(running("open")))
    return sweep.filter("kind = 2").select("row.*", F.when(F.col("at").isNotNull() & (F.col("open") > 0), F.col("qual")).alias("qual"))


def starts(entry_points: DataFrame, spans: DataFrame) -> DataFrame:
    """Functions at which entry points begin: project, rel, qual, ep (name), ep_ord.

    An entry point begins at the function defined on its line; one that is a class begins at the first run method
    after it, if no plain function comes before.
    """
    at = spans.filter(F.col("qual") != MODULE)
    exact = entry_points.join(sized(at.select("project", "rel", F.col("line").alias("lineno"), "qual")), ["project", "rel", "lineno"], "left")
    # from the last line of a file to its first, the function that ends the search is the last one met: no class meets all spans of its file
    runs = F.col("qual").rlike(r"\.(_run|_arun|__call__)$")
    ends = at.filter(runs | ~F.col("qual").contains(".")).select("project", "rel", F.col("line").alias("at"), F.lit(1).alias("kind"), F.struct(F.when(runs, F.col("qual")).alias("q")).alias("m"))
    asked = exact.filter("qual is null and pattern_type = 'class_attribute'").select("project", "rel", F.col("lineno").alias("at"), F.lit(0).alias("kind"), F.col("name").alias("ep"), "ep_ord")
    back = Window.partitionBy("project", "rel").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    late = asked.unionByName(ends, allowMissingColumns=True).withColumn("m", F.last("m", ignorenulls=True).over(back))
    late = late.filter("kind = 0 and m.q is not null").select("project", "rel", F.col("m.q").alias("qual"), "ep", "ep_ord")
    return exact.filter("qual is not null").select("project", "rel", "qual", F.col("name").alias("ep"), "ep_ord").unionByName(late)


def numbered(entry_points: DataFrame) -> DataFrame:
    """Entry points with ``ep_ord``, their place in the project."""
    w = Window.partitionBy("project").orderBy("rel", "step", "ord", "sub", "lineno", "name")
    return entry_points.withColumn("ep_ord", F.row_number().over(w))


def closure(begin: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Functions met within ``depth`` calls: project, rel, qual, ep, ep_ord, hops, path and files (names and
    files from the entry point to the function). Of paths of one length and entry point the least counts."""
    node = ["project", "rel", "qual"]
    step = F.struct(F.col("ep"), F.col("ep_ord"), F.col("path"), F.col("files"))
    first = begin.withColumns({"path": F.array("qual"), "files": F.array("rel")}).groupBy(node).agg(F.min(step).alias("b"))
    seen = stored(first.select(*node, "b.*", F.lit(0).alias("hops")), "closure")
    levels = [seen]
    links = edges.select("project", F.col("src_rel").alias("rel"), F.col("src").alias("qual"), "dst_rel", "dst")
    for level in range(1, depth + 1):
        now = levels[-1].join(sized(links), node)
        now = now.select("project", F.col("dst_rel").alias("rel"), F.col("dst").alias("qual"), "ep", "ep_ord", F.concat("path", F.array("dst")).alias("path"), F.concat("files", F.array("dst_rel")).alias("files"))
        new = now.join(sized(seen.select(node)), node, "left_anti").groupBy(node).agg(F.min(step).alias("b")).select(*node, "b.*", F.lit(level).alias("hops"))
        new = stored(new, "closure")
        levels.append(new)
        if not new.head(1):
            break
        seen = seen.unionByName(new)
    out = stored(seen, "reach")
    discard(*levels)
    return out


def warnings(reach: DataFrame, edges: DataFrame, found: DataFrame, spans: DataFrame, depth: int = DEPTH) -> DataFrame:
    """What limited the analysis, as (project, warning, n): functions not followed because they lie beyond
    ``depth`` calls (``depth``), and files with findings but without facts (``no_facts``)."""
    node = ["project", "rel", "qual"]
    links = edges.select("project", F.col("src_rel").alias("rel"), F.col("src").alias("qual"), "dst_rel", "dst")
    last = reach.filter(F.col("hops") == depth).join(sized(links), node).select("project", F.col("dst_rel").alias("rel"), F.col("dst").alias("qual")).distinct()
    beyond = last.join(sized(reach.select(node)), node, "left_anti").groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit("depth").alias("warning"), "n")
    lost = found.select("project", "rel").distinct().join(sized(spans.select("project", "rel").distinct()), ["project", "rel"], "left_anti")
    return beyond.unionByName(lost.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit("no_facts").alias("warning"), "n"))


def tag(found: DataFrame, entry_points: DataFrame, facts_spans: DataFrame, graph_nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """``found`` with reachability, entry_point_name, ep_ord, reachability_path, reachability_files and
    reachability_path_truncated; ``reach`` is the closure of the entry points."""
    any_ep = entry_points.select("project").distinct().withColumn("has_ep", F.lit(True))
    reach = reach.withColumnRenamed("path", "chain")
    rows = enclosing(found, facts_spans).join(sized(any_ep), "project", "left").join(sized(reach), ["project", "rel", "qual"], "left").join(sized(graph_nodes.withColumn("is_node", F.lit(True))), ["project", "rel", "qual"], "left")
    state = (
        F.when(F.col("has_ep").isNull(), "no_entry_points").when(F.col("qual").isNull(), "unknown").when(F.col("qual") == MODULE, "module_level")
        .when(F.col("chain").isNotNull(), "reachable").when(F.col("is_node").isNull(), "unknown").otherwise("unreachable")
    )
    hit = state == "reachable"
    return rows.withColumns(
        {
            "reachability": state,
            "entry_point_name": F.when(hit, F.col("ep")),
            "ep_ord": F.when(hit, F.col("ep_ord")),
            "reachability_path": F.when(hit, F.col("chain")),
            "reachability_files": F.when(hit, F.col("files")),
            "reachability_path_truncated": F.when(hit, F.size("chain") > SHOWN).otherwise(False),
        }
    ).drop("has_ep", "is_node", "chain", "files", "ep", "hops")


def reachable_findings(found: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Entry points (with ``ep_ord``) and the ids of the findings that they reach best."""
    ids = found.filter("ep_ord is not null").groupBy("project", "ep_ord").agg(F.sort_array(F.collect_list("finding_id")).alias("reachable_findings"))
    return entry_points.join(sized(ids), ["project", "ep_ord"], "left").withColumn("reachable_findings", F.coalesce("reachable_findings", F.array().cast("array<string>")))
