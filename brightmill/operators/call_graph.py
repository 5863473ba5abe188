"""The call graph inside each project: modules resolved to files, calls resolved to functions.

Everything is an equi-join keyed by project and path. Candidate files of a module become rows with a rank,
and the least rank that exists wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import union_all
from ..functions.parser import view
from ..session import sized

MODULE = "<module>"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _join(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])


def resolve_modules(wanted: DataFrame, every: DataFrame) -> DataFrame:
    """``wanted`` (project, rel, module, level, ...) with ``source``: the rel path of the module's file, or
    NULL. ``every`` holds project and rel of all Python files of the projects.

    Relative modules are looked up from the importing file's folder, ``level - 1`` folders up; absolute ones
    from the project's root, then beside every package folder of the same first name, in path order. ``x.py`` comes
    before ``x/__init__.py``. Folders above the root hold nothing.
    """

    keys = wanted.select("project", "rel", "module", "level").distinct().filter("module is not null and module <> ''")
    module = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    here = F.filter(F.split(_folder(F.col("rel")), "/"), lambda x: x != "")
    up = F.size(here) - (F.col("level") - 1)
    base = F.when(F.col("level") == 0, F.lit("")).when(up >= 0, F.array_join(F.slice(here, 1, F.greatest(up, F.lit(0))), "/"))
    near = keys.select("*", _join(base, module).alias("stem"), F.lit("").alias("beside"), F.lit(0).alias("far"), base.alias("base")).filter("base is not null").drop("base")
    packages = every.filter(F.col("rel").rlike(r"(^|/)__init__\.py$")).select("project", _folder(F.col("rel")).alias("folder")).filter(F.col("folder").contains("/"))
    packages = packages.select("project", F.element_at(F.split("folder", "/"), -1).alias("top"), _folder(F.col("folder")).alias("beside"))
    far = keys.filter("level = 0").withColumn("top", F.substring_index("module", ".", 1)).join(sized(packages), ["project", "top"])
    far = far.select("project", "rel", "module", "level", _join(F.col("beside"), module).alias("stem"), "beside", F.lit(1).alias("far"))
    tries = near.unionByName(far).select("*", F.posexplode(F.array(F.concat("stem", F.lit(".py")), F.concat("stem", F.lit("/__init__.py")))).alias("form", "candidate"))
    hits = tries.join(sized(every.select("project", F.col("rel").alias("candidate"))), ["project", "candidate"])
    best = hits.groupBy("project", "rel", "module", "level").agg(F.min(F.struct("far", "beside", "form", "candidate")).alias("b")).select("project", "rel", "module", "level", F.col("b.candidate").alias("source"))
    return wanted.join(sized(best), ["project", "rel", "module", "level"], "left")


def _aliases(facts: DataFrame) -> DataFrame:
    rows = view(facts.filter("parsed"), "imports").filter("top")
    local = F.coalesce("asname", F.when(F.col("kind") == "from", F.col("symbol")).otherwise(F.substring_index("module", ".", 1)))
    return rows.withColumn("local", local).withColumn("given", F.coalesce("module", F.lit(""))).filter("symbol is null or symbol <> '*'")


def reexports(facts: DataFrame, every: DataFrame) -> DataFrame:
    """(project, local, source) that packages pass on from their own modules; of several the last in path
    and source order."""
    rows = _aliases(facts).filter((F.col("kind") == "from") & (F.col("level") > 0) & F.col("rel").rlike(r"(^|/)__init__\.py$"))
    rows = rows.select("project", "rel", "ord", F.coalesce("asname", "symbol").alias("local"), F.when(F.col("given") == "", F.col("symbol")).otherwise(F.col("given")).alias("module"), "level")
    found = resolve_modules(rows, every).filter("source is not null")
    return found.groupBy("project", "local").agg(F.max_by("source", F.struct("rel", "ord")).alias("source"))


def file_imports(facts: DataFrame, every: DataFrame) -> DataFrame:
    """(project, rel, local, source): what module-level imports of a file bind to files of the project. A
    re-exported name goes to the file that defines it; of several bindings the last counts."""
    rows = _aliases(facts).filter("not (kind = 'from' and given = '__future__')")
    bare = (F.col("kind") == "from") & (F.col("level") > 0) & (F.col("given") == "")
    rows = rows.select("project", "rel", "ord", "local", "kind", bare.alias("bare"), F.when(bare, F.col("symbol")).otherwise(F.col("given")).alias("module"), "level")
    passed = reexports(facts, every).withColumnRenamed("source", "passed")
    found = resolve_modules(rows, every).join(sized(passed), ["project", "local"], "left")
    source = F.when((F.col("kind") == "from") & ~F.col("bare"), F.coalesce("passed", "source")).otherwise(F.col("source"))
    found = found.withColumn("to", source).filter("to is not null")
    return found.groupBy("project", "rel", "local").agg(F.max_by("to", "ord").alias("source"))


def nodes(facts: DataFrame) -> DataFrame:
    """(project, rel, qual) of all functions."""
    return view(facts.filter("parsed"), "spans").select("project", "rel", "qual").distinct()


def spans(facts: DataFrame) -> DataFrame:
    """(project, rel, line, stop, qual) of all functions, and one row at line 0 for each parsed file."""
    own = view(facts.filter("parsed"), "spans").select("project", "rel", "line", "stop", "qual")
    return own.unionByName(facts.filter("parsed").select("project", "rel", F.lit(0).alias("line"), F.lit(None).cast("int").alias("stop"), F.lit(MODULE).alias("qual")))


def edges(facts: DataFrame, every: DataFrame) -> DataFrame:
    """(project, src_rel, src, dst_rel, dst): resolved calls. A bare name is looked up in the own file, then in
    the file it was imported from; ``self.m`` in the innermost class; ``x.m`` in the file that x names."""
    exports = facts.filter("parsed").select("project", F.col("rel").alias("dst_rel"), F.explode("exports").alias("dst"))
    links = view(facts.filter("parsed"), "links").select("project", F.col("rel").alias("src_rel"), F.col("caller").alias("src"), "kind", "obj", F.col("attr").alias("dst"))
    own = links.filter("kind in ('name', 'method')").withColumn("dst_rel", F.col("src_rel")).join(sized(exports), ["project", "dst_rel", "dst"])
    imports = file_imports(facts, every).select("project", F.col("rel").alias("src_rel"), F.col("local"), F.col("source").alias("dst_rel"))
    outside = links.filter("kind in ('name', 'module')").withColumn("local", F.coalesce("obj", "dst")).join(sized(imports), ["project", "src_rel", "local"]).join(sized(exports), ["project", "dst_rel", "dst"])
    here = own.filter("kind = 'name'").select("project", "src_rel", "src", "dst")
    # a name of the own file hides an imported one
    outside = outside.join(sized(here.withColumn("kind", F.lit("name"))), ["project", "src_rel", "src", "dst", "kind"], "left_anti")
    cols = ["project", "src_rel", "src", "dst_rel", "dst"]
    return union_all([own.select(cols), outside.select(cols)]).distinct()
