"""Python entry points: decorated definitions, tool classes and factory calls, with their frameworks.

Works on fact rows like the detectors: lookups of imports stay inside the file's row. One shuffle, of the
(few) matches, removes repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .detectors import last_of, quoted
from .findings import union_all

KEYS = ["project", "path", "rel"]


def origins(imports: Column) -> Column:
    """Array of (local, module): where each imported name comes from, in order. Relative imports without a
    module are left out."""
    kept = F.filter(imports, lambda i: (i.kind == "import") | (F.coalesce(i.module, F.lit("")) != ""))
    return F.transform(
        kept,
        lambda i: F.struct(
            F.coalesce(i.asname, F.when(i.kind == "from", i.symbol).otherwise(F.substring_index(i.module, ".", 1))).alias("local"),
            i.module.alias("module"),
        ),
    )


def framework_of(module: str, frameworks=R.FRAMEWORKS) -> Column:
    """Framework of a module (a column's name): the first entry that equals it or is a dotted prefix of it."""
    return F.expr("CASE " + " ".join(f"WHEN {module} = {quoted(p)} OR startswith({module}, {quoted(p + '.')}) THEN {quoted(name)}" for p, name in frameworks) + " END")


def _within(module: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: (module == p) | module.startswith(F.concat(p, F.lit("."))))


def _with_origins(facts: DataFrame) -> DataFrame:
    d = facts.filter("parsed").withColumn("origins", origins(F.col("imports")))
    made = F.transform("assigned", lambda a: F.struct(a["var"].alias("local"), last_of(F.col("origins"), "local", a["called"], "module").alias("module")))
    return d.withColumn("inferred", F.filter(made, lambda m: m["module"].isNotNull()))


def _look(array: str, name) -> Column:
    return last_of(F.col(array), "local", name, "module")


def _decorated(d: DataFrame, table) -> DataFrame:
    one = F.transform(F.filter("decorators", lambda x: x["key"].isin(list(table))), lambda x: F.struct(x.alias("d"), _look("origins", x["receiver"]).alias("of_receiver"), _look("origins", x["key"]).alias("of_key"), _look("inferred", x["receiver"]).alias("made_of")))
    rows = d.select(*KEYS, F.explode(one).alias("x")).select(*KEYS, "x.d.*", "x.of_receiver", "x.of_key", "x.made_of")
    # handlers below function level count in the second pass only
    rows = rows.filter("step = 1 or key in ('call_tool', 'list_tools')")
    first = Window.partitionBy("project", "path", "step", "ord").orderBy("nth")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    hint = lambda c: F.lower(c).isin(R.MCP_NAMES)
    default = F.coalesce(*[F.when(F.col("key") == k, v) for k, v in table.items()])
    pick = F.coalesce(
        F.when(framework_of("of_receiver").isNotNull(), F.struct(framework_of("of_receiver").alias("framework"), F.lit(0.95).alias("confidence"))),
        F.when(framework_of("of_key").isNotNull(), F.struct(framework_of("of_key").alias("framework"), F.lit(0.95).alias("confidence"))),
        F.when(framework_of("made_of").isNotNull(), F.struct(framework_of("made_of").alias("framework"), F.lit(0.8).alias("confidence"))),
        F.when(F.col("of_receiver").isNotNull(), F.struct(F.when(hint(F.col("receiver")), "mcp").otherwise(R.UNKNOWN_FRAMEWORK).alias("framework"), F.lit(0.7).alias("confidence"))),
        F.when(F.col("of_key").isNotNull(), F.struct(F.when(hint(F.col("key")), "mcp").otherwise(R.UNKNOWN_FRAMEWORK).alias("framework"), F.lit(0.7).alias("confidence"))),
        F.when(hint(F.col("receiver")), F.struct(F.lit("mcp").alias("framework"), F.lit(0.6).alias("confidence"))),
        F.struct(default.alias("framework"), F.lit(0.6).alias("confidence")),
    )
    return rows.withColumn("p", pick).select(*KEYS, F.col("label").alias("name"), F.col("line").alias("lineno"), "p.framework", F.lit("decorator").alias("pattern_type"), "p.confidence", (F.col("step") + 1).alias("step"), "ord", F.lit(0).alias("sub"))


def _classes(d: DataFrame, table, decorators) -> DataFrame:
    tagged = F.array_distinct(F.transform(F.filter("decorators", lambda x: x["key"].isin(list(decorators)) & (x["step"] == 1)), lambda x: x["ord"]))
    one = F.transform(F.filter("bases", lambda b: b["base"].isin(list(table)) & ~F.array_contains(tagged, b["ord"])), lambda b: F.struct(b.alias("b"), _look("origins", b["base"]).alias("module")))
    rows = d.select(*KEYS, F.explode(one).alias("x")).select(*KEYS, "x.b.*", "x.module")
    first = Window.partitionBy("project", "path", "ord").orderBy("nth")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1 and label is not null")
    known = framework_of("module")
    default = F.coalesce(*[F.when(F.col("base") == k, v) for k, v in table.items()])
    sure = F.when(known.isNotNull(), 0.95).when(F.col("module").isNull(), 0.6).otherwise(0.7)
    return rows.select(*KEYS, F.col("label").alias("name"), F.col("line").alias("lineno"), F.coalesce(known, default).alias("framework"), F.lit("class_attribute").alias("pattern_type"), sure.alias("confidence"), F.lit(2).alias("step"), "ord", F.lit(0).alias("sub"))


_FACTORY = "call string, rules array<struct<needs: string, prefixes: array<string>, shape: string, fn_key: string, list_key: string, name_key: string, label: string>>"


def _factories(d: DataFrame, table) -> DataFrame:
    by_call: dict[str, list] = {}
    for call, *rule in table:
        by_call.setdefault(call, []).append(tuple(rule))
    rules = R.table(d.sparkSession, by_call.items(), _FACTORY)
    one = F.transform("factories", lambda x: F.struct(x.alias("f"), _look("origins", x["receiver"]).alias("of_receiver"), _look("origins", x["called"]).alias("of_called")))
    rows = d.select(*KEYS, "functions", "origins", F.explode(one).alias("x")).select(*KEYS, "functions", "origins", "x.f.*", "x.of_receiver", "x.of_called")
    rows = rows.join(F.broadcast(rules), F.col("called") == F.col("call"))  # a fixed table of a few rows
    module = F.coalesce("of_receiver", "of_called")
    right = lambda r: F.when(r["needs"].isNotNull(), F.col("receiver") == r["needs"]).otherwise(F.col("receiver").isNull() | _within(F.coalesce("of_receiver", F.lit("")), r["prefixes"]))
    fits = lambda r: F.coalesce(right(r) & ((F.size(r["prefixes"]) == 0) | _within(module, r["prefixes"])), F.lit(False))
    # the first rule that fits is found in place: a shuffle of calls would carry the imports and functions of their file with each
    rows = rows.withColumn("rule", F.get(F.filter("rules", fits), F.lit(0))).filter("rule is not null").select(*rows.columns, "rule.*")
    keyword = lambda key: F.try_element_at(F.filter("keywords", lambda k: k["key"] == F.col(key)), F.lit(1))
    ref = F.coalesce(F.get(keyword("fn_key")["refs"], F.lit(0)), F.get("first", F.lit(0)))
    label = F.try_element_at(F.filter("keywords", lambda k: (k["key"] == F.col("name_key")) & k["text"].isNotNull()), F.lit(1))["text"]
    single = F.array(F.struct(F.coalesce(F.nullif(label, F.lit("")), ref).alias("name"), ref.alias("ref")))
    listed = F.transform(F.coalesce(keyword("list_key")["refs"], F.array().cast("array<string>")), lambda r: F.struct(r.alias("name"), r.alias("ref")))
    rows = rows.withColumn("made", F.when(F.col("shape") == "single", single).otherwise(listed)).select("*", F.posexplode("made").alias("sub", "m")).filter("m.name is not null")
    line = F.coalesce(F.try_element_at(F.filter("functions", lambda f: f["name"] == F.col("m.ref")), F.lit(1))["line"], F.col("line"))
    candidates = [last_of(F.col("origins"), "local", F.col("needs"), "module"), F.col("of_called"), F.col("of_receiver")]
    rows = rows.withColumn("module", F.coalesce(*candidates))
    sure = F.when(framework_of("module").isNotNull(), 0.95).when(F.col("module").isNotNull(), 0.7).otherwise(0.6)
    return rows.select(*KEYS, F.col("m.name").alias("name"), line.alias("lineno"), F.coalesce(framework_of("module"), F.col("label")).alias("framework"), F.lit("registration_call").alias("pattern_type"), sure.alias("confidence"), F.lit(1).alias("step"), "ord", "sub")


def python_entry_points(facts: DataFrame, decorators=R.DECORATORS, bases=R.BASE_CLASSES, factories=R.FACTORIES) -> DataFrame:
    """All entry points of the files: name, lineno, framework, pattern_type, confidence; one per line and name
    of a file, factories first, then definitions in order, then handlers at any depth."""
    d = _with_origins(facts)
    found = union_all([_factories(d, factories), _decorated(d, decorators), _classes(d, bases, decorators)])
    w = Window.partitionBy("project", "path", "lineno", "name").orderBy("step", "ord", "sub")
    return found.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
