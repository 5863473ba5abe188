"""Source files written from table rows: the driver's tables hold no code, so queries make theirs from them.

A template has header lines and one statement per event type (``{id}`` stands for the event's id); one file is
written per user, with a statement per event in order. Statements may have several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("click", "view", "purchase", "error", "signup")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines_of(rows: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """One row per key with ``text``: the lines of its rows in order, one below the other. Partitions are not merged by
    their few bytes, as what follows (parsing) costs time by the line."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    in_order = F.array_sort(F.collect_list(F.struct(order, line)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(in_order, lambda x: x[line]), "\n").alias("text"))


def statement(template: dict[str, str]) -> Column:
    """The statement of an event."""
    return F.coalesce(*[F.when(F.col("event_type") == t, F.replace(F.lit(s), F.lit("{id}"), F.col("event_id").cast("string"))) for t, s in template.items()])


def event_files(events: DataFrame, header: list[str], template: dict[str, str] | Column, suffix: str = "py", project: Column | None = None) -> DataFrame:
    """files(project, path, rel, content): ``app/u<user>.<suffix>`` in one of seven projects, or in ``project``."""
    made = template if isinstance(template, Column) else statement(template)
    group = project if project is not None else F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"))
    rows = events.select(group.alias("project"), "user_id", "event_id", made.alias("line"))
    files = lines_of(rows, ["project", "user_id"], "event_id", "line")
    path = F.concat(F.lit("app/u"), F.col("user_id").cast("string"), F.lit("." + suffix))
    text = F.concat(F.lit("".join(h + "\n" for h in header)), F.col("text"), F.lit("\n"))
    return files.select("project", path.alias("path"), path.alias("rel"), text.cast("binary").alias("content"))


#: Chains of functions: every sign-up opens the next function of its file (an entry point if its value is
#: high), a view inside it calls the one after, clicks read files and errors run commands.
CHAIN_HEADER = ["import subprocess", "from langchain_core.tools import tool", "if True:", "    pass"]
ENTRY_VALUE = 60


def chain_files(events: DataFrame) -> DataFrame:
    """files of one project per user."""
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum((F.col("event_type") == "signup").cast("int")).over(so_far).cast("string")
    head = F.concat(F.when(F.col("value") > ENTRY_VALUE, "@tool\n").otherwise(""), F.lit("def f"), F.col("nth"), F.lit("():\n    pass"))
    call = F.concat(F.lit("    f"), (F.col("nth").cast("int") + 1).cast("string"), F.lit("()"))
    made = F.when(F.col("event_type") == "signup", head).when(F.col("event_type") == "view", call).when(F.col("event_type") == "click", "    open('a')").when(F.col("event_type") == "error", "    subprocess.run(['a'])").otherwise("    pass")
    return event_files(events.withColumn("nth", nth), CHAIN_HEADER, made, project=F.concat(F.lit("p"), F.col("user_id").cast("string")))


def order_edges(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Calls between customers: an order of one calls another, with both places. One row per order."""
    n = customer.agg(F.count(F.lit(1)).alias("n"))
    at = customer.select("c_custkey", "c_nationkey")
    pairs = orders.crossJoin(n).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + 7) % F.col("n")).alias("dst"), "o_orderstatus", "o_orderpriority")
    return pairs.join(at.toDF("src", "src_nation"), "src").join(at.toDF("dst", "dst_nation"), "dst")


def nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per region, a file per nation, a function per customer. Orders in progress call a function by
    its imported name, finished ones through its module, open ones something that does not exist."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    customer = read(spark, sf_dir, "customer")
    calls = order_edges(read(spark, sf_dir, "orders"), customer)
    regions = nation.withColumnRenamed("region", "dst_region").withColumnRenamed("nation", "dst_nation")
    calls = calls.join(regions, "dst_nation").join(nation.toDF("src_nation", "src_region"), "src_nation")
    near = F.col("src_region") == F.col("dst_region")
    dst = F.concat(F.lit("c"), F.col("dst").cast("string"), F.lit("()"))
    text = F.when(F.col("o_orderstatus") == "P", dst).when(F.col("o_orderstatus") == "F", F.concat(F.lit("n"), F.col("dst_nation").cast("string"), F.lit("."), dst)).otherwise("ghost()")
    body = calls.select("src", text.alias("call")).distinct().groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("    "), "call"))), "\n").alias("body"))
    functions = customer.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("nation")).join(body, "src", "left")
    functions = functions.withColumn("line", F.concat(F.lit("def c"), F.col("src").cast("string"), F.lit("():\n"), F.coalesce("body", F.lit("    pass"))))
    code = lines_of(functions, ["nation"], "src", "line")
    wanted = calls.filter((F.col("o_orderstatus") == "P") & near & (F.col("src_nation") != F.col("dst_nation")))
    line = F.concat(F.lit("from .n"), F.col("dst_nation").cast("string"), F.lit(" import c"), F.col("dst").cast("string"))
    named = wanted.select(F.col("src_nation").alias("nation"), line.alias("line")).distinct().groupBy("nation").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("named"))
    everyone = nation.join(nation.toDF("other", "region"), "region").groupBy("nation", "region").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("import n"), F.col("other").cast("string")))), "\n").alias("modules"))
    files = everyone.join(code, "nation").join(named, "nation", "left")
    path = F.concat(F.lit("n"), F.col("nation").cast("string"), F.lit(".py"))
    content = F.concat_ws("\n", "modules", "named", "text")
    return files.select(F.concat(F.lit("r"), F.col("region").cast("string")).alias("project"), path.alias("path"), path.alias("rel"), content.cast("binary").alias("content"))


def project_files(rows: DataFrame, key: str, case: Column, trees: list[dict[str, str]]) -> DataFrame:
    """One project ``p<key>`` per row, with the files of the tree of its case (``{k}`` stands for the key). Rows are spread
    before they become files: a small table is one partition, and parsing its files would be one task."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    name = F.col(key).cast("string")
    tree = lambda t: F.array(*[F.struct(F.lit(path).alias("path"), F.replace(F.lit(text), F.lit("{k}"), name).alias("text")) for path, text in t.items()])
    chosen = F.coalesce(*[F.when(case == n, tree(t)) for n, t in enumerate(trees)])
    files = rows.select(F.concat(F.lit("p"), name).alias("project"), F.explode(chosen).alias("f"))
    return files.select("project", F.col("f.path").alias("path"), F.col("f.path").alias("rel"), F.col("f.text").cast("binary").alias("content"))
