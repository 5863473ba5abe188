"""TypeScript and JavaScript entry points, from lines of text.

A file's lines are one array; a line that may start a registration is picked inside the row, together with the
lines around it that its pattern may look at. There is no shuffle before the final removal of repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["project", "path", "rel"]
_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_QUOTED = "[\"']([^\"']+)[\"']"
_WORD = "[\\w]+"
_GAP = "\\s*"
_NAME = f"name{_GAP}:{_GAP}{_QUOTED}"
_DYNAMIC = f"new\\s+Dynamic(?:Structured|)Tool{_GAP}\\("
AHEAD, AROUND, NEAR = 12, 8, 10


def _method(name: str, owner: bool = True) -> str:
    return (f"{_WORD}{_GAP}\\.{_GAP}" if owner else "\\.") + f"{name}{_GAP}\\("


def lines(text: Column) -> Column:
    """Lines of a text as an array, without an empty last one."""
    parts = F.split(text, _BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _found(line, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, "(?U)" + pattern, group), F.lit(""))


def _first(array: Column, pattern: str) -> Column:
    hits = F.filter(F.transform(array, lambda x: _found(x, pattern)), lambda x: x.isNotNull())
    return F.get(hits, F.lit(0))


def ts_entry_points(files: DataFrame) -> DataFrame:
    """Entry points of files(project, path, rel, text): name, lineno, pattern_type, confidence."""
    rows = files.select(*KEYS, lines(F.col("text")).alias("lines"))
    may = "(?U)\\.\\s*(?:tool|registerTool|addTool)\\s*\\(|\\.setRequestHandler\\s*\\(|^\\s*name\\s*:|Dynamic"
    hits = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("line"), (i + 1).alias("lineno"))), lambda x: x["line"].rlike(may))
    picked = F.transform(
        hits,
        lambda x: F.struct(
            x["line"].alias("line"),
            x["lineno"].alias("lineno"),
            F.get("lines", x["lineno"]).alias("next"),
            F.slice("lines", x["lineno"], AHEAD).alias("ahead"),
            F.array_join(F.slice("lines", F.greatest(F.lit(1), x["lineno"] - AROUND), x["lineno"] + AROUND + 1 - F.greatest(F.lit(1), x["lineno"] - AROUND)), "\n").alias("around"),
        ),
    )
    rows = rows.select(*KEYS, F.explode(picked).alias("x")).select(*KEYS, "x.*")
    line, following = F.col("line"), F.coalesce("next", F.lit(""))

    def either(method: str, nth: int, kind: str, sure: float, owner=True, value=_QUOTED, end=""):
        here = _found(line, _method(method, owner) + _GAP + value + end)
        below = F.when(line.rlike("(?U)" + _method(method, owner)), _found(following, "^" + _GAP + value + end))
        return nth, F.coalesce(here, below), kind, sure

    quoted_name = "\\b" + _NAME
    inline = _found(line, _DYNAMIC + "[^)]*?" + _NAME)
    definition = F.when(F.col("around").rlike("(?U)\\bdescription\\s*:") & F.col("around").rlike("(?U)\\binputSchema\\s*:"), _found(line, "^" + _GAP + _NAME))
    patterns = [
        either("tool", 1, "mcp_tool", 0.95),
        either("registerTool", 2, "mcp_tool", 0.95),
        (3, F.when(line.rlike("(?U)" + _method("addTool")), _first(F.slice("ahead", 1, NEAR), quoted_name)), "mcp_tool", 0.9),
        either("setRequestHandler", 4, "mcp_handler", 0.8, owner=False, value=f"({_WORD})", end=_GAP + ","),
        (5, definition, "mcp_tool_definition", 0.85),
        (6, F.coalesce(inline, F.when(line.rlike("(?U)" + _DYNAMIC), F.coalesce(_first(F.col("ahead"), quoted_name), F.lit("unknown")))), "langchain_tool", 0.85),
    ]
    # an added tool called "unknown" counts as unnamed, like one without a name
    every = F.array(*[F.struct(F.lit(n).alias("step"), (F.nullif(name, F.lit("unknown")) if n == 3 else name).alias("name"), F.lit(kind).alias("pattern_type"), F.lit(sure).alias("confidence")) for n, name, kind, sure in patterns])
    found = rows.select(*KEYS, "lineno", F.explode(F.filter(every, lambda e: e["name"].isNotNull())).alias("e")).select(*KEYS, "lineno", "e.*")
    w = Window.partitionBy("project", "path", "lineno", "name").orderBy("step")
    return found.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
