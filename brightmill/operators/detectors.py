"""Capability detectors as one plan over the fact rows.

Imports are resolved inside each file's row by array functions. A detector is a list of rules over the columns of a
site (a call, an opening ``with``, or a subscript); the rules of all detectors are evaluated in one projection that makes
an array of candidate findings per site, so facts are read once and sites exploded once, however many detectors
there are. One shuffle, of the (few) findings, removes repeats. Outputs have the columns project, path, rel, detector,
capability, evidence, lineno, confidence, step, ord: the last two give the order in which a file's findings are met.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

KEYS = ["project", "path", "rel"]


def names(imports: Column) -> Column:
    """Array of (local, full): what each imported name stands for, in order."""
    return F.transform(
        imports,
        lambda i: F.struct(
            F.coalesce(i.asname, F.when(i.kind == "from", i.symbol).otherwise(i.module)).alias("local"),
            F.when(i.kind == "import", i.module).when(F.coalesce(i.module, F.lit("")) == "", i.symbol).otherwise(F.concat(i.module, F.lit("."), i.symbol)).alias("full"),
        ),
    )


def last_of(array: Column, field: str, value: Column, result: str) -> Column:
    """``result`` of the last entry whose ``field`` equals ``value``; NULL if there is none."""
    return F.try_element_at(F.filter(array, lambda x: x[field] == value), F.lit(-1))[result]


def dotted(full: Column, head: Column, tail: Column) -> Column:
    return F.when(head.isNotNull(), F.concat_ws(".", F.coalesce(full, head), tail))


def sites(facts: DataFrame) -> DataFrame:
    """Sites of strictly readable files, with ``full`` (what an imported head stands for), ``resolved`` (dotted
    callee), ``owner`` (dotted receiver) and ``client`` (constructor of a tracked HTTP client)."""
    usable = facts.filter("strict and parsed").withColumn("names", names(F.col("imports")))
    bound = F.transform("bindings", lambda b: F.struct(b["var"].alias("var"), dotted(last_of(F.col("names"), "local", b["head"], "full"), b["head"], b["tail"]).alias("made")))
    usable = usable.withColumn("clients", F.filter(bound, lambda b: b["made"].isin(R.CLIENTS)))
    one = F.transform(
        "sites",
        lambda c: F.struct(
            c.alias("c"),
            last_of(F.col("names"), "local", c["head"], "full").alias("full"),
            last_of(F.col("names"), "local", c["recv_head"], "full").alias("owner_full"),
            last_of(F.col("clients"), "var", c["recv"], "made").alias("client"),
        ),
    )
    rows = usable.select(*KEYS, F.explode(one).alias("x")).select(*KEYS, "x.c.*", "x.full", "x.owner_full", "x.client")
    return rows.withColumn("resolved", dotted(F.col("full"), F.col("head"), F.col("tail"))).withColumn("owner", dotted(F.col("owner_full"), F.col("recv_head"), F.col("recv_tail")))


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Conditions over long lists are written as SQL: one expression is parsed instead of hundreds of calls to the JVM.


def _any(tests) -> Column:
    return F.expr("(" + " OR ".join(tests) + ")")


def _starts(column: str, prefixes) -> Column:
    return _any(f"startswith({column}, {quoted(p)})" for p in prefixes)


def _ends(column: str, suffixes) -> Column:
    return _any(f"endswith({column}, {quoted(s)})" for s in suffixes)


def _first(cases) -> Column:
    """The value of the first condition that holds, of (condition, value) as SQL."""
    return F.expr("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " END")


@dataclass(frozen=True)
class Rule:
    """A site where ``when`` holds has a finding; ``step`` orders the rules of a detector."""

    when: Column
    capability: str | Column
    evidence: str | Column
    confidence: float | Column
    step: int = 1


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def shell_exec() -> list[Rule]:
    """EXECUTE: subprocess and os calls by literal receiver, bare exec and eval. Repeats are kept."""
    attr = _is("attr") & (((F.col("recv") == "subprocess") & F.col("name").isin("run", "Popen", "call")) | ((F.col("recv") == "os") & (F.col("name") == "system")))
    bare = _is("name") & F.col("name").isin("exec", "eval")
    return [Rule(attr, "EXECUTE", F.concat("recv", F.lit("."), "name", F.lit("()")), 0.95), Rule(bare, "EXECUTE", F.concat("name", F.lit("()")), 0.95)]


def network(rules=R.NETWORK_CALLS) -> list[Rule]:
    """SEND: known calls by dotted prefix and suffix, socket-like calls, imported HTTP names, calls on tracked
    clients, and literal URLs."""
    r, full = F.col("resolved"), F.col("full")
    label = _first((f"startswith(resolved, {quoted(m)}) AND endswith(resolved, {quoted(n)})", quoted(f"{m}.{n}")) for m, n in rules)
    known = _any(f"{f}(full, {quoted(f'{m}.{n}')})" for m, n in rules for f in ("endswith", "startswith"))
    http = full.contains("urllib.request") | (
        full.contains("http") & ~full.contains("urllib.parse") & ~full.contains("qdrant_client.http.models") & ~F.element_at(F.split(full, r"\."), -1).isin(R.HTTP_SETTINGS) & ~full.startswith("mcp.server")
    )
    bare = _is("name") & full.isNotNull() & (full != "")
    urls = F.filter(F.transform("strings", lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s.startswith("http://") | s.startswith("https://"))
    target = F.when(_is("attr"), F.coalesce(r, "name")).otherwise(F.coalesce(full, "name"))
    return [
        Rule(_is("attr") & label.isNotNull(), "SEND", label, 0.95),
        Rule(_is("attr") & label.isNull() & _ends("resolved", R.SOCKET_ENDS) & ~_starts("resolved", R.LOCAL_DATABASES), "SEND", r, 0.85),
        Rule(bare & (known | http), "SEND", full, F.when(known, 0.9).otherwise(0.8)),
        Rule(F.col("client").isNotNull() & F.col("name").isin(R.CLIENT_VERBS), "SEND", F.concat_ws(".", "client", "name"), 0.95, 2),
        Rule((_is("attr") | _is("name")) & F.col("name").isin(R.URL_VERBS) & (F.size(urls) > 0), "SEND", F.concat(target, F.lit(" -> "), F.get(urls, F.lit(0))), 0.9, 3),
    ]


def file_access() -> list[Rule]:
    """READ and WRITE: open by mode, path methods, loads of open files, os and shutil writers."""
    name, owner, full = F.col("name"), F.coalesce("owner", F.lit("None")), F.col("full")
    writes = F.col("mode").isin(R.WRITE_MODES)
    way, sure = F.when(writes, "WRITE").otherwise("READ"), F.when(writes, 0.95).otherwise(0.9)
    call_text = F.concat(owner, F.lit("."), name, F.lit("()"))
    return [
        Rule(_is("name") & (name == "open"), way, F.concat(F.lit("open(..., mode="), "mode_repr", F.lit(")")), sure, 1),
        Rule(_is("attr") & name.isin("read_text", "read_bytes"), "READ", call_text, 0.95, 2),
        Rule(_is("attr") & name.isin("write_text", "write_bytes"), "WRITE", call_text, 0.95, 3),
        Rule(_is("attr") & name.isin("load", "loads") & F.col("arg0_open"), "READ", F.concat(owner, F.lit("."), name, F.lit("(<open(...)>)")), 0.9, 4),
        Rule(_is("attr") & F.col("owner").startswith("shutil") & name.isin(R.SHUTIL_WRITES), "WRITE", call_text, 0.9, 5),
        Rule(_is("attr") & F.col("owner").startswith("os") & name.isin(R.OS_WRITES), "WRITE", call_text, 0.9, 6),
        Rule(_is("name") & full.startswith("os.") & _ends("full", ["." + x for x in R.OS_WRITES]), "WRITE", full, 0.9, 7),
        Rule(_is("name") & full.startswith("shutil.") & _ends("full", ["." + x for x in R.SHUTIL_WRITES]), "WRITE", full, 0.9, 8),
        Rule(_is("name") & (full.contains("pathlib") | full.contains("Path")) & (full.contains("read_text") | full.contains("read_bytes")), "READ", full, 0.9, 9),
        Rule(_is("with"), way, F.concat(F.lit("with open(..., mode="), "mode_repr", F.lit(")")), sure, 10),
    ]


def secrets(rules=R.SECRET_CALLS, methods=R.SECRET_METHODS) -> list[Rule]:
    """SECRETS (own design): environment, keyring, dotenv and vault reads; os.environ subscripts."""
    r, key = F.col("resolved"), F.col("arg0")
    sure = _first([*((f"resolved = {quoted(name)}", f"{p}D") for name, p in rules), *((f"kind = 'attr' AND name = {quoted(name)}", f"{p}D") for name, p in methods)])
    shown = F.when(key.isNotNull(), F.concat(r, F.lit("('"), key, F.lit("')"))).otherwise(F.concat(r, F.lit("()")))
    subscript = F.when(key.isNotNull(), F.concat(F.lit("os.environ['"), key, F.lit("']"))).otherwise("os.environ[...]")
    return [Rule((_is("attr") | _is("name")) & sure.isNotNull(), "SECRETS", shown, sure), Rule(_is("subscript") & (r == "os.environ"), "SECRETS", subscript, 0.9)]


def dynamic_exec() -> list[Rule]:
    """DYNAMIC: evaluation and import by name; an import of a literal name does not count."""
    name, full = F.col("name"), F.col("full")
    listed = name.isin(R.DYNAMIC_NAMES) | F.coalesce(_ends("full", ["." + x for x in R.DYNAMIC_NAMES]), F.lit(False))
    bare = _is("name") & listed & ~((name == "__import__") & F.col("arg0_str"))
    return [
        Rule(bare, "DYNAMIC", F.coalesce(F.nullif(full, F.lit("")), name), F.when(name.isin("eval", "exec"), 0.95).otherwise(0.9)),
        Rule(_is("attr") & F.col("resolved").isin(R.DYNAMIC_CALLS), "DYNAMIC", F.col("resolved"), 0.9),
    ]


def autonomy() -> list[Rule]:
    """AUTONOMY: background runners and schedulers, one finding per pattern and file."""
    last, r = F.lower(F.coalesce("recv_last", F.lit(""))), F.col("resolved")
    harmless = (F.col("name") == "start") & (last.contains("match") | last.contains("span") | last.contains("trace") | last.endswith("_res"))
    known = r.isin(R.AUTONOMY_CALLS)
    return [
        Rule(_is("attr") & known, "AUTONOMY", r, 0.85),
        Rule(_is("name") & F.col("full").isin(R.AUTONOMY_CALLS), "AUTONOMY", F.col("full"), 0.85),
        Rule(_is("attr") & r.isNotNull() & ~known & F.col("name").isin(R.AUTONOMY_METHODS) & ~harmless, "AUTONOMY", F.concat(r, F.lit("()")), 0.8),
    ]


#: Rules of each detector, and what tells its findings in a file apart: the first of each key stays.
BUILT_IN: dict[str, tuple[Callable[[], list[Rule]], tuple[str, ...]]] = {
    "shell_exec": (shell_exec, ("ord",)), "network": (network, ("evidence", "lineno")), "file_access": (file_access, ("capability", "evidence", "lineno")),
    "secrets": (secrets, ("evidence", "lineno")), "dynamic_exec": (dynamic_exec, ("evidence", "lineno")), "autonomy": (autonomy, ("evidence",)),
}
#: Detectors whose findings come in the order of the tree; others go rule by rule.
_ONE_WALK = {"file_access"}


def detect(facts: DataFrame, *names_: str, detectors=None) -> DataFrame:
    """Findings of all detectors, or of those named."""
    table = detectors or BUILT_IN
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    found = []
    for name in names_ or table:
        rules, key = table[name]
        for rule in rules():
            order = (F.lit(1), F.col("ord") * 16 + rule.step) if name in _ONE_WALK else (F.lit(rule.step), F.col("ord"))
            values = {"capability": as_col(rule.capability), "evidence": as_col(rule.evidence), "lineno": F.col("line"), "confidence": as_col(rule.confidence).cast("double"), "step": order[0], "ord": order[1]}
            parts = F.struct(*[(values[k] if k in key else F.lit(None)).cast("string").alias(k) for k in ("capability", "evidence", "lineno", "ord")])
            found.append(F.when(rule.when, F.struct(F.lit(name).alias("detector"), *[v.alias(k) for k, v in values.items()], parts.alias("key"))))
    rows = sites(facts).select(*KEYS, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*KEYS, "x.*")
    first = Window.partitionBy("project", "path", "detector", "key").orderBy("step", "ord")
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth", "key")
