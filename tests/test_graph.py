"""Call graph, imports and reachability on small projects."""

from pyspark.sql import functions as F

from brightmill.operators import call_graph, reachability
from brightmill.plans import corpus
from brightmill.plans.queries import QUERIES
from brightmill.plans.scan import Scan
from helpers import files

CODE = {
    "alias": {"u.py": "def h(): pass", "a.py": "from u import h as g\ndef f(): g()"},
    "plain": {"u.py": "def h(): pass", "a.py": "from u import h\ndef f(): h()"},
    "module": {"u.py": "def h(): pass\nclass C:\n    def m(self): self.n()\n    def n(self): pass", "a.py": "import u\ndef f():\n    u.h()\n    u.C()"},
    "relative": {"p/__init__.py": "", "p/u.py": "def h(): pass", "p/q/__init__.py": "", "p/q/a.py": "from ..u import h\nfrom . import b\ndef f():\n    h(); b.k()", "p/q/b.py": "def k(): pass"},
    "reexport": {"p/__init__.py": "from .impl import h", "p/impl.py": "def h(): pass", "a.py": "from p import h\ndef f(): h()"},
    "star": {"u.py": "def h(): pass", "a.py": "from u import *\ndef f(): h()"},
    "inside": {"u.py": "def h(): pass", "a.py": "def f():\n    from u import h\n    h()"},
    "far": {"src/lib/__init__.py": "", "src/lib/u.py": "def h(): pass", "a.py": "from lib.u import h\ndef f(): h()"},
    "own": {"u.py": "def h(): pass", "a.py": "from u import h\ndef h(): pass\ndef f(): h()"},
    "broken": {"u.py": "def h(:", "a.py": "from u import h\ndef f(): h()"},
}
EDGES = {
    ("plain", "a.py", "f", "u.py", "h"), ("module", "a.py", "f", "u.py", "h"), ("module", "u.py", "C.m", "u.py", "C.n"), ("relative", "p/q/a.py", "f", "p/u.py", "h"), ("relative", "p/q/a.py", "f", "p/q/b.py", "k"),
    ("reexport", "a.py", "f", "p/impl.py", "h"), ("far", "a.py", "f", "src/lib/u.py", "h"), ("own", "a.py", "f", "a.py", "h"),
}


def test_edges(spark):
    scan = Scan(files(spark, CODE))
    got = {(r.project, r.src_rel, r.src, r.dst_rel, r.dst) for r in call_graph.edges(scan.facts, scan.every).collect()}
    assert got == EDGES


def test_states_paths_and_ties(spark):
    chain = "\n".join(f"def f{i}():\n    f{i + 1}()\n    eval('x')" for i in range(11))
    projects = {
        "chain": f"@tool\ndef start(): f0()\n{chain}\neval('m')",
        "ties": "@tool('z')\ndef a(): x()\n@tool('a')\ndef b(): x()\ndef x(): eval('1')\ndef lost(): eval('1')",
        "nothing": "def f(): eval('1')\neval('2')",
        "tool_class": "class T(BaseTool):\n    name = 't'\n    def helper(self): eval('1')\n    def _run(self): self.helper()",
        "stopped": "class T(BaseTool):\n    name = 't'\n    x = 1\ndef plain(): eval('1')\nclass U:\n    def _run(self): plain()",
        "cycle": "@tool\ndef a():\n    b(); eval('1')\ndef b(): a()",
    }
    rows = Scan(files(spark, projects)).tagged.filter("detector = 'shell_exec'").collect()
    by = {(r.project, r.lineno): r for r in rows}
    assert [by["chain", 5 + 3 * i].reachability for i in range(11)] == ["reachable"] * 8 + ["unreachable"] * 3
    assert by["chain", 14].reachability_path == ["start", "f0", "f1", "f2", "f3"] and not by["chain", 14].reachability_path_truncated
    assert by["chain", 17].reachability_path_truncated and by["chain", 36].reachability == "module_level"
    assert by["ties", 5].entry_point_name == "a" and by["ties", 6].reachability == "unreachable"
    assert {by["nothing", n].reachability for n in (1, 2)} == {"no_entry_points"}
    assert by["tool_class", 3].reachability_path == ["T._run", "T.helper"]
    assert by["stopped", 4].reachability == "unreachable"
    assert by["cycle", 3].reachability_path == ["a"]


def test_innermost_span_and_lines_without_number(spark):
    spans = spark.createDataFrame([("p", "a", 0, None, "<module>"), ("p", "a", 10, 20, "outer"), ("p", "a", 12, 13, "inner")], "project string, rel string, line int, stop int, qual string")
    rows = spark.createDataFrame([("p", "a", n) for n in (5, 10, 13, 14, 21, None)] + [("p", "b", 1)], "project string, rel string, lineno int")
    got = {(r.rel, r.lineno): r.qual for r in reachability.enclosing(rows, spans).collect()}
    assert got == {("a", 5): "<module>", ("a", 10): "outer", ("a", 13): "inner", ("a", 14): "outer", ("a", 21): "<module>", ("a", None): None, ("b", 1): None}


def test_warnings(spark):
    chain = "@tool\ndef f0(): f1()\n" + "\n".join(f"def f{i}(): f{i + 1}(); eval('1')" for i in range(1, 12))
    scan = Scan(files(spark, {"deep": chain, "flat": "@tool\ndef f(): g()\ndef g(): f()"}))
    reach = reachability.closure(reachability.starts(reachability.numbered(scan.python_entry_points), scan.spans), scan.edges)
    found = scan.raw_findings.select("project", "rel").union(spark.createDataFrame([("flat", "gone.py")], "project string, rel string"))
    got = {(r.project, r.warning, r.n) for r in reachability.warnings(reach, scan.edges, found, scan.spans).collect()}
    assert got == {("deep", "depth", 1), ("flat", "no_facts", 1)}


def test_reach_over_all_orders_like_breadth_first_search(spark, data):
    customer = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_acctbal").collect()
    out = {}
    for o in spark.read.parquet(f"{data}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        out.setdefault(o.o_custkey, set()).add((o.o_orderkey * 31 + 7) % len(customer))
    best = {}
    for start in (c.c_custkey for c in customer if c.c_acctbal > 9800):
        seen, now = {start}, {start}
        for hops in range(9):
            for node in now:
                best[node] = min(best.get(node, (9, "")), (hops, f"ep{start}"))
            now = {d for node in now for d in out.get(node, ())} - seen
            seen |= now
    got = {r.node: (r.hops, r.entry_point) for r in QUERIES["bounded_reach"](spark, data).collect()}
    assert got == {f"c{node}": b for node, b in best.items()} and len(got) > 100


def test_files_of_a_small_table_are_parsed_by_many_tasks(spark):
    rows = spark.range(100).coalesce(1)
    made = corpus.project_files(rows, "id", F.col("id") % 2, [{"a.py": ""}, {"a.py": "", "b.py": ""}])
    assert made.select(F.spark_partition_id().alias("n")).distinct().count() > 1 and made.count() == 150


def test_stored_tables_are_not_broadcast_by_their_bytes(spark):
    """A million equal names are a file of a few kB, and a broadcast of them fails."""
    scan = Scan(files(spark, CODE))
    reach = scan.reach
    for df in (call_graph.edges(scan.facts, scan.every), reachability.warnings(reach, scan.edges, scan.raw_findings, scan.spans), scan.tagged):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_do_not_meet_all_functions_of_their_file(spark):
    spans = spark.range(1, 20001).selectExpr("'p' project", "'a' rel", "cast(3 * id as int) line", "cast(3 * id + 1 as int) stop", "'f' || id qual")
    rows = spark.range(1, 60001).selectExpr("'p' project", "'a' rel", "cast(id as int) lineno")
    out = reachability.enclosing(rows, spans)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("qual is not null").count() == 39999 and out.filter("qual = 'f' || cast(floor(lineno / 3) as int)").count() == 39999


def test_classes_of_a_file_do_not_meet_all_its_functions(spark):
    """The run method after a class is found in one sweep: the only join is by line."""
    code = "".join(f"class T{n}(BaseTool):\n    name = 't{n}'\n" + ("    def help(self): pass\n    def _run(self): pass\n" if n % 3 == 0 else "") for n in range(30)) + "def f(): pass\nclass T(BaseTool):\n    name = 't'\n"
    scan = Scan(files(spark, {"p": code, "q": "class T(BaseTool):\n    name = 't'\n"}))
    begin = reachability.starts(scan.numbered_entry_points, scan.spans)
    assert sorted((r.project, r.ep, r.qual) for r in begin.collect()) == sorted(("p", f"t{n}", f"T{-(-n // 3) * 3}._run") for n in range(28))
    assert begin._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # one by line, for both parts of the union
