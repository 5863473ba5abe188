"""Registered queries over the code-fact engine and their SQL counterparts.

The queries write source files from table rows (``corpus``), and run them through the engine. Their SQL never
sees the text: it works out from the columns what must be found, so the two can disagree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.parser import parse
from ..operators import call_graph, detectors, entry_points, findings, reachability, ts_entry_points
from ..session import sized, stored
from ..sources import files as sources
from . import corpus
from .corpus import read
from .scan import Scan
from .scan import project_reports as scan_reports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _events_cte(header: int, sizes: dict[str, int] | None = None) -> str:
    """Events with their project, file, and the line of their statement's first line."""
    size = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in (sizes or {}).items()) + " ELSE 1 END" if sizes else "1"
    return f"""e AS (SELECT *, 'p' || (user_id % 7) AS project, 'app/u' || user_id || '.py' AS file,
  CAST({header} + 1 + coalesce(sum({size}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS lineno
  FROM events)"""


# ---- capability detectors ----------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str, detector: str, header: list[str], template: dict[str, str]) -> DataFrame:
    facts = parse(corpus.event_files(read(spark, sf_dir, "events"), header, template))
    found = findings.with_ids(findings.enrich(detectors.detect(facts, detector)))
    return found.select("project", F.col("rel").alias("file"), "lineno", "capability", "evidence", "confidence", "risk_level", "finding_id")


def _found_sql(detector: str, header: int, rows: list[tuple[str, str, str, float]], extra: str = "") -> str:
    """SQL of findings from (event type, capability, evidence, confidence) rows."""
    rules = ", ".join("('{}', '{}', '{}', {})".format(t, c, v.replace("'", "''"), s) for t, c, v, s in rows)
    risk = "CASE capability " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in (("EXECUTE", "high"), ("SEND", "high"), ("WRITE", "high"), ("SECRETS", "high"), ("DYNAMIC", "high"))) + " ELSE 'medium' END"
    return f"""WITH {_events_cte(header)},
t(event_type, capability, evidence, sure) AS (VALUES {rules}),
f AS (SELECT project, file, lineno, capability, evidence, sure FROM e JOIN t USING (event_type) {extra})
SELECT project, file, lineno, capability, evidence, CAST(sure AS DOUBLE) AS confidence, {risk} AS risk_level,
  substr(sha1('{detector}:' || file || ':' || lineno || ':' || evidence), 1, 12) AS finding_id FROM f"""


@query(_found_sql("shell_exec", 2, [("click", "EXECUTE", "subprocess.run()", 0.95), ("purchase", "EXECUTE", "os.system()", 0.95), ("error", "EXECUTE", "eval()", 0.95), ("view", "EXECUTE", "subprocess.Popen()", 0.95), ("view", "EXECUTE", "subprocess.call()", 0.95)]))
def shell_exec_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "subprocess.run(['ls'])", "purchase": "os.system('x')", "error": "eval('1')", "signup": "subprocess.check_output(['ls'])", "view": "subprocess.Popen(['ls']); subprocess.call(['ls'])"}
    return _found(spark, sf_dir, "shell_exec", ["import subprocess", "import os"], template)


@query(
    _found_sql(
        "network",
        3,
        [
            ("click", "SEND", "requests.get", 0.95), ("view", "SEND", "requests.Session.post", 0.95), ("view", "SEND", "s.post -> http://h/a", 0.9), ("purchase", "SEND", "urllib.request.urlopen", 0.9),
            ("purchase", "SEND", "urllib.request.urlopen -> https://h/b", 0.9), ("error", "SEND", "db.connect", 0.85),
        ],
        "UNION ALL SELECT DISTINCT project, file, 3, 'SEND', 'requests.Session', 0.95 FROM e",
    )
)
def network_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "requests.get(u); requests.get(u)", "view": "s.post('http://h/a')", "purchase": "urlopen('https://h/b')", "error": "db.connect(1)", "signup": "sqlite3.connect(1)"}
    return _found(spark, sf_dir, "network", ["import requests", "from urllib.request import urlopen", "s = requests.Session()"], template)


@query(
    _found_sql(
        "file_access",
        2,
        [
            ("click", "READ", "open(..., mode='')", 0.9), ("view", "WRITE", "open(..., mode='w')", 0.95), ("view", "WRITE", "with open(..., mode='w')", 0.95), ("purchase", "WRITE", "pathlib.Path.write_text()", 0.95),
            ("error", "WRITE", "shutil.move()", 0.9), ("error", "WRITE", "os.remove()", 0.9), ("signup", "READ", "json.load(<open(...)>)", 0.9), ("signup", "READ", "open(..., mode='r+')", 0.9),
        ],
    )
)
def file_access_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "open('a')", "view": "with open('a', 'w') as f: f.write('x')", "purchase": "Path('a').write_text('x')", "error": "shutil.move('a', 'b'); os.remove('a')", "signup": "json.load(open('a', 'r+'))"}
    return _found(spark, sf_dir, "file_access", ["import shutil, os, json", "from pathlib import Path"], template)


@query(_found_sql("secrets", 1, [("click", "SECRETS", "os.getenv('K')", 0.9), ("view", "SECRETS", "os.environ['T']", 0.9), ("purchase", "SECRETS", "keyring.get_password('a')", 0.95), ("error", "SECRETS", "os.environ.get()", 0.9)]))
def secrets_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "os.getenv('K')", "view": "os.environ['T']", "purchase": "keyring.get_password('a', 'b')", "error": "os.environ.get(k)", "signup": "os.getcwd()"}
    return _found(spark, sf_dir, "secrets", ["import os, keyring"], template)


@query(_found_sql("dynamic_exec", 2, [("click", "DYNAMIC", "eval", 0.95), ("view", "DYNAMIC", "importlib.import_module", 0.9), ("purchase", "DYNAMIC", "re.compile", 0.9), ("signup", "DYNAMIC", "exec", 0.95)]))
def dynamic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "eval('1')", "view": "importlib.import_module(m)", "purchase": "compile(p)", "error": "__import__('os')", "signup": "exec('x'); exec('y')"}
    return _found(spark, sf_dir, "dynamic_exec", ["import importlib", "from re import compile"], template)


@query(
    _found_sql("autonomy", 1, [("click", "AUTONOMY", "threading.Thread", 0.85), ("click", "AUTONOMY", "start()", 0.8), ("view", "AUTONOMY", "asyncio.create_task", 0.85), ("error", "AUTONOMY", "job.start()", 0.8), ("signup", "AUTONOMY", "s.add_job()", 0.8)])
    .replace("JOIN t USING (event_type) )", "JOIN t USING (event_type) QUALIFY row_number() OVER (PARTITION BY project, file, evidence ORDER BY lineno) = 1)")
)
def autonomy_first_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "threading.Thread(target=f).start()", "view": "asyncio.create_task(g())", "purchase": "span.start()", "error": "job.start()", "signup": "s.add_job(f)"}
    return _found(spark, sf_dir, "autonomy", ["import threading, asyncio"], template)


@query(_found_sql("network", 4, [("click", "SEND", "http.client.HTTPConnection", 0.8), ("error", "SEND", "requests.post", 0.9)]))
def network_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names imported from HTTP-like modules, and the settings and parsers among them that send nothing."""
    template = {"click": "HTTPConnection('h')", "view": "urlparse('h')", "purchase": "Timeout(5)", "error": "post(u)", "signup": "Filter()"}
    return _found(spark, sf_dir, "network", ["from http.client import HTTPConnection", "from urllib.parse import urlparse; from httpx import Timeout", "from requests import post", "from qdrant_client.http.models import Filter"], template)


@query(_found_sql("file_access", 2, [("click", "WRITE", "os.remove", 0.9), ("view", "WRITE", "shutil.move", 0.9), ("purchase", "READ", "None.read_text()", 0.95), ("error", "WRITE", "g.write_bytes()", 0.95)]))
def file_access_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare imported functions, and methods of receivers without a name."""
    template = {"click": "remove('a')", "view": "move('a', 'b')", "purchase": "x[0].read_text()", "error": "f().g().write_bytes(b)", "signup": "rmtree('a')"}
    return _found(spark, sf_dir, "file_access", ["from os import remove", "from shutil import move, rmtree"], template)


# ---- capabilities, risks, languages, ids ---------------------------------------------------------------------

_RISK_HEADER = ["import os, subprocess, requests"]
_CAPS_CTE = """c AS (SELECT 'p' || user_id AS project,
  bool_or(event_type = 'click' AND value > 150) AS send, bool_or(event_type = 'purchase' AND value > 100) AS destroy,
  bool_or(event_type = 'error' AND value > 100) AS run, bool_or(event_type = 'view' AND value > 100) AS look, bool_or(event_type = 'signup' AND value > 120) AS make FROM events GROUP BY user_id)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one project per user, whose capabilities depend on what the user's high values are."""
    high = lambda t, n: (F.col("event_type") == t) & (F.col("value") > n)
    made = F.when(high("click", 150), "requests.get(u)").when(high("purchase", 100), "os.remove('a')").when(high("error", 100), "subprocess.run(['a'])").when(high("view", 100), "open('a')").when(high("signup", 120), "open('a', 'w')").otherwise("x = 1")
    files = corpus.event_files(read(spark, sf_dir, "events"), _RISK_HEADER, made, project=F.concat(F.lit("p"), F.col("user_id").cast("string")))
    return Scan(files).raw_findings


@query(f"""WITH {_CAPS_CTE}
SELECT project, concat_ws(',', CASE WHEN run THEN 'EXECUTE' END, CASE WHEN look THEN 'READ' END, CASE WHEN send THEN 'SEND' END, CASE WHEN destroy OR make THEN 'WRITE' END) AS capabilities
FROM c WHERE run OR look OR send OR destroy OR make""")
def capabilities_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.capabilities(_mixed(spark, sf_dir)).withColumn("capabilities", F.array_join("capabilities", ","))


_RISK_VALUES = ", ".join("('{}', '{}', '{}')".format(i, t.replace("'", "''"), w.replace("'", "''")) for i, t, w, _, _ in R.RISKS)


@query(f"""WITH {_CAPS_CTE}, r AS (
SELECT project, 'data_exfiltration' AS id, 'high' AS severity, 'SEND,WRITE' AS triggered FROM c WHERE send AND (destroy OR make)
UNION ALL SELECT project, 'remote_control', 'high', 'EXECUTE,SEND' FROM c WHERE run AND send
UNION ALL SELECT project, 'secret_leak', 'high', 'READ,SEND' FROM c WHERE look AND send
UNION ALL SELECT project, 'destructive_agent', 'high', 'EXECUTE,WRITE' FROM c WHERE run AND destroy)
SELECT project, id, severity, triggered, title, why FROM r JOIN (VALUES {_RISK_VALUES}) AS t(id, title, why) USING (id)""")
def combined_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.risks(_mixed(spark, sf_dir)).select("project", "id", "severity", F.array_join("capabilities_triggered", ",").alias("triggered"), "title", "why")


@query("""WITH x AS (SELECT p_brand AS project, CASE p_type WHEN 'ECONOMY' THEN 'Go' WHEN 'SMALL' THEN 'Rust' WHEN 'MEDIUM' THEN 'Java' WHEN 'LARGE' THEN 'C++' WHEN 'PROMO' THEN 'Kotlin' END AS language FROM part WHERE p_size > 5)
SELECT project, language, count(*) AS count FROM x WHERE language IS NOT NULL GROUP BY ALL""")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.create_map(*[F.lit(x) for x in ("ECONOMY", "go", "SMALL", "rs", "MEDIUM", "Java", "LARGE", "cc", "PROMO", "kts", "STANDARD", "md")])
    folder = F.when(F.col("p_size") <= 5, "Vendor/").otherwise("src/")
    return findings.languages(read(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.concat(folder, F.lit("m"), F.col("p_partkey").cast("string"), F.lit("."), F.try_element_at(ends, F.col("p_type"))).alias("path")))


@query("""WITH f AS (SELECT *, 'lib/p' || l_partkey || '.py' AS file, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'call' || l_suppkey END AS evidence FROM lineitem),
r AS (SELECT *, 'network:' || file || ':' || l_linenumber || CASE WHEN evidence = '' THEN '' ELSE ':' || evidence END AS ref FROM f)
SELECT ref AS finding_ref, substr(sha1(ref), 1, 12) AS finding_id FROM r""")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        F.lit("network").alias("detector"), F.concat(F.lit("lib/p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("rel"), F.col("l_linenumber").alias("lineno"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("call"), F.col("l_suppkey").cast("string"))).alias("evidence"),
    )
    return findings.with_ids(rows).select("finding_ref", "finding_id")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' WHEN 'error' THEN 'info' WHEN 'signup' THEN 'medium' END AS risk_level,
  least(1.0, value / 100) AS confidence, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS INTEGER) END AS lineno FROM events""")
def normalized_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "click", "HIGH").when(F.col("event_type") == "view", "severe").when(F.col("event_type") == "error", "Info").when(F.col("event_type") == "signup", "medium")
    rows = read(spark, sf_dir, "events").select("event_id", level.alias("risk_level"), (F.col("value") / 100).alias("confidence"), F.when(F.col("event_type") == "view", "first").otherwise(F.col("user_id").cast("string")).alias("lineno"))
    return findings.normalized(rows).select("event_id", "risk_level", "confidence", "lineno")


@query("""SELECT p_partkey AS part, p_size % 10 IN (0, 4) AS scanned, p_size % 10 = 0 AS searched, p_size % 10 = 5 AS script FROM part""")
def file_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ["src/{}.py", "Tests/{}.py", "src/test_{}.py", "src/{}_test.py", "node_modules/{}.py", "src/{}.tsx.mjs", "src/{}.d.ts", "dist/{}.js", "src/{}.spec.ts", "src/{}.min.js"]
    path = F.coalesce(*[F.when(F.col("p_size") % 10 == n, F.replace(F.lit(s), F.lit("{}"), F.col("p_partkey").cast("string"))) for n, s in enumerate(shapes)])
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), path.alias("path"))
    return rows.select("part", sources.scanned(F.col("path")).alias("scanned"), sources.searched(F.col("path")).alias("searched"), sources.is_script(F.col("path")).alias("script"))


@query("""SELECT p_partkey AS part, p_size % 6 IN (0, 1, 2, 3) AS scanned, p_size % 6 IN (0, 3) AS packaged FROM part""")
def package_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files of a folder, and which of them count in a package of the index."""
    shapes = ["src/{}.py", "Docs/{}.py", "scripts/a/{}.py", "scripted/{}.py", "benchmark/{}.py", "src/{}.pyi"]
    path = F.coalesce(*[F.when(F.col("p_size") % 6 == n, F.replace(F.lit(s), F.lit("{}"), F.col("p_partkey").cast("string"))) for n, s in enumerate(shapes)])
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), path.alias("path"))
    return rows.select("part", sources.scanned(F.col("path")).alias("scanned"), sources.scanned(F.col("path"), tuple(R.PACKAGE_SKIPS)).alias("packaged"))


@query("""SELECT 'p' || p_partkey AS project, p_size % 3 <> 1 AS strict, p_size % 3 <> 2 AS parsed, CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS findings,
  CAST(CASE WHEN p_size % 3 = 2 THEN 0 ELSE 1 END AS BIGINT) AS entry_points FROM part""")
def text_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are valid, that have bytes which are no UTF-8 (capability detectors skip those), and that do not parse."""
    code = "@tool\ndef f(): eval('1')\n# "
    files = corpus.project_files(read(spark, sf_dir, "part"), "p_partkey", F.col("p_size") % 3, [{"a.py": code}, {"a.py": code}, {"a.py": "def f(:"}])
    odd = files.join(read(spark, sf_dir, "part").filter("p_size % 3 = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("project"), F.lit(True).alias("odd")), "project", "left")
    scan = Scan(odd.withColumn("content", F.when(F.col("odd"), F.concat("content", F.unhex(F.lit("FF")))).otherwise(F.col("content"))).drop("odd"))
    one = F.count(F.lit(1))
    found = scan.raw_findings.filter("detector = 'shell_exec'").groupBy("project").agg(one.alias("findings"))
    eps = scan.python_entry_points.groupBy("project").agg(one.alias("entry_points"))
    return scan.all_facts.select("project", "strict", "parsed").join(sized(found), "project", "left").join(sized(eps), "project", "left").fillna(0, ["findings", "entry_points"])


# ---- call graph ------------------------------------------------------------------------------------------------

_CALLS_CTE = """n AS (SELECT count(*) AS n FROM customer),
k AS (SELECT o_custkey AS src, (o_orderkey * 31 + 7) % n AS dst, o_orderstatus FROM orders, n),
c AS (SELECT k.*, a.c_nationkey AS sn, b.c_nationkey AS dn, x.n_regionkey AS sr, y.n_regionkey AS dr FROM k
  JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst JOIN nation x ON x.n_nationkey = a.c_nationkey JOIN nation y ON y.n_nationkey = b.c_nationkey)"""


@query(f"""WITH {_CALLS_CTE}
SELECT DISTINCT 'r' || sr AS project, 'n' || sn || '.py' AS src_rel, 'c' || src AS src, 'n' || dn || '.py' AS dst_rel, 'c' || dst AS dst FROM c WHERE sr = dr AND o_orderstatus IN ('P', 'F')""")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = Scan(corpus.nation_files(spark, sf_dir))
    return call_graph.edges(scan.facts, scan.every)


@query(f"""WITH {_CALLS_CTE}, m AS (SELECT DISTINCT sn, sr FROM (SELECT c_nationkey AS sn, n_regionkey AS sr FROM customer JOIN nation ON n_nationkey = c_nationkey))
SELECT 'r' || a.sr AS project, 'n' || a.sn || '.py' AS rel, 'n' || b.sn AS local, 'n' || b.sn || '.py' AS source FROM m a JOIN m b ON a.sr = b.sr
UNION ALL SELECT DISTINCT 'r' || sr, 'n' || sn || '.py', 'c' || dst, 'n' || dn || '.py' FROM c WHERE sr = dr AND sn <> dn AND o_orderstatus = 'P'""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = Scan(corpus.nation_files(spark, sf_dir))
    return call_graph.file_imports(scan.facts, scan.every)


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
k AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 31 + 7) % n AS dst FROM orders, n),
s AS (SELECT c_custkey AS node, 'ep' || c_custkey AS ep, 0 AS hops FROM customer WHERE c_acctbal > 9800),
r(node, ep, hops) AS (SELECT * FROM s UNION SELECT dst, ep, hops + 1 FROM r JOIN k ON src = node WHERE hops < 8),
b AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)
SELECT 'c' || node AS node, min(ep) AS entry_point, hops FROM r JOIN b USING (node, hops) GROUP BY node, hops""")
def bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure over the calls of all orders; entry points are the customers of the highest balances."""
    customer = read(spark, sf_dir, "customer")
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    calls = corpus.order_edges(read(spark, sf_dir, "orders"), customer)
    edges = calls.select(F.lit("p").alias("project"), F.lit("a.py").alias("src_rel"), name("src").alias("src"), F.lit("a.py").alias("dst_rel"), name("dst").alias("dst")).distinct()
    begin = customer.filter("c_acctbal > 9800").select(F.lit("p").alias("project"), F.lit("a.py").alias("rel"), name("c_custkey").alias("qual"), F.concat(F.lit("ep"), F.col("c_custkey").cast("string")).alias("ep"), F.col("c_custkey").cast("int").alias("ep_ord"))
    return reachability.closure(begin, stored(edges, "edges")).select(F.col("qual").alias("node"), F.col("ep").alias("entry_point"), "hops")


#: Packages: a re-export, a climbing import, a package below src, a method of the own class, a nested caller, a
#: name that hides an import.
_PACKAGES = [
    {"p/__init__.py": "from .impl import h", "p/impl.py": "def h(): pass", "a.py": "from p import h\ndef f(): h()"},
    {"p/__init__.py": "", "p/u.py": "def h(): pass", "p/q/__init__.py": "", "p/q/a.py": "from ..u import h\ndef f(): h()"},
    {"src/lib/__init__.py": "", "src/lib/u.py": "def h(): pass", "a.py": "from lib.u import h\ndef f(): h()"},
    {"a.py": "class C:\n    def m(self): self.n()\n    def n(self): pass"},
    {"a.py": "def h(): pass\ndef f():\n    def g():\n        h()\n    return g"},
    {"u.py": "def h(): pass", "a.py": "from u import h\ndef h(): pass\ndef f(): h()"},
]


@query("""SELECT 'p' || p_partkey AS project, src_rel, src, dst_rel, dst FROM part JOIN (VALUES (0, 'a.py', 'f', 'p/impl.py', 'h'), (1, 'p/q/a.py', 'f', 'p/u.py', 'h'), (2, 'a.py', 'f', 'src/lib/u.py', 'h'),
(3, 'a.py', 'C.m', 'a.py', 'C.n'), (4, 'a.py', 'g', 'a.py', 'h'), (5, 'a.py', 'f', 'a.py', 'h')) AS t(c, src_rel, src, dst_rel, dst) ON p_size % 6 = c""")
def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(corpus.project_files(read(spark, sf_dir, "part"), "p_partkey", F.col("p_size") % 6, _PACKAGES)).edges


#: Entry points that are classes with and without a run method, handlers inside functions, and none at all.
_CLASSES = [
    {"a.py": "class T(BaseTool):\n    name = 't{k}'\n    def helper(self): eval('1')\n    def _run(self): self.helper()"},
    {"a.py": "class T(BaseTool):\n    name = 't{k}'\ndef plain(): eval('1')\nclass U:\n    def _run(self): plain()"},
    {"a.py": "def make():\n    @server.call_tool()\n    def run{k}(x): eval(x)"},
    {"a.py": "def make():\n    @tool\n    def run(x): eval(x)"},
    {"a.py": "if make:\n    @server.list_tools()\n    def go{k}(x):\n        class T:\n            def m(self): eval('1')"},
]


@query("""SELECT 'p' || p_partkey AS project, lineno, qual, reachability, entry || p_partkey AS entry_point, replace(path, '{k}', '' || p_partkey) AS path FROM part JOIN (VALUES
(0, 3, 'T.helper', 'reachable', 't', 'T._run > T.helper'), (1, 3, 'plain', 'unreachable', NULL, NULL), (2, 3, 'run{k}', 'reachable', 'run', 'run{k}'), (3, 3, 'run', 'no_entry_points', NULL, NULL),
(4, 5, 'm', 'unreachable', NULL, NULL)) AS t(c, lineno, qual_, reachability, entry, path) ON p_size % 5 = c, LATERAL (SELECT replace(qual_, '{k}', '' || p_partkey) AS qual)""")
def class_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scan(corpus.project_files(read(spark, sf_dir, "part"), "p_partkey", F.col("p_size") % 5, _CLASSES)).tagged.filter("detector = 'shell_exec'")
    return rows.select("project", "lineno", "qual", "reachability", F.col("entry_point_name").alias("entry_point"), F.array_join("reachability_path", " > ").alias("path"))


@query("SELECT 'p' || c_custkey AS project, 'depth' AS warning, CAST(1 AS BIGINT) AS n FROM customer WHERE c_custkey % 14 >= 9")
def depth_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 0 to 13 calls: where one is longer than eight, the function after those is not followed."""
    chains = [{"a.py": "@tool\ndef f0(): f1()\n" + "".join(f"def f{i}(): f{i + 1}()\n" for i in range(1, n + 1))} for n in range(14)]
    return Scan(corpus.project_files(read(spark, sf_dir, "customer"), "c_custkey", F.col("c_custkey") % 14, chains)).warnings


# ---- chains of functions: enclosing functions, states, best entry points, report ----------------------------

#: For every event: lineno, nth (the function around it, 0 at module level), and of that function the entry
#: point e that reaches it best, if one does within eight calls.
_CHAIN_CTE = f"""e AS (SELECT *, 'p' || user_id AS project, 'app/u' || user_id || '.py' AS file, event_type = 'signup' AND value > {corpus.ENTRY_VALUE} AS is_ep,
  sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS nth,
  CAST(4 + sum(CASE WHEN event_type <> 'signup' THEN 1 WHEN value > {corpus.ENTRY_VALUE} THEN 3 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS lineno FROM events),
g AS (SELECT user_id, nth, bool_or(is_ep) AS is_ep, bool_or(event_type = 'view') AS calls FROM e WHERE nth > 0 GROUP BY ALL),
b AS (SELECT *, max(CASE WHEN is_ep THEN nth END) OVER (PARTITION BY user_id ORDER BY nth) AS ep,
  max(CASE WHEN NOT calls THEN nth END) OVER (PARTITION BY user_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM g),
q AS (SELECT user_id, nth, CASE WHEN ep > coalesce(gap, 0) AND nth - ep <= 8 THEN ep END AS ep FROM b),
x AS (SELECT user_id, bool_or(is_ep) AS has_ep FROM e GROUP BY user_id),
f AS (SELECT e.project, e.file, e.user_id, e.lineno, e.nth, q.ep, has_ep, CASE WHEN event_type = 'click' THEN 'READ' ELSE 'EXECUTE' END AS capability,
  CASE WHEN NOT has_ep THEN 'no_entry_points' WHEN e.nth = 0 THEN 'module_level' WHEN q.ep IS NOT NULL THEN 'reachable' ELSE 'unreachable' END AS reachability
  FROM e JOIN x USING (user_id) LEFT JOIN q USING (user_id, nth) WHERE event_type IN ('click', 'error'))"""


def _chains(spark: SparkSession, sf_dir: str) -> Scan:
    return Scan(corpus.chain_files(read(spark, sf_dir, "events")))


@query(f"""WITH {_CHAIN_CTE} SELECT project, file, lineno, CASE WHEN nth = 0 THEN '<module>' ELSE 'f' || nth END AS qual FROM f""")
def enclosing_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _chains(spark, sf_dir)
    rows = scan.raw_findings.select("project", "rel", "lineno")
    return reachability.enclosing(rows, scan.spans).select("project", F.col("rel").alias("file"), "lineno", "qual")


@query(f"""WITH {_CHAIN_CTE} SELECT project, file, lineno, capability, reachability, CASE WHEN reachability = 'reachable' THEN 'f' || ep END AS entry_point,
  CASE WHEN reachability = 'reachable' THEN array_to_string(list_transform(range(CAST(ep AS BIGINT), CAST(nth AS BIGINT) + 1), lambda i: 'f' || i), ' > ') END AS path,
  reachability = 'reachable' AND nth - ep + 1 > 5 AS truncated FROM f""")
def reach_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chains(spark, sf_dir).tagged
    return rows.select("project", F.col("rel").alias("file"), "lineno", "capability", "reachability", F.col("entry_point_name").alias("entry_point"), F.array_join("reachability_path", " > ").alias("path"), F.col("reachability_path_truncated").alias("truncated"))


@query(f"""WITH {_CHAIN_CTE} SELECT 'p' || user_id AS project, 'f' || nth AS qual, 'f' || ep AS entry_point, CAST(nth - ep AS INTEGER) AS hops FROM q WHERE ep IS NOT NULL""")
def best_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _chains(spark, sf_dir)
    begin = reachability.starts(scan.python_entry_points.withColumn("ep_ord", F.col("ord")), scan.spans)
    return reachability.closure(begin, scan.edges).select("project", "qual", F.col("ep").alias("entry_point"), "hops")


@query(f"""WITH {_CHAIN_CTE} SELECT project, reachability, count(*) AS n FROM f GROUP BY ALL""")
def reach_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.state_counts(_chains(spark, sf_dir).tagged)


@query(f"""WITH {_CHAIN_CTE}, c AS (SELECT project, user_id, 'f' || ep AS name, count(*) AS n FROM f WHERE reachability = 'reachable' GROUP BY ALL)
SELECT e.project, 'f' || nth AS name, e.lineno - 1 AS lineno, coalesce(n, 0) AS reachable_findings FROM e LEFT JOIN c ON c.project = e.project AND c.name = 'f' || nth WHERE is_ep""")
def reachable_per_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _chains(spark, sf_dir)
    return reachability.reachable_findings(scan.tagged, scan.numbered_entry_points).select("project", "name", "lineno", F.size("reachable_findings").cast("long").alias("reachable_findings"))


@query(f"""WITH {_CHAIN_CTE} SELECT CAST(coalesce(max(CASE WHEN reachability = 'reachable' AND capability = 'EXECUTE' THEN 1 END), 0) AS INTEGER) AS exit_code FROM f""")
def severity_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.exit_code(_chains(spark, sf_dir).tagged, "high")


@query(f"""WITH {_CHAIN_CTE}, p AS (SELECT project, count(*) AS eps FROM e WHERE is_ep GROUP BY ALL), u AS (SELECT DISTINCT project FROM e),
c AS (SELECT project, count(*) AS n, count(*) FILTER (WHERE reachability = 'reachable') AS r FROM f GROUP BY ALL)
SELECT u.project, CAST(1 AS BIGINT) AS files, coalesce(n, 0) AS findings, coalesce(r, 0) AS reachable, coalesce(eps, 0) AS entry_points FROM u LEFT JOIN p USING (project) LEFT JOIN c USING (project)""")
def v1_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _chains(spark, sf_dir)
    one = F.count(F.lit(1))
    files = scan.files.filter(sources.scanned(F.col("path"))).groupBy("project").agg(one.alias("files"))
    found = scan.tagged.groupBy("project").agg(one.alias("findings"), F.count_if(F.col("reachability") == "reachable").alias("reachable"))
    eps = scan.python_entry_points.groupBy("project").agg(one.alias("entry_points"))
    return files.join(sized(found), "project", "left").join(sized(eps), "project", "left").fillna(0, ["findings", "reachable", "entry_points"])


@query(f"""WITH {_CHAIN_CTE}, u AS (SELECT project, count(*) FILTER (WHERE is_ep) AS eps FROM e GROUP BY ALL),
c AS (SELECT project, count(*) AS n, count(*) FILTER (WHERE reachability = 'reachable') AS r, array_to_string(list_sort(list_distinct(list(capability))), ',') AS caps FROM f GROUP BY ALL)
SELECT u.project, '1' AS version, CAST(1 AS INTEGER) AS files, CAST(eps AS INTEGER) AS entry_points, CAST(coalesce(n, 0) AS INTEGER) AS findings, CAST(coalesce(r, 0) AS INTEGER) AS reachable, coalesce(caps, '') AS capabilities FROM u LEFT JOIN c USING (project)""")
def project_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of many projects, read back from their JSON."""
    shape = "schema_version string, num_files_scanned int, entry_points_detected int, findings array<struct<finding: struct<reachability: string>>>, capabilities array<string>"
    rows = scan_reports(_chains(spark, sf_dir)).select("project", F.from_json("report", shape).alias("r"))
    reachable = F.size(F.filter("r.findings", lambda x: x["finding"]["reachability"] == "reachable"))
    return rows.select("project", F.col("r.schema_version").alias("version"), F.col("r.num_files_scanned").alias("files"), F.col("r.entry_points_detected").alias("entry_points"), F.size("r.findings").alias("findings"), reachable.alias("reachable"), F.array_join("r.capabilities", ",").alias("capabilities"))


# ---- Python entry points ---------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str, header: list[str], template: dict[str, str]) -> DataFrame:
    facts = stored(parse(corpus.event_files(read(spark, sf_dir, "events"), header, template)), "facts")
    return entry_points.python_entry_points(facts).select("project", F.col("rel").alias("file"), "name", "lineno", "framework", "pattern_type", "confidence")


def _entries_sql(header: int, sizes: dict[str, int], rows: list[tuple], extra: str = "") -> str:
    """SQL of entry points from (event type, name prefix, lines below the first, framework, confidence, pattern)."""
    rules = ", ".join(f"('{t}', '{n}', {d}, '{f}', {c}, '{p}')" for t, n, d, f, c, p in rows)
    return f"""WITH {_events_cte(header, sizes)}, t(event_type, prefix, below, framework, sure, pattern_type) AS (VALUES {rules})
SELECT project, file, CASE WHEN prefix = 'm' THEN 'm' ELSE prefix || event_id END AS name, CAST(lineno + below AS INTEGER) AS lineno, framework, pattern_type, CAST(sure AS DOUBLE) AS confidence
FROM e JOIN t USING (event_type) {extra}"""


@query(
    _entries_sql(
        4, {"click": 2, "view": 2, "purchase": 2, "error": 2, "signup": 3},
        [("click", "c", 1, "langchain", 0.95, "decorator"), ("view", "v", 1, "mcp", 0.8, "decorator"), ("purchase", "k", 1, "semantic_kernel", 0.6, "decorator"), ("signup", "m", 2, "mcp", 0.6, "decorator")],
    )
)
def ep_decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "@tool\ndef c{id}(): pass", "view": "@app.call_tool()\ndef v{id}(): pass", "purchase": "@x.kernel_function(name='k{id}')\nasync def p(): pass", "error": "def e{id}(): pass\npass", "signup": "class K{id}:\n    @server.list_tools()\n    def m(self): pass"}
    return _entries(spark, sf_dir, ["from langchain_core.tools import tool", "from mcp.server.fastmcp import FastMCP", "app = FastMCP('x')", "import semantic_kernel"], template)


@query(_entries_sql(2, {t: 2 for t in corpus.TYPES}, [("click", "a", 0, "langchain", 0.95, "class_attribute"), ("view", "b", 0, "agno", 0.6, "class_attribute")]))
def ep_base_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "class A{id}(BaseTool):\n    name = 'a{id}'", "view": "class B{id}(agno.Toolkit):\n    name: str = 'b{id}'", "purchase": "class C{id}(StructuredTool):\n    name = x", "error": "class D{id}(Generic[BaseTool]):\n    name = 'd'", "signup": "y = 1\npass"}
    return _entries(spark, sf_dir, ["from langchain.tools import BaseTool", "import agno"], template)


@query(
    _entries_sql(
        4, {},
        [("view", "g", 0, "openai_swarm", 0.95, "registration_call"), ("purchase", "h", 0, "llamaindex", 0.95, "registration_call"), ("error", "k", 0, "dspy", 0.95, "registration_call")],
        """UNION ALL SELECT project, file, 't' || event_id, 4, 'dspy', 'registration_call', 0.95 FROM e WHERE event_type = 'click'
UNION ALL SELECT DISTINCT project, file, 'helper', 4, 'openai_swarm', 'registration_call', 0.95 FROM e WHERE event_type = 'view'""",
    )
)
def ep_factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "t{id} = Tool(helper, name='t{id}')", "view": "Agent(functions=[helper, g{id}])", "purchase": "FunctionTool.from_defaults(fn=h{id})", "error": "x = [Tool(k{id}), Tool(k{id})]", "signup": "q: int = Tool(helper)"}
    return _entries(spark, sf_dir, ["from dspy import Tool", "from swarm import Agent", "from llama_index.core.tools import FunctionTool", "def helper(): pass"], template)


@query(
    _entries_sql(
        3, {t: 2 for t in corpus.TYPES},
        [
            ("click", "c", 1, "langchain", 0.95, "decorator"), ("view", "v", 1, "unknown", 0.7, "decorator"), ("purchase", "p", 1, "unknown", 0.7, "decorator"), ("error", "e", 1, "mcp", 0.6, "decorator"),
            ("signup", "s", 1, "marvin", 0.6, "decorator"),
        ],
    )
)
def ep_framework_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": "@lc.tool\ndef c{id}(): pass", "view": "@weird.tool\ndef v{id}(): pass", "purchase": "@tool_plain\ndef p{id}(): pass", "error": "@mcp.register_tool\ndef e{id}(): pass", "signup": "@nothing.fn\ndef s{id}(): pass"}
    return _entries(spark, sf_dir, ["import langchain_core as lc", "import weird", "from weird import tool_plain"], template)


# ---- TypeScript entry points -----------------------------------------------------------------------------------


def _scripts(spark: SparkSession, sf_dir: str, template) -> DataFrame:
    files = corpus.event_files(read(spark, sf_dir, "events"), ["// generated"], template, suffix="ts")
    return ts_entry_points.ts_entry_points(files.withColumn("text", F.col("content").cast("string"))).select("project", F.col("rel").alias("file"), "name", "lineno", "pattern_type", "confidence")


def _scripts_sql(sizes: dict[str, int], rows: list[tuple]) -> str:
    rules = ", ".join(f"('{t}', '{n}', '{p}', {c})" for t, n, p, c in rows)
    return f"""WITH {_events_cte(1, sizes)}, t(event_type, prefix, pattern_type, sure) AS (VALUES {rules})
SELECT project, replace(file, '.py', '.ts') AS file, prefix || event_id AS name, lineno, pattern_type, CAST(sure AS DOUBLE) AS confidence FROM e JOIN t USING (event_type)"""


@query(_scripts_sql({}, [("click", "t", "mcp_tool", 0.95), ("view", "r", "mcp_tool", 0.95), ("purchase", "H", "mcp_handler", 0.8), ("error", "d", "langchain_tool", 0.85)]))
def ts_same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": 'server.tool("t{id}", run)', "view": "s.registerTool('r{id}', {})", "purchase": "s.setRequestHandler(H{id}, run)", "error": 'new DynamicTool({ name: "d{id}" })', "signup": "// nothing"}
    return _scripts(spark, sf_dir, template)


@query(_scripts_sql({t: 2 for t in corpus.TYPES}, [("click", "t", "mcp_tool", 0.95), ("view", "r", "mcp_tool", 0.95), ("purchase", "H", "mcp_handler", 0.8), ("error", "d", "langchain_tool", 0.85), ("signup", "a", "mcp_tool", 0.9)]))
def ts_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"click": 'server.tool(\n  "t{id}",', "view": "s.registerTool(\n  'r{id}',", "purchase": "s.setRequestHandler(\n  H{id},", "error": 'new DynamicStructuredTool({\n  name: "d{id}",', "signup": 's.addTool({\n  name: "a{id}",'}
    return _scripts(spark, sf_dir, template)


@query(f"""WITH {_events_cte(1, {"purchase": 2})}
SELECT project, replace(file, '.py', '.ts') AS file, CASE event_type WHEN 'click' THEN 'unknown' WHEN 'view' THEN 'a' || event_id ELSE 'u' || event_id END AS name, CAST(lineno + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS lineno,
  CASE WHEN event_type = 'click' THEN 'langchain_tool' ELSE 'mcp_tool' END AS pattern_type, CAST(CASE WHEN event_type = 'click' THEN 0.85 ELSE 0.95 END AS DOUBLE) AS confidence FROM e WHERE event_type IN ('click', 'view', 'purchase')""")
def ts_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools without a name nearby, two registrations on one line, and lines that end in a line separator."""
    return _scripts(spark, sf_dir, {"click": "new DynamicTool({", "view": 's.tool("a{id}", f); s.tool("b", g)', "purchase": "x\u2028s.tool('u{id}', f)", "error": "s.addTool({", "signup": "// nothing"})


@query(f"""WITH {_events_cte(1)},
w AS (SELECT *, bool_or(event_type = 'view' AND value <= 100) OVER near AS described, bool_or(event_type = 'purchase' AND value > 60) OVER near AS shaped FROM e WINDOW near AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING))
SELECT project, replace(file, '.py', '.ts') AS file, 'n' || event_id AS name, lineno, 'mcp_tool_definition' AS pattern_type, CAST(0.85 AS DOUBLE) AS confidence FROM w WHERE event_type = 'click' AND described AND shaped""")
def ts_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda t: F.col("event_type") == t
    made = F.when(is_("click"), F.concat(F.lit('  name: "n'), F.col("event_id").cast("string"), F.lit('",'))).when(is_("view") & (F.col("value") <= 100), 'description: "x",').when(is_("purchase") & (F.col("value") > 60), "inputSchema: {},").otherwise("// nothing")
    return _scripts(spark, sf_dir, made)


@query(f"""SELECT prefix, framework FROM (VALUES {", ".join(f"('{p}', '{n}')" for p, n in R.FRAMEWORKS)}) AS t(prefix, framework)""")
def framework_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every framework prefix resolves to its framework, with and without a submodule."""
    names = R.table(spark, [(p,) for p, _ in R.FRAMEWORKS], "prefix string")
    deeper = names.withColumn("module", F.concat("prefix", F.lit(".tools"))).select("prefix", entry_points.framework_of("module").alias("framework"))
    return names.select("prefix", entry_points.framework_of("prefix").alias("framework")).union(deeper).distinct()
