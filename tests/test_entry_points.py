"""Entry points of Python and of TypeScript sources."""

import pytest

from brightmill.functions import rules as R
from brightmill.functions.parser import parse
from brightmill.operators import entry_points
from brightmill.operators.entry_points import python_entry_points
from brightmill.operators.ts_entry_points import ts_entry_points
from helpers import files

PYTHON = {
    "@tool\ndef f(): pass": [("f", 2, "langchain_or_crewai", "decorator", 0.6)],
    "from crewai.tools import tool\n@tool('n')\ndef f(): pass": [("n", 3, "crewai", "decorator", 0.95)],
    "from mine import tool\n@tool\ndef f(): pass": [("f", 3, "unknown", "decorator", 0.7)],
    "def g():\n    @tool\n    def f(): pass": [],
    "def g():\n    @server.call_tool()\n    def f(): pass": [("f", 3, "mcp", "decorator", 0.6)],
    "if x:\n    @tool\n    def f(): pass": [],
    "class A:\n    @tool\n    def f(self): pass": [("f", 3, "langchain_or_crewai", "decorator", 0.6)],
    "from strands import Agent\na = Agent[int]('x')\n@a.tool\ndef f(): pass": [("f", 4, "strands", "decorator", 0.8)],
    "class A(BaseTool): pass": [],
    "@tool\nclass A(BaseTool):\n    name = 'n'": [("n", 2, "langchain_or_crewai", "decorator", 0.6)],
    "class A(x.StructuredTool, BaseTool):\n    name: str = 'n'": [("n", 1, "langchain", "class_attribute", 0.6)],
    "from swarm import Agent\ndef f(): pass\na = Agent(name='x', functions=[f, m.g])": [("f", 2, "openai_swarm", "registration_call", 0.95), ("g", 3, "openai_swarm", "registration_call", 0.95)],
    "from other import Agent\na = Agent(functions=[f])": [],
    "from dspy import Tool\ndef go():\n    Tool(f)": [],
    "from camel.toolkits import FunctionTool\nt = [FunctionTool(f), FunctionTool(g)]": [("f", 2, "camel", "registration_call", 0.95), ("g", 2, "camel", "registration_call", 0.95)],
    "def f(:": [],
}
SCRIPTS = {
    'server.tool("a", x); server.tool("b", y)': [("a", 1, "mcp_tool", 0.95)],
    "server . tool (\n\n'a'": [],
    "server.addTool({\n" + "  x: 1,\n" * 8 + "  name: 'n' })": [("n", 1, "mcp_tool", 0.9)],
    "server.addTool({\n" + "  x: 1,\n" * 9 + "  name: 'n' })": [],
    "new DynamicTool({\n" + "  x: 1,\n" * 11 + "  name: 'n' })": [("unknown", 1, "langchain_tool", 0.85)],
    "s.setRequestHandler(\n  List, run)": [("List", 1, "mcp_handler", 0.8)],
    "s.setRequestHandler(handler(x), run)": [],
    "{\n  name: 'n',\n  description: 'd',\n  inputSchema: {} }": [("n", 2, "mcp_tool_definition", 0.85)],
    "{\n  name: 'n',\n  description: 'd' }": [],
    "a\x0bb\u2028s.registerTool('é', x)": [("é", 3, "mcp_tool", 0.95)],
}


def test_python_cases(spark):
    got = {}
    for r in python_entry_points(parse(files(spark, {str(n): code for n, code in enumerate(PYTHON)}))).collect():
        got.setdefault(r.project, []).append((r.name, r.lineno, r.framework, r.pattern_type, r.confidence))
    for n, (code, want) in enumerate(PYTHON.items()):
        assert sorted(got.get(str(n), [])) == sorted(want), code


def test_script_cases(spark):
    from pyspark.sql import functions as F

    given = files(spark, {str(n): {"a.ts": code} for n, code in enumerate(SCRIPTS)}).withColumn("text", F.col("content").cast("string"))
    got = {}
    for r in ts_entry_points(given).collect():
        got.setdefault(r.project, []).append((r.name, r.lineno, r.pattern_type, r.confidence))
    for n, (code, want) in enumerate(SCRIPTS.items()):
        assert sorted(got.get(str(n), [])) == sorted(want), code


@pytest.mark.parametrize("table", ["decorators", "bases", "factories"])
def test_rules_can_be_extended(spark, table):
    code = "@mine\ndef f(): pass\nclass A(MyTool):\n    name = 'n'\nregister(g)"
    more = {"decorators": {"mine": "own"}, "bases": {"MyTool": "own"}, "factories": [("register", None, [], "single", None, None, None, "own")]}
    rows = python_entry_points(parse(files(spark, {"p": code})), **{table: more[table]}).collect()
    assert [(r.name, r.framework) for r in rows] == [{"decorators": ("f", "own"), "bases": ("n", "own"), "factories": ("g", "own")}[table]]


def test_rules_of_factory_calls_are_chosen_in_place(spark):
    """Nothing is shuffled by call (with the imports and functions of the call's file); of several rules that fit the first counts."""
    table = [("go", "x", [], "single", None, None, None, "a"), ("go", None, [], "single", None, None, None, "b"), ("go", None, [], "single", None, None, None, "c")]
    rows = entry_points._factories(entry_points._with_origins(parse(files(spark, {"p": "x.go(f)\ngo(g)\ny.go(h)\nno(i)"}))), table)
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.name, r.framework) for r in rows.collect()) == [("f", "a"), ("g", "b")]
    assert "hashpartitioning" not in entry_points._factories(entry_points._with_origins(parse(files(spark, {"p": "go(g)"}))), R.FACTORIES)._jdf.queryExecution().executedPlan().toString()
