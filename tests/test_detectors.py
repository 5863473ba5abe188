"""Detector quirks, all in one scan: every case is a project of its own."""

from brightmill.functions.parser import parse
from brightmill.operators import detectors
from helpers import files

CASES = {
    "shell_exec": {
        "import subprocess as sp\nsp.run('a')": [],  # receivers are literal
        "subprocess.run('a'); subprocess.run('a')": [("subprocess.run()", 1)] * 2,  # repeats stay
        "subprocess.check_output('a')\nos.popen('a')": [],
        "x.eval('1')\neval('1')": [("eval()", 2)],
        "def f(:\n": [],
    },
    "network": {
        "import requests as r\nr.get('https://e.example/x')": [("requests.get", 2), ("requests.get -> https://e.example/x", 2)],
        "import requests\nrequests.get(url='https://e.example')": [("requests.get", 2)],
        "x.disconnect()": [("x.disconnect", 1)],
        "sqlite3.connect('a')": [],
        "from http.client import HTTPConnection\nHTTPConnection('h')": [("http.client.HTTPConnection", 2)],
        "from httpx import Timeout\nTimeout(5)": [],
        "from qdrant_client.http.models import Filter\nFilter()": [],
        "import httpx\nasync def f():\n    async with httpx.AsyncClient() as c:\n        await c.get(u)": [("httpx.Client", 3), ("httpx.AsyncClient.get", 4)],  # the first rule that fits names it
        "app.get(1, 'no url', ' https://a ', 'https://b')": [("app.get -> https://a", 1)],
        "from urllib.parse import urlparse\nurlparse('http://a')": [],
    },
    "file_access": {
        "open('a', 'w+')": [("READ", "open(..., mode='w+')", 1)],
        "open('a', mode='x')": [("WRITE", "open(..., mode='x')", 1)],
        "f().g().read_text()": [("READ", "g.read_text()", 1)],
        "x[0].write_bytes(b)": [("WRITE", "None.write_bytes()", 1)],
        "oslo.remove(x)": [("WRITE", "oslo.remove()", 1)],
        "async def f():\n    async with open('a') as g: pass": [("READ", "open(..., mode='')", 2)],
        "from os import remove\nremove('a')": [("WRITE", "os.remove", 2)],
        "from shutil import rmtree\nrmtree('a')": [],
    },
    "dynamic_exec": {
        "re.compile('a')": [],
        "from re import compile\ncompile('a')": [("re.compile", 2)],
        "__import__('os')\n__import__(name)": [("__import__", 2)],
        "import importlib as i\ni.import_module(n)": [("importlib.import_module", 2)],
        "eval('1'); eval('2')\neval('3')": [("eval", 1), ("eval", 2)],
    },
    "autonomy": {
        "import threading\nthreading.Thread().start()\nthreading.Thread()": [("threading.Thread", 3), ("start()", 2)],  # breadth first: line 3 comes before what is inside line 2
        "my_match.start(); span.start(); http_res.start(); a.trace_x.start()": [],
        "from asyncio import create_task\ncreate_task(f())": [("asyncio.create_task", 2)],
        "x.y.start()": [("x.y.start()", 1)],
        "x[0].start()": [("start()", 1)],
    },
}


def test_all_cases(spark):
    projects = {f"{d}/{n}": code for d, cases in CASES.items() for n, code in enumerate(cases)}
    facts = parse(files(spark, projects)).cache()
    every = detectors.detect(facts).cache()
    for name, cases in CASES.items():
        got = {}
        for r in every.filter(f"detector = '{name}' and project like '{name}/%'").collect():
            got.setdefault(r.project, []).append((r.capability, r.evidence, r.lineno) if name == "file_access" else (r.evidence, r.lineno))
        for n, (code, want) in enumerate(cases.items()):
            assert sorted(got.get(f"{name}/{n}", [])) == sorted(want), code


def test_bytes_that_are_no_utf8(spark):
    """Detectors skip such files, the other analyses read what can be read."""
    facts = parse(files(spark, {"p": {"a.py": b"eval('\xff')\ndef f(): pass\n", "b.py": "eval('1')"}}))
    assert [(r.path, r.evidence) for r in detectors.detect(facts, "shell_exec").collect()] == [("b.py", "eval()")]
    row = facts.filter("path = 'a.py'").first()
    assert not row.strict and row.parsed and [s.qual for s in row.spans] == ["f"]
