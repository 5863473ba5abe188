"""Whole scans, reports, targets, the registry and the command line."""

import io
import json
import tarfile
import urllib.error
import zipfile

import pytest

from brightmill.operators import findings, registry
from brightmill.plans import report
from brightmill.plans.scan import scan_path, scan_target, v1_report
from brightmill.sources import targets
from brightmill.sources.files import read_tree, upload_tree

AGENT = "import subprocess, requests\nfrom langchain_core.tools import tool\n@tool\ndef go(x):\n    run(x)\ndef run(x):\n    subprocess.run(x)\nrequests.post(u)\n"


def tree(folder, **kinds):
    for name, text in {"agent.py": AGENT, "test_agent.py": "eval('1')", "tool.ts": 'server.tool("t", f)', "sub/.venv/x.py": "eval('1')"}.items():
        p = folder / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text(text)
    return folder


def test_scan_of_a_folder(spark, tmp_path):
    out = scan_path(spark, tree(tmp_path / "my+pro %20[x] ject"))
    assert out["num_files_scanned"] == 1 and out["num_ts_files_scanned"] == 1 and out["capabilities"] == ["EXECUTE", "SEND"]
    assert [r["id"] for r in out["risks"]] == ["remote_control"] and out["risks"][0]["capabilities_triggered"] == ["EXECUTE", "SEND"]
    by = {f["finding"]["capability"]: f["finding"] for f in out["findings"]}
    assert by["EXECUTE"]["reachability"] == "reachable" and by["EXECUTE"]["reachability_path"] == ["go", "run"] and by["SEND"]["reachability"] == "module_level"
    assert by["EXECUTE"]["file"] == str(tmp_path / "my+pro %20[x] ject" / "agent.py") and by["EXECUTE"]["relative_file"] == "agent.py"
    assert out["py_entry_points"][0]["reachable_findings"] == [by["EXECUTE"]["finding_id"]]
    assert report.exit_code(out) == 1 and report.exit_code(out, "none") == 0
    v1 = json.loads(report.json_report(out))
    assert len(v1) == 16 and v1["entry_points_detected"] == 2 and v1["schema_version"] == "1"
    text = report.human_report(out, explain=True)
    for part in ("Reachability Summary", "1 reachable", "1 module-level", "go @ agent.py", "TypeScript Entry Points", "[HIGH] EXECUTE via subprocess.run()"):
        assert part in text, part
    report.write_json_report(out, tmp_path / "deep/er/r.json")
    assert json.loads((tmp_path / "deep/er/r.json").read_text())["capabilities"] == ["EXECUTE", "SEND"]


def test_single_file_bypasses_exclusions(spark, tmp_path):
    p = tmp_path / "test_x.py"
    p.write_text("eval('1')")
    out = scan_path(spark, p)
    assert [f["finding"]["relative_file"] for f in out["findings"]] == ["."] * 2
    assert out["findings"][0]["finding"]["finding_ref"].split(":")[1] == "." and out["findings"][0]["finding"]["reachability"] == "no_entry_points"


def test_folder_without_python(spark, tmp_path):
    for name in ("a.go", "b.go", "c.rs", "vendor/d.go", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    out = scan_path(spark, tmp_path)
    assert out["other_languages"] == [{"language": "Go", "count": 2}, {"language": "Rust", "count": 1}] and out["findings"] == []
    assert "Detected: Go (2 files), Rust (1 files)" in report.human_report(out)


def test_only_source_files_are_read(spark, tmp_path):
    """Files beyond two gigabytes, of any kind, stop no scan."""
    tree(tmp_path)
    for name in ("weights.bin", "huge.py", ".git/pack"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with open(tmp_path / name, "wb") as f:
            f.truncate((2 << 30) + 10)
    rows = {r.rel: r.size for r in read_tree(spark, tmp_path).selectExpr("rel", "octet_length(content) AS size").collect()}
    assert rows["agent.py"] == len(AGENT) and all(rows[n] is None for n in ("weights.bin", "huge.py", ".git/pack")) and len(rows) == 7
    out = scan_path(spark, tmp_path)
    assert out["num_files_scanned"] == 2 and out["capabilities"] == ["EXECUTE", "SEND"] and out["warnings"] == []


def test_hidden_and_underscored_files_count(spark, tmp_path):
    for name, text in {"pkg/__init__.py": "from .impl import h", "pkg/impl.py": "def h(): eval('1')", "main.py": "from pkg import h\n@tool\ndef go(): h()", ".hooks/a.py": "exec('1')", "pkg/_x/b.py": "exec('1')"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    out = scan_path(spark, tmp_path)
    by = {(f["finding"]["relative_file"], f["detector"]): f["finding"] for f in out["findings"]}
    assert by["pkg/impl.py", "shell_exec"]["reachability_path"] == ["go", "h"] and {r for r, _ in by} == {"pkg/impl.py", ".hooks/a.py", "pkg/_x/b.py"} and out["num_files_scanned"] == 5


def test_trees_of_the_driver_are_uploaded(spark, tmp_path):
    tree(tmp_path)
    key = lambda r: r.path
    assert sorted(upload_tree(spark, tmp_path, batch_bytes=10).collect(), key=key) == sorted(read_tree(spark, tmp_path).collect(), key=key)
    assert upload_tree(spark, tmp_path / "sub" / ".venv").count() == 1
    (tmp_path / "empty").mkdir()
    assert read_tree(spark, tmp_path / "empty").count() == 0
    assert upload_tree(spark, tmp_path / "empty").count() == 0


def test_progress_and_warnings(spark, tmp_path):
    (tmp_path / "a.py").write_text("@tool\ndef f0(): f1()\n" + "\n".join(f"def f{i}(): f{i + 1}(); eval('1')" for i in range(1, 12)))
    told = []
    with pytest.warns(UserWarning, match="1 functions lie beyond 8 calls"):
        out = scan_path(spark, tmp_path, tell=lambda *x: told.append(x))
    assert [t[:2] for t in told] == [("analysis_scan", 0), ("analysis_scan", 50), ("analysis_scan", 100)] and told[-1][2] == "1/1 files"
    assert "Note: 1 functions lie beyond" in report.human_report(out)


def test_reports_of_many_projects_are_those_of_single_scans(spark):
    from brightmill.plans.scan import Scan, project_reports, report_of
    from helpers import files

    projects = {"one": {"agent.py": AGENT, "b.ts": 'server.tool("t", f)'}, "two": {"x.go": "package x", "y.rs": ""}, 'th"ree': {"a.py": "open('a', 'w')\n@tool\ndef f(): eval('1')"}}
    got = {r.project: json.loads(r.report) for r in project_reports(Scan(files(spark, projects))).collect()}
    assert set(got) == set(projects)
    for name in ("one", "two"):
        want = json.loads(report.json_report(report_of(Scan(files(spark, {name: projects[name]})), name)))
        assert got[name] | {"generated_at": 0, "source_type": 0} == want | {"generated_at": 0, "source_type": 0}


def archive(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            if text is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(info)
            else:
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_package_target(spark, tmp_path):
    data = archive({"pkg-1.2/setup.py": "", "pkg-1.2/pkg/a.py": "eval('1')", "pkg-1.2/docs/b.py": "eval('1')", "../evil.py": "x", "/abs.py": "x", "pkg-1.2/link.py": None})

    def get(url, body=None, timeout=60):
        if url.endswith("json"):
            files = [{"packagetype": "bdist_wheel", "filename": "p.whl", "url": "w"}, {"packagetype": "sdist", "filename": "p.tar.gz", "url": "s"}]
            return json.dumps({"info": {"version": "1.2"}, "urls": files}).encode()
        assert url == "s"
        return data

    out = scan_target(spark, "pypi:pkg", get=get)
    assert out["resolved_version"] == "1.2" and out["source_type"] == "pypi" and {f["finding"]["file"] for f in out["findings"]} == {"pkg/a.py"}
    assert v1_report(out)["resolved_version"] == "1.2"


def test_package_failures(tmp_path):
    def missing(url, timeout=0):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    with pytest.raises(RuntimeError, match="1. not found"):
        targets.fetch_package("x", "1", tmp_path, missing)
    with pytest.raises(RuntimeError, match="neither"):
        targets.fetch_package("x", None, tmp_path, lambda *a, **k: b'{"urls": []}')
    with pytest.raises(RuntimeError):
        targets.unpack("x.rar", b"", tmp_path)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../evil.py", "x"), f.writestr("ok.py", "x")
    targets.unpack("x.whl", z.getvalue(), tmp_path)
    assert [p.name for p in tmp_path.iterdir()] == ["ok.py"] and not (tmp_path.parent / "evil.py").exists()
    assert targets.package_spec("pypi:a == 1.0") == ("a", "1.0") and targets.package_spec("pypi:a") == ("a", None)


def test_mcp_and_git_targets(spark):
    pages = {None: {"resources": [{"uri": "file:///a.py"}, {"uri": "x:/b", "mimeType": "text/x-python"}], "nextCursor": "2"}, "2": {"resources": [{"uri": "c.txt"}, {"uri": "d.py"}]}}

    def get(url, body, timeout=0):
        ask = json.loads(body)
        if ask["method"] == "initialize":
            raise OSError
        if ask["method"] == "resources/list":
            return json.dumps({"result": pages[ask["params"].get("cursor")]}).encode()
        texts = {"file:///a.py": ["eval('1')", "x = 1"], "x:/b": ["exec('1')"], "d.py": [" "]}
        return json.dumps({"result": {"contents": [{"text": t} for t in texts.get(ask["params"].get("uri"), [])]}}).encode()

    with targets.resolve("mcp+https://h/x", get=get) as t:
        names = sorted(p.name for p in t.path.iterdir())
        kept = t.path
    assert [n[:5] + n[14:] for n in names] == ["0001_a.py", "0002_b.py"] and not kept.exists()
    with targets.resolve("https://github.com/a/b", git=lambda url, out, tell: (out.mkdir(), (out / "a.py").write_text(url))) as t:
        assert (t.path / "a.py").exists() and t.kind == "github"
    with pytest.raises(FileNotFoundError), targets.resolve("no-such-thing"):
        pass


def test_registry_and_custom_findings(spark):
    from helpers import files

    registry.clear_registry()

    @registry.register_detector("todo")
    def todo(path, content):
        return [{"capability": "READ", "evidence": "todo", "lineno": n, "risk_level": "low"} for n, x in enumerate(content.split("\n"), 1) if "TODO" in x]

    class Bad:
        name = "bad"

        def scan_file(self, path, content):
            raise OSError

    class Odd:
        lineno, confidence, evidence = "12", "high", 7

        @property
        def capability(self):
            raise ValueError

    @registry.register_detector("types")
    def types(path, content):
        return [{"capability": "READ", "evidence": b"x", "lineno": "12", "confidence": "high"}, {"lineno": [1], "confidence": 7, "risk_level": 3}, Odd(), None]

    registry.register_detector(Bad())
    with pytest.raises(ValueError):
        registry.register_detector(todo)
    with pytest.raises(ValueError):
        registry.register_detector("bad")(todo)
    try:
        rows = findings.enrich(registry.custom_findings(files(spark, {"p": "x\n# TODO", "q": b"\xff TODO"}), registry.get_detectors())).collect()
        assert [(r.project, r.detector, r.lineno, r.risk_level, r.confidence) for r in rows if r.detector == "todo"] == [("p", "todo", 2, "low", 0.9)]
        odd = [(r.lineno, r.confidence, r.risk_level, r.evidence) for r in rows if r.detector == "types"]
        assert odd == [(12, 0.9, "medium", "b'x'"), (None, 1.0, "3", None), (None, 0.9, "medium", None)]
        assert registry.call_detector(registry.get_detector("bad"), "a", "b") == []
    finally:
        registry.clear_registry()
    assert registry.get_detectors() == {}


def test_normal_values():
    from brightmill.plans.scan import _normal

    assert _normal({"risk_level": "HIGH", "confidence": "3", "lineno": "7"}) == {"risk_level": "high", "confidence": 1.0, "lineno": 7}
    assert _normal({"risk_level": "odd", "confidence": "x", "lineno": "x"}) == {"risk_level": "medium", "confidence": None, "lineno": None}
    assert _normal({"risk_level": None, "confidence": -1, "lineno": None}) == {"risk_level": None, "confidence": 0.0, "lineno": None}


def test_format_path():
    assert report.format_path(["a", "b", "c"], True) == "a → … → c" and report.format_path(["a", "b"], True) == "a → b" and report.format_path(None, False) == ""


def test_command_line(spark, tmp_path, capsys):
    tree(tmp_path)
    with pytest.raises(SystemExit) as e:
        report.main([str(tmp_path), "--json", "--severity", "high"])
    assert e.value.code == 1 and json.loads(capsys.readouterr().out)["target"] == str(tmp_path)
    with pytest.raises(SystemExit) as e:
        report.main([str(tmp_path / "none")])
    assert e.value.code == 2


def test_scripts_lose_their_invalid_bytes_only(spark):
    from brightmill.plans.scan import Scan
    from helpers import files

    rows = Scan(files(spark, {"p": {"a.ts": b'server.tool("a\xffb", f)', "b.ts": 'server.tool("\ufffd", f)'}})).ts_entry_points.collect()
    assert sorted(r.name for r in rows) == ["ab", "\ufffd"]
