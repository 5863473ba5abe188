"""Scan targets: local paths, Git repositories, MCP endpoints and packages of a Python index.

Remote targets are fetched by the driver into a temporary folder that lasts as long as the context. Whatever
touches the network is a parameter, so that tests and closed networks can put in their own.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import shutil
import subprocess
import tarfile
import tempfile
import urllib.error
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from urllib.parse import urlparse
from urllib.request import Request, urlopen

INDEX = "https://pypi.org/pypi"
Progress = Callable[[str, int, str], None]


@dataclass
class Target:
    path: Path
    shown: str
    kind: str
    version: str | None = None


def fetch(url: str, body: bytes | None = None, timeout: int = 60) -> bytes:
    headers = {"Content-Type": "application/json"} if body else {}
    with urlopen(Request(url, data=body, headers=headers, method="POST" if body else "GET"), timeout=timeout) as answer:
        return answer.read()


def is_github(target: str) -> bool:
    u = urlparse(target)
    return u.scheme in ("http", "https") and "github.com" in u.netloc.lower()


def is_mcp(target: str) -> bool:
    return target.startswith(("mcp+http://", "mcp+https://"))


def package_spec(target: str) -> tuple[str, str | None]:
    """Name and version of ``pypi:name[==version]``."""
    name, _, version = target.removeprefix("pypi:").partition("==")
    return name.strip(), version.strip() or None


def safe(name: str) -> bool:
    """Whether an archive member stays below the folder it is unpacked to."""
    p = PurePosixPath(name)
    return not p.is_absolute() and ".." not in p.parts


def unpack(name: str, data: bytes, out: Path) -> None:
    """Unpack an archive without absolute, climbing or linked members."""
    try:
        if name.endswith((".tar.gz", ".tgz", ".tar.bz2")):
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:bz2" if name.endswith("bz2") else "r:gz") as t:
                t.extractall(out, [m for m in t.getmembers() if safe(m.name) and not m.issym() and not m.islnk()], filter="data")
        elif Path(name).suffix in (".zip", ".whl"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                z.extractall(out, [m for m in z.namelist() if safe(m)])
        else:
            raise RuntimeError(f"cannot unpack {name!r}: unknown kind of archive")
    except (tarfile.TarError, zipfile.BadZipFile) as e:
        raise RuntimeError(f"cannot unpack {name!r}: {e}") from e


def fetch_package(name: str, version: str | None, out: Path, get=fetch, tell: Progress | None = None) -> str:
    """Download and unpack a package (source archive before wheel); the version found."""
    tell = tell or (lambda *_: None)
    shown = f"{name}=={version}" if version else name
    tell("pypi_download", 0, f"asking for {name}")
    try:
        about = json.loads(get("/".join(filter(None, (INDEX, name, version, "json"))), timeout=15))
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"PyPI: {shown!r} not found" if e.code == 404 else f"PyPI answered HTTP {e.code} for {shown!r}") from e
    except urllib.error.URLError as e:
        raise RuntimeError(f"PyPI cannot be reached over the network: {e}") from e
    files = [f for kind in ("sdist", "bdist_wheel") for f in about.get("urls", []) if f.get("packagetype") == kind]
    if not files:
        raise RuntimeError(f"PyPI: {shown!r} has neither an sdist nor a wheel")
    tell("pypi_download", 30, files[0]["filename"])
    try:
        data = get(files[0]["url"], timeout=60)
    except urllib.error.URLError as e:
        raise RuntimeError(f"download of {files[0]['filename']!r} failed: {e}") from e
    tell("pypi_download", 70, files[0]["filename"])
    unpack(files[0]["filename"], data, out)
    tell("pypi_download", 100, "done")
    return about["info"]["version"]


def fetch_mcp(endpoint: str, out: Path, get=fetch) -> None:
    """Store the Python resources of an MCP endpoint as files."""

    def ask(number: int | None, method: str, **params) -> dict:
        note = {"jsonrpc": "2.0", "method": method, "params": params} | ({"id": number} if number is not None else {})
        return (json.loads(get(endpoint, json.dumps(note).encode(), timeout=15)) or {}).get("result") or {}

    try:
        ask(1, "initialize", protocolVersion="2024-11-05", capabilities={}, clientInfo={"name": "brightmill", "version": "1"})
        ask(None, "notifications/initialized")
    except Exception:  # servers may do without the greeting
        pass
    found, cursor, number = [], None, 10
    while True:
        page = ask(number, "resources/list", **({"cursor": cursor} if cursor else {}))
        found += page.get("resources", [])
        number, cursor = number + 1, page.get("nextCursor")
        if not cursor:
            break
    wanted = [r for r in found if str(r.get("uri", "")).endswith(".py") or r.get("mimeType") in ("application/x-python-code", "text/x-python")]
    if not wanted:
        raise RuntimeError("the MCP endpoint has no Python resources")
    for n, r in enumerate(wanted, 1):
        uri = str(r.get("uri", ""))
        text = "\n".join(c["text"] for c in ask(1000 + n, "resources/read", uri=uri).get("contents", []) if isinstance(c.get("text"), str))
        if text.strip():
            name = PurePosixPath(urlparse(uri).path).name or f"resource_{n}"
            name = name if name.endswith(".py") else name + ".py"
            (out / f"{n:04d}_{hashlib.sha1(uri.encode()).hexdigest()[:8]}_{name}").write_text(text, encoding="utf-8")


def clone(url: str, out: Path, tell: Progress | None = None) -> None:
    tell = tell or (lambda *_: None)
    tell("github_clone", 0, "starting")
    with subprocess.Popen([*"git clone --progress --depth 1".split(), url, str(out)], stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True) as run:
        said = []
        for line in run.stderr:  # carriage returns end lines too
            said.append(line)
            if m := re.search(r"(Receiving objects|Resolving deltas): +([0-9]+)%", line):
                tell("github_clone", min(99, int(m[2])), m[1])
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, run.args, stderr="".join(said[-20:]))
    tell("github_clone", 100, "done")


def package_root(folder: Path) -> Path:
    """The only directory of an unpacked source archive if it looks like a project, else the folder."""
    inner = [p for p in folder.iterdir() if p.is_dir() and p.suffix != ".dist-info"] if folder.is_dir() else []
    marks = ("PKG-INFO", "pyproject.toml", "setup.cfg", "setup.py")
    return inner[0] if len(inner) == 1 and any((inner[0] / m).exists() for m in marks) else folder


@contextmanager
def resolve(target: str | Path, tell: Progress | None = None, get=fetch, git=clone) -> Iterator[Target]:
    """The local folder of a target: a Path or existing path, a GitHub URL, an MCP endpoint, a package."""
    if isinstance(target, Path) or Path(str(target).strip()).exists():
        p = Path(str(target).strip()).resolve()
        yield Target(p, str(p), "local")
        return
    text = str(target).strip()
    work = Path(tempfile.mkdtemp(prefix="brightmill-target-"))
    try:
        inside = work / "content"
        if is_github(text):
            git(text, inside, tell)
            yield Target(inside, text, "github")
        elif is_mcp(text):
            inside.mkdir()
            fetch_mcp(text.removeprefix("mcp+"), inside, get)
            yield Target(inside, text, "mcp")
        elif text.startswith("pypi:"):
            inside.mkdir()
            version = fetch_package(*package_spec(text), inside, get, tell)
            yield Target(inside, text, "pypi", version)
        else:
            raise FileNotFoundError(f"{text!r} is no local path and no remote target of a known kind")
    finally:
        shutil.rmtree(work, ignore_errors=True)
