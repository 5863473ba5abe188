"""Reports as JSON and as text, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .scan import scan_target, v1_report

_STATES = [("unreachable", "no call path leads there"), ("module_level", "run when the module is imported"), ("unknown", "could not be resolved")]


def json_report(results: dict) -> str:
    return json.dumps(v1_report(results), ensure_ascii=False, indent=2)


def write_json_report(results: dict, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json_report(results), encoding="utf-8")


def format_path(path: list | None, truncated: bool, files: list | None = None, explain: bool = False) -> str:
    """``a → … → z`` for long paths; with ``explain`` every step on a line, with its file."""
    path = path or []
    if explain:
        return "\n      → ".join(f"{p} @ {f}" if f else p for p, f in zip(path, files or [None] * len(path)))
    if truncated and len(path) > 2:
        path = [path[0], *path[-1:]]
        path.insert(1, "…")
    return " → ".join(path)


def _section(title: str) -> list[str]:
    return [title, "-" * len(title)]


def _finding(item: dict, explain: bool, state: bool) -> list[str]:
    f = item["finding"]
    at = f"{f.get('file')}:{f['lineno']}" if f.get("lineno") else f"{f.get('file')}"
    kind = f.get("reachability")
    mark = f"{kind.upper()}  " if state and kind in dict(_STATES) else ""
    out = [f"  [{str(f.get('risk_level', 'unknown')).upper()}] {mark}{f.get('capability')} via {f.get('evidence')} ({item.get('detector', 'unknown')} @ {at})"]
    if kind == "reachable":
        text = format_path(f.get("reachability_path"), f.get("reachability_path_truncated", False), f.get("reachability_files"), explain)
        out += ["    call chain:", f"      {text}"] if explain and text else [f"    path: {text}"] if text else []
    elif kind == "module_level":
        out.append("    reachability: runs on import of this module")
    return [*out, f"    explanation: {f.get('explanation', '')}", f"    impact: {f.get('impact', '')}"]


def human_report(results: dict, explain: bool = False) -> str:
    """The text report."""
    out = ["Agent Capability Report", "=" * 23, ""]
    if results.get("py_entry_points"):
        out += _section("Python Entry Points (LLM-controlled surface)")
        out += [f"  • {e['name']}  ({e['framework']}/{e['pattern_type']} @ {e['file']}:{e['lineno']})" for e in results["py_entry_points"]] + [""]
    caps = results.get("capabilities", [])
    out += [*_section("Capabilities"), *(f"  • {c}" for c in caps), ""] if caps else ["No detected capabilities.", ""]
    out += _section("Combined Risks")
    for r in results.get("risks", []):
        out += [f"  [{str(r.get('severity', 'unknown')).upper()}] {r.get('title')}", f"    why: {r.get('why', '')}", f"    capabilities: {', '.join(r.get('capabilities_triggered', []))}"]
    out += ["" if results.get("risks") else "  None inferred.", *([] if results.get("risks") else [""])]
    by: dict[str | None, list] = {}
    for x in results.get("findings", []):
        by.setdefault(x["finding"].get("reachability"), []).append(x)
    if set(by) & {"reachable", *dict(_STATES)}:
        out += _section("Reachability Summary")
        out += [f"  {len(by.get('reachable', [])):>4} reachable"] + [f"  {len(by.get(s, [])):>4} {s.replace('_', '-')}" for s, _ in _STATES if s == "unreachable" or by.get(s)] + [""]
        out += _section("Reachable Findings")
        out += [line for x in by.get("reachable", []) for line in _finding(x, explain, False)] or ["  No findings can be reached from the entry points."]
        out.append("")
        rest = [x for s, _ in _STATES for x in by.get(s, [])]
        if rest:
            out += [*_section("Other Findings"), *(line for x in rest for line in _finding(x, explain, True)), ""]
    else:
        out += _section("Findings")
        if "no_entry_points" in by:
            out += ["  No Python entry points: all findings, without reachability.", ""]
        out += [line for x in results.get("findings", []) for line in _finding(x, explain, False)] or ["  No findings detected."]
        out.append("")
    scripts, n = results.get("ts_entry_points", []), int(results.get("num_ts_files_scanned") or 0)
    if scripts:
        out += [*_section("TypeScript Entry Points (LLM-controlled surface)"), *(f"  • {e['name']}  ({e['pattern_type']} @ {e['file']}:{e['lineno']})" for e in scripts), ""]
    elif n:
        out += [f"TypeScript/JavaScript files scanned: {n} (without entry points of a known pattern)", ""]
    if not results.get("num_files_scanned"):
        other = results.get("other_languages", [])
        if scripts:
            out += ["⚠  Capabilities are analysed in Python only; the entry points above show what can be called.", ""]
        elif not n:
            out.append("Nothing to analyse: there are neither Python nor TypeScript files.")
            out += ["Detected: " + ", ".join(f"{x['language']} ({x['count']} files)" for x in other), ""] if other else [""]
    out += [f"Note: {w}" for w in results.get("warnings", [])]
    version, target = results.get("resolved_version"), results.get("target", "")
    out.append("Static analysis only.")
    python = int(results.get("num_files_scanned") or 0)
    out.append(f"Read {python} Python and {n} TypeScript/JavaScript files under {target}" + (f" (version {version})" if version and version not in target else ""))
    return "\n".join(out)


def exit_code(results: dict, severity: str = "high") -> int:
    levels = {"none": set(), "medium": {"high", "medium"}}.get(severity, {"high"})
    return int(any(x.get("finding", {}).get("reachability") == "reachable" and x["finding"].get("risk_level") in levels for x in results.get("findings", [])))


def _bar(stage: str, percent: int, detail: str) -> None:
    print(f"\r{stage:<14} [{'#' * (percent * 28 // 100):<28}] {percent:3d}% {detail:<24}", end="\n" if percent >= 100 else "", file=sys.stderr, flush=True)


def main(argv: list[str] | None = None) -> None:
    """Command line; exits with 0, 1 (reachable findings of the severity) or 2 (failure)."""
    options = {
        "path": {"default": ".", "nargs": "?", "help": "path, GitHub URL, mcp+http(s):// endpoint or pypi:name[==version]"},
        "--json": {"dest": "as_json", "action": "store_true", "help": "the report as JSON"},
        "--rules": {"default": "core", "choices": ["core", "all"], "help": "accepted; there is one rule set"},
        "--severity": {"default": "high", "choices": ["high", "medium", "none"], "help": "least risk of a reachable finding that fails"},
        "--explain": {"action": "store_true", "help": "whole call chains with files"},
    }
    p = argparse.ArgumentParser(prog="brightmill", description="What a language model can reach through your code.")
    for name, how in options.items():
        p.add_argument(name, **how)
    args = p.parse_args(argv)
    try:
        from pyspark.sql import SparkSession

        results = scan_target(SparkSession.builder.appName("brightmill").getOrCreate(), args.path, tell=_bar)
    except Exception as e:  # the exit code tells
        print("Error:", e, file=sys.stderr)
        sys.exit(2)
    print(json_report(results) if args.as_json else human_report(results, args.explain))
    code = exit_code(results, severity=args.severity)
    sys.exit(code)


if __name__ == "__main__":
    main()
