"""Registry of further detectors: Python functions of (path, content), run beside the built-in plans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

_known: dict[str, object] = {}


def _key(detector, name=None) -> str:
    key = name or getattr(detector, "name", None) or getattr(detector, "__name__", None)
    if not key:
        raise ValueError("a detector needs a name, of its own or given")
    if key in _known:
        raise ValueError(f"there is a detector named {key!r} already")
    return key


def register_detector(what=None):
    """Register a function or an object with ``scan_file``; as a call, as ``@register_detector`` or as
    ``@register_detector("name")``. Names are unique."""
    if what is not None and not isinstance(what, str):
        _known[_key(what)] = what
        return what

    def wrap(detector):
        _known[_key(detector, what)] = detector
        return detector

    return wrap


def get_detectors() -> dict[str, object]:
    return dict(_known)


def get_detector(name: str):
    return _known.get(name)


def clear_registry() -> None:
    _known.clear()


def call_detector(detector, path: str, content: str) -> list:
    """Findings of one detector on one text; a detector that fails has none."""
    try:
        run = detector if callable(detector) else detector.scan_file
        return list(run(path, content) or [])
    except Exception:  # one detector must not stop a scan
        return []


_SCHEMA = "project string, path string, rel string, detector string, capability string, evidence string, lineno int, confidence double, step int, ord int, explanation string, impact string, risk_level string"
_TEXTS = ("capability", "evidence", "explanation", "impact", "risk_level")


def _number(kind, x, default, low, high):
    """``x`` as a number of the kind within its bounds, or the default."""
    try:
        return min(max(kind(x), low), high)
    except (TypeError, ValueError, OverflowError):
        return default


def finding_row(found, order: int) -> dict:
    """The fields of one finding of a custom detector (a mapping or an object). What has a wrong type becomes text or
    NULL, a confidence without a number 0.9."""
    get = found.get if isinstance(found, dict) else lambda name: getattr(found, name, None)
    texts = {k: None if (v := get(k)) is None else str(v) for k in _TEXTS}
    return texts | {"lineno": _number(int, get("lineno"), None, -(2**31), 2**31 - 1), "confidence": _number(float, get("confidence"), 0.9, 0.0, 1.0), "step": 1, "ord": order}


def custom_findings(files: DataFrame, detectors: dict | None = None) -> DataFrame:
    """Findings of registered detectors over files(project, path, rel, content); a detector, or a finding, that
    fails is left out and stops nothing."""
    chosen = get_detectors() if detectors is None else detectors
    arrow = to_arrow_schema(_parse_datatype_string(_SCHEMA))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    text = (r["content"] or b"").decode()
                except UnicodeDecodeError:
                    continue
                for name, detector in chosen.items():
                    for n, f in enumerate(call_detector(detector, r["path"], text)):
                        try:
                            rows.append({k: r[k] for k in ("project", "path", "rel")} | finding_row(f, n) | {"detector": name})
                        except Exception:  # an object whose attributes or texts fail
                            continue
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("project", "path", "rel", F.col("content").cast("binary").alias("content")).mapInArrow(run, _SCHEMA)
