"""URL filters: all glob rules matched at once by a bit-parallel wildcard automaton.

A rule is a glob over the canonical URL: ``*`` stands for any run of characters, ``?`` for one
character, anything else for itself; a rule matches the whole URL. Rules are packed into Shift-And
masks of as many 64-bit words as they need. A rule of m characters has m + 1 states; a state before a
``*`` loops on every character. For each URL character all states of all rules advance together:
``D = ((D << 1) & B[c]) | (D & loops)``, with the carry between words. Batches advance one character
of all their URLs per step.

Canonical form (built-in expressions): trimmed; scheme and host lower-cased; user info, default port,
fragment and ``utm_*`` parameters removed; an empty path and a trailing slash dropped.

Defined results: a NULL URL has a NULL canonical form, matches nothing and is not blocked; an empty one
matches only rules that match the empty text; repeated rows each give a row; NULL ids are carried; no
rules, or an empty table, give no matches or no rows; extra columns are ignored; long URLs are matched
whole. Characters are Unicode code points.

Rules are a parameter: a list, or a table of them (``rules_of``) of at most ``RULE_BYTES``. RULES is an example that fits the
URLs of the test tables. As many URLs are matched at once as their states fit ``STATE_BYTES``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import rebatch

#: Most bytes of globs that are sent to every task; states of a batch.
RULE_BYTES, STATE_BYTES = 16 << 20, 32 << 20
#: (rule id, glob): hosts and paths that a crawl filter would refuse.
RULES = [
    (1, "*://*casino*"), (2, "*://*pills*"), (3, "*://*free-bets*"), (4, "*://*ads-track*"), (5, "*://ads.*"),
    (6, "*://*.example.org/es/?*"), (7, "*.html"), (8, "http://*"), (9, "*://*/login*"), (10, "*&session=*"),
    (11, "*://blog.*.example.net/*"), (12, "*?page=?&*"), (13, "*://m.*"), (14, "*/wp-admin/*"), (15, "*://???.*/en/9???*"),
    (16, "*xxx*"), (17, "*://*porn*"), (18, "*.exe"), (19, "*://*.example.com/de/*/*"), (20, "*/en/*7"),
]
#: Rules whose match blocks a URL; the others only tag it.
BLOCKING = (1, 2, 3, 4, 5, 9, 14, 16, 17, 18)


def canonical(url: Column) -> Column:
    """The canonical form of a URL column."""
    u = F.trim(url)
    u = F.regexp_replace(u, "#.*$", "")
    head = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    tail = F.substr(u, F.length(head) + F.lit(1))
    head = F.regexp_replace(head, "://[^@]*@", "://")
    head = F.regexp_replace(head, "^(http://.*):80$", "$1")
    head = F.regexp_replace(head, "^(https://.*):443$", "$1")
    tail = F.regexp_replace(tail, "([?&])utm_[a-z]+=[^&]*&?", "$1")
    tail = F.regexp_replace(tail, "[?&]+$", "")
    tail = F.regexp_replace(tail, "/$", "")
    return F.concat(head, tail)


class Automaton:
    """The packed rules."""

    def __init__(self, rules):
        self.ids = [r for r, _ in rules]
        chars: list[str | None] = []  # what the transition into each state reads: None nothing, "" anything
        loops, starts, accepts = [], [], []
        for _, glob in rules:
            state = len(chars)
            chars.append(None)
            starts.append(state)
            for c in glob:
                if c == "*":
                    loops.append(len(chars) - 1)
                else:
                    chars.append("" if c == "?" else c)
            accepts.append(len(chars) - 1)
        self.words = max(1, -(-len(chars) // 64))
        self.accepts = accepts
        self.start, self.loops = self._mask(starts), self._mask(loops)
        self.alphabet = np.array(sorted({ord(c) for c in chars if c}), np.uint32)
        some = [i for i, c in enumerate(chars) if c == ""]
        rows = [self._mask(some)]
        for a in self.alphabet.tolist():
            rows.append(self._mask(some + [i for i, c in enumerate(chars) if c and ord(c) == a]))
        self.reads = np.stack(rows)

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b >> 6] |= np.uint64(1) << np.uint64(b & 63)
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean (texts, rules)."""
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        known = (self.alphabet[at] == points) if len(self.alphabet) else np.zeros(len(points), bool)
        code = np.where(known, at + 1, 0)
        d = np.repeat(self.start[None, :], len(texts), 0)
        live = len(length)
        for step in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= step:
                live -= 1
            now = d[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:live] = (moved & self.reads[code[begin[:live] + step]]) | (now & self.loops)
        out = np.empty((len(texts), len(self.ids)), bool)
        for j, b in enumerate(self.accepts):
            out[order, j] = (d[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1) != 0
        return out


def rules_of(table: DataFrame, rule: str = "rule_id", glob: str = "glob", blocks: str = "blocks") -> tuple[list, tuple]:
    """(rules, blocking) for ``filtered`` from a table, such as a filter list read from files; its size is checked before it
    is collected. Rows with a NULL id or glob are left out; of an id with several globs each is a rule."""
    rows = table.select(F.col(rule).alias("i"), F.col(glob).alias("g"), F.coalesce(F.col(blocks), F.lit(False)).alias("b")).filter("i is not null and g is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("g") + 16)).first()[0] or 0
    if size > RULE_BYTES:
        raise ValueError(f"the rules have {size} bytes, {RULE_BYTES} at most are sent to every task")
    found = rows.orderBy("i", "g").collect()
    return [(r.i, r.g) for r in found], tuple(sorted({r.i for r in found if r.b}))


def filtered(pages: DataFrame, rules=RULES, blocking=BLOCKING, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, canonical_url, matched (rule ids in order, comma-separated) and blocked."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, canonical_url string, matched string, blocked boolean"
    rules, refuse = list(rules), set(blocking)

    def run(batches):
        automaton = Automaton(rules)
        bad = np.array([i in refuse for i in automaton.ids], bool)
        names = [str(i) for i in automaton.ids]
        rows = max(1, min(8192, STATE_BYTES // (8 * automaton.words + len(names))))
        for batch in rebatch(batches, rows):
            urls = batch.column(1)
            found = automaton.matches(pc.fill_null(urls, "").to_pylist())
            found &= np.asarray(urls.is_valid())[:, None]
            text = [",".join(names[j] for j in np.flatnonzero(row)) if row.any() else "" for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), urls, pa.array(text, pa.string()), pa.array((found & bad).any(1))], names=[key, "canonical_url", "matched", "blocked"])

    return pages.select(key, canonical(F.col(url)).alias("canonical_url")).mapInArrow(run, schema)


def _like(glob: str) -> str:
    out = "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in glob)
    return out.replace("'", "''")


SQL = f"""
WITH cut AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
parts AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head FROM cut),
halves AS (
  SELECT page_id,
    regexp_replace(regexp_replace(regexp_replace(head, '://[^@]*@', '://'), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') AS head,
    regexp_replace(regexp_replace(regexp_replace(substr(u, length(head) + 1), '([?&])utm_[a-z]+=[^&]*&?', '\\1', 'g'), '[?&]+$', ''), '/$', '') AS tail
  FROM parts),
urls AS (SELECT row_number() OVER () AS r, page_id, head || tail AS canonical_url FROM halves),
rules(id, pattern) AS (VALUES {", ".join(f"({i}, '{_like(g)}')" for i, g in RULES)})
SELECT any_value(page_id) AS page_id, any_value(canonical_url) AS canonical_url,
  coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE canonical_url LIKE pattern ESCAPE '\\'), '') AS matched,
  coalesce(bool_or(canonical_url LIKE pattern ESCAPE '\\' AND id IN {BLOCKING}), false) AS blocked
FROM urls, rules GROUP BY r
"""
