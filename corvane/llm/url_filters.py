"""URL filters: all glob rules at once, by a bit-parallel automaton.

The rules become one Shift-And machine. Each pattern takes a run of bits in a row
of 64-bit words, one bit per position; a bit that stands before a star keeps itself
alive while the star's class of characters goes by. One step per character of the
canonical URL (host, then path) moves every pattern of every URL of a batch:

    next = ((state << 1 | first) & letter[c]) | (state & loop[c])

Shifts carry between the words, but never into another pattern, whose first bit is
set by `first` only at the start of the URL. A state that reaches a pattern's
accepting bit (in a star behind its last letter, or at the URL's end) is a match.

A rule is a host with an optional path, as in `example.org/es/`. It fits its host
and all subdomains, if the path starts with the rule's. Longest rule wins; on equal
length the first listed. A URL that no rule fits gets the verdict of the glob list:
block if a block glob matches, else allow; without a host: block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bounded_batches

#: Fixed rules (verdict, host and path), as the contract gives them.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Globs over the canonical URL that decide the rest: a star in the host part stays
#: within the host, one in the path takes anything.
BLOCK_GLOBS = ("*casino*/*", "*pills*/*", "*free-bets*/*", "*porn*/*", "*/*/wp-login*", "*/cgi-bin/*", "*/*.exe", "*/*.apk")

#: URLs are simulated up to this many at once, in order of length.
_AT_ONCE = 4096


class GlobMachine:
    """Patterns: letters and stars; a star before the first `/` does not cross it."""

    def __init__(self, patterns: Sequence[str]):
        self.patterns = list(patterns)
        cells: list[tuple[int, int]] = []  # (letter, or -1 at a pattern's start; class of the star behind: 0 none, 1 host, 2 any)
        first, accept = [], []
        for pattern in self.patterns:
            first.append(len(cells))
            cells.append((-1, 0))
            in_host = True
            for c in pattern.encode():
                if c == 0x2A:
                    cells[-1] = (cells[-1][0], max(cells[-1][1], 1 if in_host else 2))
                else:
                    in_host &= c != 0x2F
                    cells.append((c, 0))
            accept.append(len(cells) - 1)
        self.width = max(1, -(-len(cells) // 64))
        self.letter = np.zeros((256, self.width), np.uint64)
        self.loop = np.zeros((256, self.width), np.uint64)
        self.start = np.zeros(self.width, np.uint64)
        self.accept = accept
        for i, (letter, star) in enumerate(cells):
            bit = np.uint64(1 << i % 64)
            if letter >= 0:
                self.letter[letter, i // 64] |= bit
            if star:
                self.loop[:, i // 64] |= bit
                if star == 1:
                    self.loop[0x2F, i // 64] &= ~bit
        for i in first:
            self.start[i // 64] |= np.uint64(1 << i % 64)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: URL by pattern."""
        out = np.zeros((len(urls), len(self.patterns)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        for at in range(0, len(order), _AT_ONCE):
            rows = order[at : at + _AT_ONCE]
            sizes = np.array([len(urls[i]) for i in rows])
            flat = np.frombuffer(b"".join(urls[i] for i in rows), np.uint8)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            state = np.tile(self.start, (len(rows), 1))
            for k in range(int(sizes[0]) if len(sizes) else 0):
                live = int(np.searchsorted(-sizes, -k, "left"))  # sizes descend
                c, now = flat[begins[:live] + k], state[:live]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:live] = (moved & self.letter[c]) | (now & self.loop[c])
            for p, bit in enumerate(self.accept):
                out[rows, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for no `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:end], rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return host.translate(_LOWER), tail[:stop]


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def judge(urls: list[str | None], machine: GlobMachine, rules: Sequence[tuple[str, str]]) -> tuple[list, list, list, list]:
    """rules come first among the machine's patterns, two for each: host, subdomains."""
    parts = [split_url(u) for u in urls]
    hit = machine.matches([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
    fits = hit[:, 0 : 2 * len(rules) : 2] | hit[:, 1 : 2 * len(rules) : 2]
    spam = hit[:, 2 * len(rules) :].any(axis=1)
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    chosen, verdict = [], []
    for row, (host, _) in enumerate(parts):
        best = next((i for i in rank if fits[row, i]), None)
        chosen.append(None if best is None else rules[best][1])
        verdict.append(rules[best][0] if best is not None else "block" if spam[row] or not host else "allow")
    return [h for h, _ in parts], [p for _, p in parts], chosen, verdict


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict (allow or block).

    A null URL or one without `://` has an empty host and path and is blocked, as
    nothing tells where it comes from. Repeated rows and null ids each keep a row;
    other columns are not read. One narrow pass: no shuffle.
    """
    bounded_batches(pages.sparkSession)
    stars = [glob for _, rule in rules for glob in (f"{rule}*", f"*.{rule}*")] + list(block_globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = GlobMachine(stars)
        for batch in batches:
            found = judge(batch.column("url").to_pylist(), machine, rules)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.string()) for x in found)], names=["id", "host", "path", "rule", "verdict"])

    source = pages.selectExpr(f"cast(`{id_column}` as long) as id", f"`{url_column}` as url")
    return source.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_column)


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_GLOB_SQL = " or ".join("regexp_matches(host || path, '^" + "".join("[^/]*" if c == "*" and "/" not in g[:i] else ".*" if c == "*" else "[.]" if c == "." else c for i, c in enumerate(g)) + "$')" for g in BLOCK_GLOBS)
OP5_SQL = f"""
with parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), fits as (
  select page_id, host, path, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/'
  end as rule from split
)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when host = '' or {_GLOB_SQL} then 'block' else 'allow' end as verdict
from fits
"""
