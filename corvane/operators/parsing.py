"""Web pages and text to markdown, sections and tables. One Python pass per row set;
rows are pages, so tasks stay small."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import sliced

SECTION = "struct<path:string,parents:array<string>,heading:string,level:int,text:string,start:int,stop:int>"
TABLE = "struct<caption:string,headers:array<string>,rows:array<map<string,string>>,start:int,stop:int>"
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$")


class _Markdown(HTMLParser):
    """Blocks become lines, headings #, table rows pipes; scripts and styles go."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.cells, self.cell, self.skip, self.rows = [], None, None, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "br", "li", "article", "section", "ul", "ol"):
            self.parts.append("\n")
        elif tag == "table":
            self.rows = 0
            self.parts.append("\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]|p|div", tag):
            self.parts.append("\n")
        elif tag in ("td", "th") and self.cells is not None and self.cell is not None:
            self.cells.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.cells:
            self.parts.append("| " + " | ".join(self.cells) + " |\n")
            if not self.rows:
                self.parts.append("|" + " --- |" * len(self.cells) + "\n")
            self.rows, self.cells = self.rows + 1, None

    def handle_data(self, data):
        if not self.skip:
            (self.cell if self.cell is not None else self.parts).append(data)


def markdown_of(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    lines = [" ".join(line.split()) for line in "".join(parser.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_markdown(pages: DataFrame, column: str = "html") -> DataFrame:
    @sliced("string")
    def convert(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else markdown_of(h))

    return pages.withColumn("markdown", convert(column))


def sections_of(text: str) -> list[dict]:
    """Flat sections with paths 1.2.1: own text up to the next heading, stop at the next
    heading of the same or a higher level; without a heading one section, Document."""
    found = list(_HEADING.finditer(text))
    if not found:
        return [dict(path="1", parents=[], heading="Document", level=1, text=text.strip(), start=0, stop=len(text))]
    out, stack, counts = [], [], {}
    for i, m in enumerate(found):
        level = len(m[1])
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1] if stack else ""
        counts[parent] = counts.get(parent, 0) + 1
        path = f"{parent}.{counts[parent]}" if parent else str(counts[parent])
        stop = next((n.start() for n in found[i + 1 :] if len(n[1]) <= level), len(text))
        own = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)].strip()
        out.append(dict(path=path, parents=[s[2] for s in stack], heading=m[2], level=level, text=own, start=m.start(), stop=stop))
        stack.append((level, path, m[2]))
    return out


def tables_of(text: str) -> list[dict]:
    """Pipe tables: a header line with a bar, a rule below, rows until a line without one."""
    cut = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    lines, out, at, offsets = text.split("\n"), [], 0, [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)
    while at + 1 < len(lines):
        if "|" in lines[at] and _RULE.match(lines[at + 1]):
            headers, end, rows = cut(lines[at]), at + 2, []
            while end < len(lines) and "|" in lines[end]:
                cells = cut(lines[end])
                rows.append(dict(zip(headers, cells + [""] * (len(headers) - len(cells)), strict=False)))
                end += 1
            before = lines[at - 1].strip() if at and lines[at - 1].strip() and not lines[at - 1].startswith("#") else None
            out.append(dict(caption=before, headers=headers, rows=rows, start=offsets[at], stop=min(offsets[end] - 1, len(text))))
            at = end
        else:
            at += 1
    return out


def _exploded(df: DataFrame, column: str, make, kind: str, keep: tuple[str, ...]) -> DataFrame:
    @sliced(f"array<{kind}>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: make(t) if t else [])

    return df.select(*keep, F.posexplode(parse(column)).alias("place", "_s")).select(*keep, "place", "_s.*")


def extract_sections(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Flat sections with path, parents, heading, level, own text and range."""
    return _exploded(docs, column, sections_of, SECTION, keep)


def extract_tables(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return _exploded(docs, column, tables_of, TABLE, keep)


def section_of_offset(tables: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """The deepest section around each table's start (none: null)."""
    s = sections.select(key, F.col("start").alias("_a"), F.col("stop").alias("_b"), "level", "path")
    around = tables.join(s, (tables[key] == s[key]) & (F.col("start") >= F.col("_a")) & (F.col("start") < F.col("_b")), "left").drop(s[key])
    return around.groupBy(key, "start").agg(F.max_by("path", F.struct("level", "path")).alias("section_path"))


def linearise_table(df: DataFrame) -> DataFrame:
    """Caption, header, rule and rows as markdown."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform("rows", lambda r: line(F.transform("headers", lambda h: F.coalesce(r[h], F.lit("")))))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("headers")))
    return df.withColumn("linearised", F.concat_ws("\n", "caption", line(F.col("headers")), rule, F.array_join(body, "\n")))


def parse_status(df: DataFrame, suffixes: tuple[str, ...] = ("html", "md", "txt")) -> DataFrame:
    """df (suffix, content binary, n_sections, warnings): FAILED with its warning,
    PARTIAL for content with warnings, else SUCCEEDED."""
    failed = F.when(~F.lower("suffix").isin(*suffixes), "unsupported").when(F.length("content") == 0, "empty").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8").when(F.coalesce("n_sections", F.lit(0)) == 0, "no content")
    status = F.when(failed.isNotNull(), "FAILED").when(F.size("warnings") > 0, "PARTIAL").otherwise("SUCCEEDED")
    return df.withColumn("parse_status", status).withColumn("warning", failed)
