"""Loaders: text, Markdown, CSV, HTML, kinds of files by name and first bytes."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import turtle

#: Languages by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "rb": "ruby", "php": "php", "swift": "swift",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "fs": "fsharp", "ex": "elixir", "exs": "elixir",
    "erl": "erlang", "hs": "haskell", "lua": "lua", "pl": "perl", "r": "r", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql",
    "yml": "yaml", "yaml": "yaml", "toml": "toml", "json": "json", "xml": "xml", "html": "html", "css": "css",
}
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Kinds by first bytes (hexadecimal).
MAGIC = (
    ("255044462D", "application/pdf"), ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"),
    ("494433", "audio/mpeg"), ("FFFB", "audio/mpeg"), ("FFF3", "audio/mpeg"), ("664C6143", "audio/flac"), ("4F676753", "audio/ogg"), ("504B0304", "application/zip"),
)
#: Elements whose text isn't read, and those that hold the main text, in order.
DROPPED = frozenset(("script", "style", "noscript", "nav", "aside", "header", "footer", "form"))
ROOTS = ("article", "main", "body")


def line_count(text: Column) -> Column:
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return n + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def heading_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^\s{0,3}#{1,6}\s+"))


def fence_count(text: Column) -> Column:
    return F.floor(F.regexp_count(text, F.lit(r"(?m)^\s{0,3}```")) / 2)


def language(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.substring_index(name, ".", -1)))


def base_mime(mime: Column) -> Column:
    """A MIME type without its parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(mime, ";", 1)))


def sniffed(content: Column) -> Column:
    """MIME type by first bytes; null where they don't tell. A ZIP archive that names word/document.xml early is a DOCX file."""
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(MAGIC):
        out = F.when(F.substring(content, 1, len(prefix) // 2) == F.unhex(F.lit(prefix)), kind).otherwise(out)
    word = F.position(F.lit("word/document.xml"), F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0
    out = F.when((out == "application/zip") & word, DOCX).otherwise(out)
    inner = F.when(F.substring(content, 9, 4) == F.unhex(F.lit("57415645")), "audio/wav").when(F.substring(content, 9, 4) == F.unhex(F.lit("57454250")), "image/webp")
    return F.when(F.substring(content, 1, 4) == F.unhex(F.lit("52494646")), inner).otherwise(out)


#: Loaders by MIME type and by extension.
BY_MIME = {"text/plain": "text", "text/markdown": "markdown", "text/csv": "csv", "text/html": "html", "application/xhtml+xml": "html", "application/pdf": "pdf", DOCX: "docx", **{f"image/{k}": "image" for k in ("jpeg", "png", "gif", "webp")}, **{f"audio/{k}": "audio" for k in ("mpeg", "wav", "flac", "ogg")}}
BY_EXTENSION = {"txt": "text", "md": "markdown", "markdown": "markdown", "csv": "csv", "tsv": "csv", "htm": "html", "html": "html", "pdf": "pdf", "docx": "docx"}


def dispatched(files: DataFrame, fallback: str | None = "text") -> DataFrame:
    """files (path, content, and mime_type where known) with loader: by the MIME type, else the first bytes, else the extension, else the fallback."""
    table = lambda d, key: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)
    told = table(BY_MIME, base_mime(F.col("mime_type"))) if "mime_type" in files.columns else F.lit(None).cast("string")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_name = F.coalesce(table(BY_EXTENSION, ext), F.when(table(LANGUAGES, ext).isNotNull(), "code"))
    return files.withColumn("loader", F.coalesce(told, table(BY_MIME, sniffed(F.col("content"))), by_name, F.lit(fallback)))


def files(spark, path: str) -> DataFrame:
    """path, content, loader of the files of a folder."""
    return dispatched(spark.read.format("binaryFile").load(path).select("path", "content"))


def load(files: DataFrame) -> DataFrame:
    """path, loader, text, error, info (JSON) of files (path, content): each by its own loader. Images and sound need a provider and fail here."""
    x = files if "loader" in files.columns else dispatched(files)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, loader, content in zip(f["path"], f["loader"], f["content"], strict=True):
                try:
                    text, info = read_file(path, loader, bytes(content or b""))
                    rows.append((path, loader, text, None, json.dumps(info, sort_keys=True)))
                except Exception as error:
                    rows.append((path, loader, None, str(error)[:2000] or type(error).__name__, None))
            yield pd.DataFrame(rows, columns=["path", "loader", "text", "error", "info"])

    return x.select("path", "loader", "content").mapInPandas(run, "path string, loader string, text string, error string, info string")


def read_file(path: str, loader: str, content: bytes) -> tuple[str, dict]:
    """Text of one file and what its loader counts."""
    text = content.decode("utf-8", "replace")
    if loader == "text":
        return text, {"line_count": text.count("\n") + (bool(text) and not text.endswith("\n"))}
    if loader == "markdown":
        return text, {"heading_count": len(re.findall(r"^\s{0,3}#{1,6}\s+", text, re.M)), "code_block_count": len(re.findall(r"^\s{0,3}```", text, re.M)) // 2}
    if loader == "csv":
        body, cut = csv_text(content.decode("utf-8-sig", "replace"))
        return body, {"truncated": cut}
    if loader == "html":
        return html_text(text), {}
    if loader == "docx":
        return docx_text(content)[0], {"headings": docx_text(content)[1]}
    if loader == "code":
        return text, {"language": LANGUAGES.get(path.rsplit(".", 1)[-1].lower())}
    if loader == "pdf":
        return pdf_text(content)
    raise ValueError(f"no loader for {loader}")


def pdf_text(content: bytes) -> tuple[str, dict]:
    """Pages joined by blank lines, and each page's offset; pypdf is needed, which may be missing."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("reading PDF files needs pypdf") from error
    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise ValueError("the PDF file is encrypted")
    parts, offsets, at = [], {}, 0
    for k, page in enumerate(reader.pages):
        part = page.extract_text() or ""
        offsets[str(k + 1)] = at
        parts.append(part)
        at += len(part) + 2
    return "\n\n".join(parts), {"page_offsets": offsets}


def triples(lines: DataFrame) -> DataFrame:
    """uri, primary, aliases, type_hint of the subjects of N-Triples lines (value): ``turtle.labelled`` of what they say."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    part = lambda k: F.regexp_extract("value", line, k)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    x = lines.select(bare(part(1)).alias("s"), part(2).alias("p"), part(3).alias("o")).filter("p <> ''")

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(turtle.unescaped)

    quoted = F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)
    literal = F.col("o").startswith('"')
    x = x.withColumn("literal", literal).withColumn("o", F.when(~literal, bare(F.col("o"))).otherwise(quoted))
    escaped = F.contains("o", F.lit("\\"))  # few: the rest stays in the JVM
    return turtle.labelled(x.filter(~escaped).unionByName(x.filter(escaped).withColumn("o", plain("o"))))


def csv_text(raw: str, cap: int = 10_000) -> tuple[str, bool]:
    """Rows as 'header: value' paragraphs after a paragraph of the headers, and whether rows were left out."""
    raw = raw.removeprefix("﻿")
    try:
        delimiter = csv.Sniffer().sniff(raw[:4096], ",;\t|").delimiter
    except csv.Error:  # the commonest of the header line
        delimiter = max(",;\t|", key=raw.split("\n", 1)[0].count)
    rows = list(csv.reader(io.StringIO(raw), delimiter=delimiter))
    if not rows:
        return "", False
    head = [h.strip() for h in rows[0]]
    body = ["; ".join(f"{h}: {v}" for h, v in zip(head, [*r, *[""] * len(head)], strict=False)) for r in rows[1 : cap + 1]]
    return "\n\n".join(["CSV columns: " + ", ".join(head), *body]), len(rows) - 1 > cap


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes | None) -> tuple[str, int]:
    """Paragraphs of a DOCX file, one a line, headings as Markdown (levels 1 to 6), blank ones kept; and how many headings.

    Null or empty content gives no text; what is not a DOCX file raises ValueError."""
    if not content:
        return "", 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            styles = ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else []
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ValueError(f"malformed DOCX: {e}") from e
    named = {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val", "") for s in styles if s.tag == f"{_W}style" and s.find(f"{_W}name") is not None}
    lines, headings = [], 0
    for p in body.findall(f"{_W}p") if body is not None else ():
        text = "".join({"t": e.text or "", "tab": "\t", "br": "\n"}.get(e.tag.removeprefix(_W), "") for r in p.iter(f"{_W}r") for e in r)
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style_id = style.get(f"{_W}val", "") if style is not None else ""
        kind, _, level = named.get(style_id, style_id).lower().partition(" ")
        if not text.strip():
            text = ""
        elif kind == "heading" and level.strip().isdigit():
            text = "#" * min(max(int(level), 1), 6) + " " + text
            headings += 1
        lines.append(text)
    return "\n".join(lines), headings


def docx_loaded(content: DataFrame) -> DataFrame:
    """path, text, headings, error of rows (path, content) of DOCX files; a malformed file has an error and no text."""

    def one(raw) -> tuple:
        try:
            return (*docx_text(raw), None)
        except ValueError as e:
            return None, None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(bytes(c) if c is not None else None) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "text": [g[0] for g in got], "headings": pd.array([g[1] for g in got], "Int64"), "error": [g[2] for g in got]})

    return content.select("path", "content").mapInPandas(run, "path string, text string, headings long, error string")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.parts: list[tuple[frozenset, str]] = []
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if "title" in self.stack:
            self.title.append(data)
        elif data.strip() and DROPPED.isdisjoint(self.stack):
            self.parts.append((frozenset(self.stack), data.strip()))


def html_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    body = ""
    for root in (*ROOTS, None):
        if body := "\n".join(t for path, t in p.parts if root is None or root in path):
            break
    title = " ".join("".join(p.title).split())
    return body if not title or body.startswith(title) else f"# {title}\n\n{body}"


def html_loaded(pages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "text": [html_text(h or "") for h in f["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")
