"""Readers: files as text, tables as strings, office documents, JSON logs.

Everything starts from Spark's own readers, so any store that Spark reads will
do; formats that Spark lacks are unpacked from ``binaryFile`` content in tasks.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from csv import Error as CsvError
from csv import reader as csv_reader
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.markup import html_markdown
from ..functions.text import file_kind, replaced_images, route

MOST_CHARS = 1_000_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_V = "{urn:schemas-microsoft-com:vml}"


def binary(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, route, content`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_kind("path").alias("kind"), route("path").alias("route"), "content")


def text(files: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """``path, text``: UTF-8, else GBK, at most ``most`` characters; null where neither fits."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                return None if b is None else decoded(b, most)
            except UnicodeDecodeError:
                return None

        return content.map(one)

    return files.select("path", read("content").alias("text"))


def csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A table of strings: nothing is inferred."""
    return spark.read.option("header", "true").option("inferSchema", "false").option("encoding", encoding).option("multiLine", "true").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str, holds: str | None = None) -> DataFrame:
    """An append-only log; lines that do not parse are left out, ``holds`` keeps those with a substring."""
    lines = spark.read.text(path)
    if holds:
        lines = lines.where(F.col("value").contains(holds))
    rows = lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return rows.where("ok").select("r.*")


#: Kinds of pictures that are kept.
PICTURES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")


def docx_parts(content: bytes) -> tuple[str, list[tuple[str, str, bytes]]]:
    """A Word document as Markdown, headings a level down, lists, tables and pictures in order; and (name, part, bytes) of its pictures, each part once."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{_W}body")
    targets = {}
    if "word/_rels/document.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(book.read("word/_rels/document.xml.rels"))}
    styles = {}
    if "word/styles.xml" in names:
        for x in ElementTree.fromstring(book.read("word/styles.xml")).iter(f"{_W}style"):
            name = x.find(f"{_W}name")
            styles[x.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    out: list[str] = []
    pictures: dict[str, tuple[str, str, bytes]] = {}

    def words(node: ElementTree.Element) -> str:
        return "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else t.text or "" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")).strip()

    def references(node: ElementTree.Element) -> Iterator[str]:
        found = [x.get(f"{_R}embed") for x in node.iter(f"{_A}blip")] + [x.get(f"{_R}id") for x in node.iter(f"{_V}imagedata")]
        for rid in found:
            part = targets.get(rid, "")
            part = part.lstrip("/") if part.startswith("/") else f"word/{part}"
            kind = "." + part.rpartition(".")[2] if "." in part.rpartition("/")[2] else ".png"
            if part in names and kind.lower() in PICTURES:
                if part not in pictures:
                    pictures[part] = (f"img_{len(pictures)}{kind}", part, book.read(part))
                name = pictures[part][0]
                yield f"![图{name[4:].partition('.')[0]}](images/{name})"

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            line, own = words(node), list(references(node))
            if line:
                style = node.find(f"{_W}pPr/{_W}pStyle")
                key = (style.get(f"{_W}val") or "") if style is not None else ""
                name = (styles.get(key) or key).lower()
                number = "".join(c for c in name if c.isdigit())
                if name == "title":
                    line = f"## {line}"
                elif name.startswith("heading"):
                    line = "#" * min(6, int(number or 1) + 1) + " " + line
                elif node.find(f"{_W}pPr/{_W}numPr") is not None or "list" in name:
                    line = f"- {line}"
                out.append(line)
            out += own or ([] if line else [""])
        elif node.tag == f"{_W}tbl":
            rows = [[words(c).replace("|", "\\|").replace("\n", " ") for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if rows:
                out += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:]), ""]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip(), list(pictures.values())


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[tuple[str, str]]]]:
    """(sheet, row number from 0, (column, value) of its cells) below each sheet's header row; a broken sheet is passed over."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = (targets.get(sheet.get(f"{_R}id")) or "").lstrip("/")
        try:
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        except (KeyError, ElementTree.ParseError):
            continue
        header: dict[str, str] = {}
        for i, row in enumerate(root.iter(f"{_S}row")):
            cells = []
            for c in row.iter(f"{_S}c"):
                v, place = c.find(f"{_S}v"), "".join(x for x in c.get("r", "") if x.isalpha())
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells.append((place, shared[int(value)] if c.get("t") == "s" and value else value))
            if i == 0:
                header = dict(cells)
            else:
                yield sheet.get("name", ""), i - 1, [(header.get(p, p), v) for p, v in cells]


def spreadsheets(files: DataFrame, cell: int = 2000) -> DataFrame:
    """``path, sheet, row, title, content``: a chunk for each row of each sheet that has anything."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for sheet, i, cells in xlsx_rows(content):
                        lines = [f"{k}: {v.strip()[:cell]}" for k, v in cells if v.strip()]
                        if lines:
                            rows.append((path, sheet, i, f"{sheet}-第{i + 2}行", "\n".join(lines)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "title", "content"])

    return files.where(F.col("kind") == "xlsx").select("path", "content").mapInPandas(run, "path string, sheet string, row int, title string, content string")


def decoded(content: bytes, most: int | None = MOST_CHARS) -> str:
    """UTF-8, else GBK; an error where neither fits."""
    try:
        return content.decode("utf-8-sig")[:most]
    except UnicodeDecodeError:
        return content.decode("gbk")[:most]


def csv_rows(content: bytes) -> Iterator[tuple[str, int, list[tuple[str, str]]]]:
    """As ``xlsx_rows``, of a table in UTF-8 or GBK; all values are texts, blank lines no rows."""
    rows = (r for r in csv_reader(io.StringIO(decoded(content, None), newline="")) if r)
    header = next(rows, [])
    for i, row in enumerate(rows):
        yield "sheet1", i, list(zip(header, row))


def json_markdown(text: str, title: str, cell: int) -> str:
    """JSON as Markdown: a section for each record of a list or key of an object; nested values as indented lines, cut to ``cell`` characters."""

    def lines(v: object) -> list[str]:
        plain = not isinstance(v, (dict, list))
        return [str(v)[:cell]] if plain else json.dumps(v, ensure_ascii=False, indent=2)[:cell].split("\n")

    data, out = json.loads(text), [f"# {title}", ""]
    if isinstance(data, list):
        for i, record in enumerate(data, 1):
            out.append(f"## 记录 {i}")
            if isinstance(record, dict):
                for k, v in record.items():
                    first, *more = lines(v)
                    out += [f"- {k}: {first}", *(f"  {x}" for x in more)]
            else:
                out += lines(record)
            out.append("")
    elif isinstance(data, dict):
        for k, v in data.items():
            out += [f"## {k}", *lines(v), ""]
    else:
        out += [*lines(data), ""]
    return "\n".join(out)


_PARSED = "path string, kind string, stage string, error string, markdown string, pictures array<struct<name:string,place:int,before:string,after:string,sha256:string,content:binary>>, rows array<struct<sheet:string,row:int,title:string,content:string>>"


def _pictured(markdown: str, pictures: list[tuple[str, str, bytes]], around: int) -> list[dict]:
    """Each picture with its first place in the text, in order, and what stands around it."""
    out = []
    for name, _, content in pictures:
        reference = next((m for m in re.finditer(r"!\[[^\]]*\]\(images/([^)]+)\)", markdown) if m[1] == name), None)
        start, end = reference.span() if reference else (-1, 0)
        out.append({
            "name": name, "place": start, "before": markdown[max(0, start - around) : start] if reference else "", "after": markdown[end : end + around] if reference else "",
            "sha256": hashlib.sha256(content).hexdigest(), "content": content,
        })
    return out


def parsed(files: DataFrame, cell: int = 2000, rows_most: int = 10_000, around: int = 100) -> DataFrame:
    """``path, kind, stage, error, markdown, pictures, rows``: each of ``files`` read by its kind, once.

    Texts, JSON, pages, Markdown and Word documents become ``markdown``, a title
    in front; tables become ``rows``, chunks of at most ``rows_most`` a file,
    counted after empty ones are left out. A file that cannot be read has the
    stage ("decode", "parse", "convert" or "route") and the error instead. Read
    the outputs from a staged copy: ``documents``, ``pictures``, ``table_rows``
    and ``quarantine`` each take a part of it.
    """

    def one(path: str, kind: str, way: str, content: bytes) -> dict:
        title = path.rpartition("/")[2]
        title = title[: -len(kind) - 1] if kind else title
        stage, found = "route", {"markdown": None, "pictures": None, "rows": None}
        try:
            if way in ("error", "pdf") or kind == "xls":
                raise ValueError(f"no reader for .{kind}")
            stage = "decode"
            text = decoded(content) if kind in ("txt", "md", "json", "html", "htm") else ""
            stage = "parse" if kind in ("json", "docx", "xlsx", "csv") else "convert"
            if kind == "json":
                found["markdown"] = json_markdown(text, title, cell)
            elif kind in ("html", "htm"):
                found["markdown"] = html_markdown(text, title)
            elif kind == "docx":
                body, pictures = docx_parts(content)
                found["markdown"] = f"# {title}\n\n{body}".strip()
                found["pictures"] = _pictured(found["markdown"], pictures, around)
            elif way == "table":
                made = []
                for sheet, i, cells in (xlsx_rows if kind == "xlsx" else csv_rows)(content):
                    lines = [f"{k}: {v[:cell]}" for k, v in cells if v.strip()]
                    if lines:
                        made.append({"sheet": sheet, "row": i, "title": f"{sheet}-第{i + 2}行", "content": "\n".join(lines)})
                    if len(made) == rows_most:
                        break
                found["rows"] = made
            else:
                found["markdown"] = text if kind == "md" else f"# {title}\n\n{text}"
            return {"path": path, "kind": kind, "stage": None, "error": None, **found}
        except (ValueError, KeyError, IndexError, RecursionError, zipfile.BadZipFile, ElementTree.ParseError, CsvError) as e:  # UnicodeDecodeError and JSON errors are ValueErrors
            return {"path": path, "kind": kind, "stage": stage, "error": f"{type(e).__name__}: {e}"[:500], "markdown": None, "pictures": None, "rows": None}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([one(row["path"], row["kind"], row["route"], row["content"] or b"")], schema=kind_of)

    kind_of = pa.schema([
        ("path", pa.string()), ("kind", pa.string()), ("stage", pa.string()), ("error", pa.string()), ("markdown", pa.string()),
        ("pictures", pa.list_(pa.struct([("name", pa.string()), ("place", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("sha256", pa.string()), ("content", pa.binary())]))),
        ("rows", pa.list_(pa.struct([("sheet", pa.string()), ("row", pa.int32()), ("title", pa.string()), ("content", pa.string())]))),
    ])
    return files.select("path", "kind", "route", "content").mapInArrow(run, _PARSED)


def pages_as_markdown(pages: DataFrame, closed: bool = False) -> DataFrame:
    """``pages(url, html)`` with ``markdown``: the page's own title in front, or its url; with ``closed``, character references without a semicolon stay."""
    kind = StructType([*pages.schema.fields, StructField("markdown", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [html_markdown(h, u or "", closed) for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "markdown"])

    return pages.mapInArrow(run, kind)


def documents(read: DataFrame) -> DataFrame:
    """``path, kind, text`` of files that became Markdown; "" for those that could not be read, as a user of the files expects."""
    return read.where((F.col("markdown").isNotNull() | F.col("error").isNotNull()) & ~F.col("kind").isin("csv", "xlsx", "xls")).select("path", "kind", F.coalesce("markdown", F.lit("")).alias("text"))


def pictures(read: DataFrame) -> DataFrame:
    """``path, name, place, before, after, sha256, content`` of the pictures in documents."""
    return read.select("path", F.explode("pictures").alias("p")).select("path", "p.*")


def distinct_pictures(found: DataFrame) -> DataFrame:
    """``sha256, content, uses``: each picture once, whatever files it is in."""
    return found.groupBy("sha256").agg(F.first("content").alias("content"), F.count("*").alias("uses"))


def table_rows(read: DataFrame) -> DataFrame:
    return read.select("path", F.explode("rows").alias("r")).select("path", "r.*")


def quarantine(read: DataFrame) -> DataFrame:
    """``path, kind, stage, error`` of files that could not be read."""
    return read.where("error IS NOT NULL").select("path", "kind", "stage", "error")


def with_summaries(texts: DataFrame, found: DataFrame, summaries: DataFrame) -> DataFrame:
    """``texts(path, text)`` with the references of pictures replaced by ``summaries(sha256, url, summary)``; references without one stay."""
    links = found.join(summaries, "sha256").select("path", F.concat(F.lit("images/"), F.col("name")).alias("target"), F.struct("url", "summary").alias("link"))
    maps = links.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "link")))).alias("links"))
    joined = texts.join(maps, "path", "left")
    return joined.withColumn("text", F.when(F.col("links").isNotNull(), replaced_images("text", "links")).otherwise(F.col("text"))).drop("links")


def word_documents(files: DataFrame) -> DataFrame:
    """``path, text`` of .docx files as Markdown; "" where one cannot be read."""
    return documents(parsed(files.where("kind = 'docx'"))).select("path", "text")
