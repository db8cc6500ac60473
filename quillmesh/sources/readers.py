"""Files of many kinds as Markdown, one row per file, failures as rows.

``read_folder`` lists a folder with Spark's binary source and converts each file
where it lies; nothing is collected. Kinds whose parser needs a library that is
not installed (workbooks, slides, images) give an error row.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDEST = 40


def decode(raw: bytes) -> str:
    """UTF-8 with or without a mark, else the Windows code page."""
    for kind in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(kind)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def cell(text: object) -> str:
    return re.sub(r"\s*\n\s*", " ", str(text)).replace("|", "\\|").strip()


def markdown_table(rows: list[list[str]], widest: int | None = None) -> str:
    """Rows as a table without empty rows and columns; sheets have a ``widest``."""
    rows = [r[:widest] for r in rows if any(c.strip() for c in r[:widest])]
    if not rows:
        return ""
    width = max(map(len, rows))
    keep = [i for i in range(width) if any(i < len(r) and r[i].strip() for r in rows)]
    lines = ["| " + " | ".join(cell(r[i]) if i < len(r) else "" for i in keep) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * len(keep), *lines[1:]])


def sheet_markdown(grid: list[list[str]]) -> str:
    """Leading rows with a single cell are titles; the rest is one table."""
    rows = [r for r in grid if any(c.strip() for c in r)]
    titles = []
    while rows and sum(bool(c.strip()) for c in rows[0]) == 1 and len(rows) > 1:
        titles.append(next(c for c in rows.pop(0) if c.strip()))
    return "\n\n".join([*(f"**{cell(t)}**" for t in titles), markdown_table(rows, WIDEST)]).strip()


def text_markdown(raw: bytes) -> tuple[str, int, str]:
    text = decode(raw).replace("\r\n", "\n").replace("\r", "\n")
    return text, text.count("\n") + bool(text and not text.endswith("\n")), "lines"


def csv_markdown(raw: bytes) -> tuple[str, int, str]:
    text = decode(raw)
    try:
        kind = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
    except csv.Error:
        kind = csv.excel
    rows = list(csv.reader(io.StringIO(text), kind))
    return markdown_table(rows), max(0, len(rows) - 1), "rows"


def json_markdown(raw: bytes) -> tuple[str, int, str]:
    """Indented; malformed text is kept as it is."""
    text = decode(raw)
    try:
        value = json.loads(text)
        text = json.dumps(value, indent=2, ensure_ascii=False)
        n = len(value) if isinstance(value, list) else 1
    except ValueError:
        n = 1
    return f"```json\n{text}\n```", n, "records"


def xml_markdown(raw: bytes) -> tuple[str, int, str]:
    """Elements as headings; children that repeat a tag as the rows of a table."""
    root = ET.fromstring(raw)
    name = lambda e: re.sub(r"^\{.*\}", "", e.tag)
    out: list[str] = []

    def fields(e: ET.Element) -> dict[str, str]:
        got = {f"@{re.sub(r'^{.*}', '', k)}": v for k, v in e.attrib.items()}
        if (e.text or "").strip():
            got[""] = e.text.strip()
        for c in e:
            if len(c) == 0:
                got[name(c)] = (c.text or "").strip()
        return got

    todo: list[tuple[ET.Element, int]] = [(root, 1)]
    while todo:
        e, depth = todo.pop()
        out.append("#" * min(depth, 6) + " " + name(e))
        out += [f"- {k}: {v}" if k else v for k, v in fields(e).items()]
        groups: dict[str, list[ET.Element]] = {}
        for c in e:
            if (c.tail or "").strip():
                out.append(c.tail.strip())
            groups.setdefault(c.tag, []).append(c)
        later = []
        for same in groups.values():
            flat = all(len(g) == 0 for c in same for g in c)
            if len(same) > 1 and flat and any(len(c) or c.attrib for c in same):
                rows = [fields(c) for c in same]
                heads = list(dict.fromkeys(k for r in rows for k in r))
                out.append(markdown_table([[h or name(same[0]) for h in heads], *([r.get(h, "") for h in heads] for r in rows)]))
            else:
                later += [c for c in same if len(c) or c.attrib]
        todo += [(c, depth + 1) for c in reversed(later)]
    return "\n\n".join(x for x in out if x), 1, "files"


def html_text(page: str) -> str:
    """Tags dropped, entities decoded, white space collapsed."""
    body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", " ", page)
    return re.sub(r"\s+", " ", html.unescape(body)).strip()


def mail_markdown(raw: bytes) -> tuple[str, int, str]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(("plain",))
    if body is not None:
        text = body.get_content()
    else:
        page = m.get_body(("html",))
        text = html_text(page.get_content()) if page is not None else ""
    try:
        when = m["date"].datetime.isoformat() if m["date"] else ""
    except (AttributeError, TypeError, ValueError):
        when = str(m["date"])
    heads = [(k, str(m[k] or "")) for k in ("from", "to", "cc", "subject")] + [("date", when)]
    names = [a.get_filename() or "unnamed" for a in m.iter_attachments()]
    lines = [f"- {k}: {v}" for k, v in heads if v.strip()] + ([f"- attachments: {', '.join(names)}"] if names else [])
    return "\n".join(lines) + "\n\n" + text.strip(), 1, "messages"


def page_markdown(raw: bytes) -> tuple[str, int, str]:
    return html_text(decode(raw)), 1, "pages"


READERS: dict[str, Callable[[bytes], tuple[str, int, str]]] = {
    "txt": text_markdown, "md": text_markdown, "log": text_markdown, "csv": csv_markdown, "tsv": csv_markdown, "json": json_markdown,
    "xml": xml_markdown, "eml": mail_markdown, "html": page_markdown, "htm": page_markdown,
}

CONVERTED = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("units", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("error", T.StringType())])


def convert(suffix: str, raw: bytes) -> dict:
    reader = READERS.get(suffix.lower())
    if reader is None:
        return {"markdown": None, "units": None, "unit": None, "error": f"no reader for .{suffix}"}
    try:
        text, units, unit = reader(bytes(raw))
        return {"markdown": text, "units": units, "unit": unit, "error": None}
    except Exception as e:  # one bad file must not fail the folder
        return {"markdown": None, "units": None, "unit": None, "error": f"{type(e).__name__}: {e}"}


@F.pandas_udf(CONVERTED)
def converted(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([convert(s, c) for s, c in zip(suffix, content, strict=True)], columns=["markdown", "units", "unit", "error"])


def read_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, markdown, units, unit, error) of the files of one folder;
    hidden and lock files are skipped, and so are files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    named = files.withColumn("name", F.substring_index("path", "/", -1)).filter(~F.col("name").rlike(r"^(\.|~\$|_)"))
    got = named.withColumn("c", converted(F.lower(F.substring_index("name", ".", -1)), F.col("content")))
    return got.select("path", "name", "length", "c.*")


def splice(text: str, blocks: list[str], mark: str = "<!-- image -->") -> str:
    """The n-th block in place of the n-th mark; marks without a block stay."""
    parts = text.split(mark)
    out = [parts[0]]
    for i, p in enumerate(parts[1:]):
        out += [blocks[i] if i < len(blocks) else mark, p]
    return "".join(out)


def question_list(text: str) -> list[dict[str, str]]:
    """Sections "## Q1 Title" with a question and a reference paragraph."""
    out = []
    for m in re.finditer(r"(?ms)^##\s+([A-Z]\d+)\b[ .:-]*([^\n]*)\n(.*?)(?=^##\s|\Z)", text):
        body = m[3]
        ask = re.search(r"(?im)^\**question\**\s*:?\**\s*(.+)$", body)
        ref = re.search(r"(?ims)^\**reference\**\s*:?\**\s*(.+?)\s*\Z", body)
        out.append({"id": m[1], "title": m[2].strip(), "question": ask[1].strip() if ask else "", "reference": ref[1].strip() if ref else ""})
    return out


def spliced(text: Column, blocks: Column, mark: str = "<!-- image -->") -> Column:
    """:func:`splice` as an expression: ``blocks`` is an array of texts."""
    parts = F.split(text, re.escape(mark))
    after = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    put = F.slice(blocks, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(parts[0], F.array_join(F.zip_with(after, put, lambda p, b: F.concat(F.coalesce(b, F.lit(mark)), p)), ""))


def questions(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, id, title, question, reference) of the sections of Markdown pages."""
    kind = dict(pages.dtypes)[id_col]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, q["id"], q["title"], q["question"], q["reference"]) for i, t in zip(b[id_col], b[text_col], strict=True) for q in question_list(t or "")]
            yield pd.DataFrame(rows, columns=[id_col, "id", "title", "question", "reference"])

    return pages.select(id_col, text_col).mapInPandas(read, f"{id_col} {kind}, id string, title string, question string, reference string")
