"""File formats to documents: one Arrow-batched function over (path, bytes). A file that can't be read gives its error, never a failed task."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract

SCHEMA = "path string, format string, title string, markdown string, plain_text string, source_type string, provenance map<string,string>, error string"
#: Suffixes that a folder scan takes.
SUFFIXES = ("json", "md", "rst", "org", "txt", "yaml", "yml", "toml", "log", "html", "htm", "ipynb", "jsonl", "xml", "opml", "rss", "atom", "eml", "vtt", "srt", "pdf", "docx", "odt", "pptx", "xlsx", "csv")
#: Bytes: files above are left out; an archive's entries and their declared sum are bounded.
MOST_BYTES, ENTRY_BYTES, DECLARED_BYTES = 50 << 20, 100 << 20, 250 << 20


def _doc(markdown: str, plain: str | None = None, title: str | None = None, source_type: str = "file", **provenance: object) -> dict:
    return {"title": title, "markdown": markdown, "plain_text": markdown if plain is None else plain, "source_type": source_type, "provenance": {k: str(v) for k, v in provenance.items() if v not in (None, "")}}


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def parse_json(data: bytes) -> dict:
    value = json.loads(data)
    content, meta = value.get("content") or {}, value.get("metadata") or {}
    if not isinstance(content, dict) or "markdown" not in content:
        raise ValueError("not a stored extraction")
    return _doc(content["markdown"], content.get("plain_text", ""), meta.get("title"), meta.get("source_type") or "file", **{k: v for k, v in meta.items() if isinstance(v, (str, int, float))})


def parse_notebook(data: bytes) -> dict:
    book = json.loads(data)
    language = book.get("metadata", {}).get("kernelspec", {}).get("language", "")
    cells = []
    for cell in book.get("cells", []):
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        if source.strip():
            cells.append(f"```{language}\n{source}\n```" if cell.get("cell_type") == "code" else source)
    return _doc("\n\n".join(cells), source_type="notebook")


def parse_jsonl(data: bytes) -> dict:
    out = []
    for line in _text(data).splitlines():
        try:
            row = json.loads(line)
        except ValueError:
            continue
        value = next((row[k] for k in ("text", "content", "body", "message", "value") if isinstance(row, dict) and isinstance(row.get(k), str)), None)
        if value:
            out.append(value)
    return _doc("\n".join(out))


def parse_xml(data: bytes) -> dict:
    try:
        texts = [t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip()]
        return _doc("\n".join(texts))
    except ElementTree.ParseError:
        return _doc(_text(data))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def parse_feed(data: bytes) -> dict:
    entries = [e for e in ElementTree.fromstring(data).iter() if _local(e) in ("item", "entry")]
    parts, first, ids, links = [], None, [], []
    for e in entries:
        field = {_local(c): (c.text or c.get("href") or "").strip() for c in e}
        first = first or field.get("title")
        ids.append(field.get("guid") or field.get("id") or "")
        links.append(field.get("link", ""))
        body = field.get("encoded") or field.get("content") or field.get("summary") or field.get("description") or ""
        parts.append("\n\n".join(x for x in (f"## {field['title']}" if field.get("title") else "", re.sub(r"<[^>]+>", "", body)) if x))
    return _doc("\n\n".join(parts), title=first, source_type="feed", entry_ids=",".join(filter(None, ids)), links=",".join(filter(None, links)))


def parse_mail(data: bytes) -> dict:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain",)) or m.get_body(("html",))
    text = body.get_content() if body else ""
    if body is not None and body.get_content_type() == "text/html":
        text = extract(text)["markdown"] or ""
    references = str(m.get("References", "")).split()
    return _doc(text.strip(), title=m.get("Subject"), source_type="email", email_from=m.get("From"), email_to=m.get("To"), date=m.get("Date"), message_id=m.get("Message-ID"), thread_id=references[0] if references else m.get("In-Reply-To"), has_attachments=any(True for _ in m.iter_attachments()))


_TIME = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s+-->\s+(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})")


def parse_subtitles(data: bytes) -> dict:
    starts, ends, lines, source = [], [], [], None
    for line in _text(data).splitlines():
        t = _TIME.search(line)
        if t:
            n = [int(x or 0) for x in t.groups()]
            starts.append(n[0] * 3600 + n[1] * 60 + n[2] + n[3] / 1000)
            ends.append(n[4] * 3600 + n[5] * 60 + n[6] + n[7] / 1000)
        elif line.startswith("NOTE source:"):
            source = line.split(":", 1)[1].strip()
        elif line.strip() and not line.startswith(("WEBVTT", "NOTE", "STYLE")) and not line.strip().isdigit():
            lines.append(re.sub(r"<[^>]+>", "", line).strip())
    return _doc("\n".join(lines), source_type="subtitle", start_seconds=min(starts, default=None), end_seconds=max(ends, default=None), source=source)


def _streams(data: bytes) -> Iterator[bytes]:
    """Contents of a file's streams, unpacked where they are packed."""
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        try:
            yield zlib.decompressobj().decompress(m.group(1), ENTRY_BYTES)
        except zlib.error:
            yield m.group(1)


def _characters(streams: list[bytes]) -> dict[bytes, str]:
    """What the codes of fonts mean, by the maps to Unicode that a file carries."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for raw in streams:
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                out.setdefault(bytes.fromhex(a.decode()), text(b))
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
            for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                for k in range(min(int(z, 16) - int(a, 16) + 1, 65536)):
                    out.setdefault((int(a, 16) + k).to_bytes(len(a) // 2, "big"), chr((int(b, 16) + k) & 0x10FFFF) if len(b) <= 4 else text(b))
    return out


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
_PDF_TEXT = re.compile(rb"\(((?:\\.|[^()\\])*)\)|<([0-9A-Fa-f\s]*)>|(-?\d+(?:\.\d+)?)(?=[\s(<\]])|\b(Td|TD|T\*|Tm)(?![\w*])|('|\")", re.S)


def parse_pdf(data: bytes) -> dict:
    """Text operators of the pages' streams: literal and hexadecimal strings, by the file's maps to Unicode, else as Latin-1; new lines where the text moves."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF header")
    streams = list(_streams(data))
    known = _characters(streams)
    width = max(map(len, known), default=1)

    def decoded(code: bytes) -> str:
        if not known:
            return code.decode("latin-1")
        return "".join(known.get(code[i : i + width], code[i : i + width].decode("latin-1") if width == 1 else "") for i in range(0, len(code), width))

    out, pages = [], len(re.findall(rb"/Type\s*/Page\b(?!s)", data))
    for raw in streams:
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", raw, re.S):
            words: list[str] = []
            for m in _PDF_TEXT.finditer(block):
                if m.group(1) is not None:
                    words.append(decoded(re.sub(rb"\\(\d{1,3}|\r?\n|.)", lambda e: bytes([int(e.group(1), 8) & 255]) if e.group(1)[:1].isdigit() else _ESCAPES.get(e.group(1), e.group(1).strip(b"\r\n")), m.group(1), flags=re.S)))
                elif m.group(2) is not None:
                    digits = re.sub(rb"\s", b"", m.group(2)).decode()
                    words.append(decoded(bytes.fromhex(digits + "0" * (len(digits) % 2))))
                elif m.group(3) is not None:
                    if words and float(m.group(3)) < -200 and not words[-1].endswith((" ", "\n")):
                        words.append(" ")  # a wide step back within an array is a space
                elif words and not words[-1].endswith("\n"):
                    words.append("\n")
            if "".join(words).strip():
                out.append("".join(words).strip("\n"))
    info = {k.decode().lower(): v.decode("latin-1") for k, v in re.findall(rb"/(Title|Author|Subject|Creator)\s*\(((?:\\.|[^()\\])*)\)", data)}
    return _doc("\n".join(out), title=info.get("title"), page_count=pages, **{k: v for k, v in info.items() if k != "title"})


def _archive(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    sizes = [i.file_size for i in z.infolist()]
    if max(sizes, default=0) > ENTRY_BYTES or sum(sizes) > DECLARED_BYTES:
        raise ValueError("archive beyond the limits")
    return z


def parse_docx(data: bytes) -> dict:
    root = ElementTree.fromstring(_archive(data).read("word/document.xml"))
    out = []
    for p in (e for e in root.iter() if _local(e) == "p"):
        text = "".join(e.text or "" for e in p.iter() if _local(e) == "t").strip()
        style = next((v for e in p.iter() if _local(e) == "pstyle" for v in e.attrib.values()), "")
        level = re.match(r"(?i)heading\s*(\d)", style)
        if text:
            out.append(f"{'#' * int(level.group(1))} {text}" if level else text)
    return _doc("\n\n".join(out))


def _xml_text(z: zipfile.ZipFile, pattern: str) -> list[str]:
    names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
    return [" ".join(t.strip() for t in ElementTree.fromstring(z.read(n)).itertext() if t.strip()) for n in names]


def parse_odt(data: bytes) -> dict:
    return _doc("\n\n".join(_xml_text(_archive(data), r"content\.xml")))


def parse_pptx(data: bytes) -> dict:
    z = _archive(data)
    slides, notes = _xml_text(z, r"ppt/slides/slide\d+\.xml"), _xml_text(z, r"ppt/notesSlides/notesSlide\d+\.xml")
    return _doc("\n\n".join(slides + notes), source_type="presentation", slide_count=len(slides), has_notes=bool(notes))


def _table(rows: list[list[str]]) -> str:
    rows = [r for r in ([c.strip().replace("|", "\\|").replace("\n", " ") for c in r] for r in rows) if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _column(reference: str) -> int | None:
    """Number of a cell's column from its reference, counted from 0."""
    letters = re.match(r"[A-Z]+", reference or "")
    n = 0
    for c in letters.group() if letters else "":
        n = 26 * n + ord(c) - 64
    return n - 1 if letters else None


def parse_xlsx(data: bytes) -> dict:
    """Every sheet as a table under its name; cells stand where their references say, blank ones stay blank."""
    z = _archive(data)
    shared = ["".join(t.text or "" for t in e.iter() if _local(t) == "t") for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    relations = {e.get("Id"): e.get("Target") or "" for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    out = []
    for k, sheet in enumerate(e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
        own = next((v for a, v in sheet.attrib.items() if a.rsplit("}", 1)[-1] == "id"), None)
        target = relations.get(own) or f"worksheets/sheet{k + 1}.xml"
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(path)).iter() if _local(e) == "row") if path in z.namelist() else ():
            cells: dict[int, str] = {}
            for c in (e for e in row if _local(e) == "c"):
                value = next((e.text or "" for e in c if _local(e) == "v"), "") or "".join(t.text or "" for e in c if _local(e) == "is" for t in e.iter() if _local(t) == "t")
                at = _column(c.get("r") or "")
                cells[len(cells) if at is None else at] = shared[int(value)] if c.get("t") == "s" and value else value
            if any(cells.values()):
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        out.append(f"## Sheet: {sheet.get('name') or ''}\n\n{_table(rows)}")
    return _doc("\n\n".join(out))


def parse_csv(data: bytes) -> dict:
    return _doc(_table(list(csv.reader(io.StringIO(_text(data))))))


def parse_html(data: bytes) -> dict:
    r = extract(_text(data))
    return _doc(r["markdown"] or "", r["plain_text"] or "", r["title"])


PARSERS: dict[str, Callable[[bytes], dict]] = {
    "json": parse_json, "ipynb": parse_notebook, "jsonl": parse_jsonl, "eml": parse_mail, "pdf": parse_pdf, "docx": parse_docx, "odt": parse_odt, "pptx": parse_pptx, "xlsx": parse_xlsx, "csv": parse_csv,
    **dict.fromkeys(("md", "rst", "org"), lambda b: _doc(_text(b), "")),
    **dict.fromkeys(("txt", "yaml", "yml", "toml"), lambda b: _doc(_text(b))),
    "log": lambda b: _doc(re.sub(r"\x1b\[[0-9;?]*[ -/]*[@-~]", "", _text(b))),
    **dict.fromkeys(("html", "htm"), parse_html), **dict.fromkeys(("xml", "opml"), parse_xml), **dict.fromkeys(("rss", "atom"), parse_feed), **dict.fromkeys(("vtt", "srt"), parse_subtitles),
}


def parse_file(path: str, data: bytes) -> dict:
    """One file by its suffix (none means JSON); an unknown format or a fault is an error in the row."""
    name = path.rsplit("/", 1)[-1]
    form = name.rsplit(".", 1)[-1].lower() if "." in name else "json"
    base = {"path": path, "format": form, "title": None, "markdown": None, "plain_text": None, "source_type": "file", "provenance": {}, "error": None}
    if form not in PARSERS:
        return base | {"error": f"unknown format: {form}"}
    try:
        found = PARSERS[form](data)
        if form == "json":  # a stored extraction without its address is addressed by its path
            found["provenance"].setdefault("url", path if "://" in path else f"file://{path}")
        return base | found | {"title": found["title"] or name.rsplit(".", 1)[0]}
    except Exception as e:  # noqa: BLE001 - any fault of a file is data
        return base | {"error": f"{type(e).__name__}: {e}"[:300]}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files (path, modificationTime, length, content) of a folder, of the known suffixes and within the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*SUFFIXES) & (F.col("length") <= MOST_BYTES))


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([parse_file(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])], columns=[c.split()[0] for c in re.sub(r"<[^>]*>", "", SCHEMA).split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def sitemap_entries(xml: str) -> tuple[str, list[tuple[str, str | None, float | None, str | None]]]:
    """Kind (urlset, index, unknown) and (url, last_modified, priority, change_freq); what precedes a fault stays."""
    parser = ElementTree.XMLPullParser(("end",))
    kind, out = "unknown", []
    try:
        parser.feed(xml)
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        for _, e in parser.read_events():
            if _local(e) in ("url", "sitemap"):
                f = {_local(c): (c.text or "").strip() for c in e}
                kind = "urlset" if _local(e) == "url" else "index"
                if f.get("loc"):
                    try:
                        priority = float(f["priority"]) if f.get("priority") else None
                    except ValueError:
                        priority = None
                    out.append((f["loc"], f.get("lastmod") or None, priority, f.get("changefreq") or None))
    except ElementTree.ParseError:
        pass
    return kind, out


def sitemaps(df: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """Rows (source, kind, url, last_modified, priority, change_freq), the first of each URL within a sitemap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for u, x in zip(pdf["u"], pdf["x"]):
                kind, entries = sitemap_entries(x or "")
                seen: set[str] = set()
                for e in entries:
                    if e[0] not in seen:
                        seen.add(e[0])
                        rows.append((u, kind, *e))
            yield pd.DataFrame(rows, columns=["source", "kind", "url", "last_modified", "priority", "change_freq"])

    return df.select(F.col(url).alias("u"), F.col(xml).alias("x")).mapInPandas(run, "source string, kind string, url string, last_modified string, priority double, change_freq string")
