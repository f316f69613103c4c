"""Crawl records: a data source for WARC files, header fields, charset repair, HTML paragraphs and links."""

from __future__ import annotations

import codecs
import glob
import gzip
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from paraloom.functions import text as T
from paraloom.session import shared_folder

SCHEMA = "rec_type string, target_uri string, content binary"
#: Encodings tried after the declared one, in this order; fixed values.
FALLBACKS = ["utf-8", "iso-8859-1", "gb2312", "cp1251", "cp1252"]


#: What reading a damaged file raises.
DAMAGE = (EOFError, OSError, ValueError, zlib.error)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the local one of a plain path, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class WarcFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``: one task per file, records streamed; gzip by file suffix.

    The folder is a URI of any file system that Arrow knows, or a local path or pattern.  A damaged
    file ends at the damage; what was read before it stays, and with the option ``damaged`` set to
    true one row of type ``damaged`` with the file's name as its address says so, to be counted.
    ``df.write.format("warc").mode("append").save(folder)`` writes a gzip file per task.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("damaged", "").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str, damaged: bool):
        self.path, self.damaged = path, damaged

    def partitions(self) -> list[InputPartition]:
        if "://" not in self.path and not self.path.startswith("file:") and not os.path.isdir(self.path):
            return [WarcFile(f) for f in sorted(glob.glob(self.path))]
        where, base = file_system(self.path)
        found = [f.path for f in where.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and ".warc" in f.base_name and not f.base_name.endswith(".tmp")]
        # the scheme and host of a URI, to find the file system again
        prefix = self.path.removesuffix(base) if "://" in self.path else ""
        return [WarcFile(prefix + f) for f in sorted(found)]

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        if partition is None:
            return
        where, path = file_system(partition.path)
        whole = True
        with where.open_input_stream(path, compression=None) as raw:
            records_ = Records(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)
            yield from records_
            whole = records_.whole
        if self.damaged and not whole:
            yield "damaged", partition.path, None


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class WarcWriter(DataSourceWriter):
    """A file per task, under a name of its own attempt until the job commits."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        where, base = file_system(self.path)
        where.create_dir(base, recursive=True)
        final = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
        with where.open_output_stream(final + ".tmp", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb") as out:
            for r in rows:
                content = bytes(r["content"] or b"")
                head = ["WARC/1.0", *(f"{k}: {v}" for k, v in (("WARC-Type", r["rec_type"]), ("WARC-Target-URI", r["target_uri"])) if v is not None), f"Content-Length: {len(content)}"]
                out.write("\r\n".join([*head, "", ""]).encode() + content + b"\r\n\r\n")
        return Written(final + ".tmp", final)

    def commit(self, messages) -> None:
        where, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                where.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        where, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.temporary)


class Records:
    """(type, target URI, content) of each record of an open WARC file, up to its end or its damage; ``whole`` tells which."""

    def __init__(self, f):
        self.f, self.whole = io.BufferedReader(f) if not hasattr(f, "peek") and hasattr(f, "readinto") else f, True

    def __iter__(self) -> Iterator[tuple[str | None, str | None, bytes]]:
        while True:
            try:
                got = self._next()
            except DAMAGE:
                self.whole = False
                return
            if got is None:
                return
            yield got

    def _next(self) -> tuple[str | None, str | None, bytes] | None:
        while not (line := self.f.readline()).startswith(b"WARC/"):
            if not line:
                return None
        head: dict[str, str] = {}
        while line := self.f.readline().strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        content = self.f.read(size)
        if size < 0 or len(content) < size:
            raise EOFError("a record ends before its length")
        return head.get("warc-type"), head.get("warc-target-uri"), content


def records(f) -> Iterator[tuple[str | None, str | None, bytes]]:
    return iter(Records(f))


def through_files(rows: DataFrame) -> DataFrame:
    """The records after writing them to a new folder beside the checkpoints and scanning it."""
    spark = rows.sparkSession
    spark.dataSource.register(WarcSource)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows.select("rec_type", "target_uri", "content").write.format("warc").mode("append").save(folder)
    return spark.read.format("warc").load(folder)


def latest(rows: DataFrame) -> DataFrame:
    """One row per record_id, the one loaded last."""
    other = [c for c in rows.columns if c != "record_id"]
    newest = F.max_by(F.struct(*other), F.struct(F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.xxhash64("content")))
    return rows.groupBy("record_id").agg(newest.alias("r")).select("record_id", "r.*")


def responses(rows: DataFrame) -> DataFrame:
    """Response records of HTML with a host, with ``host``, ``mime`` and declared ``charset``; cheap filters come first."""
    head = T.http_header(F.decode("content", "iso-8859-1"))
    kind = T.content_type(head)
    return (
        rows.filter(F.col("rec_type") == "response")
        .withColumns({"host": T.host(F.col("target_uri")), "mime": T.mime(kind), "charset": T.charset(kind)})
        .filter("mime = 'text/html' AND host IS NOT NULL")
    )


def resolve_charset(name: str | None) -> str:
    """A known encoding's name; unknown and missing ones are UTF-8."""
    try:
        return codecs.lookup(name).name if name else "utf-8"
    except LookupError:
        return "utf-8"


def best_decode(content: bytes, declared: str | None) -> tuple[str, str]:
    """(text, encoding) of the first encoding with the fewest replacement characters, stopping at none."""
    best = None
    for enc in [resolve_charset(declared), *FALLBACKS]:
        text = content.decode(enc, "replace")
        bad = sum("￰" <= c <= "￿" for c in text)
        if best is None or bad < best[0]:
            best = (bad, text, enc)
        if not bad:
            break
    return best[1], best[2]


class _Page(HTMLParser):
    """Paragraphs, links and the texts of all elements, without scripts, styles and comments."""

    HIDDEN = {"script", "style", "noscript", "template", "head"}

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.hidden, self.open = base, 0, None
        self.paragraphs: list[str] = []
        self.texts: list[str] = []
        self.links: list[str] = []

    def _close(self) -> None:
        if self.open is not None:
            self.paragraphs.append("".join(self.open))
            self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in ("p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "body"):
            self._close()
            if tag == "p":
                self.open = []
        elif tag == "a" and not self.hidden and (href := dict(attrs).get("href")):
            try:
                self.links.append(urljoin(self.base, href))
            except ValueError:
                pass

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("p", "div", "section", "article", "body", "html"):
            self._close()

    def handle_data(self, data):
        if self.hidden:
            return
        if data.strip():
            self.texts.append(data)
        if self.open is not None:
            self.open.append(data)


def parse(html: str, base: str = "") -> _Page:
    page = _Page(base or "")
    page.feed(html)
    page.close()
    page._close()
    return page


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 500):
            part = b.slice(a, 500)
            out: list[tuple] = []
            for i, (content, charset, uri) in enumerate(zip(*(part.column(c).to_pylist() for c in ("content", "charset", "target_uri")), strict=True)):
                body = (content or b"").partition(b"\r\n\r\n")[2]
                try:
                    text, enc = best_decode(body, charset)
                    page = parse(text, uri)
                    out.append((i, enc, page.paragraphs, page.texts, page.links))
                except (ValueError, AssertionError, RecursionError):
                    out.append((i, None, [], [], []))  # a page that can't be parsed is told by its missing encoding
            if out:
                _, enc, ps, ts, ls = zip(*out, strict=True)
                lists = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("record_id"), part.column("host"), part.column("target_uri"), pa.array(enc, pa.string()), pa.array(ps, lists), pa.array(ts, lists), pa.array(ls, lists)],
                    ["record_id", "host", "target_uri", "encoding", "paragraphs", "texts", "links"],
                )


#: Elements and attributes that cleaning keeps; fixed values.
KEPT_ELEMENTS = frozenset(
    "a b blockquote br caption cite code col colgroup dd div dl dt em h1 h2 h3 h4 h5 h6 i img li ol p pre q small span strike strong sub sup table tbody td tfoot th thead tr u ul".split()
)
KEPT_ATTRIBUTES = frozenset("href title cite span width start type align alt height src summary abbr axis colspan rowspan scope".split())


class _Clean(HTMLParser):
    """The page's body with kept elements alone; the text of dropped ones stays, but for scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in _Page.HIDDEN:
            self.hidden += 1
        elif tag in KEPT_ELEMENTS and not self.hidden:
            kept = "".join(f' {k}="{escape(v or "")}"' for k, v in attrs if k in KEPT_ATTRIBUTES and not (k in ("href", "src") and (v or "").strip().lower().startswith(("javascript:", "data:"))))
            self.out.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag):
        if tag in _Page.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in KEPT_ELEMENTS - {"br", "img", "col"} and not self.hidden:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(escape(data, quote=False))


def clean_html(html: str) -> str:
    page = _Clean()
    page.feed(html)
    page.close()
    return "".join(page.out)


def cleaned_pages(rows: DataFrame) -> DataFrame:
    """``(record_id, html)`` of the responses with harmless elements and attributes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                out = [clean_html(best_decode((c or b"").partition(b"\r\n\r\n")[2], x)[0]) for c, x in zip(part.column("content").to_pylist(), part.column("charset").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("record_id"), pa.array(out, pa.string())], ["record_id", "html"])

    return responses(rows).select("record_id", "charset", "content").mapInArrow(run, "record_id long, html string")


def pages(rows: DataFrame) -> DataFrame:
    """``(record_id, host, target_uri, encoding, paragraphs, texts, links)`` of the responses."""
    return responses(rows).select("record_id", "host", "target_uri", "charset", "content").mapInArrow(
        _extract, "record_id long, host string, target_uri string, encoding string, paragraphs array<string>, texts array<string>, links array<string>"
    )


def page_paragraphs(rows: DataFrame, least: int = 100) -> DataFrame:
    """``(host, uri, line_no, text)`` of paragraphs of at least ``least`` characters without Specials."""
    each = pages(rows).select("host", F.col("target_uri").alias("uri"), F.posexplode("paragraphs").alias("line_no", "raw"))
    text = T.normalise_space(F.col("raw"))
    return each.select("host", "uri", "line_no", text.alias("text")).filter((F.length("text") >= least) & ~T.has_specials(F.col("text")))


def crawl_links(pages_: DataFrame) -> DataFrame:
    """``(uri, link)`` within the host, without fragments."""
    each = pages_.select("host", F.col("target_uri").alias("uri"), F.explode("links").alias("link"))
    return each.filter(~F.col("link").contains("#") & (T.host(F.col("link")) == F.col("host"))).select("uri", "link").distinct()
