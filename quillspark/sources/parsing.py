"""Parsers as plugs over binary files: bytes to a paper, with fallback.

``files`` is what ``spark.read.format("binaryFile")`` gives: path, content. An engine takes the bytes and returns pages (a list of
texts); layout models and services plug in the same way. Built in are plain text, web pages and the text layer of simple PDF files.
"""

from __future__ import annotations

import html as html_codes
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import title_of
from quillspark.operators.tables import abstract_of, reference_items

Engine = Callable[[bytes], list[str]]
#: What a text must have for the next engine not to be tried.
LEAST_A_PAGE, LEAST_IN_ALL = 100, 500

_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|T\*|\bET\b|'|\"")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _string(token: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return plain.decode("latin-1")


def pdf_text(data: bytes) -> list[str]:
    """A page for each content stream that shows text: strings in order, a line for each text object."""
    pages = []
    for found in _STREAM.finditer(data):
        body = found[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass  # not packed
        if b"BT" not in body:
            continue
        shown = [_string(t) if t[:1] == b"(" else "\n" for t in _SHOWN.findall(body)]
        pages.append(re.sub(r"\n{3,}", "\n\n", "".join(shown)).strip())
    return pages


def html_text(data: bytes) -> list[str]:
    text = re.sub(r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ", data.decode("utf-8", "replace"))
    text = re.sub(r"(?i)<(?:br|/p|/h[1-6]|/li|/tr)[^>]*>", "\n", text)
    return [html_codes.unescape(re.sub(r"<[^>]*>", " ", text)).strip()]


def plain_text(data: bytes) -> list[str]:
    return data.decode("utf-8", "replace").split("\f")


ENGINES: dict[str, Engine] = {"pdf": pdf_text, "html": html_text, "plain": plain_text}


def page_count(content: Column) -> Column:
    """Pages of a PDF by its page objects, 0 for anything else; no model."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(F.substring(text, 1, 5) == "%PDF-", F.regexp_count(text, F.lit(r"/Type\s*/Page(?![a-zA-Z])"))).otherwise(0)


def good_enough(pages: list[str]) -> bool:
    total = sum(map(len, pages))
    return bool(pages) and total / len(pages) >= LEAST_A_PAGE and total > LEAST_IN_ALL


def parsed(files: DataFrame, order: list[str], engines: dict[str, Engine] | None = None) -> DataFrame:
    """``source, engine, pages, full_text, title, abstract, references`` of each file.

    Engines are tried in turn: the first with a text that is good enough counts, else the longest text; one that fails
    counts as empty. A file that none can read has no page and engine null.
    """
    known = ENGINES | (engines or {})
    wanted = [(name, known[name]) for name in order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"]):
                best: tuple[str | None, list[str]] = (None, [])
                for name, engine in wanted:
                    try:
                        pages = engine(bytes(data or b""))
                    except Exception:  # an engine may fail in any way; the next one is tried
                        continue
                    if sum(map(len, pages)) > sum(map(len, best[1])):
                        best = (name, pages)
                    if good_enough(pages):
                        best = (name, pages)
                        break
                out.append((path.rsplit("/", 1)[-1], *best))
            yield pd.DataFrame(out, columns=["source", "engine", "pages"])

    text = F.array_join("pages", "\n\n")
    found = files.select("path", "content").mapInPandas(run, "source string, engine string, pages array<string>").withColumn("full_text", text)
    return found.withColumns({"title": title_of(F.col("full_text")), "abstract": abstract_of(F.col("full_text")), "references": reference_items(F.col("full_text"))})


def element_text(elements: DataFrame) -> DataFrame:
    """``source, full_text`` of a layout stream (``source, page, nth, kind, text``), in order.

    Headers, footers and pictures go, and body texts that hold a table's markup; a table's block takes the caption before it.
    """
    body = elements.where("kind not in ('header', 'footer', 'picture')").where("kind = 'table' or not contains(text, '<table')")
    lines = body.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", "nth", "text"))).alias("e"))  # a paper's own elements
    return lines.select("source", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("full_text"))


_IMAGE = re.compile(rb"<<([^<>]*(?:<<[^<>]*>>[^<>]*)*)>>\s*stream\r?\n")


def pdf_images(data: bytes, least: int = 20 << 10) -> list[tuple[int, int, bytes]]:
    """(width, height, bytes) of the JPEG streams of a PDF that have ``least`` bytes or more."""
    out = []
    for head in _IMAGE.finditer(data):
        about = head[1]
        if b"/DCTDecode" not in about or b"/Image" not in about:
            continue
        end = data.find(b"endstream", head.end())
        body = data[head.end() : end].rstrip(b"\r\n") if end >= 0 else b""
        size = [re.search(rb"/" + name + rb"\s+([0-9]+)", about) for name in (b"Width", b"Height")]
        if len(body) >= least:
            out.append((*(int(m[1]) if m else 0 for m in size), body))
    return out


def figures(files: DataFrame, least: int = 20 << 10) -> DataFrame:
    """The figure table: ``id, paper_source, figure_id, figure_type, width, height, image`` of the rasters in PDF files; a broken file has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                out += [(name, f"Figure_{i}", "figure", w, h, image) for i, (w, h, image) in enumerate(pdf_images(bytes(data or b""), least), 1)]
            yield pd.DataFrame(out, columns=["paper_source", "figure_id", "figure_type", "width", "height", "image"])

    found = files.select("path", "content").mapInPandas(run, "paper_source string, figure_id string, figure_type string, width int, height int, image binary")
    return found.select(F.xxhash64("paper_source", "figure_id").alias("id"), "*")


def as_data_address(image: Column, kind: str = "image/jpeg") -> Column:
    """A binary image as a data address for a page."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(image))
