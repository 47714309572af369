"""Word documents as blocks, and blocks as text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.schemas import BLOCKS
from casewright.operators.lines import joined

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _own(element: ElementTree.Element | None, tag: str, name: str = "val") -> str | None:
    found = None if element is None else element.find(W + tag)
    return None if found is None else found.get(W + name)


def _style_names(package: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Names by style id, and that of the default paragraph style."""
    if "word/styles.xml" not in package.namelist():
        return {}, ""
    names, default = {}, ""
    for style in ElementTree.fromstring(package.read("word/styles.xml")).iter(W + "style"):
        name = _own(style, "name") or ""
        # what is saved as "heading 1" is shown as "Heading 1"
        name = "Heading" + name[7:] if name.startswith("heading ") else name
        names[style.get(W + "styleId") or ""] = name
        if style.get(W + "type") == "paragraph" and style.get(W + "default") in ("1", "true"):
            default = name
    return names, default


def _paragraph(p: ElementTree.Element) -> str:
    """The text of the runs, those in links included: tabs and breaks as characters, nothing of deletions."""
    out: list[str] = []
    for child in p:
        if child.tag in (W + "r", W + "hyperlink"):
            for run in [child] if child.tag == W + "r" else child.findall(W + "r"):
                for x in run:
                    if x.tag == W + "t":
                        out.append(x.text or "")
                    elif x.tag in (W + "tab", W + "ptab"):
                        out.append("\t")
                    elif x.tag == W + "cr" or x.tag == W + "br" and x.get(W + "type") in (None, "textWrapping"):
                        out.append("\n")
                    elif x.tag == W + "noBreakHyphen":
                        out.append("-")
    return "".join(out)


def _cell(tc: ElementTree.Element) -> str:
    """The stripped paragraphs of a cell, then its nested tables on one line, parted by spaces."""
    texts = [t for p in tc.findall(W + "p") if (t := _paragraph(p).strip().replace("\n", " "))]
    nested = ["; ".join(" | ".join(row) for row in _rows(t)) for t in tc.findall(W + "tbl")]
    return " ".join([*texts, *(n for n in nested if n)])


def _rows(tbl: ElementTree.Element) -> list[list[str]]:
    """Cells by row; a cell over several columns or rows is in each place it takes."""
    rows: list[list[str]] = []
    for tr in tbl.findall(W + "tr"):
        row: list[str] = []
        for tc in tr.findall(W + "tc"):
            pr = tc.find(W + "tcPr")
            merge = None if pr is None else pr.find(W + "vMerge")
            goes_on = merge is not None and merge.get(W + "val", "continue") == "continue"
            above = rows[-1][len(row)] if goes_on and rows and len(row) < len(rows[-1]) else None
            row += [_cell(tc) if above is None else above] * int(_own(pr, "gridSpan") or 1)
        rows.append(row)
    return rows


def blocks_of(content: bytes) -> list[dict]:
    """The paragraphs and tables right in the body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names, default = _style_names(package)
        body = ElementTree.fromstring(package.read("word/document.xml")).find(W + "body")
    out: list[dict] = []
    for child in () if body is None else body:
        if child.tag == W + "p":
            style = names.get(_own(child.find(W + "pPr"), "pStyle") or "", default)
            last = (style.split() or [""])[-1]
            level = (int(last) if last.isdecimal() else 1) if style.startswith("Heading") else None
            out.append({"kind": "paragraph", "style": style, "level": level, "text": _paragraph(child).strip(), "cells": None})
        elif child.tag == W + "tbl":
            out.append({"kind": "table", "style": None, "level": None, "text": None, "cells": _rows(child)})
    return out


def word_blocks(files: DataFrame) -> DataFrame:
    """path, block_no, kind, style, level, text and cells of every block of the Word files (path, content).

    A file that cannot be read gives one block of kind "error" with the reason as its text.  A batch holds whole files;
    Spark bounds it by bytes (spark.sql.execution.arrow.maxBytesPerBatch) and by rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in BLOCKS.fields]
        for b in batches:
            for path, content in zip(b.path, b.content):
                try:
                    found = blocks_of(content)
                except Exception as e:
                    found = [{"kind": "error", "style": None, "level": None, "text": f"{type(e).__name__}: {e}", "cells": None}]
                rows = pd.DataFrame([{"path": path, "block_no": i, **x} for i, x in enumerate(found)], columns=names)
                rows["level"] = rows["level"].astype("Int32")
                yield rows

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def word_texts(blocks: DataFrame) -> DataFrame:
    """path, doc_text and error: headings with their hashes, tables as pipe rows and an empty line after, no empty paragraphs."""
    heading = F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("text"))
    table = F.concat(F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n"), F.lit("\n"))
    text = F.when(F.col("kind") == "table", table).when((F.col("kind") == "paragraph") & (F.col("text") != ""), F.when(F.col("level").isNotNull(), heading).otherwise(F.col("text")))
    return blocks.groupBy("path").agg(joined(text, "block_no").alias("doc_text"), F.max(F.when(F.col("kind") == "error", F.col("text"))).alias("error"))
