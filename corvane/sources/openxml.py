"""Office Open XML files to text and structure counts, in parallel over a binaryFile scan (mapInPandas: XML in ZIP is
beyond SQL). DOCX: paragraphs that aren't blank, in order, then table rows joined by " | ". PPTX: one text per slide."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _text(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx(raw: bytes) -> tuple[str, dict[str, int]]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    tables = list(body.iter(f"{WORD}tbl"))
    inside = {id(p) for t in tables for p in t.iter(f"{WORD}p")}
    parts = [_text(p, f"{WORD}t") for p in body.iter(f"{WORD}p") if id(p) not in inside]
    for t in tables:
        for row in t.iter(f"{WORD}tr"):
            parts.append(" | ".join(x for x in (_text(c, f"{WORD}t").strip() for c in row.iter(f"{WORD}tc")) if x))
    counts = {"paragraphs": sum(1 for _ in body.iter(f"{WORD}p")), "tables": len(tables), "slides": 0, "shapes": 0}
    return "\n".join(p for p in parts if p.strip()), counts


def pptx(raw: bytes) -> tuple[list[str], dict[str, int]]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    slides, shapes = [], 0
    for _, name in found:
        root = ElementTree.fromstring(z.read(name))
        texts = []
        for shape in root.iter(f"{SLIDES}sp"):
            body = shape.find(f"{SLIDES}txBody")
            if body is not None:
                shapes += 1
                texts.append("\n".join(_text(p, f"{DRAWING}t") for p in body.iter(f"{DRAWING}p")))
        slides.append("\n".join(t for t in texts if t.strip()))
    return slides, {"paragraphs": 0, "tables": 0, "slides": len(slides), "shapes": shapes}


SCHEMA = "path string, slide int, text string, paragraphs int, tables int, slides int, shapes int, error string"


def sections(files: DataFrame) -> DataFrame:
    """(path, content) -> a row for each text of a file; a file that can't be read gives one row with its error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    if path.lower().endswith(".pptx"):
                        texts, counts = pptx(raw)
                        rows += [(path, k, t, *counts.values(), None) for k, t in enumerate(texts, 1)]
                    else:
                        text, counts = docx(raw)
                        rows.append((path, None, text, *counts.values(), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({k: "Int32" for k in ("slide", "paragraphs", "tables", "slides", "shapes")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx}").load(root)
    return sections(files)
