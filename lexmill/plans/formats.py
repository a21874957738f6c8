"""Files of office formats made from plain texts, for queries that read them back."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import ship

#: Lines on a page or slide.
PAGE = 40


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(text: str) -> bytes:
    """A paragraph for every line, in two runs."""
    lines = "".join(f"<w:p><w:r><w:t>{escape(x[:5])}</w:t></w:r><w:r><w:t>{escape(x[5:])}</w:t></w:r></w:p>" for x in text.split("\n"))
    return _archive({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{lines}</w:body></w:document>'})


def pptx(text: str) -> bytes:
    """A slide for every PAGE lines, with one shape of a paragraph for each."""
    lines = text.split("\n")
    slides = {}
    for i in range(0, len(lines), PAGE):
        body = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines[i : i + PAGE])
        slides[f"ppt/slides/slide{i // PAGE + 1}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody>{body}</p:txBody></p:sp></p:sld>'
    return _archive(slides)


def epub(text: str) -> bytes:
    """One chapter with a paragraph for every line."""
    body = "".join(f"<p>{escape(x)}</p>" for x in text.split("\n"))
    return _archive(
        {
            "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
            "O/p.opf": '<package xmlns="o"><manifest><item href="c.xhtml" media-type="application/xhtml+xml"/></manifest></package>',
            "O/c.xhtml": f"<html><head><style>p {{}}</style></head><body>{body}</body></html>",
        }
    )


def pdf(text: str) -> bytes:
    """A page for every PAGE lines, one shown string each; other characters than Windows-1252's become ?."""
    lines, objects = text.split("\n"), {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"}
    kids = []
    for i in range(0, len(lines), PAGE):
        shown = b"".join(b"(" + x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*\n" for x in lines[i : i + PAGE])
        data = zlib.compress(b"BT /F1 12 Tf 14 TL 72 720 Td\n" + shown + b"ET")
        n = 10 + 2 * (i // PAGE)
        kids.append(b"%d 0 R" % n)
        objects[n] = b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (n + 1)
        objects[n + 1] = b"<</Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(data), data)
    objects[2] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer\n<</Root 1 0 R>>\n%%EOF"


MAKERS: dict[str, Callable[[str], bytes]] = {"docx": docx, "pptx": pptx, "epub": epub, "pdf": pdf}


def as_files(docs: DataFrame, suffix: str) -> DataFrame:
    """(path, length, content): each document (doc_id, text) as a file of the format."""
    ship(docs.sparkSession)
    make = MAKERS[suffix]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [make(t or "") for t in b["text"]]
            yield pd.DataFrame({"path": [f"/in/{i}.{suffix}" for i in b["doc_id"]], "length": [len(x) for x in made], "content": made})

    return docs.select(F.col("doc_id"), F.col("text")).mapInPandas(run, "path string, length long, content binary")
