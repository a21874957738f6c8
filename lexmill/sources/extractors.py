"""Text from file contents: a registry of extractors by suffix, on the standard library alone.

An extractor takes bytes and returns text or None. ``register`` adds or replaces one, for
example a PDF reader with OCR, whose engine is not part of the standard library.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

from lexmill.functions.patterns import DROPPED_TAGS, MARKDOWN, MARKDOWN_REST
from lexmill.sources.pdf import page_texts

Extractor = Callable[[bytes], str | None]
EXTRACTORS: dict[str, Extractor] = {}


def register(*suffixes: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        for s in suffixes:
            EXTRACTORS[s.lower()] = f
        return f

    return add


def decode(content: bytes, encoding: str = "utf-8-sig") -> str:
    """UTF-8 without its mark, else Latin-1 (which never fails); every line end becomes \\n."""
    try:
        text = content.decode(encoding)
    except UnicodeDecodeError:
        text = content.decode("iso-8859-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def tidy(text: str) -> str:
    """White space collapsed in every line, empty lines dropped."""
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


class _Nodes(HTMLParser):
    """Text nodes outside dropped elements; comments and tags end a node."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS and tag not in ("meta", "link"):
            self.inside += 1

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS and self.inside:
            self.inside -= 1

    def handle_data(self, data):
        if not self.inside and data.strip():
            self.found.append(data.strip())


def html_text(markup: str) -> str:
    """Each stripped text node on a line of its own."""
    parser = _Nodes()
    parser.feed(markup)
    parser.close()
    return tidy("\n".join(parser.found))


@register(".txt")
def plain(content: bytes) -> str | None:
    """Text as it stands, with its mark."""
    return decode(content, "utf-8")


@register(".html", ".htm")
def html(content: bytes) -> str | None:
    return html_text(decode(content))


def _python_pattern(p: str) -> tuple[str, int]:
    """A pattern with Java's leading flags as a Python pattern and its flags."""
    flags = 0
    if m := re.match(r"\(\?([a-zA-Z]+)\)", p):
        p = p[m.end() :]
        flags = (re.M if "m" in m[1] else 0) | (re.S if "s" in m[1] else 0)
    return p, flags


@register(".md", ".markdown")
def markdown(content: bytes) -> str | None:
    text = decode(content)
    for p, put in (*MARKDOWN, *MARKDOWN_REST):
        pattern, flags = _python_pattern(p)
        groups = re.findall(r"\$(\d)", put)
        text = re.sub(pattern, (lambda m, g=groups: "".join(m[int(i)] or "" for i in g)) if groups else put, text, flags=flags)
    return tidy(text)


def _paragraphs(xml: bytes, paragraph: str, run: str) -> list[str]:
    root = ElementTree.fromstring(xml)
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith(run)) for p in root.iter() if p.tag.endswith(paragraph)]


@register(".docx")
def docx(content: bytes) -> str | None:
    """Paragraphs that aren't blank, an empty line between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n\n".join(p for p in _paragraphs(z.read("word/document.xml"), "}p", "}t") if p.strip())


@register(".pptx")
def pptx(content: bytes) -> str | None:
    """Shapes of a slide by lines, slides by empty lines, in slide order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        texts = []
        for name in slides:
            root = ElementTree.fromstring(z.read(name))
            shapes = [x for x in root.iter() if x.tag.endswith("}sp")]
            found = ["\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in s.iter() if p.tag.endswith("}p")) for s in shapes]
            texts.append("\n".join(t for t in found if t.strip()))
    return "\n\n".join(t for t in texts if t)


@register(".epub")
def epub(content: bytes) -> str | None:
    """Documents in manifest order, each as text, an empty line between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if x.tag.endswith("}rootfile"))
        items = [x for x in ElementTree.fromstring(z.read(package)).iter() if x.tag.endswith("}item")]
        names = [posixpath.join(posixpath.dirname(package), unescape(i.get("href"))) for i in items if i.get("media-type") == "application/xhtml+xml"]
        texts = [html_text(decode(z.read(n))) for n in names if n in z.namelist()]
    return "\n\n".join(t for t in texts if t)


@register(".pdf")
def pdf(content: bytes) -> str | None:
    """Pages with text, an empty line between them; scanned pages have none."""
    return "\n\n".join(t for t in page_texts(content) if t.strip())


def processor_name(suffix: str) -> str | None:
    """Name of the extractor that serves a suffix, None if there is none."""
    found = EXTRACTORS.get(suffix.lower())
    return found.__name__ if found else None


def extract(suffix: str, content: bytes | None, instead: dict[str, str] | None = None) -> tuple[str | None, str | None]:
    """(text, error): never raises, so one broken file costs one row.

    ``instead`` names suffixes that are read as another one.
    """
    if content is None:
        return None, "no content"
    suffix = (suffix or "").lower()
    found = EXTRACTORS.get((instead or {}).get(suffix, suffix))
    if found is None:
        return None, "unsupported format"
    try:
        text = found(content)
    except Exception as e:  # noqa: BLE001  (a file may be broken in any way)
        return None, f"{type(e).__name__}: {e}"[:200]
    if text is None or not text.strip():
        return None, "no text content"
    return text, None
