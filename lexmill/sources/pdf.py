"""Text and facts of PDF files, on the standard library alone.

Objects are found by scanning the file, so a broken cross-reference table does no harm; object
streams and content streams are inflated. Text is shown by a font, whose ToUnicode table gives
its characters; without one, single bytes are Windows-1252. Lines end where a text operator
moves down. Encrypted files have pages but no text, and scanned pages need OCR, whose engine is
not part of the standard library: ``needs_ocr`` in the text functions tells which.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any


class Name(str):
    """A name object, without its slash."""


class Ref(int):
    """A reference to an object's number."""


class Operator(str):
    """A bare word: an operator of a content stream, or a keyword."""


class Stream(dict):
    """A dictionary with the bytes that follow it."""

    data = b""


_SPACE, _DELIMITER = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END = object()


class Reader:
    """Reads objects one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            if data[self.at] in _SPACE:
                self.at += 1
            elif data[self.at] == 0x25:  # a comment
                while self.at < len(data) and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self) -> Any:
        """The next object, or ``_END``."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return _END
        two, c = data[at : at + 2], data[at : at + 1]
        if two == b"<<":
            self.at += 2
            return self._dictionary()
        if two == b">>":
            self.at += 2
            return Operator(">>")
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self._string()
        if c == b"/":
            m = _WORD.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0] if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))
        if c == b"[":
            self.at += 1
            out = []
            while (x := self.next()) is not _END and x != Operator("]"):
                out.append(x)
            return out
        if c in (b"]", b"{", b"}", b")", b">"):
            self.at += 1
            return Operator(c.decode())
        if m := _REFERENCE.match(data, at):
            self.at = m.end()
            return Ref(int(m[1]))
        word = _WORD.match(data, at)
        self.at = word.end()
        if _NUMBER.fullmatch(word[0]):
            return float(word[0]) if b"." in word[0] else int(word[0])
        text = word[0].decode("latin-1")
        return {"true": True, "false": False, "null": None}.get(text, Operator(text))

    def _dictionary(self) -> dict:
        out = {}
        while True:
            key = self.next()
            if key is _END or key == Operator(">>"):
                return out
            value = self.next()
            if isinstance(key, Name):
                out[str(key)] = value

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data) and depth:
            c = data[at : at + 1]
            if c == b"\\":
                m = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif data[at + 1 : at + 2] in (b"\n", b"\r"):
                    at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                else:
                    out += _ESCAPES.get(data[at + 1 : at + 2], data[at + 1 : at + 2])
                    at += 2
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
            at += 1
        self.at = at
        return bytes(out)


class Document:
    """The objects of one file."""

    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise ValueError("not a PDF file")
        self.size = len(content)
        self.objects: dict[int, Any] = {}
        self.trailers: list[dict] = []
        for m in re.finditer(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b", content):
            reader = Reader(content, m.end())
            value = reader.next()
            if isinstance(value, dict):
                reader.skip()
                if content.startswith(b"stream", reader.at):
                    value = self._stream(value, content, reader.at + 6)
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"\btrailer\b", content):
            value = Reader(content, m.end()).next()
            if isinstance(value, dict):
                self.trailers.append(value)
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.get("Type") == "XRef":
                self.trailers.append(value)
            if isinstance(value, Stream) and value.get("Type") == "ObjStm":
                self._unpack(value)
        self.encrypted = any("Encrypt" in t for t in self.trailers)

    def _stream(self, head: dict, content: bytes, at: int) -> Stream:
        at += 2 if content.startswith(b"\r\n", at) else 1
        size = head.get("Length")
        end = at + size if isinstance(size, int) and not isinstance(size, Ref) else -1
        if end < at or b"endstream" not in content[end : end + 20]:
            end = content.find(b"endstream", at)
            end = len(content) if end < 0 else end
        out = Stream(head)
        out.data = content[at:end]
        return out

    def _unpack(self, stream: Stream) -> None:
        data = self.bytes_of(stream)
        first, reader = self.get(stream.get("First")) or 0, Reader(data)
        places = [(reader.next(), reader.next()) for _ in range(self.get(stream.get("N")) or 0)]
        for number, at in places:
            if isinstance(number, int) and isinstance(at, int) and number not in self.objects:
                self.objects[number] = Reader(data, first + at).next()

    def get(self, value: Any) -> Any:
        """The object behind a reference."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def bytes_of(self, stream: Stream) -> bytes:
        """A stream's bytes, inflated where it says so; empty for other filters."""
        filters = self.get(stream.get("Filter"))
        data = stream.data
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            f = self.get(f)
            if f in ("FlateDecode", "Fl"):
                inflate = zlib.decompressobj()
                try:
                    data = inflate.decompress(data) + inflate.flush()
                except zlib.error:
                    return b""
            elif f in ("ASCIIHexDecode", "AHx"):
                data = Reader(b"<" + data).next()
            else:
                return b""
        parts = self.get(stream.get("DecodeParms"))
        parts = self.get(parts[0]) if isinstance(parts, list) and parts else parts
        if isinstance(parts, dict) and (self.get(parts.get("Predictor")) or 1) >= 10:
            data = _unpredict(data, self.get(parts.get("Columns")) or 1)
        return data

    def pages(self) -> list[dict]:
        """Page objects in reading order, with inherited resources."""
        roots = [self.get(t.get("Root")) for t in reversed(self.trailers)] + [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        for root in roots:
            if isinstance(root, dict) and "Pages" in root:
                found = list(self._leaves(root["Pages"], None, set()))
                if found:
                    return found
        return [v for _, v in sorted((k, v) for k, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "Page")]

    def _leaves(self, node: Any, resources: Any, seen: set) -> Iterator[dict]:
        if isinstance(node, Ref):
            if int(node) in seen:
                return
            seen.add(int(node))
        node = self.get(node)
        if not isinstance(node, dict):
            return
        resources = node.get("Resources", resources)
        if "Kids" in node:
            for kid in self.get(node["Kids"]) or []:
                yield from self._leaves(kid, resources, seen)
        else:
            yield {**node, "Resources": resources}

    def page_text(self, page: dict) -> str:
        if self.encrypted:
            return ""
        streams = self.get(page.get("Contents"))
        streams = [self.get(s) for s in (streams if isinstance(streams, list) else [streams])]
        data = b"\n".join(self.bytes_of(s) for s in streams if isinstance(s, Stream))
        resources = self.get(page.get("Resources"))
        fonts = self.get(resources.get("Font")) if isinstance(resources, dict) else None
        maps = {k: self._font(self.get(v)) for k, v in fonts.items()} if isinstance(fonts, dict) else {}
        return "".join(_shown(data, maps)).strip("\n")

    def _font(self, font: Any) -> tuple[int, dict[int, str]]:
        """(bytes of a code, characters of codes)."""
        if not isinstance(font, dict):
            return 1, {}
        wide = 2 if font.get("Subtype") == "Type0" else 1
        table = self.get(font.get("ToUnicode"))
        return (wide, _unicode_table(self.bytes_of(table))) if isinstance(table, Stream) else (wide, {})

    def info(self) -> dict[str, Any]:
        pages = self.pages()
        meta: dict[str, str] = {}
        for t in self.trailers:
            found = self.get(t.get("Info"))
            if isinstance(found, dict) and not self.encrypted:
                meta.update({k: _text(v) for k, v in ((k, self.get(v)) for k, v in found.items()) if isinstance(v, bytes)})
        return {"page_count": len(pages), "metadata": meta, "encrypted": self.encrypted, "file_size": self.size, "has_images": any(self._has_image(p) for p in pages[:3])}

    def _has_image(self, page: dict) -> bool:
        resources = self.get(page.get("Resources"))
        things = self.get(resources.get("XObject")) if isinstance(resources, dict) else None
        return isinstance(things, dict) and any(isinstance(x := self.get(v), dict) and x.get("Subtype") == "Image" for v in things.values())


def _unpredict(data: bytes, columns: int) -> bytes:
    """Rows of PNG predictors back to their bytes (one byte a sample, as in object tables)."""
    out, before = bytearray(), bytearray(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left, up = row[i - 1] if i else 0, before[i]
            if kind == 1:
                row[i] = (row[i] + left) & 255
            elif kind == 2:
                row[i] = (row[i] + up) & 255
            elif kind == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif kind == 4:
                corner = before[i - 1] if i else 0
                p = left + up - corner
                near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[i] = (row[i] + near) & 255
        out += row
        before = row + bytearray(columns - len(row))
    return bytes(out)


def _text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _unicode_table(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    as_text = lambda raw: raw.decode("utf-16-be", "replace")
    reader, held = Reader(data), []
    while (x := reader.next()) is not _END:
        if x == Operator("endbfchar"):
            for code, put in zip(held[::2], held[1::2], strict=False):
                if isinstance(code, bytes) and isinstance(put, bytes):
                    out[int.from_bytes(code)] = as_text(put)
        elif x == Operator("endbfrange"):
            for lo, hi, put in zip(held[::3], held[1::3], held[2::3], strict=False):
                if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                    continue
                for i, code in enumerate(range(int.from_bytes(lo), min(int.from_bytes(hi), int.from_bytes(lo) + 0xFFFF) + 1)):
                    if isinstance(put, list):
                        if i < len(put) and isinstance(put[i], bytes):
                            out[code] = as_text(put[i])
                    elif isinstance(put, bytes) and put:
                        out[code] = as_text((int.from_bytes(put) + i).to_bytes(len(put)))
        if isinstance(x, Operator):
            held = []
        else:
            held.append(x)
    return out


def _shown(data: bytes, fonts: dict[str, tuple[int, dict[int, str]]]) -> Iterator[str]:
    """The text of a content stream, with line ends where it moves to another line."""
    reader, held, font, fresh = Reader(data), [], (1, {}), True
    height: Any = None

    def chars(raw: bytes) -> str:
        wide, table = font
        if not table:
            return "" if wide == 2 else raw.decode("cp1252", "replace")
        return "".join(table.get(int.from_bytes(raw[i : i + wide]), "") for i in range(0, len(raw), wide))

    while (x := reader.next()) is not _END:
        if not isinstance(x, Operator):
            held.append(x)
            continue
        parts: list[str] = []
        moved = False
        if x == "Tf" and len(held) >= 2:
            font = fonts.get(str(held[-2]), (1, {}))
        elif x in ("Td", "TD") and len(held) >= 2:
            moved = held[-1] != 0
        elif x == "Tm" and len(held) >= 6:
            moved, height = height is not None and held[-1] != height, held[-1]
        elif x in ("T*", "BT"):
            moved = True
        elif x == "BI":  # an image in line
            end = data.find(b"EI", reader.at)
            reader.at = len(data) if end < 0 else end + 2
        elif x in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
            moved = x != "Tj"
            parts = [chars(held[-1])]
        elif x == "TJ" and held and isinstance(held[-1], list):
            for item in held[-1]:
                if isinstance(item, bytes):
                    parts.append(chars(item))
                elif isinstance(item, (int, float)) and item < -200 and parts:  # a gap as wide as a blank
                    parts.append(" ")
        if moved and not fresh:
            yield "\n"
            fresh = True
        text = "".join(parts)
        if text:
            yield text
            fresh = False
        held = []


def page_texts(content: bytes, pages: list[int] | None = None) -> list[str]:
    """The text of every page, or of the given ones (from 0, those out of range are left out).

    A page that can't be read is empty.
    """
    document = Document(content)
    found = document.pages()
    out = []
    for i in range(len(found)) if pages is None else [p for p in pages if 0 <= p < len(found)]:
        try:
            out.append(document.page_text(found[i]))
        except (ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError):
            out.append("")
    return out


def info(content: bytes) -> dict[str, Any]:
    """page_count, metadata, encrypted, file_size, has_images (first three pages)."""
    return Document(content).info()
