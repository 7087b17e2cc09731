"""Texts of PDF files, page by page, in plain Python: object tables, Flate streams, text operators.

A file is opened and read by seeking, an object at a time, so that no task holds a whole file; pages are dealt to tasks in
ranges. What is read: classic and stream cross-references, object streams, a scan for objects where the table is broken;
content that isn't compressed or by Flate (with PNG predictors for tables); fonts with a ToUnicode map, else the Windows
code page with named differences. Encrypted files and pages that can't be read have empty pages.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of a task's range; bytes of one object or stream that is read, at most; levels of a page tree.
RANGE, MOST_BYTES, DEPTH = 16, 1 << 26, 64
#: A move of this share of a font's size to the right, or this many thousandths back between strings, is a blank.
_BLANK, _KERN = 0.2, 180
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s()<>\[\]{}/%]*|[+-]?\d*\.?\d+(?=[\s()<>\[\]{}/%]|$)|<[0-9A-Fa-f\s]*>|\(|[^\s()<>\[\]{}/%]+")
_NAMED = {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "fi": "ﬁ", "fl": "ﬂ", "endash": "–", "emdash": "—", "quoteright": "’", "quoteleft": "‘", "degree": "°", "multiply": "×", "mu": "µ", "parenleft": "(", "parenright": ")", "slash": "/", "colon": ":", "semicolon": ";", "percent": "%", "plus": "+", "equal": "=", **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))}


class Ref(NamedTuple):
    number: int


class Name(str):
    pass


class Operator(str):
    pass


class Broken(ValueError):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that opens before at, and where it ends."""
    out, depth = bytearray(), 1
    escapes = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
    while at < len(data):
        c = data[at]
        at += 1
        if c == 92 and at < len(data):
            c = data[at]
            at += 1
            if digits := re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2]):
                out.append(int(digits[0], 8) & 255)
                at += len(digits[0]) - 1
            elif c in (10, 13):
                at += c == 13 and data[at : at + 1] == b"\n"
            else:
                out.append(escapes.get(c, c))
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def parse(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(object or operator, where it ends) of PDF syntax, one after another; dictionaries are dicts, arrays lists."""
    stack: list[list] = []
    while (m := _TOKEN.search(data, at)) is not None:
        at, token = m.end(), m[0]
        if token[:1] == b"%":
            continue
        if token in (b"<<", b"["):
            stack.append([token])
            continue
        if token in (b">>", b"]"):
            if not stack:
                raise Broken("brackets")
            kind, *items = stack.pop()
            value = items if kind == b"[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False)}
        elif token == b"(":
            value, at = _string(data, at)
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[+-]?\d+", token):
            value = int(token)
        elif re.fullmatch(rb"[+-]?\d*\.\d+", token):
            value = float(token)
        elif token == b"R" and stack and len(stack[-1]) > 2 and all(isinstance(x, int) for x in stack[-1][-2:]):
            value = Ref(stack[-1][-2])
            del stack[-1][-2:]
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(token, Operator(token.decode("latin-1")))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Pdf:
    """A file's objects and pages."""

    def __init__(self, file: BinaryIO):
        self.file, self.places, self.packed, self.trailer = file, {}, {}, {}
        self.size = file.seek(0, 2)
        try:
            self._tables()
            self.pages = list(self._pages(self.get(self.get(self.trailer["Root"])["Pages"]), {}, 0))
        except Exception:  # a broken table: the objects themselves are looked for
            self._scan()
            self.pages = list(self._pages(self.get(self.get(self.trailer.get("Root"))["Pages"]), {}, 0)) if self.trailer.get("Root") else []
        if "Encrypt" in self.trailer:
            self.pages = [None] * len(self.pages)

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(size, MOST_BYTES))

    def _tables(self) -> None:
        found = re.findall(rb"startxref\s+(\d+)", self.read(max(0, self.size - 2048), 2048))
        at, seen = int(found[-1]), set()
        while at is not None and at not in seen:
            seen.add(at)
            if self.read(at, 4) == b"xref":
                told = self._classic(at)
            else:
                told = self._stream_table(at)
            self.trailer = {**told, **self.trailer}
            if isinstance(extra := told.get("XRefStm"), int):
                self._stream_table(extra)
            at = told.get("Prev")

    def _classic(self, at: int) -> dict:
        data, size = b"", 4096
        while b"trailer" not in data and len(data) < min(self.size - at, MOST_BYTES):
            data, size = self.read(at, size), size * 4
        head, _, _ = data.partition(b"trailer")
        number = None
        for line in head.splitlines()[1:]:
            if pair := re.fullmatch(rb"\s*(\d+)\s+(\d+)\s*", line):
                number = int(pair[1])
            elif entry := re.match(rb"\s*(\d{10})\s+\d{5}\s+([nf])", line):
                if entry[2] == b"n":
                    self.places.setdefault(number, int(entry[1]))
                number += 1
        begins = at + len(head) + 7
        return next(parse(self.read(begins, 1 << 16)))[0]

    def _stream_table(self, at: int) -> dict:
        told, data = self._object_at(at)
        rows, widths = self._inflate(told, data), told["W"]
        index, step = told.get("Index") or [0, told["Size"]], sum(told["W"])
        numbers = [n for first, count in zip(index[::2], index[1::2], strict=True) for n in range(first, first + count)]
        for k, number in enumerate(numbers):
            row, field = rows[k * step : (k + 1) * step], []
            for w in widths:
                field.append(int.from_bytes(row[:w], "big") if w else None)
                row = row[w:]
            kind = 1 if field[0] is None else field[0]
            if number not in self.places and number not in self.packed:
                if kind == 1:
                    self.places[number] = field[1]
                elif kind == 2:
                    self.packed[number] = (field[1], field[2] or 0)
        return told

    def _scan(self) -> None:
        """Places of all objects by their headings, a stretch of the file at a time."""
        self.places, self.packed = {}, {}
        for base in range(0, self.size, 1 << 20):
            part = self.read(base, (1 << 20) + 64)
            for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", part):
                if m.start() < 1 << 20:
                    self.places[int(m[1])] = base + m.start()
            for m in re.finditer(rb"trailer\s*(?=<<)", part):
                self.trailer = {**self.trailer, **next(parse(self.read(base + m.end(), 1 << 16)))[0]}
        if "Root" not in self.trailer:
            root = next((n for n in self.places if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Catalog"), None)
            self.trailer |= {"Root": Ref(root)} if root is not None else {}

    def _object_at(self, at: int) -> tuple[object, bytes | None]:
        size = 1 << 14
        while True:
            data = self.read(at, size)
            head = re.match(rb"\s*\d+\s+\d+\s+obj\b", data)
            if not head:
                raise Broken("no object")
            value, end = next(parse(data[head.end() :] + b" ", 0), (None, 0))
            end += head.end()
            if end < len(data) - 16 or len(data) < size:
                break
            size *= 4
        if not isinstance(value, dict) or not (opens := re.match(rb"\s*stream(\r\n|\n|\r)", data[end : end + 64])):
            return value, None
        begins = at + end + opens.end()
        length = self.get(value.get("Length"))
        if isinstance(length, int) and self.read(begins + length, 32).lstrip().startswith(b"endstream"):
            return value, self.read(begins, length)
        return value, self.read(begins, MOST_BYTES).partition(b"endstream")[0]

    def _inflate(self, told: dict, data: bytes) -> bytes:
        filters, parms = self.get(told.get("Filter")) or [], self.get(told.get("DecodeParms")) or {}
        for i, name in enumerate([filters] if isinstance(filters, str) else filters):
            if name not in ("FlateDecode", "Fl"):
                raise Broken(f"filter {name}")
            unpack = zlib.decompressobj()
            data = unpack.decompress(data, MOST_BYTES)
            own = self.get(parms[i] if isinstance(parms, list) else parms) or {}
            if own.get("Predictor", 1) >= 10:
                data = _unpredicted(data, own.get("Columns", 1) * own.get("Colors", 1) * own.get("BitsPerComponent", 8) // 8)
        return data

    def get(self, value: object) -> object:
        """What a reference stands for; other values as they are. Streams are (dictionary, bytes)."""
        if not isinstance(value, Ref):
            return value
        if value.number in self.packed:
            holder, _ = self.packed[value.number]
            told, data = self._object_at(self.places[holder])
            data = self._inflate(told, data)
            pairs = [x for x, _ in parse(data[: told["First"]])]
            offset = dict(zip(pairs[::2], pairs[1::2], strict=False))[value.number]
            return next(parse(data[told["First"] + offset :] + b" "))[0]
        if value.number not in self.places:
            return None
        told, data = self._object_at(self.places[value.number])
        return told if data is None else (told, data)

    def _pages(self, node: object, inherited: dict, depth: int) -> Iterator[dict]:
        if not isinstance(node, dict) or depth > DEPTH:
            return
        own = inherited | {k: node[k] for k in ("Resources",) if k in node}
        if "Kids" in node:
            for kid in self.get(node["Kids"]) or []:
                yield from self._pages(self.get(kid), own, depth + 1)
        else:
            yield own | node

    def text(self, page: dict | None) -> str:
        if page is None:
            return ""
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        contents = self.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [page.get("Contents")]
        data = b"\n".join(self._inflate(*s) for s in map(self.get, parts) if isinstance(s, tuple))
        return _Writer({name: _Font(self, self.get(f)) for name, f in fonts.items()}).run(data)


def _unpredicted(data: bytes, width: int) -> bytes:
    """Rows of PNG's filters none, sub and up, as tables use them."""
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            row[i] = (row[i] + (before[i] if kind == 2 else row[i - 1] if kind == 1 and i else 0)) & 255
        out += row
        before = row
    return bytes(out)


class _Font:
    """Codes of a font to text."""

    def __init__(self, pdf: Pdf, told: object):
        told = told if isinstance(told, dict) else {}
        self.wide, self.codes = told.get("Subtype") == "Type0", {}
        encoding = pdf.get(told.get("Encoding"))
        if isinstance(encoding, dict):
            at = 0
            for x in pdf.get(encoding.get("Differences")) or []:
                if isinstance(x, int):
                    at = x
                else:
                    self.codes[at] = x if len(x) == 1 else chr(int(x[3:7], 16)) if re.fullmatch(r"uni[0-9A-F]{4}", x) else _NAMED.get(x, "")
                    at += 1
        if isinstance(cmap := pdf.get(told.get("ToUnicode")), tuple):
            self._map(pdf._inflate(*cmap))

    def _map(self, data: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "ignore")
        held: list = []
        for x, _ in parse(data):
            if not isinstance(x, Operator):
                held.append(x)
                continue
            if x == "endbfchar":
                for code, to in zip(held[::2], held[1::2], strict=False):
                    self.codes[int.from_bytes(code, "big")] = text(to)
            elif x == "endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    low, high = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    for k in range(min(high - low + 1, 65536)):
                        self.codes[low + k] = text(to[k]) if isinstance(to, list) else text(to)[:-1] + chr(ord(text(to)[-1]) + k)
            held = []

    def decode(self, data: bytes) -> str:
        if self.wide:
            return "".join(self.codes.get(data[i] << 8 | data[i + 1], "") for i in range(0, len(data) - 1, 2))
        return "".join(self.codes[b] if b in self.codes else bytes([b]).decode("cp1252", "ignore") for b in data)


class _Writer:
    """Runs a page's text operators: lines by vertical moves, blanks by gaps."""

    def __init__(self, fonts: dict[str, _Font]):
        self.fonts, self.font, self.size, self.leading, self.out = fonts, None, 1.0, 0.0, []

    def _move(self, dx: float, dy: float) -> None:
        if abs(dy) > 0.01:
            self._put("\n")
        elif dx > _BLANK * self.size:
            self._put(" ")

    def _put(self, gap: str) -> None:
        if self.out and (gap == "\n" or not self.out[-1].endswith((" ", "\n"))):
            self.out.append(gap)

    def _show(self, data: object) -> None:
        if isinstance(data, bytes):
            self.out.append(self.font.decode(data) if self.font else data.decode("cp1252", "ignore"))

    def run(self, data: bytes) -> str:
        held: list = []
        x = y = 0.0
        for token, _ in parse(data):
            if not isinstance(token, Operator):
                held.append(token)
                continue
            n = [v for v in held if isinstance(v, (int, float))]
            if token == "Tf" and len(held) >= 2:
                self.font, self.size = self.fonts.get(held[-2]), abs(float(held[-1])) or 1.0
            elif token in ("Td", "TD") and len(n) >= 2:
                self.leading = -n[1] if token == "TD" else self.leading
                self._move(*n[-2:])
            elif token == "Tm" and len(n) >= 6:
                self._move(n[4] - x, n[5] - y)
                x, y = n[4], n[5]
            elif token == "TL" and n:
                self.leading = n[-1]
            elif token == "T*":
                self._put("\n")
            elif token == "Tj" and held:
                self._show(held[-1])
            elif token in ("'", '"') and held:
                self._put("\n")
                self._show(held[-1])
            elif token == "TJ" and held and isinstance(held[-1], list):
                for part in held[-1]:
                    if isinstance(part, (int, float)) and part < -_KERN:
                        self._put(" ")
                    self._show(part)
            elif token == "BT":
                x = y = 0.0
            elif token == "ET":
                self._put("\n")
            held = []
        return re.sub(r" +\n", "\n", "".join(self.out)).strip("\n")


def page_texts(file: BinaryIO, first: int = 0, count: int | None = None) -> list[str]:
    """The texts of a range of pages; a page that can't be read is empty."""
    pdf, out = Pdf(file), []
    for page in pdf.pages[first : None if count is None else first + count]:
        try:
            out.append(pdf.text(page))
        except Exception:  # one broken page doesn't cost the others
            out.append("")
    return out


def _opened(path: str) -> BinaryIO:
    from urllib.parse import unquote, urlparse

    place = urlparse(path)
    if place.scheme not in ("", "file"):
        raise ValueError(f"{path}: pages are read by seeking, which needs a mounted folder; use read_pages for other stores")
    return open(unquote(place.path), "rb")


def read_pdf_pages(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, page, pages, text: a row for each page of the files below a folder that all executors have mounted.

    A file that isn't a PDF has no page. Its pages are dealt out in ranges of RANGE, so a long file is several tasks' work.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("doc_id"), "path")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            numbers = []
            for p in part["path"]:
                with _opened(p) as f:
                    try:
                        numbers.append(len(Pdf(f).pages))
                    except Exception:
                        numbers.append(0)
            yield part.assign(pages=numbers)

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                with _opened(r.path) as f:
                    found = page_texts(f, r.first, RANGE)
                yield pd.DataFrame({"doc_id": r.doc_id, "page": range(r.first, r.first + len(found)), "pages": r.pages, "text": found})

    counted = named.mapInPandas(count, "doc_id string, path string, pages int").where("pages > 0")
    ranges = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(RANGE))).alias("first"))
    return ranges.repartition("path", "first").mapInPandas(texts, "doc_id string, page int, pages int, text string")


def read_pdf(spark: SparkSession, path: str, pattern: str = "*.pdf", skip_empty: bool = False) -> DataFrame:
    """doc_id, raw_text: pages joined by line ends, a page without text as an empty one; with skip_empty such pages are left out and each page has its own line end."""
    pages = F.array_sort(F.collect_list(F.struct("page", "text")))
    whole = read_pdf_pages(spark, path, pattern).groupBy("doc_id").agg(pages.alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    kept = F.transform(F.filter(texts, lambda t: t != ""), lambda t: F.concat(t, F.lit("\n")))
    return whole.select("doc_id", (F.array_join(kept, "") if skip_empty else F.array_join(texts, "\n")).alias("raw_text"))
