"""Text of PDF files by the standard library alone: enough for documents whose
text is text. Streams may be deflated and objects packed; fonts need a ToUnicode
map or a one-byte encoding. What is encrypted, scanned or coded otherwise is an
error, never a guess."""

from __future__ import annotations

import re
import zlib

#: Bytes that a file's streams may inflate to.
LARGEST = 1 << 28

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\(|<<|>>|<([0-9A-Fa-f\s]*)>|/([^\s()<>\[\]{}/%]*)|\[|\]|[^\s()<>\[\]{}/%]+|%[^\r\n]*")
_PAREN = re.compile(rb"[()\\]")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """A file that cannot be read as text."""


class Pdf:
    def __init__(self, content: bytes):
        if not content.lstrip()[:5] == b"%PDF-":
            raise PdfError("no PDF header")
        self.left = LARGEST
        self.bodies: dict[int, bytes] = {}
        places = list(_OBJECT.finditer(content))
        for m, after in zip(places, [*places[1:], None], strict=True):
            self.bodies[int(m[1])] = content[m.end() : after.start() if after else len(content)]
        if b"/Encrypt" in content:
            raise PdfError("encrypted")
        for body in list(self.bodies.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body.partition(b"stream")[0]):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        first, data = self._number(body, b"First"), self.stream(body)
        numbers = list(map(int, data[:first].split()))
        ends = [*numbers[3::2], len(data) - first]
        for number, start, end in zip(numbers[::2], numbers[1::2], ends, strict=True):
            self.bodies.setdefault(number, data[first + start : first + end])

    def _number(self, body: bytes, key: bytes) -> int:
        m = re.search(rb"/" + key + rb"\s+(\d+)(\s+\d+\s+R\b)?", body)
        if not m:
            raise PdfError(f"no {key.decode()}")
        return self._plain(int(m[1])) if m[2] else int(m[1])

    def _plain(self, number: int) -> int:
        m = re.match(rb"\s*(\d+)", self.bodies.get(number, b""))
        if not m:
            raise PdfError("a missing number")
        return int(m[1])

    def stream(self, body: bytes) -> bytes:
        head, mark, rest = body.partition(b"stream")
        if not mark:
            raise PdfError("no stream")
        data = rest[2:] if rest[:2] == b"\r\n" else rest[1:]
        length = re.search(rb"/Length\s+(\d+)(\s+\d+\s+R\b)?", head)
        size = (self._plain(int(length[1])) if length[2] else int(length[1])) if length else data.rfind(b"endstream")
        data = data[:size]
        filters = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
        for name in re.findall(rb"/(\w+)", filters[1]) if filters else ():
            if name not in (b"FlateDecode", b"Fl"):
                raise PdfError(f"a stream in {name.decode('latin-1')}")
            inflate = zlib.decompressobj()
            data = inflate.decompress(data, self.left)
            self.left -= len(data)
            if inflate.unconsumed_tail:
                raise PdfError("streams are too large")
        return data

    def value(self, body: bytes, key: bytes) -> bytes:
        """What follows a key: a dictionary, an array, or up to the next key; a
        reference is followed."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if reference := _REFERENCE.match(rest):
            return self.bodies.get(int(reference[1]), b"")
        if rest[:2] == b"<<":
            depth = 0
            for t in re.finditer(rb"<<|>>", rest):
                depth += 1 if t[0] == b"<<" else -1
                if not depth:
                    return rest[: t.end()]
        if rest[:1] == b"[":
            return rest[: rest.find(b"]") + 1]
        return re.match(rb"/?[^/<>\[\]]*", rest)[0]

    def pages(self) -> list[bytes]:
        """Page dictionaries in order, each with the resources it inherits."""
        root = next((b for b in self.bodies.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        found, seen = [], set()
        start = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R\b", root)
        stack = [(int(start[1]), b"")] if start else []
        while stack:
            number, resources = stack.pop()
            if number in seen:
                raise PdfError("a page tree with a cycle")
            seen.add(number)
            body = self.bodies.get(number, b"")
            resources = self.value(body, b"Resources") or resources
            kids = self.value(body, b"Kids")
            if kids:
                stack += [(int(k), resources) for k in reversed(_REFERENCE.findall(kids))]
            else:
                found.append(body.replace(b"/Resources", b"/Own") + b"/Resources " + resources)
        return found


def _unicode(cmap: bytes) -> tuple[dict[bytes, str], int]:
    """Codes and what they mean by a ToUnicode map, and the bytes of a code."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    found: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            found[bytes.fromhex(a.decode())] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, z, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            low, size = int(a, 16), len(a) // 2
            targets = [text(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", many)]
            for k in range(min(int(z, 16) - low + 1, 1 << 16)):
                meant = targets[k] if k < len(targets) else text(one)[:-1] + chr(ord(text(one)[-1]) + k) if one else None
                if meant is not None:
                    found[(low + k).to_bytes(size, "big")] = meant
    return found, max(map(len, found), default=1)


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins at ``at``, and where it ends."""
    depth, start = 1, at + 1
    at = start
    while depth:
        m = _PAREN.search(data, at)
        if not m:
            raise PdfError("a string that does not end")
        at = m.end() + (m[0] == b"\\")
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else _NAMED.get(m[3], m[3])
    return _ESCAPE.sub(plain, data[start : at - 1]), at


def page_text(pdf: Pdf, page: bytes) -> str:
    fonts = pdf.value(pdf.value(page, b"Resources"), b"Font")
    tables: dict[bytes, tuple[dict[bytes, str], int] | None] = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R\b", fonts):
        body = pdf.bodies.get(int(number), b"")
        mapped = re.search(rb"/ToUnicode\s+(\d+)", body)
        tables[name] = _unicode(pdf.stream(pdf.bodies.get(int(mapped[1]), b""))) if mapped else None
        if not mapped and re.search(rb"/Subtype\s*/Type0\b", body):
            raise PdfError("a font without a map to Unicode")
    contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
    data = b"\n".join(pdf.stream(pdf.bodies.get(int(n), b"")) for n in _REFERENCE.findall(contents[1])) if contents else b""
    out: list[str] = []
    font: tuple[dict[bytes, str], int] | None = None
    operands: list[bytes | float] = []
    strings: list[str] = []

    def shown(raw: bytes) -> str:
        if font is None:
            return raw.decode("cp1252", "replace")
        codes, size = font
        return "".join(codes.get(raw[i : i + size], "") for i in range(0, len(raw), size))

    at = 0
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token == b"(":
            raw, at = _literal(data, m.start())
            strings.append(shown(raw))
        elif m[1] is not None:
            digits = re.sub(rb"\s", b"", m[1]).decode()
            strings.append(shown(bytes.fromhex(digits + "0" * (len(digits) % 2))))
        elif m[2] is not None:
            operands.append(m[2])
        elif re.fullmatch(rb"[+-]?[0-9]*\.?[0-9]+|[+-]?[0-9]+\.", token):
            operands.append(float(token))
            if strings and float(token) < -200:
                strings.append(" ")  # a gap between the parts of TJ
        elif token not in (b"[", b"]", b"<<", b">>") and token[:1] != b"%":
            if token == b"Tf" and operands:
                font = tables.get(next((o for o in operands if isinstance(o, bytes)), b""))
            elif token in (b"Td", b"TD"):
                out.append("\n" if len(operands) > 1 and operands[-1] else " ")
            elif token in (b"T*", b"'", b'"', b"Tm", b"ET"):
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out += strings
            operands, strings = [], []
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def text(content: bytes) -> str:
    """The text of all pages, a blank line between them."""
    pdf = Pdf(content)
    pages = pdf.pages()
    if not pages:
        raise PdfError("no pages")
    return "\n\n".join(page_text(pdf, page) for page in pages)
