"""Edits of a Word part as splices of its bytes: what no edit touches stays byte for byte.

One pass of the parser notes where every paragraph, each of its children and the properties of its runs begin and end.  A span of a
paragraph's text then becomes a splice from the first to the last run that it touches: what is left of their text, in runs of the same
name with the same properties, around the formula's markup.  Declarations of prefixes, wherever they stand, the order of attributes, the
XML declaration and the encoding are never rewritten.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from xml.parsers import expat
from xml.sax.saxutils import escape

#: Namespaces, children that a replaced run may hold, children of a paragraph that go when one of its spans is replaced,
#: children of a paragraph whose runs are part of its text.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
IN_RUN = ("rPr", "t", "lastRenderedPageBreak")
DISCARDED = ("proofErr",)
WRAPPERS = ("hyperlink", "smartTag", "ins", "del")
PARAGRAPH, RUN, TEXT, WRAPPING = (W, "p"), (W, "r"), (W, "t"), tuple((W, x) for x in WRAPPERS)


class Unsafe(ValueError):
    """Markup or a structure that is left alone."""


@dataclass(slots=True)
class Child:
    """A direct child of a paragraph: its name as written, its place in the bytes and its text."""

    space: str
    local: str
    name: str
    begin: int
    end: int = -1
    text: str = ""
    inner: list[str] = field(default_factory=list)  # names of its children
    properties: tuple[int, int] | None = None
    prefixed: bool = False  # declares a prefix of its own

    @property
    def word(self) -> str | None:
        return self.local if self.space == W else None

    @property
    def replaceable(self) -> bool:
        return self.word in DISCARDED or (self.word == "r" and not self.prefixed and all(x in IN_RUN for x in self.inner))


@dataclass(slots=True)
class Paragraph:
    begin: int
    body: int  # where its content begins
    children: list[Child] = field(default_factory=list)
    closing: int = -1  # where its end tag begins
    end: int = -1

    @property
    def text(self) -> str:
        return "".join(c.text for c in self.children)


def decoded(data: bytes) -> tuple[bytes, str | None]:
    """A part as UTF-8 and the encoding to go back to; None where it is UTF-8 already."""
    for mark, name in ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data.decode(name).encode(), name
    found = re.match(rb"(?:\xef\xbb\xbf)?<\?xml[^>]*?\sencoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']", data)
    name = found[1].decode().lower() if found else "utf-8"
    if name in ("utf-8", "utf8", "us-ascii", "ascii"):
        return data, None
    try:
        text = data.decode(name)
    except (LookupError, UnicodeDecodeError) as e:
        raise Unsafe(f"encoding {name}: {e}") from None
    if text.encode(name) != data:
        raise Unsafe(f"encoding {name} can't be kept")
    return text.encode(), name


#: A tag's bytes up to its end; a > in a quoted value does not end it.
TAG = re.compile(rb"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")


def _closed(data: bytes, at: int) -> int:
    """Where the tag that begins at an offset ends."""
    if found := TAG.match(data, at):
        return found.end()
    raise Unsafe("a tag does not end")


def indexed(data: bytes) -> list[Paragraph]:
    """Paragraphs of a UTF-8 part in document order, those within others too; Unsafe if it declares a document type or is not well formed."""
    out: list[Paragraph] = []
    spaces: dict[str, str] = {"xml": "http://www.w3.org/XML/1998/namespace"}
    known: dict[str, tuple[str, str]] = {}  # what names mean where these hold
    outer: list[tuple[int, dict[str, str], dict[str, tuple[str, str]]]] = []  # what held outside of the open elements that declare, and their depths
    names: list[tuple[str, str]] = []  # of the open elements
    open_: list[tuple[Paragraph, int]] = []  # paragraphs that are open, and the depth of each
    begins: list[int] = []
    reader = expat.ParserCreate("utf-8")
    reader.ordered_attributes = True
    reader.buffer_text = True

    def refuse(*_) -> None:
        raise Unsafe("markup declares a document type")

    def start(name: str, attributes: list[str]) -> None:
        nonlocal spaces, known
        at, depth, own = reader.CurrentByteIndex, len(names), None
        if attributes:
            own = {k.partition(":")[2]: v for k, v in zip(attributes[::2], attributes[1::2]) if k == "xmlns" or k.startswith("xmlns:")}
            if own:
                outer.append((depth, spaces, known))
                spaces, known = {**spaces, **own}, {}
        pair = known.get(name)
        if pair is None:
            prefix, _, local = name.rpartition(":")
            pair = known[name] = (spaces.get(prefix, ""), local)
        if open_:
            p, level = open_[-1]
            if depth == level + 1:
                p.children.append(Child(*pair, name, at, prefixed=bool(own)))
            elif depth == level + 2:
                child, (space, local) = p.children[-1], pair
                child.inner.append(local if space == W else name)
                if local == "rPr" and space == W and child.properties is None:
                    child.properties = (at, -1)
        names.append(pair)
        begins.append(at)
        if pair == PARAGRAPH:
            out.append(Paragraph(at, _closed(data, at)))
            open_.append((out[-1], depth))

    def finish(_: str) -> None:
        nonlocal spaces, known
        names.pop()
        began, depth = begins.pop(), len(names)
        if outer and outer[-1][0] == depth:
            _, spaces, known = outer.pop()
        at = reader.CurrentByteIndex
        tagged = data.startswith(b"</", at)
        end = data.find(b">", at) + 1 if tagged else -1
        if not end:
            raise Unsafe("a tag does not end")
        if not open_:
            return
        p, level = open_[-1]
        if depth > level + 2 or depth == level + 2 and p.children[-1].properties != (began, -1):
            return
        end = end if tagged else _closed(data, began)
        if depth == level:
            open_.pop()
            p.closing, p.end = (at if tagged else end), end
        elif depth == level + 1:
            p.children[-1].end = end
        else:
            p.children[-1].properties = (began, end)

    def characters(text: str) -> None:
        if names[-1] != TEXT:
            return
        for p, level in open_:  # a text box's paragraph lies within a run of another
            path = names[level + 1 :]
            if path and path[0] == RUN or len(path) > 1 and path[0] in WRAPPING and path[1] == RUN:
                p.children[-1].text += text

    reader.StartDoctypeDeclHandler = reader.EntityDeclHandler = reader.ExternalEntityRefHandler = refuse
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = start, finish, characters
    try:
        reader.Parse(data, True)
    except expat.ExpatError as e:
        raise Unsafe(f"markup is not well formed: {e}") from None
    return out


#: Names as the parser writes them where it resolves prefixes itself.
PARAGRAPH_NAME, RUN_NAME, TEXT_NAME, *WRAPPING_NAMES = ("}".join(x) for x in (PARAGRAPH, RUN, TEXT, *WRAPPING))


def paragraph_texts(data: bytes) -> list[str]:
    """Texts of the paragraphs of ``indexed``, in a pass that notes no places; what this pass can't take, ``indexed`` takes or refuses."""
    out: list[list[str]] = []
    names: list[str] = []
    open_: list[tuple[list[str], int]] = []
    reader = expat.ParserCreate("utf-8", "}")
    reader.buffer_text = True

    def refuse(*_) -> None:
        raise Unsafe("markup declares a document type")

    def start(name: str, _) -> None:
        if name == PARAGRAPH_NAME:
            out.append([])
            open_.append((out[-1], len(names)))
        names.append(name)

    def finish(_: str) -> None:
        if names.pop() == PARAGRAPH_NAME:
            open_.pop()

    def characters(text: str) -> None:
        if names[-1] != TEXT_NAME:
            return
        for own, level in open_:
            path = names[level + 1 : level + 3]
            if path[:1] == [RUN_NAME] or path[1:] == [RUN_NAME] and path[0] in WRAPPING_NAMES:
                own.append(text)

    reader.StartDoctypeDeclHandler = reader.EntityDeclHandler = reader.ExternalEntityRefHandler = refuse
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = start, finish, characters
    try:
        reader.Parse(data, True)
    except expat.ExpatError:
        return [p.text for p in indexed(data)]
    return ["".join(own) for own in out]


@lru_cache(maxsize=1024)
def formula(markup: bytes, display: bool) -> tuple[bytes, bytes]:
    """A compiled formula inline and, for a paragraph of its own, as a block; Unsafe if it is no Office Math."""
    body = re.sub(rb"^(?:\xef\xbb\xbf)?\s*(?:<\?xml[^>]*\?>)?\s*", b"", markup).rstrip()
    root: list[str] = []
    inner: list[tuple[int, int]] = []
    reader = expat.ParserCreate("utf-8", "}")
    depth = 0

    def start(name: str, _) -> None:
        nonlocal depth
        if not depth:
            root.append(name)
        elif depth == 1 and name == f"{M}}}oMath" and not inner:
            inner.append((reader.CurrentByteIndex, -1))
        depth += 1

    def finish(name: str) -> None:
        nonlocal depth
        depth -= 1
        if depth == 1 and inner and inner[0][1] < 0:
            inner[0] = (inner[0][0], _closed(body, reader.CurrentByteIndex))

    reader.StartElementHandler, reader.EndElementHandler = start, finish
    try:
        reader.Parse(body, True)
    except expat.ExpatError as e:
        raise Unsafe(f"formula is not well formed: {e}") from None
    if root[0] == f"{M}}}oMath":
        return body, b'<m:oMathPara xmlns:m="' + M.encode() + b'">' + body + b"</m:oMathPara>"
    if root[0] == f"{M}}}oMathPara" and inner and not re.search(rb"\sxmlns", body[: _closed(body, 0)].replace(b'xmlns:m="' + M.encode() + b'"', b"", 1)):
        own = body[inner[0][0] : inner[0][1]]
        return re.sub(rb"^<m:oMath(?=[\s/>])", b'<m:oMath xmlns:m="' + M.encode() + b'"', own) if b"xmlns:m=" not in own[: _closed(own, 0)] else own, body
    raise Unsafe("formula does not contain an Office Math object")


@dataclass(slots=True)
class Edit:
    """A span of a paragraph's text, and the markup of its formula; display: it may stand as a block."""

    start: int
    end: int
    markup: bytes
    display: bool = False


def _places(p: Paragraph, start: int, end: int) -> tuple[int, int]:
    """Indexes of the first and the last run that a span touches; Unsafe if it touches more than plain runs."""
    at, first, last = 0, None, None
    for i, c in enumerate(p.children):
        stop = at + len(c.text)
        if c.text and c.word == "r":
            if first is None and at <= start < stop:
                first = i
            if at < end <= stop:
                last = i
        at = stop
    if first is None or last is None or start >= end:
        raise Unsafe("formula offsets no longer map to Word text runs")
    if not all(c.replaceable for c in p.children[first : last + 1]):
        raise Unsafe("formula crosses a field, hyperlink, bookmark, drawing, or complex Word run")
    return first, last


def paragraph_splices(data: bytes, p: Paragraph, edits: list[Edit], best_effort: bool = False) -> tuple[list[tuple[int, int, bytes]], str, int, list[str]]:
    """(splices, the text that must remain, how many edits were made, reasons of the others) of one paragraph."""
    done: list[tuple[Edit, int, int, bytes, bytes]] = []
    reasons = []
    floor = 0
    for e in sorted(edits, key=lambda e: (e.start, e.end)):
        try:
            if e.start < floor:
                raise Unsafe("formulas overlap")
            done.append((e, *_places(p, e.start, e.end), *formula(e.markup, e.display)))
            floor = e.end
        except Unsafe as reason:
            if not best_effort:
                raise
            reasons.append(str(reason))
    text = p.text
    if not done:
        return [], text, 0, reasons
    rest, at = [], 0
    for e, *_ in done:
        rest.append(text[at : e.start])
        at = e.end
    left = "".join([*rest, text[at:]])
    if len(done) == 1 and done[0][0].display and not left.strip() and all(c.word == "pPr" or c.replaceable for c in p.children):
        kept = [c for c in p.children if c.word == "pPr"]
        begin = kept[-1].end if kept else p.body
        return [(begin, p.closing, done[0][4])], "", 1, reasons

    def run(c: Child, part: str) -> bytes:
        """A run like c with a part of its text."""
        prefix = c.name.rpartition(":")[0]
        t = f"{prefix}:t" if prefix else "t"
        own = data[c.properties[0] : c.properties[1]] if c.properties else b""
        space = ' xml:space="preserve"' if part[0].isspace() or part[-1].isspace() else ""
        return b"".join((f"<{c.name}>".encode(), own, f"<{t}{space}>{escape(part)}</{t}></{c.name}>".encode()))

    starts, at = [], 0
    for c in p.children:
        starts.append(at)
        at += len(c.text)
    touched: dict[int, list[bytes]] = {}
    for e, first, last, _, _ in done:
        for i in range(first, last + 1):
            touched.setdefault(i, [])
    splices = []
    for i, c in enumerate(p.children):
        if i in touched and c.word == "r":
            out, at, stop = [], starts[i], starts[i] + len(c.text)
            for e, first, last, inline, _ in done:
                if not first <= i <= last:
                    continue
                if at < e.start:
                    out.append(run(c, text[at : e.start]))
                if i == first:
                    out.append(inline)
                at = min(stop, e.end)
            if at < stop:
                out.append(run(c, text[at:stop]))
            splices.append((c.begin, c.end, b"".join(out)))
        elif c.word in DISCARDED:
            splices.append((c.begin, c.end, b""))
    return splices, left, len(done), reasons


def spliced(part: bytes, edits: dict[int, list[Edit]], best_effort: bool = False) -> tuple[bytes, int, list[tuple[int, str]]]:
    """A part with formulas put in: (bytes, how many edits were made, (paragraph, reason) of the others); edits by paragraph.

    Texts are read back from the result: every paragraph must hold what its spans left of it, or the part is refused.
    """
    data, encoding = decoded(part)
    before = indexed(data)
    splices, expected, n, reasons = [], {}, 0, []
    for i, own in edits.items():
        if not 0 <= i < len(before):
            raise Unsafe(f"there is no paragraph {i}")
        new, text, made, why = paragraph_splices(data, before[i], own, best_effort)
        splices += new
        n += made
        reasons += [(i, x) for x in why]
        if made:
            expected[i] = text
    if not splices:
        return part, 0, reasons
    out, at = [], 0
    for begin, end, new in sorted(splices):
        if begin < at:
            raise Unsafe("edits overlap")
        out += (data[at:begin], new)
        at = end
    data = b"".join([*out, data[at:]])
    after, edited = paragraph_texts(data), sorted(before[i].begin for i in expected)
    around = [bisect_left(edited, p.end) > bisect_right(edited, p.begin) for p in before]  # paragraphs that hold an edited one in a text box
    if len(after) != len(before) or any(a != expected.get(i, b.text) for i, (a, b) in enumerate(zip(after, before)) if not around[i]):
        raise Unsafe("text changed outside of the spans")
    return data.decode().encode(encoding) if encoding else data, n, reasons
