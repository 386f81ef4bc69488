"""A small tolerant HTML reader: elements, their style path and the text below them."""

from __future__ import annotations

import html
import re

import xxhash

_NAME = r"[a-zA-Z][^\s/>]*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)({_NAME})([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
    "thead tr ul caption head title".split()
)
#: What may not close an open paragraph or list item from inside.
SCOPE = frozenset("article aside body td th table section main div blockquote figure form html".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Element:
    __slots__ = ("tag", "key", "path", "parent", "start", "end", "words", "shapes")

    def __init__(self, tag: str, key: str, path: int, parent: int, start: int, words: frozenset):
        self.tag, self.key, self.path, self.parent, self.start, self.end, self.words = tag, key, path, parent, start, start, words
        self.shapes: list[str] = []


class Page:
    """Elements in page order; ``texts`` are the decoded text runs with the element each lies in."""

    def __init__(self, source: str):
        self.elements: list[Element] = []
        self.texts: list[tuple[int, str]] = []
        self.breaks: set[int] = set()  # text positions that a br comes before
        self._parse(source)

    def _parse(self, source: str) -> None:
        elements, texts, open_ = self.elements, self.texts, [0]
        elements.append(Element("", "", 0, -1, 0, frozenset()))
        position, search, n = 0, TOKEN.search, len(source)
        while position < n:
            m = search(source, position)
            if m is None:
                self._text(source[position:], open_[-1])
                break
            if m.start() > position:
                self._text(source[position : m.start()], open_[-1])
            position = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"), open_[-1])
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(open_, tag)
                continue
            if tag == "br":
                texts.append((open_[-1], " "))
                continue
            self._make_room(open_, tag)
            attributes = m[3] if m[2] else m[6]
            number = self._open(open_[-1], tag, attributes or "")
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, position)
                position = n if end is None else end.start()
                if end is not None:
                    close = source.find(">", position)
                    position = n if close < 0 else close + 1
                elements[number].end = len(texts)
            elif tag not in VOID:
                open_.append(number)
        for number in open_:
            elements[number].end = len(texts)

    def _text(self, raw: str, owner: int) -> None:
        self.texts.append((owner, html.unescape(raw) if "&" in raw else raw))

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        names, role = [], ""
        if "=" in attributes:
            for k, a, b, c in ATTRIBUTE.findall(attributes):
                k = k.lower()
                if k in ("class", "id"):
                    names += html.unescape(a or b or c).lower().split()
                elif k in ("role", "itemprop"):
                    role = (a or b or c).lower()
        key = ".".join([tag, *sorted(n for n in names if not any(ch.isdigit() for ch in n))])
        if role:
            names.append(f"{role}=")
        up = self.elements[parent]
        if not up.shapes or up.shapes[-1] != key:
            up.shapes.append(key)
        words = frozenset(w for n in names for w in [n, *re.split(r"[-_]+", n)])
        path = xxhash.xxh64_intdigest(f"{up.path}/{key}")
        self.elements.append(Element(tag, key, path, parent, len(self.texts), words))
        return len(self.elements) - 1

    def _close(self, open_: list[int], tag: str) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if self.elements[open_[i]].tag == tag:
                for number in open_[i:]:
                    self.elements[number].end = len(self.texts)
                del open_[i:]
                return

    def _make_room(self, open_: list[int], tag: str) -> None:
        """Close what the start of ``tag`` ends: an open paragraph, or a list item or cell like it."""
        ends = ENDS_ITSELF.get(tag)
        if tag in BLOCK:
            for i in range(len(open_) - 1, 0, -1):
                name = self.elements[open_[i]].tag
                if name == "p":
                    for number in open_[i:]:
                        self.elements[number].end = len(self.texts)
                    del open_[i:]
                    break
                if name in SCOPE or name in BLOCK:
                    break
        if ends:
            for i in range(len(open_) - 1, 0, -1):
                name = self.elements[open_[i]].tag
                if name in ends:
                    for number in open_[i:]:
                        self.elements[number].end = len(self.texts)
                    del open_[i:]
                    break
                if name in ("ul", "ol", "dl", "table", "select") or name in SCOPE:
                    break

    def style_nodes(self) -> dict[int, tuple[int, int]]:
        """For each style path of the page the hash of its presentation and of the text below it."""
        joined, at = [], [0]
        for _, text in self.texts:
            joined.append(text)
            at.append(at[-1] + len(text))
        whole = "".join(joined)
        shapes: dict[int, list[str]] = {}
        contents: dict[int, list[str]] = {}
        for e in self.elements[1:]:
            shapes.setdefault(e.path, []).append(",".join(e.shapes))
            contents.setdefault(e.path, []).append(" ".join(whole[at[e.start] : at[e.end]].split()))
        return {
            p: (xxhash.xxh64_intdigest("|".join(dict.fromkeys(s))), xxhash.xxh64_intdigest("\x00".join(contents[p])))
            for p, s in shapes.items()
        }
