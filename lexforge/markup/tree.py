"""Markup of articles: text to a typed tree, rewrites, and three printed forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


class MarkupError(ValueError):
    pass


@dataclass
class Node:
    """``kind`` with ``text`` and attributes; a cell, a table, a piece of plain text, a break."""

    kind: str
    text: str = ""
    attrs: dict = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def walk(self, parent: int = -1, depth: int = 0, ids: Iterator[int] | None = None, pos: int = 0):
        ids = iter(range(1 << 40)) if ids is None else ids
        own = next(ids)
        yield own, parent, pos, depth, self
        for k, child in enumerate(self.children):
            yield from child.walk(own, depth + 1, ids, k)


#: Tags that hold text up to their brace.
_SPANS = (("u{", "underline"), ("b{", "bold"), ("i{", "italic"), ("s{", "italic"), ("sup{", "superscript"), ("sub{", "subscript"))
#: Table tags: without numbers, with one, with a range.
_BARE, _COUNT, _RANGE = ("tau", "tcd", "tld", "ter", "ted"), ("tcn", "tln"), ("tfl", "tcl", "tcr", "tcm", "tfu", "tlt")
_LITERAL = {"@": "@", "\\": "\\", "~": "~", ";": ";", "S": "↑"}
_COLOUR = re.compile(r"([0-9a-fA-F]{2})\s?([0-9a-fA-F]{2})\s?([0-9a-fA-F]{2})")
_NAMED = {"ADD": "addendum", "UE": "addendum", "WebLink": "weblink", "Left": "alignment", "Right": "alignment", "Center": "alignment"}
_OPENING, _CLOSING = re.compile(r"F\{([_~])([^_~}]*)\}"), re.compile(r"F\{([^_~}]*)[_~]\}")
_RANGED, _DIGITS, _PLAIN = re.compile(r"(\d+)(?:-(\d+))?"), re.compile(r"\d+"), re.compile(r"[^@\\~\n\r;}]+")
COLOURS = {0x000000: "black", 0xFF0000: "red", 0x008000: "green", 0x0000FF: "blue", 0x808080: "gray", 0xFFFFFF: "white", 0xFFFF00: "yellow", 0x800080: "purple", 0xFFA500: "orange", 0xA52A2A: "brown"}


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text.partition("\0")[0], 0
        self.root = Node("text")
        self.stack = [self.root]
        self.plain: list[str] = []
        self.tables: list[dict] = []

    def here(self) -> Node:
        if not self.stack:
            raise MarkupError("mismatched tags")
        return self.stack[-1]

    def eat(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def match(self, pattern: re.Pattern[str]) -> re.Match[str] | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def must(self, found):
        if not found:
            raise MarkupError(f"unexpected {self.text[self.at : self.at + 10]!r}")
        return found

    def end_plain(self) -> None:
        if self.plain:
            self.here().children.append(Node("plain", "".join(self.plain)))
            self.plain = []

    def add(self, kind: str, **attrs) -> None:
        self.end_plain()
        self.here().children.append(Node(kind, attrs=attrs))

    def open(self, kind: str, **attrs) -> Node:
        self.end_plain()
        node = Node(kind, attrs=attrs)
        self.here().children.append(node)
        self.stack.append(node)
        return node

    def close(self) -> None:
        self.end_plain()
        self.here()
        self.stack.pop()

    def run(self, semicolon: bool = True, brace: bool = False) -> None:
        """Text up to a sign that ends it here."""
        while self.at < len(self.text):
            if m := self.match(_PLAIN):
                self.plain.append(m[0])
                continue
            c = self.text[self.at]
            if c == "@":
                self.at += 1
                self.at_sign()
            elif c == "\\":
                self.at += 1
                self.backslash()
            elif self.eat("\n") or self.eat("\r\n"):
                self.add("soft_break")
            elif self.eat("~"):
                self.plain.append(" ")
            elif c == ";" and not semicolon or c == "}" and not brace:
                return
            else:
                self.plain.append(c)
                self.at += 1
        self.end_plain()

    def at_sign(self) -> None:
        c = self.text[self.at : self.at + 1]
        if c in _LITERAL and c:
            self.at += 1
            self.plain.append(_LITERAL[c])
        elif self.eat("C%ID="):
            m = self.match(_DIGITS)
            self.eat("%")
            self.add("id", id=int(m[0]) if m else -1)
        elif self.eat("C"):
            self.end_plain()
            line = self.text.find("\n", self.at)
            self.at = len(self.text) if line < 0 else line + 1
        elif c.isascii() and c.isdigit():
            self.at += 1
            self.add("sticky", num=int(c))
        else:
            self.end_plain()

    def backslash(self) -> None:
        if self.eat("'"):
            self.plain.append("'")
            return
        if self.eat("\\"):
            self.add("break")
            return
        if self.eat("{"):
            self.plain.append("\\{")
            self.run()
            self.eat("}")
            self.plain.append("}")
            return
        for mark, kind in _SPANS:
            if self.eat(mark):
                self.open(kind)
                self.run()
                self.close()
                self.eat("}")
                return
        if self.eat("eb{"):
            self.add("tab", column=int(self.must(self.match(_DIGITS))[0]))
            self.eat("}")
            return
        if self.eat("ee"):
            self.add("tab", column=-1)
            return
        if self.eat("tab{"):
            self.tables.append({"rows": 0, "columns": 0, "cells": 0, "open": False})
            self.open("table")
            self.run(True, True)
            return
        if self.table_tag():
            return
        if m := self.match(_OPENING):
            name = m[2]
            if rgb := _COLOUR.fullmatch(name):
                value = int("".join(rgb.groups()), 16)
                self.open("color", rgb=value, name=COLOURS.get(value, "black"), tilde=m[1] == "~")
            else:
                self.open(self.must(_NAMED.get(name)))
            self.run()
            return
        if m := self.match(_CLOSING):
            self.end_plain()
            if self.here().kind == _NAMED.get(m[1], "color"):
                self.close()
            return
        if self.eat("S{"):
            self.reference()
        elif self.eat("w{"):
            self.sound()

    def table_tag(self) -> bool:
        name = self.text[self.at : self.at + 3]
        if name not in (*_BARE, *_COUNT, *_RANGE, "tcc"):
            return False
        self.at += 3
        self.end_plain()
        if not self.tables:
            raise MarkupError("a table tag outside of a table")
        table = self.tables[-1]
        if name == "tcc":
            if table["cells"] < table["rows"] * table["columns"]:
                if table["open"]:
                    self.close()
                self.open("cell")
                table["open"], table["cells"] = True, table["cells"] + 1
            elif self.eat("}"):
                for _ in range(1 + table["open"]):
                    self.close()
                self.tables.pop()
        elif name in _BARE:
            self.add("table_tag", tag=name, first=-1, last=-1)
        elif name in _COUNT:
            n = int(self.must(self.match(_DIGITS))[0])
            table["columns" if name == "tcn" else "rows"] = n
            self.add("table_tag", tag=name, first=n, last=-1)
        else:
            m = self.must(self.match(_RANGED))
            self.add("table_tag", tag=name, first=int(m[1]), last=int(m[2] or m[1]))
        return True

    def part(self) -> None:
        self.run(False)
        self.end_plain()

    def reference(self) -> None:
        node = self.open("placeholder", code="", num=-1, num2=-1)
        self.open("text")
        self.part()
        self.close()
        if not self.eat(";"):
            return
        if self.eat("."):
            m = self.must(self.match(re.compile(r"[^:;}]*(?=[:;}])")))
            node.attrs["code"] = m[0]
        if self.eat(":"):
            for key, sign in (("num", ""), ("num2", "-")):
                if self.eat(sign) and (m := self.match(_DIGITS)):
                    node.attrs[key] = int(m[0])
        while self.eat(";"):
            self.part()
        if self.eat(":"):
            first = int(self.must(self.match(_DIGITS))[0])
            node.attrs["range"] = (first, int(self.must(self.match(_DIGITS))[0]) if self.eat("-") else 0)
        if not self.eat("}"):
            # a semicolon that should have been escaped
            self.plain.append(";")
            self.part()
            while self.eat(";"):
                self.part()
            self.must(self.eat("}"))
        self.close()

    def sound(self) -> None:
        self.open("sound")
        while True:
            self.open("text")
            self.part()
            self.close()
            if not self.eat(";"):
                break
        self.must(self.eat("}"))
        self.close()


_STICKY = {1: ("bold",), 4: ("bold",), 7: ("bold",), 3: ("bold", "italic"), 2: ("italic",)}


def _unstick(node: Node) -> None:
    """Sticky marks become regions, up to the next mark of the same parent."""
    for child in node.children:
        _unstick(child)
    out: list[Node] = []
    target = out
    for child in node.children:
        if child.kind != "sticky":
            target.append(child)
            continue
        target = out
        for kind in _STICKY.get(child.attrs["num"], ()):
            target.append(Node(kind))
            target = target[-1].children
    node.children = out


def _span_tables(node: Node) -> None:
    for child in node.children:
        _span_tables(child)
    if node.kind == "table":
        node.attrs["grid"] = grid(node)


def _own(node: Node) -> Iterator[Node]:
    """What belongs to a table, without what belongs to tables within it."""
    for child in node.children:
        yield child
        if child.kind != "table":
            yield from _own(child)


def grid(table: Node) -> list[list[dict]]:
    """Cells in rows, with their spans; ``tcm`` and ``tlm``-like ranges are merged into the cell before them.

    A table within a cell keeps its cells to itself.
    """
    tags = {c.attrs["tag"]: c.attrs["first"] for c in _own(table) if c.kind == "table_tag" and c.attrs["tag"] in _COUNT}
    columns, rows = tags.get("tcn", 0), tags.get("tln", 0)
    cells = [{"node": c, "across": False, "down": False, "hspan": 1, "vspan": 1} for c in _own(table) if c.kind == "cell"]
    at = -1
    for c in _own(table):
        if c.kind == "cell":
            at += 1
        elif c.kind == "table_tag" and at >= 0 and c.attrs["tag"] in ("tcd", "tld"):
            cells[at]["across" if c.attrs["tag"] == "tcd" else "down"] = True
    cells += [{"node": Node("cell"), "across": False, "down": False, "hspan": 1, "vspan": 1} for _ in range(rows * columns - len(cells))]
    out = [cells[r * columns : (r + 1) * columns] for r in range(rows)]
    for line, mark, span in [(r, "across", "hspan") for r in out] + [([r[k] for r in out], "down", "vspan") for k in range(columns if out else 0)]:
        owner = line[0] if line else None
        for cell in line:
            if cell[mark]:
                owner[span] += 1
            else:
                owner = cell
    return out


def parse(text: str) -> Node:
    p = _Parser(text)
    p.run(True, True)
    p.end_plain()
    _unstick(p.root)
    _span_tables(p.root)
    return p.root


def without_extra_breaks(node: Node) -> Node:
    """The tree without invisible nodes, breaks that lead, and breaks in excess: hard ones win over soft ones."""
    out: list[Node] = []
    run: list[Node] = []

    def end_run() -> None:
        if out:
            hard = [b for b in run if b.kind == "break"]
            out.extend(run if len(run) < 2 else hard or run[-1:])
        run.clear()

    for child in node.children:
        if child.kind in ("placeholder", "id"):
            continue
        if child.kind in ("break", "soft_break"):
            run.append(child)
        else:
            end_run()
            out.append(without_extra_breaks(child))
    end_run()
    return Node(node.kind, node.text, node.attrs, out)


_ESCAPED = re.compile(r"([\[\]#~^@])")
_DSL_TAGS = {"bold": "b", "italic": "i", "underline": "u", "weblink": "url", "superscript": "sup", "subscript": "sub"}
TRIMMED = " \t,;!?-."
_RULER = "-" * 10


def _dsl(node: Node) -> str:
    inner = "".join(map(_dsl, node.children))
    kind, a = node.kind, node.attrs
    if kind == "plain":
        return _ESCAPED.sub(r"\\\1", node.text)
    if kind in _DSL_TAGS:
        return f"[{_DSL_TAGS[kind]}]{inner}[/{_DSL_TAGS[kind]}]"
    if kind == "color":
        return inner if a["tilde"] else f"[c {a['name']}]{inner}[/c]"
    if kind == "addendum":
        return f"({inner})"
    if kind == "break":
        return "[br]\n"
    if kind == "soft_break":
        return " "
    if kind == "article_reference":
        body = inner.strip(TRIMMED)
        at = inner.find(body)
        extra = "" if a["heading"] == body else f" ({body})"
        return f"{inner[:at]}[ref]{a['heading']}[/ref]{extra}{inner[at + len(body) :]}"
    if kind == "image":
        return f"[s]{a.get('secondary') or a['name']}[/s]"
    if kind == "sound":
        names = a.get("names") or [""] * len(node.children)
        return ", ".join(f"[s]{n}[/s]{_dsl(c)}" if n else f"[s]{_dsl(c)}[/s]" for n, c in zip(names, node.children)) + " "
    if kind == "web_reference":
        return f"[url]{a['link']}[/url]" if inner in ("", a["link"]) else f"{inner} ([url]{a['link']}[/url])"
    if kind == "table_reference":
        return f"\n{_RULER}\n{inner}\n{_dsl(a['content'])}{_RULER}\n" if "content" in a else inner
    if kind == "picture_reference":
        return f"\n{_RULER}\n{_dsl(a['header'])}\n{_dsl(a['description'])}\n[s]{a['image']}[/s]\n{a['copyright']}\n{_RULER}\n" if "header" in a else inner
    if kind == "table":
        return f"\n[s]{a['rendered']}[/s]" if a.get("rendered") else ""
    if kind in ("placeholder", "tab", "id", "table_tag"):
        return ""
    return inner


def dsl(node: Node) -> str:
    return _dsl(without_extra_breaks(node))


def dsl_heading(node: Node) -> str:
    return dsl(node).replace("(", "\\(").replace(")", "\\)")


_HTML_TAGS = {"bold": "b", "italic": "i", "underline": "u", "superscript": "sup", "subscript": "sub"}


def html(node: Node) -> str:
    """A hard break is an element, a soft one nothing; tables have their spans, cells a width in whole per cents."""
    inner = "".join(map(html, node.children)) if node.kind != "table" else ""
    if node.kind == "plain":
        return node.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if node.kind in _HTML_TAGS:
        return f"<{_HTML_TAGS[node.kind]}>{inner}</{_HTML_TAGS[node.kind]}>"
    if node.kind == "color" and not node.attrs["tilde"]:
        return f'<font color="#{node.attrs["rgb"]:06x}">{inner}</font>'
    if node.kind == "addendum":
        return f"({inner})"
    if node.kind == "break":
        return "<br>"
    if node.kind == "table":
        rows = node.attrs.get("grid", [])
        cell = lambda c, n: f'<td width="{100 // n * c["hspan"]}%" colspan="{c["hspan"]}" rowspan="{c["vspan"]}">{html(c["node"])}</td>'
        return "<table>" + "".join("<tr>" + "".join(cell(c, len(r)) for c in r if not c["across"] and not c["down"]) + "</tr>" for r in rows) + "</table>"
    return "" if node.kind in ("placeholder", "tab", "id", "table_tag", "soft_break") else inner


_TITLES = {
    "text": "TextRun", "plain": "PlainRun", "bold": "BoldFormattingRun", "italic": "ItalicFormattingRun", "underline": "UnderlineFormattingRun", "weblink": "WebLinkFormattingRun", "color": "ColorFormattingRun",
    "addendum": "AddendumFormattingRun", "alignment": "AlignmentFormattingRun", "superscript": "SuperscriptFormattingRun", "subscript": "SubscriptFormattingRun", "article_reference": "ArticleReferenceRun", "id": "IdRun",
    "tab": "TabRun", "placeholder": "ReferencePlaceholderRun", "break": "LineBreakRun", "soft_break": "SoftLineBreakRun", "table": "TableRun", "table_tag": "TableTag", "cell": "TableCellRun", "table_reference": "TableReferenceRun",
    "picture_reference": "PictureReferenceRun", "web_reference": "WebReferenceRun", "image": "InlineImageRun", "sound": "InlineSoundRun", "sticky": "StickyRun",
}
_TAG_NUMBERS = {t: k for k, t in enumerate("- tcn tln tau tcd tfl tcl tcr tld tfu tlt tcc ter tcm ted".split())}


def _title(node: Node) -> str:
    """What :func:`outline` says of a node: its title and attributes."""
    a, kind = node.attrs, node.kind
    title = _TITLES.get(kind, kind)
    if kind == "plain":
        return f"{title}: {node.text}"
    if kind == "color":
        return f"{title}; rgb={a['rgb']:06x}; name={a['name']}; tilde={int(a['tilde'])}"
    if kind in ("id", "tab"):
        return f"{title}: {a['id' if kind == 'id' else 'column']}"
    if kind == "placeholder":
        return f"{title}; code={a['code']}; num={a['num']}; num2={a['num2']}" + ("; range={}-{}".format(*a["range"]) if "range" in a else "")
    if kind == "table_tag":
        return f"{title} {_TAG_NUMBERS.get(a['tag'], a['tag'])}; from={a['first']}; to={a['last']}"
    if kind == "table":
        return title + (f" {a['rendered']}" if a.get("rendered") else "")
    shown = {
        "article_reference": (("offset", "offset"),), "table_reference": (("offset", "offset"), ("file", "file")), "picture_reference": (("offset", "offset"), ("file", "file"), ("cr", "copyright"), ("image", "image")),
        "web_reference": (("link", "link"),), "image": (("name", "name"), ("secondary", "secondary")), "sticky": (("num", "num"),),
    }.get(kind, ())
    if kind == "sound":
        return f"{title}; name=[" + ", ".join(f"({n})" for n in a.get("names", ())) + "]"
    return title + "".join(f"; {label}={a.get(key, '')}" for label, key in shown)


def outline(node: Node, depth: int = 0) -> str:
    """A line for each node, indented by depth."""
    return "  " * depth + _title(node) + "\n" + "".join(outline(c, depth + 1) for c in node.children)


@dataclass(frozen=True)
class Known:
    """What a dictionary's descriptor tells of references: (type, name, code) of each, ranges (file, first, last), and the files on disk by their name in lower case."""

    references: tuple[tuple[str, str, str], ...] = (("WEB", "Web", "W"),)
    ranges: tuple[tuple[str, int, int], ...] = ()
    files: dict[str, str] = field(default_factory=dict)

    def spelled(self, name: str) -> str:
        return self.files.get(name.lower(), name)


def _sound_file(name: str) -> str:
    return name[:-4] + ".wav" if name.lower().endswith(".adp") else name


def _resolved(node: Node, known: Known) -> Node:
    """What a placeholder stands for; the placeholder itself where that can't be told."""
    a, caption = node.attrs, node.children[0] if node.children else Node("text")
    code, last = a["code"], node.children[-1] if node.children else Node("text")
    if not code:
        return Node("article_reference", attrs={"offset": a["num"]}, children=[caption]) if caption.children and a["num"] != -1 else node
    kind, code = code[0], code[1:]
    if kind == "I":
        more = node.children[1:3]
        sound = len(more) == 2 and all(x.kind == "plain" for x in more) and more[0].text == "T"
        return Node("image", attrs={"name": known.spelled(code), "secondary": known.spelled(_sound_file(more[1].text)) if sound else ""})
    name = next((n for _, n, c in known.references if c == code), None)
    if name is None or kind != "M":
        return node
    if name == "Web":
        return Node("web_reference", attrs={"link": last.text}, children=[caption]) if last.kind == "plain" else node
    if name in ("Tabellen", "Bilder") and a["num"]:
        file, offset = in_range(known.ranges, a["num"])
        table = name == "Tabellen"
        return Node("table_reference" if table else "picture_reference", attrs={"offset": offset, "file": file}, children=[caption if table else last])
    return node


def _named_sounds(node: Node) -> Node:
    """A sound with its files' names, and what follows each name as its label."""
    if "names" in node.attrs:
        return node
    names, children = [], []
    for child in node.children:
        head = child.children[0] if child.children else None
        if head is None or head.kind != "plain":
            raise MarkupError("a sound without a file")
        at = head.text.find(' "')
        names.append(_sound_file(head.text if at < 0 else head.text[:at]))
        children.append(Node(child.kind, child.text, child.attrs, [Node("plain", "" if at < 0 else head.text[at:]), *child.children[1:]]))
    return Node("sound", attrs={**node.attrs, "names": names}, children=children)


def resolve(node: Node, known: Known) -> Node:
    """The tree with placeholders resolved by their code: images and sounds by name, articles by offset, tables, pictures and web pages by the descriptor; a second time nothing changes."""
    children = []
    for child in node.children:
        child = resolve(child, known)
        children.append(_resolved(child, known) if child.kind == "placeholder" else _named_sounds(child) if child.kind == "sound" else child)
    return Node(node.kind, node.text, node.attrs, children)


def resolve_articles(node: Node, heading_of: Callable[[int, str], str]) -> Node:
    """The tree in which each reference to an article shows the heading that ``heading_of`` gives for its place and caption."""
    children = [resolve_articles(c, heading_of) for c in node.children]
    if node.kind == "article_reference":
        caption = "".join(map(_dsl, children))
        return Node(node.kind, node.text, {**node.attrs, "heading": heading_of(node.attrs["offset"] - 1, caption.strip(TRIMMED))}, children)
    return Node(node.kind, node.text, node.attrs, children)


def picture(lines: Iterator[str]) -> dict:
    """Header, copyright, image and description of an external picture: its attributes are comments, and the first line without is the description."""
    out = {"header": parse(next(lines, "")), "copyright": "", "image": "", "type": "", "description": Node("text")}
    for line in lines:
        line = line.rstrip("\r")
        for mark, key in (("@C%CR=", "copyright"), ("@C%File=", "image"), ("@C%Type=", "type")):
            if line.startswith(mark):
                out[key] = line[len(mark) :]
                break
        else:
            if line.startswith("@C%"):
                raise MarkupError("an unknown attribute of a picture")
            if not line.startswith("@C"):
                out["description"] = parse(line)
                return out
    return out


def table_text(lines: Iterator[str]) -> dict:
    """Content and ``mt`` of an external table, which goes up to the line that refers to nothing."""
    held, mt = [], ""
    for line in lines:
        if line.startswith("@C%MT="):
            mt = line[6:].strip().strip('"')
            continue
        held.append(line + "\n")
        if line.startswith("\\S{;:"):
            return {"content": parse("".join(held)), "mt": mt}
    raise MarkupError("a table without an end")


def inline(node: Node, secondary: Callable[[str, int], Iterator[str]]) -> Node:
    """The tree with external tables and pictures read in; ``secondary`` gives the lines of a file from an offset on."""
    children = [inline(c, secondary) for c in node.children]
    read = {"table_reference": table_text, "picture_reference": picture}.get(node.kind)
    more = read(secondary(node.attrs["file"], node.attrs["offset"])) if read else {}
    return Node(node.kind, node.text, {**node.attrs, **more}, children)


def in_range(ranges: list[tuple[str, int, int]], offset: int) -> tuple[str, int]:
    """File and offset in it of the first range that holds an offset; none is an error."""
    for name, first, last in ranges:
        if first <= offset < last:
            return name, offset - first
    raise MarkupError(f"no range holds {offset}")


def without_heading(node: Node, headings: list[str]) -> Node:
    """The article without its heading at the very start, if it has one heading and begins with it."""
    if len(headings) != 1:
        return node
    spot = node
    while spot.children and spot.children[0].kind not in ("plain", "break", "soft_break"):
        spot = spot.children[0]
    if not spot.children or spot.children[0].kind != "plain" or spot.children[0].text.rstrip("\r\n\t: ") != headings[0]:
        return node
    del spot.children[0]
    while node.children and node.children[0].kind in ("break", "soft_break"):
        del node.children[0]
    return node
