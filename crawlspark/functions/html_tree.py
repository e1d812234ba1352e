"""The tree that the HTML standard's parser builds, as far as links and texts depend on it.

One pass over the tags: a stack of open elements, scopes, implied ends, raw text, formatting
elements that are opened again or taken apart where tags overlap, content that does not belong into
tables put before them, lists of options, and SVG and MathML. Scripting counts as on, so noscript is text.
Head and body are one element, as no link or text depends on which of them it is in; framesets are not read.
"""

from __future__ import annotations

import re
from html import unescape

_SPACE = "\t\n\f\r "
_NAME = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />]*)")
_ATTR = re.compile(r"[\t\n\f\r /]*(=?[^\t\n\f\r />=]*)[\t\n\f\r ]*(=?)")
_VALUE = re.compile(r"[\t\n\f\r ]*(?:([\"'])|([^\t\n\f\r >]*))")
_COMMENT_END = re.compile(r"--!?>")

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style xmp".split())
ESCAPABLE = frozenset(("textarea", "title"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
MARKED = frozenset(("applet", "marquee", "object", "template", "td", "th", "caption"))
#: Start tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing form plaintext xmp hr".split()) | HEADINGS
SPECIAL = CLOSES_P - {"dialog", "search"} | MARKED | VOID - {"frame"} | RAW - {"noembed"} | {"noembed", "body", "html", "li", "dd", "dt", "button", "table", "tbody", "tfoot", "thead", "tr", "colgroup", "select", "textarea", "title", "frameset", "head"}
ENDS_BLOCK = (CLOSES_P | {"button"}) - HEADINGS - {"p", "hr", "plaintext", "xmp", "form"}
ROWS = frozenset(("tbody", "tfoot", "thead"))
IN_TABLE = ROWS | {"table", "tr"}
TABLE_PARTS = ROWS | {"caption", "col", "colgroup", "tr", "td", "th"}
SCOPE = frozenset("html applet caption table td th marquee object template".split())
#: Start tags that end SVG and MathML.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: SVG and MathML elements whose content is HTML, or text that HTML may follow.
HTML_INSIDE, TEXT_INSIDE = frozenset(("foreignobject", "desc", "title")), frozenset(("mi", "mo", "mn", "ms", "mtext"))


class Node:
    __slots__ = ("tag", "attrs", "foreign", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: str = ""):
        self.tag, self.attrs, self.foreign, self.parent, self.children = tag, attrs, foreign, None, []

    def add(self, child: Node | str, before: Node | None = None) -> None:
        if isinstance(child, Node):
            child.take_out()
            child.parent = self
        self.children.insert(_place(self.children, before), child) if before is not None else self.children.append(child)

    def take_out(self) -> None:
        if self.parent is not None:
            del self.parent.children[_place(self.parent.children, self)]
            self.parent = None

    def walk(self):
        """Elements and strings in document order, without recursion."""
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.children))

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))


def _special(n: Node) -> bool:
    if n.foreign:
        return n.tag in (TEXT_INSIDE if n.foreign == "math" else HTML_INSIDE) or n.tag == "annotation-xml"
    return n.tag in SPECIAL


def _place(children: list, node: Node) -> int:
    """From the end, as what is looked for has been added lately."""
    for i in range(len(children) - 1, -1, -1):
        if children[i] is node:
            return i
    raise ValueError("not a child")


class Builder:
    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.active: list[Node | None] = []  # formatting elements; None is a marker
        self.quirks, self.form = True, None

    # the stack
    @property
    def top(self) -> Node:
        return self.open[-1]

    def within(self, *tags: str, also: frozenset | set = frozenset(), scope: frozenset = SCOPE) -> bool:
        """Whether one of the tags is open, with no end of scope above it."""
        for n in reversed(self.open):
            if n.foreign:
                if _special(n):
                    return False
            elif n.tag in tags:
                return True
            elif n.tag in scope or n.tag in also:
                return False
        return False

    def pop_to(self, *tags: str) -> None:
        while len(self.open) > 1:
            n = self.open.pop()
            if n.tag in tags and not n.foreign:
                return

    def imply(self, but: str = "") -> None:
        while self.top.tag in IMPLIED and self.top.tag != but and not self.top.foreign:
            self.open.pop()

    def close_p(self) -> None:
        if self.within("p", also={"button"}):
            self.imply("p")
            self.pop_to("p")

    def unmark(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # insertion
    def _spot(self, parent: Node | None = None) -> tuple[Node, Node | None]:
        """Where a node goes: into the current one, but before a table whose rows cannot hold it."""
        target = parent or self.top
        if target.tag not in IN_TABLE or target.foreign:
            return target, None
        for i in range(len(self.open) - 1, 0, -1):
            n = self.open[i]
            if n.tag == "template" and not n.foreign:
                return n, None
            if n.tag == "table" and not n.foreign:
                return (n.parent, n) if n.parent is not None else (self.open[i - 1], None)
        return self.open[0], None

    def insert(self, tag: str, attrs: dict[str, str], foreign: str = "", foster: bool = True) -> Node:
        node = Node(tag, attrs, foreign)
        parent, before = self._spot() if foster else (self.top, None)
        parent.add(node, before)
        self.open.append(node)
        return node

    def text(self, data: str) -> None:
        if not data:
            return
        if self.top.tag in IN_TABLE and not self.top.foreign:
            if not data.strip(_SPACE):
                self.top.children.append(data)
                return
        if not self.top.foreign and not (self.top.tag == "select" or self.within("select", scope=SCOPE)):
            self.reopen()
        parent, before = self._spot()
        parent.add(data, before)

    # formatting elements
    def reopen(self) -> None:
        i = len(self.active)
        while i and self.active[i - 1] is not None and self.active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.insert(old.tag, old.attrs)

    def format(self, tag: str, attrs: dict[str, str]) -> None:
        node, same = self.insert(tag, attrs), []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == tag and n.attrs == attrs:
                same.append(n)
        if len(same) >= 3:  # no more than three alike
            self._forget(same[-1])
        self.active.append(node)

    def _forget(self, node: Node) -> None:
        self.active = [n for n in self.active if n is not node]

    def _drop(self, node: Node) -> None:
        self.open = [n for n in self.open if n is not node]

    @staticmethod
    def _at(nodes: list, node: Node) -> int:
        return next((i for i in range(len(nodes) - 1, -1, -1) if nodes[i] is node), -1)

    def adopt(self, tag: str) -> None:
        """The end tag of a formatting element, whatever overlaps it."""
        if self.top.tag == tag and not self.top.foreign and self._at(self.active, self.top) < 0:
            self.open.pop()
            return
        for _ in range(8):
            found = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    found = n
                    break
            if found is None:
                self.end_other(tag)
                return
            at = self._at(self.open, found)
            if at < 0:
                self._forget(found)
                return
            if not self.within(tag):
                return
            lower = next((i for i in range(at + 1, len(self.open)) if _special(self.open[i])), None)
            if lower is None:
                del self.open[at:]
                self._forget(found)
                return
            block, above = self.open[lower], self.open[at - 1]
            mark, last, i = self._at(self.active, found), block, lower
            for count in range(1, 1 << 30):
                i -= 1
                node = self.open[i]
                if node is found:
                    break
                if count > 3:
                    self._forget(node)
                k = self._at(self.active, node)
                if k < 0:
                    del self.open[i]
                    continue
                copy = Node(node.tag, node.attrs)
                self.active[k] = self.open[i] = copy
                if last is block:
                    mark = k + 1
                copy.add(last)
                last = copy
            parent, before = self._spot(above)
            last.take_out()
            parent.add(last, before)
            copy = Node(found.tag, found.attrs)
            for child in block.children:
                if isinstance(child, Node):
                    child.parent = copy
            copy.children, block.children = block.children, []
            block.add(copy)
            k = self._at(self.active, found)
            del self.active[k]
            self.active.insert(mark - (k < mark), copy)
            self._drop(found)
            self.open.insert(self._at(self.open, block) + 1, copy)

    # tags
    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        top = self.top
        if top.foreign and not self._html_may_follow(tag):
            if tag in BREAKOUT or tag == "font" and {"color", "face", "size"} & set(attrs):
                while self.top.foreign and not self._html_may_follow(tag):
                    self.open.pop()
                self.start(tag, attrs, closed)
                return
            self.insert(tag, attrs, top.foreign)
            if closed:
                self.open.pop()
            return
        if tag == "image":
            tag = "img"
        if tag in ("html", "head", "body", "frameset", "frame"):
            return
        if self.within("select") and not self._start_in_select(tag, attrs):
            return
        if (tag in TABLE_PARTS or tag == "table") and self._start_table(tag, attrs):
            return
        self._start_in_body(tag, attrs, closed)

    def _html_may_follow(self, tag: str) -> bool:
        top = self.top
        if top.foreign == "math" and top.tag in TEXT_INSIDE:
            return tag not in ("mglyph", "malignmark")
        if top.foreign == "math" and top.tag == "annotation-xml":
            return tag == "svg" or top.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")
        return top.foreign == "svg" and top.tag in HTML_INSIDE

    def _start_in_select(self, tag: str, attrs: dict[str, str]) -> bool:
        """Only options live in a list of options. Whether the tag is to be read as if outside."""
        if tag in ("option", "optgroup", "hr"):
            if self.top.tag == "option":
                self.open.pop()
            if tag != "option" and self.top.tag == "optgroup":
                self.open.pop()
            self.insert(tag, attrs)
            if tag == "hr":
                self.open.pop()
        elif tag == "select":
            self.pop_to("select")
        elif tag in ("input", "keygen", "textarea") or tag in TABLE_PARTS or tag == "table":
            self.pop_to("select")
            return True
        elif tag in ("script", "template"):
            return True
        return False

    def _start_table(self, tag: str, attrs: dict[str, str]) -> bool:
        """Parts of tables; false: nothing special about it here."""
        if tag == "table":
            if self.top.tag in IN_TABLE and not self.top.foreign:  # a table in a table's row ends that table
                self.pop_to("table")
            elif not self.quirks:
                self.close_p()
            self.reopen() if self.top.tag not in IN_TABLE else None
            self.insert(tag, attrs)
            return True
        around = next(n.tag for n in reversed(self.open) if n.tag in ("table", "template", "html") and not n.foreign)
        if around == "html" or around == "template" and self.top.tag not in TABLE_PARTS and self.top.tag != "template":
            return True  # ignored outside of tables
        for cell in ("td", "th", "caption"):
            if self.within(cell, scope=frozenset(("html", "table", "template"))):
                self.imply()
                self.pop_to(cell)
                self.unmark()
                break
        keep = {"caption": (), "colgroup": (), "col": ("colgroup",), "tbody": (), "tfoot": (), "thead": (), "tr": ROWS, "td": ("tr",), "th": ("tr",)}[tag]
        while self.top.tag not in ("table", "template", "html", *keep):
            self.open.pop()
        if self.top.tag == "table":
            if tag == "col":
                self.insert("colgroup", {}, foster=False)
            elif tag in ("tr", "td", "th"):
                self.insert("tbody", {}, foster=False)
        if tag in ("td", "th") and self.top.tag in ROWS:
            self.insert("tr", {}, foster=False)
        self.insert(tag, attrs, foster=False)
        if tag == "col":
            self.open.pop()
        elif tag in MARKED:
            self.active.append(None)
        return True

    def _start_in_body(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if self.top.tag == "colgroup" and tag != "template":
            self.open.pop()
        if tag in ("svg", "math"):
            self.reopen()
            self.insert(tag, attrs, tag)
            if closed:
                self.open.pop()
            return
        if tag == "form":
            if self.form is not None:
                return
            self.close_p()
            self.form = self.insert(tag, attrs)
            return
        if tag in CLOSES_P:
            self.close_p()
            if tag in HEADINGS and self.top.tag in HEADINGS and not self.top.foreign:
                self.open.pop()
        elif tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.open):
                if n.tag in same and not n.foreign:
                    self.imply(n.tag)
                    self.pop_to(n.tag)
                    break
                if _special(n) and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag == "button" and self.within("button"):
            self.imply()
            self.pop_to("button")
        elif tag in ("option", "optgroup") and self.top.tag == "option":
            self.open.pop()
        elif tag in ("rb", "rtc") and self.within("ruby"):
            self.imply()
        elif tag in ("rp", "rt") and self.within("ruby"):
            self.imply("rtc")
        if tag in FORMATTING:
            if tag == "a":
                for n in reversed(self.active):
                    if n is None:
                        break
                    if n.tag == "a":
                        self.adopt("a")
                        self._forget(n)
                        self._drop(n)
                        break
            self.reopen()
            if tag == "nobr" and self.within("nobr"):
                self.adopt("nobr")
                self.reopen()
            self.format(tag, attrs)
            return
        if tag not in CLOSES_P and tag not in ("li", "dd", "dt", "base", "link", "meta", "title", "script", "style", "noframes", "template", "textarea", "rb", "rp", "rt", "rtc", "param", "source", "track"):
            self.reopen()
        hidden = tag == "input" and attrs.get("type", "").lower() == "hidden" or tag in ("script", "style", "template")
        self.insert(tag, attrs, foster=not hidden)
        if tag in VOID:
            self.open.pop()
        elif tag in MARKED:
            self.active.append(None)

    def end(self, tag: str) -> None:
        if self.top.foreign and tag not in ("p", "br"):
            for i in range(len(self.open) - 1, 0, -1):
                if not self.open[i].foreign:
                    break
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return
        while self.top.foreign and tag in ("p", "br"):
            self.open.pop()
        if tag in ("html", "head", "body", "frameset") or tag in VOID and tag != "br":
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "select":
            if self.within("select"):
                self.pop_to("select")
        elif tag == "table" or tag in TABLE_PARTS:
            self._end_table(tag)
        elif self.within("select") and tag not in ("option", "optgroup", "template"):
            return
        elif tag == "p":
            if not self.within("p", also={"button"}):
                self._start_in_body("p", {}, False)
            self.close_p()
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and self.within("form"):
                self.imply()
                self._drop(node)
        elif tag in HEADINGS:
            if self.within(*HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif tag in ("li", "dd", "dt"):
            if self.within(tag, also={"ol", "ul"} if tag == "li" else set()):
                self.imply(tag)
                self.pop_to(tag)
        elif tag in ENDS_BLOCK:
            if self.within(tag):
                self.imply()
                self.pop_to(tag)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in MARKED:
            if self.within(tag, scope=frozenset(("html",)) if tag == "template" else SCOPE):
                self.imply()
                self.pop_to(tag)
                self.unmark()
        else:
            self.end_other(tag)

    def _end_table(self, tag: str) -> None:
        if not self.within(tag, scope=frozenset(("html", "table", "template"))):
            return
        if tag not in ("td", "th", "caption"):
            for cell in ("td", "th", "caption"):
                if self.within(cell, scope=frozenset(("html", "table", "template"))):
                    self.pop_to(cell)
                    self.unmark()
        self.imply()
        self.pop_to(tag)
        if tag in ("td", "th", "caption"):
            self.unmark()

    def end_other(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            n = self.open[i]
            if n.tag == tag and not n.foreign:
                self.imply(tag)
                del self.open[i:]
                return
            if _special(n):
                return


def _attributes(text: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag from its name on, whether it closes itself, and where it ends; -1 where the text ends first."""
    attrs: dict[str, str] = {}
    if text.startswith(">", at):
        return attrs, False, at + 1
    while True:
        m = _ATTR.match(text, at)
        name, at = m[1].lower(), m.end()
        value = ""
        if name and m[2]:
            v = _VALUE.match(text, at)
            at = v.end()
            if v[1]:
                end = text.find(v[1], at)
                if end < 0:
                    return attrs, False, -1
                value, at = text[at:end], end + 1
            else:
                value = v[2]
        if name:
            attrs.setdefault(name, unescape(value) if "&" in value else value)
        if at >= len(text):
            return attrs, False, -1
        if text[at] == ">":
            return attrs, text[at - 1] == "/" and not value.endswith("/"), at + 1


def parse(text: str) -> Node:
    """The root of the tree of a document. Null characters are left out."""
    text, b, at, n = text.replace("\0", ""), Builder(), 0, 0
    n = len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            b.text(unescape(text[at:lt]))
        if lt == n:
            break
        m = _NAME.match(text, lt)
        if m is None:
            at = _other(b, text, lt)
            continue
        tag = m[2].lower()
        attrs, closed, at = _attributes(text, m.end())
        if at < 0:
            break
        if m[1]:
            b.end(tag)
            continue
        before = b.top
        b.start(tag, attrs, closed)
        if (tag in RAW or tag in ESCAPABLE or tag == "plaintext") and b.top is not before and b.top.tag == tag and not b.top.foreign:
            end = None if tag == "plaintext" else re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I).search(text, at)
            stop = end.start() if end else n
            if raw := text[at:stop]:
                b.top.children.append(unescape(raw) if tag in ESCAPABLE else raw)
            at = stop
            if end:
                b.open.pop()
                _, _, at = _attributes(text, end.end())
                if at < 0:
                    break
    return b.root


def _other(b: Builder, text: str, at: int) -> int:
    """Comments, declarations and a < that begins nothing; where to go on."""
    if text.startswith("<!--", at):
        if short := re.compile(r"<!---?>").match(text, at):
            return short.end()
        end = _COMMENT_END.search(text, at + 4)
        return end.end() if end else len(text)
    if text.startswith("<![CDATA[", at) and b.top.foreign:
        end = text.find("]]>", at)
        b.text(text[at + 9 : end if end >= 0 else len(text)])
        return end + 3 if end >= 0 else len(text)
    if text[at + 1 : at + 2] in ("!", "?", "/") and at + 2 < len(text):
        if text[at + 2 : at + 9].lower() == "doctype" and not b.root.children:
            b.quirks = text[at + 9 : at + 15].strip(_SPACE + ">").lower()[:4] != "html"
        end = text.find(">", at)
        return end + 1 if end >= 0 else len(text)
    b.text("<")
    return at + 1
