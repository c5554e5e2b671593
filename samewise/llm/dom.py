"""A forgiving block-level parser for HTML.

Only block elements become nodes; inline markup is dropped and its text belongs
to the block around it, a line break (br) is white space in it.  Every run of inline
text ends at a block boundary or a rule (hr).  Elements that hold no text of the page are skipped: those of raw
text up to their end tag, as browsers do; others are parsed, and end with their
end tag or with the block around them, so one left open hides no more than that.
"""

from __future__ import annotations

import re
from html import unescape

# Element names of HTML.
GROUPS = {
    "root": "html body",
    "head": "head title",
    "article": "article",
    "main": "main",
    "section": "section",
    "div": "div center",
    "paragraph": "p",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu",
    "item": "li dt dd",
    "nav": "nav",
    "header": "header",
    "footer": "footer address",
    "aside": "aside",
    "form": "form fieldset button select option label legend dialog search datalist",
    "table": "table thead tbody tfoot tr td th caption",
    "quote": "blockquote pre figure figcaption details summary",
}
RAW = "script style iframe textarea title"
SKIPPED = frozenset("noscript template svg object canvas audio video annotation annotation-xml".split())
#: Blocks within one of these do not end the paragraph around it.
_PARTED = frozenset("noscript template object".split())
#: Where HTML begins within svg; elsewhere in it these and blocks end it.
_HTML_IN_SVG = frozenset("foreignobject desc".split())
_NOT_SVG = frozenset("b big br code em embed hr i img nobr ruby s small span strike strong sub sup tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_FORM = frozenset("button label select option".split())

GROUP_NAMES = tuple(GROUPS)
BLOCKS = {name: GROUP_NAMES.index(group) for group, names in GROUPS.items() for name in names.split()}
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_HOLDS_P = frozenset("td th li dd button".split())
_HEADING = GROUP_NAMES.index("heading")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>|\Z)))*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRS = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW.split()}
_NEXT = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in _PARTED}


class Node:
    __slots__ = ("attrs", "group", "hidden", "letters", "linked", "name", "parent", "runs")

    def __init__(self, name: str, parent: int, attrs: str):
        self.name, self.parent, self.group = name, parent, BLOCKS[name]
        self.letters = self.linked = 0
        self.runs: list[str] = []
        if "=" in attrs:
            self.attrs = " ".join(m[2] or m[3] or m[4] or "" for m in _ATTRS.finditer(attrs))
            self.hidden = bool(_HIDDEN.search(attrs))
        else:
            self.attrs, self.hidden = "", attrs.strip() == "hidden"


class Open:
    """Names of what is open, and where each last stands; every step takes the same time at any depth."""

    __slots__ = ("names", "places")

    def __init__(self, *names: str):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        for name in names:
            self.push(name)

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def cut(self, size: int) -> None:
        """Closes all from place ``size`` on."""
        while len(self.names) > size:
            self.places[self.names.pop()].pop()

    def last(self, *names: str) -> int:
        """The innermost place of any of the names, -1 without one."""
        return max((held[-1] for n in names if (held := self.places.get(n))), default=-1)


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, runs): nodes with parents before children, and (node, text) runs in page order.

    The time is in proportion to the length of html, however its elements are nested or left open.
    """
    nodes = [Node("html", -1, "")]
    stack = [0]
    names = Open("html")
    paragraph = [-1]  # for each open node, the paragraph that a block beginning in it ends
    runs: list[tuple[int, str]] = []
    pending: list[str] = []
    skip = Open()  # an open element without text of the page, and what is open in it
    parted = False
    links = linked = 0
    at = 0

    def staying(name: str) -> int:
        """How many of the open nodes stay open as a block begins."""
        size = len(stack)
        if name != "head" and names.names[-1] == "head":
            size -= 1
        if name not in INLINE_FORM and paragraph[size - 1] > 0:
            size = paragraph[size - 1]
        if name in _CLOSED_BY:
            ended, bound = _CLOSED_BY[name]
            place = names.last(*ended)
            if place > max(0, names.last(*bound)):
                size = min(size, place)
        return size

    def close(size: int) -> None:
        del stack[size:], paragraph[size:]
        names.cut(size)

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            pending.clear()
            if text:
                node = nodes[stack[-1]]
                node.letters += len(text)
                node.linked += min(linked, len(text))
                node.runs.append(text)
                runs.append((stack[-1], text))
        linked = 0

    while True:
        m = _TAG.search(html, at)
        if m is None:
            if not skip.names:
                pending.append(html[at:])
            break
        if m.start() > at and not skip.names:
            text = html[at : m.start()]
            pending.append(text)
            if links:
                linked += len(text)
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["cdata"] and not skip.names:
                pending.append(m["cdata"].replace("&", "&amp;"))
            continue
        name = name.lower()
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in _ENDS:
            if not closing and not attrs.endswith("/"):
                end = _ENDS[name].search(html, at)
                at = end.end() if end else len(html)
            continue
        if skip.names and skip.names[-1] == "svg" and not closing and (name in BLOCKS or name in _NOT_SVG):
            skip.cut(len(skip.names) - 1)
        if name == "math" and closing and skip.names and skip.names[0].startswith("annotation"):
            skip.cut(0)
        if name in SKIPPED or skip.names and name in _HTML_IN_SVG:
            if closing:
                if (place := skip.last(name)) >= 0:
                    skip.cut(place)
            elif not attrs.endswith("/"):
                if not skip.names:
                    following = _NEXT[name].search(html, at) if name in _PARTED else None
                    parted = bool(following and following[1])
                skip.push(name)
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
            continue
        if name == "br":  # white space within its block
            if not skip.names:
                pending.append("\n")
            continue
        if name == "hr":
            if not skip.names:
                flush()
            continue
        if name not in BLOCKS:
            continue
        if skip.names:
            if closing and (place := skip.last(name)) >= 0:
                skip.cut(place)
                continue
            if closing and (name in ("html", "body") or names.last(name) < 0):
                continue
            if not closing and (parted or skip.last(*_HTML_IN_SVG) >= 0 or name != "body" and staying(name) == len(stack)):
                if not attrs.endswith("/"):
                    skip.push(name)
                continue
            skip.cut(0)  # the block around it ends
        flush()
        links = 0
        if closing:
            if name not in ("html", "body") and (place := names.last(name)) > 0:
                close(place)
            continue
        if name == "html" or name == "body" and names.last("body") >= 0:
            continue
        close(staying(name))
        nodes.append(Node(name, stack[-1], attrs))
        if not attrs.endswith("/"):
            here = len(stack)
            paragraph.append(here if name == "p" else paragraph[-1] if name not in _HOLDS_P and BLOCKS[name] == _HEADING else -1)
            stack.append(len(nodes) - 1)
            names.push(name)
    flush()
    return nodes, runs
