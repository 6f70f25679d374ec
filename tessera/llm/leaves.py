"""HTML as a sequence of leaf blocks: texts with the tags, classes and ids around them.

A forgiving reader: end tags may be missing, attributes unquoted, comments and
scripts unclosed. Block-level tags end a block; inline tags do not; a line
break is white space. Nothing outside of text is kept: scripts, styles,
comments, the document's head and embedded objects give no blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: HTML's block-level tags, those whose content is no page text, and those that an own start tag ends.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template iframe noembed noframes title textarea svg math object audio video canvas head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "optgroup": ("select",)}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.IGNORECASE)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ends: dict[str, re.Pattern] = {}


@dataclass(slots=True)
class Leaf:
    text: str
    #: The names around it: distinct tags, and pieces of classes, ids and roles, outermost first.
    path: tuple[str, ...]
    #: Those of the innermost block and of the one around it.
    near: tuple[str, ...]
    #: How much of the text is in links, in characters.
    linked: int


def names(attributes: str) -> list[str]:
    """Lower-case pieces of the classes, ids and roles."""
    found = [p.lower() for m in NAMED.finditer(attributes) for p in PIECE.findall(m[1] or m[2] or m[3] or "")]
    return [*found, "!hidden"] if UNSEEN.search(attributes) else found


def _after_end(name: str, page: str, at: int) -> int:
    """Where the content of a hidden element ends; an unclosed head ends with its body, any other one with the page."""
    if name not in _ends:
        _ends[name] = re.compile(rf"</{name}\b[^>]*>" + ("|(?=<body\\b)" if name == "head" else ""), re.IGNORECASE)
    end = _ends[name].search(page, at)
    if end is None and name == "head":
        return at
    return end.end() if end else len(page)


class _Reader:
    def __init__(self):
        self.leaves: list[Leaf] = []
        #: Tag, own names, and all names so far of each open block.
        self.stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [("", (), ())]
        #: How many blocks of each tag are open, so that a tag that is not is not looked for.
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.link, self.linked = 0, 0

    def text(self, raw: str) -> None:
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(piece)
            if self.link:
                self.linked += len(piece.strip())

    def cut(self) -> None:
        """End the block: its text stands under the names that are open now."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                outer = tuple(f"around {n}" for n in self.stack[-2][1]) if len(self.stack) > 1 else ()
                self.leaves.append(Leaf(text, self.stack[-1][2], (*outer, *self.stack[-1][1]), min(self.linked, len(text))))
            self.pieces = []
        self.linked = 0

    def close(self, name: str, scope: tuple[str, ...] = ()) -> None:
        if not self.open[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                self.open.subtract(tag for tag, *_ in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i][0] in scope:
                return

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append(" ")
        elif name == "a":
            self.link = 1
        elif name in BLOCKS:
            self.cut()
            if name not in ("button", "label"):
                self.close("p", ("td", "th", "button"))
            for other in ENDS.get(name, ()):
                self.close(other, SCOPES[name])
            if name not in VOID:
                path, own = self.stack[-1][2], (name, *names(attributes))
                fresh = [n for n in dict.fromkeys(own) if n not in path]
                self.stack.append((name, own, (*path, *fresh) if fresh else path))
                self.open[name] += 1

    def end(self, name: str) -> None:
        if name == "a":
            self.link = 0
        elif name in BLOCKS:
            self.cut()
            self.link = 0
            self.close(name)


def leaves(page: str | None) -> list[Leaf]:
    """The page's blocks of text in order, white space inside them turned into single spaces."""
    reader, at, page = _Reader(), 0, page or ""
    while (tag := TAG.search(page, at)) is not None:
        reader.text(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        attributes = (tag[3] or tag[6] or "").strip()
        if tag[1] or tag[4]:
            reader.end(name)
        elif name in HIDDEN:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                at = _after_end(name, page, at)
        else:
            reader.start(name, attributes)
    reader.text(page[at:])
    reader.cut()
    return reader.leaves
