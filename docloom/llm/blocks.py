"""HTML as a sequence of leaf blocks: text between block-level tags, with the path of tags above it.

Scripts, styles, templates, the head and comments have no blocks and part none:
text before and after one of them in a paragraph is one block. Character
references are decoded, tags that are no block's vanish, a line break is white space, and
white space becomes one space. Paragraphs, list items and table cells that are
not closed end where HTML says they do. Formulas and drawings are inline: their
text is text of the block around them.

Time is linear in the page, whatever it holds: a place where quotes never close
is looked at once, and open elements are found by name, not by a walk. Below
``DEEPEST`` levels tags add nothing to a path, so its buckets stay few; text at
any depth is kept.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

PATH_BUCKETS = 512
#: Levels of tags that a path tells apart.
DEEPEST = 64

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("""[>"']""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose text is no text of the page: a browser that runs scripts shows none of it, or it is part of a form.
_SILENT = frozenset("script style template noscript iframe head title desc metadata annotation annotation-xml select textarea".split())
#: Of these, what lies inside is not markup: they end at their own end tag only.
_RAW = frozenset("script style iframe title textarea".split())
#: What a head can hold; anything else ends it.
_HEAD = frozenset("title meta link base style script noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block; all others, known or not, stand in the line of the text around them.
_BLOCK = frozenset(
    "html body address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav object ol optgroup option"
    " p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: What lies in these is inline, and a tag there can close itself.
_FOREIGN = ("math", "svg")
#: Elements that an opening tag ends, and those beyond which it ends none.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select", "datalist")),
}
_P_SCOPE = tuple("table td th caption button object template html".split())


@dataclass(slots=True)
class Block:
    text: str
    path: int
    link_chars: int


class Paths:
    """Numbers of tag paths, and the buckets that their tags, classes and ids hash to."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.buckets: list[frozenset[int]] = [frozenset()]
        self.depth: list[int] = [0]

    def below(self, path: int, tag: str, attributes: str) -> int:
        if self.depth[path] >= DEEPEST:
            return path
        words = sorted({w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _PART.findall(m[2] or m[3] or m[4] or "")}) if "=" in attributes else ()
        key = (path, f"{tag} {' '.join(words)}")
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.buckets)
            own = [f"tag {tag}", *(f"name {w}" for w in words)]
            self.buckets.append(self.buckets[path] | {zlib.crc32(x.encode("utf-8", "surrogatepass")) % PATH_BUCKETS for x in own})
            self.depth.append(self.depth[path] + 1)
        return found


class _Tags:
    """Where tags of a page end."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.failed: set[int] = set()  # quotes from which on no end is found
        self.unclosed: dict[str, int] = {}  # by quote, the place from which on there is no other

    def end(self, at: int) -> int:
        """The first ``>`` outside quotes; where quotes never close, the first one at all; -1 without any."""
        page, passed, j = self.page, [], at
        while m := _SPECIAL.search(page, j):
            quote, p = m[0], m.start()
            if quote == ">":
                return p
            if p in self.failed or p >= self.unclosed.get(quote, len(page)):
                break
            passed.append(p)
            close = page.find(quote, p + 1)
            if close < 0:
                self.unclosed[quote] = p
                break
            j = close + 1
        self.failed.update(passed)
        return page.find(">", at) if at <= self.last else -1


def blocks(page: str | None, paths: Paths) -> list[Block]:
    """Leaf blocks of a page in their order."""
    page = page or ""
    tags = _Tags(page)
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]
    places: dict[str, list[int]] = {}  # of open elements, by name
    pieces: list[str] = []
    links = 0
    at_path = -1
    silent = 0  # depth of the stack from which on all is silent

    def flush() -> None:
        nonlocal links, at_path
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, at_path, links))
            pieces.clear()
        links, at_path = 0, -1

    def shrink(n: int) -> None:
        nonlocal silent
        for tag, _ in stack[n:]:
            places[tag].pop()
        del stack[n:]
        if silent >= n:
            silent = 0

    def nearest(names: tuple[str, ...]) -> int:
        """The innermost open element of these; 0 if there is none."""
        return max((at[-1] for name in names if (at := places.get(name))), default=0)

    def text_of(a: int, b: int) -> None:
        nonlocal links, at_path
        if a >= b or silent:
            return
        piece = page[a:b]
        if "&" in piece:
            piece = html.unescape(piece)
        pieces.append(piece)
        if at_path < 0 and not piece.isspace():
            at_path = stack[-1][1]
        if places.get("a"):
            links += len(piece)

    done = look = 0  # what lies before is dealt with; where to look for the next tag
    while (lt := page.find("<", look)) >= 0:
        if page.startswith("<!--", lt):
            text_of(done, lt)
            close = page.find("-->", lt + 2)
            done = look = close + 3 if close >= 0 else len(page)
            continue
        if lt > tags.last:
            # No tag ends any more; only a comment can still begin.
            comment = page.find("<!--", lt)
            if comment < 0:
                break
            look = comment
            continue
        named = _NAME.match(page, lt + 1)
        if not named:
            if page[lt + 1] not in "!?/":
                look = lt + 1
                continue
            text_of(done, lt)
            done = look = page.find(">", lt) + 1
            continue
        end = tags.end(named.end())
        text_of(done, lt)
        done = look = end + 1
        tag = named[2].lower()
        foreign = any(places.get(x) for x in _FOREIGN)
        inline = foreign or tag not in _BLOCK
        if named[1]:  # an end tag
            if tag == "br":
                pieces.append(" ")
                continue
            opened = places[tag][-1] if places.get(tag) else 0
            # An end tag of what a formula or drawing, or a silent element, stands in ends that too.
            if tag in _BLOCK and (not foreign or 0 < opened < nearest(_FOREIGN)) and (not silent or 0 < opened < silent):
                flush()
            if opened:
                shrink(opened)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if silent and stack[silent][0] == "head" and tag not in _HEAD:
            shrink(silent)
        if tag in _VOID or foreign and page[end - 1] == "/":
            if not inline and not silent:
                flush()
            continue
        if not inline and not silent:
            flush()
            if places.get("p") and places["p"][-1] > nearest(_P_SCOPE):
                shrink(places["p"][-1])
            if tag in _ENDS:
                ended, kept = map(nearest, _ENDS[tag])
                if ended > kept:
                    shrink(ended)
        if tag in _RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, done)
            after = page.find(">", close.start()) if close else -1
            done = look = after + 1 if after >= 0 else len(page)
            continue
        stack.append((tag, paths.below(stack[-1][1], tag, page[named.end() : end]) if not silent else stack[-1][1]))
        n = len(stack) - 1
        places.setdefault(tag, []).append(n)
        if tag in _SILENT and not silent:
            silent = n
    text_of(done, len(page))
    flush()
    return out
