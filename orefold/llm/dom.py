"""A page as a tree of block elements and text runs, and the features of its nodes."""

from __future__ import annotations

import html
import re

import numpy as np

#: Element names by the part they play.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HIDDEN = frozenset(
    "script style title noscript template iframe svg math object canvas audio video "
    "textarea select datalist noembed noframes xmp dialog".split()
)
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_GROUPS = {
    "main": "article main",
    "box": "section div center body html hgroup fieldset details summary address",
    "paragraph": "p",
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol dl menu dir",
    "item": "li dt dd",
    "table": "table caption thead tbody tfoot tr td th",
    "nav": "nav",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form button label option input legend",
    "figure": "figure figcaption",
    "quote": "blockquote pre",
}
GROUP_NAMES = ("text", *_GROUPS)
_GROUP_OF = {
    tag: i + 1 for i, tags in enumerate(_GROUPS.values()) for tag in tags.split()
}
_BREAKING = frozenset(_GROUP_OF)
_HOLDER_NAMES = "main box nav header footer aside form".split()
_HOLDERS = frozenset(GROUP_NAMES.index(name) for name in _HOLDER_NAMES)
#: An opening tag closes open elements of these names, one of each set in turn, not
#: beyond the second set.
_CELL, _ROWS = ("td", "th"), ("thead", "tbody", "tfoot")
_CLOSES = {
    "li": (("li",),),
    "dt": (("dt", "dd"),),
    "dd": (("dt", "dd"),),
    "tr": (_CELL, ("tr",)),
    "td": (_CELL,),
    "th": (_CELL,),
    "option": (("option",),),
    **dict.fromkeys(_ROWS, (_CELL, ("tr",), _ROWS)),
}
_SCOPES = frozenset("ul ol dl table td th html body div article section".split())
_NOT_IN_P = _BREAKING - frozenset("button label option input legend".split())

TOKEN_GROUPS = {
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner "
    "adsense dfp outbrain taboola",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pager "
    "pagination skip toc tabs masthead header footer foot bottom copyright legal",
    "side": "sidebar side aside widget widgets related recommended recommendations more "
    "popular trending recent archive tags tagcloud secondary rail",
    "comment": "comment comments commentlist reply replies respond discussion disqus "
    "thread reviews",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay "
    "banner privacy paywall message toast",
    "share": "share sharing social follow byline meta author date print email rating",
    "form": "form login signin signup register search newsletter subscribe subscription "
    "contact poll survey",
    "content": "article content main post entry story body text prose document page "
    "articlebody maincontent",
}
"""Words in class, id and role that speak for or against main text; fixed values."""
_TOKEN_BIT = {}
for _i, _words in enumerate(TOKEN_GROUPS.values()):
    for _word in _words.split():
        _TOKEN_BIT[_word] = _TOKEN_BIT.get(_word, 0) | 1 << _i
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*+))>"
    r"|<!--(?:.*?-->|.*\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I
)
_MAY_HIDE = re.compile(r"hidden|\bstyle\b", re.I)
_NAMED = re.compile(
    r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?"
)
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+")
_SENTENCE = re.compile(r"[.!?;:,](?=\s|$)")


_MOST_KNOWN = 1 << 14


def _attributes(source: str) -> tuple[int, bool]:
    """Token groups named in the attributes, as bits, and whether the element is hidden."""
    bits = 0
    for found in _ATTRIBUTE.finditer(source):
        for word in _WORDS.findall(found.group(found.lastindex or 0)):
            bits |= _TOKEN_BIT.get(word.lower(), 0)
    return bits, bool(_MAY_HIDE.search(source)) and _hides(source)


def _hides(source: str) -> bool:
    """Whether attributes hide their element: ``hidden``, ``aria-hidden`` that is true, or
    a style whose effective ``display`` is none or ``visibility`` is hidden. Of attributes
    of one name the first counts."""
    named: dict[str, str] = {}
    for found in _NAMED.finditer(source):
        name, value = found.group(1).lower(), found.group(found.lastindex or 1)
        named.setdefault(name, value if found.lastindex > 1 else "")
    if "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true":
        return True
    styles: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub("", html.unescape(named.get("style", ""))).lower().split(";"):
        name, _, value = part.partition(":")
        value, _, important = value.partition("!")
        one = (important.strip() == "important", value.strip())
        if one[1] and one[0] >= styles.get(name.strip(), one)[0]:
            styles[name.strip()] = one
    hidden = {"display": ("none",), "visibility": ("hidden", "collapse")}
    return any(styles.get(name, (False, ""))[1] in values for name, values in hidden.items())


class Page:
    """Nodes in document order: block elements, and runs of text between their edges.

    Parsing never fails: unclosed and stray tags are repaired as far as blocks need it,
    what looks like markup but is none is text, and scripts, styles, hidden elements and
    comments leave nothing. A hidden element ends where it would end if it were visible.
    """

    def __init__(
        self, source: str, known: dict[str, tuple[int, bool]] | None = None
    ) -> None:
        """``known`` holds what attributes were found to say; pages of a task can share it."""
        self._known = {} if known is None else known
        self.parent: list[int] = []
        self.group: list[int] = []
        self.bits: list[int] = []
        self.above: list[int] = []
        self.groups_above: list[int] = []
        self.holder: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.place: list[int] = []
        self.previous: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.marked: list[str] = []
        self._open: list[tuple[str, int]] = []
        self._children: list[int] = []
        self._last: list[int] = []
        self._run: list[str] = []
        self._run_linked = 0
        self._link = -1
        self._muted = -1  # where in _open the hidden element is; what it holds has no node
        self._parse(source)
        self._flush()
        while self._open:
            self._pop()

    def _node(self, group: int, bits: int, text: str, linked: int) -> int:
        at = len(self.parent)
        up = self._open[-1][1] if self._open else -1
        self.parent.append(up)
        self.group.append(group)
        self.bits.append(bits)
        self.above.append(self.above[up] | self.bits[up] if up >= 0 else 0)
        self.groups_above.append(
            self.groups_above[up] | 1 << self.group[up] if up >= 0 else 0
        )
        self.holder.append(
            -1 if up < 0 else up if self.group[up] in _HOLDERS else self.holder[up]
        )
        self.depth.append(len(self._open))
        self.end.append(at + 1)
        self.place.append(self._children[up] if up >= 0 else 0)
        self.previous.append(self._last[up] if up >= 0 else -1)
        self.text.append(text)
        self.linked.append(linked)
        self._children.append(0)
        self._last.append(-1)
        if up >= 0:
            self._children[up] += 1
            self._last[up] = at
        return at

    def _said(self, attributes: str) -> tuple[int, bool]:
        found = self._known.get(attributes)
        if found is None:
            if len(self._known) >= _MOST_KNOWN:
                self._known.clear()
            found = self._known[attributes] = _attributes(attributes)
        return found

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self._node(0, 0, text, min(self._run_linked, len(text)))
            self._run, self._run_linked = [], 0

    def _pop(self) -> None:
        if self._muted >= 0:
            self._open.pop()
            if len(self._open) == self._muted:
                self._muted = -1
            return
        self._flush()
        _, at = self._open.pop()
        self.end[at] = len(self.parent)
        if self._link >= len(self._open):
            self._link = -1

    def _close(self, names: tuple[str, ...], scopes: frozenset[str]) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            name = self._open[i][0]
            if name in names:
                while len(self._open) > i:
                    self._pop()
                return
            if name in scopes:
                return

    def _parse(self, source: str) -> None:
        at, size = 0, len(source)
        skipped, skip_depth = "", 0
        match = _TAG.search
        while at < size:
            found = match(source, at)
            stop = found.start() if found else size
            if stop > at and not skipped and self._muted < 0:
                piece = source[at:stop]
                if "&" in piece:
                    piece = html.unescape(piece)
                self._run.append(piece)
                if self._link >= 0:
                    self._run_linked += len(piece.strip())
            if not found:
                return
            at = found.end()
            closing, name, rest = found.group(1, 2, 3)
            if name is None:
                closing, name, rest = found.group(4, 5, 6)
                if name is None:
                    continue
            name = name.lower()
            if skipped:
                if name == skipped:
                    skip_depth += -1 if closing else 1
                    if not skip_depth:
                        skipped = ""
                continue
            if closing:
                self._end(name)
                continue
            bits, hidden = self._said(rest) if rest else (0, False)
            hidden = hidden and name not in _VOID and name != "head"
            if name in _BREAKING and (hidden or self._muted >= 0):
                self._imply(name)
            if name in _RAW:
                ends = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = ends.start() if ends else size
                skipped, skip_depth = name, 1
            elif name in _HIDDEN or hidden or self._muted >= 0:
                if rest.endswith("/") or name in _VOID:
                    continue
                if self._muted < 0:
                    self._run.append(" ")
                if name in _HIDDEN:
                    skipped, skip_depth = name, 1
                else:
                    if self._muted < 0:
                        self._muted = len(self._open)
                    self._open.append((name, -1))
            else:
                self._start(name, bits, rest)

    def _imply(self, name: str) -> None:
        """Close what an opening tag closes."""
        if name in _NOT_IN_P:
            self._close(("p",), _SCOPES - {"div", "article", "section"})
        for names in _CLOSES.get(name, ()):
            self._close(names, frozenset("ul ol dl table".split()))

    def _start(self, name: str, bits: int, rest: str) -> None:
        if name == "a":
            self._link = len(self._open)
        if name == "br" or name in ("img", "wbr"):
            self._run.append(" " if name == "br" else "")
        if name not in _BREAKING:
            if name in ("hr",):
                self._flush()
            return
        self._flush()
        self._imply(name)
        if name in ("html", "body") and any(name == tag for tag, _ in self._open):
            return
        node = self._node(_GROUP_OF[name], bits, "", 0)
        if name not in _VOID:
            self._open.append((name, node))
        if "data-main=" in rest:
            self.marked.append((node, "data-main=1" in rest))

    def _end(self, name: str) -> None:
        if self._muted >= 0 and name not in _BREAKING:
            for i in range(len(self._open) - 1, self._muted - 1, -1):
                if self._open[i][0] == name:
                    while len(self._open) > i:
                        self._pop()
                    return
                if self._open[i][0] in _BREAKING:
                    break
        if name == "a":
            self._link = -1
        elif name in _BREAKING and name not in ("html", "body"):
            self._close((name,), frozenset(("td", "th")) - {name} if name in ("p", "li") else frozenset())


FEATURES = (
    [f"is_{name}" for name in GROUP_NAMES]
    + [f"parent_{name}" for name in ("box", "paragraph", "heading", "item", "table", "main")]
    + [f"held_by_{name}" for name in _HOLDER_NAMES]
    + [f"held_by_token_{name}" for name in TOKEN_GROUPS]
    + [f"own_{name}" for name in TOKEN_GROUPS]
    + [f"above_{name}" for name in TOKEN_GROUPS]
    + [f"in_{name}" for name in ("main", "nav", "header", "footer", "aside", "form", "list")]
    + "chars words link_density sentence_density node_density page_share "
    "paragraph_share depth begins ends place siblings before after holder_links "
    "holder_share main_elsewhere".split()
)


def features(page: Page) -> np.ndarray:
    """One row for each node; subtree sums are differences of running totals."""
    n = len(page.parent)
    if not n:
        return np.zeros((0, len(FEATURES)))
    parent = np.array(page.parent)
    group, bits = np.array(page.group), np.array(page.bits)
    above, groups_above = np.array(page.above), np.array(page.groups_above)
    end, start = np.array(page.end), np.arange(n)
    own = np.array([len(text) for text in page.text], float)
    up = np.maximum(parent, 0)
    up_group = np.where(parent >= 0, group[up], -1)
    columns = [group == i for i in range(len(GROUP_NAMES))]
    for name in ("box", "paragraph", "heading", "item", "table", "main"):
        columns.append(up_group == GROUP_NAMES.index(name))
    holder = np.array(page.holder)
    held = np.maximum(holder, 0)
    for name in _HOLDER_NAMES:
        columns.append((holder >= 0) & (group[held] == GROUP_NAMES.index(name)))
    for i in range(len(TOKEN_GROUPS)):
        columns.append((holder >= 0) & (bits[held] >> i & 1 == 1))
    for i in range(len(TOKEN_GROUPS)):
        columns.append(bits >> i & 1)
    for i in range(len(TOKEN_GROUPS)):
        columns.append(above >> i & 1)
    for name in ("main", "nav", "header", "footer", "aside", "form", "list"):
        columns.append(groups_above >> GROUP_NAMES.index(name) & 1)

    def subtree(values: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0.0], np.cumsum(values)])
        return running[end] - running[start]

    chars = subtree(own)
    words = subtree(np.array([text.count(" ") + 1 if text else 0 for text in page.text], float))
    linked = subtree(np.array(page.linked, float))
    sentences = subtree(np.array([len(_SENTENCE.findall(t)) if t else 0 for t in page.text], float))
    in_paragraph = subtree(own * (up_group == GROUP_NAMES.index("paragraph")))
    running = np.concatenate([[0.0], np.cumsum(own)])
    whole = max(1.0, running[-1])
    previous = np.array(page.previous)
    following = np.full(n, -1)
    known = previous >= 0
    following[previous[known]] = start[known]
    place = np.array(page.place)
    siblings = np.bincount(up, minlength=n)[up]
    has_main = bool((group == GROUP_NAMES.index("main")).any())
    density = linked / np.maximum(chars, 1)
    columns += [
        np.log1p(chars),
        np.log1p(words),
        density,
        sentences / np.maximum(words, 1),
        np.log1p(chars / (end - start)),
        chars / whole,
        in_paragraph / np.maximum(chars, 1),
        np.array(page.depth),
        running[start] / whole,
        running[end] / whole,
        place / np.maximum(siblings, 1),
        np.log1p(siblings),
        np.log1p(np.where(known, chars[previous], 0)),
        np.log1p(np.where(following >= 0, chars[following], 0)),
        np.where(holder >= 0, density[held], 0),
        np.where(holder >= 0, chars[held] / whole, 1),
        np.full(n, has_main) & ((groups_above >> 1 & 1) == 0) & (group != 1),
    ]
    return np.stack([np.asarray(column, float) for column in columns], 1)


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """Which nodes are main text, as the best assignment without contradictions: what a
    dropped node holds is dropped, and what a kept node is held by is kept.

    Each node votes with its log odds, text runs more the longer they are; a run that is
    all its element holds votes with the mean of both. The best value of a subtree is found from the leaves up, then choices are made from the root down.
    """
    n = len(page.parent)
    if not n:
        return np.zeros(0, bool)
    lengths = np.array([len(text) for text in page.text], float)
    sole = np.array(
        [up >= 0 and page.end[up] - up == 2 for up in page.parent], bool
    ) & (lengths > 0)
    up = np.maximum(np.array(page.parent), 0)
    logits = np.where(sole, (logits + logits[up]) / 2, logits)
    vote = np.clip(logits, -5, 5) * np.where(lengths > 0, np.log2(2 + lengths), 1.0)
    keep = vote.tolist()
    drop = (-vote).tolist()
    for at in range(n - 1, -1, -1):
        up = page.parent[at]
        if up >= 0:
            keep[up] += max(keep[at], drop[at])
            drop[up] += drop[at]
    kept = np.zeros(n, bool)
    for at in range(n):
        up = page.parent[at]
        kept[at] = keep[at] > drop[at] and (up < 0 or kept[up])
    return kept
