"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.llm.boosting import Trees, fit_trees
from orefold.llm.common import text_array, text_slices
from orefold.llm.dom import Page, decode, features

_BATCH = 64


@dataclass(frozen=True)
class Training:
    """The trees are fitted on ``pages`` made-up pages of known structure; nothing of the
    data is learnt, so the model is the same for every table."""

    pages: int = 1000
    rounds: int = 60
    depth: int = 4
    seed: int = 11


class _Writer:
    """Writes a made-up page whose blocks say whether they are main text."""

    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)
        self.semantic = self.random.random() < 0.6
        self.classes = self.random.random() < 0.8
        self.longest = self.random.randint(2, 8)

    def words(self, low: int, high: int) -> str:
        r = self.random
        made = []
        for _ in range(r.randint(low, high)):
            made.append("".join(r.choice("bdfgklmnprstv") + r.choice("aeiou")
                                for _ in range(r.randint(1, self.longest))))
            if r.random() < 0.1:
                made[-1] += r.choice(".,;")
        return " ".join(made)

    def sentences(self, low: int, high: int) -> str:
        r = self.random
        return " ".join(
            self.words(3, 18).capitalize() + r.choice(".....!?")
            for _ in range(r.randint(low, high))
        )

    def element(
        self, tag: str, inside: str, names: str = "", mark: int | None = None,
        always: bool = False,
    ) -> str:
        r = self.random
        given = ""
        if names and (always or self.classes and r.random() < 0.85):
            name = r.choice(names.split())
            key = r.choice(["class", "class", "id"])
            extra = r.choice(["", "", " box", "-wrapper", "-inner", "_1"])
            given = f' {key}="{name}{extra}"'
        marked = "" if mark is None else f" data-main={mark}"
        return f"<{tag}{given}{marked}>{inside}</{tag}>"

    def box(self, semantic: str, names: str, inside: str, mark: int = 0) -> str:
        return self.element(semantic if self.semantic else "div", inside, names, mark)

    def links(self, low: int, high: int) -> str:
        r = self.random
        count = r.randint(low, high)
        if r.random() < 0.7:
            inside = "".join(f'<li><a href="#">{self.words(1, 3)}</a></li>' for _ in range(count))
            return f"<ul>{inside}</ul>"
        return " ".join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(count))

    def ad(self) -> str:
        r = self.random
        inside = r.choice([self.sentences(1, 2), self.words(2, 8), f'<a href="#">{self.words(2, 9)}</a>'])
        if r.random() < 0.3:
            inside = f"<p>{inside}</p>"
        return self.element(r.choice(["div", "div", "aside"]), inside,
                            "ad ads advert sponsored promo banner advertisement", 0,
                            always=r.random() < 0.8)

    def paragraph(self) -> str:
        r = self.random
        kind = r.random()
        if kind < 0.7:
            text = self.sentences(1, 7)
        elif kind < 0.85:
            text = self.words(1, 6).capitalize() + r.choice([".", ""])
        else:
            text = r.choice([" | ", " ", "### ", "!! "]).join(self.words(1, 1) for _ in range(r.randint(4, 60)))
        if r.random() < 0.2:
            text += f' <a href="#">{self.words(1, 4)}</a> {self.sentences(1, 2)}'
        kind = r.random()
        if kind < 0.12:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f"<p>{text}"
        return f"<p>{text}</p>"

    def article(self) -> str:
        r = self.random
        parts = []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.words(2, 9)}</h1>")
        if r.random() < 0.2:
            parts.append(self.element("div", f"{self.words(2, 5)} <a href='#'>{self.words(1, 2)}</a>",
                                      "byline meta author date share social", 0))
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 20, 40])):
            kind = r.random()
            if kind < 0.8:
                parts.append(self.paragraph())
            elif kind < 0.87:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.91:
                items = "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(r.randint(2, 6)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.95:
                cells = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>"
                                for _ in range(r.randint(2, 5)))
                parts.append(f"<table>{cells}</table>")
            elif kind < 0.97:
                parts.append(f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>")
            else:
                parts.append(self.ad())
        if len(parts) < 2:
            parts.append(self.paragraph() if r.random() < 0.7 else f"<p>{self.words(1, 5)}.</p>")
        inside = "".join(parts)
        if r.random() < 0.3:
            inside = self.element("div", inside, "content body text entry prose")
        if r.random() < 0.25:
            inside += self.box("footer", "share social tags meta", self.links(2, 5))
        return self.box("article" if r.random() < 0.8 else "section",
                        "article post content entry story main", inside, 1)

    def comments(self) -> str:
        r = self.random
        one = lambda: self.element(
            r.choice(["li", "div", "article"]),
            f"<{(t := r.choice(['p', 'div', 'span']))}>{self.sentences(1, 5)}</{t}>"
            + r.choice(["", f"<a href='#'>{self.words(1, 1)}</a>", f"<span>{self.words(1, 3)}</span>"]),
            "comment reply review",
            always=True,
        )
        inside = "".join(one() for _ in range(r.randint(1, 8)))
        head = r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 3)}</h2>"])
        if r.random() < 0.4:
            inside += f"<form><label>{self.words(1, 2)}</label><button>{self.words(1, 2)}</button></form>"
        return self.element(
            r.choice(["div", "section", "ol"]),
            head + inside,
            "comments commentlist discussion replies respond disqus",
            0,
            always=True,
        )

    def page(self) -> str:
        r = self.random
        maybe = lambda share, part: part() if r.random() < share else ""
        logo = lambda: r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<a href='#'>{self.words(1, 2)}</a>", f"<p>{self.words(2, 7)}</p>", ""])
        nav = lambda: self.box("nav", "nav menu navbar navigation breadcrumbs", self.links(2, 12))
        header = lambda: self.box("header", "header masthead topbar", logo() + maybe(0.5, nav))
        notice = lambda: self.element("div", f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>",
                                      "cookie consent notice alert gdpr popup", 0)
        side = lambda: self.box("aside", "sidebar side widget related popular", "".join(
            r.choice([f"<h3>{self.words(1, 4)}</h3>{self.links(2, 8)}", f"<p>{self.sentences(1, 3)}</p>", self.ad()])
            for _ in range(r.randint(1, 4))))
        form = lambda: self.element("form", f"<p>{self.words(3, 12)}</p><label>{self.words(1, 3)}</label><button>{self.words(1, 2)}</button>",
                                    "newsletter subscribe login search signup", 0)
        related = lambda: self.box("section", "related more recommended popular", f"<h3>{self.words(1, 3)}</h3>" + self.links(2, 8))
        footer = lambda: self.box("footer", "footer bottom copyright legal", r.choice([
            f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>{self.words(4, 20)}</p>",
            self.links(2, 10), f"<p>{self.sentences(1, 3)}</p>{self.links(2, 6)}"]))
        article = self.article()
        inner = maybe(0.2, side) + maybe(0.25, self.ad) + article + maybe(0.25, self.comments)
        inner += maybe(0.25, related) + maybe(0.2, form) + maybe(0.2, side)
        if r.random() < 0.5:
            inner = self.element("main" if self.semantic and r.random() < 0.6 else "div", inner,
                                 "main content page container wrapper")
        body = maybe(0.3, notice) + maybe(0.5, header) + maybe(0.6, nav) + maybe(0.35, self.ad)
        body += maybe(0.1, form) + inner + maybe(0.2, side) + maybe(0.15, self.comments)
        body += maybe(0.15, notice) + maybe(0.85, footer)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}" + r.choice(
            ["</body></html>", ""]
        )


def _labels(page: Page) -> np.ndarray:
    """Which nodes hold main text: runs whose nearest marked element says so, and all
    elements around them."""
    marks = dict(page.marked)
    main = np.zeros(len(page.parent), bool)
    within = [False] * len(page.parent)
    for at, up in enumerate(page.parent):
        within[at] = marks.get(at, within[up] if up >= 0 else False)
        main[at] = within[at] and bool(page.text[at])
    for at in range(len(page.parent) - 1, 0, -1):
        if main[at] and page.parent[at] >= 0:
            main[page.parent[at]] = True
    return main


@lru_cache(2)
def train(training: Training = Training()) -> Trees:
    """Fit the trees on the driver; the made-up pages bound the work."""
    pages = [Page(_Writer(training.seed * 100_003 + i).page()) for i in range(training.pages)]
    rows = np.concatenate([features(page) for page in pages])
    labels = np.concatenate([_labels(page) for page in pages]).astype(float)
    return fit_trees(rows, labels, training.rounds, training.depth)


def main_blocks(trees: Trees, sources: list[str]) -> list[tuple[list[str], int]]:
    """For each page the main blocks in page order, and the number of all blocks."""
    found = []
    known: dict[str, tuple[int, bool]] = {}
    for at in range(0, len(sources), _BATCH):
        pages = [Page(source, known) for source in sources[at : at + _BATCH]]
        rows = [features(page) for page in pages]
        logits = trees.logits(np.concatenate(rows))
        bounds = np.cumsum([0] + [len(row) for row in rows])
        for page, low, high in zip(pages, bounds[:-1], bounds[1:]):
            kept = decode(page, logits[low:high])
            blocks = [text for text, keep in zip(page.text, kept) if keep and text]
            found.append((blocks, sum(map(bool, page.text))))
    return found


def extract(
    pages: DataFrame,
    training: Training = Training(),
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Rows ``page_id, url, text, n_chars, n_blocks, n_dropped``.

    The text is the page's main blocks in page order, joined by two line breaks. Character
    references are decoded, white space within a block becomes one space. Trees rate every
    element and text run by its name, attribute words, subtree density, links, depth,
    place and siblings; the page's rating without contradictions between an element and
    what it holds decides.

    Null and empty pages, and pages without any text, have the empty text. Broken markup
    is read as far as it goes. Null ids and urls stay null; repeated rows each give a row;
    an empty table gives an empty result. Whole pages are read, however long.
    """
    trees = train(training)

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__html"):
            found = main_blocks(trees, text_array(batch, "__html").to_pylist())
            texts = ["\n\n".join(blocks) for blocks, _ in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column(0),
                    "url": batch.column(1),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(text) for text in texts], pa.int64()),
                    "n_blocks": pa.array([len(blocks) for blocks, _ in found], pa.int64()),
                    "n_dropped": pa.array([n - len(blocks) for blocks, n in found], pa.int64()),
                }
            )

    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{html}`").alias("__html"),
    )
    return rows.mapInArrow(
        extracted,
        "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, "
        "n_dropped bigint",
    )
