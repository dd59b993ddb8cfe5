"""Blocks of HTML pages, from Python's own parser over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "blockquote": "quote", "li": "list_item", "figcaption": "caption"}
SKIPPED = ("script", "style", "title")
#: Pages whose blocks a task holds at once.
PAGES = 256


class _Blocks(HTMLParser):
    """Collects the text of every block element, in the order in which they begin.

    Text counts for every open block, so nested blocks are emitted twice. A new block tag closes an
    open p; navigation is dropped and counted.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.nav, self.skip, self.n_nav = [], [], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "nav":
            self.nav += 1
            self.n_nav += 1
        elif tag in SKIPPED:
            self.skip += 1
        elif tag in KINDS and not self.nav:
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            self.out.append((tag, parts := []))
            self.open.append((tag, parts))
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "nav":
            self.nav = max(0, self.nav - 1)
        elif tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.nav and not self.skip:
            for _, parts in self.open:
                parts.append(data)


def parse_blocks(html: str | None) -> tuple[list[tuple[str, str]], int, int]:
    """([(tag, text)], dropped navigations, dropped empty blocks)."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    found = [(tag, " ".join("".join(parts).split())) for tag, parts in p.out]
    kept = [x for x in found if x[1]]
    return kept, p.n_nav, len(found) - len(kept)


def dom_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, kind, heading_level, text, n_nav, n_empty) of pages (page_id, html)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # blocks are given out for some pages at a time, so those of a whole batch are never held
            for at in range(0, len(batch), PAGES):
                rows = []
                for page, html in zip(batch["page_id"].iloc[at:at + PAGES], batch["html"].iloc[at:at + PAGES]):
                    kept, n_nav, n_empty = parse_blocks(html)
                    rows += [(page, i, tag, KINDS[tag], int(tag[1]) if tag[0] == "h" else None, text, n_nav, n_empty) for i, (tag, text) in enumerate(kept)]
                yield pd.DataFrame(rows, columns=["page_id", "pos", "tag", "kind", "heading_level", "text", "n_nav", "n_empty"]).astype({"heading_level": "Int32"})

    return pages.select("page_id", "html").mapInPandas(
        emit, "page_id long, pos int, tag string, kind string, heading_level int, text string, n_nav int, n_empty int")
