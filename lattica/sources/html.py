"""Visible text of whole pages, by the standard library's tokenizer in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lattica.session import ship

#: Elements whose text is not part of a page's content.
FURNITURE = ("nav", "header", "footer", "noscript", "template")
CODE = ("script", "style")


class _Reader(HTMLParser):
    """Pieces of text; closing an element of ``FURNITURE`` takes back what was read since it opened."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.held = dict.fromkeys(FURNITURE, 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.pieces.append(" ")
        if tag in self.held:
            self.open.append((tag, len(self.pieces)))
            self.held[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.held.get(tag):
            name = None
            while name != tag:
                name, since = self.open.pop()
                self.held[name] -= 1
            del self.pieces[since:]
        self.pieces.append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in self.held or tag in CODE:  # HTML knows no empty form of these: the slash is ignored
            self.handle_starttag(tag, attrs)
        else:
            self.pieces.append(" ")

    def handle_comment(self, data: str) -> None:
        self.pieces.append(" ")

    def handle_data(self, data: str) -> None:
        if self.cdata_elem not in CODE:
            self.pieces.append(data)


def read(page: str) -> str:
    """Text of a page with single spaces; elements may nest, and one that is never closed keeps its text."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return " ".join("".join(reader.pieces).split())


def page_text(c: Column) -> Column:
    """``read`` of each page; null stays null."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)

    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else read(p))

    return F.pandas_udf(texts, "string")(c)
