"""Text of HTML pages, one Arrow batch at a time."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings in the order in which they are tried; the last accepts anything.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin-1")


class _Text(HTMLParser):
    """Pieces of text by line; script and style are left out, each table row is a line of its cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip, self.cells, self.cell = 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "tr":
            self._row()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self._cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th"):
            self._cell()
        elif tag in ("tr", "table"):
            self._row()

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        if self.cell is not None:
            self.cell.append(data.strip())
        elif self.cells is None:
            self.parts.append(data.strip())

    def _cell(self):
        if self.cell is not None:
            self.cells.append(" ".join(" ".join(self.cell).split()))
            self.cell = None

    def _row(self):
        self._cell() if self.cells is not None else None
        if self.cells and any(self.cells):
            self.parts.append(" | ".join(self.cells))
        self.cells = None


def text_of(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser._row()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(parser.parts))


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text of each page; null for null."""
    return html.map(lambda x: None if x is None else text_of(x))


@F.pandas_udf(T.StringType())
def decode_html(data: pd.Series) -> pd.Series:
    """Bytes as text, by the first encoding that fits."""

    def one(raw):
        for name in ENCODINGS if raw is not None else ():
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return data.map(one)
