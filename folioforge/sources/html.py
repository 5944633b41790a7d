"""Text of raw web pages, as a column."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that start a line, and elements that are not shown.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
HIDDEN = frozenset("script style head template noscript svg title".split())


#: Elements without content and without an end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _shown(tag: str, attrs: list) -> bool:
    names = {k: v or "" for k, v in attrs}
    return tag not in HIDDEN and "hidden" not in names and "display:none" not in "".join(names.get("style", "").lower().split())


class _Reader(HTMLParser):
    """Text of shown elements. ``open`` holds the elements that are open from a hidden one on."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.parts.append("\n")
        elif tag in ("td", "th") and not self.open:
            self.parts.append(" ")
        if tag not in VOID and (self.open or not _shown(tag, attrs)):
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        # An end closes the nearest open element of its name; ends of elements that were not opened inside mean nothing.
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.open:
            self.parts.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    """The shown text, a line for each block, without empty lines."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = (re.sub(r" +", " ", line).strip() for line in "".join(reader.parts).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text, na_action="ignore")
