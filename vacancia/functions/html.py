"""Markup to text.

Text nodes only, character references decoded once, nothing put between neighbouring nodes, script and
style bodies kept, ends trimmed. Plain markup is handled in the JVM; rows the JVM form cannot be sure
about (scripts, rare references, broken tags) go through one Arrow function around the standard library
parser. Both give the same text, so the choice is made row by row.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancia.functions.text import col, strip_ws

# Workers receive the function itself, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ATTR = r"""\s+[a-zA-Z][a-zA-Z0-9:_-]*(?:="[^"<>]*")?"""
# Script-like elements switch the parser's mode, so their tags never count as plain.
_PLAIN_TAG = rf"</?(?!(?i:script|style|textarea|title|plaintext|xmp|iframe|noembed|noframes|noscript)\b)[a-zA-Z][a-zA-Z0-9]*+(?:{_ATTR})*+\s*/?>"
_PLAIN_COMMENT = r"<!--[^<>-]*+-->"
PLAIN_MARKUP = f"{_PLAIN_TAG}|{_PLAIN_COMMENT}"
# The references decoded in the JVM; the ampersand must come last.
BASIC_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
_BASIC_PATTERN = "|".join(ref for ref, _ in BASIC_REFERENCES)
# The fast form also drops tags the plain pattern refuses.
_ANY_MARKUP = r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>"


class _TextNodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []

    def handle_data(self, data):
        self.nodes.append(data)


def text_nodes(markup: str | None) -> str | None:
    """The parser is fed but never closed: an unfinished tail stays unread."""
    if markup is None:
        return None
    parser = _TextNodes()
    try:
        parser.feed(markup)
    except Exception:
        return markup
    return "".join(parser.nodes).strip()


@F.pandas_udf(T.StringType())
def _text_nodes_arrow(markup: pd.Series) -> pd.Series:
    return markup.map(text_nodes, na_action="ignore")


def _decode_basic(c: Column) -> Column:
    for ref, char in BASIC_REFERENCES:
        c = F.replace(c, F.lit(ref), F.lit(char))
    return c


def strip_html(c: Column | str, mode: str = "auto") -> Column:
    """mode: "auto" (exact, JVM where sure), "exact" (parser for all), "fast" (JVM for all)."""
    raw = F.coalesce(col(c), F.lit(""))
    if mode == "exact":
        return F.coalesce(_text_nodes_arrow(raw), F.lit(""))
    if mode == "fast":
        return strip_ws(_decode_basic(F.regexp_replace(raw, _ANY_MARKUP, "")))
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    bare = F.regexp_replace(raw, PLAIN_MARKUP, "")
    unsure = F.rlike(F.regexp_replace(bare, _BASIC_PATTERN, ""), F.lit("[<&]"))
    parsed = _text_nodes_arrow(F.when(unsure, raw))
    return F.coalesce(parsed, strip_ws(_decode_basic(bare)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _text_nodes_list_arrow(items: pd.Series) -> pd.Series:
    return items.map(lambda markups: [text_nodes(m) for m in markups], na_action="ignore")


def strip_html_list(items: Column) -> Column:
    """`strip_html` over a list of fragments; lists with only plain markup stay in the JVM."""
    raw = F.transform(items, lambda m: F.coalesce(m, F.lit("")))
    bare = F.transform(raw, lambda m: F.regexp_replace(m, PLAIN_MARKUP, ""))
    unsure = F.exists(bare, lambda m: F.rlike(F.regexp_replace(m, _BASIC_PATTERN, ""), F.lit("[<&]")))
    return F.coalesce(_text_nodes_list_arrow(F.when(unsure, raw)), F.transform(bare, lambda m: strip_ws(_decode_basic(m))))
