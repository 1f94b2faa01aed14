"""Feed documents taken apart in document order, with the message of the parser for those that are broken.

The readers built into Spark group an element's children by name, so which of two differently named ones came last
is lost, and they keep no message. Only this splitting is Python; every field is chosen by column expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle

# Workers receive the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ATOM = "{http://www.w3.org/2005/Atom}"  # fixed value
PART = "struct<tag:string,text:string,href:string,term:string,nested:boolean>"
_PART_TYPE = pa.list_(pa.struct([(n, pa.string()) for n in ("tag", "text", "href", "term")] + [("nested", pa.bool_())]))


def _part(tag: str, e) -> dict:
    return {"tag": tag, "text": e.text or "", "href": e.get("href"), "term": e.get("term"), "nested": len(e) > 0}


def _item(e) -> list[dict]:
    """Children under their names without prefix."""
    return [_part(child.tag.rpartition("}")[2], child) for child in e]


def _entry(e) -> list[dict]:
    """Atom children, and those of an author as author/name."""
    parts = []
    for child in e:
        if child.tag.startswith(ATOM):
            name = child.tag[len(ATOM):]
            parts.append(_part(name, child))
            parts += [_part(f"{name}/{g.tag[len(ATOM):]}", g) for g in child if name == "author" and g.tag.startswith(ATOM)]
    return parts


def elements(text: str) -> tuple[list[tuple[str, list[dict]]], str | None]:
    """(kind, parts) of every item and entry below the root, and the error of a document that has none for being broken."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as broken:
        return [], str(broken)
    kinds = (("item", "item", _item), ("entry", f"{ATOM}entry", _entry))
    return [(kind, parts(e)) for kind, tag, parts in kinds for e in root.iter(tag) if e is not root], None


def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, ...) to (..., kind, parts, error): a row of kind "file" for each document and one for each item."""
    for batch in batches:
        texts = batch.column("value")
        rest = batch.drop_columns(["value"])
        for i, text in enumerate(texts):
            found, error = elements(text.as_py() or "")
            n = len(found) + 1
            columns = [
                *(rest.column(c).take(pa.array([i] * n)) for c in range(rest.num_columns)),
                pa.array(["file", *(kind for kind, _ in found)], pa.string()),
                pa.array([[], *(parts for _, parts in found)], _PART_TYPE),
                pa.array([error] * n, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "kind", "parts", "error"])
