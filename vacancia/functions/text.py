"""Text and list helpers with the falsy rules of the source documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that count as white space in the input rules.
WS = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*cols: Column | str, default: str | None = "") -> Column:
    """First non-empty string; missing, null and "" all count as empty, spaces do not."""
    parts = [blank_to_null(c) for c in cols]
    return F.coalesce(*parts, F.lit(default)) if default is not None else F.coalesce(*parts)


def filled_number(c: Column) -> Column:
    """Null for zero: an amount of 0 counts as missing."""
    return F.when(c != 0, c)


def lowered(c: Column | str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def strip_ws(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"(?U)\A{WS}+|{WS}+\z", "")


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Plain substring tests joined by OR; `text` must already be lower case."""
    out = F.lit(False)
    for i, term in enumerate(terms):
        hit = F.contains(text, F.lit(term))
        out = hit if i == 0 else out | hit
    return out


def terms_found(text: Column, terms: Sequence[str]) -> Column:
    """The given terms that are substrings of the lower-case text, in their order; blank ones never are."""
    usable = [t for t in terms if t.strip()]
    if not usable:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t.lower().strip())), F.lit(t)) for t in usable]))


def count_found(text: Column, terms: Sequence[str]) -> Column:
    """How many of the given terms are substrings of the lower-case text."""
    out = F.lit(0)
    for t in terms:
        if t.strip():
            out = out + F.contains(text, F.lit(t.lower().strip())).cast("int")
    return out


def parse_comma_list(c: Column | str) -> Column:
    """Split on commas, trim, drop blanks."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), strip_ws)
    return F.filter(parts, lambda x: x != "")


def drop_blanks(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def singleton(c: Column) -> Column:
    """[] for an empty value, else a one-element list."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(c, F.lit("")) == "", empty).otherwise(F.array(c))


def names_of(structs: Column) -> Column:
    """`name` of each struct, "" where it is missing."""
    return F.transform(structs, lambda s: F.coalesce(s["name"], F.lit("")))


def searchable_text(title="title", description="description_text", company="company",
                    departments="departments", tags="tags") -> Column:
    """Lower-case title, description, company, departments and tags with one space between each."""
    def joined(c):
        return F.coalesce(F.array_join(col(c), " "), F.lit(""))

    parts = [F.coalesce(col(c), F.lit("")) for c in (title, description, company)]
    return F.lower(F.concat_ws(" ", *parts, joined(departments), joined(tags)))


def first_phrase(text_lower: Column, phrases: Sequence[str]) -> Column:
    """The first phrase of the list found in the text, or null."""
    return F.coalesce(*[F.when(F.contains(text_lower, F.lit(p)), F.lit(p)) for p in phrases])


def make_id(source: Column | str, *parts: Column) -> Column:
    """First 12 hex digits of md5 over `source:part:part`, empty parts left out."""
    src = F.lit(source) if isinstance(source, str) else source
    key = F.concat(src, F.lit(":"), F.concat_ws(":", *[blank_to_null(p.cast("string")) for p in parts]))
    return F.substring(F.md5(key), 1, 12)


def company_from_title(title: Column | str) -> Column:
    """What follows the last " at " of a headline, else ""."""
    t = col(title)
    return F.when(F.contains(t, F.lit(" at ")), strip_ws(F.substring_index(t, " at ", -1))).otherwise("")
