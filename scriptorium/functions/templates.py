"""Sentences from semi-structured values: templates over a VARIANT, as column expressions.

{a.b}       the value at a path as text, empty where there is none
{a.b|x}     x where there is none or an empty one
{a.b,}      a list, joined by ", "
{a.b~f}     the value through the function f of `calls`
<...>       a part that stands only where its first value (or `a.b?` at its start) is there, and neither empty, 0 nor false
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{([\w.]+)(\|[^}]*|,|~\w+)?\}")


def value(v: Column, path: str) -> Column:
    """The value at a path as text: numbers plain, booleans as True and False; null where there is none."""
    x = F.try_variant_get(v, f"$.{path}", "variant")
    text = F.try_variant_get(v, f"$.{path}", "string")
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(text)).otherwise(text)


def there(v: Column, path: str) -> Column:
    """Whether a value is there and neither null, empty, 0 nor false."""
    x = F.try_variant_get(v, f"$.{path}", "variant")
    json = F.to_json(x)
    return F.coalesce(~json.isin("null", '""', "0", "0.0", "false", "[]", "{}"), F.lit(False))


def strings(v: Column, path: str) -> Column:
    """A list of texts; empty where there is none."""
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def _slot(v: Column, path: str, kind: str | None, calls: Mapping[str, Callable[[Column], Column]]) -> Column:
    if kind == ",":
        return F.array_join(strings(v, path), ", ")
    if kind and kind[0] == "|":
        return F.when(there(v, path), value(v, path)).otherwise(F.lit(kind[1:]))
    if kind and kind[0] == "~":
        return F.coalesce(calls[kind[1:]](F.coalesce(value(v, path), F.lit(""))), F.lit(""))
    return F.coalesce(value(v, path), F.lit(""))


def _plain(v: Column, text: str, calls) -> list[Column]:
    out, at = [], 0
    for m in _SLOT.finditer(text):
        out += [F.lit(text[at : m.start()]), _slot(v, m[1], m[2], calls)]
        at = m.end()
    return [*out, F.lit(text[at:])]


def filled(v: Column, template: str, calls: Mapping[str, Callable[[Column], Column]] | None = None) -> Column:
    """A template's text for a variant."""
    parts: list[Column] = []
    for piece in re.split(r"(<[^>]*>)", template):
        if not piece.startswith("<"):
            parts += _plain(v, piece, calls or {})
            continue
        told = re.match(r"<([\w.]+)\?(.*)>$", piece)
        path, body = (told[1], told[2]) if told else (_SLOT.search(piece)[1], piece[1:-1])
        parts.append(F.when(there(v, path), F.concat(*_plain(v, body, calls or {}))).otherwise(F.lit("")))
    return F.concat(*parts)


def lines(v: Column, templates: list[str], calls: Mapping[str, Callable[[Column], Column]] | None = None) -> Column:
    """The texts of templates that are not empty, as an array."""
    return F.filter(F.array(*[filled(v, t, calls) for t in templates]), lambda x: x != "")
