"""Column functions on text: tokens, names, mark-up, numbers, digests.  All stay in the JVM."""

from __future__ import annotations

import json
from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Short terms that are kept although they have two letters.
SHORT_TERMS = ("ac", "dc", "hp", "xp")
# Words that a search leaves out
STOP_WORDS = (
    "about", "after", "also", "and", "are", "because", "before", "between", "can", "could", "does", "for", "from", "have", "how", "into", "its", "mean", "means",
    "set", "that", "the", "their", "them", "then", "this", "use", "using", "what", "when", "where", "which", "with", "would", "your",
)
# Entities that translations are cleaned of, in order
TAG_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&apos;", "'"), ("&quot;", '"'))
# Entities that pages are cleaned of where the result is fixed by a list, in order
PAGE_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
# What counts as a number (dice, decimals, ordinals), and what marks private paths
NUMBER = r"(?Ui)(?<!\w)(?:\d+d\d+(?:\s*[+-]\s*\d+)?|\d+(?:\.\d+)?(?:st|nd|rd|th)?)(?!\w)"
PRIVATE_PATHS = ("\\users\\", "/home/", "/users/")
#: What stands for a character in HTML: a number, or a name of at most 32 characters.
_ENTITY = "&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def search_terms(text: Column) -> Column:
    """A query's terms in order, once each, without stop words and short words."""
    keep = lambda t: ((F.char_length(t) > 2) | t.isin(*SHORT_TERMS)) & ~t.isin(*STOP_WORDS)
    return F.array_distinct(F.filter(tokens(text), keep))


def normal_name(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def holds_name(query: Column, name: Column) -> Column:
    """Whether a name's terms stand in a query, in a row and whole."""
    n = normal_name(name)
    single = n.isin(*STOP_WORDS)
    return (n != "") & ~single & F.contains(F.concat(F.lit(" "), normal_name(query), F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def _names() -> str:
    """The names of HTML's entities (without the ampersand) as a JSON object; those that need no semicolon stand without one too."""
    return json.dumps(html5)


def _point(n: Column) -> Column:
    """The character of a number, as HTML reads it: Windows' characters for 128 to 159, a mark for what is none."""
    windows = {0: "\ufffd", 13: "\r"} | {k: bytes([k]).decode("cp1252", "replace").replace("\ufffd", chr(k)) for k in range(128, 160)}
    table = F.create_map(*[F.lit(x) for pair in windows.items() for x in pair])
    code = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    none = (n.between(1, 8)) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.coalesce(F.element_at(table, n.cast("int")), F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(none, "").otherwise(code))


def unescape(text: Column) -> Column:
    """HTML's entities to characters, each once: names with a semicolon, some without, numbers."""
    names = F.from_json(F.lit(_names()), "map<string,string>")
    digits = lambda e: F.regexp_replace(e, "[^0-9a-fA-F]", "")

    def number(e: Column) -> Column:
        hexed = e.rlike("^&#[xX]")
        told = F.when(hexed, F.ltrim(digits(F.substring(e, 4, 100)), F.lit("0"))).otherwise(F.ltrim(digits(e), F.lit("0")))
        large = F.length(told) > 9
        ten = F.when(large, F.lit("2147483647")).otherwise(F.concat(F.lit("0"), told))
        n = F.when(hexed & ~large, F.conv(ten, 16, 10)).otherwise(ten).cast("long")
        return _point(n)

    def named(e: Column) -> Column:
        name = F.substring(e, 2, 40)
        # else the longest beginning that is a name without a semicolon
        heads = F.transform(F.when(F.length(name) > 1, F.sequence(F.length(name) - 1, F.lit(1), F.lit(-1))), lambda k: F.named_struct(F.lit("k"), k, F.lit("c"), F.element_at(names, F.substring(name, F.lit(1), k))))
        head = F.get(F.filter(heads, lambda h: h["c"].isNotNull()), F.lit(0))
        return F.coalesce(F.element_at(names, name), F.concat(head["c"], F.substring(name, head["k"] + 1, F.lit(40))), e)

    between, found = F.split(text, _ENTITY, -1), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    read = F.transform(found, lambda e: F.when(F.startswith(e, F.lit("&#")), number(e)).otherwise(named(e)))
    glued = F.array_join(F.zip_with(between, read, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), glued).otherwise(text)


@cache
def _single_upper() -> dict[str, str]:
    """Characters whose upper case is more than one, and what stands for each where a character gives one."""
    many = [c for c in map(chr, range(0x110000)) if len(c.upper()) > 1]
    return {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in many}


def upper_each(text: Column) -> Column:
    """Upper case of as many characters as the text has, as SQL gives it: a sharp s is not two letters."""
    single = F.create_map(*[F.lit(x) for pair in _single_upper().items() for x in pair])
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(single, c), F.upper(c))), "")
    return F.when(text.rlike(f"[{''.join(_single_upper())}]"), each).otherwise(F.upper(text))


def strip_html(html: Column) -> Column:
    """Tags to blanks, entities to characters, blanks collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, "<[^>]+>", " ")), r"(?U)\s+", " "))


def strip_listed(html: Column) -> Column:
    """As strip_html, but of entities those of a list alone, with their semicolons, and ASCII blanks alone."""
    x = F.regexp_replace(html, "<[^>]+>", " ")
    for name, char in PAGE_ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[\t\n\f\r ]+", " "))


def strip_tags(html: Column) -> Column:
    """Tags to nothing and a few entities to characters, as translations are cleaned."""
    x = F.regexp_replace(html, "<[^>]+>", "")
    for name, char in TAG_ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def numbers(text: Column) -> Column:
    """Numbers, dice and ordinals, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lower)


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once, however often fn names it (in a lambda, too)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trigrams(words: Column) -> Column:
    """Sets of three words in a row."""
    # words are taken by place: a slice walks to its start, which squares the time of long texts
    three = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return let(words, lambda w: F.when(F.size(w) < 3, F.array().cast("array<string>")).otherwise(three(w)))


def coverage(part: Column, whole: Column) -> Column:
    """Share of a set that another holds."""
    return let(part, lambda p: F.size(F.array_intersect(p, whole)) / F.greatest(F.lit(1), F.size(F.array_distinct(p))))


def slug(text: Column, most: int = 80, default: str = "section") -> Column:
    x = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def bare_id(name: Column) -> Column:
    """What follows the last colon."""
    return F.substring_index(name, ":", -1)


def digest(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *cols), 256)


def private_marks(text: Column, markers: tuple[str, ...] = ()) -> Column:
    """Names of the kinds of private values in a text, sorted, comma-joined; markers: words that mark one, in lower case."""
    kinds = [("at", text.rlike("@")), ("control", text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")), ("email", text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))]
    low = F.lower(text)
    home = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in PRIVATE_PATHS])
    marked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers], F.lit(False))
    kinds += [("home", home), ("marker", marked), ("path", text.rlike(r"[A-Za-z]:\\"))]
    return F.concat_ws(",", *[F.when(hit, F.lit(k)) for k, hit in kinds])
