"""Text helpers as native Column expressions.

The original code runs on Python strings; where Python and Java
semantics differ (whitespace, title case, strip) the expressions below
spell out the Python behaviour with patterns that Java regex and RE2
read the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

WS = K.PY_WHITESPACE_CLASS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(text: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(text), f"^{WS}+|{WS}+$", "")


def clean_text(text: Column | str) -> Column:
    """B1: drop bracketed citation lists ``[1]``, ``[2, 3]`` (``[2-4]`` stays),
    collapse whitespace runs to one blank, strip."""
    no_cites = F.regexp_replace(_c(text), K.CITATION_PATTERN, "")
    collapsed = F.regexp_replace(no_cites, f"{WS}+", " ")
    # after collapsing, only a single U+0020 can remain at either end
    return F.trim(collapsed)


_REGEX_META = set("\\.^$|?*+()[]{}")


def regex_literal(s: str) -> str:
    """A literal text as a pattern valid in Java regex and RE2."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in s)


def unsubsumed(keywords: list[str]) -> list[str]:
    """Keywords that contain no other keyword of the list: a text holds any
    of the list exactly if it holds any of these."""
    return [k for k in dict.fromkeys(keywords) if not any(o != k and o in k for o in keywords)]


def contains_any(text: Column | str, keywords: list[str], lower: bool = True) -> Column:
    """True when the (lower-cased) text contains any keyword as a substring.

    Keywords are used as given: a keyword with an upper-case letter never
    matches lower-cased text, as in the original, so it is left out. The
    text expression is evaluated and lower-cased once (as the only element
    of an array), whatever the number of keywords.
    """
    t = F.lower(_c(text)) if lower else _c(text)
    live = unsubsumed([k for k in keywords if not lower or k == k.lower()])
    if not live:
        return F.lit(False) & t.isNotNull()
    return F.coalesce(F.exists(F.array(t), lambda x: reduce(lambda p, q: p | q, [x.contains(k) for k in live])), F.lit(False))


def py_title(text: Column | str) -> Column:
    """Python ``str.title()``: every run of letters starts upper-case, the
    rest of the run is lower-case (so ``soda-lime`` -> ``Soda-Lime``, which
    ``initcap`` alone does not do)."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"([^\p{L}]+|\p{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.initcap(w)), "")


def strip_suffixes(text: Column | str, suffixes: list[str]) -> Column:
    """Remove every occurrence of each suffix text, in order (Python ``replace``)."""
    out = _c(text)
    for s in suffixes:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def decode_xml_entities(text: Column | str) -> Column:
    """Decode the five predefined XML entities (``&amp;`` last)."""
    out = _c(text)
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def strip_tags(html: Column | str) -> Column:
    """Text content of an HTML/XML fragment: tags removed, entities decoded."""
    return decode_xml_entities(F.regexp_replace(_c(html), r"<[^>]*>", ""))
