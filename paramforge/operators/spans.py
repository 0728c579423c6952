"""B15 with positions: values and cues are spans of the text, and a value
that could fill several fields goes to the field of the nearest cue.

``found_in`` marks every match of one alternation of patterns, so each text is
scanned once; ``assigned`` is an as-of step to both sides: the last cue before
a value and the first cue after it, whichever lies closer (the one before on
a tie). Both run in the JVM on one text at a time, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.units import bound

_NUMBER = r"\b[0-9][0-9.]*(?:-[0-9]+)?"
#: (quantity, field of a cue or '' of a value, pattern), tested in this order.
#: The syntax is common to Java and RE2; ``\b`` is ASCII in both.
PATTERNS = [
    ("pressure", "base_pressure", r"\b(?:base pressure|background pressure|base vacuum)"),
    ("pressure", "working_pressure", r"\b(?:working pressure|process pressure|sputtering pressure)"),
    ("substance", "target", r"\btargets?\b"),
    ("substance", "substrate", r"\bsubstrates?\b"),
    ("substance", "material", r"\bfilms?\b"),
    ("pressure", "", r"\b[0-9][0-9.]*(?:e-?[0-9]+)?(?: ?[x×] ?10\^?-?[0-9]+)? ?(?:mtorr|torr|mbar|mpa|pa)\b"),
    ("power", "", r"\b[0-9][0-9.,]*(?:-[0-9]+)? ?(?:kw|mw|w)\b"),
    ("temperature", "", r"-?" + _NUMBER + r" ?°? ?(?:c|k)\b|\broom temperature|\brt\b"),
    ("thickness", "", _NUMBER + r" ?(?:(?:nm|um|mm|a)\b|μm|Å)"),
    ("method", "", r"\b(?:(?:rf|dc|pulsed dc) )?(?:magnetron )?sputter(?:ing)?\b|\bmagnetron\b|\bhipims\b|\bion beam deposition\b|\bsol-gel\b"),
    ("gas", "", r"\b(?:argon|oxygen|nitrogen|hydrogen|krypton|ar|o2|n2|h2)\b"),
    ("substance", "", r"\bzinc oxide\b|\b(?:soda-lime |ito )?glass\b|\bquartz\b|\bsapphire\b|\bkapton\b|(?-i:\b(?:[A-Z][a-z]?[0-9]*){2,}(?:[:/](?:[A-Z][a-z]?[0-9]*)+)*\b)"),
]
#: Field of a value whose quantity has one field, or that has no cue in reach.
DEFAULT_FIELD = {"pressure": "working_pressure", "power": "power", "temperature": "temperature", "thickness": "film_thickness",
                 "method": "deposition_method", "gas": "gas_mixture", "substance": "material"}
#: Characters between a value and a cue that still belong together.
REACH = 60
FIELDS = [k.lower() for k in K.RAW_KEYS]
ANY = "(?i)(" + "|".join(f"(?:{p})" for _, _, p in PATTERNS) + ")"
OPEN, CLOSE, NEXT = "\x01", "\x02", "\x03"  # marks; a text that holds them has them as blanks


def _grouped() -> tuple[str, list[int]]:
    """The same as ``ANY``, by the kind of the first character, and the pattern
    of each of its groups. All patterns start at a word boundary, only one may
    have a minus before it: the boundary is looked for once, and a character
    meets only the branches that can begin with it."""
    digit, letter, minus = [], [], []
    for k, (_, _, pattern) in enumerate(PATTERNS):
        branches = re.split(r"\|(?=(?:-\?|\(\?-i:)?\\b)", pattern)
        signed = [b for b in branches if b.startswith("-?")]
        bare = [b.removeprefix("-?").replace(r"\b", "", 1) for b in branches]
        for kind, found in ((digit, [b for b in bare if b.startswith("[0-9]")]), (letter, [b for b in bare if not b.startswith("[0-9]")]), (minus, [b.replace("-?", "-", 1) for b in signed])):
            if found:
                kind.append((k, f"({'|'.join(found)})"))
    of = lambda kind: "|".join(g for _, g in kind)
    return rf"(?i)\b(?:(?=[0-9])(?:{of(digit)})|(?=[a-z])(?:{of(letter)}))|{of(minus)}", [k for k, _ in digit + letter + minus]


#: A match is rewritten as all groups in a line, of which one is not empty: its
#: place tells the pattern.
GROUPS, GROUP_PATTERNS = _grouped()
MARKED = OPEN + NEXT.join(f"${k}" for k in range(1, len(GROUP_PATTERNS) + 1)) + CLOSE


def found_in(text: Column) -> Column:
    """array<struct<start, end, span, quantity, cue>>: every match of a text
    with its place in characters, from 0, in the order of the text. ``cue`` is
    the field a cue names, null for a value."""

    def unmarked(t: Column) -> Column:
        return F.when(t.contains(OPEN) | t.contains(CLOSE) | t.contains(NEXT), F.translate(t, OPEN + CLOSE + NEXT, "   ")).otherwise(t)

    clean = bound(F.coalesce(text, F.lit("")), unmarked)
    pieces = F.split(F.regexp_replace(clean, GROUPS, MARKED), OPEN)
    # each piece but the first is the groups, CLOSE, and the text up to the next
    marks = len(GROUP_PATTERNS)

    def places(p: Column) -> Column:
        """Where each match starts, and last the end of the text."""
        return F.aggregate(F.slice(p, 2, F.size(p)), F.array(F.length(p[0])), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x) - marks))

    kinds = F.array(*[F.struct(F.lit(PATTERNS[k][0]).alias("quantity"), F.lit(PATTERNS[k][1] or None).cast("string").alias("cue")) for k in GROUP_PATTERNS])

    def match(start: Column, piece: Column) -> Column:
        def told(groups: Column) -> Column:
            return bound(F.replace(groups, F.lit(NEXT), F.lit("")), lambda span: F.struct(span.alias("span"), F.get(kinds, F.instr(groups, span) - 1).alias("kind")))

        return bound(bound(F.substring_index(piece, CLOSE, 1), told), lambda m: F.struct(
            start.alias("start"), (start + F.length(m["span"])).alias("end"), m["span"].alias("span"), m["kind"]["quantity"].alias("quantity"), m["kind"]["cue"].alias("cue")))

    return bound(pieces, lambda p: F.transform(F.slice(places(p), 1, F.size(p) - 1), lambda at, i: match(at, F.get(p, i + 1))))


def spans(papers: DataFrame, text_col: str = "combined_text", key: list[str] | None = None) -> DataFrame:
    """(key, start, end, span, quantity, cue): the matches of ``found_in`` as
    rows. A null or empty text has no spans. ``key`` (paper_id) names a text;
    rows with the key and text of another add nothing."""
    key = key or ["paper_id"]
    rows = papers.select(*key, F.explode(found_in(F.col(text_col))).alias("s")).select(*key, "s.*")
    return rows.dropDuplicates([*key, "start"])


def assigned(found: Column, reach: int = REACH) -> Column:
    """array<struct<start, span, field, distance>>: every value of ``found_in``
    with the field of its nearest cue of the same quantity, at most ``reach``
    characters away; otherwise with the quantity's default field and a null
    distance. Spans do not overlap and are not empty, so a cue with ``reach``
    or more spans between is out of reach: no other is looked at."""
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_FIELD.items() for x in kv])
    cued = sorted({q for q, cue, _ in PATTERNS if cue})
    far = F.lit(1 << 30)

    def near(all_: Column, cues: Column, v: Column, i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        # of a short text, all cues; their number bounds the work
        some = F.when(F.size(all_) <= reach, cues).otherwise(F.slice(all_, first + 1, i - first + reach + 1))
        around = F.filter(some, lambda c: c["cue"].isNotNull() & (c["quantity"] == v["quantity"]))

        def side(cues: Column) -> Column:
            left = F.try_element_at(F.filter(cues, lambda c: c["start"] < v["start"]), F.lit(-1))
            right = F.get(F.filter(cues, lambda c: c["start"] > v["start"]), F.lit(0))
            return F.struct(left.alias("l"), right.alias("r"), F.coalesce(v["start"] - left["end"], far).alias("dl"), F.coalesce(right["start"] - v["end"], far).alias("dr"))

        def pick(n: Column) -> Column:
            distance = F.least(n["dl"], n["dr"])
            cue = F.when(n["dl"] <= n["dr"], n["l"]["cue"]).otherwise(n["r"]["cue"])
            return F.when(distance <= reach, F.struct(cue.alias("cue"), distance.alias("distance")))

        return F.when(v["quantity"].isin(cued), bound(around, lambda cues: bound(side(cues), pick)))

    def value(v: Column, n: Column) -> Column:
        return F.struct(v["start"].alias("start"), v["span"].alias("span"),
                        F.coalesce(n["cue"], F.element_at(default, v["quantity"])).alias("field"), n["distance"].alias("distance"))

    def all_values(all_: Column, cues: Column) -> Column:
        each = F.transform(all_, lambda v, i: F.when(v["cue"].isNull(), bound(near(all_, cues, v, i), lambda n: value(v, n))))
        return F.filter(each, lambda v: v.isNotNull())

    return bound(found, lambda all_: bound(F.filter(all_, lambda s: s["cue"].isNotNull()), lambda cues: all_values(all_, cues)))


def extract_fields(papers: DataFrame, text_col: str = "combined_text", reach: int = REACH) -> DataFrame:
    """The ten raw fields of every row: the values of a field in the order of
    the text, joined by ', '; a field without a value is 'Not specified'. Rows
    without any span stay. Two texts under one paper_id are two papers; a
    repeated row comes out as often as it came in; a null id is an id."""
    values = assigned(found_in(F.col(text_col)), reach)
    # a generated row is computed once, whatever is read from it later
    told = papers.select("paper_id", F.inline(F.array(F.struct(values.alias("_all")))))

    def of(field: str):
        # nulls are not joined
        return F.array_join(F.transform("_all", lambda s: F.when(s["field"] == field, s["span"])), ", ")

    return told.select("paper_id", *[F.coalesce(F.nullif(of(f), F.lit("")), F.lit(K.NOT_SPECIFIED)).alias(f) for f in FIELDS])
