"""Text structuring (B1-B9) as map-only DataFrame jobs.

Two inputs share the operators:

* ``documents``: one paper per document; its lines are the paragraphs
  of one section whose heading is the document's ``source``.
* ``pages`` (HTML): title, first paragraph, block sections and the
  ``<ul>`` lists as tables of cells.

Everything works on one row at a time (array higher-order functions),
so there is no shuffle and no Python. Well-nested TEI goes through
``tei_columns.py``, broken TEI files through ``tei.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markup as M
from ..functions.text import clean_text, contains_any, strip_tags
from ..functions.units import bound

# --- documents ----------------------------------------------------------------


def paragraphs_of(text: Column | str) -> Column:
    """Paragraphs of a document: its lines."""
    t = F.col(text) if isinstance(text, str) else text
    return F.split(t, "\n", -1)


def is_relevant(text: Column) -> Column:
    """B2: paragraph mentions a deposition keyword (lower-case substring)."""
    return contains_any(text, K.PARAGRAPH_KEYWORDS)


def relevant_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every paragraph cleaned (B1) and kept when relevant (B2), with
    its position."""
    return (
        docs.select(id_col, F.posexplode(paragraphs_of(text_col)).alias("pos", "raw"))
        .select(id_col, "pos", clean_text("raw").alias("paragraph"))
        .filter(is_relevant(F.col("paragraph")))
    )


def section_text(text: Column | str) -> Column:
    """The relevant cleaned paragraphs joined by one blank, in order;
    null when none survived (the section is dropped)."""
    cleaned = F.transform(paragraphs_of(text), lambda p: clean_text(p))
    kept = F.filter(cleaned, lambda p: is_relevant(p))
    return bound(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")))


def structured_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Structured paper per document: (paper_id, title, abstract, sections)."""
    sec = F.struct(F.col("source").alias("heading"), section_text("text").alias("text"))
    return docs.select(
        F.col(id_col).cast("string").alias("paper_id"),
        F.lit("").alias("title"),
        F.lit("").alias("abstract"),
        # the section text is built once; a section without text is dropped
        F.filter(F.array(sec), lambda s: s["text"].isNotNull()).alias("sections"),
    )


def section_assemble(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """B7 as rows: (id, heading, text) for sections that kept a paragraph.
    A section is one element of an array and the filter tests the element:
    a filter on the column would compute the text again below it."""
    section = F.struct(F.col("source").alias("heading"), section_text("text").alias("text"))
    return docs.select(id_col, F.inline(F.filter(F.array(section), lambda s: s["text"].isNotNull())))


# --- pages (HTML) ---------------------------------------------------------------

def _first(html: Column, pattern: str) -> Column:
    return F.regexp_extract(html, pattern, 1)


def page_title(html: Column | str) -> Column:
    """First <title> text, cleaned, else ''."""
    h = F.col(html) if isinstance(html, str) else html
    return clean_text(strip_tags(_first(h, r"(?s)<title[^>]*>(.*?)</title>")))


def _body(h: Column) -> Column:
    return _first(h, r"(?s)<body[^>]*>(.*)</body>")


def _paragraph_texts(fragment: Column) -> Column:
    """Texts of the <p> elements of a fragment. Paragraphs may be left
    open, so each runs to its ``</p>`` or to the next ``<p>``."""
    pieces = F.slice(F.split(fragment, r"<p(?:\s[^>]*)?>", -1), 2, 1 << 30)
    return F.transform(pieces, lambda s: clean_text(strip_tags(F.regexp_replace(s, r"(?s)</p>.*$", ""))))


def page_abstract(html: Column | str) -> Column:
    """B4 on pages: the first paragraph of the article, cleaned, else ''."""
    h = F.col(html) if isinstance(html, str) else html
    art = _first(h, r"(?s)<article[^>]*>(.*?)</article>")
    return F.coalesce(F.try_element_at(_paragraph_texts(art), F.lit(1)), F.lit(""))


def page_sections(html: Column | str) -> Column:
    """The block children of <body> (<div>, <article>) in order, as
    ``struct(heading, paragraphs)``; heading = first h1-h6, else
    'Unknown Section'. A block runs to its own closing tag, so blocks nested
    in it belong to it; one inside a navigation, a list or any other
    container is no child of the body."""
    h = F.col(html) if isinstance(html, str) else html
    blocks = M.children(_body(M.readable(h)), ["div", "article"], M.HTML_CONTAINERS)

    def one(b: Column) -> Column:
        head = F.regexp_extract(b, r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
        heading = F.when(head == "", F.lit(K.UNKNOWN_SECTION)).otherwise(clean_text(strip_tags(head)))
        return F.struct(heading.alias("heading"), _paragraph_texts(b).alias("paragraphs"))

    return F.transform(blocks, one)


def list_cells(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """B8 over pages: each ``<ul>`` is a table (1-based), each ``<li>`` a row
    of one cleaned cell. Long form (id, table_idx, row_idx, cell_idx, cell)."""
    lists = F.regexp_extract_all(F.col("html"), F.lit(r"(?s)<ul[^>]*>(.*?)</ul>"), 1)
    t = pages.select(id_col, F.posexplode(lists).alias("t", "ul"))
    rows = t.select(id_col, (F.col("t") + 1).alias("table_idx"),
                    F.posexplode(F.regexp_extract_all(F.col("ul"), F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1)).alias("r", "li"))
    return rows.select(id_col, "table_idx", (F.col("r") + 1).alias("row_idx"), F.lit(1).alias("cell_idx"),
                       clean_text(strip_tags("li")).alias("cell"))


def page_ok(html: Column | str) -> Column:
    """B9 status of one page: a body element could be found."""
    h = F.col(html) if isinstance(html, str) else html
    return F.coalesce(h.rlike(r"(?s)<body[^>]*>.*</body>"), F.lit(False))


def parse_report(pages: DataFrame) -> DataFrame:
    """One failed page never stops the job; success and total counts."""
    ok = page_ok("html")
    return pages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
    )


def structured_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Structured paper per page (A3 writes this): title, abstract and the
    sections that kept a relevant paragraph."""
    secs = page_sections("html")
    kept = F.transform(
        secs,
        lambda s: F.struct(s["heading"].alias("heading"),
                           F.array_join(F.filter(s["paragraphs"], lambda p: is_relevant(p)), " ").alias("text")),
    )
    return pages.select(
        F.col(id_col).cast("string").alias("paper_id"),
        page_title("html").alias("title"),
        page_abstract("html").alias("abstract"),
        F.filter(kept, lambda s: s["text"] != "").alias("sections"),
    )
