"""Text columns: trimming, whitespace, tags, entities, teasers, single-line prompt text."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: blank, tab, line feed, carriage return, NUL and vertical tab
_EDGE = " \t\n\r\x00\x0b"


def trim_edges(c: Column) -> Column:
    return F.trim(c, F.lit(_EDGE))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(_EDGE))


def squeeze(c: Column) -> Column:
    """Runs of any (Unicode) white space become one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>", "")


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _entity(found: re.Match) -> str:
    mark = found[0]
    return html.unescape(mark) if mark[1] == "#" else html5.get(mark[1:], mark)


def _decoded(text: str) -> str:
    """Entities closed by a semicolon; unknown names and cut-off ones stay as they are."""
    return _ENTITY.sub(_entity, text)


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    # only texts with an ampersand become Python strings
    marked = pc.fill_null(pc.match_substring(texts, "&"), False)
    decoded = [_decoded(t) for t in texts.filter(marked).to_pylist()]
    return pc.replace_with_mask(texts, marked, pa.array(decoded, texts.type)) if decoded else texts


def decode_core(c: Column) -> Column:
    """The five predefined entities only, without leaving the JVM."""
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def decode_entities(c: Column) -> Column:
    return _unescape(c)


@F.pandas_udf(ArrayType(StringType()))
def _unescape_all(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda texts: [None if t is None else _decoded(t) for t in texts], na_action="ignore")


def decode_entities_all(c: Column) -> Column:
    """``decode_entities`` for every element of an array, row-local."""
    return _unescape_all(c)


#: elements whose end ends a line
LINE_ENDS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li")


def _pieces(c: Column, *, shortcodes: bool = False) -> Column:
    """The text cut, in order and without loss, into comments, tags, shortcodes where asked for, and runs between them."""
    marked = r"(?s:<!--.*?-->)|<[A-Za-z/!?][^>]*>"
    plain = r"[^<]+|<"
    if shortcodes:
        marked, plain = rf"{marked}|(?i:\[/?[a-z_]+[^\]]*\])", r"[^<\[]+|[<\[]"
    return F.regexp_extract_all(c, F.lit(f"{marked}|{plain}"), F.lit(0))


def _is_marked(piece: Column, opener: str) -> Column:
    """A lone opener is text; markup has an end as well."""
    return F.startswith(piece, F.lit(opener)) & (F.length(piece) > 1)


def _tag_text(piece: Column) -> Column:
    """What stands for a tag: a line end for ``br`` and closed blocks, otherwise nothing."""
    inner = F.lower(F.substr(piece, F.lit(2), F.length(piece) - 2))
    ends_line = inner.isin(*[f"/{name}" for name in LINE_ENDS]) | (F.rtrim(F.rtrim(inner, F.lit("/")), F.lit(" \t\r\n")) == "br")
    return F.when(ends_line, "\n").otherwise("")


def html_to_text(c: Column) -> Column:
    """Markup read piece by piece (a tag runs to the next ``>``), entities decoded; a run of the same white space counts once."""
    read = F.transform(_pieces(c), lambda piece: F.when(_is_marked(piece, "<"), _tag_text(piece)).otherwise(piece))
    plain = F.translate(decode_entities(F.array_join(read, "")), "\t", " ")
    return trim_edges(F.regexp_replace(plain, r"([ \n])\1+", "$1"))


def shorten(c: Column, width: int = 600) -> Column:
    """The words in one line, cut hard at ``width`` characters with an ellipsis; null when blank."""
    line = trim_edges(F.regexp_replace(c, r"\s+", " "))
    return blank_to_null(F.when(F.length(line) > width, F.concat(trim_end(F.left(line, F.lit(width))), F.lit("…"))).otherwise(line))


def shorten_at_word(c: Column, width: int = 600) -> Column:
    """Whole words within ``width``, with a spaced ellipsis; a first word that is longer is cut."""
    head = F.left(c, F.lit(width))
    broken = F.length(F.substring_index(head, " ", -1))
    whole = F.when(broken < F.length(head), F.left(head, F.length(head) - broken)).otherwise(head)
    return F.when(F.length(c) > width, F.concat(trim_end(whole), F.lit(" …"))).otherwise(c)


def clean_text(c: Column) -> Column:
    """One line: entities decoded, a blank for each ``[shortcode]``, nothing for tags."""
    pieces = _pieces(decode_entities(c), shortcodes=True)
    read = F.transform(pieces, lambda piece: F.when(_is_marked(piece, "<"), "").when(_is_marked(piece, "["), " ").otherwise(piece))
    return trim_edges(squeeze(F.array_join(read, "")))


def prompt_line(c: Column) -> Column:
    """Angle brackets to blanks, one line; null becomes empty."""
    return trim_edges(squeeze(F.translate(F.coalesce(c, F.lit("")), "<>", "  ")))


def prompt_html(c: Column, width: int) -> Column:
    return F.left(prompt_line(strip_tags(F.coalesce(c, F.lit("")))), F.lit(width))
