"""Documentation texts: byte slices and parsed comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_slice(content: Column, start: Column, end: Column) -> Column:
    """Text of the bytes [start, end) of binary content; null if start or end is 0 or the cut is not UTF-8."""
    piece = F.substring(content, start.cast("int") + 1, (end - start).cast("int"))
    return F.when((start != 0) & (end != 0), F.try_validate_utf8(piece.cast("string")))


def parse_comment(text: Column) -> Column:
    """STRUCT<brief, tags ARRAY<STRUCT<tag, text>>> of a comment: the text before the first line that begins with @, and one tag per such line.

    Comment marks are taken off; lines of one piece are joined by blanks. Null stays null.
    """
    bare = F.regexp_replace(text, r"^\s*/\*+[!<]*|\**\*/\s*$|^\s*///*[!<]*", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?m)^[ \t]*\*+[ \t]?", ""), r"\r", ""))
    pieces = F.split(F.concat(F.lit("\n"), bare), r"\n[ \t]*@")
    flat = lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))
    tag = lambda p: F.struct(F.regexp_extract(p, r"^(\S*)", 1).alias("tag"), flat(F.regexp_replace(p, r"^\S*", "")).alias("text"))
    return F.when(text.isNotNull(), F.struct(flat(F.get(pieces, 0)).alias("brief"), F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), tag).alias("tags")))


def page_title(html: Column) -> Column:
    """Content of the first title element; an extension, as pages themselves pass through unchanged."""
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1), F.lit(""))
