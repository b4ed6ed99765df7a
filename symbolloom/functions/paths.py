"""Paths of symbols and files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symbolloom.schemas import NORMAL


def element(identifier: Column, name: Column) -> Column:
    """``identifier.name``; null if either is."""
    return F.concat(identifier, F.lit("."), name)


def split_path(part: Column) -> Column:
    """(identifier, name): the first two pieces between dots; missing ones are null."""
    pieces = F.split(part, "[.]")
    return F.struct(F.get(pieces, 0).alias("identifier"), F.get(pieces, 1).alias("name"))


def normalize_identifier(identifier: Column) -> Column:
    """Identifiers of members become those of what they are; others stay."""
    out = identifier
    for k, v in NORMAL.items():
        out = F.when(identifier == k, v).otherwise(out)
    return out


def normalize_path(path: Column) -> Column:
    """Each part of an array of parts normalised; parts without a dot stay."""
    one = lambda p: F.when(F.contains(p, F.lit(".")), element(normalize_identifier(F.get(F.split(p, "[.]"), 0)), F.get(F.split(p, "[.]"), 1))).otherwise(p)
    return F.transform(path, one)


def file_stem(path: Column) -> Column:
    """Last path element without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob in which * crosses separators; a folder matches all below it."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/" else c
        i += 1
    return f"^{out}(/.*)?$"


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether any of the globs matches; no globs match everything."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(path, F.lit(glob_regex(p)))
    return out
