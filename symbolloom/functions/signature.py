"""Type signatures of callbacks as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symbolloom.schemas import ARGUMENTS


def parse_signature(text: Column) -> Column:
    """STRUCT<returnType, arguments> of ``function RETURN (TYPE NAME, ...)``; null for text without '(' or too short.

    Of an argument's words two are type and name; of more the first two are the type and the third the
    name; an argument of one word is dropped. decl keeps the argument's whole text.
    """
    rest = F.substring(text, F.lit(10), F.length(text))
    open_ = F.instr(rest, F.lit("("))
    inner = F.substring(rest, open_ + 1, F.length(rest) - open_ - 1)

    def one(a: Column) -> Column:
        w = F.split(a, " ")
        many = F.size(w) > 2
        kind = F.when(many, F.concat_ws(" ", F.slice(w, 1, 2))).otherwise(F.get(w, 0))
        return F.struct(kind.alias("type"), F.when(many, F.get(w, 2)).otherwise(F.get(w, 1)).alias("name"), a.alias("decl"), F.lit(None).cast("string").alias("default"))

    arguments = F.transform(F.filter(F.split(inner, ", "), lambda a: F.size(F.split(a, " ")) >= 2), one).cast(ARGUMENTS)
    return F.when((F.length(text) > 10) & (open_ > 0), F.struct(F.trim(F.substring(rest, F.lit(1), open_ - 1)).alias("returnType"), arguments.alias("arguments")))
