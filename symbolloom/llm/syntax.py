"""Source files that are not valid in the language of their extension (problem 6).

Each file gets the cost of a syntax repair by error-correcting chart parsing over bracketed spans
(grammar.py); nonzero cost flags it, and where the edits lie tells truncation, merge conflict and a wrong
language apart. For SourcePawn the chart's parse without edits decides. Of the other languages, which have
rules that no such chart holds, a strict reader has the last word: the structural index for JSON, and their own
parsers for Python and TOML, unless these give up at a limit of their own; then the chart decides.
"""

from __future__ import annotations

import re
import sys
import tomllib
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolloom.llm import python_toml, sourcepawn
from symbolloom.llm.grammar import Language
from symbolloom.operators.nested import Index
from symbolloom.parser import lexer

#: The language of each extension.
LANGUAGES = {"inc": "sourcepawn", "sp": "sourcepawn", "json": "json", "toml": "toml", "py": "python"}
_MARKER = re.compile(rb"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$)")
_CONDITION = re.compile(r"#[ \t]*(if|else|elseif|endif)\b")

Repair = tuple[int, int, str]  # edits, offset of the first (-1 for none), kind


class Json(Language):
    """JSON over kinds: s string, 0 number or word, and the brackets and delimiters themselves."""

    _V = "(?:[s0]|[āŁ])"
    brackets = {"{": (0x100, ("object",)), "[": (0x140, ("list",)), "(": (0x180, ("none",))}
    patterns = {"object": f"(?:s:{_V}(?:,s:{_V})*)?", "list": f"(?:{_V}(?:,{_V})*)?", "none": "!", "file": _V}
    top = "file"
    TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z_.])|(?:true|false|null)\b|[ \t\r\n]+|[A-Za-z_]+|[\s\S]')

    def kinds(self, tokens: list[str]) -> str:
        return "".join("s" if t[0] == '"' and len(t) > 1 else " " if t[0] in " \t\r\n" else t if t in "{}[]:,()" else "0" if t[0] in "-0123456789" and t != "-" or t in ("true", "false", "null") else "!" for t in tokens)


@lru_cache(maxsize=1)
def _json() -> Json:
    return Json()


def _kind(content: bytes, places: list[int], edits: int, size: int, still_open: bool) -> str:
    """What the places of the edits (byte offsets, in order) tell.

    conflict: an edit lies on a line with a conflict marker. truncation: all edits lie at the end (in the last
    twentieth or the last two lines), and brackets or a token were open there. mismatch: more than a twentieth
    of the tokens had to be edited. Else error.
    """
    lines = [(m.start(), content.find(b"\n", m.start())) for m in _MARKER.finditer(content)]
    if any(a <= p and (p <= b or b < 0) for p in places for a, b in lines):
        return "conflict"
    end = len(content.rstrip())
    tail = min(content.rfind(b"\n", 0, max(content.rfind(b"\n", 0, end), 0)) + 1, end - end // 20)
    if still_open and places and (places[0] >= tail or edits <= 3) and places[-1] >= tail:
        return "truncation"
    return "mismatch" if edits * 20 > size else "error"


def _repair(language: Language, kinds: str, at: list[int], begin: list[int], content: bytes, least: Repair | None = None) -> Repair | None:
    """The repair by the chart; ``at``: the token of each kind, ``begin``: offsets of the tokens. None if nothing needs one.

    ``least`` (edits, place, kind) is what a strict reader has found, for files in which the chart finds nothing.
    """
    edits, places, still_open = language.repair(kinds)
    if not edits:
        return least
    offset = lambda p: begin[at[p]] if p < len(at) and at[p] < len(begin) else len(content)
    where = sorted(map(offset, places))
    cut_token = bool(where) and content[where[0] : where[0] + 1] in (b'"', b"'", b"/") and where[0] >= 0.9 * len(content)
    return edits, where[0], _kind(content, where, edits, len(kinds), still_open or cut_token or content.endswith(b"\0"))


def conditions_match(tokens: list[str], kinds: str) -> bool:
    """Whether #if, #else and #endif lines pair up."""
    depth, i = 0, kinds.find(lexer.LINE)
    while i >= 0:
        if m := _CONDITION.match(tokens[i]):
            depth += (m[1] == "if") - (m[1] == "endif")
            if depth < 0 or (not depth and m[1] in ("else", "elseif")):
                return False
        i = kinds.find(lexer.LINE, i + 1)
    return depth == 0


def read_sourcepawn(content: bytes) -> tuple[list[str], str, bool]:
    """(tokens, kinds, whether the chart has a parse without edits)."""
    tokens, kinds = lexer.tokenize(content.decode("latin-1"))
    language = sourcepawn.language()
    return tokens, kinds, conditions_match(tokens, kinds) and language.accepts(language.code(kinds))


def is_sourcepawn(content: bytes) -> bool:
    """Whether a content is valid SourcePawn; for readers of declarations that take such a check."""
    return read_sourcepawn(content)[2]


def check_sourcepawn(content: bytes) -> tuple[list[str], str, Repair | None]:
    """(tokens, kinds, repair or None if valid)."""
    tokens, kinds, fine = read_sourcepawn(content)
    if fine:
        return tokens, kinds, None
    language, paired = sourcepawn.language(), conditions_match(tokens, kinds)
    at = [i for i, c in enumerate(kinds) if c not in " /#"]
    repair = _repair(language, language.code(kinds), at, lexer.starts(tokens), content, (0, len(content), "error"))
    return tokens, kinds, (repair[0] + (not paired), repair[1], repair[2])


def _python_error(content: bytes) -> int | None:
    """Offset of the line at which Python's parser stops, -1 where it gives up at a limit of its own, None for a valid file."""
    if b"\0" in content:
        return content.index(b"\0")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(content, "file", "exec", dont_inherit=True)
    except SyntaxError as e:
        if str(e.msg).startswith("too many"):
            return -1
        if e.lineno is None:
            return _undecoded(content)
        return sum(map(len, content.splitlines(keepends=True)[: e.lineno - 1]))
    except (RecursionError, MemoryError, OverflowError):
        return -1
    except ValueError:
        return 0
    return None


def _undecoded(content: bytes) -> int:
    try:
        content.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return 0


def _toml_error(content: bytes) -> int | None:
    """As _python_error, for TOML."""
    digits = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)  # integers of any length are valid
    try:
        text = content.decode("utf-8")
        tomllib.loads(text)
    except UnicodeDecodeError as e:
        return e.start
    except RecursionError:
        return -1
    except ValueError as e:
        m = re.search(r"line (\d+)", str(e))
        return sum(len(x) + 1 for x in content.split(b"\n")[: int(m[1]) - 1]) if m else len(content)
    finally:
        sys.set_int_max_str_digits(digits)
    return None


def _check_with(language: python_toml.Python | python_toml.Toml, stops: int | None, content: bytes) -> Repair | None:
    if stops is None:
        return None
    text = content.decode("latin-1")  # offsets are bytes; a token outside of ASCII is a name as good as any
    if not text.isascii():
        text = "".join(c if c.isascii() else "_" for c in text)
    tokens = language.tokenize(text)
    kinds, at = language.kinds(tokens)
    least = None if stops < 0 else (1, min(stops, len(content)), _kind(content, [min(stops, len(content))], 1, 20, False))
    return _repair(language, kinds, at, lexer.starts(tokens), content, least)


def check_json(content: bytes) -> Repair | None:
    bad = None
    try:
        content.decode("utf-8")
        if Index(content).valid:
            return None
    except UnicodeDecodeError as e:
        bad = e.start
    tokens = Json.TOKEN.findall(content.decode("latin-1"))
    language = _json()
    kinds = language.kinds(tokens)
    at = [i for i, c in enumerate(kinds) if c != " "]
    return _repair(language, kinds.replace(" ", ""), at, lexer.starts(tokens), content, (1, len(content) if bad is None else bad, "error"))


def check(language: str, content: bytes) -> Repair | None:
    """The repair of a file, or None if it is valid."""
    if language == "sourcepawn":
        return check_sourcepawn(content)[2]
    if language == "json":
        return check_json(content)
    if language == "python":
        return _check_with(python_toml.python(), _python_error(content), content)
    return _check_with(python_toml.toml(), _toml_error(content), content)


def language_of(path: Column) -> Column:
    """Language by the extension, in any letter case; null for other or no extensions. Separators are / and \\."""
    extension = F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.([^.]*)$", 1))
    out = F.lit(None).cast("string")
    for e, language in LANGUAGES.items():
        out = F.when(extension == e, language).otherwise(out)
    return out


def repairs(files: DataFrame, id_col: str = "blob_id", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id_col, language, edits, first_edit, kind) of each file of a known language with content.

    edits is 0 for a valid file, else the cost of the repair found in tokens, without a bound. first_edit is a
    byte offset, -1 for valid files. Null content, null paths and unknown extensions give no row; an empty
    SourcePawn, Python or TOML file is valid, an empty JSON one is not. Whole contents are checked where
    they are read; rows repeat as the input's do.
    """
    id_type = files.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for language, content in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                out.append(check(language, content.as_py()) or (0, -1, "valid"))
            edits, first, kind = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits, pa.int32()), pa.array(first, pa.int64()), pa.array(kind, pa.string())], names=[id_col, "language", "edits", "first_edit", "kind"])

    known = files.select(F.col(id_col), language_of(F.col(path_col)).alias("language"), F.col(content_col)).where(f"language is not null and `{content_col}` is not null")
    return known.mapInArrow(scan, f"`{id_col}` {id_type}, language string, edits int, first_edit bigint, kind string")


def rates(files: DataFrame, repo_col: str = "repo", id_col: str = "blob_id", **kw) -> DataFrame:
    """(repo, language, files, invalid, rate): share of invalid files; a null repo is one group."""
    keyed = files.withColumn("__key", F.struct(F.col(id_col), F.col(repo_col)))
    found = repairs(keyed.drop(id_col, "language"), id_col="__key", **kw)
    groups = found.groupBy(F.col(f"__key.{repo_col}").alias("repo"), "language").agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("edits") > 0).cast("bigint")).alias("invalid"))
    return groups.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
