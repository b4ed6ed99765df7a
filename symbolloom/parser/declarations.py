"""Declarations of SourcePawn include files as symbol rows: a table function from text to flat records.

A tolerant reader of declarations only: bodies are skipped by brackets. It emits functions, method maps,
enum structs, enums, constants (entries of unnamed enums), defines, typesets and typedefs, with their
members, arguments and the byte span of the comment that documents each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from symbolloom.parser import expressions, lexer

_ARG = "STRUCT<type STRING, name STRING, decl STRING, `default` STRING>"
_DOC = "ref_line BIGINT, doc_start BIGINT, doc_end BIGINT"
MEMBER = f"STRUCT<kind STRING, name STRING, type STRING, value STRING, fn_kind STRING, getter BOOLEAN, setter BOOLEAN, arguments ARRAY<{_ARG}>, {_DOC}>"
SYMBOL = f"category STRING, name STRING, kind STRING, return_type STRING, type STRING, parent STRING, value STRING, arguments ARRAY<{_ARG}>, members ARRAY<{MEMBER}>, {_DOC}, doc_text STRING, decl_ord BIGINT, error STRING"
_SPECIFIERS = frozenset("uvkbw")
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Reader:
    def __init__(self, content: bytes) -> None:
        self.tokens, kinds = lexer.tokenize(content.decode("latin-1"))
        self.begin = lexer.starts(self.tokens)
        self.index = [i for i, k in enumerate(kinds) if k not in " \n/#"]
        self.kinds = [kinds[i] for i in self.index] + ["$"]
        self.line, line = [], 1
        for t in self.tokens:
            self.line.append(line)
            line += t.count("\n")
        self.by_end: dict[int, tuple[int, int]] = {}
        self.by_start: dict[int, tuple[int, int]] = {}
        for i, k in enumerate(kinds):
            if k == "/":
                span = (self.begin[i], self.begin[i + 1])
                self.by_end.setdefault(self.line[i] + self.tokens[i].count("\n"), span)
                self.by_start.setdefault(self.line[i], span)
        self.raw = kinds
        self.at = 0

    @property
    def kind(self) -> str:
        return self.kinds[self.at]

    def ahead(self, n: int = 1) -> str:
        return self.kinds[min(self.at + n, len(self.kinds) - 1)]

    def text(self, at: int | None = None) -> str:
        i = self.at if at is None else at
        return self.tokens[self.index[i]].encode("latin-1").decode("utf-8", "replace") if i < len(self.index) else ""

    def take(self) -> str:
        out = self.text()
        self.at += self.at < len(self.index)
        return out

    def doc(self, at: int) -> dict[str, int]:
        """Line and comment span of the declaration that begins with token ``at``; zeros without a comment."""
        line = self.line[self.index[at]]
        span = self.by_end.get(line - 1) or self.by_start.get(line)
        if not span:
            return {"ref_line": 0, "doc_start": 0, "doc_end": 0}
        return {"ref_line": line, "doc_start": span[0], "doc_end": span[1]}

    def skip_group(self) -> tuple[int, int]:
        """Passes a bracket group; gives the token range inside it."""
        want, first = [_CLOSE[self.kind]], self.at + 1
        self.at += 1
        while want and self.kind != "$":
            if self.kind in _CLOSE:
                want.append(_CLOSE[self.kind])
            elif self.kind == want[-1]:
                want.pop()
            self.at += 1
        return first, self.at - 1

    def render(self, first: int, end: int) -> str:
        """Source text of a token range, with one space where the source has space."""
        out, last = "", None
        for j in range(first, end):
            if last is not None and self.index[j] != last + 1:
                out += " "
            out += self.text(j)
            last = self.index[j]
        return out

    def expression(self, first: int, end: int) -> str:
        """The expression of a token range in one spelling."""
        return expressions.render([self.text(j) for j in range(first, end)], "".join(self.kinds[first:end]))

    def pieces(self, first: int, end: int) -> Iterator[tuple[int, int]]:
        """Token ranges between top-level commas."""
        depth, start = 0, first
        for j in range(first, end):
            k = self.kinds[j]
            depth += (k in _CLOSE) - (k in ")]}")
            if k == "," and not depth:
                yield start, j
                start = j + 1
        if start < end:
            yield start, end

    def arguments(self, first: int, end: int) -> list[dict[str, Any]]:
        out = []
        for a, b in self.pieces(first, end):
            equal = next((j for j in range(a, b) if self.kinds[j] == "="), b)
            default = self.expression(equal + 1, b) if equal < b else None
            decl = self.render(a, equal).strip()
            names = [j for j in range(a, equal) if self.kinds[j] in "nt"]
            dots = any(self.kinds[j] == "E" for j in range(a, equal))
            if dots or not names:
                out.append({"type": self.render(a, next((j for j in range(a, equal) if self.kinds[j] == "E"), equal)).strip().rstrip(":") or "any", "name": "...", "decl": decl, "default": default})
                continue
            name_at = names[-1]
            kind = self.render(a, name_at).strip().rstrip(":").strip()
            out.append({"type": kind + self.render(name_at + 1, equal).strip() or "int", "name": self.text(name_at), "decl": decl, "default": default})
        return out

    def until_end(self) -> None:
        """Passes the rest of a declaration: a body, or everything up to a semicolon or the line's end."""
        if self.at and self.kind not in "${=;" and self.line[self.index[self.at]] > self.line[self.index[self.at - 1]]:
            return
        while self.kind != "$":
            if self.kind == "{":
                self.skip_group()
                if self.kind == ";":
                    self.at += 1
                return
            if self.kind in "([":
                self.skip_group()
                continue
            k, line = self.kind, self.line[self.index[self.at]]
            self.at += 1
            if k == ";":
                return
            if self.kind != "$" and self.line[self.index[self.at]] > line and self.kind not in "{=.?:,)" and k not in "=,(":
                return


def _function(r: _Reader, native_ok: bool = True) -> dict[str, Any] | None:
    """A function or method head at the reader, or None (nothing is read then)."""
    start, specs = r.at, []
    while r.kind in _SPECIFIERS or r.kind == "a":
        specs.append(r.take())
    kind = ""
    head = r.at
    while r.kind in "nt" and r.ahead() in "nt[:j":
        r.take()
        while r.kind == "[":
            r.skip_group()
        if r.kind == ":":
            r.take()
    kind = r.render(head, r.at).rstrip(":").strip()
    if r.kind == "j":
        r.take()
    if r.kind not in "nt" or r.ahead() != "(":
        r.at = start
        return None
    name = r.take()
    inside = r.skip_group()
    out = {"name": name, "kind": " ".join(s for s in specs if s != "const"), "return_type": kind, "arguments": r.arguments(*inside), **r.doc(start)}
    r.until_end()
    return out


def _member(kind: str, f: dict[str, Any]) -> dict[str, Any]:
    return {"kind": kind, "name": f["name"], "type": f.get("return_type"), "value": None, "fn_kind": "native" if "native" in f.get("kind", "") else "stock", "getter": None, "setter": None, "arguments": f.get("arguments"), "ref_line": f["ref_line"], "doc_start": f["doc_start"], "doc_end": f["doc_end"]}


def _plain(kind: str, name: str, doc: dict[str, int], **kw: Any) -> dict[str, Any]:
    return {"kind": kind, "name": name, "type": None, "value": None, "fn_kind": None, "getter": None, "setter": None, "arguments": None, **kw, **doc}


def _record_members(r: _Reader, end: int) -> list[dict[str, Any]]:
    """Methods, properties and fields of a method map or enum struct whose content ends before token ``end``."""
    out = []
    while r.at < end:
        start = r.at
        if r.kind == "p":
            r.take()
            first = r.at
            while r.ahead() in "nt[]:" and r.kind != "$":
                r.take()
            kind, name, doc = r.render(first, r.at).rstrip(":").strip(), r.take(), r.doc(start)
            getter = setter = False
            if r.kind == "{":
                a, b = r.skip_group()
                names = [r.text(j) for j in range(a, b) if r.kinds[j] == "n" and r.kinds[j + 1] == "("]
                getter, setter = "get" in names, "set" in names
            out.append(_plain("property", name, doc, type=kind, getter=getter, setter=setter))
        elif f := _function(r):
            out.append(_member("method", f))
        elif r.kind in "ant":
            first = r.at
            while r.kind in "nta[]" and r.ahead() not in ";$" and not (r.kind in "nt" and r.ahead() == "[" and r.ahead(2) != "]"):
                r.take()
            out.append(_plain("field", r.text(), r.doc(start), type=r.render(first, r.at).strip()))
            r.take()
            r.until_end()
        else:
            r.take()
    r.at = end
    return out


def parse(content: bytes) -> Iterator[dict[str, Any]]:
    """Symbols of one file, in order of declaration."""
    r = _Reader(content)
    ordinal = 0

    def symbol(category: str, name: str, doc: dict[str, int], **kw: Any) -> dict[str, Any]:
        nonlocal ordinal
        ordinal += 1
        return {"category": category, "name": name, "kind": None, "return_type": None, "type": None, "parent": None, "value": None, "arguments": None, "members": None, "error": None, **doc, **kw, "decl_ord": ordinal - 1}

    for i, k in enumerate(r.raw):
        if k == "#" and r.tokens[i].lstrip("# \t").startswith("define"):
            parts = r.tokens[i].encode("latin-1").decode("utf-8", "replace").lstrip("# \t")[6:].split(None, 1)
            if parts:
                line = r.line[i]
                span = r.by_end.get(line - 1) or r.by_start.get(line)
                yield symbol("defines", parts[0].split("(")[0], {"ref_line": line if span else 0, "doc_start": span[0] if span else 0, "doc_end": span[1] if span else 0}, value=parts[1].split("//")[0].strip() if len(parts) > 1 else "")
    while r.kind != "$":
        start, k = r.at, r.kind
        if k == "e" and r.ahead() == "r" or k == "m":
            r.at += 2 if k == "e" else 1
            name, parent = r.take(), None
            while r.kind not in "{$;":
                if r.kind == "<":
                    r.take()
                    parent = r.text()
                r.take()
            if r.kind == "{":
                save = r.at
                a, b = r.skip_group()
                after, r.at = r.at, a
                members = _record_members(r, b)
                r.at = max(after, save + 1)
                yield symbol("enumstructs" if k == "e" else "methodmaps", name, r.doc(start), parent=parent, members=members)
        elif k == "e":
            r.take()
            name = r.take() if r.kind in "nt" else None
            while r.kind not in "{$;":
                r.take()
            if r.kind == "{":
                a, b = r.skip_group()
                entries = []
                for x, y in r.pieces(a, b):
                    at = x + 2 if r.kinds[x + 1 : x + 2] == [":"] else x
                    equal = next((j for j in range(x, y) if r.kinds[j] == "="), y)
                    entries.append(_plain("entry", r.text(at), r.doc(x), value=r.expression(equal + 1, y) if equal < y else None))
                if name is None:
                    yield from (symbol("constants", e["name"], {n: e[n] for n in ("ref_line", "doc_start", "doc_end")}) for e in entries)
                else:
                    yield symbol("enums", name, r.doc(start), members=entries)
        elif k == "y":
            r.take()
            name = r.take()
            r.take()
            first = r.at
            while r.kind not in "($;":
                r.take()
            if r.kind == "(":
                r.skip_group()
            yield symbol("typedefs", name, r.doc(start), type=r.render(first, r.at))
            r.until_end() if r.kind == ";" else None
        elif k == "Y":
            r.take()
            name = r.take()
            if r.kind == "{":
                a, b = r.skip_group()
                after, r.at, types = r.at, a, []
                while r.at < b:
                    if r.kind == "f":
                        first = r.at
                        while r.kind not in "($;}":
                            r.take()
                        if r.kind == "(":
                            r.skip_group()
                        text = r.render(first, r.at)
                        types.append(_plain("type", text, r.doc(first), type=text))
                    else:
                        r.take()
                r.at = after
                yield symbol("typesets", name, r.doc(start), members=types)
        elif f := _function(r):
            kw = {n: f[n] for n in ("kind", "return_type", "arguments")}
            yield symbol("functions", f["name"], {n: f[n] for n in ("ref_line", "doc_start", "doc_end")}, **kw)
        elif k in "{([":
            r.skip_group()
        elif k in "ukba" or k in "nt":
            r.take()
            r.until_end()
        else:
            r.take()


def _doc_text(content: bytes, start: int, end: int) -> str | None:
    """The comment's text; None without one, at byte 0, and for bytes that are no UTF-8."""
    if not start or not end:
        return None
    try:
        return content[start:end].decode("utf-8")
    except UnicodeDecodeError:
        return None


def _readable(content: bytes) -> None:
    """Raises ValueError for contents that can't be a source text: with a zero byte, or not in UTF-8."""
    if b"\0" in content:
        raise ValueError("zero byte")
    content.decode("utf-8")


def parse_files(files: DataFrame, keys: list[str], content_col: str = "content", valid: Callable[[bytes], bool] | None = None) -> DataFrame:
    """``keys`` and the symbol columns of every declaration in binary contents; null content gives nothing.

    A file that can't be read, among them those with a zero byte or bytes that are no UTF-8, gives one row with
    an error and no symbol; so do files that ``valid`` (a function of a content, such as a syntax check) refuses.
    Files are parsed where they are read.
    """
    arrow = to_arrow_schema(StructType.fromDDL(SYMBOL))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, content in enumerate(batch.column(batch.num_columns - 1)):
                if content.is_valid:
                    text = content.as_py()
                    try:
                        _readable(text)
                        if valid and not valid(text):
                            raise SyntaxError
                        symbols = [s | {"doc_text": _doc_text(text, s["doc_start"], s["doc_end"])} for s in parse(text)]
                    except (IndexError, RecursionError, ValueError, SyntaxError) as e:
                        symbols = [{"error": type(e).__name__}]
                    found += symbols
                    rows += [i] * len(symbols)
            if rows:
                take, out = pa.array(rows), pa.RecordBatch.from_pylist(found, schema=arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), *out.columns], names=[*keys, *arrow.names])

    schema = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, content_col).mapInArrow(scan, f"{schema}, {SYMBOL}")
