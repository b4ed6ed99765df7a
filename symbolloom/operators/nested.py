"""Deeply nested JSON documents to flat, linked tables (problem 4).

Structural indexing: quote, bracket and delimiter positions are found on whole byte arrays, strings by the
parity of quotes, nesting depth by prefix sums, each token's container by one sort by depth. Validity is
decided on the token arrays; spans of the wanted paths are then read off and emitted as rows that carry
the keys of all their parents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Categories of a strand, and kinds of members of a symbol.
CATEGORIES = ("functions", "methodmaps", "enumstructs", "constants", "defines", "enums", "typesets", "typedefs")
MEMBER_KINDS = ("methods", "properties", "fields", "entries", "types")
OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST, COLON, COMMA, STRING, SCALAR = range(8)
_STRUCTURE = np.full(256, 255, np.uint8)
for _kind, _char in enumerate(b"{}[]:,"):
    _STRUCTURE[_char] = _kind
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALAR = re.compile(rb"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null")


class Index:
    """Tokens of a JSON text: kind, start and end (exclusive), level, container (token number or -1), is_key.

    ``valid`` tells whether the text is one JSON value (RFC 8259) and nothing else.
    """

    def __init__(self, text: bytes) -> None:
        self.valid, self.text = False, text
        b = np.frombuffer(text, np.uint8)
        quote = b == 0x22
        back = np.flatnonzero(b == 0x5C)
        escaped = np.zeros(0, np.int64)
        if len(back):
            first = np.ones(len(back), bool)
            first[1:] = np.diff(back) > 1
            run = np.cumsum(first) - 1
            odd = (back - back[first][run]) % 2 == 0  # backslashes that escape what follows
            escaped = back[odd] + 1
            if len(escaped) and escaped[-1] >= len(b):
                return
            quote[escaped] = False
        marks = np.flatnonzero(quote)
        if len(marks) % 2:
            return
        inside = np.cumsum(quote, dtype=np.int32) % 2 > 0  # with the opening quote, without the closing one
        if len(escaped):
            u = escaped[b[escaped] == ord("u")]
            if not (inside[escaped].all() and _ESCAPES[b[escaped]].all()) or (len(u) and u[-1] + 4 >= len(b)) or not all(_HEX[b[u + i]].all() for i in range(1, 5)):
                return
        if (inside & (b < 0x20)).any():
            return
        outside = ~inside & ~quote
        structure = np.flatnonzero(outside & (_STRUCTURE[b] < 255))
        plain = outside & ~_BLANK[b]
        plain[structure] = False
        edge = np.diff(np.concatenate([[0], plain.view(np.int8), [0]]))
        s_start, s_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if any(not _SCALAR.fullmatch(x) for x in {text[i:j] for i, j in zip(s_start.tolist(), s_end.tolist(), strict=True)}):
            return
        start = np.concatenate([structure, marks[::2], s_start])
        end = np.concatenate([structure + 1, marks[1::2] + 1, s_end])
        kind = np.concatenate([_STRUCTURE[b[structure]], np.full(len(marks) // 2, STRING, np.uint8), np.full(len(s_start), SCALAR, np.uint8)])
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.kind = start, end, kind = start[order], end[order], kind[order]
        n = len(kind)
        if not n:
            return
        opens, closes = (kind == OPEN_OBJECT) | (kind == OPEN_LIST), (kind == CLOSE_OBJECT) | (kind == CLOSE_LIST)
        depth = np.cumsum(opens.astype(np.int32) - closes)
        if depth.min() < 0 or depth[-1]:
            return
        level = depth - opens  # of the container that holds the token; a closing bracket is in the one that it closes
        level[closes] += 1
        # one sort by level: each container's opening comes first, its content follows
        which = np.concatenate([np.flatnonzero(opens), np.arange(n)])
        at_level = np.concatenate([level[opens] + 1, level])
        starts = np.arange(len(which)) < opens.sum()
        order = np.lexsort((~starts, which, at_level))
        which, starts, at_level = which[order], starts[order], at_level[order]
        fill = np.maximum.accumulate(np.where(starts, np.arange(len(which)), -1))
        container = np.full(n, -1, np.int64)
        content = ~starts & (at_level > 0)
        container[which[content]] = which[fill[content]]
        kind_of = np.where(container >= 0, kind[container], 255)
        before = np.concatenate([[np.uint8(254)], kind[:-1]])
        in_object, in_list = kind_of == OPEN_OBJECT, kind_of == OPEN_LIST
        key = (kind == STRING) & in_object & ((before == OPEN_OBJECT) | (before == COMMA))
        after_key = np.concatenate([[False], key[:-1]])
        ended = ~after_key & ((before == STRING) | (before == SCALAR) | (before == CLOSE_OBJECT) | (before == CLOSE_LIST))
        value = ~closes & (kind != COLON) & (kind != COMMA) & ~key
        fine = np.ones(n, bool)
        fine &= (kind != COLON) | (after_key & in_object)
        fine &= (kind != COMMA) | (ended & (in_object | in_list))
        empty = (before == OPEN_OBJECT) | (before == OPEN_LIST)
        fine &= ~closes | (((kind == CLOSE_OBJECT) == in_object) & (ended | (empty & (container == np.arange(n) - 1))))
        fine &= ~value | np.where(in_object, before == COLON, np.where(in_list, (before == OPEN_LIST) | (before == COMMA), np.arange(n) == 0))
        self.valid = bool(fine.all()) and level[0] == 0
        self.container, self.value = container, value
        self.close = np.full(n, -1, np.int64)
        self.close[container[closes]] = np.flatnonzero(closes)

    def children(self) -> dict[int, list[int]]:
        """Value tokens by container, in order."""
        values = np.flatnonzero(self.value)
        order = values[np.argsort(self.container[values], kind="stable")]
        owner = self.container[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        return {int(self.container[g[0]]): g.tolist() for g in np.split(order, cuts)} if len(order) else {}

    def key(self, token: int) -> str:
        """The key of a value token in an object."""
        raw = self.text[self.start[token - 2] + 1 : self.end[token - 2] - 1]
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8")

    def span(self, token: int) -> str:
        """The JSON text of a value token."""
        last = self.close[token] if self.kind[token] in (OPEN_OBJECT, OPEN_LIST) else token
        return self.text[self.start[token] : self.end[last]].decode("utf-8")


Row = tuple[str, str, str, str, str, str, str, int, int]


def records(index: Index) -> Iterator[Row]:
    """(level, strand, category, symbol, member_kind, member, item_kind, ord, token) of the document's records."""
    below, kinds = index.children(), index.kind

    def fields(token: int) -> dict[str, int]:
        """Fields of an object; of a key that occurs twice the last holds; {} for anything else."""
        return {index.key(t): t for t in below.get(token, ())} if kinds[token] == OPEN_OBJECT else {}

    def items(path: tuple[str, ...], kind: str, token: int | None) -> Iterator[Row]:
        if token is not None and kinds[token] == OPEN_LIST:
            for i, t in enumerate(below.get(token, ())):
                yield "item", *path, kind, i, t

    def record(path: tuple[str, ...], own: dict[str, int], callable_: bool) -> Iterator[Row]:
        if "docs" in own:
            yield from items(path, "tag", fields(own["docs"]).get("tags"))
        if callable_:
            yield from items(path, "argument", own.get("arguments"))
        if "parsedSignature" in own:
            yield from items(path, "argument", fields(own["parsedSignature"]).get("arguments"))

    root = fields(0)
    for strand, s in fields(root["strands"]).items() if "strands" in root else ():
        yield "strand", strand, "", "", "", "", "", -1, s
        for category, c in fields(s).items():
            if category not in CATEGORIES:
                continue
            for symbol, y in fields(c).items():
                path, own = (strand, category, symbol, "", ""), fields(y)
                yield "symbol", *path, "", -1, y
                yield from record(path, own, category == "functions")
                for kind in MEMBER_KINDS:
                    for member, m in fields(own[kind]).items() if kind in own else ():
                        inner = (strand, category, symbol, kind, member)
                        yield "member", *inner, "", -1, m
                        yield from record(inner, fields(m), kind == "methods")


def flatten(files: DataFrame, id_col: str = "file_id", body_col: str = "body", levels: tuple[str, ...] = ("strand", "symbol", "member", "item"), with_text: bool = True) -> DataFrame:
    """Linked rows of nested documents: id_col, level, strand, category, symbol, member_kind, member, item_kind, ord, json.

    Each row names its parents by their keys; members of a symbol itself have ''. Elements are tags of any
    symbol's or member's docs, and arguments of functions, methods and parsed signatures; ord counts from 0
    within its list (else -1). Bodies that are null, blank or not valid JSON give nothing; fields that are
    absent, null or of another type have no records; unknown keys are passed over. json is the record's
    text. No shuffle: every document is indexed where it is read.
    """
    id_type = files.schema[id_col].dataType.simpleString()
    names = [id_col, "level", "strand", "category", "symbol", "member_kind", "member", "item_kind", "ord"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids: list[int] = []
            for i, body in enumerate(batch.column(1)):
                if not body.is_valid:
                    continue
                index = Index(body.as_py().encode("utf-8"))
                if not index.valid:
                    continue
                found = [r for r in records(index) if r[0] in levels]
                ids += [i] * len(found)
                rows += [(*r[:-1], index.span(r[-1])) for r in found] if with_text else [r[:-1] for r in found]
                if len(rows) > 20_000:
                    yield emit(batch, ids, rows)
                    rows, ids = [], []
            if rows:
                yield emit(batch, ids, rows)

    def emit(batch: pa.RecordBatch, ids: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64() if n == "ord" else pa.string()) for n, c in zip([*names[1:], "json"], columns, strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *arrays], names=names + ["json"] * with_text)

    schema = f"`{id_col}` {id_type}, level string, strand string, category string, symbol string, member_kind string, member string, item_kind string, ord bigint" + ", json string" * with_text
    return files.select(id_col, body_col).mapInArrow(scan, schema)
