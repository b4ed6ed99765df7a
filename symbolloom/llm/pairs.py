"""Functions paired with the text of the comment that documents them (problem 5).

Comment spans and function spans are found independently in each valid SourcePawn file. An as-of interval
join then attaches to each function the nearest comment: one that ends on the line before its first line,
or else one that starts on that line after the code; anything else between them rejects it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolloom.llm import syntax
from symbolloom.parser import lexer

LEAST_WORDS = 5
_BRACES = re.compile(r"[{}]")
_PARENS = re.compile(r"[()]")
_BRACKETS = re.compile(r"[(){}]")
_BODY = re.compile(r"[ /#\n]*\{")
_STATEMENT_END = re.compile(r"[;\n]")
_GAP = "[ /#\n]*"
#: A declaration's head up to its parameter list: specifiers, result type or tag, name.
_HEAD = re.compile(rf"(?:[uvkbwa]{_GAP})*(?:[nt](?:{_GAP}\[{_GAP}\])*{_GAP}(?::{_GAP})?)?(?:j?(n)|O{_GAP}[-o<>&=jI]){_GAP}\(")
_OWNER = re.compile(rf"(?:m|e{_GAP}r){_GAP}(n)[^{{}};]*$")
#: What may not stand before a function's head: it would make the head part of an expression or another declaration.
_NOT_BEFORE = frozenset("=,(.[o<>&-?:AfemypYGUgIjJzNR")
_WORD = regex.compile(r"\p{L}+")
_PIECE = regex.compile(r"\p{Lu}?\p{Ll}+|\p{L}")
_TAG = regex.compile(r"^[ \t]*@(\w+)[ \t]*(.*)$")


def brief_of(comment: str) -> str:
    """The text before the first @ tag that starts a line, or, if there is none, that of @brief; without marks."""
    if comment.startswith("//"):
        lines = [re.sub(r"^/{2,}[!<]*", "", comment)]
    else:
        inner = re.sub(r"\**/$", "", re.sub(r"^/\*+[!<]*", "", comment))
        lines = [re.sub(r"^[ \t]*\*+(?!\*)", "", line) for line in re.split(r"\r\n|\r|\n", inner)]
    before: list[str] = []
    tagged: list[str] = []
    tag = None
    for line in lines:
        if m := _TAG.match(line):
            tag = m[1].lower()
            line = m[2]
        if tag is None:
            before.append(line)
        elif tag == "brief":
            tagged.append(line)
    text = "\n".join(before)
    return text if text.strip() else "\n".join(tagged)


def own_words(brief: str, bare_name: str) -> int:
    """Words of the brief that are not pieces of the function's name."""
    pieces = {p.lower() for p in _PIECE.findall(bare_name)}
    return sum(w.lower() not in pieces for w in _WORD.findall(brief))


def functions(tokens: list[str], kinds: str) -> list[tuple[int, str, str]]:
    """(first token, bare name, full name) of every function and method of a valid file."""
    found: list[tuple[int, str, str]] = []
    spans, depth, start = [], 0, 0
    for m in _BRACES.finditer(kinds):
        if m[0] == "{":
            if not depth:
                start = m.start()
            depth += 1
        else:
            depth -= 1
            if not depth:
                spans.append((start, m.start()))
    parts, at = [], 0
    for a, b in spans:
        parts += [kinds[at : a + 1], " " * (b - a - 1)]
        owner = _OWNER.search(kinds, at, a)
        at = b
        if owner:
            name = tokens[owner.start(1)]
            inner, depth, cut = list(kinds[a + 1 : b]), 0, 0
            for m in _BRACES.finditer(kinds, a + 1, b):
                if m[0] == "{":
                    if not depth:
                        cut = m.start()
                    depth += 1
                else:
                    depth -= 1
                    if not depth:
                        inner[cut - a : m.start() - a - 1] = " " * (m.start() - cut - 1)
            found += [(i, n, f"{name}.{n}") for i, n in _heads(tokens, "".join(inner), a + 1)]
    parts.append(kinds[at:])
    found += [(i, n, n) for i, n in _heads(tokens, "".join(parts), 0)]
    return sorted(found)


def _heads(tokens: list[str], flat: str, offset: int) -> Iterator[tuple[int, str]]:
    """Functions declared at one level, of which deeper braces are blank."""
    inner, depth, cut = [], 0, 0
    at = 0
    for m in _PARENS.finditer(flat):  # blanks within parentheses
        if m[0] == "(":
            if not depth:
                cut = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                inner += [flat[at : cut + 1], " " * (m.start() - cut - 1)]
                at = m.start()
    flat = "".join([*inner, flat[at:]])
    for m in _HEAD.finditer(flat):
        at, soft = m.start() - 1, False
        while at >= 0 and flat[at] in " /#\n":
            soft |= flat[at] == "\n"
            at -= 1
        last = flat[at] if at >= 0 else ""
        if last in _NOT_BEFORE or last in ("n", "t", "0", "s") and not soft:
            continue
        name = m.start(1) if m.start(1) >= 0 else m.end() - 2
        yield offset + m.start(), tokens[offset + name] if m.start(1) >= 0 else "operator" + tokens[offset + name].strip()


def _ends(kinds: str, heads: list[int]) -> list[int]:
    """Last token of the function that begins at each token of ``heads``: the end of its body, or of its line or statement."""
    closes, stack = {}, []
    for m in _BRACKETS.finditer(kinds):
        if m[0] in "({":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    out = []
    for h in heads:
        at = closes[kinds.index("(", h)] + 1
        body = _BODY.match(kinds, at)
        if body:
            out.append(closes[body.end() - 1])
        else:
            end = _STATEMENT_END.search(kinds, at)
            out.append(end.start() - (kinds[end.start()] != ";") if end else len(kinds) - 1)
    return out


def documented(content: bytes) -> list[tuple[str, str, str, int, int]]:
    """(full name, bare name, comment, start, end) of the functions of one file that have a comment; [] if it isn't valid.

    start and end are the byte span of the function, from its first specifier to the end of its body or declaration.
    """
    tokens, kinds, valid = syntax.read_sourcepawn(content)
    if not valid or "(" not in kinds:
        return []
    begin = np.array(lexer.starts(tokens))
    kind = np.frombuffer(kinds.encode("latin-1"), np.uint8)
    text = np.frombuffer(content, np.uint8)
    newlines = np.flatnonzero(text == 10)
    line_of = lambda at: np.searchsorted(newlines, at)
    comments = np.flatnonzero(kind == ord("/"))
    heads = functions(tokens, kinds)
    if not len(comments) or not heads:
        return []
    c_start, c_end = begin[comments], begin[comments + 1] - 1
    c_first, c_last = line_of(c_start), line_of(c_end)
    line_start = np.concatenate([[0], newlines + 1])
    solid = np.flatnonzero((kind != ord(" ")) & (kind != ord("\n")))  # tokens that are not blank
    before = np.searchsorted(solid, comments) - 1  # the last solid token before the comment
    last_line = np.where(before >= 0, line_of(begin[solid[np.maximum(before, 0)] + 1] - 1), -1)
    alone = (last_line < c_first) & (c_start > 0)
    # interval join: comments by their last line, of one line the first
    lead = np.flatnonzero(alone)
    f_line = line_of(begin[[h[0] for h in heads]])
    hit = np.searchsorted(c_last[lead], f_line - 1, side="left")
    code = np.flatnonzero((kind != ord(" ")) & (kind != ord("\n")) & (kind != ord("/")))
    out = []
    for (first, bare, full), line, h in zip(heads, f_line.tolist(), hit.tolist(), strict=True):
        chosen = -1
        if h < len(lead) and c_last[lead[h]] == line - 1:
            chosen = lead[h]
        else:
            end = line_start[line + 1] if line + 1 < len(line_start) else len(content)
            k = np.searchsorted(begin[code], end) - 1  # last code that starts on the line
            j = int(np.searchsorted(c_start, begin[code[k]] if k >= 0 else 0))
            if j < len(comments) and c_first[j] == line and c_start[j] > 0:
                chosen = j
        if chosen >= 0:
            out.append((first, full, bare, content[c_start[chosen] : c_end[chosen] + 1].decode("utf-8", "replace")))
    ends = _ends(kinds, [r[0] for r in out])
    return [(*rest, int(begin[first]), int(begin[end + 1])) for (first, *rest), end in zip(out, ends, strict=True)]


def pairs(files: DataFrame, id_col: str = "blob_id", path_col: str = "path", content_col: str = "content", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id_col, func_name, comment, start, end, code): documented functions and methods of the valid SourcePawn files.

    Functions whose comment is missing, or whose brief has fewer than ``least_words`` words of its own, are
    left out; so are files of other languages, files that are not valid, and null content. A comment that
    starts at byte 0 documents nothing. Each function is a row, also where several have one name (a forward and
    its body, or two sides of a condition). start and end are byte offsets, code is the text between. Bytes that are not UTF-8 stand for no letters. Each file is handled where it is read.
    """
    id_type = files.schema[id_col].dataType.simpleString()
    names = [id_col, "func_name", "comment", "start", "end", "code"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, content in enumerate(batch.column(1)):
                content = content.as_py()
                for full, bare, comment, start, end in documented(content):
                    if own_words(brief_of(comment), bare) >= least_words:
                        rows.append(i)
                        found.append((full, comment, start, end, content[start:end].decode("utf-8", "replace")))
            if rows:
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, zip(*found, strict=True), types)], names=names)

    source = files.where((syntax.language_of(F.col(path_col)) == "sourcepawn") & F.col(content_col).isNotNull()).select(id_col, content_col)
    return source.mapInArrow(scan, f"`{id_col}` {id_type}, func_name string, comment string, start bigint, end bigint, code string")
