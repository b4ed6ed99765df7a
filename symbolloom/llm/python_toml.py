"""Syntax of Python 3 and TOML over token kinds, for repair costs.

The grammars hold what is context-free over bracketed spans; blocks of Python are spans between the marks <
and > that changes of indentation leave. Rules about names and places (a return outside a function, a key
given twice) are left to the languages' own parsers.
"""

from __future__ import annotations

import keyword
import re
from functools import lru_cache

from symbolloom.llm.grammar import Language

_STRING = r"(?i:[rbuf]|[rb]{2}|[rf]{2})?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_PY_TOKEN = re.compile(_STRING + r"|#[^\n]*|\\\r?\n|\r?\n|[ \t\f\r]+|(?:0[xXoObB][0-9a-fA-F_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[jJ]?)|\w+|\*\*=|//=|>>=|<<=|->|:=|\.\.\.|\*\*|//|>>|<<|[-+*/%@&|^]=|[=!<>]=|[\s\S]")
#: Kinds of Python's keywords and operators, plain letters or signs.
_PY_WORDS = {
    "if": "f", "elif": "e", "else": "l", "for": "F", "while": "H", "def": "d", "class": "c", "return": "R", "import": "I", "from": "J", "as": "m", "try": "t", "except": "x", "finally": "y", "with": "w", "lambda": "L",
    "yield": "Y", "await": "u", "async": "A", "raise": "Q", "del": "D", "pass": "P", "break": "P", "continue": "P", "global": "G", "nonlocal": "G", "assert": "T", "in": "i", "is": "q", "not": "!", "and": "o", "or": "o",
    "True": "0", "False": "0", "None": "0",
}
_PY_OPERATORS = {"*": "k", "**": "K", "-": "-", "+": "-", "~": "~", ":=": "W", "->": "g", "...": "0", "<": "o", ">": "o", "<=": "o", ">=": "o", "==": "o", "!=": "o", "//": "o", ">>": "o", "<<": "o", "/": "/", "%": "o", "&": "o", "|": "o", "^": "o", "@": "@"} | {c: c for c in "()[]{},:.=;"}
#: A line that begins with one of these is a new statement, even if a bracket seems to be open.
_PY_STARTS = frozenset("def class return import while try raise del pass break continue global nonlocal except finally elif assert".split())


_HEADS = frozenset("feltxyFHwdcA")
_LINES = ("simple", "if", "elif", "else", "loop", "try", "except", "finally", "other", "decorator")


class Python(Language):
    """Kinds: n name, s string, 0 number or constant, others as in the tables above. Logical lines are spans « », blocks spans < >.

    What follows a head's colon on its line is a block of one line.
    """

    brackets = {"(": (0x100, ("args", "tuple", "params")), "[": (0x140, ("list", "index")), "{": (0x180, ("dict",)), "<": (0x1C0, ("block",)), "\u00ab": (0x1000, _LINES)}
    top = "file"

    def __init__(self) -> None:
        sym = self.symbols
        args, group, params, listed, index, braces, block = sym("(", "args"), sym("(", "tuple"), sym("(", "params"), sym("[", "list"), sym("[", "index"), sym("{", "dict"), sym("<", "block")
        line = {r: sym("\u00ab", r) for r in _LINES}
        post = rf"(?:n|0|s+|{group}|{listed}|{braces})(?:\.n|{args}|{index})*"
        chain = rf"(?:[-~!u]*{post}(?:(?:[-okK/@]|q!?|!?i)[-~!u]*{post})*)"
        head = rf"(?:L(?:(?:[kK]?n(?:={post})?|k|/),?)*:)*"
        expr = rf"(?:{head}{chain}(?:f{chain}l{head}{chain})*)"
        named = rf"(?:(?:nW)?{expr})"
        many = rf"(?:k?{named}(?:,k?{named})*,?)"
        given = rf"(?:(?:YJ?)?{many}|Y)"
        targets = rf"(?:k?{post}(?:,k?{post})*,?)"
        loops = rf"(?:A?F{targets}i{chain}(?:f{named})*)+"
        arg = rf"(?:(?:[kK]|n=)?{named}(?:{loops})?)"
        param = rf"(?:n(?::{expr})?(?:={expr})?|k(?:n(?::k?{expr})?)?|Kn(?::{expr})?|/)"
        part = rf"(?:k?{named}|{named}?:{expr}?(?::{expr}?)?)"
        entry = rf"(?:{expr}:{expr}|K{chain})"
        dotted = r"(?:n(?:\.n)*)"
        listing = r"(?:n(?:mn)?(?:,n(?:mn)?)*,?)"
        item = rf"(?:{expr}(?:m{post})?)"
        small = rf"(?:{given}(?:={given})*|{post}(?:a{given}|:{expr}(?:={given})?)|nn{index}?={expr}|[DR]{many}|[PR]|Q(?:{expr}(?:J{expr})?)?|Gn(?:,n)*|I{dotted}(?:mn)?(?:,{dotted}(?:mn)?)*|J[.0]*{dotted}?I(?:k|{listing}|{params}|{group})|T{expr}(?:,{expr})?)"
        statement = "|".join([
            line["simple"], rf"{line['if']}{block}(?:{line['elif']}{block})*(?:{line['else']}{block})?", rf"{line['loop']}{block}(?:{line['else']}{block})?",
            rf"{line['try']}{block}(?:(?:{line['except']}{block})+(?:{line['else']}{block})?(?:{line['finally']}{block})?|{line['finally']}{block})", rf"{line['decorator']}*{line['other']}{block}",
        ])
        type(self).patterns = {
            "args": f"(?:{arg}(?:,{arg})*,?)?", "tuple": f"(?:{given}|{named}{loops}|{item}(?:,{item})*,?|{listing})?", "params": f"(?:{param}(?:,{param})*,?)?", "list": f"(?:{many}|{named}{loops})?", "index": f"{part}(?:,{part})*,?",
            "dict": f"(?:{entry}(?:,{entry})*,?|{expr}:{expr}{loops}|{many}|{named}{loops})?", "block": f"(?:{statement})+", "file": f"(?:{statement})*", "simple": f"{small}(?:;{small})*;?", "if": f"f{named}:", "elif": f"e{named}:",
            "else": "l:", "loop": f"(?:A?F{targets}i{many}|H{named}):", "try": "t:", "except": f"x(?:k?{expr}(?:,{expr})*(?:mn)?)?:", "finally": "y:", "decorator": f"@{named}",
            "other": f"(?:A?w{item}(?:,{item})*,?|A?dn{index}?{params}(?:g{expr})?|cn{index}?{args}?|n{many}(?:mn)?(?:f{named})?):",
        }
        super().__init__()

    @classmethod
    def kinds(cls, tokens: list[str]) -> tuple[str, list[int]]:
        """(kinds, the token of each), with marks of lines and blocks, without blanks, comments and newlines that don't count."""
        out: list[str] = []
        at: list[int] = []
        line: list[tuple[str, int]] = []
        depth, levels, width, n = 0, [0], 0, len(tokens)

        def put(kind: str, i: int) -> None:
            out.append(kind)
            at.append(i)

        def span(pieces: list[tuple[str, int]], end: int) -> None:
            put("\u00ab", pieces[0][1])
            for kind, i in pieces:
                put(kind, i)
            put("\u00bb", end)

        def flush(end: int) -> None:
            if not line:
                return
            inside, lambdas, colon = 0, 0, None
            soft = tokens[line[0][1]] in ("match", "case") and len(line) > 1 and line[1][0] not in ":=.,a"
            if line[0][0] in _HEADS or soft:
                for k, (kind, _) in enumerate(line):
                    inside += (kind in "([{") - (kind in ")]}")
                    lambdas += kind == "L" and inside <= 0
                    if kind == ":" and inside <= 0:
                        if not lambdas:
                            colon = k
                            break
                        lambdas -= 1
            if colon is not None and colon < len(line) - 1:
                span(line[: colon + 1], line[colon + 1][1])
                put("<", line[colon + 1][1])
                span(line[colon + 1 :], end)
                put(">", end)
            else:
                span(line, end)
            line.clear()

        for i, t in enumerate(tokens):
            c = t[0]
            if c in "\r\n":
                if depth and next((x for x in tokens[i + 1 : i + 3] if not x.isspace()), "") in _PY_STARTS:
                    depth = 0  # a statement begins here, so a bracket was left open
                if not depth:
                    flush(i)
                width = 0
            elif c in " \t\f\r":
                width = len(t.expandtabs()) if not line else width
            elif c == "#" or c == "\\" and t[-1] == "\n":
                pass
            else:
                if not line:
                    if width > levels[-1]:
                        levels.append(width)
                        put("<", i)
                    while width < levels[-1]:
                        levels.pop()
                        put(">", i)
                    if width != levels[-1]:
                        put("?", i)
                    width = 0
                if t in _PY_WORDS:
                    kind = _PY_WORDS[t]
                elif t in _PY_OPERATORS:
                    kind = _PY_OPERATORS[t]
                    depth = max(0, depth + (t in "([{") - (t in ")]}"))
                elif len(t) > 1 and t[-1] in "\"'":
                    kind = "s"
                elif t[-1] == "=" and len(t) > 1:
                    kind = "a"
                elif c.isdigit() or (c == "." and len(t) > 1):
                    kind = "0"
                else:
                    kind = "n" if t.isidentifier() and not keyword.iskeyword(t) else "?"
                line.append((kind, i))
        flush(n)
        for _ in levels[1:]:
            put(">", n)
        return "".join(out), at

    @staticmethod
    def tokenize(text: str) -> list[str]:
        return _PY_TOKEN.findall(text)


_TOML_TOKEN = re.compile(r'"""(?:[^\\]|\\[\s\S])*?"{3,5}|\'\'\'[\s\S]*?\'{3,5}|"(?:[^"\\\n]|\\[^\n])*"|\'[^\'\n]*\'|#[^\n]*|\r?\n|[ \t]+|[0-9]{4}-[0-9]{2}-[0-9]{2}[ ][0-9]{2}:[0-9:.]*(?:[zZ]|[-+][0-9:]+)?|[A-Za-z0-9_+:.-]*[A-Za-z0-9_+:-]|[\s\S]')
_TOML_BARE = re.compile(r"[A-Za-z0-9_-]+")
_TOML_VALUE = re.compile(r"true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:[zZ]|[-+][0-9]{2}:[0-9]{2})?)?|[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?")


class Toml(Language):
    """Kinds: s string, S string of several lines, k key, v value that may be a key, d dotted key, f value that may be a dotted key, 0 value."""

    brackets = {"[": (0x100, ("list", "header", "headers")), "{": (0x140, ("table",)), "(": (0x180, ("none",))}
    top = "file"

    def __init__(self) -> None:
        key = r"(?:[skvdf](?:\.[skvdf])*)"
        value = f"(?:[sSvf0]|{self.symbols('[', 'list')}|{self.symbols('{', 'table')})"
        pair = f"{key}={value}"
        line = f"(?:{self.symbols('[', 'header')}|{self.symbols('[', 'headers')}|{pair})"
        type(self).patterns = {
            "list": rf"\n*(?:{value}\n*(?:,\n*{value}\n*)*(?:,\n*)?)?", "header": key, "headers": self.symbols("[", "header"), "table": rf"\n*(?:{pair}\n*(?:,\n*{pair}\n*)*)?", "none": "!", "file": rf"\n*(?:{line}(?:\n+{line})*\n*)?",
        }
        super().__init__()

    @staticmethod
    def tokenize(text: str) -> list[str]:
        return _TOML_TOKEN.findall(text)

    @staticmethod
    def kinds(tokens: list[str]) -> tuple[str, list[int]]:
        out, at = [], []
        for i, t in enumerate(tokens):
            c = t[0]
            if c in " \t" or c == "#":
                continue
            if t[-1] == "\n" and len(t) < 3:
                kind = "\n"
            elif c in "\"'" and len(t) > 1:
                kind = "S" if t[:3] in ('"""', "'''") and len(t) >= 6 else "s"
            elif t in "[]{}=,.()":
                kind = t
            elif _TOML_VALUE.fullmatch(t):
                kind = "v" if _TOML_BARE.fullmatch(t) else "f" if all(map(_TOML_BARE.fullmatch, t.split("."))) else "0"
            elif _TOML_BARE.fullmatch(t):
                kind = "k"
            elif all(map(_TOML_BARE.fullmatch, t.split("."))):
                kind = "d"
            else:
                kind = "!"
            out.append(kind)
            at.append(i)
        return "".join(out), at


@lru_cache(maxsize=1)
def python() -> Python:
    return Python()


@lru_cache(maxsize=1)
def toml() -> Toml:
    return Toml()
