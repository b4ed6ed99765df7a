"""Syntax of SourcePawn, old and new style, over the token kinds of parser.lexer."""

from __future__ import annotations

import re
from functools import lru_cache

from symbolloom.llm.grammar import Language


def _patterns(sym) -> dict[str, str]:
    args, cond, params, header, step = (sym("(", r) for r in ("args", "expr", "params", "for", "step"))
    block, cases, enum, struct, methods, accessors, types, items, record, old_types = (sym("{", r) for r in ("block", "cases", "enum", "enumstruct", "methodmap", "property", "typeset", "list", "struct", "funcenum"))
    q, empty, any_dim = sym("[", "index"), sym("[", "empty"), sym("[", "index")[:-1] + sym("[", "empty")[1:]
    kind = f"(?:[nt]{empty}*)"
    tag = "(?:[nt]:)"
    operand = f"(?:n|0|s(?:E?s)*|{cond}|z(?:{args}|n{any_dim}*)|V<[nt]{empty}*>{cond}|N[nt](?:{args}|{q}+)|t{args})"
    unary = rf"(?:[-jI]|{tag})*{operand}(?:{args}|{any_dim}|\.[nt]|J[nt]|I)*"
    chain = f"(?:{unary}(?:[o<>&=A-]{unary})*)"
    expr = rf"(?:{chain}(?:\?{chain}(?:\?{chain}:{chain})?:{chain})*)"
    several = f"(?:{expr}(?:,{expr})*)"
    init = f"(?:=(?:{expr}|{items}))"
    names = f"(?:n{any_dim}*{init}?(?:,n{any_dim}*{init}?)*)"
    tagged = f"(?:{tag}?n{any_dim}*{init}?(?:,{tag}?n{any_dim}*{init}?)*)"
    end = r"[;\n]"
    local = f"(?:[ab]*{kind}{names}|[NLb][a]?{tagged})"
    simple = f"(?:{local}{end}|{several}{end}|R(?:{expr}|{items})?{end}|[BC]{end}|Z{expr}{end}|x{expr}?{end}|;)"
    head = rf"(?:i{cond}\n?|l|H{cond}\n?|h{header}\n?|d)"
    item = rf"(?:{head}*(?:{simple}|{block}[;\n]?|S{cond}\n?{cases}[;\n]?))"
    param = f"(?:a?(?:&?{tag}?&?n{any_dim}*|{kind}&?n{any_dim}*|{kind}&?E|{tag}?E|{items}:&?(?:n{any_dim}*|E)|{kind}&){init}?)"
    field = f"(?:a?{kind}n{any_dim}*(?:,n{any_dim}*)*{end})"
    body = rf"(?:\n?{block}[;\n]?)"
    result = rf"(?:{kind}\n?|{tag})"
    native = f"(?:[ukba]*v[uvkba]*{result}?j?n{params}{end})"
    method = f"(?:[ukba]*{result}?j?n{params}(?:{body}|=n{end}))"
    function = rf"(?:n|O(?:[o<>&=jI-]))"
    entry = f"(?:{tag}?n{any_dim}*(?:={expr})?)"
    element = f"(?:{expr}|{items}|n={items}|E)"
    tops = [
        f"[ukba]*[vw][uvkwba]*{result}?{function}{params}(?:=n)?{end}", f"[ukba]*{result}?{function}{params}(?:{body}|\n?R{expr}{end})", f"[ukbaNL]+(?:{kind}{names}|{tagged}){end}", f"{kind}{names}{end}",
        rf"e[nt]?:?{step}?:?\n?{enum}[;\n]?", rf"ern\n?{struct}[;\n]?", rf"mnn?(?:<n)?\n?{methods}[;\n]?", rf"yn=f{kind}{params}{end}", rf"Yn\n?{types}[;\n]?", rf"rn\n?{record}[;\n]?",
        f"gu?{tag}?n{params}{end}", rf"Gn\n?{old_types}[;\n]?", rf"Un(?:\.n)*{end}", end,
    ]
    return {
        "args": f"(?:(?:\\.n=)?(?:{expr}|{items})(?:,(?:\\.n=)?(?:{expr}|{items}))*)?", "expr": several, "params": f"(?:{param}(?:,{param})*)?",
        "for": f"(?:{local}|{several})?;{expr}?;{several}?", "step": f"A{expr}", "index": expr, "empty": "(?:)",
        "block": rf"\n?(?>{item})*", "cases": rf"\n?(?>(?:c{several}|D):|{item})*", "enum": f"(?:{entry}(?:,{entry})*,?)?", "enumstruct": rf"\n?(?>{field}|{method})*",
        "methodmap": rf"\n?(?>{native}|{method}|p{result}n\n?{accessors}[;\n]?)*", "property": rf"\n?(?>{native}|{method})*", "typeset": rf"\n?(?>f{kind}{params}{end})*",
        "list": f"(?:{element}(?:,{element})*,?)?", "struct": rf"\n?(?>u?a?{kind}n{any_dim}*{end})*", "funcenum": f"(?:{tag}?u?{params}(?:,{tag}?u?{params})*,?)?",
        "file": rf"\n?(?>{'|'.join(tops)})*",
    }


class SourcePawn(Language):
    brackets = {
        "(": (0x100, ("args", "expr", "params", "for", "step")),
        "[": (0x140, ("index", "empty")),
        "{": (0x1000, ("block", "cases", "enum", "enumstruct", "methodmap", "property", "typeset", "list", "struct", "funcenum")),
    }
    top = "file"
    _FLAT = frozenset(("args", "expr", "params", "for", "step", "index", "empty", "enum", "list", "funcenum"))
    #: A newline counts where the token before can end a statement and the next can begin one.
    _SOFT = re.compile("(?<![\nnt0sIBCREĀ-῿])\n+|\n+(?=[-o&=A<>,.:?;\nĀ-࿿])|^\n+")
    _DROP = {ord(c): None for c in " /#"}

    def __init__(self) -> None:
        type(self).patterns = _patterns(self.symbols)
        super().__init__()

    def prepare(self, content: str, role: str) -> str:
        if role in self._FLAT:
            return content.replace("\n", "") if "\n" in content else content
        content = self._SOFT.sub("", content)
        return content if content[-1:] in ("", ";", "\n") else content + "\n"

    def kept(self, content: str, role: str) -> list[int]:
        if role in self._FLAT:
            return [i for i, c in enumerate(content) if c != "\n"]
        out, at = [], 0
        for m in self._SOFT.finditer(content):
            out += range(at, m.start())
            at = m.end()
        return [*out, *range(at, len(content))]

    def role_mask(self, bracket: str, content: str) -> int:
        mask = super().role_mask(bracket, content)
        if "l" in content and bracket == "{" and self.misfits(content, "block"):
            mask &= ~3  # neither block nor cases
        return mask

    def misfits(self, content: str, role: str) -> list[int]:
        """Each else without an if before it that has none yet."""
        out, ifs = [], 0
        for i, c in enumerate(content if role in ("block", "cases") else ""):
            if c == "l" and not ifs:
                out.append(i)
            else:
                ifs += (c == "i") - (c == "l")
        return out

    def code(self, kinds: str) -> str:
        """The kinds without blanks, comments and preprocessor lines."""
        return kinds.translate(self._DROP)


@lru_cache(maxsize=1)
def language() -> SourcePawn:
    return SourcePawn()
