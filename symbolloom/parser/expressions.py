"""Expressions as text in one spelling: integers in decimal, floats with six digits, blanks around operators.

Works on tokens and keeps only whether an operand stands before: that tells calls from groups, whose brackets
are left out, and binary operators from unary ones.
"""

from __future__ import annotations

from symbolloom.parser import lexer

#: What an escaped character stands for.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v"}
_BINARY = frozenset("o<>&=A-")


def _character(code: int) -> str:
    """The character of a code; ValueError for those of no text."""
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        raise ValueError(code)
    return chr(code)


def literal(token: str) -> str:
    """A number in decimal, a float with six digits, a character as itself; as it is written what stands for none of them."""
    try:
        return _value(token)
    except ValueError:
        return token


def _value(token: str) -> str:
    if token[0] == "'":
        inner = token[1:-1]
        if inner[0] != "\\":
            return token
        body = inner[1:].rstrip(";")
        if body[:1] in "xX" and len(body) > 1:
            return f"'{_character(int(body[1:], 16))}'"
        return f"'{_character(int(body)) if body.isdigit() else _ESCAPES.get(body, body)}'"
    plain = token.replace("_", "")
    if plain[:2].lower() == "0x":
        return str(int(plain, 16))
    if plain[:2] in ("0b", "0o"):
        return str(int(plain, 2 if plain[1] == "b" else 8))
    return f"{float(plain):f}" if "." in plain else plain.lstrip("0") or "0"


def render(tokens: list[str], kinds: str) -> str:
    """The text of an expression's tokens; blanks, comments and newlines are passed over. Tag overrides keep their colon."""
    out: list[str] = []
    open_: list[str] = []
    operand, questions, cast = False, 0, False
    for token, kind in zip(tokens, kinds, strict=True):
        if kind in " \n/#":
            continue
        if kind == lexer.VALUE:
            out.append(literal(token))
            operand = True
        elif kind == "(":
            open_.append("call" if operand else "group")
            out.append("(" if operand else "")
            operand = False
        elif kind == ")":
            out.append(")" if open_ and open_.pop() == "call" else "")
            operand = True
        elif kind == "{":
            open_.append("list")
            out.append("{ ")
            operand = False
        elif kind == "}":
            if open_:
                open_.pop()
            out[-1:] = ["{}"] if out and out[-1] == "{ " else [*out[-1:], " }"]
            operand = True
        elif kind in "[.J":
            out.append(token)
            operand = False
        elif kind == "]":
            out.append("]")
            operand = True
        elif kind == ",":
            out.append(", ")
            operand = False
        elif kind == "?":
            questions += 1
            out.append(" ? ")
            operand = False
        elif kind == ":":
            out.append(" : " if questions else ":")
            questions -= questions > 0
            operand = False
        elif cast and kind in "<>":
            out.append(token)
            cast, operand = kind == "<", kind == ">"
        elif kind in _BINARY and operand:
            out.append(f" {token} ")
            operand = False
        elif kind == "N":
            out.append("new ")
            operand = False
        elif kind == "I":
            out.append(token)
        elif kind in "Vz":
            out.append(token)
            cast, operand = kind == "V", True
        else:
            out.append(token)
            operand = kind not in _BINARY and kind != "j"
    return "".join(out)
