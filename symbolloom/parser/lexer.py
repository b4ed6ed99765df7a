"""Tokens of SourcePawn text. Every token is one character of a kind string, so grammars can be patterns.

Text is bytes read as Latin-1, so that positions are byte offsets. All of the text is covered by tokens:
blanks, newlines, comments and preprocessor lines are tokens too.
"""

from __future__ import annotations

import re
from itertools import accumulate

BLANK, NEWLINE, COMMENT, LINE, NAME, TYPE, VALUE, TEXT, BAD, MARKER = " ", "\n", "/", "#", "n", "t", "0", "s", "!", "M"

#: Keywords and their kinds; directives of the preprocessor.
KEYWORDS = {
    "const": "a", "static": "b", "public": "u", "stock": "k", "native": "v", "forward": "w", "enum": "e", "struct": "r", "methodmap": "m", "property": "p", "typedef": "y", "typeset": "Y", "function": "f",
    "if": "i", "else": "l", "for": "h", "while": "H", "do": "d", "switch": "S", "case": "c", "default": "D", "return": "R", "break": "B", "continue": "C", "new": "N", "decl": "L", "sizeof": "z",
    "view_as": "V", "delete": "Z", "operator": "O", "using": "U", "functag": "g", "funcenum": "G", "exit": "x", "goto": "x", "assert": "x", "int": TYPE, "float": TYPE, "bool": TYPE, "char": TYPE, "any": TYPE, "void": TYPE,
}
#: Words that the language reserves for later; they are no names.
RESERVED = "acquire as catch cast_to double explicit finally foreach implicit import in interface let namespace nullable object package private protected readonly sealed throw try typeof union var variant virtual volatile with".split()
KEYWORDS |= dict.fromkeys(RESERVED, BAD)
DIRECTIVES = "include tryinclude define undef if else elseif endif endinput pragma error warning assert file line emit deprecate".split()
OPERATORS = {
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", ";": ";", ",": ",", ".": ".", ":": ":", "?": "?", "=": "=", "~": "j", "!": "j", "-": "-", "&": "&", "<": "<", ">": ">", "++": "I", "--": "I", "::": "J", "...": "E",
    "+": "o", "*": "o", "/": "o", "%": "o", "|": "o", "^": "o", "&&": "o", "||": "o", "==": "o", "!=": "o", "<=": "o", ">=": "o", "<<": "o", ">>": "o", ">>>": "o",
    "+=": "A", "-=": "A", "*=": "A", "/=": "A", "%=": "A", "|=": "A", "&=": "A", "^=": "A", "<<=": "A", ">>=": "A", ">>>=": "A",
}

_DIRECTIVE = "|".join(DIRECTIVES)
_COMMENT = r"//(?:[^\n\\]|\\\r?\n|\\)*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_STRING = r'"(?:[^"\\\r\n]|\\\r?\n|\\[^\r\n])*"'
TOKEN = re.compile(
    "|".join([
        r"[ \t\r\f\v]+", r"\n", r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"[A-Za-z_@][A-Za-z0-9_@]*", _STRING,
        r"(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|$)(?:(?<=^.{7})|(?<=\n.{7}))[^\n]*",
        rf"#[ \t]*(?:{_DIRECTIVE})\b(?:\\\r?\n|{_STRING}|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|/(?![/*])|[^\n\\/\"]|\"|\\)*",
        r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0o[0-7_]+|[0-9][0-9_]*(?:\.[0-9_]+(?:[eE][-+]?[0-9]+)?)?(?![A-Za-z_])", r"'(?:[^'\\\r\n]|\\(?:[xX][0-9a-fA-F]*;?|[0-9]+;?|[^\r\n]))'",
        r">>>=|<<=|>>=|>>>|\.\.\.|<<|>>|<=|>=|==|!=|&&|\|\||\+\+|--|::|[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.(){}\[\]]", r"[\s\S]",
    ])
)


class _Kinds(dict):
    """Kind of a token's text; texts seen are remembered, up to a bound."""

    def __missing__(self, token: str) -> str:
        c = token[0]
        if token in OPERATORS:
            kind = OPERATORS[token]
        elif token in KEYWORDS:
            kind = KEYWORDS[token]
        elif c.isascii() and (c.isalpha() or c in "_@"):
            kind = NAME
        elif c in " \t\r\f\v":
            return BLANK
        elif c == "\n":
            kind = NEWLINE
        elif c.isascii() and c.isdigit():
            kind = VALUE
        elif c == "/" and len(token) > 1:
            return COMMENT
        elif c == "#" and len(token) > 1:
            return LINE
        elif c == '"' and len(token) > 1:
            return TEXT
        elif c == "'" and len(token) > 1:
            kind = VALUE
        elif c in "<=>|" and len(token) >= 7:
            return MARKER
        else:
            kind = BAD
        if len(self) < 200_000:
            self[token] = kind
        return kind


KINDS = _Kinds()


def tokenize(text: str) -> tuple[list[str], str]:
    """(token texts, their kinds). A byte-order mark at the start counts as a blank."""
    tokens = TOKEN.findall(text)
    if text.startswith("\xef\xbb\xbf"):
        return tokens, "   " + "".join(map(KINDS.__getitem__, tokens[3:]))
    return tokens, "".join(map(KINDS.__getitem__, tokens))


def starts(tokens: list[str]) -> list[int]:
    """Offset of each token, and the end."""
    return [0, *accumulate(map(len, tokens))]
