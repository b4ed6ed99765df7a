"""Syntax repair and documentation pairing on small sources."""

from __future__ import annotations

import random

import numpy as np
import pytest

from symbolloom.llm import brackets, grammar, pairs, python_toml, queries, sourcepawn, syntax
from symbolloom.parser import lexer

VALID = [
    b"", b"\n", b"// only \xff", b"\xef\xbb\xbf#include <x>\n", b"/* <<<<<<< a\n=======\n>>>>>>> b */", b"int g_x = 5, g_y[3];", b"new Float:x[2] = {1.0, ...};\nstatic const char a[][] = { \"x\", \"\\\"}\" };",
    b"native Float:Old(Float:a, &b, const String:c[] = \"\", {Float,_}:d, any:...)\nforward Action OnX(int a, char[] b, any ...);", b"stock bool:F(x)\n{\n\tif (x == 1)\n\t\treturn true\n\telse if (!x) { x++; } else\n\t\tx = x ? 1 : 2\n\treturn false\n}",
    b"public void A()\n{\n\tfor (int i = 0, j; i < 3; i++) continue;\n\twhile (1) { break; }\n\tdo { x(); } while (y[1][2] > 0 && z.w.v(1).u);\n\tswitch (x) { case 1, 2: return; case A: { } default: x = -1; }\n\tdelete h; new Handle:k = f(1, _, .n = 2);\n\tArrayList l = new ArrayList(4);\n\tint[] d = new int[5];\n\tchar c = '\\n'; x = view_as<int>(y) | sizeof(z[]) + Float:q;\n}",
    b"enum { A, B = 2, }\nenum X (<<= 1) { C };\nenum Y: { Float:D[3], E }\nenum struct S { int a; char b[3]; void F(int x) { this.a = x; } }", b"methodmap M < N { public native M(int x); public native int G() \n property int P { public get() { return 1; } public native set(int v); } }\nmethodmap K __nullable__ {};",
    b"typedef F = function void (int a, char[] b);\ntypeset G { function int (int a); function Action () }\nfunctag public H(x);\nfuncenum I { public(a), Action:public(b, c) };\nstruct J { public const char[] n; int m; };\nusing __intrinsics__.Handle;",
    b"public Plugin myinfo =\n{\n\tname = \"a\",\n\tauthor = \"b\",\n};\n#if defined X\n#define Y(%1) (%1 + \\\n 1)\n#else\n#endif\npublic\n#pragma x\nint F()\n{\n}\n", b"void F() { a = \"x\" ... \"y\"; }", b"int a = 1\nint b = 2\n", b"void f()\n{\n\tg(\n#if A\n\t1\n#endif\n\t)\n}",
]
INVALID = [
    b"void f() {", b"void f() }", b"}", b"int f(int a", b"int x = ;", b"stock int f(int x)", b"\x00", b"<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n", b"/* open", b"char a[] = \"open;\n", b"{\"a\": 1}", b"[a]\nb = 1\n", b"def f(x):\n    return 1\n", b"# Title\n\ntext of a guide.\n", b"void f() { if (x) }",
    b"void f() { x = 1 y = 2; }", b"void f() { else x; }", b"enum E { A B }", b"methodmap M { int }", b"void f() { case 1: x; }", b"int a int b;", b"\"Phrases\"\n{\n\"a\" \"b\"\n}", b"void f() { x(1,,2); }", b"int caf\xc3\xa9;", b"#if X\nint a;\n", b"#endif\n", b"void f() { a ? b; }", b"native int f(int a) {", b"void f() { for (;) x(); }",
]


@pytest.mark.parametrize("content", VALID)
def test_valid(content):
    assert syntax.check("sourcepawn", content) is None


@pytest.mark.parametrize("content", INVALID)
def test_invalid(content):
    edits, at, kind = syntax.check("sourcepawn", content)
    assert edits >= 1 and 0 <= at <= len(content) and kind != "valid"


def test_kinds_of_damage():
    good = b"// a\nstock int F(int a)\n{\n\tint b = a;\n\treturn b;\n}\n" * 12
    assert syntax.check("sourcepawn", good) is None
    assert syntax.check("sourcepawn", good[:-6])[2] == "truncation"
    assert syntax.check("sourcepawn", good + b"<<<<<<< x\nint a;\n=======\nint a;\n>>>>>>> y\n")[2] == "conflict"
    assert syntax.check("sourcepawn", b"import os\ndef f(a):\n    return a[0]\nfor x in y:\n    print(x)\n")[2] == "mismatch"
    one = syntax.check("sourcepawn", good.replace(b"return b;", b"return b b;", 1))
    assert one[0] == 1 and good[: one[1]].count(b"\n") == 4


def test_chart_finds_the_fewest_edits():
    """Against plain dynamic programming over all short strings of a small language."""
    chart, words = grammar.Chart("a(?:b,)*c?"), []
    for n in range(4):
        for tail in ("", "c"):
            words.append("a" + "b," * n + tail)
    rng = random.Random(1)

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for _ in range(400):
        s = "".join(rng.choice("ab,c!") for _ in range(rng.randrange(6)))
        best = min(distance(s, w) for w in words)
        got = chart.cost(s, 4)
        assert (got[0] if got else 5) == min(best, 5), s
    assert chart.cost("ab,!", 4)[1] == 3


def test_repairs_have_no_ceiling():
    broken = b"void f()\n{\n\tg();\n\tx = 1 2 3 4 5 6 7 8 9 10;\n}\n"
    edits, at, _ = syntax.check("sourcepawn", broken)
    assert edits == 5 and broken[at:].startswith(b"2 3")
    assert syntax.check("sourcepawn", b"int a;\n\n\n\nint b = = 1;\n")[:2] == (1, 18)  # newlines that don't count are mapped back
    assert syntax.check("sourcepawn", b"void f()\n{\n\telse x();\n}\n")[:2] == (1, 12)
    lines = b"".join(b"x = %d\n" % i + b"y = = 1\n" * (i % 20 == 7) for i in range(120))
    edits, at, kind = syntax.check("python", lines)
    assert edits == 6 and at == lines.index(b"y") + 4 and kind == "error"
    assert syntax.check("toml", b"".join(b"k%d = 1\n" % i + b"y = = 1\n" * (i % 20 == 7) for i in range(120)))[0] == 6
    assert syntax.check("toml", b"x0\n" * 40)[0] >= 40
    assert syntax.check("json", b"[1,,2,,3,,4,,5,,6]")[0] == 5


def test_size_makes_nothing_invalid():
    """Nesting and numbers beyond the limits of recursive readers, and of what reads Python itself."""
    deep = b"[" * 60_000 + b"]" * 60_000
    assert syntax.check("json", deep) is None and syntax.check("json", b"[" + b"9" * 5000 + b"]") is None
    assert syntax.check("json", deep[1:])[0] == 1
    assert syntax.check("toml", b"a = " + b"[" * 3000 + b"]" * 3000) is None and syntax.check("toml", b"a = " + b"7" * 5000) is None
    assert syntax.check("toml", b"a = " + b"[" * 3000 + b"]" * 2999)[0] == 1
    assert syntax.check("python", b"x = " + b"(" * 250 + b"1" + b")" * 250 + b"\n") is None
    assert syntax.check("python", b"x = " + b"(" * 250 + b"1" + b")" * 249 + b"\n")[0] == 1
    nest = b"".join(b" " * i + b"if x:\n" for i in range(120)) + b" " * 120 + b"pass\n"
    assert syntax.check("python", nest) is None
    for n in (30, 31, 32, 33, 300, 40_000):
        source = b"void f() { x = " + b"(" * n + b"1" + b")" * n + b"; }"
        assert syntax.check("sourcepawn", source) is None and syntax.check("sourcepawn", source.replace(b"))", b")", 1))[0] == 1


def test_reserved_words_are_no_names():
    assert syntax.check("sourcepawn", b"import os\n")[2] == "mismatch" and syntax.check("sourcepawn", b"int package;")[0] == 1
    assert syntax.check("sourcepawn", b"forward void A()\n// one\n\nstatic int B(int x)\n{\n}\n") is None  # newlines around comments


def test_brackets_are_replaced_where_that_is_cheapest():
    assert [syntax.check("json", c)[0] for c in (b"[[1,2},3]", b"[1,2}", b"{s[]}", b"[1]]", b"[[1]", b"}1]", b"[{]")] == [1, 1, 2, 1, 1, 1, 1]


def test_any_number_of_brackets_is_paired_with_the_fewest_edits():
    """Against the plain recurrence over all intervals, beyond 256 brackets too."""
    rng = random.Random(8)

    def edits(s, a, b):
        return (s[a].lower() != s[b].lower()) if s[a].islower() and s[b].isupper() else s[a].isupper() + s[b].islower()

    def least(s):
        n = len(s)
        cost = np.zeros((n + 2, n + 2), int)
        for a in range(n - 1, -1, -1):
            pair = np.array([edits(s, a, k) for k in range(a + 1, n)], int)
            for b in range(a + 1, n + 1):
                cost[a, b] = min([cost[a + 1, b] + 1, *(cost[a + 1, a + 1 : b] + pair[: b - a - 1] + cost[a + 2 : b + 1, b])])
        return cost[0, n]

    crossed = "ab" * 70 + "c" + "AB" * 70  # lower case opens
    for s in [*("".join(rng.choice("abAB") for _ in range(rng.randrange(1, 14))) for _ in range(200)), "".join(rng.choice("abcABC") for _ in range(280)), crossed, "a" * 290, "A" * 150 + "a" * 151]:
        out = brackets.pair(np.array([c.islower() for c in s]), np.array([ord(c.lower()) for c in s]))
        assert sorted(i for p in out for i in p if i >= 0) == list(range(len(s)))
        assert sum(edits(s, a, k) if k >= 0 else 1 for a, k in out) == least(s), s
    assert [syntax.check("sourcepawn", b"void f() {\n" + b" y(;\n" * n + b"}\n")[0] for n in (200, 400, 1600)] == [200, 400, 1600]
    for n in (2, 20_000):  # crossed far inside
        assert syntax.check("json", b"[" * n + b"[{1]}" + b"]" * n)[0] == 2


def test_packed_costs_give_the_same_pairs(monkeypatch):
    rng, cases = random.Random(5), []
    for n in (7, 30, 90, 120):
        s = "".join(rng.choice("abAB") for _ in range(n))
        cases.append((np.array([c.islower() for c in s]), np.array([ord(c.lower()) for c in s])))
    plain = [brackets.pair(*c) for c in cases]
    monkeypatch.setattr(brackets, "PACKED", 5)
    monkeypatch.setattr(brackets, "RECENT", 2)
    assert [brackets.pair(*c) for c in cases] == plain
    row = np.array([0, 1, 0, 1, 2, 2, 1], np.int16)
    kept = brackets._packed(row)
    assert isinstance(kept, brackets._Packed) and kept.row().tolist() == row.tolist() == [kept[i] for i in range(7)]


def test_dropping_is_tried_for_any_number_of_open_brackets():
    assert [syntax.check("json", b"{" + b'"a":{1,' * n + b'"b":2}')[0] for n in (8, 9, 40, 2000)] == [10, 11, 42, 2002]


def test_trials_of_dropped_brackets_equal_whole_repairs():
    language, rng = sourcepawn.language(), random.Random(4)
    tokens, kinds = lexer.tokenize(VALID[9].decode())
    code = language.code(kinds)
    for _ in range(40):
        k = list(code)
        for _ in range(rng.randrange(1, 20)):
            k.insert(rng.randrange(len(k) + 1), rng.choice("({[(\n])}"))
        k = "".join(k)
        language.repair(k)
        plan = language._pair_greedily(k)
        lone, best, dropped = [i for i, p in plan.items() if p is None], language._apply(k, plan)[0], []
        got = language._better_dropped(k, plan, lone)
        for i in lone:
            if (edits := language._apply(k, plan | {i: -1})[0]) < best:
                best, plan = edits, plan | {i: -1}
                dropped.append(i)
        assert got == dropped, k


def test_repair_of_short_json_against_the_least():
    """Repairs are never below the least number of edits, and mostly equal to it; README gives the rate."""
    language, rng = syntax._json(), random.Random(9)
    alphabet = "s0,:[]{}"

    def valid(k):
        return language.accepts(k)

    def least(k):
        seen, front, n = {k}, {k}, 0
        while not any(map(valid, front)):
            n += 1
            front = {y for x in front for i in range(len(x) + 1) for y in {x[:i] + x[i + 1 :], *(x[:i] + c + x[i:] for c in alphabet), *(x[:i] + c + x[i + 1 :] for c in alphabet if i < len(x))}} - seen
            seen |= front
        return n

    got = []
    for _ in range(60):
        k = rng.choice(["[0,[0,s]]", "{s:[0],s:{}}", "[{s:0},0]"])
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(k) + 1)
            k = k[:i] + rng.choice(["", *alphabet]) + k[i + rng.randrange(2) :]
        got.append((language.repair(k)[0], least(k)))
    assert all(a >= b and (a == 0) == (b == 0) for a, b in got)
    assert sum(a == b for a, b in got) >= 0.7 * len(got) and sum(a for a, _ in got) <= 1.5 * sum(b for _, b in got), got


PYTHON = [
    "x = 1; y: int = 2\n", "def f(a, /, b: int = 1, *c, d=2, **e) -> int:\n    return a if b else lambda x, *y: (x, y)\n", "class A(B, k=1):\n    x: int\n    @p.q(1)\n    async def f(self): await g(*a, **b)\n", "for i, *j in z: print(i, end='')\nelse:\n    pass\n",
    "try:\n    x[1:2, ::3] = {**a, 'b': [c for d in e if f], **{1, 2}}\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del x, y\n", "with a as b, c(): pass\nwhile (n := f()) not in x is not y: n **= 2\n", "match x:\n    case [1, *r] if r: pass\n    case A(b=1) | {'k': 2}: pass\n    case _: ...\n",
    "from . import (a as b,\n  c)\nimport a.b as c, d\nfrom ..x import *\nglobal z\nassert x, 'y'\n", "if a:\n\tif b: c\n\telif d:\n\t\te\n\n# comment\n\telse: f\ng = x,\nh = not -a ** ~b @ c // d\n", "type X[T] = list[T]\ndef f[T](x: T): return 'a' \"b\" f'{x}'\n", "x = [\n  1,\n # c\n]\nprint(a for b in c)\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_chart(text):
    """Valid text has no edits in the chart itself; damage has few."""
    compile(text, "f", "exec")
    language = python_toml.python()
    assert language.accepts(language.kinds(language.tokenize(text))[0]), language.bad
    for damage in (text + "x = = 1\n", text + "y = (1\n", text + "x 2\n"):
        assert syntax.check("python", damage.encode())[0] == 1


def test_toml_chart():
    text = 'a = 1\nb.c."d e" = [1, 2.5, # x\n "s", ]\n\n[t.u]\n1.5 = {x = 1, y = [true]}\n[[v]]\nd = 1979-05-27T07:32:00Z\ne = """a\nb"""\nf = \'x\'\ng = +inf\nh = 07:32:00\ni = 0xff\n'
    language = python_toml.toml()
    assert language.accepts(language.kinds(language.tokenize(text))[0]), language.bad
    assert syntax.check("toml", text.encode()) is None
    assert [syntax.check("toml", (text + t).encode())[0] for t in ("z 1\n", "z = \n", "z = [1\n", "[q\n", "a = 2\nz = 1\nz = 2\n")] == [1, 1, 1, 1, 1]


def test_chart_equals_plain_distance_without_bound():
    chart, rng = grammar.Chart("a(?:b,)*c?"), random.Random(6)
    words = ["a" + "b," * n + tail for n in range(14) for tail in ("", "c")]
    for _ in range(60):
        s = "".join(rng.choice("ab,c!") for _ in range(rng.randrange(18)))
        best = 99
        for w in words:
            row = list(range(len(w) + 1))
            for i, x in enumerate(s, 1):
                prev, row[0] = row[0], i
                for j, y in enumerate(w, 1):
                    prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
            best = min(best, row[-1])
        assert chart.cost(s)[0] == best, s


def test_repair_is_zero_just_for_accepted_files():
    language, rng = sourcepawn.language(), random.Random(2)
    for content in VALID[:14]:
        tokens, kinds = lexer.tokenize(content.decode("latin-1"))
        code = language.code(kinds)
        assert language.accepts(code) and language.repair(code)[0] == 0
        for _ in range(20):
            i = rng.randrange(len(code) + 1)
            changed = code[:i] + rng.choice(["", "n", ";", "(", "}", "="]) + code[i + 1 :]
            accepted, edits = language.accepts(changed), language.repair(changed)[0]
            if "l" not in changed:
                assert accepted == (edits == 0), changed


def test_other_languages(spark):
    rows = [
        (1, "a.PY", b"x = 1\n"), (2, "d\\a.py", b"x ="), (3, "a.py", b""), (4, "a.py", b"<<<<<<< a\nx\n"), (5, "a.json", b'{"a": [1, "<<<<<<<"]}'), (6, "a.json", b'{"a": [1}'), (7, "a.json", b""), (8, "a.toml", b"a = 1\n"), (9, "a.toml", b"a ="),
        (10, "a.txt", b"{"), (11, None, b"{"), (12, "a.inc", None), (13, "dir.py/a.inc", b"int a;"), (14, "a.json", b"NaN"), (15, "a.json", b"\xff"), (16, "a.py", b"\xff"), (17, "a.py", b"a\x00"), (18, "a.toml", b""), (6, "a.json", b'{"a": [1}'), (19, "noextension", b"{"), (20, "A.SP", b"x" * 200_000), (21, "a.py", b"return 1\n"),
    ]
    df = spark.createDataFrame([(*r, "repo", "clash") for r in rows], "blob_id bigint, path string, content binary, repo string, language string")
    out = syntax.repairs(df).collect()
    assert sorted(r["blob_id"] for r in out if r["edits"]) == [2, 4, 6, 6, 7, 9, 14, 15, 16, 17, 20, 21]
    assert sorted({r["blob_id"] for r in out if not r["edits"]}) == [1, 3, 5, 8, 13, 18]
    rate = {r["language"]: (r["files"], r["invalid"], r["rate"]) for r in syntax.rates(df).collect()}
    assert rate == {"python": (7, 5, 0.714286), "json": (6, 5, 0.833333), "toml": (3, 1, 0.333333), "sourcepawn": (2, 1, 0.5)}
    assert syntax.repairs(df.where("false")).count() == 0 == syntax.rates(df.where("false")).count()


DOC = "Reads the whole open table twice."
SOURCE = f"""/* {DOC} */
native int First();
/* {DOC} */
native int Second();
// {DOC}

native int Gap();
int x; /* {DOC} */
native int AfterCode();
native int Tail(); // {DOC}
native int Inner(int a, /* {DOC} */ int b);
// {DOC}
// short
native int TwoLines();
/** Reads the open table. */
native int ReadsOpen();
/**
 * @param a {DOC}
 */
native int OnlyTags();
/**
 * @brief {DOC}
 * @return x
 */
stock int Tagged(int a)
{{
	// {DOC}
	int y = F(1);
	/* {DOC} */
	return G(2);
}}
/// {DOC}
methodmap Map < Base {{
	/** {DOC} */
	public native Map(int x);
	/** {DOC} */
	property int Size {{
		// {DOC}
		public native get();
	}}
	public native void Push(any v); // {DOC}
}}
/* {DOC} */
enum struct Rec {{
	// {DOC}
	void Do(int x) {{ Call(x); }}
	int field; // {DOC}
}}
// {DOC}
typedef Cb = function int (int a);
/*
// {DOC}
native int InComment();
*/
// {DOC}
static Float:Old(Float:a)
{{
}}
// {DOC}
public Plugin myinfo = {{ name = "Foo(1)" }};
/* {DOC}
 */ /* second */
native int Shared();
"""


def test_pairs_rules():
    got = {full for full, bare, c, *_ in pairs.documented(SOURCE.encode()) if pairs.own_words(pairs.brief_of(c), bare) >= 5}
    assert got == {"Second", "Tail", "Tagged", "Map.Map", "Map.Push", "Rec.Do", "Old", "Shared"}
    every = {full for full, *_ in pairs.documented(SOURCE.encode())}
    assert every == got | {"TwoLines", "ReadsOpen", "OnlyTags"}
    assert [f[0] for f in pairs.documented(b"\n" + SOURCE.encode())][:1] == ["First"]
    assert pairs.documented(SOURCE.encode() + b"}") == [] == pairs.documented(b"")


def test_code_of_pairs():
    """Spans run from the first specifier to the end of the body or declaration; equal names stay apart."""
    content = f"""
// {DOC}
native int A(int x = (1));
// {DOC}
forward void A()
// {DOC}
static int[] B(int x) // tail
{{
	if (x) {{ return "}}"; }}
}}
methodmap M {{
	// {DOC}
	public native M(int x);
}}""".encode()
    found = [(full, content[a:b].decode()) for full, _, _, a, b in pairs.documented(content)]
    assert found == [("A", "native int A(int x = (1));"), ("A", "forward void A()"), ("B", 'static int[] B(int x) // tail\n{\n\tif (x) { return "}"; }\n}'), ("M.M", "public native M(int x);")]


@pytest.mark.parametrize("header", ["methodmap Far < Base", "enum struct Far"])
def test_owner_far_from_its_brace(header):
    gap = "\n" + "// line\n" * 300
    source = f"void Before()\n{{\n}}\n{header}{gap}{{\n\t/* {DOC} */\n\tpublic void Do(int x)\n\t{{\n\t}}\n}}\n"
    assert [f[0] for f in pairs.documented(source.encode())] == ["Far.Do"]


def test_briefs_and_own_words():
    assert pairs.brief_of("/**\n * One\n * two @x.\n * @param a b\n */").split() == ["One", "two", "@x."]
    assert pairs.brief_of("/** @return x\n @brief the text\n goes on\n @note n */").split() == ["the", "text", "goes", "on"]
    assert pairs.brief_of("///< text").strip() == "text" and pairs.brief_of("//").strip() == "" == pairs.brief_of("/**/").strip() == pairs.brief_of("/***/").strip()
    assert pairs.own_words("Gets the foo2bar HUDMenu value don't", "Foo_GetHUDMenu3Bar") == 6 and pairs.own_words("", "x") == 0


def test_syntax_check_of_parsed_files(spark):
    from symbolloom.parser.declarations import parse_files

    files = spark.createDataFrame([(1, b"native int A();"), (2, b"native int B(")], "id int, content binary")
    assert {(r["id"], r["name"], r["error"]) for r in parse_files(files, ["id"], valid=syntax.is_sourcepawn).collect()} == {(1, "A", None), (2, None, "SyntaxError")}


def test_pairs_table(spark):
    rows = [(1, "a.INC", SOURCE.encode()), (2, "a.py", SOURCE.encode()), (3, "a.inc", None), (4, None, SOURCE.encode()), (5, "a.sp", SOURCE.encode() + b"{"), (6, "x\\a.sp", SOURCE.replace("\n", "\r\n").encode()), (1, "a.INC", SOURCE.encode()), (7, "a.sp", ("// " + "\u043e\u0434\u0438\u043d \u0434\u0432\u0430 \u0442\u0440\u0438 \u0447\u0435\u0442\u044b\u0440\u0435 \u043f\u044f\u0442\u044c").encode().join([b"\n", b" \xff\nnative int A();\n// x\n"]) * 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "blob_id bigint, path string, content binary, func_name string")
    got = sorted({(r["blob_id"], r["func_name"]) for r in pairs.pairs(df).collect()})
    names = ["Map.Map", "Map.Push", "Old", "Rec.Do", "Second", "Shared", "Tagged", "Tail"]
    assert got == [(i, n) for i in (1, 6) for n in names] + [(7, "A")]
    assert pairs.pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["p5_found", "p6_found", "p6_rates", "p8_ids"])
def test_queries_run(spark, tiny, name):
    assert queries.queries()[name](spark, tiny).collect()
