"""Inventory operators on small fixtures."""

from __future__ import annotations

import json
import random
import subprocess
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from oracle import assert_same
from symbolloom.functions import docs, paths, scoring, signature
from symbolloom.operators import catalogue, merge, search
from symbolloom.parser import declarations, lexer
from symbolloom.plans import generate, reference
from symbolloom.sources import bundles, git


def _dice(a: str, b: str) -> float:
    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


def test_score(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abAB  ") for _ in range(rng.randrange(7)))
    pairs = [("Foo", "Foo"), ("Foo", "foo"), ("FooBar", "oba"), ("night", "nacht"), ("x", ""), ("a", "b"), (" ", " "), ("aaaa", "aa"), ("aabb", "bbaab")] + [(word(), word()) for _ in range(300)]

    def want(a, b):
        return 1.0 if a == b else 0.9 if a.lower() == b.lower() else 0.8 if b.lower() in a.lower() else _dice(a, b)

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "x"), (-2, "x", None)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", scoring.score(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(want(a, b)), (a, b)
    names = [a for a, _ in pairs]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(names)], "i int, a string")
    for needle in ("aabb", "aaa", "b", "", " ", "aB.a", "abAB"):
        got = {r["i"]: r["s"] for r in df.select("i", scoring.score(F.col("a"), needle).alias("s")).collect()}
        assert all(got[i] == pytest.approx(want(a, needle)) for i, a in enumerate(names)), needle


def test_paths(spark):
    df = spark.createDataFrame([("a/b/x.inc",), (".profile",), ("x.tar.gz",), ("noext",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.file_stem(F.col("p"))).collect()] == ["x", ".profile", "x.tar", "noext", None]
    assert [r[0] for r in df.select(paths.glob_match(F.col("p"), ["a/*.inc", "no???"])).collect()] == [True, False, False, True, None]
    one = spark.createDataFrame([(["s", "methodmap.X", "methodmap_method.m", "odd"],)], "p array<string>")
    assert one.select(paths.normalize_path(F.col("p"))).first()[0] == ["s", "methodmap.X", "function.m", "odd"]


def test_signature(spark):
    texts = ["function void (int a, const char[] b, any ...)", "function Action()", "function", None, "function int(x)"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(signature.parse_signature(F.col("t"))).collect()]
    assert got[0].returnType == "void" and [(a["type"], a["name"]) for a in got[0].arguments] == [("int", "a"), ("const char[]", "b"), ("any", "...")]
    assert got[1].returnType == "Action" and got[1].arguments == [] and got[2] is None and got[3] is None and got[4].arguments == []


def test_docs(spark):
    raw = "/** é first\n * second\n * @param x  the x\n *   goes on\n * @return\n */".encode()
    df = spark.createDataFrame([(raw, 0, 5), (raw, 1, 0), (raw, 5, 9), (raw, 4, 5), (None, 1, 2)], "b binary, s bigint, e bigint")
    assert df.limit(1).select(docs.doc_slice(F.col("b"), F.lit(4), F.lit(6))).first()[0] == "é" and df.limit(1).select(docs.doc_slice(F.col("b"), F.lit(4), F.lit(5))).first()[0] is None
    got = spark.createDataFrame([(raw.decode(),), ("// one line",), ("",), (None,)], "t string").select(docs.parse_comment(F.col("t")).alias("d")).collect()
    assert got[0].d.brief == "é first second" and [(t.tag, t.text) for t in got[0].d.tags] == [("param", "x the x goes on"), ("return", "")]
    assert got[1].d.brief == "one line" and got[2].d.brief == "" and got[3].d is None


def test_slices_of_whole_multibyte_texts(spark):
    """Against Python on every pair of positions; cuts inside characters give null."""
    raw = "aé€😀z\n".encode()
    spans = [(a, b) for a in range(len(raw) + 1) for b in range(a, len(raw) + 1)]
    got = spark.createDataFrame([(raw, a, b) for a, b in spans], "b binary, s int, e int").select("s", "e", docs.doc_slice(F.col("b"), F.col("s"), F.col("e")).alias("p")).collect()

    def want(a, b):
        try:
            return raw[a:b].decode() if a and b else None
        except UnicodeDecodeError:
            return None

    assert {(r["s"], r["e"]): r["p"] for r in got} == {(a, b): want(a, b) for a, b in spans}


def test_text_slices_cover_whole_texts(spark, tiny):
    from symbolloom.plans import reference
    from symbolloom.session import table

    texts = {r["doc_id"]: r["text"] for r in table(spark, tiny, "documents").collect() if r["text"]}
    pieces = {}
    for r in reference.queries()["text_slices"](spark, tiny).collect():
        pieces.setdefault(r["doc_id"], {})[r["k"]] = r["piece"]
    whole = [i for i, t in texts.items() if t.isascii() and len(t) >= 16]
    assert whole and all("".join(pieces[i][k] for k in range(8)) == texts[i][1:] for i in whole)
    assert any(p is None for i, t in texts.items() if not t.isascii() for p in pieces[i].values())


def test_document_symbols_of_every_category(spark):
    maps = {"functions": {"f": {"kind": "stock", "returnType": "int"}}, "methodmaps": {"m": {"parent": "b", "methods": {"a": {"returnType": "void"}}, "properties": {"p": {"type": "int"}}}}, "enumstructs": {"s": {"fields": {"x": {"type": "char"}}}}, "constants": {"c": {}}, "defines": {"d": {"value": "1"}}, "enums": {"e": {"entries": {"y": {"value": "2"}}}}, "typesets": {"t": {"types": {"u": {"type": "v"}}}}, "typedefs": {"w": {"type": "z"}}}
    df = spark.createDataFrame([(1, json.dumps({"strands": {"s1": maps, "s2": {}}})), (2, "{"), (3, None)], "id bigint, body string")
    got = [tuple(r)[2:] for r in bundles.document_symbols(bundles.parse_bundles(df), "id").collect()]
    none = (None,) * 2
    assert sorted(got, key=str) == sorted([
        ("functions", "f", *none, "stock", "int", *none), ("methodmaps", "m", *none, *none, None, "b"), ("methodmaps", "m", "method", "a", None, "void", *none), ("methodmaps", "m", "property", "p", None, "int", *none),
        ("enumstructs", "s", *none, *none, *none), ("enumstructs", "s", "field", "x", None, "char", *none), ("constants", "c", *none, *none, *none), ("defines", "d", *none, *none, "1", None),
        ("enums", "e", *none, *none, *none), ("enums", "e", "entry", "y", *none, "2", None), ("typesets", "t", *none, *none, *none), ("typesets", "t", "type", "u", None, "v", *none), ("typedefs", "w", *none, None, "z", *none),
    ], key=str)


SYMBOLS = "bundle string, strand string, category string, name string, return_type string, arguments array<struct<type:string,name:string>>, members array<struct<kind:string,name:string,return_type:string,arguments:array<struct<type:string,name:string>>>>, created struct<count:bigint>"


def _symbols(spark):
    return spark.createDataFrame([
        ("b", "s", "functions", "Hook", "Hook", [("Hook", "a")], None, (3,)), ("b", "s", "methodmaps", "HookMap", None, None, [("method", "Hook", "Hook", [("int", "x")]), ("property", "Hook", None, None)], (5,)),
        ("b", "s", "enumstructs", "HookRec", None, None, [("method", "m", "Hook", None), ("field", "Hook", None, None)], (5,)), ("b", "s", "enums", "HookE", None, None, [("entry", "Hook", None, None)], (1,)),
        ("b", "s", "typedefs", "HookT", "Hook", [("Hook", "a")], None, None), ("b", "s", "typesets", "HookS", None, None, [("type", "sig", "Hook", [("Hook", "n")])], (9,)), ("b", "s", "constants", "Hook", None, None, None, (2,)), ("b", "t", "defines", "HOOK", None, None, None, (4,)), ("b", "t", "odd", "Hook", None, None, None, (9,)),
    ], SYMBOLS)


def test_search_rows_and_scores(spark):
    got = {("/".join(r["path"]), r["part"]): (r["name"], r["identifier"], round(r["score"], 6)) for r in search.search(_symbols(spark), "Hook", parents=["P"]).collect()}
    assert got == {
        ("P/s/function.Hook", 0): ("Hook", "function", 1.02), ("P/s/function.Hook/argument.a", 1): ("Hook", "function", 1.02), ("P/s/function.Hook/return.Hook", 2): ("Hook", "function", 1.02),
        ("P/s/methodmap.HookMap", 0): ("HookMap", "methodmap", 0.86), ("P/s/methodmap.HookMap/methodmap_method.Hook", 0): ("Hook", "methodmap_method", 1.05), ("P/s/methodmap.HookMap/methodmap_method.Hook/return.Hook", 2): ("Hook", "methodmap_method", 1.05), ("P/s/methodmap.HookMap/methodmap_property.Hook", 0): ("Hook", "methodmap_property", 1.05),
        ("P/s/enumstruct.HookRec", 0): ("HookRec", "enumstruct", 0.86), ("P/s/enumstruct.HookRec/enumstruct_method.m/return.Hook", 2): ("Hook", "enumstruct_method", 1.05), ("P/s/enumstruct.HookRec/enumstruct_field.Hook", 0): ("Hook", "enumstruct_field", 1.05),
        ("P/s/enumeration.HookE", 0): ("HookE", "enumeration", 0.84), ("P/s/enumeration.HookE/enumeration_entry.Hook", 0): ("Hook", "enumeration_entry", 1.03),
        ("P/s/typedef.HookT", 0): ("HookT", "typedef", 0.83), ("P/s/typedef.HookT/argument.a", 1): ("Hook", "argument", 1.03), ("P/s/typedef.HookT/return.Hook", 2): ("Hook", "return", 1.03),
        ("P/s/typeset.HookS", 0): ("HookS", "typeset", 0.83), ("P/s/typeset.HookS/entry.sig/argument.n", 1): ("n", "argument", 1.03), ("P/s/typeset.HookS/return.Hook", 2): ("Hook", "return", 1.03),
        ("P/s/constant.Hook", 0): ("Hook", "constant", 1.0), ("P/t/define.HOOK", 0): ("HOOK", "define", 0.9),
    }
    plain = search.search(_symbols(spark), "Hook", weighted=False, identifier="other", l1_only=True).collect()
    assert len(plain) == 10 and {r["identifier"] for r in plain if r["part"]} == {"other"}
    assert [r["score"] for r in search.ranked(search.search(_symbols(spark), "Hook"), 3).collect()] == sorted((r["score"] for r in search.search(_symbols(spark), "Hook").collect()), reverse=True)[:3]


def test_lookup_recent_empty_sitemap(spark):
    s = _symbols(spark)
    asked = [["s", "methodmap.HookMap", "methodmap_property.Hook"], ["s", "methodmap.HookMap", "function.Hook"], ["s", "methodmap.HookMap", "function.none"], ["s", "nothing.HookT", "x.y"], ["s", "enumeration.HookE", "entry.Hook"], ["none"], ["s", "enumstruct.HookRec", "field.Hook", "more"]]
    asked += [["s", "odd", "methodmap.HookMap"], ["s", "methodmap.HookMap", "odd"], ["s", "entry", "function.Hook"], None, ["s", None, "function.Hook"]]
    df = spark.createDataFrame([(i, "b", p) for i, p in enumerate(asked)] + [(99, "c", asked[0])], "i int, bundle string, path array<string>")
    got = {r["i"]: (r["found_category"], r["found_name"], r["found_member"]) for r in search.lookup(s, df).collect()}
    assert got == {0: ("methodmaps", "HookMap", "Hook"), 1: ("methodmaps", "HookMap", "Hook"), 2: ("methodmaps", "HookMap", None), 3: ("typedefs", "HookT", None), 4: ("enums", "HookE", None), 5: (None, None, None), 6: ("enumstructs", "HookRec", "Hook"), 7: ("methodmaps", "HookMap", None), 8: ("methodmaps", "HookMap", None), 9: (None, None, None), 10: (None, None, None), 11: ("functions", "Hook", None), 99: (None, None, None)}
    assert [r["name"] for r in search.recent_additions(s.where("category <> 'odd'"), 3).collect()] == ["HookS", "HookMap", "HookRec"]
    assert {r["strand"]: r["is_empty"] for r in search.empty_strands(s, s.where("category <> 'odd'")).collect()} == {"s": False, "t": True}
    urls = {r["loc"] for r in search.sitemap(s, "u", strands=spark.createDataFrame([("bare",), (None,)], "strand string")).collect()}
    own = {"function.Hook", "methodmap.HookMap", "methodmap.HookMap/function.Hook", "methodmap.HookMap/property.Hook", "methodmap.HookRec", "methodmap.HookRec/function.m", "methodmap.HookRec/field.Hook", "enum.HookE", "typedef.HookT", "typeset.HookS", "constant.Hook"}
    assert urls == {"u/s/", "u/t/", "u/bare/"} | {"u/s/" + p for p in own}
    assert "u/s/enumstruct.HookRec" in {r["loc"] for r in search.sitemap(s, "u", fix_labels=True).collect()}


def test_recents_are_fed_frozen_and_cleared(spark):
    rows = spark.createDataFrame([("b", "s", "methodmaps", "M", [("method", "m", (9,)), ("property", "p", (8,)), ("method", "n", None)], (5,)), ("b", "s", "functions", "f", None, (6,))], "bundle string, strand string, category string, name string, members array<struct<kind:string,name:string,created:struct<count:bigint>>>, created struct<count:bigint>")
    feed = search.recent_feed(rows)
    recents = search.Recents(2)
    recents.feed(feed)
    assert [(r["name"], r["member"]) for r in recents.held] == [("M", "m"), ("f", None)]
    recents.freeze()
    recents.feed(feed.withColumn("created", F.struct(F.lit(99).cast("bigint").alias("count"))))
    assert recents.held[0]["created"]["count"] == 9
    recents.freeze(False)
    assert recents.held is None
    recents.feed(feed.where("member is null"))
    recents.feed(feed.where("member = 'm'"))
    assert [r["name"] for r in recents.held] == ["M", "f"]


def test_index_and_strand_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    doc = lambda name, description: json.dumps({"meta": {"name": name, "description": description}, "source": {"type": "git", "repository": "r"}, "strands": {}})
    (folder / "a.bundle").write_text(doc("x", "old"))
    (folder / "b.bundle").write_text(doc("y", None))
    (folder / "bad.bundle").write_text("{")
    (folder / "c.json").write_text(doc("z", None))
    first, second = f"file://{tmp_path}/first", f"file://{tmp_path}/second"
    assert bundles.build_index(spark, f"file://{folder}", first) == 2
    assert {(r["name"], r["meta"]["description"], r["file_stem"]) for r in bundles.read_index(spark, first).collect()} == {("x", "old", "a"), ("y", None, "b")}
    assert bundles.build_index(spark, f"file://{folder}", second, known=first) == 0 and not (tmp_path / "second").exists()
    (folder / "a.bundle").write_text(doc("x", "new"))
    assert bundles.build_index(spark, f"file://{folder}", second, known=first) == 1
    assert {r["name"]: r["meta"]["description"] for r in bundles.read_index(spark, second).collect()} == {"x": "new", "y": None}

    strands = tmp_path / "strands"
    strands.mkdir()
    (strands / "one.json").write_text(json.dumps({"functions": [{"name": "f"}], "methodmaps": [{"name": "M", "methods": [{"name": "a"}], "properties": [{"name": "p"}]}], "enumstructs": [{"name": "E", "methods": [], "fields": [{"name": "x"}]}], "defines": [{"name": "D"}], "enums": [{"name": "N", "entries": [{"name": "e"}]}]}))
    (strands / "include.json").write_text(json.dumps({"functions": [{"name": "no"}]}))
    (strands / "empty.json").write_text("{}")
    bare, symbols = bundles.read_strands(spark, f"file://{strands}")
    got = {r["loc"] for r in search.sitemap(symbols, "u", strands=bare).collect()}
    assert got == {"u/one/", "u/empty/", "u/one/function.f", "u/one/methodmap.M", "u/one/methodmap.M/function.a", "u/one/methodmap.M/property.p", "u/one/methodmap.E", "u/one/methodmap.E/field.x", "u/one/enum.N"}


HISTORY = "bundle string, strand string, category string, name string, decl_ord bigint, h string, line bigint, version struct<hash:string,count:bigint,time:bigint>"


def _fold(rows):
    """Plain fold over a history: the behaviour the set query has to equal."""
    out, diffs = {}, 0
    for strand in {r[1] for r in rows}:
        state, seen = {}, False
        for rev in sorted({r[7][1] for r in rows if r[1] == strand}):
            now = {r[3]: r for r in rows if r[1] == strand and r[7][1] == rev}
            diffs += not seen
            seen = True
            state = {n: v for n, v in state.items() if n in now}
            for n, r in now.items():
                if n not in state:
                    state[n] = [rev, rev, r[5], r[6]]
                elif state[n][2] != r[5]:
                    state[n] = [state[n][0], rev, r[5], r[6]]
                    diffs += 1
        out |= {(strand, n): tuple(v) for n, v in state.items()}
    return out, diffs


def test_merge_random_histories(spark):
    rng = random.Random(6)
    rows = [("b", s, "f", n, 0, rng.choice("pq"), rng.randrange(99), ("h", rev, rev)) for s in "stuv" for rev in range(10) if rng.random() < 0.7 for n in "abcd" if rng.random() < 0.75]
    want, diffs = _fold(rows)
    df = spark.createDataFrame(rows, HISTORY)
    held = merge.held_rows(df, [F.col("h")], ["h", "line"])
    pick = lambda d: {(r["strand"], r["name"]): (r["created"]["count"], r["last_updated"]["count"], r["payload"]["h"], r["payload"]["line"]) for r in d.collect()}
    assert pick(merge.merge(held)) == want
    assert merge.diff_count(held).first()["diffs"] == diffs
    for cut in (0, 4, 8):
        prior = merge.merge(held.where(F.col("rev") <= cut))
        assert pick(merge.merge(held.where(F.col("rev") > cut), prior)) == want
    assert merge.merge(held.where("false")).count() == 0 and merge.diff_count(held.where("false")).first()["diffs"] == 0


def test_key_diff_and_retain_and_last_wins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), (None, 1)], "k string, d int")
    b = spark.createDataFrame([("x", 2), ("z", 1), (None, 1)], "k string, d int")
    assert sorted(tuple(r) for r in merge.key_diff(a, b, ["k"], "d").collect()) == [("x", "changed"), ("y", "deleted"), ("z", "new")]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c")], "k int, o int, v string")
    assert sorted(r["v"] for r in search.last_wins(rows, ["k"], ["o"]).collect()) == ["b", "c"]


def test_comment_attach(spark):
    decls = spark.createDataFrame([("f", 2), ("f", 5), ("f", 9), ("g", 2)], "file string, line bigint")
    comments = spark.createDataFrame([("f", 1, 1, 10, 20), ("f", 1, 1, 5, 8), ("f", 5, 5, 30, 40), ("f", 3, 3, 1, 2), ("f", 7, 7, 1, 2)], "file string, start_line bigint, end_line bigint, start bigint, end bigint")
    assert sorted(tuple(r) for r in search.attach_comments(decls, comments).collect()) == [("f", 2, 5, 8), ("f", 5, 30, 40), ("f", 9, 0, 0), ("g", 2, 0, 0)]


def test_catalogue(spark):
    row = lambda n, d, kind, stem: (n, (n, d, None), (kind, None, None, None, None), stem)
    ddl = f"name string, meta {bundles.META}, source {bundles.SOURCE}, file_stem string"
    prior = spark.createDataFrame([row("same", "d", "git", "a"), row("meta", "d", "git", "a"), row("src", "d", "git", "a"), row("gone", "d", "git", "a")], ddl)
    new = spark.createDataFrame([row("same", "d", "git", "b"), row("meta", "e", "git", "b"), row("src", "d", "direct", "b"), row("new", "d", "odd", "a"), row("new", "d", "odd", "c"), row(None, "d", "git", "a")], ddl)
    got = {r["name"]: (r["status"], r["file_stem"]) for r in catalogue.upsert(prior, new).collect()}
    assert got == {"same": ("kept", "a"), "meta": ("changed", "b"), "src": ("changed", "b"), "gone": ("kept", "a"), "new": ("new", "c")}
    assert {r["problem"] for r in catalogue.invalid_sources(new.where("name = 'new' or name = 'meta'")).collect()} == {"type", "repository"}


SOURCE = b'''/** file */
#include <x>
#define LIMIT (1 << 4) // four
/** Adds.
 * @param a first
 */
stock const int Add(int a, const char[] b = "x,y", any ...) { return a + (1); }
native Float:Old(Float:v, &n=3);
forward void OnIt()
enum { ONE = 1, TWO }
enum Color: { Red, /* c */ Green = view_as<int>(2), };
enum struct Rec { int a; char name[32]; int Get() { return this.a; } }
methodmap Map < Handle {
  public Map(int x);
  property int Size { public native get(); public native set(int v); }
  public native void Push(any v); // pushes
}
typedef Cb = function void (int a);
typeset Cbs { function int (int a); function void (); }
public Plugin myinfo = { name = "n", author = "a" };
int g_x = 5, g_y[3];
static int Last() { return 0; }
'''


def test_declarations():
    got = {(s["category"], s["name"]): s for s in declarations.parse(SOURCE)}
    assert set(got) == {("defines", "LIMIT"), ("functions", "Add"), ("functions", "Old"), ("functions", "OnIt"), ("constants", "ONE"), ("constants", "TWO"), ("enums", "Color"), ("enumstructs", "Rec"), ("methodmaps", "Map"), ("typedefs", "Cb"), ("typesets", "Cbs"), ("functions", "Last")}
    add = got["functions", "Add"]
    assert add["kind"] == "stock" and add["return_type"] == "int" and SOURCE[add["doc_start"] : add["doc_end"]].startswith(b"/** Adds.") and add["ref_line"] == 7
    assert [(a["type"], a["name"], a["default"]) for a in add["arguments"]] == [("int", "a", None), ("const char[]", "b", '"x,y"'), ("any", "...", None)]
    assert got["defines", "LIMIT"]["value"] == "(1 << 4)" and got["methodmaps", "Map"]["parent"] == "Handle"
    assert [(m["kind"], m["name"]) for m in got["methodmaps", "Map"]["members"]] == [("method", "Map"), ("property", "Size"), ("method", "Push")]
    size, push = got["methodmaps", "Map"]["members"][1:]
    assert (size["type"], size["getter"], size["setter"]) == ("int", True, True) and SOURCE[push["doc_start"] : push["doc_end"]] == b"// pushes"
    assert [(m["kind"], m["name"], m["type"]) for m in got["enumstructs", "Rec"]["members"]] == [("field", "a", "int"), ("field", "name", "char"), ("method", "Get", "int")]
    assert [(m["name"], m["value"]) for m in got["enums", "Color"]["members"]] == [("Red", None), ("Green", "view_as<int>(2)")]
    assert got["typedefs", "Cb"]["type"] == "function void (int a)" and [m["name"] for m in got["typesets", "Cbs"]["members"]] == ["function int (int a)", "function void ()"]


def test_expressions_in_one_spelling():
    """Expected texts written from the rules of the printer that has to be matched."""
    want = {
        "0x1F": "31", "0b101": "5", "0o17": "15", "1_000": "1000", "1.5": "1.500000", "2.0e3": "2000.000000", "'a'": "'a'", "'\\n'": "'\n'", '"x  y"': '"x  y"', "a+b*(c-1)": "a + b * c - 1", "-1": "-1", "a-1": "a - 1", "~x|!y": "~x | !y",
        "f( 1,g (2) )": "f(1, g(2))", "{1,2}": "{ 1, 2 }", "{}": "{}", "{0,...}": "{ 0, ... }", "a?b:c": "a ? b : c", "x[1].y": "x[1].y", "x++": "x++", "++x": "++x", "view_as< int >(2)": "view_as<int>(2)", "sizeof(x)": "sizeof(x)",
        "new Foo(1)": "new Foo(1)", "this.a=3": "this.a = 3", "1<<4": "1 << 4", "(1 << 2) /* c */": "1 << 2", "a==b&&c": "a == b && c", "(a)[1]": "a[1]", "x&-1": "x & -1",
    }
    from symbolloom.parser import expressions

    assert {k: expressions.render(*lexer.tokenize(k)) for k in want} == want
    add = {(s["category"], s["name"]): s for s in declarations.parse(b"enum X { A = 0x10, B = (1<<3) }\nnative int F(int a = 0xFF, float b=1.0, int c[] = {1,2});")}
    assert [m["value"] for m in add["enums", "X"]["members"]] == ["16", "1 << 3"] and [a["default"] for a in add["functions", "F"]["arguments"]] == ["255", "1.000000", "{ 1, 2 }"]


def test_declarations_of_anything():
    """Cut or garbled text gives some symbols or none, and never hangs or raises."""
    rng = random.Random(7)
    for _ in range(300):
        a = rng.randrange(len(SOURCE))
        list(declarations.parse(SOURCE[:a] + bytes(rng.randrange(256) for _ in range(rng.randrange(4))) + SOURCE[a + rng.randrange(9) :]))
    assert list(declarations.parse(b"")) == []


def test_lexer_covers_the_text():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice("ab1 \n\t\"'\\/*#<>=|{}()é\x00") for _ in range(rng.randrange(40)))
        tokens, kinds = lexer.tokenize(text)
        assert "".join(tokens) == text and len(tokens) == len(kinds)


def test_generate_and_documents(spark):
    v = lambda n: Row(hash=f"h{n}", count=n, time=n)
    rows = [("b", "s", v(1), b"// d\nnative int A();\nnative int B();"), ("b", "s", v(2), b"\n\n// d\nnative int A();\nnative int C();"), ("b", "s", v(3), b"// e\nnative int A();\nnative int C();")]
    files = spark.createDataFrame(rows, f"bundle string, strand string, version {bundles.BUNDLE.rsplit('version ', 1)[1]}, content binary")
    got = {r["name"]: (r["created"]["count"], r["last_updated"]["count"]) for r in generate.generate(files).collect()}
    assert got == {"A": (1, 3), "C": (2, 2)}
    prior = generate.generate(files.where("version.count < 2"))
    assert {r["name"]: (r["created"]["count"], r["last_updated"]["count"]) for r in generate.generate(files.where("version.count > 1"), prior).collect()} == got


def test_bundle_files(spark, tmp_path):
    symbols = _symbols(spark).where("category <> 'odd'").withColumn("kind", F.lit(None).cast("string")).withColumn("parent", F.lit(None).cast("string"))
    text = bundles.symbols_document(symbols).first()["json"]
    (tmp_path / "x.bundle").write_text(text)
    (tmp_path / "bad.bundle").write_text("{")
    got = bundles.read_bundle_files(spark, f"file://{tmp_path}")
    assert {r["file_stem"]: r["strands"] is None for r in got.collect()} == {"x": False, "bad": True}
    assert got.where("file_stem = 'x'").select(F.col("strands")["s"]["functions"]["Hook"]["arguments"][0]["name"]).first()[0] == "a"
    m = bundles.read_manifest(spark, '[meta]\nname = "n"\n[source]\ntype = "git"\nrepository = "r"\npatterns = ["*.inc"]').first()
    assert m["source"]["patterns"] == ["*.inc"]
    with pytest.raises(ValueError):
        bundles.read_manifest(spark, '[meta]\nname = "n"\n[source]\ntype = "git"\nrepository = "r"')
    bundles.write_sitemap(search.sitemap(symbols, "u"), f"file://{tmp_path}/map")
    assert "<loc>u/s/</loc>" in "".join(p.read_text() for p in (tmp_path / "map").glob("part*"))
    assert bundles.write_if_changed(symbols.select("name"), f"file://{tmp_path}/out", 0) is False


def test_git_history(spark, tmp_path):
    repo = str(tmp_path)

    def run(*args, when="1"):
        env = {"GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": repo}
        subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, env=env)

    run("init", "-q", "-b", "main")
    for i, (name, text) in enumerate([("a.inc", "1"), ("sub/b.inc", "2"), ("c.txt", "3"), ("a.inc", "4")]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", "m", when=str(1_000_000_000 + i))
    rows = git.history(spark, repo, ["*.inc"]).orderBy("rev_count").collect()
    assert [(r["rev_count"], r["stem"], bytes(r["content"])) for r in rows] == [(1, "b", b"2"), (3, "a", b"4")]  # the root is no single-parent commit
    assert [r["rev_count"] for r in git.history(spark, repo, [], from_time=1_000_000_002, content=False).orderBy("rev_count").collect()] == [2, 3]
    assert git.head_stems(repo, ["*.inc"]) == ["a", "b"] and git.open_repository(repo) == repo


def test_unreadable_files_go_to_a_table_of_their_own(spark):
    rows = [("b", "s", ("h", n, n), c) for n, c in enumerate([b"native int A();", b"native int B();\0", b"native int C(); // \xff", b"native int D(", None])]
    files = spark.createDataFrame(rows, f"bundle string, strand string, version {bundles.BUNDLE.rsplit('version ', 1)[1]}, content binary")
    valid = lambda content: content.endswith(b";")
    assert {(r["version"]["count"], r["error"]) for r in generate.failures_of(files, valid).collect()} == {(1, "ValueError"), (2, "UnicodeDecodeError"), (3, "SyntaxError")}
    assert [r["name"] for r in generate.symbols_of(files, valid).collect()] == ["A"]
    assert {r["version"]["count"] for r in generate.failures_of(files).collect()} == {1, 2}


def _blobs(spark, *contents):
    """Rows of blobs: versions of one file."""
    rows = [("b", f"h{n}", n, n, "a/s.inc", c) for n, c in enumerate(contents, 1)]
    return spark.createDataFrame(rows, "repo string, commit_hash string, rev_count bigint, rev_time bigint, path string, content binary")


def test_history_goes_on_behind_a_file_cut_within_a_typeset(spark):
    """A typeset's type ends before its arguments, where the file, the typeset or the type's semicolon ends."""
    types = lambda text: [m["name"] for s in declarations.parse(text) if s["category"] == "typesets" for m in s["members"]]
    assert types(b"typeset T\n{\n\tfunction void (int a);\n\tfunction bool") == ["function void (int a)", "function bool"]
    assert types(b"typeset T { function void } native int F(int a);") == ["function void"]
    assert types(b"typeset T { function void; function int (int a); };") == ["function void", "function int (int a)"]
    files = generate.file_versions(_blobs(spark, b"native int A();\ntypeset T { function void", b"native int A();\ntypeset T { function void (int a); };"))
    got = {r["name"]: (r["created"]["count"], r["last_updated"]["count"]) for r in generate.generate(files).collect()}
    assert got == {"A": (1, 1), "T": (1, 2)}


def test_generate_parses_once_and_compares_all_whatever_it_keeps(spark):
    files = generate.file_versions(_blobs(spark, b"\n// d\nnative int A();\nnative int B();", b"\n// e\nnative int A();\nnative int B();", b"\n// e\nnative int A();\nnative bool B();"))
    whole, slim = generate.generate(files), generate.generate(files, payload=["ref_line"])
    assert "MapInArrow" not in slim._jdf.queryExecution().toString()
    stamps = lambda df: {r["name"]: (r["created"]["count"], r["last_updated"]["count"]) for r in df.collect()}
    assert stamps(slim) == stamps(whole) == {"A": (1, 2), "B": (1, 3)}
    assert slim.schema["payload"].dataType.names == ["ref_line"] and whole.schema["payload"].dataType.names == generate.PAYLOAD


def test_includes_are_parsed_whole_beside_literals_that_stand_for_nothing(spark, tmp_path):
    """Codes of no character and numbers without digits stay as they are written; long numbers are numbers."""
    odd = [r"'\xD800'", r"'\xFFFFFFFF'", r"'\99999999999'", "0x_", "0b_", "7" * 5000]
    _blobs(spark, "enum E {{ {} }};\nnative int F(int a = '\\xDC00');".format(", ".join(f"A{i} = {t}" for i, t in enumerate(odd))).encode(), b"native int G(").write.parquet(f"{tmp_path}/blobs.parquet")
    entries = generate.symbols_of(generate.file_versions(spark.read.parquet(f"{tmp_path}/blobs.parquet"))).where("category = 'enums'").first()["members"]
    assert [m["value"] for m in entries] == odd
    rows = reference.queries()["parse_includes"](spark, str(tmp_path)).collect()
    assert {(r["rev"], r["name"]) for r in rows} == {(1, "E"), (1, "F"), (2, "G")}


def test_unreadable_includes_are_those_of_the_sql_whatever_is_cut_or_odd(spark, tmp_path):
    contents = [b"native int A();", b"native int B();\0", b"// \xff", b"typeset T { function bool", b"enum E { A = 0x_ };", b"native int F(int a = '\\xD800');", b"", b"typeset T { function void \xff", b"\xed\xa0\x80", "// é".encode()]
    _blobs(spark, *contents).write.parquet(f"{tmp_path}/blobs.parquet")
    got = reference.queries()["unreadable_includes"](spark, str(tmp_path))
    assert_same(got, str(tmp_path), reference.oracle_sql()["unreadable_includes"])
    assert {r["rev"] for r in got.collect()} == {2, 3, 8, 9}


def test_run_from_manifest_to_document(spark, tmp_path):
    """Walk, merge, keep what HEAD has, write; again from there; nothing without differences; the walk as a stream."""
    repo = tmp_path / "repo"
    repo.mkdir()
    clock = iter(range(1_000_000_000, 1_000_000_999))

    def run(*args):
        when = f"{next(clock)} +0000"
        subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(repo)})

    def commit(**files):
        for name, text in files.items():
            target = repo / f"{name}.inc"
            target.unlink() if text is None else target.write_text(text)
        run("add", "-A")
        run("commit", "-q", "--allow-empty", "-m", "m")

    run("init", "-q", "-b", "main")
    commit(root="native int Root();")
    commit(a="\n// one\nnative int A();\nnative int B();", gone="native int G();")
    commit(a="\n// two\nnative int A();", gone=None)
    manifest = '[meta]\nname = "n"\n[source]\ntype = "git"\nrepository = "r"\npatterns = ["*.inc"]'
    first, second, third = (f"file://{tmp_path}/{n}" for n in ("first", "second", "third"))
    assert generate.run(spark, manifest, str(repo), first) == 3  # two strands, one change
    read = lambda out: bundles.parse_bundles(spark.read.text(f"{out}/document").withColumnRenamed("value", "body")).select("bundle.*").first()
    doc = read(first)
    assert doc["meta"]["name"] == "n" and doc["source"]["patterns"] == ["*.inc"] and doc["version"]["count"] == 2 and set(doc["strands"]) == {"a"}
    a = doc["strands"]["a"]["functions"]["A"]
    assert set(doc["strands"]["a"]["functions"]) == {"A"} and (a["metadata"]["created"]["count"], a["metadata"]["last_updated"]["count"]) == (1, 2) and a["docs"]["brief"] == "two" and a["returnType"] == "int"
    assert generate.run(spark, manifest, str(repo), second, prior=first) == 0 and not (tmp_path / "second").exists()
    commit(a="\n// two\nnative float A();\nnative int C();", b="native int D();")
    assert generate.run(spark, manifest, str(repo), third, prior=first) == 2
    doc = read(third)
    stamps = {(s, n): (f["metadata"]["created"]["count"], f["metadata"]["last_updated"]["count"]) for s, v in doc["strands"].items() for n, f in v["functions"].items()}
    assert stamps == {("a", "A"): (1, 3), ("a", "C"): (3, 3), ("b", "D"): (3, 3)}

    spark.dataSource.register(git.GitHistory)
    seen = []

    def walk():
        stream = spark.readStream.format("git_history").option("path", str(repo)).option("patterns", "*.inc").load()
        keep = lambda batch, n: seen.extend((r["rev_count"], r["path"]) for r in batch.collect())
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/walk").trigger(availableNow=True).start().awaitTermination()

    walk()
    assert sorted(seen) == [(1, "a.inc"), (1, "gone.inc"), (2, "a.inc"), (3, "a.inc"), (3, "b.inc")]
    seen.clear()
    commit(b="native int E();")
    walk()
    assert seen == [(4, "b.inc")]


def test_stream_equals_batch(spark, tmp_path, tiny):
    from symbolloom.operators.snapshot_diff import symbol_attributes
    from symbolloom.session import table
    from symbolloom.streaming import merge_stream

    rows = table(spark, tiny, "snapshots").where("version.count is not null")
    folder = tmp_path / "in"
    for i, (low, high) in enumerate(((0, 5), (5, 20), (20, 10_000))):
        rows.where((F.col("version.count") >= low) & (F.col("version.count") < high)).coalesce(1).write.parquet(f"file://{folder}/{i}")
    import os

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(3):
        part = next(p for p in (folder / str(i)).iterdir() if p.suffix == ".parquet")
        target = flat / f"{i}.parquet"
        part.rename(target)
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    shown = []
    sink = merge_stream.MergeSink(spark, f"file://{tmp_path}/state", lambda state, number: shown.append(number))
    merge_stream.start(spark, f"file://{flat}", rows.schema, sink, f"file://{tmp_path}/ck").awaitTermination()
    want = merge.merge(merge.held_rows(rows, symbol_attributes(), merge_stream.PAYLOAD))
    pick = lambda d: sorted((r["bundle"], r["strand"], r["category"], r["name"], r["created"]["count"], r["last_updated"]["count"]) for r in d.collect())
    assert pick(sink.state()) == pick(want)
    before = sink.table.version()
    sink(rows, 0)  # a replayed batch
    assert sink.table.version() == before == 3 and shown[0] == 0
    last = rows.groupBy("bundle", "strand").agg(F.max("version.count").alias("m"))
    again = rows.join(last, ["bundle", "strand"]).where("version.count = m").drop("m").withColumn("version", F.struct(F.lit("h").alias("hash"), (F.col("version.count") + 1).alias("count"), F.col("version.time").alias("time")))
    many = len(shown)
    sink(again, 3)  # the same content again: kept, but no output
    assert sink.table.version() == 4 and len(shown) == many and pick(sink.state()) == pick(want)
