"""General data problems on small fixtures: nulls, ties, repeats, empty tables, clashing columns, deep and looped trees."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from symbolloom.operators import hierarchy, history, incremental, nested, snapshot_diff

UPDATES = "bundle string, strand string, category string, name string, n bigint, r bigint, gone boolean, a string, b string, at string, state string, prior string, block int"


def _versions(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], UPDATES)  # at, state, prior and block clash with inner names
    out = history.versions(df, F.col("n"), [F.col("r")], F.col("gone"), [F.col("a"), F.col("b")])
    return sorted((r["name"], r["valid_from"], r["valid_to"]) for r in out.select("name", "valid_from", "valid_to").na.fill("NULL", ["name"]).collect())


def test_versions_rules(spark):
    k = ("b", "s", "c")
    rows = [
        (*k, "x", 1, 1, False, "p", None), (*k, "x", 2, 1, False, "p", None), (*k, "x", 3, 1, False, None, "p"), (*k, "x", 3, 0, False, "q", "q"),  # nothing, a swap with null, an older report
        (*k, "x", 5, 1, True, None, None), (*k, "x", 6, 1, True, None, None), (*k, "x", 7, 1, None, None, "p"), (*k, "x", None, 9, False, "z", "z"),
        (*k, None, 4, 1, False, "p", "p"), (*k, None, 4, 1, False, "p", "p"),  # a null name, a repeated row
        (*k, "d", 2, 1, True, "p", "p"),  # only deleted
    ]
    assert _versions(spark, rows) == [("NULL", 4, -1), ("x", 1, 3), ("x", 3, 5), ("x", 7, -1)]


def test_versions_empty(spark):
    assert _versions(spark, []) == []


def test_versions_random_against_fold(spark):
    rng = random.Random(4)
    rows = [("b", "s", "c", rng.choice("uvw"), rng.randrange(40), rng.randrange(5), rng.random() < 0.2, rng.choice(["p", "q", None]), None) for _ in range(400)]
    held = {}
    for r in rows:
        key = (r[3], r[4])
        if key not in held or r[5] > held[key][0][5]:
            held[key] = [r]
        elif r[5] == held[key][0][5]:
            held[key].append(r)
    rows = [r for r in rows if len(held[(r[3], r[4])]) == 1]  # without ties of unequal rows
    want = []
    for name in "uvw":
        before, current = None, None
        for _, r in sorted((c, held[(n, c)][0]) for n, c in held if n == name and len(held[(n, c)]) == 1):
            if r[6]:
                if current is not None:
                    want.append((name, current, r[4]))
                current = None
            elif before is None or before[6] or before[7] != r[7]:
                if current is not None:
                    want.append((name, current, r[4]))
                current = r[4]
            before = r
        if current is not None:
            want.append((name, current, -1))
    assert _versions(spark, rows) == sorted(want)


def test_only_changed_leaves_are_descended(spark):
    """A key that is written again without a change moves no tree; one that changes and turns back does."""
    rows = [(k, b, None if b == 3 else b + 1, m, 7 + k, 9 + k) for k in range(200) for b, m in ((0, 0), (1, 0), (2, int(k == 5)), (3, 0))]
    rows = [r if r[:2] != (8, 3) else (*r[:4], 1, 2) for r in rows]
    ends = spark.createDataFrame([(*r, r[0] % 16, r[0] // 16) for r in rows], "k1 bigint, block int, next int, moved int, s1 bigint, s2 bigint, branch int, leaf int")
    assert sorted(tuple(r) for r in history._differing(ends).where("block > 0").collect()) == [(2, 5, 0), (3, 8, 0)]
    assert history._differing(ends).where("block = 0").count() == len({(k % 16, k // 16) for k in range(200)})


def test_versions_of_a_hot_key_over_many_blocks(spark, monkeypatch):
    from symbolloom.operators import blocked

    monkeypatch.setattr(blocked, "BLOCK_ROWS", 8)
    rows = [("b", "s", "c", "hot", n, 1, n % 50 == 49, "pq"[n // 7 % 2], None) for n in range(600)]
    want, before = [], None
    for n in range(600):
        gone, a = n % 50 == 49, "pq"[n // 7 % 2]
        if want and want[-1][2] == -1 and (gone or a != before):
            want[-1] = (*want[-1][:2], n)
        if not gone and (before is None or a != before):
            want.append(("hot", n, -1))
        before = None if gone else a
    assert _versions(spark, rows) == want


def _tree(spark, links):
    df = spark.createDataFrame(links, "tree string, name string, parent string")
    return {(r["tree"], r["name"]): r for r in hierarchy.hierarchy(df).collect()}


def test_hierarchy_small(spark):
    got = _tree(spark, [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "a"), ("t", "e", "gone"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "x"), ("t", "q", "z"), ("t", "s", "s"), ("u", "b", "a"), (None, "n", None)])
    short = {k: (r["root"], r["depth"], r["path"], r["below"], r["state"]) for k, r in got.items()}
    assert short == {
        ("t", "a"): ("a", 0, "a", 3, "tree"), ("t", "b"): ("a", 1, "a/b", 1, "tree"), ("t", "c"): ("a", 2, "a/b/c", 0, "tree"), ("t", "d"): ("a", 1, "a/d", 0, "tree"), ("t", "e"): ("e", 0, "e", 0, "tree"),
        ("t", "x"): ("", -1, "", -1, "on_cycle"), ("t", "y"): ("", -1, "", -1, "on_cycle"), ("t", "z"): ("", -1, "", -1, "below_cycle"), ("t", "q"): ("", -1, "", -1, "below_cycle"), ("t", "s"): ("", -1, "", -1, "on_cycle"),
        ("u", "b"): ("b", 0, "b", 0, "tree"),
    }
    assert _tree(spark, []) == {}


def test_hierarchy_random_and_deep(spark):
    rng = random.Random(1)
    links = [("r", str(i), str(rng.randrange(i)) if i and rng.random() < 0.97 else None) for i in range(300)] + [("deep", str(i), str(i - 1) if i else None) for i in range(70)]
    got, parent = _tree(spark, links), {(t, n): p for t, n, p in links}
    below = dict.fromkeys(parent, 0)
    for t, n in parent:
        line, at = [n], n
        while parent[(t, at)] is not None:
            at = parent[(t, at)]
            line.append(at)
            below[(t, at)] += 1
        r = got[(t, n)]
        assert (r["root"], r["depth"], r["path"], r["state"]) == (line[-1], len(line) - 1, "/".join(reversed(line)), "tree")
    for k, n in below.items():
        inside = {x for x, r in got.items() if x[0] == k[0] and r["root"] == got[k]["root"] and got[k]["first"] <= r["first"] <= got[k]["last"]}
        assert got[k]["below"] == n == len(inside) - 1


def test_declared_takes_the_latest(spark):
    rows = [(1, "b", " m ", " p", (1,)), (2, "b", "m", "q ", (3,)), (3, "b", "m", "r", (3,)), (4, "b", None, "p", (9,)), (5, "b", "k", "  ", None)]
    df = spark.createDataFrame(rows, "map_id bigint, bundle string, name string, parent string, version struct<count:bigint>")
    assert sorted((r["name"], r["parent"]) for r in hierarchy.declared(df).collect()) == [("k", None), ("m", "r")]


SNAP = "bundle string, strand string, category string, name string, decl_ord bigint, v string, version struct<count:bigint>, sign int, bucket int"


def _changes(spark, rows):
    df = spark.createDataFrame([(*r[:6], (r[6],), 1, 1) for r in rows], SNAP)
    return sorted((r["strand"], r["name"] or "NULL", r["rev_count"], r["change"]) for r in snapshot_diff.changes(df, [F.col("v")]).collect())


def test_snapshot_changes(spark):
    rows = [("b", "s", "f", n, 1, v, c) for c, content in ((1, "a1 b1"), (2, "a1 b2 c1"), (5, "b2"), (6, "a1 b2")) for n, v in content.split() and [tuple(x) for x in content.split()]]
    rows += [("b", "s", "f", "b", 0, "9", 2), ("b", "s", "f", "b", 1, "2", 2), ("b", "s", "f", "z", 1, "1", None), (None, "s", "f", "z", 1, "1", 2)]  # an overruled row, a repeated one, no version, no bundle
    rows += [("b", "t", "f", None, 1, None, 1), ("b", "t", "f", None, 1, "", 2), ("b", "u", "f", "only", 1, "1", 1)]
    assert _changes(spark, rows) == [("s", "a", 5, "removed"), ("s", "a", 6, "added"), ("s", "b", 2, "changed"), ("s", "c", 2, "added"), ("s", "c", 5, "removed"), ("t", "NULL", 2, "changed")]
    assert _changes(spark, []) == []


def test_snapshot_changes_of_everything_and_of_large_strands(spark):
    """More differences than one table can hold, and a strand that needs several buckets."""
    rng = random.Random(2)
    state, rows, want = {str(i): 0 for i in range(700)}, [], []
    for rev in range(4):
        if rev:
            for n in list(state):
                p = rng.random()
                if p < 0.3:
                    del state[n]
                    want.append(("big", n, rev, "removed"))
                elif p < 0.7:
                    state[n] += 1
                    want.append(("big", n, rev, "changed"))
            for i in range(100):
                state[f"{rev}-{i}"] = 0
                want.append(("big", f"{rev}-{i}", rev, "added"))
        rows += [("b", "big", "f", n, 0, str(v), rev) for n, v in state.items()]
    assert _changes(spark, rows) == sorted(want)


def test_snapshot_changes_of_a_strand_with_many_snapshots(spark, monkeypatch):
    """The strand is cut into blocks of snapshots; every snapshot is still compared with the one before."""
    monkeypatch.setattr(snapshot_diff, "BLOCK_ROWS", 50)
    rows = [("b", "s", "f", f"k{i}", 0, str(n // 3 if i == 1 else 0), n * 2) for n in range(2000) for i in range(3) if i or n % 5]
    want = [("s", "k0", n * 2, "removed" if n % 5 == 0 else "added") for n in range(1, 2000) if n % 5 in (0, 1)]
    want += [("s", "k1", n * 2, "changed") for n in range(3, 2000, 3)]
    assert _changes(spark, rows) == sorted(want)


def test_symbol_attributes_keep_nulls_and_sets_apart(spark):
    ddl = "k int, docs struct<brief:string,tags:array<struct<tag:string,text:string>>>, kind string, return_type string, parent string, arguments array<struct<type:string>>, members array<struct<kind:string,name:string>>"
    a = [(0, None, None, "x", None, None, [("m", "a"), ("m", "b")]), (1, None, None, "x", None, None, [("m", "b"), ("m", "a"), ("m", "a")]), (2, None, "x", None, None, None, [("m", "a"), ("m", "b")]), (3, None, None, "x", None, [], [("m", "a"), ("m", "b")]), (4, ("", None), None, "x", None, None, [("m", "a"), ("m", "b")])]
    texts = [r[0] for r in spark.createDataFrame(a, ddl).orderBy("k").select(*snapshot_diff.symbol_attributes()).collect()]
    assert texts[0] == texts[1] and len(set(texts)) == 4


def _run(spark, runs, deliveries):
    at = lambda x: None if x is None else dt.datetime(2020, 1, 1) + dt.timedelta(hours=x)
    r = spark.createDataFrame([(b, i, at(t), not bad) for b, i, t, *bad in runs], "bundle string, run_id bigint, started_at timestamp_ntz, ok boolean")
    d = spark.createDataFrame([(i, b, s, at(t), 7, 7) for i, b, s, t in deliveries], "delivery_id bigint, bundle string, sha string, delivered_at timestamp_ntz, run_id bigint, started_at bigint")
    return sorted(tuple(x) for x in incremental.deltas(d, r, "bundle", "delivered_at", "delivery_id", ["bundle", "sha"]).collect())


def test_incremental_rules(spark):
    runs = [("b", 1, 10), ("b", 2, 20), ("b", 3, 20), ("c", 4, 5)]
    deliveries = [(1, "b", "x", 10), (2, "b", "y", 11), (3, "b", "x", 12), (4, "b", "z", 20), (5, "b", "w", 21), (6, "c", "x", 1), (7, None, "x", 1), (8, "c", None, 2), (9, "c", None, 3), (64, "b", "v", 2), (128, "b", "v", 2), (10, "d", "x", 1), (11, "c", "q", None)]
    assert _run(spark, runs, deliveries + deliveries[:2]) == [(1, 1), (1, 64), (2, 2), (2, 4), (4, 6), (4, 8)]
    assert _run(spark, [], deliveries) == [] == _run(spark, runs, [])
    # a failed run leaves its records to the next one that succeeds; one ok row makes a run succeed
    assert _run(spark, [("b", 1, 10, "failed"), ("b", 2, 10), ("b", 5, 15, "failed"), ("b", 6, 20, "failed"), ("b", 6, 20), ("b", 9, 30, "failed"), (None, 7, 10)], deliveries) == [(2, 1), (2, 64), (6, 2), (6, 4)]
    assert _run(spark, [("b", 1, 10, "failed")], deliveries) == []


def test_incremental_random_against_a_loop(spark):
    rng = random.Random(11)
    runs = [(rng.choice("bcd"), i, rng.randrange(40), *(["failed"] * (rng.random() < 0.4))) for i in range(30)]
    deliveries = [(i, rng.choice("bcd"), rng.choice("xyzuvw"), rng.randrange(45)) for i in range(120)]
    want, seen = [], set()
    for i, b, s, t in sorted(deliveries, key=lambda d: (d[3], d[0])):
        if (b, s) not in seen:
            seen.add((b, s))
            later = sorted((r[2], r[1]) for r in runs if r[0] == b and len(r) == 3 and r[2] >= t)
            want += [(later[0][1], i)] if later else []
    assert _run(spark, runs, deliveries) == sorted(want)


def test_manifest_table_survives_failures(spark, tmp_path):
    from symbolloom.sources.manifest_table import ManifestTable, run_increment

    source, sink = ManifestTable(spark, f"file://{tmp_path}/a", "k"), ManifestTable(spark, f"file://{tmp_path}/b", "k")
    assert run_increment(source, sink, lambda d: d) is None
    source.append(spark.range(5).withColumnRenamed("id", "k"))
    source.append(spark.range(5, 8).withColumnRenamed("id", "k"))
    assert run_increment(source, sink, lambda d: d) == 1

    def fails(delta):
        raise OSError("lost")

    source.append(spark.range(8, 9).withColumnRenamed("id", "k"))
    source.delete(spark.range(2, 4).withColumnRenamed("id", "k"))
    try:
        run_increment(source, sink, fails)
    except OSError:
        pass
    assert sink.version() == 1 and sink.manifest().processed == 2
    seen = []
    run_increment(source, sink, lambda d: (seen.extend((r["k"], r["_change"]) for r in d.collect()), d)[1])
    assert sorted(seen) == [(2, "removed"), (3, "removed"), (8, "added")]
    assert sink.manifest().processed == 4 and run_increment(source, sink, fails) is None
    assert sorted(r["k"] for r in source.read().collect()) == [0, 1, 4, 5, 6, 7, 8]
    try:
        source._commit(2, [{}])
        raise AssertionError("committed twice")
    except RuntimeError:
        pass


def test_manifest_table_removals_and_spans(spark, tmp_path):
    from symbolloom.sources.manifest_table import ManifestTable

    t = ManifestTable(spark, f"file://{tmp_path}/t", "k")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k bigint")
    assert t.read() is None and t.changes(0) is None and t.deltas([(1, 0, 5, "")], "run") is None
    t.append(rows(1, 2))
    first = list(t.manifest().files)
    t.append(rows(3, None), remove=first)
    t.delete(rows(3))
    got = lambda d: sorted((r["_change"], r["k"] or 0) for r in d.collect())
    assert got(t.changes(1)) == [("added", 0), ("removed", 1), ("removed", 2)] and got(t.changes(2)) == [("removed", 3)] and t.changes(3) is None
    assert [r["k"] for r in t.read().collect()] == [None] and sorted(r["k"] for r in t.read(1).collect()) == [1, 2]
    many = spark.createDataFrame([(0, 10), (0, 11), (2, 12)], "v int, k bigint")
    assert t.append_versions(many, [{"scope": "a"}, {"scope": "b"}, {"scope": "a"}], "v", many.where("k = 11")) == 6
    spans = t.deltas([(1, 3, 4, "a"), (2, 4, 6, "a"), (3, 3, 6, "b")], "run").collect()
    assert sorted((r["run"], r["k"]) for r in spans) == [(1, 10), (2, 12)]
    assert sorted(r["k"] or 0 for r in t.read().collect()) == [0, 10, 12]
    assert t.vacuum(1) == 0 and t.vacuum(6) == 1 and t.vacuum(6) == 0 and sorted(r["k"] or 0 for r in t.read().collect()) == [0, 10, 12]


BAD = ['', ' ', '{', '{"a":1,}', '[1,]', '{"a" 1}', '{"a":}', '{a:1}', '"x', '"\\x"', '"\\u12g4"', '01', '1.', 'nul', '{"a":1}}', '{} {}', '[1 2]', '{"a":1 "b":2}', '["a":1]', '{"a","b"}', '"\t"', '[}', '{]', ',', ':', '{"a":1,,"b":2}', "'a'", '{"strands":{"s":NaN}}', '"\\', '{"a":"\\"}']
GOOD = ['{}', '[]', '1', '-0.5e+3', '"x"', 'null', ' [1, {"a": []}, "\\u00e9\\n\\\\"] ', '{"a":{"b":[[],{}]},"c":"{[,:"}', '"\\\\\\""', '{"é":"ü"}']


def test_structural_index_decides_as_a_json_parser():
    def refuse(x):
        raise ValueError(x)

    for text in BAD + GOOD:
        try:
            json.loads(text, parse_constant=refuse)
            valid = True
        except ValueError:
            valid = False
        assert nested.Index(text.encode()).valid == valid == (text in GOOD), text


def test_structural_index_on_mutations():
    rng = random.Random(3)
    base = json.dumps({"strands": {"s\"\\": {"functions": {"f": {"arguments": [{"a": [1, -2.5e3, None, True]}, []], "docs": {"tags": ["x", {}]}}}}}, "é": " \n"})
    for _ in range(1500):
        text = list(base)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(text))
            text[i : i + rng.randint(0, 1)] = rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "1", " ", "e", ""])
        text = "".join(text)
        try:
            json.loads(text)
            valid = True
        except ValueError:
            valid = False
        assert nested.Index(text.encode()).valid == valid, text


def test_flatten(spark):
    fn = {"name": "f", "docs": {"brief": "b", "tags": [{"tag": "param", "text": None}, {}]}, "arguments": [{"type": "int"}], "x_origin": {"arguments": [1, 2]}}
    doc = {"strands": {"s": {"functions": {"f": fn, "g": {"arguments": None, "docs": None}, "h": 5}, "methodmaps": {"M\"q": {"methods": {"m": fn}, "arguments": [1], "properties": None}}, "typedefs": {"T": {"parsedSignature": {"arguments": [1, 2]}}}, "odd": {"f": fn}, "enums": None}, "empty": {}}, "x": [1]}
    rows = [(1, json.dumps(doc)), (2, None), (3, "{"), (4, ""), (5, "[]"), (6, json.dumps(doc)), (7, json.dumps({"strands": []}))]
    out = nested.flatten(spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, body string, level string"))
    got = [tuple(r) for r in out.collect()]
    items = sorted(r[1:-1] for r in got if r[0] == 1 and r[1] == "item")
    path = ("s", "functions", "f", "", ""), ("s", "methodmaps", "M\"q", "methods", "m"), ("s", "typedefs", "T", "", "")
    assert items == sorted(("item", *p, kind, i) for p, kind, n in ((path[0], "tag", 2), (path[0], "argument", 1), (path[1], "tag", 2), (path[1], "argument", 1), (path[2], "argument", 2)) for i in range(n))
    assert sorted(r[1:] for r in got if r[0] == 1) == sorted(r[1:] for r in got if r[0] == 6) and {r[0] for r in got} == {1, 6}
    assert json.loads(next(r for r in got if r[1] == "symbol" and r[4] == "f")[-1]) == fn
    assert nested.flatten(spark.createDataFrame([], "file_id bigint, body string")).count() == 0
