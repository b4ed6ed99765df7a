"""Text operators: tokenisation, leakage, repetition; against other implementations and brute force."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from oracle import assert_same
from symbolloom.llm import leakage, lexicon, queries, repetition, sql, textscan, tokenize

WORD = regex.compile(r"[\p{L}\p{N}]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_words bigint, ids string"
ODD = "a's'tdrevlm \n\t'  LL1²٣._é中 İΣσς😀́\u0085\u00a0"


def _odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, tiny, name):
    assert_same(queries.queries()[name](spark, tiny), tiny, sql.oracle_sql()[name])


def test_words_are_those_of_plain_python():
    texts = [*_odd_texts(3000), "", "ΟΔΟΣ ΣΑΣ İstanbul İ", "x" * 1_200_000 + " end"]
    row = 0
    for first, end, data, offsets in textscan.slices(pa.array(texts)):
        hashes, rows, *_ = textscan.words(data, offsets)
        want = [(i, textscan.hash_points([ord(c) for c in w.lower()])) for i, t in enumerate(texts[first:end]) for w in WORD.findall(t)]
        assert list(zip(rows.tolist(), hashes.tolist(), strict=True)) == want
        assert first == row
        row = end
    assert row == len(texts)


def test_slices_of_nulls_and_views():
    col = pa.array(["skipped", None, "é", "", "b"]).slice(1)
    (first, end, data, offsets), = textscan.slices(col)
    assert (first, end, data.tobytes(), offsets.tolist()) == (0, 4, "éb".encode(), [0, 0, 2, 2, 3])
    assert list(textscan.slices(pa.array([], pa.string()))) == []


def test_transducer_holds_just_its_words():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(1, 7))): [rng.randrange(9) for _ in range(rng.randint(1, 3))] for _ in range(600)}
    arrays = lexicon.compile_words(words)
    asked = list(words) + [w + b"a" for w in words] + [w[:-1] for w in words] + [b"", b"\x00"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    stop = np.cumsum([len(w) for w in asked])
    rank = lexicon.look_up(arrays, data, stop - [len(w) for w in asked], stop)
    for w, r in zip(asked, rank.tolist(), strict=True):
        got = arrays["ids"][arrays["id_start"][r] : arrays["id_start"][r + 1]].tolist() if r >= 0 else None
        assert got == words.get(w)
    assert len(arrays["base"]) < sum(map(len, words))  # suffixes are shared
    assert lexicon.look_up(lexicon.compile_words({}), data, stop - [len(w) for w in asked], stop).max() == -1


def test_token_ids_equal_a_public_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [*_odd_texts(4000), "", None, "<|endoftext|> x", "don't we'll 'tis ''s 's", "   \n\n  a   ", "word " * 60_000, "a" * 3000]
    tok = Tokenizer.from_file(os.path.join(tokenize.TOKENIZERS, "byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, None, None, 1, "clash") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["ids"] for r in tokenize.token_ids(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (tok.encode(t, add_special_tokens=False).ids if t else []), t
    assert tokenize.token_ids(df.where("false")).collect() == []
    assert tokenize.token_ids(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_frequent_words_are_counted_over_all_texts(spark):
    """Words that just two of many texts hold are frequent words too; those with most and their ids are in the lexicon."""
    from pyspark import SparkFiles

    ranks_path = os.path.join(tokenize.TOKENIZERS, "byte_bpe_50k.tiktoken")
    pairs = [f"zq{a}{b}xv" for a in "abcdefgh" for b in "jklmnopq"]  # words that no vocabulary has
    rows = [(f"{i} " * (1 + i % 3),) for i in range(12_000)] + [(p,) for p in pairs] + [(p + "\n" + "x" * i,) for i, p in enumerate(pairs)] + [(None,)]
    texts = spark.createDataFrame(rows, "text string").repartition(5)
    arrays = lexicon.load(SparkFiles.get(tokenize.build_lexicon(spark, texts, ranks_path)))
    data = np.frombuffer("".join(pairs).encode(), np.uint8)
    stop = np.cumsum([len(p) for p in pairs])
    rank = lexicon.look_up(arrays, data, stop - [len(p) for p in pairs], stop)
    assert rank.min() >= 0
    merge = tokenize._encoding(ranks_path)[0]._encode_single_piece
    assert [arrays["ids"][arrays["id_start"][r] : arrays["id_start"][r + 1]].tolist() for r in rank] == [merge(p.encode()) for p in pairs]


def test_most_frequent_words_against_plain_counts(spark):
    from collections import Counter

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["rare", ""]
    counts = Counter(w.encode() for t in texts for w in regex.findall(tokenize.PATTERN, t))
    want = sorted(((-n, w) for w, n in counts.items() if n > 1))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(6)
    for most in (1, 20, 57, 10_000):
        assert [(-n, w) for w, n in tokenize.most_frequent(df, most)] == want[:most]
    assert tokenize.most_frequent(df.where("false"), 5) == []


def test_counts_that_are_handed_on_early_add_up(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(["a b a", "b", None])})] * 3
    whole = [(w, n) for b in tokenize._count_words(iter(batches)) for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True)]
    monkeypatch.setattr(tokenize, "COUNTED_WORDS", 1)
    parts = list(tokenize._count_words(iter(batches)))
    total = {}
    for b in parts:
        for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
            total[w] = total.get(w, 0) + n
    assert len(parts) == 4 and total == dict(whole) == {b"a": 3, b" b": 3, b" a": 3, b"b": 3}


def _w(t):
    return [x.lower() for x in WORD.findall(t or "")]


def test_leakage(spark):
    item = "In build 5206 the HookEvent callback resolves each signed spawn group within 30 seconds of a map change"
    other = "one two three four five six seven eight nine ten eleven twelve thirteen"
    swapped = item.replace("5206", "77").replace("HookEvent", "FreeEvent").replace("30", "12")
    texts = ["x " + item.upper().replace(" ", "--") + " y", " ".join(item.split()[:12]), " ".join(item.split()[:11]), swapped, item.replace("30", "5206"), None, "", other + " " + item, other + " " + other, "z"]
    docs = spark.createDataFrame([(i, t, None, None, 1, "") for i, t in enumerate(texts)], DOCS)
    items = spark.createDataFrame([(1, item), (1, item), (2, other), (3, None), (4, "short"), (5, item + " more FreeEvent")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in leakage.leaked_items(docs, items).collect()}
    assert {k for k, v in got.items() if v} == {(0, 1), (0, 5), (1, 1), (1, 5), (4, 1), (4, 5), (7, 1), (7, 2), (7, 5), (8, 2)}
    assert got[3, 1] == 0 == got[3, 5]
    assert leakage.leaked_items(docs.where("false"), items).count() == 0 == leakage.leaked_items(docs, items.where("false")).count()
    shuffled = leakage.leaked_items(docs, items, sent_windows=0)
    assert {(r["doc_id"], r["item_id"]): r["verbatim"] for r in shuffled.collect()} == got


def _leaks(spark, texts, items, run=12, least=6):
    docs = spark.createDataFrame([(i, t, None, None, 1, "") for i, t in enumerate(texts)], DOCS).repartition(3)
    held = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r["verbatim"] for r in leakage.leaked_items(docs, held, run=run, least=least).collect()}


def test_slots_must_be_renamed_one_to_one(spark):
    item = "the first 10 rows and then 10 cells of the open table"
    assert _leaks(spark, [item.replace("10", "4"), item.replace("10 rows", "4 rows"), item], [item]) == {(0, 0): 0, (2, 0): 1}


def test_names_and_units_that_no_item_has(spark):
    """Renamed names, numbers, measures and units are found, whatever they are; other words aren't renamed."""
    one = "Alice walks 12 miles from Leeds to the market where Bob sells apples for 3kg each and Alice pays"
    two = "The handler GetClientHealth returns the current value of the given slot and 30 seconds later GetClientHealth resets it"
    texts = [
        "Carol walks 7 kilometres from York to the market where Dave sells apples for 9g each and Carol pays", two.replace("GetClientHealth", "FetchPlayerArmor").replace("30 seconds", "5 frames"),
        "Carol walks 7 kilometres from York to the market where Carol sells apples for 9g each and Carol pays", two.replace("current", "former").replace("given", "taken").replace("GetClientHealth", "X"),
        "Later, alas. " + two.replace("The", "Then").replace("GetClientHealth", "A1") + ". The end", "so the " + two[4:].replace("GetClientHealth", "PlainName"), "we know that the handler" + two[11:].replace("GetClientHealth", "Other"),
    ]
    got = _leaks(spark, texts, [one, two], run=17, least=8)
    assert got == {(0, 0): 0, (1, 1): 0, (4, 1): 0, (5, 1): 0, (6, 1): 0}


def _template_leaks(docs, items, run, least):
    """Brute force over all pairs of windows of plain words."""

    def forms(text):
        found, number = [], False
        for m in WORD.finditer(text or ""):
            w = m[0]
            kind = "#" if regex.fullmatch(r"\p{N}+", w) else "%" if regex.fullmatch(r"\p{N}+\p{L}+", w) else "@" if regex.search(r"\p{Lu}", w) else "~" if number and regex.fullmatch(r"\p{L}+", w) else ""
            before = text[: m.start()]
            starts = not before.strip(" \t\n\f\r") or (before[-1:] in tuple(" \t\n\f\r") and before.rstrip(" \t\n\f\r")[-1:] in tuple(".!?"))
            found.append((w.lower(), kind, "" if kind == "@" and starts and regex.fullmatch(r"\p{Lu}[^\p{Lu}]*", w) else kind))
            number = kind == "#"
        return [[(w, (a, b)[f]) for w, a, b in found] for f in (0, 1)]

    out = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            for x in forms(text):
                for y in forms(item):
                    for a in range(len(x) - run + 1):
                        for b in range(len(y) - run + 1):
                            pairs = list(zip(x[a : a + run], y[b : b + run], strict=True))
                            if all(v[0] == w[0] for v, w in pairs):
                                out[d, i] = 1
                            if not all(v[1] == w[1] and (v[1] or v[0] == w[0]) for v, w in pairs) or sum(not v[1] for v, _ in pairs) < least:
                                continue
                            one = {(v, w) for v, w in pairs if v[1]}
                            if len({v for v, _ in one}) == len(one) == len({w for _, w in one}):
                                out.setdefault((d, i), 0)
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["aB", "ab", "Ab", "Cd.", "cd.", "CD", "De", "de", "7", "12", "4x", "rows", "cells", "the", "of", "!"]
    items = [" ".join(rng.choice(pool) for _ in range(rng.randrange(3, 9))) for _ in range(30)] + [None]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(3, 20))) for _ in range(120)] + [None, ""]
    want = _template_leaks(texts, items, 3, 1)
    assert _leaks(spark, texts, items, run=3, least=1) == want and {0, 1} == set(want.values())


def test_one_template_that_fills_texts_costs_no_pairs(spark):
    numbers = lambda a: " ".join(str(a + i) for i in range(6000))
    lines = lambda a: " ".join(f"line {a + i} holds the value of row number" for i in range(3000))
    assert _leaks(spark, [numbers(0), numbers(9000), lines(0), lines(5000), "0 " * 6000], [numbers(0), lines(0), "0 " * 6000]) == {(0, 0): 1, (2, 1): 1, (3, 1): 0, (4, 2): 1}


def _share(t):
    x, seen = _w(t), set()
    rep = [False] * len(x)
    for i in range(len(x) - 7):
        k = tuple(x[i : i + 8])
        if k in seen:
            rep[i : i + 8] = [True] * 8
        seen.add(k)
    return len(x), sum(rep)


def test_repetition_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b"]) if i % 3 else str(rng.randrange(200)) for _ in range(rng.randrange(90))) for i in range(150)]
    phrase = "one two three four five six seven eight"
    texts += [None, "", "  ", phrase, phrase + " " + phrase, "a " * 9, "a " * 8, (phrase + " ") * 3000 + "x " * 10, phrase + "\n" + phrase.upper()]
    df = spark.createDataFrame([(i, t, rng.choice(["en", "EN-us", " en ", None, ""]), rng.choice(["s", None]), 1, "") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in repetition.statistics(df).collect()}
    assert got == {i: _share(t) for i, t in enumerate(texts)}
    want = {i for i, (n, k) in got.items() if n and k * 10 >= 3 * n}
    assert {r["doc_id"] for r in repetition.repetitive(df).collect()} == want
    assert repetition.repetitive(df.where("false")).count() == 0


def test_repetition_where_most_of_a_group_repeats(spark):
    """The cut must not lose cases that are the rule in their group."""
    texts = ["one two three four five six seven eight " * (2 + i % 3) for i in range(40)] + [f"word{i} only once" for i in range(3)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "") for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in repetition.repetitive(df).collect()} == set(range(40))


def _stats(spark, vectors, group="en"):
    rows = [(i, group, "s", 1, 0, 0.0, *map(float, v)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "doc_id bigint, language string, origin string, n_words bigint, n_repeated bigint, share double, x0 double, x1 double, x2 double, x3 double")


def _robust(x, steps=4):
    """The estimate in numpy: squared distances of all rows."""

    def fit(rows, factor):
        return rows.mean(0), np.cov(rows.T, bias=True) * factor + repetition.RIDGE * np.eye(x.shape[1])

    def d2(m, c):
        y = x - m
        return (y @ np.linalg.inv(c) * y).sum(1)

    lower = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    off = np.abs(x - lower(x))
    found = []
    for d in ((off**2).sum(1), (off**2 / (2.2 * lower(off) ** 2 + repetition.RIDGE)).sum(1)):
        for _ in range(steps):
            m, c = fit(x[d <= lower(d)], 1.0)
            d = d2(m, c)
        found.append((np.linalg.det(c), d))
    d = min(found, key=lambda f: f[0])[1]
    return d2(*fit(x[d <= repetition.CHI2_975 * repetition.HALF], repetition.REWEIGHTED))


def test_estimate_against_numpy_and_rate_on_clean_data(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(size=(900, 4)) @ rng.normal(size=(4, 4)) * 3
    far = rng.normal(size=(200, 4)) * 0.5 + [40, -40, 30, 30]
    for x, known in ((clean, 900), (np.concatenate([clean, far]), 900), (np.zeros((7, 4)), 7)):
        got = {r["doc_id"]: (r["d2"], r["rejected"]) for r in repetition.robust(_stats(spark, x)).collect()}
        want = _robust(x)
        assert np.allclose([got[i][0] for i in range(len(x))], want, rtol=1e-6, atol=1e-9)
        assert all(got[i][1] for i in range(known, len(x)))
        assert sum(got[i][1] for i in range(known)) <= 0.05 * known and (known < 900 or sum(got[i][1] for i in range(known)) >= 0.01 * known)
    shuffled = repetition.robust(_stats(spark, clean[:50]), sent_groups=0).collect()
    assert np.allclose([r["d2"] for r in sorted(shuffled, key=lambda r: r["doc_id"])], _robust(clean[:50]))


def test_outliers_are_far_from_their_group(spark):
    rng = random.Random(4)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(80, 120))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "") for i, t in enumerate([*plain, "buy now cheap " * 40])], DOCS)
    got = {r["doc_id"]: (r["d2"], r["rejected"]) for r in repetition.outliers(df).collect()}
    assert got[120][1] and got[120][0] > max(d for i, (d, _) in got.items() if i != 120)
