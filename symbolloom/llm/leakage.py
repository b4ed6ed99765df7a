"""Evaluation items that appear, wholly or partly or reworked, in a corpus (problem 9).

Every text, item or document, is canonicalised by itself: numbers, measures (digits with letters after them),
units and names become typed placeholders, each numbered by its first occurrence in the window. Windows of
``run`` words with equal canonical forms therefore differ by nothing but a one-to-one renaming of slot
values, which is the slot check. Windows are hash-joined: raw ones (equal words) and canonical ones.
A bitmap of the items' window hashes lets only candidates out of the documents' scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolloom.llm import textscan
from symbolloom.session import cut

NUMBER, MEASURE, NAME, UNIT = 1, 2, 3, 4
#: The bitmap has 2**BITS bits, whatever the items; more windows only let more candidates through.
BITS = 24
#: Items' windows up to this number are sent to every task of the join; more are joined by a shuffle.
SENT_WINDOWS = 1 << 20
_SEED = np.uint64(0x5851F42D4C957F2D)


def slot_types(rows: np.ndarray, start: np.ndarray, end: np.ndarray, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(type of each word or 0, whether a name may as well be the ordinary word that begins a sentence).

    A number has digits only, a measure digits and then letters. Any other word with a capital is a name. A
    unit is a word of letters without capitals right after a number. A sentence begins at the start of the
    text or after one of .!? and blanks. Nothing but the text itself is looked at.
    """
    count = lambda hit: np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])
    number = textscan.char_classes()[cps] == textscan.NUMBER
    upper = textscan.letter_cases()[cps] == textscan.UPPER
    digits, capitals = count(number), count(upper)
    turns = count(np.concatenate([number[:1], number[1:] != number[:-1]]) if len(cps) else number)
    n_digit, size, n_upper = digits[end] - digits[start], end - start, capitals[end] - capitals[start]
    kind = np.zeros(len(start), np.uint8)
    is_number = n_digit == size
    if not len(start):
        return kind, kind > 0
    before = np.concatenate([[False], is_number[:-1] & (rows[1:] == rows[:-1])])
    kind[before & (n_digit == 0) & (n_upper == 0)] = UNIT
    kind[n_upper > 0] = NAME
    kind[number[start] & (n_digit < size) & (turns[end] - turns[start + 1] == 1)] = MEASURE
    kind[is_number] = NUMBER
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13) & (cps != 11))
    solid = np.maximum.accumulate(np.where(blank, -1, np.arange(len(cps))))
    prior = np.where(start > 0, solid[start - 1], -1)
    first_of_row = prior < offsets[rows]
    begins = first_of_row | ((prior < start - 1) & np.isin(cps[np.maximum(prior, 0)], [ord(c) for c in ".!?"]))
    return kind, (kind == NAME) & begins & upper[start] & (n_upper == 1)


def _earlier(rows: np.ndarray, hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many words ago the same slot value occurred in the same row; 0 for the first and for other words."""
    out = np.zeros(len(rows), np.int64)
    slots = np.flatnonzero(kind)
    key = textscan.mix(hashes[slots] + kind[slots] * _SEED) ^ textscan.mix(rows[slots].astype(np.uint64) + _SEED)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out[slots[order[1:][same]]] = slots[order[1:][same]] - slots[order[:-1][same]]
    return out


@lru_cache(maxsize=8)
def _factors(size: int) -> np.ndarray:
    return textscan.mix(np.arange(1, size + 1, dtype=np.uint64) * _SEED) | np.uint64(1)


def canonical_windows(hashes: np.ndarray, rows: np.ndarray, kind: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the canonical forms of all windows with ``least`` words that are no slots and at least one that is; their rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ago = _earlier(rows, hashes, kind)
    code = textscan.mix(kind.astype(np.uint64) * _SEED)
    slot = kind > 0
    alone = np.where(slot, code, hashes)
    again = np.where(slot, textscan.mix(code + ago.astype(np.uint64)), hashes)
    total, literal = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j, f in enumerate(_factors(size)):
        at = slice(j, j + n)
        total += np.where((ago[at] > 0) & (ago[at] <= j), again[at], alone[at]) * f
        literal += ~slot[at]
    fine = (rows[:n] == rows[size - 1 :]) & (literal >= least) & (literal < size)
    return textscan.mix(total[fine] ^ _SEED), rows[:n][fine]


def _windows(col: pa.Array, run: int, least: int, bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hashes, whether raw) of the distinct windows of each slice that the bitmap lets through."""
    for first, _, data, offsets in textscan.slices(col):
        hashes, rows, start, end, cps = textscan.words(data, offsets)
        raw, at = textscan.windows(hashes, rows, run)
        kind, plain = slot_types(rows, start, end, cps, textscan.code_points(data, offsets)[1])
        found = [(rows[at], raw, np.ones(len(raw), bool))]
        for form in (kind, np.where(plain, np.uint8(0), kind)) if plain.any() else (kind,):
            canonical, own = canonical_windows(hashes, rows, form, run, least)
            found.append((own, canonical, np.zeros(len(own), bool)))
        own, hashes, is_raw = (np.concatenate(x) for x in zip(*found, strict=True))
        if bits is not None:
            top = hashes >> np.uint64(64 - BITS)
            go = (bits[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1) > 0
            own, hashes, is_raw = own[go], hashes[go], is_raw[go]
        _, one = np.unique(np.stack([own.astype(np.uint64), hashes], 1), axis=0, return_index=True) if len(own) else (None, np.zeros(0, np.int64))
        yield first + own[one], hashes[one], is_raw[one]


def windows(texts: DataFrame, id_col: str, text_col: str, run: int, least: int, bits=None) -> DataFrame:
    """(id_col, h, verbatim INT): the distinct windows of each text; with ``bits`` (a broadcast bitmap) those that it may hold."""
    id_type = texts.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else np.frombuffer(bits.value, np.uint64)
        for batch in batches:
            for own, hashes, is_raw in _windows(batch.column(1), run, least, known):
                if len(own):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(hashes.view(np.int64)), pa.array(is_raw.astype(np.int32))], names=[id_col, "h", "verbatim"])

    return texts.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {id_type}, h bigint, verbatim int")


def _bitmap(spark: SparkSession, held: DataFrame):
    """A broadcast bitmap of the leading bits of ``h``; at most 2**(BITS - 6) words come to the driver."""
    top = F.shiftrightunsigned("h", 64 - BITS)
    words = held.groupBy(F.shiftrightunsigned(top, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))")).alias("b")).collect()
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in words:
        out[r["w"]] = r["b"]
    return spark.sparkContext.broadcast(out.tobytes())


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 12, least: int = 6, id_col: str = "doc_id", text_col: str = "text", sent_windows: int = SENT_WINDOWS) -> DataFrame:
    """(id_col, item_id, verbatim INT): the items with which a text shares a window of ``run`` words.

    verbatim is 1 if some such window has equal words, else 0: then its numbers, measures, units and names are
    renamed one to one, and at least ``least`` of its words are none of these (a window of placeholders says
    nothing; equal words count however many of them are numbers). A capitalised word that begins a sentence
    is tried both as a name and as itself. Texts are scanned whole and once. Each text gives each window
    once, so a run of one template that fills a text costs no pairs. Items of any number and length are
    taken: the bitmap has a fixed size, and more than ``sent_windows`` windows are joined by a shuffle.
    Null and empty texts, and those of fewer than ``run`` words, match nothing; repeated item rows count
    once; null item ids give nothing. Windows are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    known = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    held = cut(windows(known, "item_id", "text", run, least).distinct())
    found = windows(docs, id_col, text_col, run, least, _bitmap(spark, held))
    other = held.select("item_id", "h")
    joined = found.join(F.broadcast(other) if held.count() <= sent_windows else other, "h")
    return joined.groupBy(id_col, "item_id").agg(F.max("verbatim").alias("verbatim"))
