"""Token ids of a whole corpus by a public byte-level BPE vocabulary (problem 8).

Texts are cut into words by the vocabulary's split pattern, evaluated on character-class arrays; a
minimal acyclic transducer (lexicon.py) that holds the vocabulary's own words and the frequent words of
the corpus gives their ids; the words it lacks are merged exactly. Null and empty texts give [].
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolloom.llm import lexicon, textscan
from symbolloom.session import Stored, ensure_checkpoint_dir

TOKENIZERS = "/opt/tokenizers"
#: The split pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_WORDS = 100_000
#: So many different words are counted at once in a task; their counts are handed on then, and added up by the shuffle.
COUNTED_WORDS = 200_000


@lru_cache(maxsize=2)
def _encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words of a slice begin (with the end appended), and each word's row.

    The pattern's rules on runs of one class: a run of letters, of digits or of other characters takes one
    space before it; white space before a run keeps all but its last character as one word, and that last
    one, unless it is such a space, as another; an apostrophe that begins a run of its own takes a
    contraction after it.
    """
    cps, rows = textscan.code_points(data, offsets)
    n = len(cps)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    kinds = textscan.char_classes()[cps]
    first = np.zeros(n + 1, bool)  # of a run
    first[1:-1] = kinds[1:] != kinds[:-1]
    first[rows] = True
    space, row_start = kinds == textscan.SPACE, np.zeros(n + 1, bool)
    row_start[rows] = True
    begins = first.copy()
    after_space = np.zeros(n + 1, bool)  # a run of other than space that has white space before it in its row
    after_space[1:-1] = first[1:-1] & ~space[1:] & space[:-1] & ~row_start[1:-1]
    after = np.flatnonzero(after_space)
    begins[after - 1] = True  # the last white space is apart from those before it
    takes = after[cps[after - 1] == 0x20]
    begins[takes] = False
    # contractions
    quote = np.flatnonzero((cps == 0x27) & begins[:-1] & first[:-1] & first[1:] & ~row_start[1:])
    quote = quote[quote + 1 < n]
    if len(quote):
        a = cps[quote + 1]
        b = cps[np.minimum(quote + 2, n - 1)]
        has_b = (quote + 2 < n) & ~row_start[np.minimum(quote + 2, n)]
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = has_b & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for q, length in ((quote[one], 2), (quote[two & ~one], 3)):
            begins[q + 1] = False
            rest = q + length
            rest = rest[(rest < n) & ~first[np.minimum(rest, n)]]
            begins[rest] = True
    begins[n] = True
    at = np.flatnonzero(begins)
    row = np.searchsorted(rows, at[:-1], side="right") - 1
    if len(cps) != len(data):
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), dtype=np.int64)])[at]
    return at, row


class Encoder:
    """Ids of words: from the transducer, else by exact merges, of which the latest are remembered."""

    def __init__(self, ranks_path: str, lexicon_path: str) -> None:
        self.merge = _encoding(ranks_path)[0]._encode_single_piece
        self.arrays = lexicon.load(lexicon_path)
        self.memo: dict[bytes, list[int]] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the number of ids of each row."""
        at, row = split(data, offsets)
        start, end = at[:-1], at[1:]
        rank = lexicon.look_up(self.arrays, data, start, end)
        id_start, ids = self.arrays["id_start"], self.arrays["ids"]
        missing = np.flatnonzero(rank < 0)
        known = np.maximum(rank, 0)
        lengths = (id_start[known + 1] - id_start[known]).astype(np.int64) if len(ids) else np.zeros(len(rank), np.int64)
        pieces: list[list[int]] = []
        if len(missing):
            raw, memo = data.tobytes(), self.memo
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True):
                word = raw[a:b]
                got = memo.get(word)
                if got is None:
                    got = memo[word] = self.merge(word)
                pieces.append(got)
            lengths[missing] = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stop = np.cumsum(lengths)
        source = np.where(rank < 0, 0, id_start[known] if len(ids) else 0) - (stop - lengths)
        place = np.arange(stop[-1] if len(stop) else 0) + np.repeat(source, lengths)
        if len(missing):
            extra = np.fromiter((i for p in pieces for i in p), np.int32, int(lengths[missing].sum()))
            own = np.repeat(rank < 0, lengths)
            out = np.empty(len(place), np.int32)
            out[own] = extra
            out[~own] = ids[place[~own]]
        else:
            out = ids[place]
        counts = np.bincount(row, weights=lengths, minlength=len(offsets) - 1).astype(np.int64) if len(row) else np.zeros(len(offsets) - 1, np.int64)
        return out, counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of all words; a word has several rows where more than COUNTED_WORDS are in hand at once."""
    counts: Counter[bytes] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for _, _, data, offsets in textscan.slices(batch.column(0)):
            at, _ = split(data, offsets)
            raw = data.tobytes()
            bounds = at.tolist()
            counts.update(raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False))
            if len(counts) > COUNTED_WORDS:
                yield counted()
                counts.clear()
    yield counted()


def most_frequent(texts: DataFrame, max_words: int) -> list[tuple[bytes, int]]:
    """(word, how often) of the ``max_words`` most frequent words of all texts, counted exactly, of those that occur twice at least.

    Of words that are as frequent the first by their bytes are taken. Words below a count that enough others
    reach are left out before the sort, so that one task can end it.
    """
    counts = texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    stored = Stored(counts)
    rounded = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 5, 0)), greatest(length(bin(n)) - 5, 0))")  # five binary digits are kept
    least, words = 0, 0
    for r in sorted(stored.df.groupBy(rounded.alias("n")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):  # at most 16 a binary digit
        least, words = r["n"], words + r["words"]
        if words >= max_words:
            break
    found = stored.df.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(max_words).coalesce(1).collect()  # at most max_words
    stored.drop()
    return [(bytes(r["word"]), r["n"]) for r in found]


def build_lexicon(spark: SparkSession, texts: DataFrame, ranks_path: str, max_words: int = 30_000) -> str:
    """Compiles the transducer and gives the name by which executors get its file.

    It holds every vocabulary entry that is a word by itself, and the ``max_words`` most frequent words of all
    ``texts``, counted exactly (ties by the word). The counts only decide which words are fast; every text is
    encoded whole and alike. ``texts`` has one column, ``text``.
    """
    import regex

    encoding, ranks = _encoding(ranks_path)
    whole, pairs = regex.compile(PATTERN), {}
    for token, rank in ranks.items():
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if (m := whole.match(text)) and m.end() == len(text):
            pairs[token] = [rank]
    for word, _ in most_frequent(texts, max_words):
        if word not in pairs:
            pairs[word] = encoding._encode_single_piece(word)
    block = lexicon.to_bytes(lexicon.compile_words(pairs))
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:24]}.bin"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark), name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        out.write(bytearray(block))
        out.close()
    sc.addFile(str(path.makeQualified(fs.getUri(), fs.getWorkingDirectory())))
    return name


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(id_col, ids ARRAY<INT>): the ids of each text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts have an empty list;
    repeated ids stay repeated rows; other columns don't matter. No shuffle: each row is encoded in place.
    """
    ranks_path = ranks_path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    name = build_lexicon(spark, docs.select(F.col(text_col).alias("text")), ranks_path)
    id_type = docs.schema[id_col].dataType.simpleString()
    spark.sparkContext.addFile(ranks_path)  # executors needn't have the vocabulary
    ranks_name = os.path.basename(ranks_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(ranks_name), SparkFiles.get(name))
        for batch in batches:
            for first, end, data, offsets in textscan.slices(batch.column(1)):
                ids, counts = encoder.encode(data, offsets)
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {id_type}, ids array<int>")
