"""Repetition inside single documents, and outliers of it per language and source (problem 10).

Each document gives a vector of transformed statistics. Per group of language and source, a regularised
minimum-covariance-determinant estimate gives a centre and a scatter: concentration steps over all documents
from two starts, of which the one with the smaller determinant is kept, made consistent for normal data and
reweighted. Documents are rejected by Mahalanobis distance; the share of rejected ones is then checked
exactly. Where a group's scatter is so wide that a document with the wanted share could lie within the cut,
that group's cut is lowered to the least distance that any vector with this share can have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolloom.llm import textscan
from symbolloom.session import cut

DIMS = 4
#: Fixed values, for DIMS degrees of freedom: the 0.975 quantile of chi-square, and by how much the scatter of the
#: nearest half, or of those within that quantile, falls short of the whole for normal data.
CHI2_975, HALF, REWEIGHTED = 11.143286781877796, 2.1090, 1.0645
#: Added to each variance, as most documents have one value in some statistic: a standard deviation of 0.1 counts as none.
RIDGE = 1e-2
STARTS = 2


def _repeated(hashes: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Whether each word lies in a run of ``size`` words that also begins earlier in its row."""
    found, at = textscan.windows(hashes, rows, size)
    out = np.zeros(len(hashes) + 1, np.int32)
    if len(found):
        key = found ^ textscan.mix(rows[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        again = at[order[1:][key[order[1:]] == key[order[:-1]]]]
        np.add.at(out, again, 1)
        np.add.at(out, again + size, -1)
    return np.cumsum(out)[:-1] > 0


def statistics(docs: DataFrame, run: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: group (language, source), n_words, n_repeated, share, and vector x0..x3.

    A word is repeated if it lies in a run of ``run`` words that also begins earlier in the document. Null,
    empty and wordless texts have no words and the share 0. Language tags are trimmed, lower-cased and cut
    at the first separator; null and blank ones are ''. A null source is ''. Runs are compared by 64-bit
    hashes. No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = ["n_words", "n_repeated", "share", *(f"x{i}" for i in range(DIMS))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in textscan.slices(batch.column(3)):
                hashes, rows, *_ = textscan.words(data, offsets)
                n = end - first
                words = np.bincount(rows, minlength=n)
                many = np.maximum(words, 1)
                share = np.bincount(rows[_repeated(hashes, rows, run)], minlength=n) / many
                phrase = np.bincount(rows[_repeated(hashes, rows, 3)], minlength=n) / many
                # distinct words of a row: sort by row, then hash
                order = np.lexsort((hashes, rows))
                h, r = hashes[order], rows[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                variety = np.where(words > 0, np.bincount(r[new], minlength=n) / many, 1.0)
                arrays = [words, np.rint(share * many).astype(np.int64), share, np.sqrt(share), np.sqrt(phrase), variety, np.log1p(words) / 4]
                fixed = [batch.column(i).slice(first, n) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(a) for a in arrays)], names=[id_col, "language", "origin", *columns])

    schema = f"`{id_col}` {id_type}, language string, origin string, n_words bigint, n_repeated bigint, share double, " + ", ".join(f"x{i} double" for i in range(DIMS))
    language = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "^[^-_]*", 0)
    return docs.select(id_col, language.alias("language"), F.coalesce("source", F.lit("")).alias("origin"), text_col).mapInArrow(scan, schema)


def _distance(center: list[Column], low: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance of x0.. by forward substitution."""
    z: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"x{i}") - center[i] - sum((low[i][k] * z[k] for k in range(i)), F.lit(0.0))
        z.append(rest / low[i][i])
    return sum((v * v for v in z), F.lit(0.0))


GROUP = ["language", "origin"]
_L = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _fit(kept: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre, variance of x0, Cholesky factor and determinant per group of the kept rows; one partial aggregation."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _L)]
    m = kept.groupBy(*keys).agg(*sums)
    m = m.select(*keys, *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)), "n", *(f"q{i}{j}" for i, j in _L))
    cov = lambda i, j: (F.col(f"q{max(i, j)}{min(i, j)}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (RIDGE if i == j else 0.0)
    m = m.select(*keys, *(f"m{i}" for i in range(DIMS)), *(cov(i, j).alias(f"c{i}{j}") for i, j in _L))
    # one column of the factor at a time, so that expressions stay small
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            m = m.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    size = F.col("l00")
    for i in range(1, DIMS):
        size = size * F.col(f"l{i}{i}")
    return m.select(*keys, *(f"m{i}" for i in range(DIMS)), "c00", size.alias("size"), *(f"l{i}{j}" for i, j in _L))


def _with_distance(stats: DataFrame, model: DataFrame, keys: list[str], few: bool) -> DataFrame:
    low = [[F.col(f"l{i}{j}") if j <= i else F.lit(0.0) for j in range(DIMS)] for i in range(DIMS)]
    joined = stats.join(F.broadcast(model) if few else model, keys)
    return joined.withColumn("d2", _distance([F.col(f"m{i}") for i in range(DIMS)], low))


def robust(stats: DataFrame, at_least: float | None = None, steps: int = 4, sent_groups: int = 100_000) -> DataFrame:
    """``stats`` (statistics(), computed once) with d2 (squared robust distance), cut2 and rejected (d2 >= cut2).

    The starts order each group by the distance from its coordinate medians, plain or in units of the median
    deviations; every concentration step keeps the half of each group nearest to the last estimate (ties are
    kept too) and estimates again, over all documents. The kept start is scaled by HALF, then all within the
    0.975 quantile are estimated once more and scaled by REWEIGHTED. Quantiles are sketches, so d2 varies in
    its last digits with the partitioning. ``at_least``: a bound on the share that no rejected set may miss: x0
    is the root of the share, and vectors with x0 >= t have a squared distance of at least (t - m0)**2 / c00, to
    which the cut is lowered where that is less. Models are a row a group; up to ``sent_groups`` are sent to
    every task, more are joined by a shuffle. An empty table gives an empty result.
    """
    half, each = F.percentile_approx, [*GROUP, "start"]
    columns = stats.columns
    middle = stats.groupBy(*GROUP).agg(*(half(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(DIMS)))
    middle = cut(middle)
    few = middle.count() <= sent_groups
    send = lambda m: F.broadcast(m) if few else m
    off = stats.join(send(middle), GROUP).select(*columns, *(F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"o{i}") for i in range(DIMS)))
    wide = off.groupBy(*GROUP).agg(*(half(f"o{i}", 0.5, 1000).alias(f"w{i}") for i in range(DIMS)))
    total = lambda unit: sum((F.col(f"o{i}") * F.col(f"o{i}") / unit(i) for i in range(DIMS)), F.lit(0.0))
    near = off.join(send(wide), GROUP).select(*columns, F.posexplode(F.array(total(lambda i: F.lit(1.0)), total(lambda i: F.col(f"w{i}") * F.col(f"w{i}") * 2.2 + RIDGE))).alias("start", "d2"))
    both = stats.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    for _ in range(steps):
        limit = near.groupBy(*each).agg(half("d2", 0.5, 1000).alias("limit"))
        kept = near.join(send(limit), each).where("d2 <= limit")
        model = cut(_fit(kept, each, 1.0))
        near = _with_distance(both, model, each, few).select(*both.columns, "d2")
    best = model.groupBy(*GROUP).agg(F.min_by("start", F.struct("size", "start")).alias("start"))
    raw = near.join(send(best), each).where(F.col("d2") <= CHI2_975 * HALF).select(*columns)
    final = cut(_fit(raw, GROUP, REWEIGHTED))
    if at_least is None:
        bound = F.lit(CHI2_975)
    else:
        gap = F.greatest(F.lit(float(np.sqrt(at_least))) - F.col("m0"), F.lit(0.0))
        bound = F.least(F.lit(CHI2_975), gap * gap / F.col("c00") * (1 - 1e-6))
    return _with_distance(stats, final, GROUP, few).withColumn("cut2", bound).withColumn("rejected", F.col("d2") >= F.col("cut2")).select(*columns, "d2", "cut2", "rejected")


def outliers(docs: DataFrame, at_least: float | None = None, steps: int = 4, sent_groups: int = 100_000, **kw) -> DataFrame:
    """robust() of the documents' statistics()."""
    return robust(cut(statistics(docs, **kw)), at_least, steps, sent_groups)


def repetitive(docs: DataFrame, share: float = 0.3, id_col: str = "doc_id", **kw) -> DataFrame:
    """(id_col): documents of which at least ``share`` of the words are repeated: rejected ones, checked exactly."""
    exact = F.col("n_repeated") >= F.lit(share) * F.col("n_words") - 1e-9
    return outliers(docs, at_least=share, id_col=id_col, **kw).where(F.col("rejected") & (F.col("n_words") > 0) & exact).select(id_col).distinct()
