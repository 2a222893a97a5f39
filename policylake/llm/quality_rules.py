"""Quality rules: plain limits on text statistics, then robust multivariate outliers per language and source.

Statistics of a text are turned into a vector of five transformed values. For every (lang, source) the minimum
covariance determinant estimate is sought over the texts that pass the plain limits: from two deterministic starts
(medians with absolute deviations; means with covariances), C-steps take the ``CORE`` share of texts that lie nearest
and re-estimate centre and covariance from them; of the two ends the smaller determinant wins and is polished. A text
is rejected if its squared Mahalanobis distance from the estimate exceeds ``CUTOFF``.

Everything runs on a narrow table of statistics: a step is two aggregates with partial sums (the share's quantile, the
moments) and a join with one small row per group, so a group of a third of all rows costs no task more than another.
The 5 x 5 algebra is done on the rows of groups, in tasks. A variance below the measuring precision (``FLOOR``,
squared) counts as that, so a group of equal texts rejects nothing for want of spread; a larger one is not touched. Usual
variances weigh in as ``USUAL_TEXTS`` texts would, since the spread of a dozen texts in five dimensions is no evidence.

Defined cases: null text counts as empty, so it fails the limits; null lang and source are groups of their own; without
any row there is no group; equal rows get equal verdicts. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm._arrow import row_of, sliced, split_words, text_bytes
from policylake.llm._links import stored

CORE = 0.75
CONSISTENCY = 1.41  # 0.75 / P(chi2 with 7 degrees <= the 0.75 quantile of chi2 with 5): the core's spread, as if whole
CUTOFF = 27.9  # chi2 with 5 degrees, probability 0.99996
#: About what one word, one character, one symbol and one repeated line change in a text of 50 words, and a few repeated words.
FLOOR = (0.02, 0.005, 0.05, 0.7, 0.12)
#: Usual deviations, which count as this many texts: a small group alone cannot tell its spread, a large one outweighs them.
USUAL = (1.0, 0.15, 0.05, 0.7, 0.12)
USUAL_TEXTS = 10
STEPS = 3
ACCURACY = 10000
NAMES = ("x0", "x1", "x2", "x3", "x4")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _line_repeats(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    pieces = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    lines = pieces.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows, codes = rows[worded], codes[worded]
    size = int(codes.max()) + 1 if len(codes) else 1
    firsts = np.unique(rows * size + codes) // size
    return np.bincount(rows, minlength=len(texts)) - np.bincount(firsts, minlength=len(texts))


def _word_repeats(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words that stand in a window of three words found twice or more in their text."""
    rows, n = row_of(bounds), len(bounds) - 1
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    inside = rows[2:] == rows[:-2]
    at = np.flatnonzero(inside)
    pairs = np.unique(codes[:-1].astype(np.int64) * (int(codes.max()) + 1) + codes[1:], return_inverse=True)[1]
    last = codes[at + 2].astype(np.int64)
    order = np.lexsort((last, pairs[at], rows[at]))
    r, p, l = rows[at][order], pairs[at][order], last[order]
    same = (r[1:] == r[:-1]) & (p[1:] == p[:-1]) & (l[1:] == l[:-1])
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[at[often] + k] = True
    return np.bincount(rows[covered], minlength=n)


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The columns to keep, and the five base statistics of each text."""
    kept = [c for c in keep if c not in STATS]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("_text"))
    plain, symbols = np.ones(256, bool), np.zeros(256, bool)
    plain[[32, *range(9, 14), *range(128, 192)]] = False
    symbols[list(b"#*$%&|<>")] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "_text"):
            texts = part.column("_text")
            raw, offsets = text_bytes(texts)
            words, bounds = split_words(texts)
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            counts = []
            for table in (plain, symbols):
                sums = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(table[raw], out=sums[1:])
                counts.append(sums[offsets[1:]] - sums[offsets[:-1]])
            values = [np.diff(bounds), *counts, _line_repeats(texts), _word_repeats(codes, bounds)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(v, pa.int64()) for v in values)],
                                             [*kept, *STATS])

    schema = rows.drop("_text").select("*", *(F.lit(0).cast("long").alias(s) for s in STATS)).schema
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return [F.log(words), F.log(F.greatest("word_chars", F.lit(1)) / words),
            F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1)).cast("double")),
            F.log1p(F.col("n_dup_lines").cast("double")), F.sqrt(F.col("n_repeat_words") / words)]


def _triangle() -> list[tuple[int, int]]:
    return [(i, j) for i in range(5) for j in range(i, 5)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row from its group's estimate, joined to it."""
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_triangle()):
        term = (F.col(NAMES[i]) - F.col("center")[i]) * (F.col(NAMES[j]) - F.col("center")[j]) * F.col("inverse")[k]
        total = total + (term if i == j else 2 * term)
    return total


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)]
    squares = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}{j}") for i, j in _triangle()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *squares)


def _estimates(moments: DataFrame, by: list[str]) -> DataFrame:
    """(by, center, inverse, det): of every group's moments; one small row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            center, inverse, det = [], [], []
            for row in part.to_pylist():
                mean = np.array([row[f"s{i}"] for i in range(5)]) / row["n"]
                cov = np.zeros((5, 5))
                for i, j in _triangle():
                    cov[i, j] = cov[j, i] = row[f"q{i}{j}"] / row["n"] - mean[i] * mean[j]
                cov = (CONSISTENCY * row["n"] * cov + USUAL_TEXTS * np.diag(np.square(USUAL))) / (row["n"] + USUAL_TEXTS)
                cov += np.diag(np.maximum(np.square(FLOOR) - np.diag(cov), 0))
                values, vectors = np.linalg.eigh(cov)
                values = np.maximum(values, min(FLOOR) ** 2 / 2)
                back = (vectors / values) @ vectors.T
                center.append(mean.tolist())
                inverse.append([float(back[i, j]) for i, j in _triangle()])
                det.append(float(np.log(values).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in by), pa.array(center, pa.list_(pa.float64())),
                 pa.array(inverse, pa.list_(pa.float64())), pa.array(det, pa.float64())], [*by, "center", "inverse", "det"])

    schema = moments.select(*by, F.array(F.lit(0.0)).alias("center"), F.array(F.lit(0.0)).alias("inverse"),
                            F.lit(0.0).alias("det")).schema
    return moments.mapInArrow(run, schema)


def _with(rows: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns that may be null."""
    renamed = other.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in other.columns if c not in by))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(renamed, on, how).drop(*(f"_{c}" for c in by))


def _step(rows: DataFrame, estimate: DataFrame, by: list[str]) -> DataFrame:
    """One C-step: the nearest share of every group, and the estimate from it."""
    far = _with(rows, estimate, by).withColumn("d", _distance()).select(*by, *NAMES, "d")
    limits = far.groupBy(*by).agg(F.percentile_approx("d", CORE, ACCURACY).alias("limit"))
    core = _with(far, limits, by).where("d <= limit")
    return stored(_estimates(_moments(core, by), by), "estimate")


def _median_start(rows: DataFrame, by: list[str]) -> DataFrame:
    """The estimate from the texts nearest to the medians, in units of their absolute deviations."""
    medians = rows.groupBy(*by).agg(*(F.percentile_approx(x, 0.5, ACCURACY).alias(f"m{i}") for i, x in enumerate(NAMES)))
    off = _with(rows, medians, by).select(*by, *NAMES, *(F.abs(F.col(x) - F.col(f"m{i}")).alias(f"a{i}") for i, x in enumerate(NAMES)))
    spread = off.groupBy(*by).agg(*(F.percentile_approx(f"a{i}", 0.5, ACCURACY).alias(f"b{i}") for i in range(5)))
    scaled = sum((F.col(f"a{i}") / F.greatest(1.4826 * F.col(f"b{i}"), F.lit(FLOOR[i]))) ** 2 for i in range(5))
    far = _with(off, spread, by).withColumn("d", scaled).select(*by, *NAMES, "d")
    limits = far.groupBy(*by).agg(F.percentile_approx("d", CORE, ACCURACY).alias("limit"))
    return stored(_estimates(_moments(_with(far, limits, by).where("d <= limit"), by), by), "estimate")


def mcd(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, center, inverse, det): minimum covariance determinant estimate of x0 to x4 of every group."""
    ends = []
    for start in (_median_start(rows, by), stored(_estimates(_moments(rows, by), by), "estimate")):
        for _ in range(STEPS):
            start = _step(rows, start, by)
        ends.append(start)
    second = ends[1].select(*by, *(F.col(c).alias(f"{c}2") for c in ("center", "inverse", "det")))
    both = _with(ends[0], second, by)
    best = both.select(*by, *(F.when(F.col("det") <= F.col("det2"), F.col(c)).otherwise(F.col(f"{c}2")).alias(c)
                              for c in ("center", "inverse", "det")))
    return _step(rows, best, by)


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), by: tuple[str, ...] = ("lang", "source"),
           text: str = "text") -> DataFrame:
    """The columns to keep with statistics, base_failed, distance (squared, null if base_failed or no group), and kept."""
    carried = tuple(dict.fromkeys([*keep, *by]))
    own = ("base_failed", "distance", "kept")
    stats = text_statistics(docs, tuple(c for c in carried if c not in own), text)
    table = stored(stats.select("*", base_failed().alias("base_failed"), *(x.alias(n) for x, n in zip(_vector(), NAMES))),
                   "statistics")
    group = [f"_g{i}" for i in range(len(by))]
    rows = table.select(*table.columns, *(F.col(c).alias(g) for c, g in zip(by, group)))
    estimate = mcd(rows.where(~F.col("base_failed")).select(*group, *NAMES), group)
    far = _with(rows, estimate, group, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return far.select(*(c for c in stats.columns if c in keep or c in STATS), "base_failed", "distance",
                      (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))
