"""Quality rules with robust multivariate outliers (operator 2).

Two plain rules reject short texts and texts of repeated words. Of the others, transformed statistics form a vector
per document; for each language and source the minimum-covariance-determinant estimate gives centre and scatter of
the bulk, and documents beyond CUT in squared Mahalanobis distance are rejected.

Estimates are made for every language and source, every language, and all rows, each from the share KEEP of its rows with
the least determinant. A language and source is judged by its own estimate drawn towards its language's, and that towards
the one of all rows, by the weight of PRIOR rows: one rule for groups of any size. Distances are scaled so that the
median and the CALIBRATE quantile of a group do not exceed those of chi-square. A variance is at least FLOOR times that of
sampling a text of the group's lengths, which matters where most texts have none of a thing.

The estimate runs as Spark aggregates. A concentration step computes distances under the present estimate, counts
and sums vectors and products per group and distance bin, and takes the bins that hold the closest share KEEP of
the rows: what reaches one task is sums per bin, never the rows of a group. Steps end when no determinant falls any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill.llm import words as W
from auditmill.llm.batches import bound_batches
from auditmill.session import store

KEEP = 0.75             # share of a group's rows that the estimate rests on
PRIOR = 100             # rows that the wider group's estimate counts for
FALL = 1e-4             # least fall of a log determinant that is worth a further step
REJECTED = 1e-6         # share of a normal bulk that the cut would reject
CALIBRATE = 0.85        # upper quantile that is set against chi-square
FLOOR = 0.0625          # least variance, as a multiple of 1 / words (or characters) of a text; 0.25 is that of sampling
SOFT = 1e-3             # correlations are lessened by this share, so that no scatter is singular
BINS = 32               # distance bins per doubling
FIT_TASKS = 16          # tasks that fit estimates; one more for every GROUPS_PER_TASK groups beyond
GROUPS_PER_TASK = 100
SENT_GROUPS = 10_000    # estimates of so many groups, about a kilobyte each, are sent to the tasks; more are joined
SHARES = 32             # shares of a group's rows in that join
NAMES = ("word_length", "symbols", "marks", "capitals", "repeats", "dup_lines")
PER_CHAR = (False, False, True, True, False, False)  # what a statistic is a share of
D = len(NAMES)


def chi_square(share: float) -> float:
    """Quantile of chi-square with D degrees of freedom, D even."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, D // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


CUT = chi_square(1 - REJECTED)
TRIANGLE = [(i, j) for i in range(D) for j in range(i, D)]

_SYMBOL, _MARK, _CAPITAL = (np.zeros(256, dtype=bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CAPITAL[65:91] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals")


def count_words(texts: pa.Array) -> list[np.ndarray]:
    """The columns of COUNTS for whole texts."""
    found: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for _, data, offsets in W.slices(texts):
        n = len(offsets) - 1
        words = W.words_of(data, offsets)
        inside = ~W.BLANK[data]
        first, hashes = W.windows(words, 3)
        again = first[W.repeated(W.of_text(words.text[first], hashes))]
        repeats = np.zeros(len(words.text), dtype=bool)
        for k in range(3):
            repeats[again + k] = True
        lines = W.lines_of(data, offsets)
        filled = np.zeros(len(lines.start), dtype=bool)
        if len(lines.start):
            running = np.concatenate([[0], np.cumsum(inside)])
            filled = running[lines.end] > running[lines.start]
        owner = lines.text[filled]
        copies = owner[W.seen_before(W.of_text(owner, lines.hash[filled]))]
        for column, values in zip(found, (
                np.bincount(words.text, minlength=n), W.count_in_texts(inside & ((data & 0xC0) != 0x80), offsets),
                W.count_in_texts(_SYMBOL[data], offsets), np.bincount(copies, minlength=n),
                np.bincount(words.text[repeats], minlength=n), W.count_in_texts(_MARK[data], offsets),
                W.count_in_texts(_CAPITAL[data], offsets))):
            column.append(values)
    return [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in found]


def with_counts(documents: DataFrame, text_column: str, out: str) -> DataFrame:
    """`documents` with a struct `out` of COUNTS; all other columns pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_words(batch.column(batch.schema.get_field_index(text_column)))
            yield batch.append_column(out, pa.StructArray.from_arrays([pa.array(c) for c in counts], names=list(COUNTS)))
    bound_batches(documents.sparkSession)
    if out in documents.columns:
        raise ValueError(f"the table has a column {out}")
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(out, counts)]))


def statistics(c: Column) -> Column:
    """The transformed statistics, in the order of NAMES, of a struct of COUNTS."""
    per_word = F.greatest(c["n_words"], F.lit(1)).cast("double")
    per_char = F.greatest(c["word_chars"], F.lit(1)).cast("double")
    return F.array(F.log(per_char / per_word), F.sqrt(c["n_symbols"] / per_word), F.sqrt(c["n_marks"] / per_char),
                   F.sqrt(c["n_capitals"] / per_char), F.sqrt(c["n_repeat_words"] / per_word), F.sqrt(c["n_dup_lines"] / per_word))


def noise(c: Column) -> Column:
    """One over the words and one over the characters of a text: what the variance of a share goes by."""
    return F.array(1 / F.greatest(c["n_words"], F.lit(1)).cast("double"), 1 / F.greatest(c["word_chars"], F.lit(1)).cast("double"))


def base_failed(c: Column) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def _groups(lang: Column, source: Column) -> list[Column]:
    """Keys of the language and source, the language, and all rows."""
    none = F.lit(None).cast("string")
    return [F.xxhash64(F.lit(level), a, a.isNull(), b, b.isNull()) for level, (a, b) in enumerate(((lang, source), (lang, none), (none, none)))]


def _members(rows: DataFrame) -> DataFrame:
    """(grp, x, noise): a row counts for its own group and for the two wider ones."""
    return rows.filter("NOT failed").select(F.explode(F.array(*_groups(F.col("lang"), F.col("source")))).alias("grp"), "x", "noise")


def _scatter(n: float, sums: np.ndarray, products: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of counted rows; variances are raised to their floors, correlations softened."""
    mean = np.asarray(sums) / n
    scatter = np.zeros((D, D))
    for (i, j), total in zip(TRIANGLE, products):
        scatter[i, j] = scatter[j, i] = total / n - mean[i] * mean[j]
    least = FLOOR * np.array([noise[int(c)] / n for c in PER_CHAR])
    own = np.diag(scatter)
    return mean, scatter * (1 - SOFT) + np.diag(np.maximum(own, least) - own * (1 - SOFT))


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, inverse, log determinant and scatter from counts, sums and products, one row per start and group."""
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            mean, scatter = _scatter(row.n, row.sums, row.products, row.noise)
            out.append((row.start, row.grp, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1]), scatter.ravel().tolist()))
        yield pd.DataFrame(out, columns=["start", "grp", "centre", "inverse", "logdet", "scatter"])


ESTIMATE = "start int, grp long, centre array<double>, inverse array<double>, logdet double, scatter array<double>"


def distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    gap = [F.get(x, F.lit(i)) - F.get(centre, F.lit(i)) for i in range(D)]
    total = F.lit(0.0)
    for i, j in TRIANGLE:
        total = total + (1 if i == j else 2) * F.get(inverse, F.lit(i * D + j)) * gap[i] * gap[j]
    return total


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    x = [F.get("x", F.lit(i)) for i in range(D)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in TRIANGLE]
    noises = [F.sum(F.get("noise", F.lit(i))).alias(f"e{i}") for i in range(2)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums, *products, *noises)


def _packed(rows: DataFrame) -> DataFrame:
    return rows.select("start", "grp", F.col("n").cast("double").alias("n"), F.array(*[f"s{i}" for i in range(D)]).alias("sums"),
                       F.array(*[f"p{i}_{j}" for i, j in TRIANGLE]).alias("products"), F.array("e0", "e1").alias("noise"))


def _beside(members: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """Rows with what `table` says of their group, up to two rows a group. A group may hold all rows, so rows are not
    dealt by group: few groups are broadcast, of many each is copied to SHARES shares of its rows."""
    if groups <= SENT_GROUPS:
        return members.join(F.broadcast(table), "grp")
    share = F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int")
    copied = table.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return members.withColumn("share", share).join(copied, ["grp", "share"]).drop("share")


def _binned(members: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    near = _beside(members, estimate, groups).withColumn("d2", distance(F.col("x"), F.col("centre"), F.col("inverse")))
    return near.withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(1e-6))) * BINS).cast("int"))


def _closest(members: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    """Moments of the KEEP closest rows of each start and group, to the next whole bin."""
    bins = _moments(_binned(members, estimate.select("start", "grp", "centre", "inverse"), groups), "start", "grp", "bin")
    whole = Window.partitionBy("start", "grp")
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = (bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .withColumn("all", F.sum("n").over(whole)).filter(F.col("before") < KEEP * F.col("all")))
    names = ["n", *[f"s{i}" for i in range(D)], *[f"p{i}_{j}" for i, j in TRIANGLE], "e0", "e1"]
    return inner.groupBy("start", "grp").agg(*[F.sum(c).alias(c) for c in names])


def _fitted(moments: DataFrame, groups: int) -> DataFrame:
    """The estimates of `groups` groups, in as many tasks as their number calls for: each row is a group's moments,
    so the partitions of the shuffle before, whose number follows the input, would be all but empty."""
    tasks = FIT_TASKS + groups // GROUPS_PER_TASK
    return _packed(moments).coalesce(tasks).mapInPandas(_fit, ESTIMATE)


def _starts(members: DataFrame, groups: int) -> DataFrame:
    """Two robust first estimates of each group: medians with median deviations, and medians with the scatter of
    bounded deviations."""
    def medians(rows: DataFrame, prefix: str, *more: Column) -> DataFrame:
        return rows.groupBy("grp").agg(F.array(*[F.percentile_approx(F.get("x", F.lit(i)), 0.5, 10_000) for i in range(D)]).alias(prefix), *more)
    errors = [F.avg(F.get("noise", F.lit(i))) for i in range(2)]
    least = F.array(*[F.sqrt(F.lit(FLOOR) * errors[int(c)]) for c in PER_CHAR]).alias("least")
    centre = store(medians(members, "centre", least))
    away = _beside(members, centre, groups).select("grp", F.zip_with("x", "centre", lambda a, b: F.abs(a - b)).alias("x"))
    both = store(centre.join(medians(away, "mad"), "grp").withColumn("mad", F.zip_with("mad", "least", lambda m, f: F.greatest(1.4826 * m, f))))
    bounded = _beside(members, both, groups).select("grp", "noise", F.transform(F.arrays_zip("x", "centre", "mad"), lambda z: (
        F.tanh((z["x"] - z["centre"]) / z["mad"]) * z["mad"])).alias("x"))
    scatter = _moments(bounded, "grp").withColumn("start", F.lit(1))
    second = _fitted(scatter, groups).drop("centre").join(centre, "grp")
    def diagonal(mad: Column) -> Column:
        cells = [F.lit(1.0) / (F.get(mad, F.lit(i)) * F.get(mad, F.lit(i))) if i == j else F.lit(0.0) for i in range(D) for j in range(D)]
        return F.array(*cells)
    first = both.select(F.lit(0).alias("start"), "grp", "centre", diagonal(F.col("mad")).alias("inverse"))
    return first.unionByName(second.select("start", "grp", "centre", "inverse"))


def concentrate(members: DataFrame, groups: int) -> DataFrame:
    """The estimate of least determinant of each group (grp, centre, inverse, logdet, scatter), over both starts.

    A step replaces the estimates whose determinant it lowers; each lowers by FALL at least, so the steps end."""
    now = store(_fitted(_closest(members, _starts(members, groups), groups), groups))
    while True:
        tried = _fitted(_closest(members, now, groups), groups)
        old = now.select("start", "grp", F.struct("centre", "inverse", "logdet", "scatter").alias("old"))
        both = tried.join(old, ["start", "grp"]).withColumn("falls", F.col("old.logdet") - F.col("logdet") > FALL)
        fields = [F.when(F.col("falls"), F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in ("centre", "inverse", "logdet", "scatter")]
        stepped = store(both.select("start", "grp", *fields, "falls"))
        now = stepped.drop("falls")
        if not stepped.filter("falls").limit(1).count():
            break
    best = now.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return now.join(best, ["grp", "start"])


def _scales(members: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    """(grp, n, scale): by how much a group's distances exceed chi-square, at the median or the upper quantile."""
    bins = _binned(members, estimate.select("grp", "centre", "inverse"), groups).groupBy("grp", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(whole))

    def quantile(share: float) -> Column:
        bin_ = F.max(F.when(F.col("before") < share * F.col("all"), F.col("bin")))
        return F.pow(F.lit(2.0), (bin_ + 0.5) / BINS) / chi_square(share)
    return placed.groupBy("grp").agg(F.max("all").alias("n"), F.greatest(quantile(0.5), quantile(CALIBRATE)).alias("scale"))


def _blend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse scatter of each language and source, drawn towards the wider groups."""
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            centre = scatter = scale = None
            for n, c, s, k in ((row.n2, row.centre2, row.scatter2, row.scale2), (row.n1, row.centre1, row.scatter1, row.scale1),
                               (row.n0, row.centre0, row.scatter0, row.scale0)):
                if c is None or n is None or n != n:
                    continue
                own, mine, log = np.asarray(c), np.asarray(s).reshape(D, D), math.log(max(k, 1e-9))
                if centre is None:
                    centre, scatter, scale = own, mine, log
                else:
                    w = n / (n + PRIOR)
                    centre, scatter, scale = w * own + (1 - w) * centre, w * mine + (1 - w) * scatter, w * log + (1 - w) * scale
            if centre is not None:
                out.append((row.lang, row.source, centre.tolist(), np.linalg.inv(scatter * math.exp(scale)).ravel().tolist()))
        yield pd.DataFrame(out, columns=["lang", "source", "centre", "inverse"])


def estimates(rows: DataFrame) -> DataFrame:
    """(lang, source, centre, inverse) from (lang, source, failed, x, noise): what judges each language and source."""
    keys = [k.alias(f"g{i}") for i, k in enumerate(_groups(F.col("lang"), F.col("source")))]
    joined = store(rows.groupBy("lang", "source").agg(F.count("*").alias("rows")).select("lang", "source", *keys))
    members = store(_members(rows))
    groups = joined.select(F.explode(F.array("g0", "g1", "g2")).alias("grp")).distinct().count()
    best = store(concentrate(members, groups))
    found = store(best.join(_scales(members, best, groups), "grp").select("grp", "n", "centre", "scatter", "scale"))
    for i in range(3):
        named = found.toDF(f"g{i}", f"n{i}", f"centre{i}", f"scatter{i}", f"scale{i}")
        joined = joined.join(named, f"g{i}", "left")
    tasks = FIT_TASKS + groups // GROUPS_PER_TASK
    return store(joined.coalesce(tasks).mapInPandas(_blend, "lang string, source string, centre array<double>, inverse array<double>"))


def verdicts(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """`rows` (lang, source, failed, x, ...) with `distance` (null without an estimate) and `kept`."""
    named = estimate.toDF("_l", "_s", "centre", "inverse")
    judged = rows.join(named, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    d2 = F.when(~F.col("failed"), distance(F.col("x"), F.col("centre"), F.col("inverse")))
    return judged.withColumn("distance", d2).withColumn("kept", ~F.col("failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).drop(
        "centre", "inverse")


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
          source_column: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of each row.

    A null text has no words and fails the base rule. A null language or source is a value like others. Null ids and
    repeated rows are kept, each counts; an empty table gives an empty one; further columns are not read."""
    docs = documents.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"),
                            F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text"))
    counted = with_counts(docs, "text", "c").select(
        "id", "lang", "source", "c", base_failed(F.col("c")).alias("failed"), statistics(F.col("c")).alias("x"), noise(F.col("c")).alias("noise"))
    rows = store(counted)
    return verdicts(rows, estimates(rows)).select(
        F.col("id").alias(id_column), *[f"c.{c}" for c in COUNTS[:5]], F.col("failed").alias("base_failed"), "distance", "kept")


def keep_good(documents: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """The rows of `documents` that `judge` keeps, with their columns. Counts are taken again beside the rows, so
    texts are not shuffled to meet their verdicts."""
    columns, spare = documents.columns, "_counts"
    while spare in columns:
        spare += "_"
    def measured(rows: DataFrame) -> DataFrame:
        return with_counts(rows, text_column, spare)
    lang, source = F.col(lang_column).cast("string"), F.col(source_column).cast("string")
    narrow = measured(documents.select(*dict.fromkeys([text_column, lang_column, source_column]))).select(
        lang.alias("lang"), source.alias("source"), base_failed(F.col(spare)).alias("failed"), statistics(F.col(spare)).alias("x"),
        noise(F.col(spare)).alias("noise"))
    estimate = estimates(store(narrow))
    rows = measured(documents).filter(~base_failed(F.col(spare)))
    packed = rows.select(F.struct(*columns).alias("row"), lang.alias("lang"), source.alias("source"),
                         F.lit(False).alias("failed"), statistics(F.col(spare)).alias("x"))
    return verdicts(packed, estimate).filter("kept").select("row.*")
