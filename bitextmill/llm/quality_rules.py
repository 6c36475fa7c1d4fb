"""Quality rules as robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Base rules reject very short and very repetitive texts. For the others, statistics of the whole text are transformed to
roughly normal scales, and location and scatter are estimated per (language, source) by concentration steps: start from
the per-group medians and scaled deviations, and from means and variances, then keep the share ``SUPPORT`` of rows nearest by Mahalanobis
distance and re-estimate from those; of the two starts the one that ends with the least determinant counts. A step is one aggregation over all rows, for
the groups of all three levels at once: the sums of each bin of distances, of which the nearest bins are added up. It
combines before the shuffle, so a hot source costs no more than another and no group is collected. Every group has its
own estimates, drawn towards those of its language, and a language's towards those of all rows: a group of n rows weighs
n^2 / (n^2 + OWN^2) in the pooled location and scatter. So a few rows, which tell little of themselves, are judged by
their language, and no verdict turns on a limit.

Nulls: a null text has no words; null lang or source form groups of their own. Texts without words fail the base rule.
Empty tables give no rows, repeated rows repeat, other columns are ignored. Very long texts are read whole, one at a
time. Ties: rows of one bin of distances are all nearer or all farther; equal rows have equal verdicts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, staged

#: Share of rows that the estimates are made from, and rows at which a group weighs as much as the wider group.
SUPPORT, OWN = 0.75, 60
#: Concentration steps; each lowers the determinant, by little after the third.
STEPS, STARTS = 3, 2
#: Groups whose estimates are sent to all tasks; tasks that share a group beyond that.
MOST_SENT, SALT = 20_000, 64
#: Squared distances are cut into bins of this many per natural-log unit, from exp(LOW) up.
GRAIN, LOW, BINS = 12, -6.0, 320
#: Rejected beyond this chance of a normal row.
TAIL = 1e-9

SYMBOLS = b"#*$%&|<>"
SPACES = bytes((0x20, *range(0x09, 0x0E)))
UPPER = bytes(range(0x41, 0x5B))
#: ASCII letters and the first bytes of longer characters.
LETTERS = UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0xC3, 0xF5))
FEATURES = ["f_symbols", "f_repeats", "f_length", "f_upper"]
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long"
_COLUMNS = [c.split()[0] for c in STATS.split(", ")]


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    n = len(ids) - 2
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base < 2_000_000:
        keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:  # pragma: no cover - over two million distinct words in one text
        pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * base + ids[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    inside = np.zeros(len(ids), bool)
    inside[:-2] |= hit
    inside[1:-1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of ``STATS`` for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    lines, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup += 1
        elif line.strip(SPACES):
            lines.add(line)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - count(SPACES), count(SYMBOLS), dup, repeated_words(ids), count(UPPER), count(LETTERS)


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A struct ``doc`` of the columns ``keep``, lang and source as text, and the statistics of the whole text."""
    bounded(docs.sparkSession)
    text = lambda c: F.col(c).cast("string").alias(c)
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), text("lang"), text("source"), text("text"))
    if "text" in keep and docs.schema["text"].dataType.simpleString() == "string":
        source = source.drop("text")  # it is in ``doc`` already
    schema = f"doc {source.schema['doc'].dataType.simpleString()}, lang string, source string, {STATS}"

    def run(batches):
        for batch in batches:
            texts = batch.column(3) if batch.num_columns > 3 else batch.column(0).field("text")
            rows = [text_stats(t.as_py()) for t in texts]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["doc", "lang", "source", *_COLUMNS])

    return _levels(source.mapInArrow(lean(run), schema)).select("*", base_failed().alias("base_failed"), *features())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """Transformed statistics: shares by arc sine of the root, which steadies their variance, and log word length."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda x, of: F.asin(F.sqrt(F.least(x / of, F.lit(1.0))))
    return [
        share(F.col("n_symbols"), chars).alias("f_symbols"),
        share(F.col("n_repeat_words") + F.col("n_dup_lines"), n + F.col("n_dup_lines")).alias("f_repeats"),
        F.log(chars / n).alias("f_length"),
        share(F.col("n_upper"), F.greatest(F.col("n_letters"), F.lit(1))).alias("f_upper"),
    ]


class Estimates:
    """Location, inverse scatter and factor of one group."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray):
        self.mean, self.inverse = mean, np.linalg.inv(cov + RIDGE)

    def flat(self) -> list[float]:
        return [*map(float, self.mean), *(float(self.inverse[i, j]) for i in range(P) for j in range(P))]


P = len(FEATURES)
#: Least scatter of a statistic, so that groups whose statistic hardly varies do not reject by tiny differences.
RIDGE = np.diag([0.025, 0.10, 0.08, 0.04]) ** 2


def chi2_quantile(p: int, upper: float) -> float:
    """Upper quantile of chi-squared with ``p`` degrees of freedom (Wilson and Hilferty)."""
    lo, hi = 0.0, 40.0  # normal quantile by bisection
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(mid / math.sqrt(2)) > upper else (lo, mid)
    return p * (1 - 2 / (9 * p) + lo * math.sqrt(2 / (9 * p))) ** 3


def _consistency(h: float) -> float:
    """Factor by which the scatter of the nearest share ``h`` of normal rows is too small (simulated, fixed seed)."""
    d = np.sort((np.random.default_rng(0).standard_normal((200_000, P)) ** 2).sum(1))
    return float(P / d[: int(h * len(d))].mean())


def _distance(params: str) -> Column:
    diffs = [F.col(f) - F.col(params)[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(P):
            total = total + diffs[i] * diffs[j] * F.col(params)[P + i * P + j]
    return total


def _levels(rows: DataFrame) -> DataFrame:
    """Group keys at three levels, so every estimate is one aggregation: (lang, source), lang, all."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return rows.withColumns({"k2": F.concat_ws("\u0001", text("lang"), text("source")), "k1": text("lang")})


def pooled(n: int, mean: np.ndarray, cov: np.ndarray, wide_mean: np.ndarray, wide_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of a group of ``n`` rows mixed with those of the wider group."""
    w = n * n / (n * n + OWN * OWN)
    apart = mean - wide_mean
    return wide_mean + w * apart, w * cov + (1 - w) * wide_cov + w * (1 - w) * np.outer(apart, apart)


def _long(rows: DataFrame) -> DataFrame:
    """(key, start, up, features): each row once for each level's group and start; ``up`` is the key of the wider group."""
    level = lambda key, up: F.struct(key.alias("key"), up.alias("up"))
    all_, lang = F.lit("all"), F.concat(F.lit("l"), F.col("k1"))
    groups = F.array(level(all_, F.lit("")), level(lang, all_), level(F.concat(F.lit("s"), F.col("k2")), lang))
    return rows.where("not base_failed").select(F.explode(groups).alias("g"), *FEATURES).select("g.*", F.explode(F.array(*map(F.lit, range(STARTS)))).alias("start"), *FEATURES)


def _start(rows: DataFrame) -> DataFrame:
    """Diagonal estimates: by medians and scaled deviations (mergeable quantile sketches), and by means and variances."""
    first = F.col("start") == 0
    quantiles = [F.percentile_approx(F.when(first, F.col(f)), [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)]
    moments = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)] + [F.var_pop(f).alias(f"v{i}") for i, f in enumerate(FEATURES)]
    found = rows.groupBy("key", "start").agg(*quantiles, *moments)
    middle = [F.when(first, F.col(f"q{i}")[1]).otherwise(F.col(f"m{i}")) for i in range(P)]
    spread = [F.when(first, F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2)).otherwise(F.col(f"v{i}")) for i in range(P)]
    inverse = [1 / (spread[i] + float(RIDGE[i, i])) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
    return found.select("key", "start", F.array(*middle, *inverse).alias("params"))


def with_params(rows: DataFrame, params: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with their group's ``params``. A small table goes to all tasks; a larger one is joined by key and salt, so
    that a group of a third of all rows is spread over tasks."""
    if params.count() <= MOST_SENT:  # rows of some 200 bytes
        return rows.join(F.broadcast(params), keys, how)
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALT)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


_MOMENTS = [f"s{i}" for i in range(P)] + [f"x{i}{j}" for i in range(P) for j in range(i, P)]


def _nearest(rows: DataFrame, params: DataFrame, factor: float) -> DataFrame:
    """(key, start, up, n, shape): rows, and mean and scaled scatter of each group's ``SUPPORT`` share of nearest rows."""
    bin_ = F.least(F.greatest(F.floor((F.log(F.col("_d") + 1e-9) - LOW) * GRAIN), F.lit(0)), F.lit(BINS)).cast("int")
    near = with_params(rows, params, ["key", "start"]).withColumn("_d", _distance("params")).withColumn("bin", bin_)
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"x{i}{j}") for i in range(P) for j in range(i, P)]
    bins = near.groupBy("key", "start", "up", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    # at most BINS + 1 entries a group
    groups = bins.groupBy("key", "start", "up").agg(F.sort_array(F.collect_list(F.struct("bin", "n", *_MOMENTS))).alias("bins"))

    def run(batches):
        for batch in batches:
            sizes, shapes = [], []
            for bins in batch.column(3).to_pylist():
                at = np.array([[b["n"], *(b[m] for m in _MOMENTS)] for b in bins])
                inside = int(np.searchsorted(np.cumsum(at[:, 0]), math.ceil(at[:, 0].sum() * SUPPORT))) + 1
                n, *found = at[:inside].sum(0)
                mean, cross = np.array(found[:P]) / n, np.zeros((P, P))
                cross[np.triu_indices(P)] = found[P:]
                cov = factor * ((cross + np.triu(cross, 1).T) / n - np.outer(mean, mean))
                sizes.append(int(n))
                shapes.append([*map(float, mean), *map(float, cov.ravel())])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(shapes, pa.list_(pa.float64()))], ["key", "start", "up", "n", "shape"])

    return groups.mapInArrow(lean(run), "key string, start int, up string, n long, shape array<double>")


def _params(found: DataFrame) -> DataFrame:
    """(key, start, params): mean and inverse of the ridged scatter, pooled with the language's and that with all rows'.

    One row a group and start: the wider groups' rows are joined to it.
    """
    wider = lambda name: found.select("start", F.col("key").alias(f"{name}_key"), F.col("up").alias(f"{name}_up"), F.struct("n", "shape").alias(name))
    joined = found.withColumn("a_key", F.col("up")).join(wider("a"), ["start", "a_key"], "left")
    joined = joined.withColumn("b_key", F.col("a_up")).join(wider("b"), ["start", "b_key"], "left")
    chain = joined.select("key", "start", F.struct("n", "shape").alias("own"), "a", "b")

    def run(batches):
        split = lambda g: (g["n"], np.array(g["shape"][:P]), np.array(g["shape"][P:]).reshape(P, P))
        for batch in batches:
            params = []
            for row in batch.to_pylist():
                groups = [split(g) for g in (row["b"], row["a"], row["own"]) if g]  # widest first
                _, mean, cov = groups[0]
                for n, own_mean, own_cov in groups[1:]:
                    mean, cov = pooled(n, own_mean, own_cov, mean, cov)
                params.append(Estimates(mean, cov).flat())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(params, pa.list_(pa.float64()))], ["key", "start", "params"])

    return chain.mapInArrow(lean(run), "key string, start int, params array<double>")


def _least(found: DataFrame) -> DataFrame:
    """Of each group, the start whose scatter has the least determinant."""

    def run(batches):
        for batch in batches:
            scatter = [np.array(s[P:]).reshape(P, P) + RIDGE for s in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(np.linalg.slogdet(c)[1]) for c in scatter], pa.float64())], [*batch.schema.names, "det"])

    rows = found.mapInArrow(lean(run), "key string, start int, up string, n long, shape array<double>, det double")
    best = rows.groupBy("key").agg(F.min_by(F.struct("up", "n", "shape"), F.struct("det", "start")).alias("g"))
    return best.select("key", F.lit(0).alias("start"), "g.*")


def estimates(rows: DataFrame, steps: int) -> DataFrame:
    """Minimum-covariance-determinant estimates of all groups of all levels: (key, params)."""
    long, factor = _long(rows), _consistency(SUPPORT)
    params = staged(_start(long), "mcd")
    for k in range(steps):
        found = staged(_nearest(long, params, factor), "mcd")
        params = staged(_params(found if k + 1 < steps else _least(found)), "mcd")
    return params.drop("start")


def _verdicts(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Distance by the estimates of the row's group; groups without any row that passes the base rules keep nothing."""
    out = with_params(rows.withColumn("key", F.concat(F.lit("s"), F.col("k2"))), params, ["key"], "left").withColumn("distance", _distance("params"))
    inlier = F.coalesce(F.col("distance") <= chi2_quantile(P, TAIL), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inlier)


def judged(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row a document: the statistics, base_failed, the squared distance and kept."""
    rows = staged(with_stats(docs, ["doc_id"]), "stats")
    return _verdicts(rows, estimates(rows, steps)).select("doc.doc_id", *_COLUMNS[:5], "base_failed", "distance", "kept")


def filter_documents(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """``docs`` without the rejected documents, with all its columns.

    Statistics are made twice, once for the estimates and once beside the whole rows: that costs CPU time but shuffles
    and writes no text. The verdict joins one row a group of documents.
    """
    found = estimates(staged(with_stats(docs, ["doc_id"]), "stats"), steps)
    return _verdicts(with_stats(docs, docs.columns), found).where("kept").select("doc.*")
