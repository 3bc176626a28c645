"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base statistics come from each text's words and lines. Their transformed vector (five
numbers) is held against a minimum-covariance-determinant estimate of the document's
language and source. There are three starts: quartiles, and the moments of either half of the
documents, parted by a hash. From each, concentration steps keep the KEEP of the group's
documents nearest by Mahalanobis distance and take their mean and covariance anew, until the
determinant falls no more; the start that ends with the smallest determinant wins, and a last
step reweights over all that aren't outlying. A document is rejected when its distance to
that estimate exceeds a chi-square quantile.

A step is one aggregation: moments by group and distance bin, so the nearest are the bins up
to the one that reaches the share, of which only the part needed counts. A group's state is
its bins, whatever its size.

Groups with fewer than MIN_GROUP documents pool by language; what is still fewer is held
against the estimate of all documents, which judges nothing if these are fewer too. Variances
have a least value, so that a constant number (no symbols at all) doesn't make one symbol infinitely far.

Rows: a null text has no words and fails the base. Null language or source is a group like
any other. Repeated rows count each. A long text is all its words and lines. An empty table
gives an empty result; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACE = r"\x20\x09-\x0D"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_GROUP, KEEP, STEPS, REWEIGHT, REJECT = 100, 0.75, 8, 0.975, 0.9999
#: Log determinants that fall by less than this have stopped to fall.
STILL = 1e-9
#: Smallest standard deviations of the transformed numbers.
FLOORS = (0.5, 0.1, 0.05, 0.15, 0.1)
D = len(FLOORS)
X = [f"x{i}" for i in range(D)]
CROSS = [(i, j) for i in range(D) for j in range(i + 1)]
PARTS = [*[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in CROSS], "det"]
#: The group that is all documents.
ALL = "\u0003"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that stand in windows found twice or more. Equal hashes are only candidates; the windows' words decide."""

    def from_hashes(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(counted(w)))

    def twice(sorted_: Column, field: str) -> Column:
        same = lambda e, k: (e[field] == F.get(sorted_, k - 1)[field]) | (e[field] == F.get(sorted_, k + 1)[field])
        return F.filter(sorted_, lambda e, k: F.coalesce(same(e, k), F.when(k == 0, e[field] == F.get(sorted_, k + 1)[field]).otherwise(e[field] == F.get(sorted_, k - 1)[field]), F.lit(False)))

    def counted(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
        texts = let(by_hash, lambda s: F.sort_array(F.transform(twice(s, "v"), lambda e: F.struct(F.array_join(F.slice(words, e["i"] + 1, WINDOW), " ").alias("v"), e["i"].alias("i")))))
        places = let(texts, lambda s: F.sort_array(F.transform(twice(s, "v"), lambda e: e["i"])))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - a, F.lit(WINDOW)))), F.lit(0), lambda t, x: t + x))

    return let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    words = F.when(trimmed == "", F.expr("array()").cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    found = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), found.alias("w"), by_line.alias("l"), symbols.alias("n_symbols"))
    return rows.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")])


def chi_square(x: float, d: int) -> float:
    """Distribution function: the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal vectors must be multiplied with."""
    return share / chi_square(chi_square_quantile(share, D), D + 2)


def _vectors(rows: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    x = [F.log1p("n_words"), F.log1p(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / words)]
    return rows.withColumns({n: e.cast("double") for n, e in zip(X, x)})


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with their group g: language and source, or the language, or all."""
    keys = rows.withColumns({"kl": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "ks": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    sizes = keys.groupBy("kl", "ks").count()
    small = F.col("count") < MIN_GROUP
    left = sizes.groupBy("kl").agg(F.coalesce(F.sum(F.when(small, F.col("count"))), F.lit(0)).alias("left"))
    names = sizes.join(left, "kl").select("kl", "ks", F.when(~small, F.concat_ws("\u0001", "kl", "ks")).when(F.col("left") >= MIN_GROUP, F.concat("kl", F.lit("\u0002"))).otherwise(F.lit(ALL)).alias("g"))
    # Read back, both sides are plain: Spark broadcasts the names if they are small, and can split a hot group if not.
    return keys.join(written(names, "groups"), ["kl", "ks"]).drop("kl", "ks")


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. to the means m0.., by forward substitution in the Cholesky factor l_ij."""
    y: list[Column] = []
    for i in range(D):
        y.append((F.col(X[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * y[j] for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _quartiles(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads of each group, from counts by fine bins, as a diagonal estimate."""
    fine = 100
    cells = rows.select("g", F.posexplode(F.array(*X)).alias("i", "x")).groupBy("g", "i", F.floor(F.col("x") * fine).alias("b")).count()
    order = Window.partitionBy("g", "i").orderBy("b")
    placed = cells.select("g", "i", "b", F.sum("count").over(order).alias("upto"), F.sum("count").over(Window.partitionBy("g", "i")).alias("n"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), (F.col("b") + 0.5) / fine))
    per = placed.groupBy("g", "i").agg(quartile(0.5).alias("m"), ((quartile(0.75) - quartile(0.25)) / 1.349).alias("s"))
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    out = [e for i in range(D) for e in (at("m", i).alias(f"m{i}"), F.greatest(at("s", i), F.lit(FLOORS[i])).alias(f"l{i}{i}"), *[F.lit(0.0).alias(f"l{i}{j}") for j in range(i)])]
    return per.groupBy("g").agg(*out)


def _moments(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"c{i}{j}") for i, j in CROSS])


SUMS = ["n", *[f"s{i}" for i in range(D)], *[f"c{i}{j}" for i, j in CROSS]]


def _estimate(total: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Means, Cholesky factor of the covariance (times ``factor``) and log determinant, from moments."""
    means = total.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(D)], *[(F.col(f"c{i}{j}") / F.col("n")).alias(f"c{i}{j}") for i, j in CROSS])
    cov = lambda i, j: (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
    covs = means.select(*keys, *[f"m{i}" for i in range(D)], *[(F.greatest(cov(i, j), F.lit(FLOORS[i] ** 2)) if i == j else cov(i, j)).alias(f"a{i}{j}") for i, j in CROSS])
    for i in range(D):  # Cholesky, a column of the factor at a time
        covs = covs.withColumn(f"l{i}{i}", F.sqrt(F.greatest(F.col(f"a{i}{i}") - sum((F.col(f"l{i}{k}") * F.col(f"l{i}{k}") for k in range(i)), F.lit(0.0)), F.lit(FLOORS[i] ** 2 / 4))))
        covs = covs.withColumns({f"l{j}{i}": (F.col(f"a{j}{i}") - sum((F.col(f"l{j}{k}") * F.col(f"l{i}{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}") for j in range(i + 1, D)} or {f"l{i}{i}": F.col(f"l{i}{i}")})
    return covs.withColumn("det", 2 * sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00"))).select(*keys, *PARTS)


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates to start from, by group and start s; with no determinant, as they aren't of the share that is kept."""
    half = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8", 1).otherwise(2)
    halves = _estimate(_moments(rows.withColumn("s", half), "g", "s"), 1.0, "g", "s")
    both = _quartiles(rows).withColumn("s", F.lit(0)).withColumn("det", F.lit(0.0)).select("g", "s", *PARTS).unionByName(halves)
    return both.withColumn("det", F.lit(float("inf"))).withColumn("fell", F.lit(True))


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimates after a concentration step, where their determinants fall; fell says so."""
    near = rows.join(now, "g").select("g", "s", *X, F.floor(F.log(_distance() + 1e-6) * 16).alias("b"))
    cells = _moments(near, "g", "s", "b")
    before = Window.partitionBy("g", "s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0.0)), "all": F.sum("n").over(Window.partitionBy("g", "s"))}).where(F.col("before") < KEEP * F.col("all"))
    part = F.least(F.lit(1.0), (KEEP * F.col("all") - F.col("before")) / F.col("n"))
    total = cells.withColumn("part", part).groupBy("g", "s").agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in SUMS])
    new = _estimate(total, consistency(KEEP), "g", "s").select("g", "s", F.struct(*PARTS).alias("new"))
    met = now.select("g", "s", F.struct(*PARTS).alias("old")).join(new, ["g", "s"]).withColumn("fell", F.col("new.det") < F.col("old.det") - STILL)
    return met.select("g", "s", F.when(F.col("fell"), F.col("new")).otherwise(F.col("old")).alias("e"), "fell").select("g", "s", "e.*", "fell")


def estimates(rows: DataFrame) -> DataFrame:
    """The group's estimate (means, factor, log determinant) for each g of ``rows`` (g, doc_id, x0..)."""
    # A row a group and start, in few files: Spark sees how small the table is, and then broadcasts it.
    now = written(_starts(rows).coalesce(16), "estimate")
    for _ in range(STEPS):
        now = written(_step(rows, now).coalesce(16), "estimate")
        if now.where("fell").isEmpty():
            break
    best = now.groupBy("g").agg(F.min_by(F.struct(*PARTS), F.struct("det", "s")).alias("e")).select("g", "e.*")
    near = rows.join(written(best.coalesce(16), "best"), "g").where(_distance() <= chi_square_quantile(REWEIGHT, D)).select("g", *X)
    return _estimate(_moments(near, "g"), consistency(REWEIGHT), "g")


def judge(docs: DataFrame) -> DataFrame:
    """Base statistics of ``docs`` with base_failed, kept and distance (squared Mahalanobis, null where the group is too small)."""
    rows = written(_vectors(base_statistics(docs)), "statistics")
    rows = written(_grouped(rows), "vectors")
    # All documents are a group beside their own where some are held against it.
    told = rows.where(F.col("g") != ALL)
    if not rows.where(F.col("g") == ALL).isEmpty():
        told = told.unionByName(rows.withColumn("g", F.lit(ALL)))
    sizes = told.groupBy("g").agg(F.count("*").alias("group_size"))
    estimate = written(estimates(told.where("n_words > 0")).join(sizes, "g").coalesce(16), "estimate")
    placed = rows.join(estimate, "g", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    distance = F.when((F.col("group_size") >= MIN_GROUP) & (F.col("n_words") > 0), _distance())
    out = placed.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), distance.alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_quantile(REJECT, D), F.lit(True)))
