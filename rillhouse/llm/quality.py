"""Quality rules and robust multivariate outliers, by DataFrame functions alone.

Each text gets a vector of transformed statistics. For every language and source a minimum-
covariance-determinant estimate is sought: from several deterministic starts (medians with absolute
deviations, the covariance of spatial signs, that of hyperbolic tangents), concentration steps keep
the half of the group nearest to the centre and take its mean and covariance as the next centre and
scale, until the determinant falls no more; the start that ends with the least determinant gives
the estimate. Squared Mahalanobis distances are then brought to scale by the group's median
distance, and a document is rejected if its distance is beyond a chi-square quantile, its margin
widened by the group's own spread. Groups too small for an estimate use their language's, then the
corpus's. The steps run over the statistics alone, never over texts again.

Statistics are held in whole steps, so that all sums are of whole numbers and no result depends on
the order or place of rows. Halves and quantiles come from exact counts of rows by steps of the
logarithm of their distance (a step is 0.2 %); the rows of the step in which a half ends count by
the share of them that it needs, so that it holds the exact half. What is joined to the rows is a
row a group, and no group has to come together in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bind, materialize, whole_text, word_list

#: Transformed statistics: mean word length, symbols a word, repeated words, repeated lines, runs
#: of capital letters.
FEATURES = ("f_length", "f_symbols", "f_repeat", "f_lines", "f_upper")
D = len(FEATURES)
#: Fixed values of chi-square with D = 5 degrees of freedom: median, upper quartile, and the 0.99999
#: quantile, beyond which a document is an outlier.
CHI2_MEDIAN, CHI2_UPPER, CHI2_CUT = 4.3515, 6.6257, 30.856
#: Concentration steps at most (groups settle after 5 to 15), and the fall of the logarithm of the
#: determinant below which a group has settled.
STEPS, SETTLED = 50, 1e-4
#: Documents that a group needs for an estimate of its own, if not given.
LEAST = 60
#: Groups whose estimates, of about 100 numbers each, are broadcast whatever their files' sizes; of
#: more, the optimizer decides.
BROADCAST_ROWS = 50_000
#: Added to each variance: the least spread that counts, 0.1, so that a feature that hardly varies in
#: a group (most texts repeat nothing) doesn't make every other value an outlier.
RIDGE = 1e-2
#: Steps of a statistic in a unit, and the largest statistic; steps of the logarithm of a distance.
UNIT, LARGEST, FINE = 1024, 64, 512


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text. Windows are
    hashed; only a text with equal hashes sorts them with their places."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(s: Column) -> Column:
        k = F.size(s)
        again = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j + 1 < k) & (F.get(s, j + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    twice = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed_of(h), covered))
    placed_of = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(n < 3, F.lit(0)).otherwise(bind(hashes, twice))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang, source, the exact base statistics and the feature vector of each document.
    Null texts count as empty."""
    t = whole_text(text)
    held = docs.select(F.col(doc_id).alias("doc_id"), "lang", "source", t.alias("t"), word_list(t).alias("words"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    joined = F.array_join("words", "")
    plain = joined
    for c in "#*$%&|<>":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    stats = held.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length(joined) - F.length(plain)).cast("long").alias("n_symbols"),
        F.when(F.contains("t", F.lit("\n")), F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
        F.when(F.contains("t", F.lit("\n")), F.size(lines)).otherwise(1).cast("long").alias("n_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit("[A-Z]{2,}")).cast("long").alias("n_upper"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.select(
        "*",
        F.log1p(F.col("word_chars") / n).alias("f_length"),
        F.sqrt(F.col("n_symbols") / n).alias("f_symbols"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f_repeat"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("f_lines"),
        F.sqrt(F.col("n_upper") / n).alias("f_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
#: The estimate of a group: centre, Cholesky factor and log determinant, all in units.
ESTIMATE = [*[f"m_{i}" for i in range(D)], *[f"l_{i}_{j}" for i, j in PAIRS], "logdet"]
#: A document's groups, from the narrowest: it is held against the first that has an estimate.
LEVELS = (("lang", "source"), ("lang",), ())


def _group(keys: tuple[str, ...] | list[str]) -> Column:
    """Name of a row's group by `keys`; null is a value of its own."""
    return F.concat_ws("\x1f", F.lit(str(len(keys))), *[F.coalesce(F.concat(F.lit("v"), F.col(k)), F.lit("null")) for k in keys])


def stepped(feature: str) -> Column:
    """A statistic in whole steps."""
    return F.round(F.least(F.lit(float(LARGEST)), F.greatest(F.lit(-float(LARGEST)), F.col(feature))) * UNIT).cast("long")


def _factored(est: DataFrame) -> DataFrame:
    """Covariances c_i_j (a ridge added) to their lower Cholesky factor l_i_j and `logdet`."""
    for i, j in PAIRS:
        value = F.col(f"c_{i}_{j}") + (RIDGE if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        est = est.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(RIDGE * 1e-3))) if i == j else value / F.col(f"l_{j}_{j}"))
    return est.withColumn("logdet", 2 * sum((F.log(f"l_{i}_{i}") for i in range(D)), F.lit(0.0)))


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance `d2` of the stepped statistics x_i, by forward substitution."""
    for i in range(D):
        z = F.col(f"x_{i}") / UNIT - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(D)), F.lit(0.0)))


def _step_of(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * FINE).cast("int")


def _ranked(values: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group by `keys`: for each name, the least `value` (whole numbers, of which there are
    boundedly many) with that many rows at or below it, as (at, before, n): the value, the rows
    below it and its own. Rows are counted where they are; a window only goes over the counts."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto_n = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    row = F.struct(F.col(value).alias("at"), (F.col("upto") - F.col("n")).alias("before"), "n")
    return upto_n.groupBy(*keys).agg(F.first("total").alias("total"), *[F.min(F.when(F.col("upto") >= r, row)).alias(name) for name, r in ranks.items()])


def _half() -> Column:
    """Rows of a half: the size at which the determinant's breakdown point is largest."""
    return F.floor((F.col("total") + D + 1) / 2)


def _written(df: DataFrame) -> DataFrame:
    return materialize(df, "mcd")


def _side(groups: DataFrame, few: bool) -> DataFrame:
    """Rows, one a group, to be joined to the members; broadcast if the groups are few."""
    return F.broadcast(groups) if few else groups


def _starts(members: DataFrame, few: bool) -> DataFrame:
    """(g, s, total, estimate) for each group and start: median and absolute deviations, with the
    covariance of the scaled rows' spatial signs, or of their hyperbolic tangents, in two of them."""
    values = members.select("g", F.posexplode(F.array(*[f"x_{i}" for i in range(D)])).alias("i", "x"))
    middle = F.ceil(F.col("total") / 2)
    flat = lambda ranked, name: ranked.groupBy("g").pivot("i", list(range(D))).agg(F.first("half.at").alias(name)).select("g", *[F.col(str(i)).alias(f"{name}_{i}") for i in range(D)])
    med = _written(flat(_ranked(values, ["g", "i"], "x", {"half": middle}), "med"))
    near = members.join(_side(med, few), "g").select("g", F.posexplode(F.array(*[F.abs(F.col(f"x_{i}") - F.col(f"med_{i}")) for i in range(D)])).alias("i", "x"))
    mad = flat(_ranked(near, ["g", "i"], "x", {"half": middle}), "mad")
    scale = [F.greatest(F.lit(RIDGE**0.5), F.col(f"mad_{i}") * 1.4826 / UNIT).alias(f"sd_{i}") for i in range(D)]
    base = _written(med.join(mad, "g").select("g", *[f"med_{i}" for i in range(D)], *scale))
    # whole steps again, so that the sums are exact
    z = lambda i: (F.col(f"x_{i}") - F.col(f"med_{i}")) / UNIT / F.col(f"sd_{i}")
    scaled = members.join(_side(base, few), "g").select("g", *[z(i).alias(f"z_{i}") for i in range(D)])
    norm = F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(D)), F.lit(1e-12)))
    whole = lambda c: F.round(c * UNIT).cast("long")
    turned = scaled.select("g", *[whole(F.col(f"z_{i}") / norm).alias(f"a_{i}") for i in range(D)], *[whole(F.tanh(F.col(f"z_{i}"))).alias(f"b_{i}") for i in range(D)])
    sums = turned.groupBy("g").agg(F.count("*").alias("total"), *[F.sum(F.col(f"{k}_{i}") * F.col(f"{k}_{j}")).alias(f"{k}_{i}_{j}") for k in "ab" for i, j in PAIRS])

    def start(k: str | None) -> Column:
        # correlations of the turned rows, spread by the deviations
        cell = lambda i, j: F.col(f"{k}_{i}_{j}") / F.sqrt(F.greatest(F.lit(1.0), F.col(f"{k}_{i}_{i}").cast("double") * F.col(f"{k}_{j}_{j}")))
        value = lambda i, j: F.lit(1.0) if i == j else F.lit(0.0) if k is None else cell(i, j)
        return F.struct(*[(value(i, j) * F.col(f"sd_{i}") * F.col(f"sd_{j}")).alias(f"c_{i}_{j}") for i, j in PAIRS])

    each = F.posexplode(F.array(start(None), start("a"), start("b"))).alias("s", "c")
    wide = sums.join(base, "g").select("g", "total", *[(F.col(f"med_{i}") / UNIT).alias(f"m_{i}") for i in range(D)], each).select("g", "s", "total", *[f"m_{i}" for i in range(D)], "c.*")
    return _factored(_written(wide)).select("g", "s", "total", *ESTIMATE)


def _packed(est: DataFrame, *more: str) -> DataFrame:
    """A row for each group, with its starts' estimates in `starts`."""
    return est.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("s", "total", *ESTIMATE, *more))).alias("starts"))


def _concentrated(members: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    """The next estimate of each group and start in `est`, from its nearest half."""
    far = _distance(members.join(_side(_written(_packed(est)), few), "g").select("g", *[f"x_{i}" for i in range(D)], F.explode("starts").alias("e")).select("g", *[f"x_{i}" for i in range(D)], "e.*"))
    cut = _ranked(far.select("g", "s", _step_of(F.col("d2")).alias("step")), ["g", "s"], "step", {"half": _half()})
    cut = _written(cut.select("g", "s", "half"))
    with_cut = _written(_packed(est.join(cut, ["g", "s"]), "half"))
    near = _distance(members.join(_side(with_cut, few), "g").select("g", *[f"x_{i}" for i in range(D)], F.explode("starts").alias("e")).select("g", *[f"x_{i}" for i in range(D)], "e.*"))
    near = near.withColumn("step", _step_of(F.col("d2")))  # no filter: it would repeat the distance's terms
    # whole numbers, seen from the centre's nearest step, so that sums of squares stay small
    y = lambda i: F.col(f"x_{i}") - F.round(F.col(f"m_{i}") * UNIT).cast("long")
    inner, outer = F.when(F.col("step") < F.col("half.at"), F.lit(1)), F.when(F.col("step") == F.col("half.at"), F.lit(1))
    terms = {f"y_{i}": y(i) for i in range(D)} | {f"y_{i}_{j}": y(i) * y(j) for i, j in PAIRS}
    sums = near.groupBy("g", "s").agg(*[F.coalesce(F.sum(k * t), F.lit(0)).alias(f"{n}{name}") for n, k in (("in_", inner), ("on_", outer)) for name, t in terms.items()])
    now = est.join(cut, ["g", "s"]).join(sums, ["g", "s"])
    share, half = (_half() - F.col("half.before")) / F.col("half.n"), _half()
    mean = {name: (F.col(f"in_{name}") + share * F.col(f"on_{name}")) / half for name in terms}
    now = now.select("g", "s", "total", *[F.round(F.col(f"m_{i}") * UNIT).alias(f"o_{i}") for i in range(D)], *[c.alias(n) for n, c in mean.items()])
    cov = [((F.col(f"y_{i}_{j}") - F.col(f"y_{i}") * F.col(f"y_{j}")) / (UNIT * UNIT)).alias(f"c_{i}_{j}") for i, j in PAIRS]
    now = now.select("g", "s", "total", *[((F.col(f"o_{i}") + F.col(f"y_{i}")) / UNIT).alias(f"m_{i}") for i in range(D)], *cov)
    return _factored(_written(now)).select("g", "s", "total", *ESTIMATE)


def concentrate(members: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimates of the groups `g` of `members` (stepped statistics x_i): total, centre m_i, Cholesky
    factor l_i_j, logdet, and the median and upper quartile `mid` and `upper` of the squared
    distances. Ties of determinants go to the first start. Groups and starts that have settled
    take no further steps."""
    few = members.select("g").distinct().count() <= BROADCAST_ROWS
    moving, settled = _written(_concentrated(members, _written(_starts(members, few)), few)), []
    for _ in range(steps):
        new = _concentrated(members, moving, few).withColumnRenamed("logdet", "new").select("g", "s", *[F.col(c).alias(f"new_{c}") for c in ESTIMATE[:-1]], F.col("new").alias("new_logdet"))
        both = _written(moving.join(new, ["g", "s"]).withColumn("fell", F.col("logdet") - F.col("new_logdet")))
        better = F.col("fell") > 0
        settled.append(both.where(F.col("fell") <= SETTLED).select("g", "s", "total", *[F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ESTIMATE]))
        moving = both.where(F.col("fell") > SETTLED).select("g", "s", "total", *[F.col(f"new_{c}").alias(c) for c in ESTIMATE])
        if moving.isEmpty():
            break
    ends = reduce(DataFrame.unionByName, [*settled, moving])
    best = ends.groupBy("g").agg(F.min_by(F.struct("total", *ESTIMATE), F.struct("logdet", "s")).alias("e")).select("g", "e.*")
    best = _written(best)
    far = _distance(members.join(_side(best, few), "g")).select("g", _step_of(F.col("d2")).alias("step"))
    spread = _ranked(far, ["g"], "step", {"mid": F.ceil(F.col("total") / 2), "upper": F.ceil(F.col("total") * 3 / 4)})
    value = lambda name: F.greatest(F.lit(1e-6), F.exp((F.col(f"{name}.at") + 0.5) / FINE))  # noqa: E731  the step's middle
    return best.join(spread.select("g", value("mid").alias("mid"), value("upper").alias("upper")), "g")


def estimates(stats: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """Estimates (see `concentrate`) of the groups of `stats` by `keys`."""
    return concentrate(_written(stats.select(_group(keys).alias("g"), *[stepped(f).alias(f"x_{i}") for i, f in enumerate(FEATURES)])), steps)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: float = CHI2_CUT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    the robust distance (null without an estimate).

    Null and blank texts have no words and fail; null languages and sources are groups; documents
    of a language and source with fewer than `least` documents that pass the base rules are held
    against their language, or, if it has as few, against all; with fewer than `least` in all there
    is no estimate and the base rules decide alone. Repeated rows each count; texts of any length
    are taken whole; no rows give none; no other column is looked at, whatever its name."""
    levels = [f"g{n}" for n in range(len(LEVELS))]
    named = statistics(docs, doc_id, text).select("*", *[_group(k).alias(g) for k, g in zip(LEVELS, levels, strict=True)], *[stepped(f).alias(f"x_{i}") for i, f in enumerate(FEATURES)])
    stats = materialize(named.drop(*FEATURES), "quality")
    good = stats.where(~base_failed())
    # the group that each language and source is held against: sums over a row for each of them
    counts = _written(good.groupBy(*levels).agg(F.count("*").alias("n0")))
    for n, g in enumerate(levels[1:], 1):
        counts = counts.join(counts.groupBy(g).agg(F.sum("n0").alias(f"n{n}")), g)
    own = F.coalesce(*[F.when(F.col(f"n{n}") >= least, F.col(g)) for n, g in enumerate(levels)])
    used = _written(counts.select("g0", own.alias("g")).where("g is not null"))
    few = used.count() <= BROADCAST_ROWS
    needed = _written(used.select("g").distinct())
    members = good.select(F.explode(F.array(*levels)).alias("g"), *[f"x_{i}" for i in range(D)]).join(_side(needed, few), "g", "left_semi")
    est = concentrate(_written(members))
    est = _side(_written(used.join(est, "g").select(F.col("g0").alias("own"), "mid", "upper", *ESTIMATE)), few)
    rows = _distance(stats.join(est, F.col("g0") == F.col("own"), "left"))
    # a group whose distances spread wider than chi-square's gets a wider margin
    d2 = F.col("d2") / F.greatest(F.lit(1.0), F.col("mid") / CHI2_MEDIAN, F.col("upper") / CHI2_UPPER)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.coalesce(d2 <= cut, F.lit(True))).alias("kept"), d2.alias("distance"))
