"""Quality rules and robust multivariate outliers: a minimum-covariance-determinant estimate per language and source
rejects documents whose transformed statistics lie far away by Mahalanobis distance. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, keyed_join, table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
DIMS = ("x_length", "x_word", "x_symbols", "x_lines", "x_repeats")
FLOORS = (0.35, 0.08, 0.25, 0.5, 0.7)  #: least standard deviation of each: a group that never varies rejects nothing small
STEPS = 20  #: concentration steps, at most; they end when no determinant falls
PRIOR = 50  #: rows that a group's parent counts for
# Chi-square with 5 degrees of freedom, its median and its points at 97.5% and 99.9%.
MEDIAN_CHI2, CHI2_975, CHI2_999 = 4.351460191095529, 12.832501994030027, 20.515005652432873
REACH = 12.0  #: how far beyond its median a distance may lie, in spans from the median to the upper quartile of its language: 5 is the 99.9% point of normal values, and clean lengths and repeats have longer tails
ESTIMATE = (*[f"m{i}" for i in range(len(DIMS))], *[f"l{i}{j}" for i in range(len(DIMS)) for j in range(i + 1)])


def let(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text: windows as hashes, equal ones found by sorting, the
    words of their places counted once."""

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, s: a + s)

    def again(z: Column) -> Column:
        same = lambda s, k: F.coalesce(F.get(z, k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(z, k + 1)["h"] == s["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(z, same), lambda s: s["i"])), covered)

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, again))

    windows = F.transform(F.slice(words, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(windows, of)).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of documents."""
    text = F.coalesce(docs["text"], F.lit(""))
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), docs["source"].alias("source"), text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACES, "") != "")

    def per_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), repeat_words(words, n).alias("n_repeat_words"))

    out = named.select(
        "doc_id", "lang", "source",
        let(F.array_remove(F.split("t", SPACE, -1), ""), per_words).alias("w"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = out.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics and the keys g0 (lang and source), g1 (lang), g2 (all)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    key = lambda c: F.coalesce(F.col(c), F.lit("\x00null"))
    return stats.withColumns({
        "x_length": F.log1p("n_words"), "x_word": F.log1p(F.col("word_chars") / n), "x_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "x_lines": F.log1p(F.col("n_dup_lines").cast("double")), "x_repeats": F.log1p(100 * F.col("n_repeat_words") / n),
        "g0": F.xxhash64(key("lang"), F.lit("/"), key("source")), "g1": F.xxhash64(key("lang")), "g2": F.lit(0).cast("long"),
    })


def factored(groups: DataFrame, *names: str) -> DataFrame:
    """(g, names, m0.., l00..) of (g, names, m0.., c00..): a column at a time, so that no expression is written out twice."""
    d = len(DIMS)
    for j in range(d):
        pivot = F.col(f"c{j}{j}")
        for k in range(j):
            pivot = pivot - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        groups = groups.withColumn(f"l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(1e-9))))
        below = {}
        for i in range(j + 1, d):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = rest / F.col(f"l{j}{j}")
        groups = groups.withColumns(below) if below else groups
    return groups.select("g", *names, *ESTIMATE)


def with_distance(rows: DataFrame, groups: DataFrame, *names: str) -> DataFrame:
    """Adds names of groups and d2, the squared Mahalanobis distance: forward substitution through the factor of the row's
    group g. groups is written; it is sent to every task where it is small, else a hot group's rows are spread."""
    out = keyed_join(rows, groups, ["g"])
    for i, x in enumerate(DIMS):
        z = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(DIMS))), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", d2).select(*rows.columns, *names, "d2")


def logdet() -> Column:
    """Log of the determinant of a factored covariance."""
    return reduce(lambda x, y: x + y, [2 * F.log(F.col(f"l{i}{i}")) for i in range(len(DIMS))])


def starts(rows: DataFrame) -> DataFrame:
    """(g, start, means, factor): deterministic first estimates about the medians (Hubert, Rousseeuw and Verdonck 2012):
    no correlation, that of the hyperbolic tangents and that of the spatial signs of the standardised values."""
    d = range(len(DIMS))
    quart = rows.groupBy("g").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(DIMS)])
    wide = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i]))
    at = keep(quart.select("g", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in d], *[wide(i).alias(f"w{i}") for i in d]), "centres")
    z = keyed_join(rows, at, ["g"]).select("g", *[((F.col(x) - F.col(f"m{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i, x in enumerate(DIMS)])
    length = F.sqrt(reduce(lambda x, y: x + y, [F.col(f"z{i}") * F.col(f"z{i}") for i in d]))
    z = z.withColumns({f"t{i}": F.tanh(f"z{i}") for i in d} | {f"u{i}": F.col(f"z{i}") / F.greatest(length, F.lit(1e-9)) for i in d})
    pairs = [(i, j) for i in d for j in range(i + 1)]
    shapes = z.groupBy("g").agg(*[F.avg(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}{j}") for c in "tu" for i, j in pairs])
    both = at.join(shapes, "g")

    def of(start: int, letter: str | None) -> DataFrame:
        part = lambda i, j: (F.lit(1.0 if i == j else 0.0) if letter is None else F.col(f"{letter}{i}{j}") + (0.1 if i == j else 0.0)) * F.col(f"w{i}") * F.col(f"w{j}")
        return factored(both.select("g", *[f"m{i}" for i in d], *[part(i, j).alias(f"c{i}{j}") for i, j in pairs])).withColumn("start", F.lit(start))

    return of(0, None).unionByName(of(1, "t")).unionByName(of(2, "u"))


def moments(near: DataFrame, by: list[str]) -> DataFrame:
    """Means and covariances of DIMS, with a share of FLOORS in the variances: no dimension that never varies makes a
    covariance singular (as in the regularised estimate of Boudt et al. 2020)."""
    d = range(len(DIMS))
    sums = near.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(DIMS)], *[F.covar_pop(DIMS[i], DIMS[j]).alias(f"s{i}{j}") for i in d for j in range(i + 1)])
    return sums.select(*by, "n", *[f"m{i}" for i in d], *[(F.col(f"s{i}{j}") + (FLOORS[i] ** 2 / 4 if i == j else 0.0)).alias(f"c{i}{j}") for i in d for j in range(i + 1)])


def concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: the half of each group that is nearest by an estimate (g, start, ..) gives the next one. Both passes are
    grouped aggregates with partial sums, so a group of any size spreads."""
    at = with_distance(rows, estimates, "start")
    half = keep(at.groupBy("g", "start").agg(F.percentile_approx("d2", 0.5, 10_000).alias("cut")), "halves")
    near = keyed_join(at, half, ["g", "start"]).where("d2 <= cut")
    return factored(moments(near, ["g", "start"]), "start")


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """(g, means, factor) of (g, DIMS): the half of a group whose covariance has the least determinant that concentration
    steps reach from any of three starts. Two steps each, then the best start goes on until no determinant falls."""
    now = keep(starts(rows), "mcd")
    for _ in range(2):
        now = keep(concentrated(rows, now), "mcd")
    best = F.min_by(F.struct(*ESTIMATE, "start"), F.struct(logdet(), "start")).alias("e")
    now = keep(now.groupBy("g").agg(best).select("g", "e.*"), "mcd")
    for _ in range(STEPS):
        further = keep(concentrated(rows, now), "mcd")
        fell = now.select("g", logdet().alias("was")).join(further.select("g", logdet().alias("is")), "g").agg(F.max(F.col("was") - F.col("is"))).first()[0]
        now = keep(now.unionByName(further).groupBy("g").agg(best).select("g", "e.*"), "mcd")
        if fell is None or fell < 1e-3:
            break
    return now.drop("start")


def consistent(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates scaled so that the median distance of each group is that of a normal sample."""
    mid = keep(with_distance(rows, estimates).groupBy("g").agg(F.percentile_approx("d2", 0.5, 10_000).alias("mid")), "medians")
    by = F.sqrt(F.greatest(F.col("mid") / MEDIAN_CHI2, F.lit(1e-6)))
    d = range(len(DIMS))
    return keep(estimates.join(mid, "g").select("g", *[f"m{i}" for i in d], *[(F.col(f"l{i}{j}") * by).alias(f"l{i}{j}") for i in d for j in range(i + 1)]), "scaled")


def reweighted(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """(g, n, means, covariances) of the rows of each group that are no outliers by the raw estimate, at the 97.5% point of
    chi-square."""
    near = with_distance(rows, consistent(rows, raw)).where(F.col("d2") <= CHI2_975)
    first = keep(moments(near, ["g"]), "reweighted")
    d = range(len(DIMS))
    scaled = consistent(rows, factored(first))
    grown = {(i, j): reduce(lambda x, y: x + y, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j + 1)]) for i in d for j in range(i + 1)}
    return scaled.join(first.select("g", "n"), "g").select("g", "n", *[f"m{i}" for i in d], *[c.alias(f"c{i}{j}") for (i, j), c in grown.items()])


def shrunk(child: DataFrame, parent: DataFrame, up: DataFrame) -> DataFrame:
    """Estimates of (g, n, ..) drawn towards those of their parents (up: g, p) as if PRIOR rows of the group came from
    there: a group of few rows takes its parent's, one of many keeps its own, and there is no size at which they switch."""
    d = range(len(DIMS))
    of = parent.select(F.col("g").alias("p"), *[F.col(f"m{i}").alias(f"pm{i}") for i in d], *[F.col(f"c{i}{j}").alias(f"pc{i}{j}") for i in d for j in range(i + 1)])
    both = child.join(up, "g").join(of, "p")
    w = F.col("n") / (F.col("n") + PRIOR)
    mean = {f"m{i}": w * F.col(f"m{i}") + (1 - w) * F.col(f"pm{i}") for i in d}
    apart = lambda i: F.col(f"m{i}") - F.col(f"pm{i}")
    cov = {f"c{i}{j}": w * F.col(f"c{i}{j}") + (1 - w) * F.col(f"pc{i}{j}") + w * (1 - w) * apart(i) * apart(j) for i in d for j in range(i + 1)}
    return both.select("g", "n", *[c.alias(k) for k, c in (mean | cov).items()])


def verdicts(docs: DataFrame) -> DataFrame:
    """base_statistics() plus d2 (null for base failures, which no estimate uses), cutoff and kept."""
    stats = keep(with_vectors(base_statistics(docs)), "statistics", wide=True)
    good = stats.where(~F.col("base_failed"))
    tree = keep(good.select("g0", "g1", "g2").distinct(), "groups")
    rows = good.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *DIMS)
    own = keep(reweighted(rows, minimum_covariance(rows)), "estimates")
    pair = lambda a, b: tree.select(F.col(a).alias("g"), F.col(b).alias("p")).distinct()
    langs = keep(shrunk(own, own, pair("g1", "g2")), "languages")
    last = keep(factored(shrunk(own, langs, pair("g0", "g1"))), "sources")
    far = keep(with_distance(good.withColumn("g", F.col("g0")), last), "distances")
    # the tail of a language's own distances
    spread = far.groupBy("g1").agg(F.percentile_approx(F.sqrt("d2"), [0.5, 0.75], 10_000).alias("q"))
    limit = keep(spread.select("g1", F.pow(F.col("q")[0] + REACH * (F.col("q")[1] - F.col("q")[0]), 2).alias("cutoff")), "limits")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = stats.where("base_failed").select(*names, F.lit(None).cast("double").alias("d2"), F.lit(None).cast("double").alias("cutoff"))
    judged = keyed_join(far, limit, ["g1"]).select(*names, "d2", F.greatest("cutoff", F.lit(CHI2_999)).alias("cutoff"))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("cutoff"), F.lit(False)))


def op5_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and whether the base rules and the outlier test keep it.

    A null text counts as empty and fails the base rule; null lang or source are values of their own; repeated rows are
    judged each; an empty table gives no rows. Extra columns are not read.
    """
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "cutoff")
