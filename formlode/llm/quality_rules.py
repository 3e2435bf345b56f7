"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Word, symbol, line and repetition statistics of each text are turned into four transformed ratios. For each group of
documents that share language and source, and for all documents together, the minimum-covariance-determinant estimate of
centre and scatter is searched from several starts: a concentration step keeps the share of rows that is closest under the
present estimate and estimates anew from these; after two steps the start with the least determinant goes on until its
determinant no longer falls. A group's estimate leans on that of all documents as if PRIOR documents of those were in it, so
that small groups need no pool. Documents beyond a fixed Mahalanobis distance are rejected. Everything is DataFrame
expressions and grouped aggregates; only one row of estimates for each group is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("f1", "f2", "f3", "f4")
_LOWER = [(a, b) for a in range(1, 5) for b in range(1, a + 1)]
#: Least standard deviations, added to each scatter, in the units of the features. Where the typical document repeats nothing,
#: half of the lines (ln 6) or 49 % of the words (ln 5.9) alone lie beyond six of these.
FLOORS = (0.06, 0.35, 0.29, 0.29)
#: Share of a group that the estimate rests on, and what turns the scatter of that share of a four-dimensional normal sample
#: into that of the whole: share / P(chi-square with 6 degrees <= the share's quantile with 4 degrees).
SHARE, CONSISTENCY = 0.75, 1.4864
#: Documents of the estimate of all that count as part of each group.
PRIOR = 60
#: Concentration steps of every start, and the least fall of the log determinant that calls for another step of the best.
FIRST_STEPS, STABLE = 2, 1e-3
#: Squared distance beyond which a document is rejected: six robust standard deviations.
CUTOFF = 36.0
ALL = "*"
#: Files of a table of estimates.
FILES = 4


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed; such columns are replaced."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    names = [c for c in docs.columns if c not in added]
    df = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], body.alias("_body"), words.alias("_w"), lines.alias("_l"))
    body = F.col("_body")
    n = F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    df = df.withColumn("_t", windows)
    placed = F.sort_array(F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_t")) < F.size("_t"), placed))

    def twice(x: Column, k: Column) -> Column:
        other = [F.coalesce(F.get("_s", k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
        return other[0] | other[1]

    inside = F.flatten(F.transform(F.filter("_s", twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    size = lambda c: F.size(c).cast("long")
    df = df.withColumns(
        {
            "n_words": size("_w"),
            "word_chars": F.length(F.translate(body, SPACE, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_lines": size("_l"),
            "n_dup_lines": size("_l") - size(F.array_distinct("_l")),
            "n_repeat_words": F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(inside))).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *added[:-1], failed.alias("base_failed"))


def _features() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "f1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "f2": F.log(0.05 + F.col("n_symbols") / words),
        "f3": F.log(0.1 + F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "f4": F.log(0.1 + F.col("n_repeat_words") / words),
    }


def _group(lang: str, source: str) -> Column:
    """The name of a row's group; nulls and empty strings differ."""
    return F.to_json(F.array(F.col(f"`{lang}`").cast("string"), F.col(f"`{source}`").cast("string")))


def _distance() -> Column:
    """Squared Mahalanobis distance by the inverse Cholesky factor in i11, i21, ..."""
    z = [sum((F.col(f"i{a}{b}") * (F.col(f"f{b}") - F.col(f"m{b}")) for b in range(1, a + 1)), F.lit(0.0)) for a in range(1, 5)]
    return z[0] * z[0] + z[1] * z[1] + z[2] * z[2] + z[3] * z[3]


def _with_factor(estimates: DataFrame) -> DataFrame:
    """Adds to m1.. and c11, c21, .. the inverse Cholesky factor i11, i21, .. and the log determinant of the scatter."""
    df = estimates
    for a in range(1, 5):
        for b in range(1, a + 1):
            rest = F.col(f"c{a}{b}") - sum((F.col(f"l{a}{k}") * F.col(f"l{b}{k}") for k in range(1, b)), F.lit(0.0))
            df = df.withColumn(f"l{a}{b}", F.sqrt(F.greatest(rest, F.lit(FLOORS[a - 1] ** 2))) if a == b else rest / F.col(f"l{b}{b}"))
    for a in range(1, 5):
        for b in range(a, 0, -1):
            inner = sum((F.col(f"l{a}{k}") * F.col(f"i{k}{b}") for k in range(b, a)), F.lit(0.0))
            df = df.withColumn(f"i{a}{b}", 1 / F.col(f"l{a}{a}") if a == b else -inner / F.col(f"l{a}{a}"))
    df = df.withColumn("log_det", 2 * sum((F.log(f"l{a}{a}") for a in range(1, 5)), F.lit(0.0)))
    return df.drop(*[f"l{a}{b}" for a, b in _LOWER])


def _moments(wanted: Column | None = None) -> list[Column]:
    """Means and regularised covariances of the features, of the wanted rows."""
    f = [F.col(x) if wanted is None else F.when(wanted, F.col(x)) for x in FEATURES]
    means = [F.avg(f[a]).alias(f"m{a + 1}") for a in range(4)]
    return means + [(F.covar_pop(f[a - 1], f[b - 1]) + (FLOORS[a - 1] ** 2 if a == b else 0.0)).alias(f"c{a}{b}") for a, b in _LOWER]


def _starts(rows: DataFrame) -> DataFrame:
    """Four first estimates of each group: from quartiles, from all rows, and from two halves of them."""
    quart = [F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q{i + 1}") for i, f in enumerate(FEATURES)]
    half = F.pmod(F.xxhash64(*FEATURES), F.lit(2))
    kinds = [_moments(), _moments(half == 0), _moments(half == 1)]
    names = [f"m{a}" for a in range(1, 5)] + [f"c{a}{b}" for a, b in _LOWER]
    each = rows.groupBy("grp").agg(*quart, *[F.struct(*k).alias(f"s{i}") for i, k in enumerate(kinds)])
    spread = [(F.col(f"q{i + 1}")[2] - F.col(f"q{i + 1}")[0]) / 1.349 for i in range(4)]
    first = [F.col(f"q{i + 1}")[1].cast("double").alias(f"m{i + 1}") for i in range(4)]
    first += [(spread[a - 1] * spread[a - 1] + FLOORS[a - 1] ** 2 if a == b else F.lit(0.0)).alias(f"c{a}{b}") for a, b in _LOWER]
    all_starts = F.posexplode(F.array(F.struct(*first), *[F.struct(*[F.col(f"s{i}")[n].alias(n) for n in names]) for i in range(3)])).alias("start", "e")
    return _with_factor(each.select("grp", all_starts).select("grp", "start", "e.*").dropna())


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: the estimate of each group and start from the rows that are closest under the present one."""
    near = rows.join(estimates, "grp").groupBy("grp", "start").agg(F.percentile_approx(_distance(), SHARE, 1000).alias("cut"))
    # Written first, so that tables of known size are joined with the rows: they are broadcast if they are small.
    cuts = written(estimates.join(near, ["grp", "start"]), "cuts", FILES)
    core = rows.join(cuts, "grp").filter(_distance() <= F.col("cut"))
    return written(_with_factor(core.groupBy("grp", "start").agg(*_moments())), "estimates", FILES)


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """For each grp of (grp, f1, .., f4) rows its centre m1.., regularised scatter c11, .. and log_det; start is where it began."""
    estimates = written(_starts(rows), "starts", FILES)
    for _ in range(FIRST_STEPS):
        estimates = _concentrated(rows, estimates)
    best = estimates.groupBy("grp").agg(F.min_by(F.struct(*[c for c in estimates.columns if c != "grp"]), F.struct("log_det", "start")).alias("e"))
    estimates = written(best.select("grp", "e.*"), "best", FILES)
    while True:
        after = _concentrated(rows, estimates)
        both = estimates.alias("was").join(after.alias("now"), "grp")
        falls = both.select("grp", (F.col("was.log_det") - F.col("now.log_det")).alias("fall"))
        pick = [F.when(F.col("now.log_det") < F.col("was.log_det"), F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in estimates.columns if c != "grp"]
        estimates = written(both.select("grp", *pick), "estimates", FILES)
        if falls.filter(F.col("fall") > STABLE).isEmpty():
            return estimates


def fit(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """For each group (grp) of the documents that passed the base rules, the centre and inverse factor that judge it."""
    passed = stats.filter(~F.col("base_failed")).select(_group(lang, source).alias("grp"), *[c.alias(n) for n, c in _features().items()])
    rows = written(passed.select(F.explode(F.array("grp", F.lit(ALL))).alias("grp"), *FEATURES), "features")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    found = minimum_determinant(rows).join(sizes, "grp")
    names = [f"m{a}" for a in range(1, 5)] + [f"c{a}{b}" for a, b in _LOWER]
    prior = found.filter(F.col("grp") == ALL).select(*[F.col(c).alias(f"p{c}") for c in names])
    own = found.filter(F.col("grp") != ALL).crossJoin(F.broadcast(prior))  # one row
    leaning = {c: (F.col("n") * F.col(c) + PRIOR * F.col(f"p{c}")) / (F.col("n") + PRIOR) for c in names}
    # The floors are no part of the sample's scatter, so they are not scaled.
    floor = {f"c{a}{a}": FLOORS[a - 1] ** 2 for a in range(1, 5)}
    scaled = [(CONSISTENCY * (x - floor.get(c, 0.0)) + floor.get(c, 0.0) if c[0] == "c" else x).alias(c) for c, x in leaning.items()]
    return written(_with_factor(own.select("grp", *scaled)).drop(*[f"c{a}{b}" for a, b in _LOWER]), "judges", FILES)


def judged(stats: DataFrame, estimates: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` with outlier_distance (squared; null if the base rules failed) and kept."""
    names = [c for c in stats.columns if c not in ("outlier_distance", "kept")]
    carried = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(names)]
    keyed = stats.select(*carried, F.col("base_failed").alias("_failed"), _group(lang, source).alias("grp"), *[c.alias(n) for n, c in _features().items()])
    near = keyed.join(estimates, "grp", "left").withColumn("_distance", F.when(~F.col("_failed"), _distance()))
    kept = ~F.col("_failed") & (F.col("_distance") <= CUTOFF)
    return near.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(names)], F.col("_distance").alias("outlier_distance"), kept.alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns of ``docs`` with the statistics, base_failed, outlier_distance and kept; one row for each row.

    Null and empty texts have no words and fail the base rules; null languages and sources form groups of their own; repeated
    rows count as often as they occur, texts of any length are measured whole. The estimates see every document that passed the
    base rules. Columns of ``docs`` that bear the names of added ones are replaced; other columns, of whatever name, are carried
    along. An empty table gives no rows. The measured table is written once, since the estimates must be complete before the
    first verdict.
    """
    stats = written(measured(docs, text), "statistics")
    return judged(stats, fit(stats, lang, source), lang, source)
