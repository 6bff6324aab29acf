"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each document becomes a vector of transformed statistics (words, length of words, marks, distinct words, words in
repeated windows, repeated lines).  For each (lang, source) the minimum-covariance-determinant estimate of location and
scatter is found over all documents that pass the base rule, and a document whose squared Mahalanobis distance lies beyond
the cut is rejected.

1. Starts are deterministic: median and MAD, classical moments, and spatial signs about the median.
2. A concentration step takes the three quarters of the group with the least distances, exactly: a histogram of the
   distance by group finds the bin that holds the last one to take, a histogram of that bin alone the distance itself
   (to 2^-26 of e-fold; rows equal to it are taken together), and the moments of the rows up to it give the next estimate.  Each
   is one aggregation with map-side combine whose result is bounded by the number of bins, however large the group is.
3. Steps go on until a start's determinant stands still; the start of the least determinant wins.
4. The winner's scatter is made consistent at the normal distribution, the documents within its 97.5% ellipsoid give the
   final moments, made consistent again.

No constant is added to a scatter.  A statistic that more than half of a group's documents share (its MAD is 0) is dropped from the
group's vector; the first four are never: where one of them doesn't vary, as where fewer than ``least`` documents
pass the base rule, the group is judged by the estimate of its language, and if that is no better, by that of all
documents, there without the statistics that don't vary.  Each estimate's cut is the chi-square quantile of its own
number of statistics.

Statistics are rounded to thousandths and taken from the group's median, so sums are exact and don't depend on the order of
rows (up to 10^9 documents a group).

Defined cases: a null text has no words and fails the base rule; null languages and sources are groups of their own; null
ids and repeated rows are kept, each counted for itself; texts of any length go whole; where all documents are alike, no statistic is left and
all are kept; an empty table gives no rows; clashing column names don't matter (``statistics`` reads doc_id, text,
lang and source alone, and rows travel as a struct where they are carried along).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.llm.rowwise import let, spread
from skyloom.sources.staging import written

SPACE = r"[\x20\x09-\x0D]+"
#: Characters other than letters, their signs, digits and white space.
MARK = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"
NAMES = ("words", "word_length", "marks", "distinct", "repeats", "dup_lines")
#: So many of them, from the first, must vary in a group that is judged by its own estimate.
CORE = 4
#: Rates are taken over so many more words, all distinct, of five letters and 0.15 marks, so a few odd words don't decide on a short text.
PRIOR = 60
P, SCALE, TRIM = len(NAMES), 1000, 0.75
#: Fixed values by number of statistics, from 1: the consistency factor of the three quarters of least distance, the 0.975 quantile of
#: chi-square and its factor, and the quantile that one in ten million exceeds, the default cut.
CONSISTENT_75 = (2.7135, 1.8591, 1.6092, 1.4864, 1.4121, 1.3616)
CHI_975 = (5.0239, 7.3778, 9.3484, 11.1433, 12.8325, 14.4494)
CONSISTENT_975 = (1.1748, 1.1045, 1.0785, 1.0645, 1.0555, 1.0493)
CUT = (28.37, 32.24, 35.41, 38.24, 40.86, 43.34)
#: Variance of rounding to whole thousandths: less is none.
ROUNDING = 1 / 12
#: Bins of a distance's logarithm: coarse ones a unit, and fine ones in each.
COARSE, FINE = 256, 1 << 18
#: A determinant that falls by less stands still; no group has needed half so many steps.
STILL, MOST_STEPS = 1e-9, 40
#: Most rows of a table by group that is broadcast.
GROUPS = 100_000
V = [f"v{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: A pool's sums (s, an array) and sums of products (q, an array of rows), from columns of the names that ``_moments`` gives.
SUMS = [f"array({', '.join(f's{i}' for i in range(P))}) AS s", f"array({', '.join('array(' + ', '.join(f'q{max(i, j)}{min(i, j)}' for j in range(P)) + ')' for i in range(P))}) AS q"]


def _repeats(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more."""

    def covered(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda p, k: (F.get(s, k - 1)["h"] == p["h"]) | (F.get(s, k + 1)["h"] == p["h"])
            at = F.sort_array(F.transform(F.filter(s, lambda p, k: F.coalesce(same(p, k), F.lit(False))), lambda p: p["i"]))
            begin = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, begin, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(pairs, twice))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5)))))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def statistics(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, the base statistics and base_failed, marks and distinct words; also the group and, with them, ``carried`` columns."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    rows = spread(docs).select(F.col("doc_id").cast("long"), text.alias("_text"), words.alias("_words"), F.concat_ws("\x01", F.coalesce("lang", F.lit("\x02")), F.coalesce("source", F.lit("\x02"))).alias("grp"), *carried)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    names = [c for c in rows.columns if c not in ("doc_id", "_text", "_words")]
    rows = rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"), _repeats(F.col("_words")).alias("n_repeat_words"),
        F.regexp_count("_text", F.lit(MARK)).cast("long").alias("n_marks"), F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"), *names,
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics in whole thousandths."""
    n, chars = F.col("n_words") + PRIOR, F.col("word_chars") + 5 * PRIOR
    parts = (
        F.log(n.cast("double")), F.log(chars / n), F.sqrt((F.col("n_marks") + 0.15 * PRIOR) / chars), F.log((F.col("n_distinct") + PRIOR) / n),
        F.sqrt(F.col("n_repeat_words") / n), F.log1p(F.col("n_dup_lines").cast("double")),
    )
    return [F.round(v * SCALE).cast("double").alias(name) for v, name in zip(parts, V)]


def _moments() -> list[Column]:
    parts = ["CAST(count(1) AS DOUBLE) AS n", *(f"sum(v{i}) AS s{i}" for i in range(P)), *(f"sum(v{i} * v{j}) AS q{i}{j}" for i, j in PAIRS)]
    return [F.expr(part) for part in parts]


def _pick(table: tuple[float, ...]) -> str:
    """SQL for the table's value for a group's number of statistics (the first for none)."""
    return f"element_at(array({', '.join(f'{x}D' for x in table)}), greatest(p, 1))"


def _shape(moments: DataFrame, by: list[str], factor: tuple[float, ...] | None = None) -> DataFrame:
    """From sums n, s, q: location m, the rows w that take a vector to one of unit scatter (a triangle; 0 for dropped statistics), and
    the log determinant, by elimination of the scatter beside the identity.  ``a`` tells which statistics count."""
    names = [*by, "a", "p"]
    f = "1D" if factor is None else _pick(factor)
    df = moments.selectExpr(*names, "n", "q", f"{f} AS f", "transform(s, (x, i) -> IF(a[i], x / n, 0D)) AS m")
    value = "f * (x / n - m[i] * m[j])"
    df = df.selectExpr(*names, "m", f"transform(q, (r, i) -> transform(r, (x, j) -> IF(a[i] AND a[j], IF(i = j, greatest({value}, {ROUNDING}D), {value}), IF(i = j, 1D, 0D)))) AS c")
    # row i less so much of row k that its entry below the pivot becomes 0; what rounding leaves of a dependent statistic is no variance
    less = "zip_with(r, g[k], (x, y) -> x - r[k] / g[k][k] * y)"
    step = f"transform(g, (r, i) -> IF(i <= k, r, transform({less}, (x, j) -> IF(i = k + 1 AND j = i, greatest(x, 1e-9 * c[i][i]), x))))"
    both = "transform(c, (r, i) -> concat(r, transform(r, (x, j) -> IF(i = j, 1D, 0D))))"
    df = df.selectExpr(*names, "m", f"aggregate(sequence(0, {P - 2}), {both}, (g, k) -> {step}) AS g")
    w = f"transform(g, (r, i) -> transform(slice(r, {P + 1}, {P}), (x, j) -> IF(a[i] AND a[j], x / sqrt(r[i]), 0D))) AS w"
    return df.selectExpr(*names, "m", w, f"aggregate(sequence(0, {P - 1}), 0D, (x, i) -> x + ln(g[i][i])) AS logdet")


def _measured(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns and d2, the squared distance from m by w. Terms are named first, so the plan holds each once."""
    terms = [" + ".join(f"w[{i}][{j}] * (v{j} - m[{j}])" for j in range(i + 1)) + f" AS _y{i}" for i in range(P)]
    return rows.selectExpr(*kept, *terms).selectExpr(*kept, " + ".join(f"_y{i} * _y{i}" for i in range(P)) + " AS d2")


def _meeting(groups: int):
    """How a table of ``groups`` rows meets documents: by broadcast up to ``GROUPS`` rows (some 30 MB), so documents don't
    move; else by a join that Spark splits where a group is large."""
    return F.broadcast if groups <= GROUPS else lambda table: table


# medians and what judges a group ---------------------------------------------------------------------------------


def _middle(counts: DataFrame) -> DataFrame:
    """Median of ``x`` by (pool, i) from the counts ``n`` of its distinct values: thousandths, so their number is bounded."""
    by = Window.partitionBy("pool", "i")
    upto = counts.withColumn("upto", F.sum("n").over(by.orderBy("x"))).withColumn("all", F.sum("n").over(by))
    return upto.filter(2 * F.col("upto") >= F.col("all")).groupBy("pool", "i").agg(F.min("x").alias("mid"), F.max("all").alias("n"))


def _pools(stats: DataFrame, least: int) -> DataFrame:
    """One row a pool: medians c and MADs d (arrays), which statistics vary (a), how many (p), and whether it can judge (good).

    Pools are each group, each language and all documents (their names have no separator, so they are no group's)."""
    long = stats.filter("NOT base_failed").select("grp", F.posexplode(F.array(*vector())).alias("i", "x"))
    counts = long.groupBy("grp", "i", "x").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.select(F.explode(_known()).alias("pool"), "i", "x", "n").groupBy("pool", "i", "x").agg(F.sum("n").alias("n")), "counts")
    mid = written(_middle(counts), "medians")
    meet = _meeting(mid.count())
    off = counts.join(meet(mid.select("pool", "i", "mid")), ["pool", "i"]).groupBy("pool", "i", F.abs(F.col("x") - F.col("mid")).alias("x")).agg(F.sum("n").alias("n"))
    both = mid.join(_middle(off).select("pool", "i", F.col("mid").alias("mad")), ["pool", "i"])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c])  # noqa: E731  # one for each statistic
    wide = both.groupBy("pool").agg(F.max("n").alias("n"), ordered("mid").alias("c"), ordered("mad").alias("d")).withColumn("a", F.transform("d", lambda d: d > 0))
    good = (F.col("n") >= least) & F.forall(F.slice("a", 1, CORE), lambda a: a)
    return written(wide.select("pool", "c", "d", "a", F.size(F.filter("a", lambda a: a)).alias("p"), good.alias("good")), "pools")


def _language() -> Column:
    return F.concat(F.lit("l"), F.substring_index("grp", "\x01", 1))


def _known() -> Column:
    return F.array(F.col("grp"), _language(), F.lit("a"))


# the estimate ----------------------------------------------------------------------------------------------------


def _starts(vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """Vectors are taken from their medians, which are 0 therefore; ``facts`` has one row a pool and goes to them."""
    scaled = ", ".join(f"IF(a[{i}], v{i} / (1.4826D * d[{i}]), 0D)" for i in range(P))
    signs = vectors.join(facts, "pool").selectExpr("*", f"array({scaled}) AS _z").selectExpr("*", "aggregate(_z, 0D, (x, z) -> x + z * z) AS _r")
    turned = [f"IF(_r > 0, _z[{i}] * _z[{j}] / _r, 0D) AS r{i}{j}" for i, j in PAIRS]
    sums = signs.selectExpr("pool", *V, *turned).groupBy("pool").agg(*_moments(), *(F.expr(f"sum(r{i}{j}) AS r{i}{j}") for i, j in PAIRS))
    rows = lambda q: "array(" + ", ".join("array(" + ", ".join(q(i, j) for j in range(P)) + ")" for i in range(P)) + ")"
    none, own = (f"array({', '.join(x)})" for x in (["0D"] * P, [f"s{i}" for i in range(P)]))
    mads = rows(lambda i, j: f"n * pow(1.4826D * d[{i}], 2)" if i == j else "0D")
    plain = rows(lambda i, j: f"q{max(i, j)}{min(i, j)}")
    turned_ = rows(lambda i, j: f"r{max(i, j)}{min(i, j)} * d[{i}] * d[{j}]")
    kinds = ", ".join(f"named_struct('start', {k}, 'n', n, 's', {s}, 'q', {q})" for k, (s, q) in enumerate(((none, mads), (own, plain), (none, turned_))))
    return written(_shape(sums.join(facts, "pool").selectExpr("pool", "a", "p", f"inline(array({kinds}))"), ["pool", "start"]), "shape")


def _concentrated(vectors: DataFrame, shape: DataFrame, facts: DataFrame, meet) -> DataFrame:
    """The shapes of the nearest ``TRIM`` (rounded up) of each pool by each start's present shape, and whether their
    determinants still fall."""
    by = ["pool", "start"]
    rows = _measured(vectors.join(meet(shape.drop("a", "p", "logdet")), "pool"), *by, *V).withColumn("_at", F.log1p("d2") * COARSE).drop("d2")
    bins = rows.groupBy(*by, F.floor("_at").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by)
    upto = bins.select(*by, "bin", "n", F.sum("n").over(order.orderBy("bin")).alias("upto"), F.ceil(TRIM * F.sum("n").over(order)).alias("want"))
    crossing = upto.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).select(*by, F.col("bin").alias("cross"), (F.col("want") - F.col("upto") + F.col("n")).alias("want"))
    within = F.floor((F.col("_at") - F.floor("_at")) * FINE)
    fine = rows.join(meet(crossing), by).filter(F.floor("_at") == F.col("cross")).groupBy(*by, "cross", "want", within.alias("fine")).agg(F.count(F.lit(1)).alias("n"))
    last = fine.withColumn("upto", F.sum("n").over(order.orderBy("fine"))).filter("upto >= want").groupBy(*by).agg(F.min(F.struct("cross", "fine")).alias("last"))
    taken = rows.join(meet(last), by).filter(F.struct(F.floor("_at").alias("cross"), within.alias("fine")) <= F.col("last")).groupBy(*by).agg(*_moments())
    now = _shape(taken.selectExpr(*by, "n", *SUMS).join(facts, "pool"), by).join(meet(shape.select(*by, F.col("logdet").alias("_was"))), by)
    return written(now.withColumn("open", F.col("logdet") < F.col("_was") - STILL).drop("_was"), "shape")


def estimates(stats: DataFrame, least: int = 50) -> DataFrame:
    """The reweighted estimate that judges each group: grp, pool, location m, inverse factor w, which statistics count, their number p,
    and the log determinant of the winning subset."""
    pools = _pools(stats, least)
    meet = _meeting(3 * pools.count())
    fit = meet(pools.select("pool", "good"))
    groups = stats.select("grp").distinct().withColumn("lang", _language())
    groups = groups.join(fit.toDF("grp", "own"), "grp", "left").join(fit.toDF("lang", "shared"), "lang", "left")
    judges = written(groups.select("grp", F.when(F.col("own"), F.col("grp")).when(F.col("shared"), F.col("lang")).otherwise("a").alias("pool")), "judges")
    facts = meet(written(pools.drop("good").join(judges.select("pool").distinct(), "pool", "left_semi"), "facts"))
    within = judges.select("grp", F.explode(_known()).alias("pool")).join(facts.select("pool", "c"), "pool")
    vectors = stats.filter("NOT base_failed").select("grp", *vector()).join(meet(within), "grp")
    vectors = written(vectors.select("pool", *((F.col(v) - F.col("c")[i]).alias(v) for i, v in enumerate(V))), "vectors")
    shape = _starts(vectors, facts)
    facts = facts.select("pool", "a", "p", "c")
    shape = _concentrated(vectors, shape, facts, meet).drop("open")  # a start's determinant is none of three quarters
    ended: list[DataFrame] = []
    for step in range(MOST_STEPS):
        now = _concentrated(vectors, shape, facts, meet)
        ended.append(now.filter("NOT open" if step + 1 < MOST_STEPS else "true").drop("open"))
        shape = now.filter("open").drop("open")
        if shape.isEmpty():
            break
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("pool").orderBy(F.round("logdet", 6), "start"))
    best = written(found.withColumn("place", rank).filter("place = 1").drop("place", "start"), "best")
    near = _measured(vectors.join(meet(best.drop("a")), "pool"), "pool", "p", *V).filter(f"d2 <= {_pick(CONSISTENT_75)} * {_pick(CHI_975)}").groupBy("pool").agg(*_moments())
    final = _shape(near.selectExpr("pool", "n", *SUMS).join(facts, "pool"), ["pool"], CONSISTENT_975).drop("logdet")
    final = final.join(meet(best.select("pool", "logdet")), "pool").join(facts.select("pool", "c"), "pool")
    final = written(final.selectExpr("pool", "a", "p", "logdet", "zip_with(m, c, (x, y) -> x + y) AS m", "w"), "shape")
    return written(judges.join(meet(final), "pool"), "estimates")


def judged(stats: DataFrame, cut: tuple[float, ...] = CUT, least: int = 50) -> DataFrame:
    """``stats`` with d2 (null only where no document passes the base rule) and kept."""
    found = estimates(stats, least).select("grp", "p", "m", "w")
    names = stats.columns
    rows = _measured(stats.select("*", *vector()).join(_meeting(found.count())(found), "grp", "left"), *(f"`{n}`" for n in names), "p").withColumn("_cut", F.expr(_pick(cut)))
    return rows.select(*names, "d2", (~F.col("base_failed") & (F.col("d2") <= F.col("_cut"))).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    return judged(written(statistics(docs), "statistics"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    rows = judged(written(statistics(docs, F.struct("*").alias("_row")), "statistics"))
    return rows.filter("kept").select("_row.*")
