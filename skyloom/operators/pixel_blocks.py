"""3x3 pixel blocks in closed form: determinant, adjugate, reciprocal condition number, cut and solve."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

NAMES = ("b_ii", "b_iq", "b_iu", "b_qq", "b_qu", "b_uu")
#: Pixels at or below this reciprocal condition number are removed.
RCOND_CUT = 0.1


@dataclass
class Block:
    """A symmetric block (a b c; b d e; c e f) as columns."""

    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column

    @classmethod
    def of(cls, *names: str) -> Block:
        return cls(*map(F.col, names or NAMES))

    def adjugate(self) -> Block:
        a, b, c, d, e, f = self.a, self.b, self.c, self.d, self.e, self.f
        return Block(d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)

    def determinant(self) -> Column:
        adj = self.adjugate()
        return self.a * adj.a + self.b * adj.b + self.c * adj.c

    def norm1(self) -> Column:
        a, b, c, d, e, f = (F.abs(x) for x in (self.a, self.b, self.c, self.d, self.e, self.f))
        return F.greatest(a + b + c, b + d + e, c + e + f)

    def times(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        return self.a * x + self.b * y + self.c * z, self.b * x + self.d * y + self.e * z, self.c * x + self.e * y + self.f * z

    def rcond(self) -> Column:
        """In the 1-norm; 0 for a singular block."""
        det = self.determinant()
        below = (self.norm1() * self.adjugate().norm1()).cast("double")
        return F.when(det == 0, F.lit(0.0)).otherwise(F.abs(det).cast("double") / below)


def with_rcond(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("rcond", Block.of().rcond())


def kept(blocks: DataFrame, cut: float = RCOND_CUT) -> DataFrame:
    return with_rcond(blocks).filter(F.col("rcond") > cut)


def degenerate(blocks: DataFrame, cut: float = RCOND_CUT) -> DataFrame:
    return with_rcond(blocks).filter(F.col("rcond") <= cut)


def without_degenerate(tod: DataFrame, bad: DataFrame) -> DataFrame:
    """Samples of removed pixels lose their pixel (-1) and their signal (0); their noise stays."""
    gone = bad.select(F.col("pix").alias("_gone"))
    out = tod.join(gone, F.col("pix") == F.col("_gone"), "left")
    out = out.withColumn("pix", F.when(F.col("_gone").isNotNull(), F.lit(-1)).otherwise(F.col("pix")).cast("long"))
    if "signal" in tod.columns:
        out = out.withColumn("signal", F.when(F.col("_gone").isNotNull(), F.lit(0.0)).otherwise(F.col("signal")))
    return out.drop("_gone")


def solved(blocks: DataFrame, rhs: DataFrame, cut: float = RCOND_CUT) -> DataFrame:
    """The binned map: each kept pixel's block inverse times its right-hand side; with hits and rcond."""
    return solved_rows(blocks.join(rhs, "pix"), cut)


def solved_rows(rows: DataFrame, cut: float = RCOND_CUT) -> DataFrame:
    """The same where one table has both."""
    block = Block.of()
    top = block.adjugate().times(F.col("i"), F.col("q"), F.col("u"))
    det = block.determinant().cast("double")
    return kept(rows, cut).select("pix", "hits", "rcond", *((n.cast("double") / det).alias(s) for n, s in zip(top, "iqu")))


def inverse(blocks: DataFrame, cut: float = RCOND_CUT) -> DataFrame:
    """pix and the inverse block's upper triangle m_ii .. m_uu."""
    block = Block.of()
    det = block.determinant().cast("double")
    adj = block.adjugate()
    return kept(blocks, cut).select("pix", "hits", "rcond", *((x.cast("double") / det).alias(n.replace("b_", "m_")) for x, n in zip((adj.a, adj.b, adj.c, adj.d, adj.e, adj.f), NAMES)))


def diagonal(blocks: DataFrame) -> DataFrame:
    """The Jacobi preconditioner: 1 over each diagonal entry, 0 where that is 0."""
    return blocks.select("pix", *(F.when(F.col(n) != 0, 1.0 / F.col(n)).otherwise(F.lit(0.0)).alias(s) for n, s in (("b_ii", "i"), ("b_qq", "q"), ("b_uu", "u"))))


def hit_shares(tod: DataFrame, groups: Column) -> DataFrame:
    """The a-priori deflation basis: the share of a pixel's samples in each group of time."""
    counts = tod.filter("pix >= 0").groupBy("pix", groups.alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("pix").agg(F.sum("n").alias("hits"))
    return counts.join(total, "pix").select("pix", "grp", (F.col("n") / F.col("hits")).alias("z"))


def full_sky(sky: DataFrame, npix: int, values: list[str]) -> DataFrame:
    """Every pixel of the sphere, 0 where nothing was seen."""
    every = sky.sparkSession.range(npix).withColumnRenamed("id", "pix")
    return every.join(sky, "pix", "left").select("pix", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))
