"""Vector expressions; sums are kept in double."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(df: DataFrame, column: str = "vector", strict: bool = True) -> DataFrame:
    """L2-normalise a vector column. A zero vector is an error, or passes unchanged where `strict` is False."""
    length = F.when(F.col("_norm") > 0, F.col("_norm"))
    length = F.coalesce(length, F.raise_error(F.lit("a zero vector has no direction")).cast("double")) if strict else F.coalesce(length, F.lit(1.0))
    return df.withColumn("_norm", norm(column)).withColumn("_length", length).withColumn(column, F.transform(column, lambda x: x.cast("double") / F.col("_length"))).drop("_norm", "_length")


def weighted_concat(parts: list[tuple[str, float]]) -> Column:
    """Several vectors as one, each times its weight; a cosine of the result weighs theirs by the squares."""

    def scaled(column: str, weight: float) -> Column:
        return F.transform(column, lambda x: x.cast("double") * weight)

    return F.concat(*[scaled(c, w) for c, w in parts])
