"""What the operators on vectors share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def common_width(rows: DataFrame, vector: str) -> int:
    """The most frequent number of components; 0 of no rows."""
    got = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return got[0].d if got else 0


def widths(rows: DataFrame, vector: str) -> list[int]:
    """The numbers of components that occur: one for each kind of embedding in the table."""
    return sorted(r.d for r in rows.select(F.size(vector).alias("d")).distinct().collect())
