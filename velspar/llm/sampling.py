"""Bounded samples of labelled documents, and one row for each doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.session import materialise

_RANGE = 1 << 24


def one_row_each(docs: DataFrame) -> DataFrame:
    """Rows repeated under one doc_id count once, the least in the order of the other columns. Nothing is shuffled but ids where none repeats."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    others = [c for c in docs.columns if c != "doc_id"]
    return materialise(docs.sparkSession, docs.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*"), "one-row-each")


def least_hashes(rows: DataFrame, by: str, most: dict[object, int] | int) -> DataFrame:
    """(doc_id, by): of each value of `by` all doc_ids, which must be distinct, up to `most`; of more, those whose hash lies in the share that gives `most`.

    The share of a value follows from its counted rows, so nothing is ranked. Hashes fall evenly: the number picked is `most` but for its
    square root or so, whatever the input's size.
    """
    wanted = F.lit(most) if isinstance(most, int) else F.coalesce(*[F.when(F.col(by) == value, n) for value, n in most.items()], F.lit(0))
    counted = rows.groupBy(by).agg(F.count("*").alias("n_of_value"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE))
    wanted = wanted.cast("bigint")
    return rows.select("doc_id", by).join(F.broadcast(counted), by).where(place * F.col("n_of_value") < wanted * _RANGE).select("doc_id", by)
