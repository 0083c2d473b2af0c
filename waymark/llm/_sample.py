"""Bounded samples by class that no single task has to gather from all the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_LOTS = 1 << 31


def lowest(rows: DataFrame, by: str, size: int, most: int) -> DataFrame:
    """``doc_id`` and ``by``: of each class the ``size`` ids with the smallest hash, fewer where it has fewer.

    Classes are counted first; twice the expected share of the hashes is let through where the rows are, and
    what is ranked then is some ``2 * size`` ids of a class at any size of the table. There may be ``most`` classes.
    """
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(_LOTS))
    counts = {r[0]: r[1] for r in rows.groupBy(by).agg(F.count(F.lit(1))).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} classes in {by}")
    # A hash below this is had by 2 * size ids on average; fewer than size have it once in 10^100 tables.
    edges = {c: _LOTS if n <= 4 * size else _LOTS * 2 * size // n for c, n in counts.items()}
    if not edges:
        return rows.select("doc_id", by).limit(0)
    edge = F.element_at(F.create_map(*[F.lit(x) for c, e in edges.items() for x in (c, e)]), F.col(by))
    some = rows.filter(lot < edge).select("doc_id", by).distinct()
    nth = F.row_number().over(Window.partitionBy(by).orderBy(lot, "doc_id"))
    return some.withColumn("nth", nth).filter(F.col("nth") <= size).select("doc_id", by)
