"""All queries of the raster engine by name, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterfold.plans import effects, files, imaging, measures, pages, pictures


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**imaging.QUERIES, **measures.QUERIES, **files.QUERIES, **effects.QUERIES, **pages.QUERIES, **pictures.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**imaging.SQL, **measures.SQL, **files.SQL, **effects.SQL, **pages.SQL, **pictures.SQL}
