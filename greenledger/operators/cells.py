"""A grid index over the vertices of map features.

A feature is stored as one row per vertex with the cell of the grid it lies in, never as one array, so an outline
of any length spreads. A view is padded and turned into the cells it touches; a cell wholly inside the view accepts its vertices without a
test. Only vertices in those cells are looked at, and a store written by cell (``write_index``) reads no other files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAD_LON, PAD_LAT = 12.0, 8.0  # Fixed values: what a view is padded by.
CELL = 10.0


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def index_vertices(vertices: DataFrame, size: float = CELL) -> DataFrame:
    """Rows of (feature, lon, lat) with ``cell_x`` and ``cell_y``; vertices without coordinates are in no cell and touch no view."""
    return vertices.withColumns({"cell_x": _cell(F.col("lon"), size), "cell_y": _cell(F.col("lat"), size)})


def write_index(indexed: DataFrame, path: str) -> None:
    indexed.repartition("cell_x").write.mode("overwrite").partitionBy("cell_x").parquet(path)


def view_cells(spark: SparkSession, views: list[tuple], size: float = CELL) -> DataFrame:
    """(view, cell_x, cell_y, whole, bounds) for padded views (name, west, east, south, north): as many rows as the views have cells."""
    rows = []
    for name, west, east, south, north in views:
        w, e, s, n = west - PAD_LON, east + PAD_LON, south - PAD_LAT, north + PAD_LAT
        for x in range(math.floor(w / size), math.floor(e / size) + 1):
            for y in range(math.floor(s / size), math.floor(n / size) + 1):
                whole = w <= x * size and (x + 1) * size <= e and s <= y * size and (y + 1) * size <= n
                rows.append((name, x, y, whole, w, e, s, n))
    return spark.createDataFrame(rows, "view string, cell_x int, cell_y int, whole boolean, _west double, _east double, _south double, _north double")


def features_in_views(indexed: DataFrame, views: list[tuple], feature: str, size: float = CELL) -> DataFrame:
    """``feature``, ``view`` and ``touches`` for every feature and view: any vertex inside the padded view.

    The cells of the views, a list bounded by the globe's cells per view, meet the vertices in their cells; a feature's vertices are folded
    to one flag per view where they lie before anything is shuffled.
    """
    spark = indexed.sparkSession
    cells = view_cells(spark, views, size)
    near = indexed.join(F.broadcast(cells), ["cell_x", "cell_y"])
    inside = F.col("whole") | (F.col("lon").between(F.col("_west"), F.col("_east")) & F.col("lat").between(F.col("_south"), F.col("_north")))
    touched = near.filter(inside).select(feature, "view").distinct().withColumn("touches", F.lit(True))
    every = indexed.select(feature).distinct().withColumn("view", F.explode(F.array(*[F.lit(v[0]) for v in views])))
    return every.join(touched, [feature, "view"], "left").withColumn("touches", F.coalesce("touches", F.lit(False)))
