"""Table functions for SQL: they take whole tables, partitioned, and give tables.

``register`` makes them known to a session; they are then called as
``SELECT * FROM top_rows(TABLE(t), by => 'k', first => 'v', n => 3)``. A partition
streams through one task row by row, and only what is to be returned is held.
"""

from __future__ import annotations

import bisect

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn


class TopRows:
    """The first ``n`` rows of each value of a column, by another column: the rows as
    they came in, whatever the table's columns, and their ``place``.

    Descending, unless ``ascending``. What a partition has beyond ``n`` rows is
    passed by. Nulls come last; equal rows keep the order in which they came."""

    def __init__(self):
        self.seen = 0

    @staticmethod
    def analyze(table, by, first, n, ascending=None):
        names = [f.name for f in table.dataType.fields]
        for argument in (by, first):
            if argument.value not in names:
                raise ValueError(f"top_rows: {argument.value!r} is no column of the table")
        out = StructType([*table.dataType.fields, StructField("place", IntegerType())])
        up = bool(ascending.value) if ascending is not None else False
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn(first.value, ascending=up, overrideNullsFirst=False)])

    def eval(self, table, by, first, n, ascending=None):
        self.seen += 1
        if self.seen <= n:
            yield (*table, self.seen)


class GraphNeighbours:
    """A node's neighbours, the ``most`` smallest by name with their relation, and
    how many links it has in all.

    Called with ``TABLE(links) PARTITION BY (node), most => 5``; links have the columns node,
    neighbour and relation. A hub's links pass through one task, which holds
    ``most`` of them. A table that was cut before (``graph.first_links``) has a column
    ``links`` as well: how many links a row stands for."""

    def __init__(self):
        self.node, self.count, self.held, self.cut = None, 0, [], None

    @staticmethod
    def analyze(table, most):
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        missing = {"node", "neighbour", "relation"} - kinds.keys()
        if missing:
            raise ValueError(f"graph_neighbours: the table has no {', '.join(sorted(missing))}")
        if most.value is None or most.value < 0:
            raise ValueError("graph_neighbours: most must be a number from 0 on")
        return AnalyzeResult(StructType([StructField("node", kinds["node"]), StructField("neighbour", kinds["neighbour"]), StructField("relation", StringType()), StructField("place", IntegerType()), StructField("links", LongType())]))

    def eval(self, table, most):
        if table["neighbour"] is None:  # no link
            return
        if self.cut is None:
            self.cut = "links" in table
        self.node, self.count = table["node"], self.count + (table["links"] if self.cut else 1)
        bisect.insort(self.held, (table["neighbour"], table["relation"] or ""))
        del self.held[most:]

    def terminate(self):
        for place, (neighbour, relation) in enumerate(self.held, 1):
            yield self.node, neighbour, relation, place, self.count


def register(spark: SparkSession) -> None:
    spark.udtf.register("top_rows", udtf(TopRows))
    spark.udtf.register("graph_neighbours", udtf(GraphNeighbours))
