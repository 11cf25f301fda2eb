"""Substring search by an index of trigrams that lies beside a table.

Every three characters in a row of a folded text are a posting (column, gram, key). A term's rows are among those
that have all its grams in one column; the postings are sorted by gram, so that only row groups with the term's grams
are read, and what they name is checked against the texts themselves. Terms of less than three characters have no
gram and scan the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelane.operators.commits import CommittedTable
from carelane.operators.predicates import search

SIZE = 3
#: Keys that are pushed into the scan of the texts; more are joined.
PUSHED_KEYS = 1_000


def grams(text: Column) -> Column:
    """Distinct trigrams of a folded text; none of a null or shorter one."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    last = F.length(folded) - (SIZE - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(folded, i, F.lit(SIZE))))


class TextIndex:
    """An index of some columns of a table (schema in DDL) by its key, under a folder: ``rows`` sorted by key, ``grams`` by gram.

    Both are committed tables. Postings are committed before their rows: until these are there, and if they never
    come, what the postings name is not found among the rows.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str, columns: list[str], files: int | None = None, group_bytes: int | None = None):
        self.spark, self.key, self.columns = spark, key, columns
        how = {"files": files, "group_bytes": group_bytes}
        self.table = CommittedTable(spark, f"{path}/rows", ddl, None, layout={"order": [key]} | how)
        kind = self.table.schema[key].dataType.simpleString()
        self.postings = CommittedTable(spark, f"{path}/grams", f"c int, gram string, key {kind}", None, layout={"order": ["gram", "c", "key"]} | how)

    def add(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Index further rows, those of a batch (stream, number) once; rows without a key are left out; how many."""
        rows = rows.where(F.col(self.key).isNotNull())
        every = F.array(*[F.struct(F.lit(i).alias("c"), grams(F.col(c)).alias("grams")) for i, c in enumerate(self.columns)])
        by_column = rows.select(F.col(self.key).alias("key"), F.inline(every))
        self.postings.append(by_column.select("key", "c", F.explode("grams").alias("gram")), batch)
        return self.table.append(rows, batch)

    def compact(self) -> None:
        """Few files again after many additions; a posting that came twice is kept once."""
        self.postings.compact(lambda rows: rows.distinct())
        self.table.compact()

    def rows(self) -> DataFrame:
        return self.table.read()

    def candidates(self, term: str) -> DataFrame | None:
        """Keys of rows that have all grams of a term in one column; None for a term without a gram."""
        wanted = self.spark.range(1).select(grams(F.lit(term))).first()[0]  # as many as the term has characters
        if not wanted:
            return None
        postings = self.postings.read().where(F.col("gram").isin(wanted))
        return postings.groupBy("c", "key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("key").distinct()

    def search(self, term: str) -> DataFrame:
        """Rows of which some column has the term, case folded, as ``predicates.search``."""
        rows, found = self.rows(), self.candidates(term)
        match = search(term, *[F.col(c) for c in self.columns])
        if found is None:
            return rows.where(match)
        few = [r["key"] for r in found.limit(PUSHED_KEYS + 1).collect()]
        if len(few) <= PUSHED_KEYS:
            return rows.where(F.col(self.key).isin(few) & match)
        return rows.join(found.withColumnRenamed("key", "__key"), F.col(self.key) == F.col("__key"), "left_semi").where(match)
