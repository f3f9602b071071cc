"""Substring search over the published index by postings of one to three letters.

Every row stands under each gram (one to three letters that follow each other) of its lower-cased name and brand,
with the columns that a listing shows. Postings lie in the order of their grams, so that a search reads the row
groups of one gram only: the rarest of the term's. What it finds is then verified by ``browse``, so
results are those of a scan. A published index is built once and searched many times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.plans import browse
from pricewake.sources.files import without_nan

GRAM = 3
SEARCHED = ("reddit_name", "brand")


def grams_of(text: Column, shortest: int = 1, longest: int = GRAM) -> Column:
    """The distinct grams of a lower-cased text; none of a null."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def of(n: int) -> Column:
        starts = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - n + 1))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of(n) for n in range(shortest, longest + 1)]))


@dataclass
class GramIndex:
    """Postings of an index below a path: ``build`` once, then search."""

    spark: SparkSession
    path: str

    def build(self, index: DataFrame) -> GramIndex:
        """Write the postings, how many rows each gram has, and the rows themselves."""
        rows = without_nan(index.select(*browse.LISTED))
        rows.write.mode("overwrite").parquet(f"{self.path}/rows")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows")
        grams = F.array_distinct(F.concat(*[grams_of(F.col(c)) for c in SEARCHED]))
        postings = rows.select(F.explode(grams).alias("gram"), *browse.LISTED)
        # By name within a gram, so that a gram of very many rows is several parts.
        dealt = postings.repartitionByRange("gram", "reddit_name", "brand").sortWithinPartitions("gram")
        dealt.write.mode("overwrite").parquet(f"{self.path}/postings")
        sizes = self._postings().groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
        sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/sizes")
        return self

    def _postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def candidates(self, term: str) -> DataFrame:
        """Rows that hold the rarest gram of the term; all rows for an empty term, none if a gram is unknown."""
        n = min(GRAM, len(term))
        if not n:
            return self.spark.read.parquet(f"{self.path}/rows")
        # A handful of rows: the grams of one term.
        wanted = self.spark.range(1).select(grams_of(F.lit(term), n, n).alias("g")).first()["g"]
        sizes = self.spark.read.parquet(f"{self.path}/sizes").filter(F.col("gram").isin(wanted)).collect()
        known = {row["gram"]: row["rows"] for row in sizes}
        rarest = min(wanted, key=lambda g: (known.get(g, 0), g))
        return self._postings().filter(F.col("gram") == rarest).drop("gram")

    def search(self, term: str) -> DataFrame:
        return browse.search(self.candidates(term), term)

    def suggest_brands(self, term: str, limit: int = browse.BRAND_SUGGESTIONS) -> DataFrame:
        return browse.suggest_brands(self.candidates(term), term, limit)

    def suggest_names(self, term: str, limit: int = browse.NAME_SUGGESTIONS) -> DataFrame:
        return browse.suggest_names(self.candidates(term), term, limit)
