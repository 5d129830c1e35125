"""A tile cache that runs share: an append-only table of bodies with their CRC, the best entry of each tile counting."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import pruning

KIND = "z int, x int, y int, status int, body binary, crc bigint, length bigint, stored timestamp"


class TileStore:
    """Tiles of one service under a path. A store() is one commit of new files, so readers and other writers are not in its way."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """All that was ever stored."""
        try:
            return self.spark.read.schema(KIND).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], KIND)

    def store(self, tiles: DataFrame) -> None:
        """tiles: z, x, y, status (present, absent or derived) and body."""
        body = F.when(F.col("status") != pruning.NO_TILE, F.col("body"))
        length = F.coalesce(F.octet_length(body).cast("bigint"), F.lit(0).cast("bigint"))
        crc = F.coalesce(F.crc32(body), F.lit(0).cast("bigint"))
        rows = tiles.select(*(F.col(c).cast("int").alias(c) for c in ("z", "x", "y", "status")), body.alias("body"), crc.alias("crc"), length.alias("length"), F.current_timestamp().alias("stored"))
        rows.where((F.col("status") == pruning.NO_TILE) | (F.col("length") > 0)).write.mode("append").partitionBy("z").parquet(self.path)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """wanted (z, x, y) with `status` and `body` of the best entry that holds: the service's own before a derived one, then the latest.

        A body whose CRC or length is not the stored one counts as no entry.
        """
        held = self.entries().join(wanted.select("z", "x", "y").distinct(), ["z", "x", "y"])
        whole = F.when(F.col("status") == pruning.NO_TILE, (F.col("length") == 0) & (F.col("crc") == 0)).otherwise((F.octet_length("body") == F.col("length")) & (F.crc32("body") == F.col("crc")))
        rank = F.struct((F.col("status") != pruning.DERIVED).alias("own"), "stored")
        best = held.where(whole).groupBy("z", "x", "y").agg(F.max_by(F.struct("status", "body"), rank).alias("e"))
        return wanted.join(best.select("z", "x", "y", "e.status", "e.body"), ["z", "x", "y"], "left")
