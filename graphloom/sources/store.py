"""The graph store: nodes and edges as partitioned Parquet, replaced in whole snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class GraphStore:
    """nodes partitioned by label and sorted by name, and edges by rel_type and source, below a folder; a pointer file names the current snapshot.

    A question on some labels and types reads only their partitions, and of those mostly the row groups that hold its names.

    A snapshot is written beside the old one and becomes current by one small write at the end,
    so readers see the old graph or the new one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, nodes: DataFrame, edges: DataFrame) -> str:
        """Replaces the graph; nodes need label, edges rel_type. Returns the snapshot's name."""
        name = uuid.uuid4().hex[:12]
        nodes.repartitionByRange("label", "name").sortWithinPartitions("label", "name").write.partitionBy("label").parquet(f"{self.root}/{name}/nodes")
        edges.repartitionByRange("rel_type", "src").sortWithinPartitions("rel_type", "src").write.partitionBy("rel_type").parquet(f"{self.root}/{name}/edges")
        current = json.dumps([name, nodes.schema.json(), edges.schema.json()])
        self.spark.range(1).select(F.lit(current).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.root}/_CURRENT")
        return name

    def _read(self, part: int) -> DataFrame:
        current = json.loads(self.spark.read.text(f"{self.root}/_CURRENT").first()[0])
        schema = StructType.fromJson(json.loads(current[part]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{current[0]}/{'nodes' if part == 1 else 'edges'}")

    def nodes(self) -> DataFrame:
        return self._read(1)

    def edges(self) -> DataFrame:
        return self._read(2)

    def clear(self, project: str | None = None) -> str:
        """Removes a project's nodes, by the prefix of their file path, and all edges that touch them; without project everything."""
        nodes, edges = self.nodes(), self.edges()
        if project is None:
            return self.write(nodes.limit(0), edges.limit(0))
        gone = nodes.where(F.col("file_path").startswith(project)).select("key").distinct()
        kept = nodes.where(~F.coalesce(F.col("file_path").startswith(project), F.lit(False)))
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("key", end), end, "left_anti")
        return self.write(kept, edges)
