"""A table in parts whose changes are seen whole or not at all.

Every change writes the parts that it replaces into a folder of its own version, and then names them in a new manifest, which
takes effect by one rename. Readers take the last manifest and the parts that it names: a job that ends before
its manifest leaves the table as it was, and its folder is written over by the next one. One job writes at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import get_text, list_names, put_text, remove

_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Manifest:
    """The version in which each part (its folder's name) was written last, and the last batch of each source."""

    version: int
    parts: dict[str, int]
    batches: dict[str, int]


@dataclass(frozen=True)
class PartTable:
    """Rows of ``schema`` (without ``by``) in parts by the text column ``by``, under ``path`` in a folder that all executors reach.

    The manifest has an entry for each part, so parts are for months or symbols, not for single rows.
    """

    spark: SparkSession
    path: str
    schema: str
    by: str

    def manifest(self) -> Manifest:
        names = sorted(n for n in list_names(self.spark, f"{self.path}/manifests") if n.endswith(".json"))
        return Manifest(**json.loads(get_text(self.spark, f"{self.path}/manifests/{names[-1]}"))) if names else Manifest(0, {}, {})

    def commit(self, rows: DataFrame, source: str = "", batch: int | None = None) -> Manifest:
        """Replace all parts that ``rows`` has rows of; others stay. A ``batch`` of a ``source`` that is in already changes nothing."""
        last = self.manifest()
        if batch is not None and last.batches.get(source, -1) >= batch:
            return last
        version = last.version + 1
        folder = f"{self.path}/data/version={version}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(self.by).parquet(folder)
        new = {name: version for name in list_names(self.spark, folder) if name.startswith(f"{self.by}=")}
        batches = last.batches if batch is None else last.batches | {source: batch}
        out = Manifest(version, last.parts | new, batches)
        put_text(self.spark, f"{self.path}/manifests/{version:012d}.json", json.dumps(out.__dict__))
        return out

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """The table as of a manifest, the last one by default; a filter on ``by`` prunes parts."""
        parts = (manifest or self.manifest()).parts
        whole = f"{self.schema}, {self.by} string, version int"
        if not parts:
            return self.spark.createDataFrame([], whole).drop("version")
        paths = [f"{self.path}/data/version={version}/{name}" for name, version in sorted(parts.items())]
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths).drop("version")

    def values(self) -> list[str | None]:
        """The value of each part."""
        names = [n.partition("=")[2] for n in sorted(self.manifest().parts)]
        return [None if n == _NULL else unquote(n) for n in names]

    def vacuum(self) -> None:
        """Remove versions and manifests that the last manifest has no use of; nobody may be reading by an older one."""
        last = self.manifest()
        for name in list_names(self.spark, f"{self.path}/manifests"):
            if name != f"{last.version:012d}.json":
                remove(self.spark, f"{self.path}/manifests/{name}")
        for folder in list_names(self.spark, f"{self.path}/data"):
            version = int(folder.partition("=")[2])
            for name in list_names(self.spark, f"{self.path}/data/{folder}"):
                if last.parts.get(name) != version:
                    remove(self.spark, f"{self.path}/data/{folder}/{name}")
            if version not in last.parts.values():
                remove(self.spark, f"{self.path}/data/{folder}")


def bars_by_symbol(spark: SparkSession, path: str) -> PartTable:
    """A table of bars in parts by symbol, as the refresh replaces them."""
    from tidewheel.sources.bars import BAR_SCHEMA

    return PartTable(spark, path, BAR_SCHEMA.partition(", ")[2], "symbol")


def spread_by(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt and sorted by ranges of ``order``, so that a large part is spread over several writers."""
    return rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
