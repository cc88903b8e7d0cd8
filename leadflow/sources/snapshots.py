"""Versioned tables: a version is a list of files, made current by one atomic rename. Survey: SNK6, E6, T16, ST1.

A store is a folder with `data` (Parquet folders that are written once and never changed) and `versions` (one small JSON
file a version: for each table its schema and, by part, the folders that hold it). A writer puts its files beside the old
ones and then renames the next version's file into place, which fails if somebody else was first. So readers always see
one whole version, a failed write leaves nothing but unread files, and old versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadflow.operators.relations import upsert


class Outdated(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Numbers of the versions, ascending."""
        return [int(x[:-5]) for x in self._names(f"{self.path}/versions") if x.endswith(".json") and x[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the current one if none is given) consists of: version, tables, applied."""
        known = self.versions()
        if not known and version is None:
            return {"version": -1, "tables": {}, "applied": {}}
        n = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/versions/{n:010d}.json", wholetext=True).first().value)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as it is in a version; files that later versions add are not seen."""
        t = self.manifest(version)["tables"][table]
        schema = StructType.fromJson(t["schema"])
        folders = sorted(f"{self.path}/{x}" for x in t["parts"].values())
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, base: dict, tables: dict, applied: dict | None = None) -> int:
        new = {"version": base["version"] + 1, "tables": base["tables"] | tables, "applied": base["applied"] | (applied or {})}
        fs, at = self._fs(f"{self.path}/versions/{new['version']:010d}.json")
        _, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        fs.mkdirs(at.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        jvm, gate = self.spark._jvm, self.spark.sparkContext._gateway
        option = jvm.org.apache.hadoop.fs.Options.Rename
        none = gate.new_array(option, 1)
        none[0] = getattr(option, "NONE")  # noqa: B009  never over a file that is there
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(at), none)
        except Exception as e:
            if fs.exists(at):
                raise Outdated(f"version {new['version']} is there already") from e
            raise
        return new["version"]

    def put(self, tables: Mapping[str, DataFrame], applied: Mapping[str, int] | None = None, base: dict | None = None) -> int:
        """A new version in which all of these tables are replaced whole, at once; `applied` are marks kept with it."""
        base = base or self.manifest()
        folder, new = f"data/{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
            new[name] = {"schema": df.schema.jsonValue(), "parts": {"": f"{folder}/{name}"}}
        return self._commit(base, new, dict(applied or {}))

    def replace_parts(self, table: str, rows: DataFrame, by: str, also: Sequence[str] = ()) -> int:
        """A new version in which the parts (values of `by`) that rows has, and those of `also`, hold these rows; others stay. SNK6.

        Files come from ranges of the part and a hash of the row, so a part with a third of all rows is many files. A
        table keeps the columns it began with. `also` empties parts that have no rows now.
        """
        base = self.manifest()
        old = base["tables"].get(table)
        schema = StructType.fromJson(old["schema"]) if old else rows.schema
        rows = rows.select(*schema.names)
        plain = [f.name for f in schema if "map<" not in f.dataType.simpleString()]
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_part", F.col(by)).repartitionByRange("_part", F.xxhash64(*plain)).sortWithinPartitions("_part")
        dealt.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        gone = {f"_part={x}" for x in also}
        parts = {k: v for k, v in (old["parts"] if old else {}).items() if k not in gone}
        parts |= {x: f"{folder}/{x}" for x in self._names(f"{self.path}/{folder}") if x.startswith("_part=")}
        return self._commit(base, {table: {"schema": schema.jsonValue(), "parts": parts}})

    def upsert(self, table: str, changes: DataFrame, key: str) -> int:
        """A new version in which rows of changes stand for those of the same key, and new keys are added. E6, T16."""
        base = self.manifest()
        return self.put({table: upsert(self.read(table, base["version"]), changes, key)}, base=base)
