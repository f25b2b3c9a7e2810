"""Several tables under one commit log: a load is seen whole or not at all.

A root folder holds ``data``, immutable Parquet folders with names of their own,
and ``_log``, one small JSON file a version that names the folders of every table.
Writers first write all folders, then put the next version's file, which must not
exist yet. A writer that dies before that leaves folders that no version names; of
two writers with the same base one gets :class:`Conflict`. Readers take a version
and see its folders only, whatever is written meanwhile, until :meth:`vacuum`.

The put is atomic where the file system refuses to rename onto a file in one step
(HDFS and the like) and, on local file systems, by a hard link.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .readers import exists
from .writers import put_text


class Conflict(RuntimeError):
    """Another writer has put the version that follows the base."""


def put_new(spark: SparkSession, text: str, path: str) -> bool:
    """Write a small file unless one of that name exists; whether it was written."""
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    put_text(spark, text, aside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    try:
        if fs.getUri().getScheme() == "file":
            os.link(source.toUri().getPath(), target.toUri().getPath())
        else:
            keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(source, target, keep)
    except FileExistsError:
        return False
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(source, False)
    return True


class Versions:
    """The tables under ``root`` and their versions, numbered from 0."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, folder: str) -> list[str]:
        path = f"{self.root}/{folder}"
        if not exists(self.spark, path):
            return []
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return [s.getPath().getName() for s in target.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(target)]

    def numbers(self) -> list[int]:
        """The versions that can be read, in order."""
        return sorted(int(name[:-5]) for name in self._files("_log") if name.endswith(".json") and name[0] != ".")

    def state(self, version: int | None = None) -> dict:
        """version, tables (name -> schema and folders) and facts of a version, by default the last.

        Before the first version there are no tables and the version is -1.
        """
        known = self.numbers()
        if version is None:
            version = known[-1] if known else -1
        if version == -1:
            return {"version": -1, "tables": {}, "facts": {}}
        if version not in known:
            raise ValueError(f"no version {version} in {self.root}")
        return json.loads(self.spark.read.text(f"{self.root}/_log/{version:020d}.json", wholetext=True).first()[0])

    def stage(self, df: DataFrame, name: str, partition_by: str | None = None) -> dict:
        """Write a folder that no version names yet; what :meth:`commit` takes for it."""
        folder = f"{name}-{uuid.uuid4().hex}"
        writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
        writer.parquet(f"{self.root}/data/{folder}")
        return {"schema": json.loads(df.schema.json()), "folders": [folder]}

    def commit(self, tables: dict[str, dict], base: int, facts: dict | None = None) -> int:
        """Make ``tables`` the version that follows ``base``; returns its number."""
        state = {"version": base + 1, "tables": tables, "facts": facts or {}}
        if not put_new(self.spark, json.dumps(state), f"{self.root}/_log/{base + 1:020d}.json"):
            raise Conflict(f"version {base + 1} of {self.root} exists")
        return base + 1

    def load(self, tables: dict[str, DataFrame], reset: bool = False, facts: dict | None = None, partition_by: dict[str, str] | None = None) -> int:
        """Write all ``tables`` as one version; a populated root is refused unless ``reset``."""
        base = self.state()["version"]
        if base >= 0 and not reset:
            raise ValueError(f"{self.root} already exists; reset to load it again")
        return self.commit({name: self.stage(df, name, (partition_by or {}).get(name)) for name, df in tables.items()}, base, facts)

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """A table of ``state`` (see :meth:`state`), by default of the last version."""
        table = (state or self.state())["tables"][name]
        schema = StructType.fromJson(table["schema"])
        if not table["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in table["folders"]])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all but the last ``keep`` versions and delete folders that none of these names.

        Not to be run while a writer is at work: what it has staged isn't named yet.
        """
        known = self.numbers()
        named = {f for v in known[-keep:] for t in self.state(v)["tables"].values() for f in t["folders"]}
        gone = [f"_log/{v:020d}.json" for v in known[:-keep]] + [f"data/{f}" for f in self._files("data") if f not in named]
        for path in gone:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return gone
