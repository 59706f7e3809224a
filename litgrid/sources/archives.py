"""Members of zip files as a Spark data source: planned from central directories, read in ranges of members."""

from __future__ import annotations

import glob
import os
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

#: Compressed bytes of the members of one task, about; a member is never parted.
RANGE = 32 << 20


@dataclass
class Members(InputPartition):
    """Some successive members of one archive, by name; an archive that cannot be opened is one range without names."""

    path: str
    names: list[str] = field(default_factory=list)
    error: str | None = None


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.range = _local(options["path"]), int(options.get("range", RANGE))
        self.tests: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tests of the member's name, equal, start or end, decide what is read; all others are left to Spark."""
        kinds = {EqualTo: "equal", StringStartsWith: "start", StringEndsWith: "end"}
        for f in filters:
            if type(f) in kinds and getattr(f, "attribute", None) == ("member",) and isinstance(f.value, str):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def _asked(self, name: str) -> bool:
        return all(name == x if kind == "equal" else name.startswith(x) if kind == "start" else name.endswith(x) for kind, x in self.tests)

    def partitions(self) -> list[Members]:
        """Ranges of about `range` compressed bytes. Only the directory at an archive's end is read, so planning does not
        depend on the archives' sizes; archives of over 4 GB have 64-bit directories, which zipfile reads as well."""
        paths = sorted(glob.glob(os.path.join(self.root, "**", "*.zip"), recursive=True)) if os.path.isdir(self.root) else sorted(glob.glob(self.root))
        found = []
        for path in paths:
            try:
                with zipfile.ZipFile(path) as z:
                    members = [(m.filename, m.compress_size) for m in z.infolist() if not m.is_dir() and self._asked(m.filename)]
            except (OSError, zipfile.BadZipFile) as e:
                found.append(Members(path, error=f"archive: {e}"))
                continue
            now, size = [], 0
            for name, n in members:
                if now and size + n > self.range:
                    found.append(Members(path, now))
                    now, size = [], 0
                now.append(name)
                size += n
            if now:
                found.append(Members(path, now))
        return found or [Members("")]

    def read(self, part: Members) -> Iterator[tuple]:
        """archive, member, content, error. A damaged member has an error and no content; those after it are read."""
        archive = os.path.basename(part.path)
        if part.error:
            yield archive, None, None, part.error
        if not part.names:
            return
        with zipfile.ZipFile(part.path) as z:
            for name in part.names:
                try:
                    with z.open(name) as member:
                        yield archive, name, member.read().decode("utf-8", "replace"), None
                except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError) as e:
                    yield archive, name, None, f"member: {e}"


class ArchiveSource(DataSource):
    """format "zip_members"; options: path (a folder, searched to any depth, or a pattern; a file system that all executors
    mount) and range. Files in stores that only Spark reaches are for tables.read_archives."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, content string, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def members(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """All members of the zip files under path; filters on member decide what is opened."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("zip_members").option("range", range_bytes).load(path)


def write_archives(rows: DataFrame, key: str, content: str, path: str, per: int = 1000) -> DataFrame:
    """Writes zip files of about `per` members, named key.json, under path, a folder that all executors mount; returns the
    archives' names and numbers of members. An archive is written beside its place and then moved there, so that a task
    that is run again replaces it whole."""
    from pyspark.sql import functions as F

    root = _local(path)
    parts = max(1, rows.count() // per)

    def pack(x):
        import pandas as pd

        name = f"part-{int(x['_part'].iloc[0]):05d}.zip"
        os.makedirs(root, exist_ok=True)
        beside = os.path.join(root, f".{name}.{os.getpid()}")
        with zipfile.ZipFile(beside, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
            for k, text in sorted(zip(x[key], x[content], strict=True)):
                z.writestr(f"{k}.json", text)
        os.replace(beside, os.path.join(root, name))
        return pd.DataFrame({"archive": [name], "n": [len(x)]})

    return rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).groupBy("_part").applyInPandas(pack, "archive string, n long")
