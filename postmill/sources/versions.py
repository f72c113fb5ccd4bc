"""Tables in versions, with a pointer that is set once per version.

A version is a folder of its own that is never written to again; manifest number n names the folder of version n and is put in
place only if there is none yet. Of two writers that start from the same version one wins and the other learns of it;
a reader resolves the pointer first and then reads a folder nobody changes. Nothing is renamed on top of anything,
so object stores serve as well as file systems.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession

from postmill.sources.scratch import hadoop_fs


class VersionConflict(Exception):
    """Another writer has written the version first."""


class VersionedTable:
    """The table under ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """All versions that can be read, ascending."""
        fs, folder = hadoop_fs(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(name) for name in names if name.isdigit())

    def _folder(self, version: int) -> str:
        return f"{self.path}/versions/" + self.spark.read.text(f"{self.path}/manifest/{version}").first().value

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the latest by default. The result stays the same when others are written."""
        known = self.versions()
        if version is None and known:
            version = known[-1]
        if version not in known:
            raise ValueError(f"there is no version {version} under {self.path}")
        return self.spark.read.parquet(self._folder(version))

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Write ``df`` as the version that follows ``after``, by default the latest as of now, and return its number.

        ``df`` may read any version. Raises ``VersionConflict`` if another writer was faster; name in ``after`` the version
        that ``df`` is made from to learn of any that came in between. What a failed writer leaves is no version.
        """
        version = (max(self.versions(), default=0) if after is None else after) + 1
        folder = f"{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/versions/{folder}")
        if not self._put_if_absent(version, folder):
            fs, own = hadoop_fs(self.spark, f"{self.path}/versions/{folder}")
            fs.delete(own, True)
            raise VersionConflict(f"version {version} of {self.path} has been written by another")
        return version

    def _put_if_absent(self, version: int, folder: str) -> bool:
        target = f"{self.path}/manifest/{version}"
        fs, place = hadoop_fs(self.spark, target)
        fs.mkdirs(place.getParent())
        if urlparse(target).scheme in ("", "file"):  # a local disk has no exclusive create in Hadoop, but links are one
            return _link(unquote(urlparse(target).path), folder)
        try:
            out = fs.create(place, False)  # exclusive on HDFS and on object stores with conditional writes
        except Exception as error:  # the class depends on the store
            if isinstance(error, PySparkException) or fs.exists(place):
                return False
            raise
        out.write(bytearray(folder.encode()))
        out.close()
        return True

    def drop_old(self, keep: int = 2) -> list[int]:
        """Drop all but the latest ``keep`` versions and return the numbers of those dropped. Their readers fail."""
        if keep < 1:
            raise ValueError("at least one version is kept")
        dropped = self.versions()[:-keep]
        for version in dropped:
            folder = self._folder(version)
            for path in (f"{self.path}/manifest/{version}", folder):
                fs, place = hadoop_fs(self.spark, path)
                fs.delete(place, True)
        return dropped


def _link(target: str, content: str) -> bool:
    """Make the file ``target`` in one step, unless there is one."""
    draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
    with open(draft, "w") as out:
        out.write(content)
    try:
        os.link(draft, target)
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)
    return True
