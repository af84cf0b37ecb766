"""Template tables in versions: a version is a folder of files and a manifest of what it was made with, published by one rename.

Readers take the newest manifest of the parameters that they ask for, and of its files only those; so a
reader that began before stays with its version. What doesn't fit is refused with the reason.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version of the manifest's own form.
FORM = 1


class Refused(ValueError):
    """A table that can't be used for what was asked, and why."""


@dataclass(frozen=True)
class Made:
    """What templates were made with; all of it must agree."""

    fingerprint: str
    algorithm: str
    version: int
    dim: int


class Versions:
    """The versions under one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.system = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self, folder: str) -> dict[str, int]:
        found = self.system.listStatus(self._at(folder)) if self.system.exists(self._at(folder)) else []
        return {s.getPath().getName(): s.getLen() for s in found if s.isFile() and not s.getPath().getName().startswith(("_", "."))}

    def _names(self, fingerprint: str) -> list[str]:
        return sorted(n for n in self._files(f"manifests/{fingerprint}") if n.endswith(".json"))

    def publish(self, templates: DataFrame, made: Made, column: str = "q") -> str:
        """Writes templates, an array of dim entries each in `column`, and then names them as the newest version; the version's name."""
        folder = f"data/{uuid.uuid4().hex}"
        templates.write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        if written.where(F.coalesce(F.size(column), F.lit(-1)) != made.dim).limit(1).count():
            self.system.delete(self._at(folder), True)
            raise Refused(f"a template doesn't have {made.dim} entries")
        body = json.dumps({"form": FORM, **asdict(made), "folder": folder, "files": self._files(folder), "rows": written.count()}, sort_keys=True)
        while True:
            last = self._names(made.fingerprint)
            name = f"{int(last[-1][:12]) + 1 if last else 1:012d}.json"
            hidden, place = self._at(f"manifests/{made.fingerprint}/.{uuid.uuid4().hex}"), self._at(f"manifests/{made.fingerprint}/{name}")
            out = self.system.create(hidden, False)
            out.write((hashlib.sha256(body.encode()).hexdigest() + "\n" + body).encode())
            out.close()
            # Where another writer took the name, the rename fails and the next one is tried.
            if not self.system.exists(place) and self.system.rename(hidden, place):
                return name
            self.system.delete(hidden, False)

    def _manifest(self, fingerprint: str, name: str) -> dict:
        at = self._at(f"manifests/{fingerprint}/{name}")
        stream = self.system.open(at)
        try:
            raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        head, _, body = raw.partition(b"\n")
        if hashlib.sha256(body).hexdigest().encode() != head:
            raise Refused(f"manifest {name} is damaged")
        found = json.loads(body)
        if found["form"] != FORM:
            raise Refused(f"manifest {name} has form {found['form']}, not {FORM}")
        return found

    def read(self, made: Made) -> DataFrame:
        """The newest version for these parameters. Refused: none there, another algorithm, version or dimension, a damaged manifest, files that are gone or of another size."""
        names = self._names(made.fingerprint)
        if not names:
            raise Refused(f"no version for the parameters {made.fingerprint}")
        found = self._manifest(made.fingerprint, names[-1])
        for field, value in asdict(made).items():
            if found[field] != value:
                raise Refused(f"{field} is {found[field]}, not {value}")
        there = self._files(found["folder"])
        for file, size in found["files"].items():
            if there.get(file) != size:
                raise Refused(f"{file} is gone or was changed")
        return self.spark.read.parquet(*[f"{self.path}/{found['folder']}/{file}" for file in found["files"]])

    def read_or_build(self, made: Made, build: Callable[[], DataFrame], column: str = "q") -> tuple[DataFrame, str | None]:
        """The version that is there, or a new one of what build gives, with the reason why it was built."""
        try:
            return self.read(made), None
        except Refused as e:
            self.publish(build(), made, column)
            return self.read(made), str(e)
