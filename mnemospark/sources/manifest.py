"""Versions of a folder of tables, by manifests that are put in place in one step.

Data files are written first, under names of their own, by Spark's commit protocol; a version is a small JSON file that names those in
force. It is renamed into place and only if no version of that number is there, so of two writers that began at the same version one
fails and begins anew, readers see whole versions, and what a writer that died has left is in no version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Manifests:
    spark: SparkSession
    folder: str

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_versions/{name}".rstrip("/"))

    def _store(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def latest(self) -> int:
        """The number of the newest version, 0 if there is none."""
        store = self._store()
        if not store.exists(self._path()):
            return 0
        names = [s.getPath().getName() for s in store.listStatus(self._path())]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def read(self, version: int) -> dict:
        stream = self._store().open(self._path(f"{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> None:
        """Puts ``version`` in place, or raises Conflict if it is there."""
        store, jvm = self._store(), self.spark._jvm
        draft, place = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{version:020d}.json")
        out = store.create(draft)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.makeQualified(store.getUri(), store.getWorkingDirectory()).toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(draft, place, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            store.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(version) from None
            raise
