"""Versioned artefacts: written aside, then committed by one rename.

A version is a folder with any number of parts: tables (JSON or Parquet, by Spark), texts
and Spark ML models. Its manifest names the parts and the sizes of all their files, and is
written last, under a temporary name that is then renamed to ``manifest-<number>.json``. A
reader takes the highest manifest, so a version is seen whole or not at all; a writer that
dies leaves a folder that no manifest names. Two writers cannot take the same number, since
the rename of the second one fails; it takes the next number.

Everything goes through the Hadoop file system of the folder (local, HDFS, object store).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    @property
    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _files(self, folder: str) -> dict[str, int]:
        """Sizes of all files below a folder, by relative path."""
        out, todo = {}, [(folder, "")]
        while todo:
            at, name = todo.pop()
            for f in self._fs.listStatus(self._path(at)):
                own = f"{name}{f.getPath().getName()}"
                if f.isDirectory():
                    todo.append((f"{at}/{f.getPath().getName()}", f"{own}/"))
                else:
                    out[own] = f.getLen()
        return out

    def versions(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[len("manifest-"):-len(".json")]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def write(self, tables: dict[str, DataFrame] | None = None, texts: dict[str, str] | None = None,
              models: dict[str, object] | None = None, fmt: str = "json", before_commit: Callable[[], None] | None = None) -> int:
        """Write a version and commit it; returns its number."""
        folder = f"data-{uuid.uuid4().hex}"
        at = f"{self.root}/{folder}"
        parts = {}
        for name, df in (tables or {}).items():
            df.write.format(fmt).save(f"{at}/{name}")
            parts[name] = {"kind": "table", "format": fmt, "schema": df.schema.json()}
        for name, text in (texts or {}).items():
            self._write(f"{at}/{name}", text)
            parts[name] = {"kind": "text"}
        for name, model in (models or {}).items():
            model.write().save(f"{at}/{name}")
            parts[name] = {"kind": "model"}
        manifest = json.dumps({"folder": folder, "parts": parts, "files": self._files(at) if parts else {}})
        if before_commit:
            before_commit()
        tmp = f"{self.root}/_tmp-{uuid.uuid4().hex}"
        self._write(tmp, manifest)
        number = max(self.versions(), default=0) + 1
        while not self._commit(tmp, number):
            number += 1
        return number

    def _commit(self, tmp: str, number: int) -> bool:
        final = self._path(f"{self.root}/manifest-{number:08d}.json")
        return not self._fs.exists(final) and self._fs.rename(self._path(tmp), final)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the latest), whose files must all be there."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise LookupError(f"no committed version {version or ''} in {self.root}")
        m = json.loads(self._read(f"{self.root}/manifest-{version or known[-1]:08d}.json"))
        if m["parts"] and m["files"] != (found := self._files(f"{self.root}/{m['folder']}")):
            raise OSError(f"files of {m['folder']} differ from its manifest: {sorted(set(m['files'].items()) ^ set(found.items()))}")
        return m

    def _part(self, name: str, kind: str, version: int | None) -> tuple[str, dict]:
        m = self.manifest(version)
        if m["parts"].get(name, {}).get("kind") != kind:
            raise LookupError(f"no {kind} {name} in {m['folder']}")
        return f"{self.root}/{m['folder']}/{name}", m["parts"][name]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType
        path, part = self._part(name, "table", version)
        return self.spark.read.schema(StructType.fromJson(json.loads(part["schema"]))).format(part["format"]).load(path)

    def text(self, name: str, version: int | None = None) -> str:
        return self._read(self._part(name, "text", version)[0])

    def model(self, name: str, version: int | None = None):
        from pyspark.ml import PipelineModel
        return PipelineModel.load(self._part(name, "model", version)[0])
