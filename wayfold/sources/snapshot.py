"""One small file that says which data files make up a table, replaced as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Snapshot:
    """The file `_snapshot` of a table's folder.

    Readers see the table as it was before a change or after it, nothing in
    between: the next snapshot is written beside the file and renamed over it,
    which is atomic on HDFS and on local disks.  A table has one writer.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration())

    def read(self) -> dict | None:
        """What the snapshot says; None before the first."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._files().open(self._at("_snapshot"))
        except Py4JJavaError as error:
            if "FileNotFoundException" in error.java_exception.getClass().getName():
                return None
            raise
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def replace(self, said: dict) -> None:
        jvm, files = self.spark._jvm, self._files()
        new = self._at(f"_snapshot-{uuid.uuid4().hex}")
        gateway = self.spark.sparkContext._gateway
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        parents = getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts").createParent()
        with_parents = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 1)
        with_parents[0] = parents
        out = files.create(new, flags, with_parents)
        try:
            out.write(bytearray(json.dumps(said, separators=(",", ":")).encode()))
        finally:
            out.close()
        over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        files.rename(new, self._at("_snapshot"), over)

    def delete(self, name: str) -> None:
        """A folder of the table, or all of it if `name` is empty; nothing if it isn't there."""
        path = self._at(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
