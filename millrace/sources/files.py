"""Small files and folders of any file system that Spark reads, through Hadoop's API."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset: a temporary one if all run in one process, else an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _temporary()


@lru_cache(maxsize=1)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


class Files:
    """The file system of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.root = self.fs.makeQualified(self.root)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def url(self, name: str) -> str:
        return self.path(name).toString()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def make_folder(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self.path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file is the old or the new one at any moment on HDFS; on a local file system there is none for a moment."""
        self._write(f"{name}.new", text, True)
        rename = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        how[0] = rename.OVERWRITE
        self.context.rename(self.path(f"{name}.new"), self.path(name), how)

    def create(self, name: str, text: str) -> bool:
        """Makes a file; False if there is one."""
        from py4j.protocol import Py4JJavaError

        try:
            self._write(name, text, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or self.exists(name):
                return False
            raise
        return True

    def time(self, name: str) -> int:
        """When a file was last changed or touched, in milliseconds."""
        return self.fs.getFileStatus(self.path(name)).getModificationTime()

    def states(self, urls: list[str]) -> list[tuple[str, int, int]]:
        """(name, size, time) of files of any file system."""
        out = []
        for url in sorted(urls):
            path = self.jvm.org.apache.hadoop.fs.Path(self.jvm.java.net.URI(url))
            status = path.getFileSystem(self.conf).getFileStatus(path)
            out.append((url, status.getLen(), status.getModificationTime()))
        return out

    def touch(self, name: str) -> None:
        self.fs.setTimes(self.path(name), self.jvm.java.lang.System.currentTimeMillis(), -1)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def listed(self, name: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name)))
