"""Files of a folder in the cluster's file system: a few names at a time, moved, written and removed."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder that all executors reach; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def files(self, below: str) -> list[str]:
        """Parquet files below a folder, relative to it."""
        found, root = [], self.fs.makeQualified(self.at(below))
        if not self.fs.exists(root):
            return found
        walk = self.fs.listFiles(root, True)
        while walk.hasNext():
            name = walk.next().getPath().toString()[len(root.toString()) + 1 :]
            if name.endswith(".parquet"):
                found.append(name)
        return sorted(found)

    def write(self, name: str, text: str) -> None:
        # Written under another name first, so that it is there whole or not at all.
        half = self.at(f"{self.path}/{name}.half")
        out = self.fs.create(half, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.rename(half, self.at(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        source = self.fs.open(self.at(f"{self.path}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def named(self, start: str, end: str) -> list[str]:
        """Names right below the folder that begin and end so, in order."""
        if not self.fs.exists(self.at(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(self.path))]
        return sorted(n for n in names if n.startswith(start) and n.endswith(end))

    def move(self, name: str, to: str) -> None:
        """Move a file unless it has been moved before."""
        old, new = self.at(f"{self.path}/{name}"), self.at(f"{self.path}/{to}")
        if self.fs.exists(old):
            self.fs.mkdirs(new.getParent())
            if not self.fs.rename(old, new):
                raise OSError(f"could not move {name} to {to}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(f"{self.path}/{name}"), True)
