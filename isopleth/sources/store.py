"""Small files and folders at any place that Spark can reach, for what the driver keeps about tables."""

from pyspark.sql import SparkSession


class Store:
    """Lists, reads, publishes and deletes by Hadoop's file systems, as Spark's own readers and writers do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        fs = self.jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.path = fs.Path
        self.files = fs.Path(folder).getFileSystem(conf)
        self.context = fs.FileContext.getFileContext(self.files.getUri(), conf)

    def list(self, folder: str, times: bool = False) -> list:
        """Names in a folder, or (name, seconds of the last change); none if there is no such folder."""
        at = self.path(folder)
        if not self.files.exists(at):
            return []
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.files.listStatus(at)]
        return found if times else [name for name, _ in found]

    def read_text(self, path: str) -> str:
        stream = self.files.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Writes a file whole under its name, or not at all: False if that name is taken."""
        at = self.path(path)
        beside = self.path(at.getParent(), f".{at.getName()}.{self.jvm.java.util.UUID.randomUUID().toString()}")
        out = self.files.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.context.rename(self.files.makeQualified(beside), self.files.makeQualified(at), options)
            return True
        except Exception as failed:
            self.files.delete(beside, False)
            if "FileAlreadyExistsException" in str(failed):
                return False
            raise

    def delete(self, path: str) -> None:
        self.files.delete(self.path(path), True)
