"""Files: CSV and JSON-lines scans, content hashes, and a store that publishes by rename."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV with a header and quoted, possibly multi-line fields, under an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that doesn't parse is dropped only if it is its file's last and lacks its end, else an error.

    Any number of files may be torn: their names are listed, and the ends of those files are looked at by tasks.
    """
    spec = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("_file", F.col("_metadata.file_path"))
    rows = lines.withColumn("row", F.from_json("value", spec, {"columnNameOfCorruptRecord": "_bad"}))
    torn = rows.filter("row._bad IS NOT NULL").groupBy("_file").agg(F.count("*").alias("n"), F.max("value").alias("line"))
    files = [r[0] for r in torn.select("_file").collect()]  # one row per torn file
    if files:
        ends = spark.read.format("binaryFile").load(files).select(F.regexp_replace("path", "^(\\w+):/+", "$1:/").alias("f"), "content")
        known = torn.select(F.regexp_replace("_file", "^(\\w+):/+", "$1:/").alias("f"), "n", "line")
        size = F.octet_length("line")
        tail = F.col("content").substr(F.octet_length("content") - size + 1, size)
        wrong = known.join(ends, "f", "left").filter((F.col("n") > 1) | F.col("content").isNull() | (tail != F.encode("line", "UTF-8"))).select("f").limit(1).collect()
        if wrong:
            raise ValueError(f"a line of {wrong[0][0]} doesn't parse")
    return rows.filter("row._bad IS NULL").select("row.*").drop("_bad")


def append_json_lines(path: str, rows: list[dict]) -> None:
    """Add rows to a file of the driver's, first cutting off a last line that was torn. For ledgers and resumable runs, not for tables."""
    with open(path, "ab+") as file:
        file.seek(0)
        whole = file.read()
        if whole and not whole.endswith(b"\n"):
            file.truncate(whole.rfind(b"\n") + 1)
        file.write(b"".join(json.dumps(r, ensure_ascii=False).encode() + b"\n" for r in rows))


def subset(rows: DataFrame, key: str, size: int, seed: int, folder: str) -> DataFrame:
    """The same `size` rows of a seeded order in every run, numbered from 0 in recipe_idx, null strings as ''; kept in folder and read from it again."""
    spark = rows.sparkSession
    target = f"{folder.rstrip('/')}/size={size}-seed={seed}"
    try:
        return spark.read.parquet(target)
    except AnalysisException:  # not made yet
        pass
    texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    first = rows.drop("recipe_idx").na.fill("", texts).orderBy(F.xxhash64(F.lit(seed), key), key).limit(size)
    place = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), key), key)) - 1  # over `size` rows
    first.withColumn("recipe_idx", place.cast("bigint")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


class Store:
    """Versioned tables below one folder: written aside, validated, renamed, and listed in the registry last.

    Readers see only what the registry lists. Any file system Spark reaches will do, as Hadoop's interface moves the files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def names(self) -> list[str]:
        """What is loaded."""
        if not self._fs.exists(self._path(f"{self.root}/_registry")):
            return []
        return sorted(s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(self._path(f"{self.root}/_registry")))

    def publish(self, name: str, rows: DataFrame, problems: Callable[[DataFrame], list[str]] = lambda df: [], partition: list[str] | None = None) -> None:
        """Write rows as `name`. Raises ValueError, publishing nothing, if it is locked, loaded already or has problems."""
        if name in self.names():
            raise ValueError(f"{name} is loaded; discard it first")
        lock, stage, final = (self._path(f"{self.root}/{x}") for x in (f"{name}.lock", f"{name}.staging", name))
        self._fs.mkdirs(self._path(self.root))
        try:
            self._fs.create(lock, False).close()
        except Exception as error:
            raise ValueError(f"{name} is being written") from error
        try:
            self._fs.delete(stage, True), self._fs.delete(final, True)  # left by a writer that died
            writer = rows.write
            (writer.partitionBy(*partition) if partition else writer).parquet(str(stage.toString()))
            if found := problems(self.spark.read.parquet(str(stage.toString()))):
                self._fs.delete(stage, True)
                raise ValueError("; ".join(found))
            self._fs.rename(stage, final)
            out = self._fs.create(self._path(f"{self.root}/_registry/{name}.json"), True)
            out.writeBytes(json.dumps({"name": name, "loaded_at": time.time()}))
            out.close()
        finally:
            self._fs.delete(lock, False)

    def table(self, name: str) -> DataFrame:
        """A loaded table; an unknown name is an error that lists the loaded ones."""
        if name not in self.names():
            raise ValueError(f"unknown: {name}; loaded: {', '.join(self.names()) or 'none'}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def replace_all(self, name: str, rows: DataFrame, dependent: list[str]) -> None:
        """Empty a table and load rows in its place; refused while any dependent table is loaded."""
        if blocking := sorted(set(dependent) & set(self.names())):
            raise ValueError(f"{', '.join(blocking)} still loaded; discard first")
        self.discard(name, sure=True)
        self.publish(name, rows)

    def discard(self, name: str, sure: bool = False) -> None:
        """Remove a table; a loaded one only if sure. The registry goes first."""
        if name in self.names() and not sure:
            raise ValueError(f"{name} is loaded; say sure=True")
        for path in (f"_registry/{name}.json", name, f"{name}.staging"):
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
