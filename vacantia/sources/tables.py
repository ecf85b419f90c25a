"""Reading raw files, and versioned Parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.operators.prepare import PREPARED_COLUMNS

RAW_COLUMNS = [
    "job_id", "company_name", "title", "description", "location", "formatted_experience_level",
    "original_listed_time", "job_posting_url", "application_url", "skills_desc", "formatted_work_type",
    "work_type", "remote_allowed",
]
EXTRA_FIELD = "_extra_field"
PLACE_BITS = 33  # rows of one file, as in monotonically_increasing_id


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _csv_scans(spark: SparkSession, path: str, one_line: bool) -> list[tuple[list[str], DataFrame]]:
    """(header, rows) for each header that occurs among the files; rows also hold `_file` and `_ordinal`.

    The driver reads the first line of every file.  `_ordinal` grows with the file's place in name order, then with the
    row's place in the file, unless files are read in splits.
    """
    options = {"header": True, "multiLine": not one_line, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    encoded = sorted(spark.read.text(path).inputFiles(), key=unquote)
    names = [spark._jvm.org.apache.hadoop.fs.Path(unquote(f)).toString() for f in encoded]
    if len(names) <= 1:
        headers = {tuple(spark.read.options(**options).csv(path).columns): names}
    else:
        headers = {}
        for name in names:
            headers.setdefault(tuple(spark.read.options(**options).csv(name).columns), []).append(name)
    # The hidden column has encoded names.
    keys = [spark._jvm.org.apache.hadoop.fs.Path(f).toString() for f in encoded]
    numbers = spark.createDataFrame(list(zip(range(len(names)), keys, names)), "_number bigint, _key string, _file string")
    scans = []
    for header, files in headers.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, EXTRA_FIELD]])
        rows = spark.read.options(**options, mode="PERMISSIVE").schema(schema).csv(path if len(headers) == 1 else files)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        rows = rows.select("*", F.col("_metadata.file_path").alias("_key"), place.alias("_place"))
        if len(names) > 1:
            rows = rows.join(F.broadcast(numbers), "_key")
        else:
            rows = rows.withColumns({"_number": F.lit(0).cast("bigint"), "_file": F.lit(names[0] if names else None).cast("string")})
        scans.append((list(header), rows.withColumn("_ordinal", F.shiftleft("_number", PLACE_BITS) + F.col("_place"))))
    return scans


def _csv_rows(spark: SparkSession, path: str, columns: list[str], one_line: bool = False) -> DataFrame:
    """The named columns of all files and `ordinal`."""
    parts = []
    for header, rows in _csv_scans(spark, path, one_line):
        present = {c: F.col(f"`{c}`") for c in header}
        wanted = [present.get(c, F.lit(None).cast("string")).alias(c) for c in columns]
        parts.append(rows.filter(F.col(EXTRA_FIELD).isNull()).select(*wanted, F.col("_ordinal").alias("ordinal")))
    if not parts:
        fields = [T.StructField(c, T.StringType()) for c in columns]
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("ordinal", T.LongType())]))
    return reduce(DataFrame.unionAll, parts)


def read_csv(spark: SparkSession, path: str, columns: list[str], one_line: bool = False) -> DataFrame:
    """The named columns of CSV files with headers, all as text; absent ones are null.

    Quoted fields may hold line breaks.  Lines with fewer fields than the header keep what they have, lines with more are
    skipped (an empty field at the end is not counted; `rejected_lines` has them), and bad bytes are replaced.  Every
    file's own header gives its positions, so columns may come in any order.  With `one_line`, for files whose quoted fields
    hold no line break, large files are read in splits.
    """
    return _csv_rows(spark, path, columns, one_line).drop("ordinal")


def rejected_lines(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """(file, fields) of the lines that `read_csv` skips: the header's fields and the first one beyond them."""
    parts = [
        rows.filter(F.col(EXTRA_FIELD).isNotNull()).select(
            F.col("_file").alias("file"), F.array(*[F.col(f"`{c}`") for c in [*header, EXTRA_FIELD]]).alias("fields")
        )
        for header, rows in _csv_scans(spark, path, one_line)
    ]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "file string, fields array<string>")


def load_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Raw postings with `ordinal`, the row's place in file order; several files follow each other by name."""
    path = f"{folder}/postings.csv"
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return _csv_rows(spark, path, RAW_COLUMNS)


def load_job_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Raw posting-skill pairs; empty when the optional file is missing."""
    path = f"{folder}/jobs/job_skills.csv"
    if not path_exists(spark, path):
        return spark.createDataFrame([], "job_id string, skill_abr string")
    return read_csv(spark, path, ["job_id", "skill_abr"])


def load_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared postings for ingest, from CSV or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in PREPARED_COLUMNS])
        return rows.withColumn("ordinal", F.monotonically_increasing_id())
    return _csv_rows(spark, path, PREPARED_COLUMNS)


def write_prepared(rows: DataFrame, path: str) -> None:
    """Write prepared postings as CSV with quoting that `load_prepared` reads back, or as Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        rows.write.mode("overwrite").parquet(path)
    else:
        rows.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="").csv(path)


class VersionedTable:
    """A Parquet table whose versions are folders; the newest complete one is current.

    A write goes to a new folder, so readers keep theirs and a repeated write of the same version is safe.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        files = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in files)

    def current(self) -> int | None:
        found = self._versions()
        return found[-1] if found else None

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        if version is None:
            version = (self.current() or 0) + 1
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(names).write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version


PLACES_SCHEMA = "bucket int, version int"


class BucketedTable:
    """A Parquet table dealt by the hash of a key into buckets; a write replaces whole buckets and leaves the others' files.

    Version n holds the replaced buckets in folders `v=n/_bucket=b`, and a small table `places/v=n` that names for each
    bucket the version with its rows (null: none).  That table is written last and makes the version complete, so a
    failed write is never seen, readers keep their files and old versions stay readable until `expire`.  The number of
    buckets is fixed by the first write.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 32):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._first_buckets = buckets

    def _found(self, pattern: str) -> list:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        return [f.getPath() for f in found]

    def versions(self) -> list[int]:
        return sorted(int(p.getParent().getName()[2:]) for p in self._found("places/v=*/_SUCCESS"))

    def current(self, before: int | None = None) -> int | None:
        """The newest complete version, or the newest one older than `before`."""
        found = [v for v in self.versions() if before is None or v < before]
        return found[-1] if found else None

    def places(self, version: int | None = None) -> dict[int, int | None]:
        """The version that holds each bucket's rows: one entry a bucket, read on the driver."""
        version = self.current() if version is None else version
        if version is None:
            return dict.fromkeys(range(self._first_buckets))
        rows = self.spark.read.schema(PLACES_SCHEMA).parquet(f"{self.path}/places/v={version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def bucket_of(self, key: Column) -> Column:
        versions = self.versions()
        count = len(self.places(versions[0])) if versions else self._first_buckets
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def buckets_of(self, rows: DataFrame, key: Column) -> list[int]:
        """The buckets that the rows belong to, at most all of them."""
        return sorted(r[0] for r in rows.select(self.bucket_of(key)).distinct().collect())

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table, or some buckets of it."""
        wanted = None if buckets is None else set(buckets)
        paths = [
            f"{self.path}/v={v}/_bucket={b}"
            for b, v in sorted(self.places(version).items())
            if v is not None and (wanted is None or b in wanted)
        ]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(
        self,
        rows: DataFrame,
        buckets: Iterable[int],
        version: int | None = None,
        verify: Callable[[DataFrame], object] | None = None,
    ) -> int:
        """Make `rows` the content of these buckets.  Rows of any other bucket are an error.

        `verify` gets the written rows, if there are any, before the version counts; what it raises prevents that.
        Writing an existing version again starts from the one before it.  Large buckets become several files.
        """
        base = self.current(version)
        version = (base or 0) + 1 if version is None else version
        places = self.places(base) if base is not None else dict.fromkeys(range(self._first_buckets))
        buckets, folder = set(buckets), f"{self.path}/v={version}"
        names = [f.split()[0] for f in self.schema.split(", ")]
        dealt = rows.select(*names, F.pmod(F.xxhash64(self.key), F.lit(len(places))).cast("int").alias("_bucket"))
        dealt.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        present = {int(p.getName().split("=")[1]) for p in self._found(f"v={version}/_bucket=*")}
        if not present <= buckets:
            raise ValueError(f"rows of buckets that are not replaced: {sorted(present - buckets)[:10]}")
        if verify is not None and present:
            verify(self.spark.read.schema(self.schema).parquet(*[f"{folder}/_bucket={b}" for b in sorted(present)]))
        places |= {b: version if b in present else None for b in buckets}
        table = self.spark.createDataFrame(sorted(places.items()), PLACES_SCHEMA).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/places/v={version}")
        return version

    def expire(self, keep: int) -> int:
        """Drop all but the newest `keep` versions, and the folders of buckets that only the dropped ones used."""
        if keep < 1:
            raise ValueError("keep at least one version")
        found = self.versions()
        dropped = found[:-keep]
        used = {(v, b) for version in found[-keep:] for b, v in self.places(version).items()}
        old = [p for v in dropped for p in self._found(f"places/v={v}")]
        for v in dropped:
            old += [p for p in self._found(f"v={v}/_bucket=*") if (v, int(p.getName().split("=")[1])) not in used]
        for place in old:
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return len(dropped)
