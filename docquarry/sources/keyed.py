"""Growing tables that are asked for few keys at a time.

A :class:`KeyedTable` is written once a batch and read by key.  Each run of batches holds its rows
by hash bucket of the key, and for each bucket a Bloom filter of its keys, so that a lookup
first asks the filters (some ten bits a key) and then opens only files that may hold a key.

Runs of ``FAN_OUT`` batches are merged to one, and so on upwards: a lookup meets a number of
runs that grows with the logarithm of the batches.  Which runs make up the table before a batch
follows from its number and from the filters that exist, which are written after the rows; there is
no list of files that a failure could leave half written, and a batch that is replayed writes its
runs again.  The rows of one key may fill more than one
file of its bucket, since the writer splits large ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docquarry.session import cut_lineage

#: Runs of one level that are merged to one of the next.
FAN_OUT = 16
#: Bits a key has in a filter, and bits that it sets: about one false file in a hundred.
BITS_PER_KEY = 10
PROBES = 4
#: Keys asked of a bucket from which on its filters let nearly any set of keys pass by chance, and aren't asked.
MANY_KEYS = 4096


def _hadoop_path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _hadoop_path(spark, path)
    return system.exists(folder)


def _probe(i: int, key: Column, bits: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), bits)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema`` (DDL) under ``path``, found by the column ``key``; rows with a NULL key are
    kept and never found by a lookup.

    ``buckets`` must stay the same for the life of the table.  ``counted`` names a column of
    counts, which may be negative: equal rows are then one row with the sum of their counts, and
    rows whose counts cancel out are gone.  ``merged`` names further columns that are no part of
    what makes rows equal, each with the function (sum, min, max) that joins them.
    """

    path: str
    key: str
    schema: str
    buckets: int = 64
    counted: str | None = None
    merged: tuple[tuple[str, str], ...] = ()

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write the rows of a batch (numbered from 0) and merge runs that are full.

        A batch that is written again replaces what it wrote before.
        """
        spark = rows.sparkSession
        if batch > 0:
            self._drop_merged(spark, batch - 1)
        rows = rows.select(*T.StructType.fromDDL(self.schema).fieldNames())
        self._write(rows, self._name(0, batch))
        level, number = 0, batch
        while number % FAN_OUT == FAN_OUT - 1:
            parts = [r for n in range(number - FAN_OUT + 1, number + 1) for r in self._written(spark, level, n)]
            level, number = level + 1, number // FAN_OUT
            if parts:
                whole = self._read(spark, [f"{self.path}/data/run={p}" for p in parts])
                self._write(self._added_up(whole), self._name(level, number))

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """Rows of earlier batches whose key is among ``keys`` (their column of the same name)."""
        spark = keys.sparkSession
        runs = self.runs(spark, before)
        if not runs:
            return spark.createDataFrame([], self.schema)
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        asked = cut_lineage(asked.withColumn("bucket", self._bucket()), "asked")
        found = self._read(spark, self.files_for(asked, runs)).join(asked.select(self.key), self.key, "left_semi")
        return self._added_up(found)

    def candidates(self, keys: DataFrame, before: int) -> DataFrame:
        """All rows of the files that may hold one of ``keys``, others among them, for a caller that joins by key itself.

        ``keys`` may repeat and are read more than once; nothing is shuffled but counts.
        """
        runs = self.runs(keys.sparkSession, before)
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket())
        files = self.files_for(asked, runs) if runs else []
        return self._added_up(self._read(keys.sparkSession, files))

    def files_for(self, asked: DataFrame, runs: list[str]) -> list[str]:
        """Folders that may hold one of the keys: at most runs x buckets names."""
        spark = asked.sparkSession
        counted = asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
        many = [r["bucket"] for r in counted if r["n"] >= MANY_KEYS]
        whole = [f"{self.path}/data/run={r}/bucket={b}" for r in runs for b in many]
        if len(many) == len(counted):
            return sorted(whole)
        asked = asked.where(~F.col("bucket").isin(many))
        filters = spark.read.schema("bucket int, bits long, words array<long>, run string").option(
            "basePath", f"{self.path}/filters").parquet(*[f"{self.path}/filters/run={r}" for r in runs])
        probed = asked.join(filters, "bucket")
        hit = F.lit(True)
        for i in range(PROBES):
            place = _probe(i, F.col(self.key), F.col("bits"))
            hit = hit & (F.bit_get(F.get("words", F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1)
        found = probed.where(hit).select("run", "bucket").distinct().collect()
        return sorted([*whole, *[f"{self.path}/data/run={r['run']}/bucket={r['bucket']}" for r in found]])

    def read(self, spark: SparkSession, before: int) -> DataFrame:
        """All rows of earlier batches."""
        return self._added_up(self._read(spark, [f"{self.path}/data/run={r}" for r in self.runs(spark, before)]))

    def _added_up(self, rows: DataFrame) -> DataFrame:
        if self.counted is None:
            return rows
        joined = {self.counted: "sum", **dict(self.merged)}
        alike = [c for c in rows.columns if c not in joined]
        out = rows.groupBy(*alike).agg(*[getattr(F, how)(c).alias(c) for c, how in joined.items()])
        return out.where(F.col(self.counted) != 0).select(*rows.columns)

    def runs(self, spark: SparkSession, before: int) -> list[str]:
        """Names of the runs that hold the batches below ``before``, the largest first."""
        names, level, number = [], 0, before
        while number:
            at_level = [r for n in range(number - number % FAN_OUT, number) for r in self._written(spark, level, n)]
            names, level, number = at_level + names, level + 1, number // FAN_OUT
        return names

    def _written(self, spark: SparkSession, level: int, number: int) -> list[str]:
        """A run, or where it was never merged (a batch number was left out) its parts."""
        name = self._name(level, number)
        if exists(spark, f"{self.path}/filters/run={name}"):
            return [name]
        parts = range(number * FAN_OUT, (number + 1) * FAN_OUT) if level else ()
        return [r for n in parts for r in self._written(spark, level - 1, n)]

    @staticmethod
    def _name(level: int, number: int) -> str:
        return f"L{level}-{number}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, name: str) -> None:
        spark, data = rows.sparkSession, f"{self.path}/data/run={name}"
        placed = rows.withColumn("bucket", self._bucket())
        # Rebalanced, not repartitioned: a bucket with a hot key is written by several tasks.
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(data)
        written = spark.read.schema(T.StructType([*T.StructType.fromDDL(self.schema).fields, T.StructField("bucket", T.IntegerType())])).parquet(data)
        if written.isEmpty():
            self._delete(spark, name)
            return
        # Neither the sketch of the number of keys nor the bits need distinct keys: none is shuffled.
        keys = written.where(F.col(self.key).isNotNull()).select("bucket", self.key)
        sizes = keys.groupBy("bucket").agg(
            F.greatest(F.lit(64), F.pow(F.lit(2.0), F.ceil(F.log2(F.approx_count_distinct(self.key) * BITS_PER_KEY))).cast("long")).cast("long").alias("bits")
        )
        probed = keys.join(F.broadcast(sizes), "bucket")  # a row a bucket
        places = probed.select("bucket", "bits", F.explode(F.array(*[_probe(i, F.col(self.key), F.col("bits")) for i in range(PROBES)])).alias("place"))
        words = places.groupBy("bucket", "bits", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("set"))
        listed = words.groupBy("bucket", "bits").agg(F.sort_array(F.collect_list(F.struct("word", "set"))).alias("held"))
        none = F.lit(0).cast("long")
        gap = lambda w, i: w["word"] - F.when(i > 0, F.get("held", i - 1)["word"]).otherwise(F.lit(-1)) - 1
        full = F.flatten(F.transform("held", lambda w, i: F.concat(F.array_repeat(none, gap(w, i)), F.array(w["set"]))))
        tail = F.array_repeat(none, (F.col("bits") / 64).cast("int") - F.size(full))
        listed.select("bucket", "bits", F.concat(full, tail).alias("words")).write.mode("overwrite").parquet(f"{self.path}/filters/run={name}")

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        kind = T.StructType.fromDDL(self.schema)
        there = [f for f in folders if exists(spark, f)]
        if not there:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*there)

    def _drop_merged(self, spark: SparkSession, batch: int) -> None:
        """Remove the runs that a batch merged, once a later batch begins and no replay can ask for them."""
        level, number = 0, batch
        while number % FAN_OUT == FAN_OUT - 1 and exists(spark, f"{self.path}/filters/run={self._name(level + 1, number // FAN_OUT)}"):
            for n in range(number - FAN_OUT + 1, number + 1):
                self._delete(spark, self._name(level, n))
            level, number = level + 1, number // FAN_OUT

    def _delete(self, spark: SparkSession, name: str) -> None:
        for kind in ("filters", "data"):
            system, folder = _hadoop_path(spark, f"{self.path}/{kind}/run={name}")
            system.delete(folder, True)
