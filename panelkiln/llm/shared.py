"""What the corpus operators have in common: tables, the shared folder, hot-group-safe exact grouping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="panelkiln-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def set_for(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (`__` for a dot) that hold within the block; what held before holds again afterwards."""
    settings = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str) -> DataFrame:
    """The same rows, written to a table and read from it."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, at: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The register-blocked Bloom filter has at most this many 64-bit words, so its broadcast is bounded whatever the input.
MOST_WORDS = 1 << 20
#: At most this many groups are broadcast as hot ones.
MOST_HOT = 8192


def exact_groups(base: DataFrame, id_col: str, key_col: str, bits_per_row: int = 32, most_words: int = MOST_WORDS, keep: Callable = F.max) -> DataFrame:
    """Groups rows with equal keys: two-pass Bloom filtering, native expressions only.

    Pass one counts how often each bit of a register-blocked Bloom filter is hit (counts are summed
    map-side before they move) and keeps, by 64-bit word, the bits hit at least twice. Pass two probes that
    filter, which is broadcast: its size is bounded by `most_words` whatever the input, and where it
    saturates more rows are merely taken for possible repeats. Only possible repeats shuffle; all other rows
    pass straight through. A group's size and keeper are partial aggregates; the groups that could be
    hot (at most MOST_HOT by construction, as each has over n / MOST_HOT rows) come back by broadcast, all others by
    a shuffle join in which no key has more rows than that.

    base: a table that is cheap to read again (give it checkpointed). Returns base's columns with keep_id
    (the group's largest id, or what `keep` says; null only if all its ids are null) and group_size.
    """
    n = base.count()
    words = 1
    while words * 64 < n * bits_per_row and words < most_words:
        words *= 2
    h = F.xxhash64(key_col, F.lit(17))
    bit = lambda at: F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int")
    probed = base.withColumns({"_word": F.pmod(h, F.lit(words)).cast("long"), "_a": bit(32), "_b": bit(44)})
    twice = (
        probed.select("_word", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_bit"))
        .groupBy("_word", "_bit").count().filter("count > 1")
        .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    )
    marked = probed.join(F.broadcast(twice), "_word", "left").withColumn(
        "_maybe", F.coalesce((F.getbit("_bits", "_a") == 1) & (F.getbit("_bits", "_b") == 1), F.lit(False))
    )
    out = [*base.columns, "keep_id", "group_size"]
    alone = {"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")}
    marked = cut(marked.select(*base.columns, "_maybe"))
    maybe = marked.filter("_maybe").drop("_maybe")
    groups = cut(
        maybe.groupBy(F.col(key_col).alias("_key")).agg(keep(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    )
    hot_from = max(32, -(-n // MOST_HOT))
    hot, cold = groups.filter(F.col("group_size") >= hot_from), groups.filter(F.col("group_size") < hot_from)
    tried = maybe.join(F.broadcast(hot), F.col(key_col) == F.col("_key"), "left")
    in_hot = tried.filter("_key is not null").select(*out)
    rest = tried.filter("_key is null").select(*base.columns)
    in_cold = rest.join(cold, F.col(key_col) == F.col("_key"), "left").select(
        *base.columns,
        F.when(F.col("_key").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    single = marked.filter("not _maybe").drop("_maybe").withColumns(alone).select(*out)
    return single.unionByName(in_hot).unionByName(in_cold)


def parted(rows: DataFrame, key: Column, keys: DataFrame, bits_per_key: int = 32, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows whose 64-bit key is certainly not in `keys` (one column of such), and the rest, which may be.

    By a register-blocked Bloom filter of `keys`, broadcast: of `most_words` words at most, whatever their number, and where it
    saturates more rows are taken for possible ones. No row moves. keys: give it checkpointed.
    """
    words, n = 1, keys.count()
    while words * 64 < n * bits_per_key and words < most_words:
        words *= 2
    named = {x: free_name(rows, x) for x in ("_word", "_bits", "_key")}
    bit = lambda k, at: F.shiftright(k, at).bitwiseAND(F.lit(63)).cast("int")
    k = F.col(keys.columns[0])
    filled = (
        keys.select(F.pmod(k, F.lit(words)).alias(named["_word"]), F.explode(F.array(bit(k, 32), bit(k, 44))).alias("at"))
        .groupBy(named["_word"]).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias(named["_bits"]))
    )
    k, bits = F.col(named["_key"]), F.col(named["_bits"])
    tried = rows.withColumn(named["_key"], key).withColumn(named["_word"], F.pmod(k, F.lit(words))).join(F.broadcast(filled), named["_word"], "left")
    may = F.coalesce((F.getbit(bits, bit(k, 32)) == 1) & (F.getbit(bits, bit(k, 44)) == 1), F.lit(False))
    return tried.filter(~may).select(*rows.columns), tried.filter(may).select(*rows.columns)


def small_batches(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def give_back() -> None:
    """Lets an idle Python worker hand the memory it has freed back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
