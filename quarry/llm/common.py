"""What the training-data operators share: reading, words, scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, in a local session (tests), a folder of our own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quarry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the process ends
        pass


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that written() made."""
    path = getattr(df, "_quarry_path", None)
    if path:
        _remove(df.sparkSession, path)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._quarry_path = path
    return out


#: Rows of ids (8 to 24 bytes each) that may be broadcast.
MAX_BROADCAST = 1_000_000


def broadcast_if_small(ids: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """A written table of ids with a broadcast hint where its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(ids) if ids.count() <= limit else ids


#: Groups of rows that are broadcast for their size: at most so many (some 50 bytes each).
MAX_LARGE = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """rows left-joined on a binary key with groups, one row for each key, whose column n counts the rows of the key.

    Groups of more than one MAX_LARGE-th of all rows can be MAX_LARGE at most and are met by broadcast, so no key of the
    shuffled join has more rows than that; rows that were met already, or have no key, are dealt evenly.
    """
    bound = max(1000, (groups.agg(F.sum(n)).first()[0] or 0) // MAX_LARGE)
    values = [c for c in groups.columns if c not in (key, n)]
    renamed = [F.col(c).alias(f"_l_{c}") for c in values]
    large = F.broadcast(groups.where(F.col(n) > bound).select(F.col(key).alias("_l_key"), *renamed, F.lit(True).alias("_l")))
    small = groups.where(F.col(n) <= bound).select(F.col(key).alias("_s_key"), *values)
    met = rows.join(large, F.col(key) == F.col("_l_key"), "left").withColumn("_at", F.monotonically_increasing_id())
    alone = F.encode(F.concat(F.lit("#"), F.col("_at").cast("string")), "UTF-8")
    met = met.withColumn("_at", F.when(F.col("_l").isNull(), F.coalesce(F.col(key), alone)).otherwise(alone))
    out = met.join(small, F.col("_at") == F.col("_s_key"), "left")
    return out.select(*[met[c] for c in rows.columns], *[F.coalesce(f"_l_{c}", c).alias(c) for c in values])
