"""Session helpers: builder defaults, checkpoints in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, by Catalyst's own estimate, that an operator may broadcast. The estimate of a few columns is their share of
#: the compressed file; as text in a hash table they take some sixty times as much, in the driver and in each executor.
BROADCAST_LIMIT = 256 * 1024


def get_spark(app: str = "kinweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def python_path(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver imported it from."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep) and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the folder named by `spark.checkpoint.dir`.

    Only a session in a single process, as in tests, may name none: it gets a temporary folder. On a cluster that raises, as
    executors do not share the driver's disk.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinweave-"))
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, from its cost-mode explanation; filters and joins are estimated from their inputs.

    A plan without an estimate counts as too large for anything.
    """
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode="cost")
    m = re.search(r"sizeInBytes=([\d.]+(?:E[+-]?\d+)?) ?([KMGTPE]i)?B", text.getvalue())
    return int(float(m[1]) * 1024 ** (" KMGTPE".index(m[2][0]) if m[2] else 0)) if m else 1 << 62


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint only if the plan's estimated size is within `limit`, else one for a shuffle join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else spread(df)


def spread(df: DataFrame) -> DataFrame:
    """`df` with the hint that a join with it shuffles both sides.

    For tables as large as the input that generators, Python functions or explosions made: Catalyst's estimate counts one
    element an array and nothing that a function adds, so it may broadcast many times its limit through the driver.
    """
    return df.hint("merge")


def broadcast_rows(df: DataFrame, most: int) -> tuple[DataFrame, list | None]:
    """A small table as rows that were counted, with a broadcast hint, and the rows; beyond `most` rows `df` as it is, and None.

    For tables whose size Catalyst cannot estimate, such as counts of types: a shuffle on such a key would put all of a
    common type's rows into one task.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def sieve(keys: DataFrame, most_bits: int = 1 << 26) -> Callable[[Column], Column]:
    """A test that every value of `keys`, one column of text, passes and most other values fail, to thin out rows before a join.

    A bitmap of hashes with at least 32 bits a key up to `most_bits` (8 MB), where it lets more pass.
    """
    spark, (name,) = keys.sparkSession, keys.columns
    bits = min(most_bits, 1 << max(6, (32 * keys.count() - 1).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    word = lambda h: F.shiftright(h, 6).cast("int")
    one = keys.filter(F.col(name).isNotNull()).select(place(F.col(name)).alias("h")).distinct()
    one = one.groupBy(word(F.col("h")).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    # One row a word, so that a word's place in the array is its number.
    every = spark.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(one, "word", "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"])).scalar()

    def test(c: Column) -> Column:
        h = place(c)
        return F.call_function("getbit", F.get(table, word(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
