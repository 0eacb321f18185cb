"""Session helpers: where intermediate tables are kept, and joins that stand a hot key."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once for each Spark application, so that they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="bibloom-"), "bibloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
        spark.sparkContext.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, local mode gets a temporary one; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bibloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it again: lineage ends there and a lost executor loses nothing.

    Its rows, and the greatest value of a column ``n``, are noted while it is written; see rows_of() and lookup().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bibloom-{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    seen = Observation()
    noted = [F.count(F.lit(1)).alias("n"), *([F.max("n").alias("top")] if "n" in df.columns else [])]
    df.observe(seen, *noted).write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_forget_all)
    _written.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._bibloom_path, out._bibloom_rows, out._bibloom_top = path, seen.get.get("n"), seen.get.get("top", 0) or 0
    return out


def together(frames: list[DataFrame]) -> DataFrame:
    """The rows of several tables of ``materialise`` with one schema, as one scan."""
    first = frames[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[f._bibloom_path for f in frames])


def rows_of(df: DataFrame) -> int:
    """Rows of a table of ``materialise``, counted while it was written; of another frame by a job."""
    n = getattr(df, "_bibloom_rows", None)
    return df.count() if n is None else n


def forget(*frames: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_bibloom_path", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def _forget_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


#: A key holding more than this share of all rows is hot; at most 1 / HOT_SHARE keys can be, which bounds what lookup() broadcasts.
HOT_SHARE = 1 / 200


def lookup(big: DataFrame, small: DataFrame, key: str, total: int, n: str = "n", spread: Column | None = None) -> DataFrame:
    """``big`` left-joined with ``small``, which is unique in ``key`` and has each key's row count of ``big`` in ``n``.

    Keys holding more than HOT_SHARE of ``total`` rows (so at most 200 of them) are broadcast; their rows take a join key
    that spreads them over all partitions, so that no task gets more than its share. ``small`` should be materialised:
    then its greatest count is known, and without a hot key nothing is broadcast. Null keys match nothing and are spread
    too. Columns of ``small`` other than ``key`` and ``n`` are added; a count that is too high does no harm.
    """
    values = [c for c in small.columns if c not in (key, n)]
    least = max(1.0, total * HOT_SHARE)
    cold = small.select(F.col(key).alias("_k"), F.lit(0).alias("_s"), F.struct(*values).alias("_cold"))
    spread = spread if spread is not None else F.xxhash64(*[F.col(c).cast("string") for c in big.columns])
    top = getattr(small, "_bibloom_top", None) if n == "n" else None
    if top is not None and top <= least:
        marked, away = big.withColumn("_hot", F.lit(None).cast(cold.schema["_cold"].dataType)), F.col(key).isNull()
    else:
        hot = small.filter(F.col(n) > F.lit(least)).select(F.col(key), F.struct(*values).alias("_hot"))
        marked, away = big.join(F.broadcast(hot), key, "left"), F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_s", F.when(away, F.pmod(spread, F.lit(1 << 30)).cast("int") + 1).otherwise(F.lit(0)))
    joined = marked.join(cold, (marked[key] == cold["_k"]) & (marked["_s"] == cold["_s"]), "left")
    got = F.coalesce("_hot", "_cold")
    return joined.select(*[big_c for big_c in big.columns], *[got[v].alias(v) for v in values])
