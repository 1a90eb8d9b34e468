"""What the operators share: folders that all executors see, staged tables, folds, training samples."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, and the words themselves, of contracts on raw words.
SPACES = r"[\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that has none gets a temporary folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _OWN[app]


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone, and its folder stays for the owner of the shared one
            return


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet and read back: work is not done twice, and a lost executor costs nothing that is stored."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """df in as many partitions as its rows ask for, if the session's setting gives more."""
    return df.coalesce(max(1, -(-rows // per_task)))


def fold(key: Column, parts: int) -> Column:
    """crc32(key as text) mod parts; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


#: Arrow batches of texts: Spark's own bounds on rows and bytes, and ours. A session that has set others keeps them.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def prepare(spark: SparkSession) -> None:
    """Texts are long: batches for Python are bounded. Results are lazy, so the settings stay in the session."""
    for key, (default, own) in _BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, own)


# ---------------------------------------------------------------- Python workers


_RESIDENT: dict = {"owner": None, "held": {}}


def resident(owner: str, key, make: Callable):
    """What a Python worker keeps from task to task of one operator; the first task of another one drops it."""
    if _RESIDENT["owner"] != owner:
        _RESIDENT["owner"], _RESIDENT["held"] = owner, {}
    held = _RESIDENT["held"]
    if key not in held:
        held[key] = make()
    return held[key]


def release() -> None:
    """Free memory goes back to the system: workers live on between tasks, beside a full heap."""
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def task(owner: str, run: Callable) -> Callable:
    """run over a task's batches, for mapInPandas and iterator UDFs: begins without other operators' tables, ends lean."""

    def whole(batches: Iterator) -> Iterator:
        if _RESIDENT["owner"] not in (None, owner):
            _RESIDENT["owner"], _RESIDENT["held"] = None, {}
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def column_udf(owner: str, schema: str, run: Callable) -> Callable:
    """A column function over batches of columns. Ids and other columns stay in the JVM, so they come out as they went in."""
    from pyspark.sql.pandas.functions import PandasUDFType

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the kind is given here, for a closure has no hints to tell it by
        return F.pandas_udf(task(owner, run), schema, PandasUDFType.SCALAR_ITER).asNondeterministic()


def whole_ids(df: DataFrame, col: str) -> None:
    """For operators that order rows by id."""
    if not isinstance(df.schema[col].dataType, T.IntegralType):
        raise TypeError(f"{col} is {df.schema[col].dataType.simpleString()}; whole numbers are expected, number the rows first")


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that each holds about per_task rows, never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, parts: int, held: int) -> DataFrame:
    """Text and label of at most ``most`` training documents of each label value, chosen by a hash of their id.

    Rows of the held-out fold, null labels and labels without a document are left out. The bound is taken per label value
    on (hash, id), so the same corpus always gives the same sample. Only ids are ranked; texts join the chosen ids.
    """
    d = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.filter(fold(F.col("doc_id"), parts) != held).dropDuplicates(["doc_id", "label"])
    tops = [ids.filter(F.col("label") == v).orderBy(F.xxhash64(F.col("doc_id"), F.lit(label)), "doc_id").limit(most) for v in (0, 1)]
    return d.join(reduce(DataFrame.union, tops), "doc_id")


def hashed_sample(docs: DataFrame, most: int, parts: int, held: int, salt: str) -> DataFrame:
    """Text of at most ``most`` training documents, chosen by a hash of their id."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    top = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(salt)), "doc_id").limit(most).distinct()
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(top, "doc_id")
