"""What the corpus operators share: the shared scratch folder, Arrow batches and word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in every contract here: space and \t \n \v \f \r, exactly what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"

#: Input rows for each file of a small table beyond the least number of files.
FILE_ROWS, LEAST_FILES = 1_000_000, 6

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where that is unset (local tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="attestry-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet into the shared folder and reads them back. The new frame carries its path in `saved_at`;
    what forget() hasn't deleted goes when the session ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)  # whoever reads the rows does so in this session
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(*frames: DataFrame) -> None:
    """Deletes what save() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "saved_at", None):
            at, fs = _file_system(df.sparkSession, path)
            fs.delete(at, True)


def hold(df: DataFrame) -> DataFrame:
    """Keeps a step's rows on the executors' disks. Unlike a local checkpoint it keeps its lineage too: what a lost executor held is
    made again from its input. For steps of which many follow each other, where writing files would cost more than it saves."""
    return df.persist(StorageLevel.DISK_ONLY)


def settle(df: DataFrame, name: str, rows: int) -> DataFrame:
    """save() of a small table into few files, as many as `rows` of the input call for. The rows are dealt out anew after the step,
    which itself runs in as many tasks as it comes in."""
    return save(df.repartition(LEAST_FILES + rows // FILE_ROWS), name)


#: Arrow batches of whole texts: long documents come by the thousand at worst. Spark's own values, for which these stand in, are the keys' second entries.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(16 << 20), f"{64 << 20}b")}


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small. The settings are the same for all operators, and a session that has chosen its own keeps them."""
    for key, (ours, default) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


_remembered: dict = {}


def remembered(owner, make):
    """What a Python worker keeps for one operator between batches and tasks. Workers outlive an operator; what another one kept goes first."""
    if owner not in _remembered:
        _remembered.clear()
        _remembered[owner] = make()
    return _remembered[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True for the third of documents that nothing may be learned from: crc32 of the id as text, mod 3, is 1. Ids that are null are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
