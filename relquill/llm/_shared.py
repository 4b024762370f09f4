"""Helpers the corpus operators share: shared storage, batch sizes, deterministic bounded samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and Python regular expression of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Side tables of at most this many ids (8 bytes each) may be broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of whole texts that a training sample brings to the driver at most (beyond one text a label).
SAMPLE_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: spark.checkpoint.dir, or, where that is unset, one of our own.

    Without the setting a local session gets a temporary folder that is removed at exit, and a cluster
    session gets a folder in its warehouse, which is shared by definition.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            made = tempfile.mkdtemp(prefix="relquill-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _local_dirs[app] = f"file://{made}"
        else:
            _local_dirs[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return _local_dirs[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relquill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove what ``stage`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/relquill/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so that workers can import them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="relquill-src-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "relquill_src.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(folder / "relquill_src.zip"))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Ready the session for operators with Python workers: the package shipped, Arrow batches of whole texts bounded."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key).rstrip("bB")) > 16 << 20:
            spark.conf.set(key, str(16 << 20))
    except Exception as error:  # noqa: BLE001  the setting is newer than some Spark releases
        if "SQL_CONF_NOT_FOUND" not in str(error) and "NumberFormat" not in str(error) and not isinstance(error, ValueError):
            raise


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def sampled_ids(labelled: DataFrame, id_col: str, label_col: str, per_label: int) -> list[tuple]:
    """For each label the ``per_label`` ids of the smallest hash: a sample that is bounded, and the same in every run.

    ``labelled`` has one slim row per id, and may have any number of labels. Counts (combined map-side) say below which hash
    about twice as many ids of a label stand as are wanted, so only those are sorted and no task gathers a whole label.
    """
    known = labelled.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__l")).where("__id IS NOT NULL AND __l IS NOT NULL")
    counts = known.groupBy("__l").agg(F.count(F.lit(1)).alias("__n"))
    part = F.least(F.lit(1.0), F.lit(2.0 * per_label + 200) / F.col("__n"))
    counts = counts.select(F.col("__l").alias("__k"), part.alias("__part"))
    hashed = known.withColumn("__h", F.xxhash64("__id", F.lit(7)))
    low = hashed.join(F.broadcast(counts), F.col("__l") == F.col("__k")).where(F.col("__h") / F.lit(2.0**64) + 0.5 <= F.col("__part"))
    first = Window.partitionBy("__l").orderBy("__h", "__id")
    rows = low.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= per_label)
    return [(r[0], r[1]) for r in sorted(rows.select("__id", "__l", "__r").collect(), key=lambda r: (r[1], r[2]))]


def sampled_rows(docs: DataFrame, sample: list[tuple], id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is sampled, with ``__label``; the sample's documented bound makes its broadcast safe."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    ids = spark.createDataFrame([(i, int(label)) for i, label in sample], f"__id {kind}, __label int")
    return docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id")).drop("__id")


def sampled_texts(docs: DataFrame, sample: list[tuple], id_col: str, text_col: str, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, object, str]]:
    """(label, id, text) of the sampled rows with a text, texts whole, in an order of their own.

    Labels share ``most_bytes`` equally; where a label's texts are longer together, the first in the sample's order are
    taken, one at least.
    """
    text = F.col(text_col).cast("string").alias("__t")
    rows = stage(sampled_rows(docs.select(id_col, text), sample, id_col).where("__t IS NOT NULL"), "sample")
    size: dict[tuple, int] = {}
    for label, i, n in rows.select("__label", id_col, F.octet_length("__t")).collect():
        size[label, i] = size.get((label, i), 0) + n
    share = most_bytes // max(1, len({label for _, label in sample}))
    left, chosen = {}, []
    for i, label in sample:
        if (label, i) in size:
            room = left.get(label)
            if room is None or room >= size[label, i]:
                left[label] = (share if room is None else room) - size[label, i]
                chosen.append((i, label))
            else:
                left[label] = -1  # the first that does not fit ends it, so lengths do not choose
    if len(chosen) < len(size):
        rows = sampled_rows(rows.drop("__label"), chosen, id_col)
    got = [(r["__label"], r[id_col], r["__t"]) for r in rows.collect()]
    return sorted(got, key=lambda r: (r[1], r[0], r[2]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
