"""What the operators share: shared-storage tables, Arrow columns as bytes, bounded samples."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. A batch holds whole texts, so it is kept small for memory's sake.
BATCH_ROWS = 500

#: Bytes of an Arrow batch: a few very long texts fill one.
BATCH_BYTES = 16 << 20

_made: dict[str, tuple[object, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and driver and executors are one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    path = tempfile.mkdtemp(prefix="lakeloom-checkpoints-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut, and a lost executor costs no redo.

    The table goes when it is forgotten, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(forget)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    # the file system outlives the session
    _made[path] = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more; without arguments all of this process."""
    for path in [t.stored_at for t in tables] if tables else list(_made):
        files, place = _made.pop(path)
        try:
            files.delete(place, True)
        except Exception:  # the JVM has ended before us
            pass


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the rows and bytes of an Arrow batch, for the rest of the session: the plan is made when df runs, long after this."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not held.lstrip("-").isdigit() or not 0 < int(held) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo: the fold of a document. A null id has the fold of the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_ids(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows with distinct keys: those with the smallest xxhash64 of the key. The same rows on every run."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(bound)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)
