"""What the training-data operators share: table access, Arrow bounds, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python. Texts of a few KB make a batch of some MB.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def as_rows(df: DataFrame):
    """All columns of df as one struct, so that no column of an operator's own can clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep what one Python worker holds at once small, whatever the texts' lengths; narrow rows may be more."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: What the tasks of one operator keep in a Python worker from task to task.
_KEPT: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """A dictionary for an operator's tasks in this worker; what another operator has kept before is dropped, as workers outlive stages."""
    for other in [o for o in _KEPT if o != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n (the folds that the labels are split by)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
