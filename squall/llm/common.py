"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.shipping import ship


#: Rows of an Arrow batch that goes to a Python worker, where the session leaves Spark's default: texts are long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Executors can import this package, and batches of texts are small."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc(column: str):
    return F.crc32(F.col(column).cast("string"))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share; set only where it is unset, and then only on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import atexit
            import shutil
            import tempfile

            where = tempfile.mkdtemp(prefix="squall-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


def map_texts(docs: DataFrame, work, schema: str, text: str = "text") -> DataFrame:
    """Applies work(record batch) to slices of bounded bytes; a long text makes a slice of its own."""
    ready(docs.sparkSession)

    def run(batches):
        from squall.llm.textcore import slices

        for batch in batches:
            place = batch.schema.get_field_index(text)
            for i, j in slices(batch.column(place)):
                made = work(batch.slice(i, j - i))
                if made is not None and made.num_rows:
                    yield made

    return docs.mapInArrow(run, schema)


def columns(batch, *names):
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def written(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """df, checkpointed, with its number of rows as n and further aggregates of the same pass.

    After a lost executor rows may be counted again: use the figures only where more does no harm.
    """
    from pyspark.sql import Observation

    shared_dir(df.sparkSession)
    seen = Observation()
    done = df.observe(seen, F.count(F.lit(1)).alias("n"), *[x.alias(k) for k, x in metrics.items()]).checkpoint()
    return done, {"n": 0, **seen.get}
