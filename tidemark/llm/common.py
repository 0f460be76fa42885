"""Table access and Arrow batches of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of an Arrow batch.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\x20\x09-\x0D]+`` of ``text``; empty for null and for blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def give_back() -> None:
    """Free memory to the system at a task's end: idle Python workers stay beside the next stages' tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes at most, unless the session sets a bound of its own: whole texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).lower() in ("67108864b", "64mb", "67108864"):  # the default
        spark.conf.set(name, BATCH)


def map_batches(df: DataFrame, fn, schema: str, start=None) -> DataFrame:
    """Arrow batches through ``fn(columns: dict of lists, state) -> dict of lists``, in slices of 512 rows.

    ``start()`` gives the state of a task (a tokenizer, a cache of a function's values). A batch's rows depend
    on its input alone, so a task that is run again after a lost executor gives the same rows.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(_parse(schema))
        state = start() if start else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = fn(batch.slice(at, 512).to_pydict(), state)
                made = {f.name: x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow}
                yield pa.RecordBatch.from_pydict(made, schema=arrow)
        batch = out = made = state = None
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _parse(schema: str):
    from pyspark.sql import types as T

    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType()}
    kinds |= {f"array<{k}>": T.ArrayType(v) for k, v in list(kinds.items())}
    return T.StructType([T.StructField(*(lambda n, k: (n, kinds[k]))(*part.split())) for part in schema.split(", ")])
