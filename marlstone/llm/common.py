"""What several operators share: reading tables, cutting lineage, running a function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lineage import cut, cut_folder, join_unique, remove  # noqa: F401

#: Texts are worked on in slices of about so many characters, so that memory does not follow the Arrow batch.
SLICE_CHARS = 2_000_000

#: Bytes of an Arrow batch between Spark and Python, about.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of the session are bounded, as texts may be long and a task holds several.

    Spark reads this setting when a job starts, which may be long after the operator has returned its plan, so it stays
    set. A size that the session has set for itself is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == _default(name, df.sparkSession):
        conf.set(name, BATCH_BYTES)
    return df


def _default(name: str, spark: SparkSession) -> str:
    return spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(name)


_HELD: dict = {}


def held(key, make: Callable):
    """What a Python worker keeps from task to task: ``make()`` of the last key alone, so that the tables of one
    operator are gone when the worker turns to another."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(texts: list, size: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive slices of a batch, each of one text or of at most ``size`` characters."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and held + n > size:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def over_texts(df: DataFrame, make: Callable, schema: str, *, key: str = "doc_id", text: str = "text", flat: bool = False) -> DataFrame:
    """Run ``make()`` once a task and the function that it returns over every text.

    The function takes a list of texts (null: empty) and returns a list of tuples, the columns of ``schema`` after
    the key; with ``flat`` it returns for each text a list of such tuples. Keys of any type, null too, are passed on.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices(texts):
                some = [x or "" for x in texts[part]]
                rows = work(some)
                own = keys.slice(part.start, len(some))
                if flat:
                    own = own.take(pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64()))
                    rows = [x for r in rows for x in r]
                if rows:
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [key, *fields])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    fields, types = parsed.names, [to_arrow_type(f.dataType) for f in parsed]
    return small_batches(df).select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, {schema}")
