"""Small helpers the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wiresift.scratch import scratch_dir

EXPAND_STEP = 1 << 16
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(frame: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """The frame written below ``spark.checkpoint.dir`` and read back: its lineage ends there.

    The shuffle files of the job are removed with it, as nothing else reads them.
    """
    spark = frame.sparkSession
    path, before = scratch_dir(spark, purpose), spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        frame.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


def text_key(text: Column | str = "text") -> Column:
    """With the document's id it names a row; rows that share both are the same document written twice."""
    return F.xxhash64(text)


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of the frame."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def expand(frame: DataFrame, count: str, number: str) -> DataFrame:
    """Every row ``count`` times, numbered from 0; rows with a count below 1 go.

    Large counts are opened in two steps, so no row ever holds an array of more
    than ``EXPAND_STEP`` numbers (or a ``EXPAND_STEP``-th of its count).
    """
    step, n = F.lit(EXPAND_STEP), F.col(count)
    block, within = free_names(frame, "_block", "_within")
    return (
        frame.where(n > 0)
        .withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step).cast("long"))))
        .withColumn(within, F.explode(F.sequence(F.lit(0).cast("long"), F.least(n - 1 - F.col(block) * step, step - 1).cast("long"))))
        .withColumn(number, F.col(block) * step + F.col(within))
        .drop(block, within)
    )


def blocks(batches, text_at: int, most_bytes: int):
    """Rows of Arrow batches as lists of Python tuples whose texts come to about ``most_bytes`` (one row at least)."""
    for batch in batches:
        columns, rows, held = batch.columns, [], 0
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            rows.append(row)
            held += len(row[text_at] or "")
            if held >= most_bytes:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows
