"""Places of rows in the order of their group, without a group ever meeting in one task.

Rows are dealt by range of (group, order), so a group that holds a third of all rows spans many tasks. Each task
counts along its sorted rows; what earlier tasks hold of a group that crosses into a task is added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm._shared import shuffle_partitions, written


def ranked(rows: DataFrame, group: str, order: list[Column | str], name: str, pos_col: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``pos_col``, counted from 0 in each group; sizes as (group, n)). ``group`` must not be null.

    Rows that tie in ``order`` keep any order, so give enough of it. Only a group that begins before a task and goes on in it needs a
    correction, so that table has at most one row for each task and is broadcast.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), group, *order).sortWithinPartitions(group, *order)
    out = [*rows.columns, "_local", "_task"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or keys[0].as_py() != last
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, -1))
            local = np.where(begin >= 0, at - begin, at + held)
            last, held = keys[-1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64()), pa.array(np.full(n, task), pa.int32())], names=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    counted = written(dealt.mapInArrow(count, f"{fields}, _local long, _task int"), name)
    parts = written(counted.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n")), f"{name}_tasks")
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    crossing = written(parts.select(group, "_task", before.alias("_before")).where("_before > 0"), f"{name}_crossing")
    pos = F.col("_local") + F.coalesce("_before", F.lit(0).cast("long"))
    placed = counted.join(F.broadcast(crossing), [group, "_task"], "left").withColumn(pos_col, pos).select(*rows.columns, pos_col)
    return placed, parts.groupBy(group).agg(F.sum("_n").alias("n"))
