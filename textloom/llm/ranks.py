"""Exact positions within groups by range-partitioned sorting and partition offsets.

No group is gathered in one task: rows are range-partitioned by (group, order), sorted within partitions, and written to the
shared folder; each partition's totals per group (at most partitions plus groups rows) are summed up to offsets, and a second
pass over the partitions adds positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut


def running(df: DataFrame, group: str, order: list[str], weight: str, partitions: int | None = None) -> DataFrame:
    """df with `before` and `total`: the weight of the rows ahead in the row's group, and of the whole group.

    group must be a string without nulls and weight a long without nulls; rows that tie in order stay in the order of the sort, so
    order should end in a unique column where that matters.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part", group).agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = {
        (r["_part"], r[group]): (r["_ahead"] or 0, r["_whole"])
        for r in sums.withColumn("_ahead", F.sum("_sum").over(ahead)).withColumn("_whole", F.sum("_sum").over(whole)).collect()  # partitions + groups rows
    }
    shared = spark.sparkContext.broadcast(offsets)
    names = df.columns
    g, w = names.index(group), names.index(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(len(names))[0].as_py()
            groups = batch.column(g).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            weights = batch.column(w).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.zeros(len(codes), np.int64)
            total = np.zeros(len(codes), np.int64)
            for code, name in enumerate(groups.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code)
                ahead_of, all_of = shared.value[part, name]
                sums = np.cumsum(weights[at])
                before[at] = ahead_of + seen.get(name, 0) + sums - weights[at]
                total[at] = all_of
                seen[name] = seen.get(name, 0) + int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(before), pa.array(total)], [*names, "before", "total"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return placed.mapInArrow(run, f"{fields}, before long, total long")
