"""Given tables of few row groups."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from clipatlas.plans.relations import spread


def test_a_row_group_in_many_splits_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": list(range(20_000))}), path, compression="none", use_dictionary=False)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "1000b")
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = spread(rows, path)
        tasks = dealt.select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks == spark.sparkContext.defaultParallelism > 1 and dealt.count() == 20_000
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
