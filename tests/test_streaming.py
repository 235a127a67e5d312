import tempfile

from pyspark.sql import functions as F

from cohortscope.operators.timing import first_event
from cohortscope.streaming import read_first_events, start_first_events
from conftest import SF_SMALL, rows


def test_streamed_first_events_equal_batch(spark):
    scratch = tempfile.mkdtemp(prefix="cohortscope-stream-", dir="/tmp")
    src, out, ckpt = f"{scratch}/src", f"{scratch}/out", f"{scratch}/ckpt"
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at")
    )
    # Two appends to the source folder: two micro-batches, the second lowers some minima.
    late = orders.filter(F.col("created_at") >= "1998-01-01")
    early = orders.filter(F.col("created_at") < "1998-01-01")
    late.write.parquet(f"{src}/part=1")
    stream = spark.readStream.schema(orders.schema).parquet(f"{src}/*")
    q = start_first_events(stream, out, checkpoint_location=ckpt, available_now=True)
    q.awaitTermination()
    early.write.parquet(f"{src}/part=2")
    q = start_first_events(stream, out, checkpoint_location=ckpt, available_now=True)
    q.awaitTermination()

    got = sorted(rows(read_first_events(spark, out)))
    want = sorted(rows(first_event(orders, name="first_at")))
    assert got == want and len(got) > 0
