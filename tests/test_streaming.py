import tempfile

from dispatchlens.plans.materialize import fact_table, raw_deliveries
from dispatchlens.sources.schema import RAW_SCHEMA
from dispatchlens.streaming.enrich import stream_facts

SF = "/root/testdata/sf0.001"


def test_stream_facts_match_batch_rows(spark):
    raw = raw_deliveries(spark, SF)
    batch = fact_table(spark, SF)
    src = tempfile.mkdtemp(prefix="dl-stream-src-")
    raw.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(RAW_SCHEMA).parquet(src)
    q = (stream_facts(stream, raw).writeStream.format("memory").queryName("stream_facts_t")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="dl-stream-ck-")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("stream_facts_t")
    assert got.count() == batch.count()
    shown = lambda d: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*batch.columns).collect()]
    assert sorted(map(str, shown(got))) == sorted(map(str, shown(batch)))
