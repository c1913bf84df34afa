"""Theme counts on a stream equal the batch result."""

from pyspark.sql import functions as F

from topicspark.operators import match as M
from topicspark.plans import fixtures as fx
from topicspark.streaming.themes import stream_theme_counts


def test_stream_equals_batch(spark, scratch):
    src = f"{scratch}/in"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(src)
    themes = fx.fx_themes(spark)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_theme_counts(stream, themes, f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination(300)
    out = spark.read.parquet(f"{scratch}/out")
    batch = M.measure_space(docs, themes)

    def flat(df):
        return {r.doc_id: sorted(r.theme_counts.items()) for r in df.select("doc_id", "theme_counts").collect()}
    assert flat(out) == flat(batch)
    assert out.select(F.countDistinct("batch_id")).first()[0] >= 2
