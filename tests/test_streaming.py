import tempfile

from sqlstrata.sources.corpus import corpus_from_dir
from sqlstrata.streaming.annotate import annotate, start_annotation

from conftest import SMOKE_DIR


def test_stream_equals_batch(spark):
    corpus = corpus_from_dir(spark, SMOKE_DIR)
    base = tempfile.mkdtemp(prefix="sqlstrata-stream-")
    corpus.write.mode("overwrite").parquet(f"{base}/in")
    q = start_annotation(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", once=True)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{base}/out")
    want = annotate(corpus)
    assert got.count() == want.count() == corpus.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
