import pytest
from pyspark.errors import StreamingQueryException

from tesserae.streaming import rules


def test_an_interrupted_run_goes_on_where_it_was(spark, tmp_path):
    kind = "path string"
    for i in range(5):
        spark.createDataFrame([(f"f{i}",)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen: list[tuple[int, list[str]]] = []

    def run(stop):
        def batch(df, number):
            files = sorted(r.path for r in df.collect())
            if number == stop:
                raise InterruptedError("stopped")
            seen.append((number, files))

        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        rules.reindex(stream, batch, str(tmp_path / "check")).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run(1)
    assert [n for n, _ in seen] == [0]
    run(None)
    assert [n for n, _ in seen] == [0, 1, 2] and sorted(f for _, files in seen for f in files) == [f"f{i}" for i in range(5)]
    run(None)
    assert len(seen) == 3  # nothing is done twice
