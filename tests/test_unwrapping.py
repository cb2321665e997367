import base64
import gzip

from pyspark.sql import functions as F

from veilspan.operators import unwrapping


def test_readings_are_bounded_and_never_silent(monkeypatch):
    text = "mail jane.doe@mail.example.com now"
    packed = base64.b64encode(gzip.compress(text.encode())).decode()
    assert unwrapping.unwrapped(packed) == [(1, "COMPRESSED", text)]
    assert (1, "OPAQUE", None) in unwrapping.unwrapped(base64.b64encode(gzip.compress(text.encode())[:-6]).decode())
    monkeypatch.setattr(unwrapping, "BUDGET", 10)
    assert unwrapping.unwrapped(packed) == [(1, "OPAQUE", None)]
    monkeypatch.setattr(unwrapping, "BUDGET", 1 << 20)
    monkeypatch.setattr(unwrapping, "DEPTH", 1)
    assert unwrapping.unwrapped("&amp;amp;lt;")[-1] == (2, "OPAQUE", None)


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "12:34:56:78"), (4, "plain words only"), (None, "\\u0061bc"), (5, "\\ud83d\\ude00"), (5, "\\ud83d x"), (6, "=41" * 200_000)]
    got = unwrapping.unwrappings(spark.createDataFrame(texts, "doc_id long, text string").withColumn("depth", F.lit(9)))
    rows = sorted((str(r.doc_id), r.depth, r.form, len(r.reading)) for r in got.collect())
    assert rows == [("5", 1, "ESCAPES", 1), ("6", 1, "ESCAPES", 200_000), ("None", 1, "ESCAPES", 3)]
    assert unwrapping.unwrappings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
