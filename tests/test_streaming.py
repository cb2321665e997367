"""Stateful streams over files."""

from veilspan.streaming import gates


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def source(spark, tmp_path, rows, schema):
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_gate_holds_until_final(spark, tmp_path):
    df = source(spark, tmp_path, [[(1, "sec", False), (2, "fine", True)], [(1, "ret", True)]], "message_id long, text string, final boolean")
    got = {(r.message_id, r.decision) for r in run(spark, gates.gate(df, "secret"), "gate")}
    assert got == {(1, "BLOCK"), (2, "ALLOW")}


def test_fragments_in_order(spark, tmp_path):
    df = source(spark, tmp_path, [[(1, 0, False)], [(1, 1, True)], [(1, 2, False)]], "stream_id long, sequence long, final boolean")
    got = {r.sequence: r.accepted for r in run(spark, gates.fragments(df), "fragments")}
    assert got == {0: True, 1: True, 2: False}


def test_registry_moves_by_the_table(spark, tmp_path):
    df = source(spark, tmp_path, [[("m", "ACTIVATE", 1)], [("m", "ACTIVATE", 2)], [("m", "REVOKE", 2)]], "mapping_ref string, action string, expected_revision long")
    got = [(r.action, r.result, r.state) for r in run(spark, gates.registry(df), "registry")]
    assert sorted(got) == [("ACTIVATE", "CHANGED", "ACTIVE"), ("ACTIVATE", "INVALID_TRANSITION", "ACTIVE"), ("REVOKE", "CHANGED", "REVOKED")]
