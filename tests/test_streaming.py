"""A stream of events leaves the history that the whole log gives."""

from shapelake.operators.sessions import replay_history
from shapelake.sources import tables
from shapelake.streaming.histories import stream_changes, stream_histories, stream_triples

SF = "/root/testdata/sf0.001"


def _run(spark, df, f, name, tmp_path, order):
    schema = df.schema
    for part, rows in enumerate((f"{order} <= 20", f"{order} > 20")):
        df.where(rows).coalesce(1).write.parquet(str(tmp_path / name / f"p{part}"))
    out = []
    stream = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name)))
    q = stream.writeStream.foreachBatch(lambda b, n: out.append((n, b.collect()))).outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_stream_equals_batch(spark, tmp_path):
    log = tables.op_log(spark, SF)
    batches = _run(spark, log, stream_histories, "log", tmp_path, "event_seq")
    last = {}
    for _, rows in batches:
        for s in {r.session_id for r in rows}:
            last[s] = sorted((r.op_seq, r.kind, r.measure) for r in rows if r.session_id == s)
    want = {}
    for r in replay_history(log).collect():
        want.setdefault(r.session_id, []).append((r.op_seq, r.kind, r.measure))
    assert last == {s: sorted(v) for s, v in want.items()}


def test_changes_add_up_to_the_batch(spark, tmp_path):
    log = tables.op_log(spark, SF)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = _run(spark, log, stream_changes, "changes", tmp_path, "event_seq")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    held = {}
    for _, rows in sorted(batches):
        for r in sorted(rows, key=lambda r: (r.session_id, r.event_seq)):
            mine = held.setdefault(r.session_id, [])
            assert len(mine) == r.place + (r.change == "undo")
            if r.change == "undo":
                assert mine.pop()[0] == r.op_seq
            else:
                mine.append((r.op_seq, r.kind, r.measure, r.previous))
    want = {}
    for r in replay_history(log).collect():
        want.setdefault(r.session_id, []).append((r.op_seq, r.kind, r.measure, r.previous))
    assert {s: x for s, x in held.items() if x} == {s: sorted(v) for s, v in want.items()}


def test_triples_skip_flat_third_clicks(spark, tmp_path):
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (2, 0), (0, 1), (5, 5), (6, 6), (7, 8)], 18)]
    df = spark.createDataFrame(rows, "session_id long, click_seq long, x double, y double")
    got = [r for _, b in _run(spark, df, stream_triples, "clicks", tmp_path, "click_seq") for r in b]
    assert [(r.op_seq, r.x3, r.y3) for r in got] == [(0, 0.0, 1.0), (1, 7.0, 8.0)]
