"""Sinks of micro-batches: a batch run twice writes once."""

from tracewell.operators import summaries
from tracewell.streaming import guarded


def test_states_change_once(spark, tmp_path):
    start = spark.createDataFrame([(1, "N"), (2, "N"), (3, "R"), (4, "C")], "id long, state string")
    path = str(tmp_path / "states")
    wish = lambda *rows: spark.createDataFrame(rows, "id long, at int, new_state string")
    write = guarded.run_states(path, start)
    batches = [wish((1, 2, "X"), (1, 1, "L"), (2, 1, "R"), (4, 1, "X"), (9, 1, "X")), wish((1, 3, "R"), (2, 3, "X"), (3, 1, "S"), (3, 1, "F")), wish((1, 4, "R"))]
    for number in (0, 0, 1, 0, 1, 2):  # batches are run again, also when later ones are there
        write(batches[number], number)
    states = lambda *n: {r.id: r.state for r in guarded.current_states(path, start, *n).collect()}
    assert states(1) == {1: "L", 2: "N", 3: "R", 4: "C"}
    assert states() == {1: "R", 2: "X", 3: "F", 4: "C"} and states(0) == {1: "N", 2: "N", 3: "R", 4: "C"}


def test_long_logs_are_files(spark, tmp_path):
    path, write = str(tmp_path / "logs"), guarded.logs(str(tmp_path / "logs"), inline=10)
    rows = lambda *r: spark.createDataFrame(r, "run long, kind string, text string, at int")
    first = rows((1, "out", "short", 1), (1, "err", "é" * 6, 1), (2, "out", "x\ny" * 50, 1), (2, "out", "old", 0))
    for _ in range(2):
        write(first, 0)
    write(rows((1, "out", "new", 1)), 1)
    got = {(r.run, r.kind): (r["size"], r.short_text, r.batch) for r in guarded.stored_logs(spark, path).collect()}
    assert got == {(1, "out"): (3, "new", 1), (1, "err"): (12, "", 0), (2, "out"): (150, "", 0)}
    files = spark.read.text(f"{path}/long/batch=0", wholetext=True).collect()
    assert sorted((r.run, r.kind, r.value.rstrip("\u0000")) for r in files) == [(1, "err", "é" * 6), (2, "out", "x\ny" * 50)]


def test_unseen_rows_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(i % 3, i * i % 17, i) for i in range(90)]
    df = spark.createDataFrame(rows, "family int, dataset int, run int")
    for k in range(3):
        df.where(f"run div 30 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = guarded.unseen(str(tmp_path / "out"), "family", "dataset", "run")

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("family", "dataset", "run").collect()))
    assert got == sorted(map(tuple, summaries.first_seen(df, "family", "dataset", "run").select("family", "dataset", "run").collect()))
