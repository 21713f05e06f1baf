"""Streams and files."""

from docfathom.sources import files
from docfathom.streaming import windows as W


def test_sliding_metrics(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 10 as int)) as ts, id % 3 as user_id, if(id % 4 = 0, 'error', 'view') as event_type, cast(id as double) as value from range(60)")
    rows.repartition(1).write.parquet(f"{tmp_path}/events")
    stream = W.read_events(spark, f"{tmp_path}/events")
    got = W.run_once(W.sliding_metrics(stream, "1 hour", "30 minutes"), "sliding", "append", f"{tmp_path}/c1").collect()
    assert got and all(r.n <= 6 for r in got) and sum(r.errors for r in got) > 0
    rate = W.adaptive_rate(stream.selectExpr("cast(user_id as string) as key", "value / 100 as latency", "if(event_type = 'error', 500, 200) as status"))
    out = W.run_once(rate, "rates", "update", f"{tmp_path}/c2").collect()
    assert {r.key for r in out} == {"0", "1", "2"} and all(r.n == 20 for r in out)
    assert W.next_rate(1, 0.1, 0, True, 0.1, 9) == 0.5 and W.next_rate(1, 0.9, 0, False, 0.1, 9) == 0.8 and W.next_rate(9, 0.1, 0, False, 0.1, 9) == 9


def test_files(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.py").write_text("x = 'é'\n")
    (tmp_path / "code/b.py").write_bytes(b"\x00\x01")
    (tmp_path / "code/c.py").write_bytes(b"caf\xe9")
    assert sorted(r.code for r in files.tree(spark, str(tmp_path / "code")).collect()) == ["café", "x = 'é'\n"]
    (tmp_path / "v.csv").write_text("term,weight\ndeep learning,2.5\n,1\nsvm,\n")
    assert {(r.term, r.weight) for r in files.vocabulary_csv(spark, str(tmp_path / "v.csv")).collect()} == {("deep learning", 2.5), ("svm", 1.0)}
    (tmp_path / "log.json").write_text('{"event": "retry", "attempt": 2}\nbroken\n')
    assert [r.event for r in files.audit_log(spark, str(tmp_path / "log.json")).collect()] == ["retry"]
    root = str(tmp_path / "graph")
    for n in (3, 5):
        files.publish({"nodes": spark.range(n).toDF("node")}, root)
        assert files.published(spark, root, "nodes").count() == n
    assert files.unfinished(spark.range(4).toDF("k"), spark.range(3).toDF("k"), "k").count() == 1
