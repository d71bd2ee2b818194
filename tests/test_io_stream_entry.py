import duckdb

from promptscreen.operators import cascade
from promptscreen.plans.workflow import Workflow
from promptscreen.sources import io
from promptscreen.streaming import stream
from tests.conftest import SF001, SF01


def test_csv_round_trip_keeps_hard_text(spark):
    rows = [(1, 'say "hi", then\nleave', "vanilla_benign", 0), (2, "  padded  ", "x", 1)]
    df = spark.createDataFrame(rows, "prompt_id bigint, prompt string, data_type string, label int")
    d = io.scratch_dir(spark, "test-csv")
    io.write_csv(df, d)
    back = sorted(tuple(r) for r in io.read_split_csv(spark, d).collect())
    assert back == sorted(rows)


def test_model_round_trip(spark):
    wf = Workflow.get(spark, SF001)
    d = io.scratch_dir(spark, "test-model")
    io.save_linear(wf.model, d)
    m2 = io.load_linear(spark, d)
    a = sorted((r.prompt_id, r.logit) for r in wf.model.score(wf.test).collect())
    b = sorted((r.prompt_id, r.logit) for r in m2.score(wf.test).collect())
    assert a == b


def test_stream_equals_batch(spark):
    wf = Workflow.get(spark, SF001)
    d = io.scratch_dir(spark, "test-stream")
    wf.requests.repartition(3).write.parquet(f"{d}/in")
    q = stream.start_scoring(spark, wf.model, f"{d}/in", f"{d}/out", f"{d}/ck",
                             max_files_per_trigger=1)
    q.awaitTermination()
    s = sorted((r.prompt_id, r.harmful_probability) for r in
               stream.read_results(spark, f"{d}/out").collect())
    b = sorted((r.prompt_id, r.harmful_probability) for r in
               cascade.score_requests(wf.model, wf.requests).collect())
    assert s == b


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"data_type", "n", "f1", "accuracy"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_spot_check(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for key in ("w2_split", "a6_breakdown", "m9_cascade"):
        df = E.queries()[key](spark, SF001)
        s = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in
                   df.select(*sorted(df.columns)).collect())
        rel = con.sql(E.oracle_sql()[key])
        cols = rel.columns
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        d = sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)
                   for r in rel.fetchall())
        assert s == d, key


def _stream_dirs(spark, parts):
    d = io.scratch_dir(spark, "reuse")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, stream.REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/in{k}")
    return d


def test_repeated_requests_reuse_a_verdict_until_it_expires(spark):
    parts = [[(1, "abc"), (2, "abc"), (3, None), (4, "")], [(5, "abc"), (6, "xy"), (7, None)]]
    d = _stream_dirs(spark, parts)

    def predict():
        return lambda texts: [0.25 if t is None else len(t) / 100 for t in texts]

    def run(source, sink, check, **more):
        stream.start_reusing(spark, predict, f"{d}/{source}", f"{d}/{sink}", f"{d}/{check}", **more).awaitTermination()
        return {r.prompt_id: (r.prompt, r.harmful_probability, r.reused) for r in stream.read_results(spark, f"{d}/{sink}").collect()}

    first = run("in0", "out", "ck")
    assert first[3] == (None, 0.25, False) and first[4] == ("", 0.0, False)
    assert {first[1], first[2]} == {("abc", 0.03, False), ("abc", 0.03, True)}
    # a restart with new files goes on with the state
    spark.createDataFrame(parts[1], stream.REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/in0")
    second = run("in0", "out", "ck")
    assert second[5] == ("abc", 0.03, True) and second[7] == (None, 0.25, True) and second[6] == ("xy", 0.02, False)
    assert {k: second[k] for k in first} == first and len(second) == 7
    # another checkpoint on the same sink is another run: earlier verdicts stay
    run("in1", "out", "other")
    assert stream.read_results(spark, f"{d}/out").count() == 10
    # kept for no time at all, a text is scored again by the next batch
    e = _stream_dirs(spark, [[(1, "abc")]])
    for k in (2, 3):
        stream.start_reusing(spark, predict, f"{e}/in0", f"{e}/out", f"{e}/ck", keep_ms=1).awaitTermination()
        spark.createDataFrame([(k, "abc"), (10 + k, "other")], stream.REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{e}/in0")
    stream.start_reusing(spark, predict, f"{e}/in0", f"{e}/out", f"{e}/ck", keep_ms=1).awaitTermination()
    assert stream.read_results(spark, f"{e}/out").filter("prompt = 'abc' and not reused").count() >= 2


def test_a_new_checkpoint_overwrites_no_verdicts(spark):
    wf = Workflow.get(spark, SF01)
    d = io.scratch_dir(spark, "runs")
    wf.requests.limit(20).coalesce(1).write.parquet(f"{d}/in")
    for check in ("a", "b", "a"):
        stream.start_scoring(spark, wf.model, f"{d}/in", f"{d}/out", f"{d}/{check}").awaitTermination()
    assert spark.read.parquet(f"{d}/out").groupBy("run").count().collect() and stream.read_results(spark, f"{d}/out").count() == 40
