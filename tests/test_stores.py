"""Stores, streams with state, pages, prompts and ranks: resumption, late rows, collisions, and what is left untouched."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import chat, jsonops, text
from threadloom.operators import personas, ranking, splits, stores, threads
from threadloom.plans import processor
from threadloom.sources import paged, writers
from threadloom.streaming import playlists


def one(column, spark):
    return spark.range(1).select(column.alias("x")).first().x


def values(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_pages_are_read_once_over_restarts(spark, tmp_path):
    rows = spark.range(95).select(F.col("id"))

    def run(numbers):
        paged.write_pages(rows, str(tmp_path / "pages"), "id", ["id"], 10, numbers)
        stream = paged.pages(spark, str(tmp_path / "pages"), per_batch=3)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(p.numInputRows for p in q.recentProgress)

    assert [run(range(4)), run(range(4, 4)), run(range(4, 7)), run(range(7, 10))] == [40, 0, 30, 25]
    got = spark.read.schema("cursor string, place int, item string").parquet(str(tmp_path / "out"))
    assert sorted(int(r.item) for r in got.collect()) == list(range(95)) and got.select("cursor").distinct().count() == 10
    assert run(range(10, 10)) == 0


def test_a_run_reads_all_pages_that_are_there(spark, tmp_path):
    """More pages than a batch, whether a run is the first or goes on from a checkpoint."""
    rows = spark.range(120).select(F.col("id"))
    for numbers, want in ((range(5), 50), (range(5, 12), 120)):
        paged.write_pages(rows, str(tmp_path / "pages"), "id", ["id"], 10, numbers)
        stream = paged.pages(spark, str(tmp_path / "pages"), per_batch=2)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema("cursor string, place int, item string").parquet(str(tmp_path / "out"))
        assert sorted(int(r.item) for r in got.collect()) == list(range(want))


def test_personas_resume_after_a_failed_batch(spark, tmp_path):
    told = spark.range(50).select(F.col("id").cast("string").alias("user_id"), F.lit(1).alias("entries"))
    made = []

    def provider(rows):
        made.append(1)
        if len(made) == 3:
            raise RuntimeError("killed in the third batch")
        return rows.select("user_id", F.concat(F.lit("p"), "user_id").alias("persona"))

    store = stores.PersonaStore(str(tmp_path / "p"))
    with pytest.raises(Exception, match="killed"):
        store.run(told.coalesce(1), provider, batch=10)
    assert store.done(spark).count() == 20 and store.personas(spark).count() == 20
    out = store.run(told.coalesce(1), provider, batch=10)
    assert values(out, "user_id", "persona") == sorted((str(i), f"p{i}") for i in range(50)) and len(made) == 6
    # stored but not listed: made again, and the later one counts
    spark.createDataFrame([("7", "stray"), ("99", "stray")], "user_id string, persona string").write.parquet(str(tmp_path / "p/personas/batch=90"))
    more = spark.createDataFrame([("99", 1)], "user_id string, entries int")
    again = {r.user_id: r.persona for r in store.run(more, provider, batch=10).collect()}
    assert again["99"] == "p99"


def test_many_persona_batches_take_few_calls(spark, tmp_path):
    told = spark.range(400).select(F.col("id").cast("string").alias("user_id"), F.lit(1).alias("entries"))
    made = []

    def provider(rows):
        made.append(1)
        return rows.select("user_id", F.concat(F.lit("p"), "user_id").alias("persona"))

    store = stores.PersonaStore(str(tmp_path / "p"))
    assert store.run(told, provider, batch=4, most=3).count() == 12 == store.done(spark).count() and len(made) == 3
    assert values(store.run(told, provider, batch=4), "user_id", "persona") == sorted((str(i), f"p{i}") for i in range(400)) and len(made) <= 3 + 32
    # each batch is published by itself, with the ids of its users
    for kind in ("personas", "ids"):
        held = spark.read.parquet(str(tmp_path / "p" / kind)).groupBy("batch").count().collect()
        assert sorted(r.batch for r in held) == list(range(100)) and {r["count"] for r in held} == {4}
    listed = spark.read.parquet(str(tmp_path / "p/ids")).select("user_id", "batch")
    assert listed.join(spark.read.parquet(str(tmp_path / "p/personas")), ["user_id", "batch"]).count() == 400


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    store = stores.KeyStore(str(tmp_path / "s"), ["k"], 8)
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert store.upsert(rows) == 8
    stamps = lambda: {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(tmp_path / "s") for n in names if n.endswith(".parquet")}
    before = stamps()
    time.sleep(0.02)
    assert store.upsert(spark.createDataFrame([(5, "new"), (1000, "new")], "k long, v string")) <= 2
    after = stamps()
    touched = {os.path.dirname(p) for p in before if p not in after}
    assert 1 <= len(touched) <= 2 and all(after[p] == t for p, t in before.items() if os.path.dirname(p) not in touched)
    assert values(store.read(spark), "k", "v") == sorted([(i, "new" if i == 5 else "old") for i in range(200)] + [(1000, "new")])
    store.modify(spark.createDataFrame([(5,), (12345,)], "k long"), lambda held: held.withColumn("v", F.lit("changed")))
    assert store.read(spark).where("v = 'changed'").count() == 1
    assert store.upsert(rows.where("k < 0")) == 0


def test_stages_are_looked_up_from_the_most_processed_on(spark, tmp_path):
    def stages(least):
        return stores.processing_stages(lambda: spark.range(100), lambda df: df.where("id % 2 = 0"), lambda df: df.where(f"id >= {least}"), least, 99, None, 0.5)

    run = lambda least: (s := stores.StageStore(str(tmp_path / "c")), s.resolve(spark, stages(least)).count(), s.built)[1:]
    assert run(10) == (45, ["raw", "sampled", "filtered-min10-max99-maxsNone-gfrac0.5"])
    assert run(10) == (45, [])
    assert run(20) == (40, ["filtered-min20-max99-maxsNone-gfrac0.5"])  # the sampled stage is found
    # a folder without its mark is no stage
    store = stores.StageStore(str(tmp_path / "c"))
    os.remove(os.path.join(store.folder(stages(10)), "_SUCCESS"))
    assert not os.path.exists(os.path.join(store.folder(stages(10)), "_SUCCESS"))


def test_late_rows_of_playlists(spark, tmp_path):
    rows = lambda n, name: spark.createDataFrame(name, "list_id string, item string, items long, ts timestamp_ltz").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    from datetime import datetime

    at = lambda s: datetime.fromtimestamp(1_600_000_000 + s)
    schema = "list_id string, item string, items long, ts timestamp"

    def run():
        stream = playlists.completeness(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), 60, "1 day")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return values(spark.read.schema(playlists.OUT).parquet(str(tmp_path / "out")), "list_id", "items", "have", "state")

    rows(1, [("a", "x", 2, at(0)), ("a", "x", 2, at(1)), ("b", "x", 1, at(2)), ("c", "x", 3, at(3))])
    assert run() == [("b", 1, 1, "complete")]
    rows(2, [("a", "y", 2, at(5)), ("end", "e", 1, at(200_000))])
    assert run() == [("a", 2, 2, "complete"), ("b", 1, 1, "complete"), ("c", 3, 1, "incomplete"), ("end", 1, 1, "complete")]


def test_colliding_thread_ids_are_hashed_again(spark):
    df = spark.range(300).select((F.col("id") % 100).alias("k"), F.lit(1).alias("thread_no"), F.col("id").alias("t"), F.lit("own").alias("n"))
    out = threads.unique_thread_ids(df, ["k"], "t", ["t"], ["t"], digits=2)
    ids = {r.k: r.thread_id for r in out.collect()}
    assert len(set(ids.values())) == 100 == len(ids) and out.columns == [*df.columns, "thread_id"]
    plain = {r.k: r.thread_id for r in threads.unique_thread_ids(df, ["k"], "t", ["t"], ["t"]).collect()}
    assert plain == {r.k: r.thread_id for r in threads.thread_ids(df, ["k"], "t", ["t"], ["t"]).collect()}


def test_more_threads_than_ids_of_so_many_digits(spark):
    df = spark.range(900).select((F.col("id") % 300).alias("k"), F.lit(1).alias("thread_no"), F.col("id").alias("t"))
    ids = {r.k: r.thread_id for r in threads.unique_thread_ids(df, ["k"], "t", ["t"], ["t"], digits=1).collect()}
    assert len(set(ids.values())) == 300 == len(ids)
    # of those that share a digit the least head keeps it, the others' ids are longer
    assert sorted(len(x) for x in ids.values())[:17] == [len("thread_") + 1] * 16 + [len("thread_") + 2]


def test_labels_by_rank_equal_labels_by_sorting(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 11 != 0, F.floor(F.col("id") % 50 / 7)).alias("day"), F.lit("mine").alias("held"))
    cut = lambda rank, n: F.floor((rank - 1) * 7 / n)
    got = ranking.labelled(df, [F.col("day"), F.col("id") % 3], [F.col("id")], cut, "part")
    rows = sorted(df.collect(), key=lambda r: (r.day is not None, r.day or 0, r.id % 3, r.id))
    assert {r.id: r.part for r in got.collect()} == {r.id: k * 7 // 1000 for k, r in enumerate(rows)} and got.columns == [*df.columns, "part"]
    kept = splits.sample_rows(df.withColumn("rn", F.lit(0)).withColumn("n", F.lit(1)), 0.3, 5, ["id"])
    assert kept.count() == 300 and set(kept.columns) == {*df.columns, "rn", "n"} and kept.agg(F.sum("n")).first()[0] == 300


def test_gap_sessions_of_hot_keys_by_buckets(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7).alias("u"), (F.pmod(F.col("id") * 7919, F.lit(90_000))).alias("t"), "id")
    plain = threads.gap_sessions(df, 90, ["u"], "t", ["id"])
    for width in (500, 7):
        parts = threads.gap_sessions(df, 90, ["u"], "t", ["id"], F.floor(F.col("t") / width))
        assert values(parts, "id", "thread_no") == values(plain, "id", "thread_no") and parts.columns == plain.columns


def turn(role, content, name=None, reasoning=None, calls=None):
    return (role, content, name, reasoning, calls)


def test_chat_prompts_by_hand(spark):
    def shown(turns, **how):
        df = spark.createDataFrame([(turns,)], f"t array<{chat.TURN}>")
        return df.select(chat.chat_prompt(F.col("t"), **how).alias("x")).first().x

    s, e = "<|im_start|>", "<|im_end|>\n"
    assert shown([turn("system", "Be."), turn("user", " hi ", "Ann")], ask=False) == f"{s}system\nBe.{e}{s}user\n<name>Ann</name>\nhi{e}"
    assert shown([turn("user", "hi")]) == f"{s}user\n\nhi{e}{s}user\n\n"
    assert shown([turn("user", "a")], speak_as=F.lit("X"), thinking=True) == f"{s}user\n\na{e}{s}user\n<name>X</name>\n<think>"
    old = [turn("user", "q"), turn("assistant", "<think>\nold\n</think>\n\nyes", "B"), turn("user", "more"), turn("assistant", "<think>\nnew\n</think>\n\nno")]
    assert shown(old, ask=False) == f"{s}user\n\nq{e}{s}assistant\n<name>B</name>\nyes{e}{s}user\n\nmore{e}{s}assistant\n<think>\nnew\n</think>\n\nno{e}"
    assert shown([turn("user", "q"), turn("assistant", "yes")], ask=False) == f"{s}user\n\nq{e}{s}assistant\n<think>\n\n</think>\n\nyes{e}"
    tools = [turn("user", "q"), turn("assistant", "", calls=[("f", '{"k": 1}'), ("g", "{}")]), turn("tool", "1"), turn("tool", "2"), turn("user", "<tool_response>x</tool_response>"), turn("assistant", "so", reasoning="r")]
    called = f'{s}assistant\n<tool_call>\n{{"name": "f", "arguments": {{"k": 1}}}}\n</tool_call>\n<tool_call>\n{{"name": "g", "arguments": {{}}}}\n</tool_call>{e}'
    answered = f"{s}user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response>{e}"
    assert shown(tools, ask=False) == f"{s}user\n\nq{e}{called}{answered}{s}user\n\n<tool_response>x</tool_response>{e}{s}assistant\n<think>\nr\n</think>\n\nso{e}"
    told = shown([turn("system", "S"), turn("user", "q")], tools=F.array(F.lit('{"a": 1}')), ask=False)
    assert told.startswith(f'{s}system\nS\n\n# Tools\n\n') and '<tools>\n{"a": 1}\n</tools>' in told and told.endswith(f"</tool_call>{e}{s}user\n\nq{e}")


def test_nearly_json_is_read_in_linear_time_and_strictly():
    p = jsonops.parse_tolerantly
    seconds = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        assert len(json.loads(p("{'l': [" + "{'k': 1}, " * n + "]}"))["l"]) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0] and seconds[1] < 20
    assert p('{"a": 1e400}') is None and p('{"a": "1e400", "b": -1e400}') is None and json.loads(p('{"a": "1e400"}')) == {"a": "1e400"}
    assert p('{"a": ' + "[" * 50_000 + "]" * 50_000 + "}") is None and p("{") is None and p('{"a": ]}') is None


def test_empty_objects_dropped_or_null(spark):
    given = '{"a": {"b": {}}, "c": [{}, {"d": {}}, 1], "x": 1, "e": {}}'
    df = spark.createDataFrame([(given,), ("no",), (None,)], "j string")
    kept = [r[0] for r in df.select(jsonops.cleaned_json(F.col("j"), ["x"], "null")).collect()]
    assert json.loads(kept[0]) == {"a": {"b": None}, "c": [{}, {"d": None}, 1], "e": None} and kept[1:] == [None, None]
    assert json.loads(df.select(jsonops.cleaned_json(F.col("j"), ["x"])).first()[0]) == {"c": [1]}


def test_entities_as_html_reads_them(spark):
    import html

    given = ["a &amp; b", "&lt;p&gt; &eacute;&hellip;", "&notit; &not &copy2024 &ampamp;", "&#39;&#x27;&#233;&#x1F600;", "&#128; &#0; &#xD800; &#x110000; &#1; &#99999999999;", "& alone && &; &#; &#x; &zz;", "no entity", "", "&&&amp;&", "&Ouml;&ouml; &CounterClockwiseContourIntegral;", "&#65 &#x41z &amp;lt;"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*given, None])], "i int, x string").select("i", text.unescape(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in rows} == {**{i: html.unescape(x) for i, x in enumerate(given)}, len(given): None}


def test_config_files(tmp_path):
    (tmp_path / "c.json").write_text('{"least": 3, "most": 9, "mode": "post", "turns": [2, 6, 1], "row_filter": "completion <> \'\'"}')
    config = processor.read_config(str(tmp_path / "c.json"), provider=personas.fixed("p"))
    assert (config.least, config.most, config.mode, config.turns) == (3, 9, "post", (2, 6, 1)) and config.row_filter is not None
    (tmp_path / "d.json").write_text('{"leest": 3}')
    with pytest.raises(ValueError, match="leest"):
        processor.read_config(str(tmp_path / "d.json"))
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("least: 2\nunseen: 0.2\n")
    assert processor.read_config(str(tmp_path / "c.yaml")).unseen == 0.2


def test_calls_are_tried_again_and_counted(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(history):
        with open(log, "a") as out:
            out.write(f"{history}\n")
        with open(log) as seen:
            times = seen.read().split("\n").count(history)
        if history == "bad" or times < 2:
            raise RuntimeError("busy")
        return ("no" if times < 3 else f"persona of {history}"), {"usd": 1.0, "prompt_tokens": 2, "completion_tokens": 3}

    told = spark.createDataFrame([(1, "one"), (2, "bad")], "user_id int, history string").coalesce(1)
    rows = {r.user_id: r for r in personas.calling(call, lambda x: x != "no", "default", tries=4, pause=0.0)(told).collect()}
    assert (rows[1].persona, rows[1].usage.usd, rows[1].usage.completion_tokens) == ("persona of one", 2.0, 6) and (rows[2].persona, rows[2].usage.usd) == ("default", 0.0)


def test_files_are_sorted_and_states_replaced(spark, tmp_path):
    rows = spark.range(2000).select(F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.pmod(F.col("id") * 7919, F.lit(2000)).alias("timestamp"))
    writers.write_splits(rows, str(tmp_path / "w"), ["timestamp"], rows=300)
    import pyarrow.parquet as pq

    for folder, _, names in os.walk(tmp_path / "w"):
        held = [pq.ParquetFile(os.path.join(folder, n)).read(["timestamp"]).column(0).to_pylist() for n in sorted(names) if n.endswith(".parquet")]
        assert all(x == sorted(x) and len(x) <= 300 for x in held)


def test_queries_run_from_any_folder(tmp_path):
    """A new process elsewhere, without a path to the package: what tasks need is shipped."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
print("ROWS", e.queries()["tolerant_json"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 1000" in done.stdout, done.stderr[-2000:]
