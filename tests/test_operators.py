"""Operators on small hand-made rows: bounds, ties, empties and quirks."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom import storage
from threadloom.functions import jsonops, mailparse, study, text, timeparse
from threadloom.operators import activity, conversations, dedupe, history, incremental, joins, personas, splits, threads, trees
from threadloom.plans import builders
from threadloom.plans.processor import Config, process
from threadloom.schemas import INTERACTION
from threadloom.sources import readers, writers
from threadloom.streaming import stateful


def values(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_active_users_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(u,) for u, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4)) for _ in range(n)], "user_id string")
    assert values(activity.active_users(df, 2, 3), "user_id") == [("b",), ("c",)]
    assert values(activity.history_drop_stats(activity.user_counts(df), 2), "users_dropped", "rows_dropped") == [(2, 7)]
    assert values(activity.history_drop_stats(activity.user_counts(df), 0), "users_dropped", "rows_dropped") == [(0, 0)]
    assert activity.count_histogram(activity.user_counts(df)).agg(F.sum("users")).first()[0] == 4


def test_history_order_and_cut(spark):
    df = spark.createDataFrame([("u", 3, "c c"), ("u", 1, "a a a a"), ("u", 2_000_000_000_000, "z"), ("v", 1, None)], "user_id string, timestamp long, completion string")
    rows = {r.user_id: r for r in history.history_text(df, 2, ["timestamp"], words=2).collect()}
    assert rows["u"].history == "[1970-01-01 00:00:01 UTC] a a\n[1970-01-01 00:00:03 UTC] c c" and rows["u"].entries == 2
    assert values(history.later_rows(df, 2, ["timestamp"]), "user_id", "timestamp") == [("u", 2_000_000_000_000)]


def test_user_split_invariants(spark):
    df = spark.createDataFrame([(u, t, u * 100 + t) for u in range(20) for t in range(10)], "user_id int, timestamp int, id int")
    out = splits.split_by_user(df, 0.2, 0.25, 0.1, 1, ["timestamp"], ["id"])
    rows = out.collect()
    assert len(rows) == 200 and len({r.id for r in rows}) == 200
    unseen = {r.user_id for r in rows if r.split == "unseen_test"}
    assert len(unseen) == 4 and all(r.split == "unseen_test" for r in rows if r.user_id in unseen)
    # round(10 * 0.25) is 2: half to even
    assert all(r.timestamp >= 8 for r in rows if r.split == "seen_test")
    assert sum(r.split == "val" for r in rows) == 128 - round(128 * 0.9)


def test_post_split_is_monotone_and_keeps_train_users(spark):
    df = spark.createDataFrame([(p, p % 3, p * 10_000 + i) for p in range(20) for i in range(2)], "post_id int, user_id int, timestamp int")
    out = splits.split_by_post_time(df, 0.1, 0.1)
    ends = {r.split: (r["first"], r["last"], r["rows"]) for r in splits.time_ranges(out).collect()}
    assert ends["train"][1] < ends["val"][0] <= ends["val"][1] < ends["test"][0] and ends["train"][2] == 32
    extra = out.unionByName(spark.createDataFrame([(99, 99, 5, "test")], "post_id int, user_id int, timestamp int, split string"))
    assert 99 not in [r.user_id for r in splits.train_users_only(extra).collect()]


def test_turn_split_gives_the_tail_to_both_tests(spark):
    df = spark.createDataFrame([(1, t) for t in (2, 4, 6, 8, 10)] + [(2, 2)], "post_id int, turn_id int")
    out = values(splits.split_by_turn(df, 2, 10, 0.1, 0.1, 1), "post_id", "turn_id", "split")
    assert out == [(1, 2, "train"), (1, 4, "train"), (1, 6, "val"), (1, 8, "seen_test"), (1, 8, "unseen_test"), (1, 10, "seen_test"), (1, 10, "unseen_test")]
    assert splits.badly_numbered(df).count() == 0
    assert splits.badly_numbered(df.where("turn_id <> 4")).count() == 1


def test_samples_are_exact_and_empty_tables_stay_empty(spark):
    df = spark.range(101)
    assert splits.sample_rows(df, 0.5, 3, ["id"]).count() == 50
    assert splits.sample_rows(df.where("id < 0"), 0.5, 3, ["id"]).count() == 0
    assert sorted(r["count"] for r in splits.chunks(df, 4, F.floor(F.col("id") / 10), [F.col("id")]).groupBy("chunk").count().collect()) == [25, 25, 25, 26]


def test_conversation_operators(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = conversations.examples(df).collect()
    assert [(r.turn_id, [p.content for p in r.prompt], r.completion) for r in found] == [(2, ["a", "b"], "c")]
    assert values(conversations.take_while_good(df, F.col("text") == "b"), "conv_id", "turn") == [(1, 0), (1, 1), (2, 0)]
    assert values(conversations.without_first(df, F.col("role") != "assistant"), "conv_id", "turn") == [(1, 1), (1, 2), (1, 3)]
    carried = conversations.carried_last(df, F.col("text"), F.col("role") == "assistant", "last").where("conv_id = 1")
    assert values(carried.where("turn = 3"), "last") == [("b",)]


def test_two_keys_as_a_sequence_of_rows(spark):
    # 2 falls to 1 by id, so its content does not count; 4 repeats nothing that stayed; 5 falls to 3 by content
    df = spark.createDataFrame([(1, "m1", "x"), (2, "m1", "y"), (3, "", "z"), (4, None, "y"), (5, "m5", "z")], "seq int, mid string, body string")
    assert values(dedupe.two_keys(df, F.col("mid"), F.md5("body"), ["seq"]), "seq") == [(1,), (3,), (4,)]


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n"), (3, "n")], "k int, v string")
    assert values(dedupe.upsert_last(old, new.distinct(), ["k"]), "k", "v") == [(1, "o"), (2, "n"), (3, "n")]
    assert values(dedupe.append_new(old, new, ["k"]), "k") == [(3,), (3,)]
    assert values(joins.last_item_wins(old, spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, seq int, item string"), ["k"], ["seq"]), "k", "item") == [(1, "b")]


def test_gaps_of_exactly_the_limit_do_not_split(spark):
    week = threads.WEEK
    df = spark.createDataFrame([("u", 0, 1), ("u", week, 2), ("u", 2 * week + 1, 3)], "user_id string, timestamp long, id int")
    assert values(threads.gap_sessions(df, week, ["user_id"], "timestamp", ["id"]), "id", "thread_no") == [(1, 1), (2, 1), (3, 2)]


def test_replies(spark):
    rows = [(1, "a", "first body", 0), (1, "b", "too short", 1), (1, "c", "long enough", 2), (1, "d", "long enough ", 3), (2, "e", "alone in it", 0)]
    df = spark.createDataFrame(rows, "thread_id int, user_id string, body string, timestamp int")
    found = threads.reply_examples(df, ["timestamp"]).collect()
    assert [(r.user_id, [p.content for p in r.prompt]) for r in found] == [("c", ["first body", "too short"])]


def test_trees_prune_and_end_on_cycles(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("b", "d"), ("x", "y")], "node_id string, parent_id string")
    assert sorted((r.node_id, r.depth) for r in trees.flatten(df).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert sorted(r.node_id for r in trees.flatten(df, F.col("node_id") != "c").collect()) == ["a", "b"]
    tops = spark.createDataFrame([("t", "x", [("r", "y")]), ("u", "z", [])], "id string, text string, replies array<struct<id:string,text:string>>")
    assert values(trees.tops_and_replies(tops), "id", "upper_comments") == [("r", ["t"]), ("t", []), ("u", [])]


def line_machine(x):
    out, run = [], False
    for line in x.split("\n"):
        if line.lstrip().startswith(">"):
            if not run:
                out.append(line.strip())
            run = True
        else:
            if run:
                out.append("[...quoted text...]")
            run = False
            out.append(line)
    return "\n".join(out)


@pytest.mark.parametrize("x", ["> a\n> b\nc", "x\n> a", "> a\n\n>b\n>c\nd", "a\n> b\nc\n> d\n> e", "", "plain"])
def test_quotes(spark, x):
    got = spark.createDataFrame([(x,)], "x string").select(text.collapse_quotes(F.col("x"))).first()[0]
    assert got == line_machine(x)


def test_text_functions(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(text.word_truncate(F.lit(" a  b c "), 2)) == "a b" and one(text.word_truncate(F.lit(" a  b "), 2)) == " a  b "
    assert one(text.clean_text(F.lit("a &amp;lt; ```b```\n"))) == "a &lt; b"
    assert one(text.strip_prefix_letters(F.lit("r/relationships"))) == "elationships"
    assert one(text.normalize_subject(F.lit("RE: a rE: Fw: b"))) == "a rE: b" and one(text.normalize_subject(F.lit(None).cast("string"))) == "(no subject)"
    assert one(text.email_field(F.lit('"A B" <a.b@x.org>]'))) == "a.b@x.org" and one(text.email_field(F.lit("<Ann>"))) == "Ann"
    assert one(text.response_of(F.lit("x</think><response> y </response>z"))) == "y" and one(text.response_of(F.lit("</think> "), "none")) == "none"
    assert one(text.md5_share(F.lit("abc"))) == 0.357
    assert one(text.fenced_json(F.lit('a\n```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(text.sanitize_name(F.lit("--a b/ü--"))) == "a-b"
    assert one(timeparse.months(F.lit("2-4"))) == [2, 3, 4] and one(timeparse.months(F.lit("1,2 13"))) == [1, 2] and one(timeparse.months(F.lit("x"))) == [1]
    assert one(timeparse.mail_epoch(F.lit("Thu, 1 Jan 1970 02:00:00 +0200 (EET)"))) == 0 and one(timeparse.mail_epoch(F.lit("bad"))) is None
    assert one(timeparse.article_epoch(F.lit("nonsense"))) == 0
    assert one(F.size(text.dropped_fields(["a", "b", "c"], F.lit("id"), 1, 0.99, 2))) == 2


def test_persona_checks(spark):
    good = {"demographics": dict.fromkeys(("age group", "gender", "location", "occupation", "nationality", "other"), "x"), **{k: ["y"] for k in ("interests", "values", "communication", "statistics")}}
    cases = [good, {**good, "more": 1}, {k: v for k, v in good.items() if k != "values"}, {**good, "values": []}, {**good, "demographics": {"gender": "x"}}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases], "p string")
    assert [r[0] for r in df.select(jsonops.persona_is_valid(F.col("p"))).collect()] == [True, False, False, False, False]
    assert jsonops.parse_tolerantly("say {'a': 1, 'b': true,} ok") == '{"a": 1, "b": true}'
    assert jsonops.parse_tolerantly('{"a": """x\ny"""}') == '{"a": "x\\ny"}' and jsonops.parse_tolerantly("nothing") is None
    near = spark.createDataFrame([('{"a": "1"}',), ("{'a': '2'}",), ("no",), (None,)], "x string").select(jsonops.read_object(F.col("x")).alias("y"))
    assert [r.y for r in near.collect()] == ['{"a": 1}', '{"a": 2}', None, None]


MAIL = """Message-ID: <1@x>
Date: Tue, 2 Jan 2001 10:00:00 -0000
From: Bob <bob@x.org>
To: ann@x.org
Subject: Re: plan

Fine with me.

-----Original Message-----
From: ann@x.org
Date: Mon, 1 Jan 2001 09:00:00 -0000
Subject: plan

Shall we?
"""


def test_mail(spark):
    found = spark.createDataFrame([(MAIL,), ("From: a@b.co\nX-Y: 1\n\nplain",), (None,)], "m string").select(mailparse.parsed_mail("m").alias("p")).collect()
    first = found[0].p
    assert [(m.headers["from"], m.body, m.is_reply, m.depth, m.email_index) for m in first] == [("ann@x.org", "Shall we?", False, 1, 0), ("bob@x.org", "Fine with me.", True, 0, 1)]  # its subject is a reply's
    assert [m.body for m in found[1].p] == ["plain"] and found[2].p is None
    forward = mailparse.messages_of('From: a@b.co\n\nsee\n---------- Forwarded by A B\n"Cy" <c@d.co> on 3 Jan 2001 10:00:00\n\ninner')
    assert [(m["headers"].get("from"), m["body"], m["is_forwarded"]) for m in forward] == [("a@b.co", "see", True), ("c@d.co", "inner", False)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('file,message\na,"line ""1""\nline 2"\nb,x\n')
    assert values(readers.mail_csv(spark, str(tmp_path / "m.csv")), "file", "message") == [("a", 'line "1"\nline 2'), ("b", "x")]
    (tmp_path / "t.txt").write_text("v1\nsome text\n--------\nv2\nNot available.\n--------\n")
    cached = readers.transcripts(spark, str(tmp_path / "t.txt"))
    assert values(cached, "video_id", "video_transcript") == [("v1", "some text"), ("v2", "Not available.")] and readers.bad_transcripts(cached).count() == 1
    (tmp_path / "p.jsonl").write_text('{"post_id": "1"}\n\nnot json\n{"post_id": "2"}\n')
    assert readers.json_lines(spark, str(tmp_path / "p.jsonl"), INTERACTION).count() == 2
    assert readers.selected(["abc", "abd"], ["ab", "abc"]) == ["abc", "abd", "abc"]
    with pytest.raises(ValueError):
        readers.selected(["abc"], ["b"])
    df = spark.createDataFrame([("train", 2), ("train", 1), ("val", 3)], "split string, id int")
    writers.write_splits(df, str(tmp_path / "out"), ["id"])
    assert values(spark.read.parquet(str(tmp_path / "out")), "split", "id") == [("train", 1), ("train", 2), ("val", 3)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_splits(df, str(tmp_path / "out"), ["id"])
    assert writers.empty_like(df).schema == df.schema and writers.empty_like(df).count() == 0
    assert writers.fingerprint({"b": 1, "a": 2}) == writers.fingerprint({"a": 2, "b": 1}) != writers.fingerprint({"a": 1})


@pytest.mark.parametrize("mode", ["user", "post", "turn"])
def test_processor(spark, mode):
    rows = [([("post", "p", None)] * (2 * (i + 1)), f"answer {i}", f"p{u % 2}", f"u{u}", 1000 * u + i, None) for u in range(6) for i in range(5)]
    df = spark.createDataFrame(rows, INTERACTION)
    config = Config(least=2, most=10, history=1, mode=mode, unseen=0.2, seen=0.2, val=0.2)
    out = process(df, config).collect()
    assert out and all(r.metadata == "{}" and r.prompt[0].metadata == "{}" and r.turn_id == len(r.prompt) for r in out)
    if mode == "user":
        assert len(out) == 30
    with pytest.raises(ValueError):
        Config(val=0.6, seen=0.5)
    with pytest.raises(ValueError):
        Config(least=3, history=3, drop_history=True)


def test_personas(spark):
    told = spark.createDataFrame([("a", 1, "x y")], "user_id string, entries long, history string")
    assert json.loads(personas.from_statistics(told).first().persona) == {"statistics": ["entries: 1", "words: 2"]}
    assert personas.pending(told, personas.fixed("p")(told)).count() == 0


def test_streams_match_batches(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def drained(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert drained(stateful.new_only(stream(), ["k"], "t"), "fresh", "append").count() == 2
    assert drained(stateful.windowed_counts(stream(), "t", "1 hour"), "hours", "complete").count() == 2
    sessions = drained(stateful.sessions(stream(), ["k"], "t", "30 minutes"), "threads", "complete")
    assert values(sessions, "k", "rows") == [("a", 1), ("a", 2), ("b", 2)]
    for n in (1, 2):
        stateful.append_if_new(stream(), str(tmp_path / "target"), ["k", "t"], str(tmp_path / f"c{n}")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "target")).count() == 4


def test_study_and_incremental(spark, tmp_path):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(study.fallback_persona(F.lit("30"), F.lit(""), F.lit("cook"))) == "A person: 30, cook." and one(study.fallback_persona(*[F.lit("")] * 3)) == "A person."
    assert one(study.problems({"feedback": F.lit("too short")}, [F.lit(11)], [F.lit("1st x"), F.lit("1st y")])) == ["feedback", "score_0", "ranks"]
    assert one(study.problems({"feedback": F.lit("w " * 10)}, [F.lit(10)], [F.lit("1st"), F.lit("2nd")])) == []
    assert one(study.in_order(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.array(F.lit("b"), F.lit("a")))) == [2, 1]
    assert one(study.has_comments(F.lit(None).cast("int"), F.array(F.lit(1)))) and not one(study.has_comments(F.lit(0), F.array(F.lit(1))))
    built = []
    for _ in range(2):
        assert incremental.cached(spark, str(tmp_path / "stage"), lambda: built.append(1) or spark.range(3)).count() == 3
    assert built == [1]
    mails = spark.createDataFrame([(MAIL,), ("From: a@b.co\n\nx",)], "m string").select(mailparse.parsed_mail("m").alias("messages"))
    assert tuple(incremental.parse_stats(mails).first()) == (2, 1, 1, 1)
    assert jsonops.without_empty({"a": {"b": {}}, "c": [{}, 1], "d": 0}, frozenset("d")) == {"c": [1]}


def test_trees_of_any_depth_and_width(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(1500)]
    star = [(f"s{i}", "s0" if i else None) for i in range(20_000)]
    cycle = [("a", None), ("b", "a"), ("b", "d"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("o", "missing")]
    df = spark.createDataFrame([*chain, *star, *cycle], "node_id string, parent_id string")
    rows = {r.node_id: r for r in trees.flatten(df).where("node_id NOT LIKE 's%'").collect()}
    assert rows["1499"].depth == 1499 and rows["1499"].path == [str(i) for i in range(1500)]
    assert {k: rows[k].path for k in "abcd"} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "c", "d"]}
    assert not {"x", "y", "o"} & set(rows) and trees.flatten(df).where("depth = 1 AND node_id LIKE 's%'").count() == 19_999
    assert trees.flatten(df.where("node_id = 'q'")).count() == 0


def test_mail_heads_and_dates():
    head, used = mailparse.headers_of("Received: by x\n\tfor y\nReturn-Path: z\nFrom: Some One <a@b.co>\nfolded line\n> To: quoted\nTo: <d@e.fr>\nX-Any: 1\n\nbody".split("\n"))
    assert head == {"received": "by x", "return-path": "z", "from": "a@b.co", "to": "d@e.fr", "x-any": "1"} and used == 9
    assert mailparse.headers_of(["Dear all:", "From: x"]) == ({}, 0) and mailparse.headers_of(["only words"]) == ({}, 0)
    assert mailparse.headers_of(["From: a@b.co", "Note: body begins"]) == ({"from": "a@b.co"}, 1)
    assert mailparse.seconds_of("Monday, January 1, 2001 9:59 AM") == 978343140 and mailparse.seconds_of("01/02/2001 03:04 PM") == 978447840
    assert mailparse.seconds_of("Mon, 14 May 2001 16:39:00 -0700 (PDT)") == 989883540 and mailparse.seconds_of("soon") is None
    mails = [{"headers": {"date": "Mon, 14 May 2001 16:39:00 +0000"}, "is_original": True, "depth": 0, "body": "new"}, {"headers": {"sent": "02/16/2001 07:24:59 AM"}, "is_original": False, "depth": 1, "body": "old"}, {"headers": {}, "is_original": False, "depth": 2, "body": "undated"}]
    assert [m["body"] for m in mailparse.oldest_first(mails)] == ["undated", "new", "old"]


def test_quoted_mails_without_a_mark():
    said = mailparse.messages_of
    bob = "From: Bob Smith [mailto:bob@x.org]\nSent: Monday, January 1, 2001 9:59 AM\nTo: a@b.co\nSubject: plan\n\nolder"
    first, second = said(f"From: a@b.co\nSubject: Re: plan\n\nnewer\nwords\n\n{bob}")
    assert (first["body"], first["is_reply"], first["is_original"]) == ("newer\nwords", True, False)
    assert second["headers"] == {"from": "bob@x.org", "sent": "Monday, January 1, 2001 9:59 AM", "to": "a@b.co", "subject": "plan"} and (second["body"], second["is_original"]) == ("older", True)
    # nested and repeated blocks, quoted ones too
    deep = said(f"From: a@b.co\n\nthird\n{bob}\n\n> From: Cy <cy@x.org>\n> Date: Mon, 1 Jan 2001 08:00:00 +0000\n>\n> oldest\n> words")
    assert [m["body"] for m in deep] == ["third", "older", "oldest\nwords"] and [m["headers"]["from"] for m in deep] == ["a@b.co", "bob@x.org", "cy@x.org"]
    again = said("From: a@b.co\n\n0" + "".join(f"\n\nFrom: u{i}@x.org\nTo: v\n\n{i}" for i in range(1, 5)))
    assert [m["body"] for m in again] == list("01234") and [m["depth"] for m in again] == list(range(5))
    # folded lines of a head; prose that only begins like one
    assert said("From: a@b.co\n\nx\nFrom: Bob\n <bob@x.org>\nTo: c@d.co;\n\te@f.gh\nbody")[1]["body"] == "body"
    assert len(said("From: a@b.co\n\nFrom: the start of it all\nwe went on.")) == 1
    # a quoted end without a head takes its reply's fields, turned round
    quoted = said("From: a@b.co\nTo: d@e.fr\nSubject: RE: plan\n\nyes\n\n> shall we?\n>\n> today?")[1]
    assert quoted["headers"] == {"from": "d@e.fr", "to": "a@b.co", "subject": "plan"} and quoted["body"] == "shall we?\n\ntoday?"
    assert said("From: a@b.co\nSubject: Re: x\n\nno quote")[0]["is_reply"] is False and said("From: a@b.co\nSubject: Re: x\n\nsee > here")[0]["is_reply"] is True
    # the lines below a sender's own line are its head
    named = said('From: a@b.co\nSubject: FW: x\n\nsee\n----- Forwarded by A -----\n"Bob" <bob@y.org> on 01/02/2001 03:04:05 PM\nTo: c@d.co\ncc: Di <di@d.co>\nSubject: x\n\ninner')
    assert named[1]["headers"] == {"from": "bob@y.org", "date": "01/02/2001 03:04:05 PM", "to": "c@d.co", "cc": "di@d.co", "subject": "x"} and named[1]["body"] == "inner" and named[0]["is_forwarded"]


def test_mails_of_any_date_are_kept(spark):
    files = spark.createDataFrame([("f", f"Message-ID: <{i}>\nFrom: u@x.org\nDate: {d}\n\nlong enough words {i}") for i, d in enumerate(["1 Jan 2001 00:00:00 GMT", "Mon, 01 Jan 01 00:00:01 EST", "2001-01-01 00:00:02", "no date"])], "file string, message string")
    got = {r.message_id: r.timestamp for r in builders.flat_mail(files).collect()}
    assert got == {"<0>": 978307200, "<1>": 978307201 + 5 * 3600, "<2>": 978307202, "<3>": None}


def test_nearly_json_of_many_kinds():
    p = jsonops.parse_tolerantly
    assert p('{"a": "5", "b": "x\ny", \'c\': \'it\\\'s\', "d": [1, 2,], "e": {"f": """q"q"""}, "g": TRUE, "h": "null", "i": "1e3"}') == json.dumps({"a": 5, "b": "x\ny", "c": "it's", "d": [1, 2], "e": {"f": 'q"q'}, "g": True, "h": None, "i": 1000.0})
    assert [p(x) for x in ("{a: 1}", '{"a" 1}', '{"a": [}]}', '{"a": tru}', '{"a": 1, , }', "[1]", "")] == [None] * 7
    assert p("{}") == "{}" and p('so {"a": []} it is') == '{"a": []}'


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(readers, "MOST_PATTERNS", 2)
    names = spark.createDataFrame([("x",)], "name string")
    assert readers.select_sources(names, spark.createDataFrame([("x",), ("y",)], "pattern string")).count() == 1
    with pytest.raises(ValueError, match="patterns"):
        readers.select_sources(names, spark.createDataFrame([("x",), ("y",), ("z",)], "pattern string"))


def test_shared_folder_or_an_error():
    class Context:
        master, getCheckpointDir = "spark://host:7077", lambda self: None

    class Conf:
        get = lambda self, key, default=None: default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(Session())
