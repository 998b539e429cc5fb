"""Builders on small raw rows, with the odd cases of each source."""

import json

from pyspark.sql import functions as F

from threadloom.plans import builders

TURN = "struct<role:string,content:string,hashed_ip:string,state:string,country:string,language:string,redacted:boolean,toxic:boolean,turn_identifier:int,timestamp:timestamp>"


def test_chat(spark):
    def turn(role, content, language="English", ip=None, at=None):
        return (role, content, ip, None, "X", language, None, False, 1, at)

    from datetime import datetime

    rows = [
        ("h1", "m", datetime(2024, 1, 1), "top", [turn("user", "a"), turn("assistant", "b", at=datetime(2024, 1, 2)), turn("user", "c", ip="ip"), turn("assistant", "d"), turn("user", "e"), turn("user", "  "), turn("user", "f")]),
        ("h2", "m", datetime(2024, 1, 1), None, [turn("user", "x", "French"), turn("assistant", "y"), turn("user", "z")]),
        ("h3", "m", None, "", [turn("user", "only")]),
    ]
    df = spark.createDataFrame(rows, f"conversation_hash string, model string, timestamp timestamp, hashed_ip string, conversation array<{TURN}>")
    out = sorted(builders.chat(df).collect(), key=lambda r: len(r.prompt))
    assert [(r.completion, [p.content for p in r.prompt], [p.role for p in r.prompt], r.user_id) for r in out] == [
        ("c", ["a", "b"], ["unknown_user", "m"], "ip"), ("e", ["a", "b", "c", "d"], ["unknown_user", "m", "ip", "m"], "ip"),
    ]
    day = 86400
    first = 1704067200
    assert [r.timestamp for r in out] == [first + day, first]  # the later assistant turn has no time of its own
    assert json.loads(out[0].metadata) == {"conversation_hash": "h1", "language": "English", "country": "X", "redacted": False, "toxic": False, "turn_identifier": 1}


def test_book(spark):
    reviews = spark.createDataFrame([("t", "x", "p1", "u", 5), ("t2", "y", "gone", "u", 6)], "title string, text string, parent_asin string, user_id string, timestamp long")
    items = spark.createDataFrame([("p1", "old", ["d"], "s", 1), ("p1", "new", ["d", "e"], "s", 2)], "parent_asin string, title string, description array<string>, store string, seq int")
    rows = builders.book(reviews, items, "seq").collect()
    assert [(r.prompt[0].role, r.prompt[0].content, r.completion, r.post_id) for r in rows] == [("s", "new: d e", "t: x", "p1")]
    assert "seq" not in json.loads(rows[0].prompt[0].metadata)


def test_news(spark):
    comments = spark.createDataFrame([("c1", "u1", "v1", 9, "reply", [("u0", "top")]), ("c2", "u2", "v2", 8, "plain", []), ("c3", "u3", "no video", 1, "x", [])], "id string, user_id string, video_id string, timestamp long, text string, upper_comments array<struct<user_id:string,text:string>>")
    videos = spark.createDataFrame([("v1", "T1", "D1"), ("v2", "T2", "D2")], "video_id string, title string, description string")
    transcripts = spark.createDataFrame([("v1", " ".join(["w"] * 2049))], "video_id string, video_transcript string")
    rows = {r.post_id: r for r in builders.news(comments, videos, transcripts).collect()}
    assert set(rows) == {"v1", "v2"} and [p.role for p in rows["v1"].prompt] == ["T1", "u0"]
    assert len(json.loads(rows["v1"].prompt[0].metadata)["transcript"].split()) == 2048 and json.loads(rows["v2"].prompt[0].metadata)["transcript"] == "Not available."


def test_opinion(spark):
    posts = spark.createDataFrame([("p", "Title", "body &gt; x", None, True, "r/relationships")], "id string, title string, selftext string, author string, is_self boolean, subreddit string")
    comments = spark.createDataFrame(
        [("a", None, "p", "A", "one", 1.0), ("b", "a", "p", None, "two", 2.0), ("c", "b", "p", "C", "three", 3.0), ("d", None, "p", "D", "[Removed]", 4.0), ("e", "d", "p", "E", "lost", 5.0)],
        "comment_id string, parent_id string, post_id string, author string, body string, created_utc double",
    )
    rows = {r.completion: r for r in builders.opinion(posts, comments).collect()}
    assert set(rows) == {"one", "two", "three"} and rows["two"].user_id == "NA"
    assert [p.content for p in rows["three"].prompt] == ["Title\n\nbody > x", "one", "two"] and [p.role for p in rows["three"].prompt] == ["poster", "A", "NA"]


def test_politics(spark):
    kind = "id string, author string, content string, responses array<string>"
    articles = spark.createDataFrame([("x", "w", "article", ["r1"], "2020-01-01 00:00:00")], kind + ", published_at string")
    responses = spark.createDataFrame([("r1", "a", "first", ["r2"]), ("r2", "b", "second", ["r1"]), ("r3", "c", "stray", [])], kind)
    rows = {r.post_id: r for r in builders.politics(articles, responses).collect()}
    assert set(rows) == {"r1", "r2"} and [p.content for p in rows["r2"].prompt] == ["article", "first"] and rows["r2"].timestamp == 1577836800


def test_email(spark):
    def mail(sender, day, body, mid, hour=10):
        return f"Message-ID: <{mid}>\nDate: {day} Jan 2001 {hour}:00:00 +0000\nFrom: {sender}@x.org\nSubject: Re: s\n\n{body}\n"

    rows = [(None, mail("A", 1, "the first mail", 1)), (None, mail("b", 2, "an answer to it", 2)), (None, mail("b", 2, "an answer to it", 2)), (None, mail("b", 2, "an answer to it", 3)), (None, mail("c", 20, "a new thread now", 4)), (None, mail("d", 21, "short", 5)), (None, "no mail")]
    df = spark.createDataFrame(rows, "file string, message string").coalesce(1)
    out = builders.email(df).collect()
    assert [(r.user_id, [p.role for p in r.prompt], r.completion) for r in out] == [("b@x.org", ["a@x.org"], "an answer to it")]
    assert json.loads(out[0].metadata)["message_id"] == "<2>" and len(json.loads(out[0].metadata)) == 14  # no file
    assert builders.email(df.where(F.lit(False))).count() == 0
