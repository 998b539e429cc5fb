"""Queries of the builders, of sinks read back by their readers, and of functions over made-up fields, with their DuckDB twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from threadloom.functions import jsonops, mailparse, study, text, timeparse
from threadloom.operators import history, incremental, trees
from threadloom.plans import builders
from threadloom.plans.catalog import query
from threadloom.schemas import DEMOGRAPHICS, INTERACTION, PERSONA, PERSONA_LISTS, SUBMISSION
from threadloom.sources import adapters, readers, writers
from threadloom.sources.adapters import EVENTS_SQL, table
from threadloom.storage import fresh_path, stored
from threadloom.streaming import stateful

def _shown():
    return F.array_join(F.transform("prompt", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("shown")


def _id(mark, c):
    return F.concat(F.lit(mark), F.col(c).cast("string"))


def _placed(spark, d):
    """Events with their place k in groups of 50: the group's first is a post, 1 to 4 hang from it, k from k // 5 else."""
    k = F.col("event_id") % 50
    base = F.col("event_id") - k
    return adapters.events(spark, d).select("*", k.cast("int").alias("k"), base.alias("base"), (base + F.floor(k / 5)).alias("above_id"))


_PLACED = f"{EVENTS_SQL}, g AS (SELECT *, event_id % 50 AS k, event_id - event_id % 50 AS base, event_id - event_id % 50 + (event_id % 50) // 5 AS above_id FROM e)"


# ---------------------------------------------------------------- builders


@query(f"""WITH RECURSIVE {_PLACED}, c AS (SELECT * FROM g WHERE k > 0 AND event_id % 13 <> 0 AND base IN (SELECT event_id FROM g WHERE k = 0)),
w AS (SELECT event_id, 'u' || user_id || ':' || event_type || ' & ' || k AS own, '' AS above FROM c WHERE k < 5
  UNION ALL SELECT c.event_id, 'u' || c.user_id || ':' || c.event_type || ' & ' || c.k, w.above || '|' || w.own FROM w JOIN c ON c.k >= 5 AND c.above_id = w.event_id)
SELECT 'u' || p.user_id || ':T ' || p.event_type || CASE WHEN p.event_id % 100 = 0 THEN chr(10) || chr(10) || 'body' || chr(10) || '> quoted' || chr(10) || '[...quoted text...]' || chr(10) || 'é end' ELSE '' END || w.above AS shown,
  c.event_type || ' & ' || c.k AS completion, 'p' || c.base AS post_id, 'u' || c.user_id AS user_id, c.timestamp, 'c' || c.event_id AS comment_id
FROM w JOIN c USING (event_id) JOIN g p ON p.event_id = c.base""")
def opinion_rows(spark, d):
    g = _placed(spark, d)
    body = F.when(F.col("event_id") % 100 == 0, "body\n> quoted\n\t> more\n&eacute; end").otherwise("")
    posts = g.where("k = 0").select(_id("p", "event_id").alias("id"), F.concat(F.lit("T "), "event_type").alias("title"), body.alias("selftext"), _id("u", "user_id").alias("author"), F.lit(True).alias("is_self"), F.lit("s").alias("subreddit"))
    said = F.when(F.col("event_id") % 13 == 0, "[deleted]").otherwise(F.concat("event_type", F.lit(" &amp; "), F.col("k").cast("string")))
    comments = g.where("k > 0").select(_id("c", "event_id").alias("comment_id"), F.when(F.col("k") >= 5, _id("c", "above_id")).alias("parent_id"), _id("p", "base").alias("post_id"), _id("u", "user_id").alias("author"), said.alias("body"), F.col("timestamp").alias("created_utc"))
    return builders.opinion(posts, comments).select(_shown(), "completion", "post_id", "user_id", "timestamp", F.get_json_object("metadata", "$.comment_id").alias("comment_id"))


@query(f"""WITH RECURSIVE {_PLACED}, w AS (SELECT event_id, k, 'u' || user_id || ':' || event_type || k AS own, '' AS above, event_id AS article, timestamp FROM g WHERE k = 0
  UNION ALL SELECT c.event_id, c.k, 'u' || c.user_id || ':' || c.event_type || c.k, CASE WHEN w.above = '' THEN w.own ELSE w.above || '|' || w.own END, w.article, w.timestamp
  FROM w JOIN g c ON (c.k BETWEEN 1 AND 4 AND w.k = 0 AND c.base = w.event_id) OR (c.k >= 5 AND c.above_id = w.event_id))
SELECT w.above AS shown, g.event_type || g.k AS completion, 'a' || event_id AS post_id, 'u' || user_id AS user_id, w.timestamp FROM w JOIN g USING (event_id) WHERE w.k > 0""")
def politics_rows(spark, d):
    g = _placed(spark, d)
    children = g.where("k > 0").select(F.when(F.col("k") < 5, F.col("base")).otherwise(F.col("above_id")).alias("up"), _id("a", "event_id").alias("child")).groupBy("up").agg(F.array_sort(F.collect_list("child")).alias("responses"))
    all_ = g.join(children, g["event_id"] == children["up"], "left").select("k", _id("a", "event_id").alias("id"), _id("u", "user_id").alias("author"), F.concat("event_type", F.col("k").cast("string")).alias("content"), F.coalesce("responses", F.array().cast("array<string>")).alias("responses"), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("published_at"))
    return builders.politics(all_.where("k = 0").drop("k"), all_.where("k > 0").drop("k", "published_at")).select(_shown(), "completion", "post_id", "user_id", "timestamp")


@query("""WITH t AS (SELECT *, min(CASE WHEN length(text) % 11 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations),
g AS (SELECT *, CASE WHEN role = 'assistant' THEN 'm' ELSE 'ip' || conv_id END || ':' || text AS own FROM t WHERE stop IS NULL OR turn < stop),
w AS (SELECT *, string_agg(own, '|' ORDER BY turn) OVER b AS shown, count(*) FILTER (role <> 'assistant') OVER b AS people, max(CASE WHEN role = 'assistant' THEN turn END) OVER b AS answered
  FROM g WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT shown, text AS completion, 'h' || conv_id AS post_id, 'ip' || conv_id AS user_id, (1600000000 + coalesce(answered, 0) * 60)::BIGINT AS timestamp FROM w WHERE role <> 'assistant' AND people > 0""")
def chat_rows(spark, d):
    turns = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("turn") * 60)
    one = F.struct(
        "turn", F.when(F.length("text") % 11 == 0, "French").otherwise("English").alias("language"), F.col("text").alias("content"), "role", _id("ip", "conv_id").alias("hashed_ip"), F.lit("s").alias("state"), F.lit("c").alias("country"),
        F.lit(False).alias("redacted"), F.lit(None).cast("boolean").alias("toxic"), F.col("turn").alias("turn_identifier"), at.alias("timestamp"),
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("conversation"))
    convs = convs.select("conversation", _id("h", "conv_id").alias("conversation_hash"), F.lit("m").alias("model"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("timestamp"), _id("ip", "conv_id").alias("hashed_ip"))
    return builders.chat(convs).select(_shown(), "completion", "post_id", "user_id", "timestamp")


@query("""SELECT 's' || p_size || ':' || p_name || ' v2: ' || p_type || ' ' || p_brand AS shown, l_returnflag || ': ' || l_linestatus AS completion, 'b' || l_partkey AS post_id, 'u' || l_suppkey AS user_id,
  floor(epoch(l_shipdate))::BIGINT AS timestamp, l_linenumber::INT AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 7 <> 0""")
def book_rows(spark, d):
    part = table(spark, d, "part").where("p_partkey % 7 <> 0")
    items = lambda v: part.select(_id("b", "p_partkey").alias("parent_asin"), _id("s", "p_size").alias("store"), F.concat("p_name", F.lit(f" v{v}")).alias("title"), F.array("p_type", "p_brand").alias("description"), F.lit(v).alias("seq"))
    lines = table(spark, d, "lineitem").select(_id("b", "l_partkey").alias("parent_asin"), _id("u", "l_suppkey").alias("user_id"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("text"), adapters.seconds("l_shipdate").alias("timestamp"), "l_linenumber")
    return builders.book(lines, items(1).unionByName(items(2)), "seq").select(_shown(), "completion", "post_id", "user_id", "timestamp", F.get_json_object("metadata", "$.l_linenumber").cast("int").alias("line"))


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'one two' ELSE 'Not available.' END AS transcript FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT title || ':about ' || id || CASE WHEN event_id % 2 = 0 THEN '|x:above' ELSE '' END AS shown, event_type AS completion, 'v' || id AS post_id, 'u' || user_id AS user_id, timestamp, transcript
FROM e JOIN v ON id = event_id % 10""")
def news_rows(spark, d):
    videos = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(_id("v", "s_suppkey").alias("video_id"), F.col("s_name").alias("title"), F.concat(F.lit("about "), F.col("s_suppkey").cast("string")).alias("description"))
    transcripts = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(_id("v", "s_suppkey").alias("video_id"), F.lit("one two").alias("video_transcript"))
    above = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("x").alias("user_id"), F.lit("above").alias("text")))).otherwise(F.array().cast("array<struct<user_id:string,text:string>>"))
    comments = adapters.events(spark, d).select(F.concat(F.lit("v"), (F.col("event_id") % 10).cast("string")).alias("video_id"), _id("c", "event_id").alias("id"), _id("u", "user_id").alias("user_id"), "timestamp", F.col("event_type").alias("text"), above.alias("upper_comments"))
    out = builders.news(comments, videos, transcripts)
    return out.select(_shown(), "completion", "post_id", "user_id", "timestamp", F.get_json_object(F.get("prompt", F.lit(0))["metadata"], "$.transcript").alias("transcript"))


_MAILS = f"""{EVENTS_SQL}, m AS (SELECT user_id AS file, event_id, timestamp, event_type || ' number ' || event_id AS body FROM e WHERE event_id % 4 = 0),
l AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY file ORDER BY timestamp, event_id) > 604800 AS fresh FROM m),
t AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY file ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS no FROM l)"""


def _mail_files(spark, d):
    date = F.date_format(F.timestamp_seconds("timestamp"), "EEE, d MMM yyyy HH:mm:ss")
    said = F.concat(F.lit("Received: by x\n\tfor y\nMessage-ID: <m"), F.col("event_id").cast("string"), F.lit(">\nDate: "), date, F.lit(" +0000 (UTC)\nfolded\nFrom: U"), F.col("event_id").cast("string"), F.lit(" <u"), F.col("event_id").cast("string"), F.lit("@x.org>\nSubject: Re: s\n\n"), F.col("event_type"), F.lit(" number "), F.col("event_id").cast("string"))
    mails = adapters.events(spark, d).where("event_id % 4 = 0").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), said.alias("message"))
    return mails.unionByName(mails.where(F.col("message").contains("click")))  # some come twice


@query(f"""WITH {_MAILS}, r AS (SELECT *, count(*) OVER (PARTITION BY file, no) AS n,
  string_agg('u' || event_id || '@x.org:' || body, '|' ORDER BY timestamp, event_id) OVER (PARTITION BY file, no ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM t)
SELECT md5(shown) AS shown_md5, body AS completion, 'u' || event_id || '@x.org' AS user_id, timestamp, '<m' || event_id || '>' AS message_id FROM r WHERE n >= 2 AND shown IS NOT NULL""")
def email_rows(spark, d):
    out = builders.email(_mail_files(spark, d))
    return out.select(F.md5(_shown()).alias("shown_md5"), "completion", "user_id", "timestamp", F.get_json_object("metadata", "$.message_id").alias("message_id"))


@query(f"WITH {_MAILS} SELECT 'f' || file AS file, '<m' || event_id || '>' AS message_id, 'u' || event_id || '@x.org' AS user_id, 'Re: s' AS subject, body, timestamp FROM m UNION ALL SELECT 'f' || file, '<m' || event_id || '>', 'u' || event_id || '@x.org', 'Re: s', body, timestamp FROM m WHERE body LIKE '%click%'")
def flat_mails(spark, d):
    return builders.flat_mail(_mail_files(spark, d)).select("file", "message_id", "user_id", "subject", "body", "timestamp")


def _nested_mails(spark, d):
    at = F.date_format(F.timestamp_seconds("timestamp"), "MM/dd/yyyy hh:mm:ss a")
    said = F.concat(F.lit("From: a@x.org\nSubject: one\n\nnewer words\n\n-----Original Message-----\nFrom: b@x.org\nSent: "), at, F.lit("\nSubject: two\n\nolder words "), F.col("event_id").cast("string"))
    alone = F.lit("From: a@x.org\nSubject: one\n\nonly words")
    return adapters.events(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, alone).otherwise(said).alias("message"))


@query("SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['0 a@x.org only words'] ELSE ['0 a@x.org newer words', '1 b@x.org older words ' || event_id] END) AS mail FROM events")
def nested_mails(spark, d):
    parsed = _nested_mails(spark, d).select("event_id", F.explode(mailparse.parsed_mail("message")).alias("m"))
    return parsed.select("event_id", F.concat_ws(" ", F.col("m.email_index").cast("string"), F.element_at("m.headers", "from"), "m.body").alias("mail"))


@query("SELECT count(*) AS files, count(*) FILTER (event_id % 3 <> 0) AS nested, count(*) FILTER (event_id % 3 <> 0) AS replies, 1::INT AS most_nested FROM events")
def mail_parse_stats(spark, d):
    return incremental.parse_stats(_nested_mails(spark, d).select(mailparse.parsed_mail("message").alias("messages")))


# ---------------------------------------------------------------- sinks, read back


def _interactions(spark, d):
    turn = F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"), F.lit("{}").alias("metadata"))
    return adapters.events(spark, d).select(
        F.array(turn).alias("prompt"), F.concat(F.lit('said "'), "event_type", F.lit('",\nthen '), F.col("value").cast("string")).alias("completion"), "post_id", _id("u", "user_id").alias("user_id"), "timestamp", F.lit("{}").alias("metadata"),
        F.col("event_id"), F.when(F.col("event_id") % 5 == 0, "val").otherwise("train").alias("split"),
    )


_ROWS = "SELECT 'u' || user_id AS user_id, event_type AS content, md5('said \"' || event_type || '\",' || chr(10) || 'then ') AS said, timestamp"


def _back():
    return ["user_id", F.get("prompt", F.lit(0))["content"].alias("content"), F.md5(F.regexp_replace("completion", "then .*$", "then ")).alias("said"), "timestamp"]


@query(f"WITH {EVENTS_SQL} {_ROWS}, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM e")
def written_splits(spark, d):
    path = fresh_path(spark, "splits")
    writers.write_splits(_interactions(spark, d).drop("event_id"), path, ["timestamp", "user_id"], rows=500)
    return spark.read.parquet(path).select(*_back(), "split")


@query(f"WITH {EVENTS_SQL} {_ROWS} FROM e")
def written_interactions(spark, d):
    path = fresh_path(spark, "interactions")
    _interactions(spark, d).drop("event_id", "split").write.parquet(path)
    return readers.interactions(spark, path).select(*_back())


@query(f"WITH {EVENTS_SQL} {_ROWS}, 'c' AS __config_name__, 's' AS __split_name__ FROM e UNION ALL {_ROWS}, 'c', 's' FROM e WHERE event_id % 2 = 0")
def appended_json(spark, d):
    path = fresh_path(spark, "json")
    rows = _interactions(spark, d)
    writers.append_json(rows.drop("event_id", "split"), path)
    writers.append_json(rows.where("event_id % 2 = 0").drop("event_id", "split"), path)
    rows.select("event_id", F.concat(F.lit('{"completion": "cut off'), "post_id").alias("value")).where("event_id % 3 = 0").drop("event_id").write.mode("append").text(path)  # lines that are no JSON
    return readers.tagged(readers.json_lines(spark, path, INTERACTION), "c", "s").select(*_back(), "__config_name__", "__split_name__")


@query("SELECT 'w' || event_id AS worker_id, 'a \"quoted\" word, and' || chr(10) || event_type AS user_response FROM events")
def appended_submissions(spark, d):
    path = fresh_path(spark, "csv")
    given = {"worker_id": _id("w", "event_id"), "user_response": F.concat(F.lit('a "quoted" word, and\n'), "event_type")}
    rows = table(spark, d, "events").select(*[given.get(f.name, F.lit("x")).alias(f.name) for f in SUBMISSION])
    for half in (0, 1):
        writers.append_submission(rows.where(F.substring("worker_id", -1, 1).cast("int") % 2 == half), path)
    return spark.read.schema(SUBMISSION).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).select("worker_id", "user_response")


@query("SELECT user_id, count(*) AS n FROM events JOIN (SELECT DISTINCT user_id AS held FROM events WHERE event_id % 3 = 0) ON user_id = held GROUP BY user_id")
def bucketed_table(spark, d):
    """Two tables bucketed alike meet, and are counted, without a shuffle."""
    names = []
    for kind, rows in (("events", table(spark, d, "events").select("event_id", "user_id")), ("held", table(spark, d, "events").where("event_id % 3 = 0").select("user_id").distinct())):
        path = fresh_path(spark, kind)
        names.append(f"{kind}_{path.rsplit('-', 1)[1]}")
        writers.write_table(rows, names[-1], ["user_id"], 4, path)
    out = spark.table(names[0]).join(spark.table(names[1]).hint("merge"), "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    if "Exchange" in out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString():
        raise RuntimeError("bucketed tables were shuffled")
    result = stored(out, fresh_path(spark, "counts"))
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return result


@query("SELECT event_id::VARCHAR AS file, 'line ' || event_type || chr(10) || 'and \"more\", so' AS message FROM events")
def mail_csv_read(spark, d):
    path = fresh_path(spark, "mails")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("file"), F.concat(F.lit("line "), "event_type", F.lit('\nand "more", so')).alias("message"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.mail_csv(spark, path)


@query("SELECT conv_id::VARCHAR AS video_id, string_agg(role, chr(10) ORDER BY turn) AS video_transcript FROM conversations GROUP BY conv_id")
def transcript_cache(spark, d):
    path = fresh_path(spark, "transcripts")
    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    record = F.concat(F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform("t", lambda x: x["role"]), "\n"))
    convs.select(record.alias("value")).write.option("lineSep", "\n--------\n").text(path)
    return readers.transcripts(spark, path)


@query("SELECT s_suppkey AS video_id FROM supplier WHERE s_suppkey % 3 <> 1")
def missing_transcripts(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("video_id"), F.when(F.col("s_suppkey") % 3 == 1, "words").when(F.col("s_suppkey") % 3 == 2, "Not available.").alias("video_transcript"))
    return readers.bad_transcripts(rows).select("video_id")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def json_documents(spark, d):
    path, nations = fresh_path(spark, "document"), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    # one document over many lines, as a made-up input
    nations.agg(F.to_json(F.collect_list(F.struct("id", "name", "region")), {"pretty": "true"}).alias("value")).write.text(path)
    return readers.json_document(spark, path, nations.schema)


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_append(spark, d):
    """The stream is appended twice from its start: the second run adds nothing."""
    target, path = fresh_path(spark, "target"), f"{d}/event[s].parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).select("user_id", "event_type")
    for _ in range(2):
        stateful.append_if_new(stream, target, ["user_id", "event_type"], fresh_path(spark, "state")).awaitTermination()
    return spark.read.parquet(target)


@query("SELECT count(*) AS n, 2 AS reads FROM events")
def cached_stage(spark, d):
    path, built = fresh_path(spark, "stage"), []

    def build():
        built.append(1)
        return table(spark, d, "events").select("event_id")

    reads = [incremental.cached(spark, path, build) for _ in range(2)]
    assert len(built) == 1
    return reads[-1].agg(F.count(F.lit(1)).alias("n")).withColumn("reads", F.lit(len(reads)))


# ---------------------------------------------------------------- functions


def _persona():
    lists = {k: F.when(F.col("event_id") % 4 == i, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(f"{k} "), F.col("event_type")), F.lit(f"more {k}"))) for i, k in enumerate(PERSONA_LISTS)}
    told = F.struct(*[F.when(F.col("event_id") % 3 == 0, "NA").otherwise(F.concat(F.lit(k[0]), F.col("user_id").cast("string"))).alias(k) for k in DEMOGRAPHICS])
    return F.struct(told.alias("demographics"), *[v.alias(k) for k, v in lists.items()])


def _persona_sql(fields: int, items: float) -> str:
    """Lines of the persona that _persona makes, with fields and items dropped."""
    # 2^64 is 1616 modulo 10000
    draw = lambda key: f"((('0x' || substr(md5(concat_ws('_', '7', 'e' || event_id, 'item', {key})), 1, 16))::UBIGINT % 10000)::BIGINT * 1616 + (('0x' || substr(md5(concat_ws('_', '7', 'e' || event_id, 'item', {key})), 17, 16))::UBIGINT % 10000)::BIGINT) % 10000"
    hashed = lambda f: f"md5(concat_ws('_', '7', 'e' || event_id, 'field', '{f}'))"
    names = ["demographics", *PERSONA_LISTS]
    rank = lambda pool, f: f"({' + '.join(f'({hashed(g)} <= {hashed(f)})::INT' for g in pool)}) <= {len(pool)} - {min(fields, len(pool) - 1)}"
    kept = lambda f: rank(names, f) if f == "demographics" else f"CASE WHEN event_id % 3 = 0 THEN {rank(names[1:], f)} ELSE {rank(names, f)} END"
    out = []
    demo = ", ".join(f"CASE WHEN {draw(chr(39) + k + ':' + k[0] + chr(39) + ' || user_id')} >= {items * 10000} THEN '  {k}: {k[0]}' || user_id END" for k in DEMOGRAPHICS)
    out.append(f"coalesce(CASE WHEN event_id % 3 <> 0 AND {kept('demographics')} THEN 'Demographics:' || chr(10) || nullif(concat_ws(chr(10), {demo}), '') END, 'Demographics: Missing')")
    for i, f in enumerate(PERSONA_LISTS):
        one, two = f"'{f} ' || event_type", f"'more {f}'"
        held = ", ".join(f"CASE WHEN {draw(x)} >= {items * 10000} THEN {x} END" for x in (one, two))
        out.append(f"coalesce(CASE WHEN event_id % 4 <> {i} AND {kept(f)} THEN '{f.capitalize()}: ' || chr(10) || '  ' || nullif(concat_ws(chr(10) || '  ', {held}), '') END, '{f.capitalize()}: Missing')")
    return f"SELECT event_id, concat_ws(chr(10), {', '.join(out)}) AS persona FROM events"


@query(_persona_sql(2, 0.3))
def persona_texts(spark, d):
    return table(spark, d, "events").select("event_id", text.persona_text(_persona(), _id("e", "event_id"), 0.5, 0.3, 7).alias("persona"))


@query(_persona_sql(0, 0.0))
def whole_persona_texts(spark, d):
    return table(spark, d, "events").select("event_id", text.persona_text(_persona(), _id("e", "event_id"), seed=7).alias("persona"))


@query(f"""SELECT event_id, array_to_string(list_sort(list_transform(list_sort([md5(concat_ws('_', '3', 'e' || event_id, 'field', f)) || f for f in {list(PERSONA_LISTS)}])[3:], lambda x: substr(x, 33))), ',') AS dropped FROM events""")
def dropped_field_names(spark, d):
    gone = text.dropped_fields(list(PERSONA_LISTS), _id("e", "event_id"), 3, 0.4, 3)
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(gone), ",").alias("dropped"))


@query("""SELECT doc_id, md5('Kids & ' || doc_id || chr(160) || ' é “q” <b> ' || lang) AS clean_md5 FROM documents WHERE lang IS NOT NULL""")
def unescaped_texts(spark, d):
    said = F.concat(F.lit("Kids &amp; "), F.col("doc_id").cast("string"), F.lit("&nbsp; &eacute; &#8220;q&#x201D; &lt;b&gt; "), F.col("lang"))
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.md5(text.unescape(said)).alias("clean_md5"))


@query("""SELECT event_id, event_type || ' said' AS reply, CASE event_id % 2 WHEN 0 THEN '{"k": 1}' ELSE 'plain' END AS fenced FROM events""")
def replies_and_fences(spark, d):
    mail = F.concat("event_type", F.lit(" said\n\n> old\n> words\n\n")), F.concat("event_type", F.lit(" said\n-----Original Message-----\nmore"))
    said = F.when(F.col("event_id") % 3 == 0, mail[0]).otherwise(mail[1])
    fenced = F.when(F.col("event_id") % 2 == 0, 'so: ```json\n{"k": 1}\n``` end').otherwise(" plain ")
    return table(spark, d, "events").select("event_id", text.cut_reply(said).alias("reply"), text.fenced_json(fenced).alias("fenced"))


@query("""SELECT event_id, 'Article from user: ' || chr(10) || 'Title: T' || event_id || chr(10) || 'Subtitle: ' || CASE WHEN event_id % 2 = 0 THEN 'sub' ELSE '' END || chr(10) || '''''''' || chr(10) || event_type || chr(10) || '''''''' || chr(10)
 || 'Message from a: ' || chr(10) || '''''''' || chr(10) || 'x' || chr(10) || '''''''' AS shown FROM events""")
def titled_messages(spark, d):
    about = F.to_json(F.struct(_id("T", "event_id").alias("title"), F.when(F.col("event_id") % 2 == 0, "sub").alias("subtitle")))
    prompt = F.array(builders.item(F.lit("user"), F.col("event_type"), about), builders.item(F.lit("system"), F.lit("s"), F.lit("{}")), builders.item(F.lit("a"), F.lit("x"), F.lit("{}")))
    return table(spark, d, "events").select("event_id", text.format_messages_titled(prompt).alias("shown"))


@query("""SELECT event_id, greatest(floor(value)::BIGINT - 50, 0)::BIGINT AS elapsed, event_id % 3 > 0 AS has_comments, CASE WHEN event_id % 2 = 0 THEN 'A person: 30, f.' ELSE 'A person.' END AS person,
 CASE event_id % 3 WHEN 0 THEN '2,3,4' WHEN 1 THEN '1,5' ELSE '1' END AS months, event_id::VARCHAR AS suffix FROM events""")
def study_functions(spark, d):
    given = F.when(F.col("event_id") % 2 == 0, "30").otherwise(""), F.when(F.col("event_id") % 2 == 0, "f").otherwise(F.lit(None).cast("string"))
    months = F.when(F.col("event_id") % 3 == 0, "2-4").when(F.col("event_id") % 3 == 1, "1, 5 13").otherwise("none")
    answers = F.when(F.col("event_id") % 3 == 2, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    count = F.when(F.col("event_id") % 3 == 1, 4)
    return table(spark, d, "events").select(
        "event_id", study.elapsed(F.lit(50).cast("long"), F.floor("value")).alias("elapsed"), study.has_comments(count, answers).alias("has_comments"), study.fallback_persona(given[0], given[1], F.lit("")).alias("person"),
        F.array_join(timeparse.months(months), ",").alias("months"), text.id_suffix(F.concat(F.lit("a_b_"), F.col("event_id").cast("string"))).alias("suffix"),
    )


@query("""SELECT event_id, event_id % 4 = 0 AS valid, CASE WHEN event_id % 4 = 1 THEN 'No training data available for this user' ELSE 'p' END AS persona FROM events""")
def persona_validation(spark, d):
    whole = {"demographics": dict.fromkeys(DEMOGRAPHICS, "x"), **{k: ["y"] for k in PERSONA_LISTS}}
    bad = [{**whole, "more": 1}, {**whole, "values": []}, {k: v for k, v in whole.items() if k != "values"}]
    k = F.col("event_id") % 4
    given = F.when(k == 0, json.dumps(whole)).when(k == 1, json.dumps(bad[0])).when(k == 2, json.dumps(bad[1])).otherwise(json.dumps(bad[2]))
    return table(spark, d, "events").select("event_id", jsonops.persona_is_valid(given).alias("valid"), jsonops.persona_or_default(F.when(k != 1, "p")).alias("persona"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'given' ELSE 'unknown' END AS gender, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'unknown' END AS first FROM supplier""")
def default_personas(spark, d):
    """Personas of a third of the suppliers; the others' are the default."""
    lists = [F.array("s_name").alias(k) for k in PERSONA_LISTS]
    told = F.to_json(F.struct(F.struct(*[F.lit("given").alias(k) for k in DEMOGRAPHICS]).alias("demographics"), *lists))
    given = F.from_json(F.when(F.col("s_suppkey") % 3 == 0, told).otherwise(jsonops.default_persona()), PERSONA)
    return table(spark, d, "supplier").select("s_suppkey", given.alias("p")).select("s_suppkey", F.col("p.demographics.gender").alias("gender"), F.get("p.interests", F.lit(0)).alias("first"))


@query("""SELECT event_id, '{"n":' || event_id || ',"t":' || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '1.5' ELSE '"x"' END || ',"l":[1,"a b"]}' AS object FROM events""")
def nearly_json(spark, d):
    third = F.when(F.col("event_id") % 3 == 0, "TRUE").when(F.col("event_id") % 3 == 1, '"1.5"').otherwise("'x'")
    near = F.concat(F.lit("answer: {'n': \""), F.col("event_id").cast("string"), F.lit('", "t": '), third, F.lit(", 'l': [1, '''a b''',],} done"))
    schema = "struct<n:long,t:string,l:array<string>>"
    read = F.from_json(jsonops.read_object(near), schema)
    shown = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit('"'), read["t"], F.lit('"'))).otherwise(read["t"])
    return table(spark, d, "events").select("event_id", F.concat(F.lit('{"n":'), read["n"].cast("string"), F.lit(',"t":'), shown, F.lit(',"l":['), read["l"][0], F.lit(',"'), read["l"][1], F.lit('"]}')).alias("object"))


@query("""SELECT 'c' || event_id AS id, event_type AS text, '' AS above FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'r' || event_id, 'reply', 'c' || event_id FROM events WHERE event_id % 4 = 0""")
def tops_with_replies(spark, d):
    replies = F.when(F.col("event_id") % 4 == 0, F.array(F.struct(_id("r", "event_id").alias("id"), F.lit("reply").alias("text")))).otherwise(F.array().cast("array<struct<id:string,text:string>>"))
    comments = table(spark, d, "events").where("event_id % 2 = 0").select(_id("c", "event_id").alias("id"), F.col("event_type").alias("text"), replies.alias("replies"))
    return trees.tops_and_replies(comments).select("id", "text", F.array_join("upper_comments", ",").alias("above"))


@query(f"""WITH {EVENTS_SQL}, h AS (SELECT conv_id AS user_id, turn AS timestamp, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) <= 12)
SELECT user_id, count(*) AS entries, md5(string_agg('[1970-01-01 00:00:' || lpad(timestamp::VARCHAR, 2, '0') || ' UTC] ' || text, chr(10) ORDER BY rn)) AS history_md5 FROM h WHERE rn <= 3 GROUP BY user_id""")
def short_text_histories(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("timestamp"), F.col("text").alias("completion"))
    return history.history_text(rows, 3, ["timestamp"], longest=12).select("user_id", "entries", F.md5("history").alias("history_md5"))


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT max(timestamp) AS now FROM e), x AS (SELECT event_id, value, timestamp, event_id % 7 AS comments, greatest(now - timestamp, 1) AS age FROM e, m)
SELECT * FROM (SELECT 'hot' AS sort, event_id FROM x ORDER BY sign(value) * log10(greatest(abs(value), 1)) + timestamp / 45000 DESC, event_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'rising', event_id FROM x WHERE age <= 604800 ORDER BY value / age DESC, event_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'controversial', event_id FROM x ORDER BY comments DESC, timestamp DESC, event_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'new', event_id FROM x WHERE age <= 2592000 ORDER BY timestamp DESC, event_id LIMIT 20)""")
def listings(spark, d):
    events = adapters.events(spark, d)
    now = events.agg(F.max("timestamp")).first()[0] or 0
    posts = events.select(F.col("event_id").alias("id"), F.col("timestamp").alias("created"), F.col("value").alias("score"), (F.col("event_id") % 7).alias("comments"))
    found = [incremental.listing(posts, sort, period, now, 20).select(F.lit(sort).alias("sort"), F.col("id").alias("event_id")) for sort, period in (("hot", "all"), ("rising", "week"), ("controversial", "all"), ("new", "month"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("SELECT event_id, coalesce(nullif(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE '{\"a\":1}' END, ''), '{}') AS metadata, event_type AS content FROM events")
def normalised_prompts(spark, d):
    about = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 2, '{"a":1}')
    raw = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"), about.alias("metadata"), F.lit(1).alias("more"))))
    one = F.get(jsonops.normal_prompt(jsonops.prompt_from_json(raw)), F.lit(0))
    return table(spark, d, "events").select("event_id", one["metadata"].alias("metadata"), one["content"].alias("content"))
