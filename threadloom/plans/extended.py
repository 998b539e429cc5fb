"""Queries of stores, streams with state, paged sources, quoted mails and chat prompts, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import chat, mailparse, timeparse
from threadloom.operators import activity, conversations, history, incremental, personas, stores, threads
from threadloom.plans import builders, processor
from threadloom.plans.catalog import query
from threadloom.sources import adapters, paged, readers, writers
from threadloom.sources.adapters import EVENTS_SQL, table
from threadloom.storage import fresh_path, stored
from threadloom.streaming import playlists


def _id(mark, c):
    return F.concat(F.lit(mark), F.col(c).cast("string"))


# ---------------------------------------------------------------- mails quoted without a mark


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, i::INT AS email_index, 'u' || turn || '@x.org' AS sender, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS body_md5, i < n - 1 AS is_original, (978307200 + turn * 60)::DOUBLE AS seconds FROM t""")
def quoted_mails(spark, d):
    """Each conversation as one mail: its last turn, quoting the turn before, and so on; heads without any mark, every other one quoted."""
    date = F.date_format(F.timestamp_seconds(F.lit(978307200) + F.col("turn") * 60), "MMMM d, yyyy h:mm:ss a")
    head = F.concat(F.lit("From: Some One [mailto:u"), F.col("turn").cast("string"), F.lit("@x.org]\nSent: "), date, F.lit("\nTo: all@x.org\nSubject: s\n\n"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat(head, "text").alias("mail"))
    mails = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("back"), "mail"))), lambda x: x["mail"]).alias("mails"))
    parsed = mails.select("conv_id", F.explode(mailparse.parsed_mail(F.array_join("mails", "\n\n"))).alias("m"))
    return parsed.select("conv_id", F.col("m.email_index").alias("email_index"), F.element_at("m.headers", "from").alias("sender"), F.md5("m.body").alias("body_md5"), F.col("m.is_original").alias("is_original"), F.col("m.seconds").alias("seconds"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def reply_chains(spark, d):
    quoting = F.concat(F.lit("From: a@x.org\nSubject: Re: one\n\nyes\n\n> shall we, "), F.col("event_id").cast("string"), F.lit("?"))
    mails = table(spark, d, "events").select("event_id", mailparse.parsed_mail(F.when(F.col("event_id") % 3 == 0, "From: a@x.org\nSubject: one\n\nonly words").otherwise(quoting)).alias("messages"))
    return incremental.reply_chains(mails).select("event_id")


@query(f"WITH {EVENTS_SQL} SELECT event_id, timestamp, 'u' || user_id AS user_id, 'v' || event_id % 5 AS video_id, event_type AS text FROM e")
def lifted_snippets(spark, d):
    at = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    snippet = F.struct(F.struct(_id("u", "user_id").alias("value")).alias("authorChannelId"), at.alias("publishedAt"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("videoId"), F.col("event_type").alias("textOriginal"))
    return builders.lifted_comments(adapters.events(spark, d).select("event_id", snippet.alias("snippet"))).drop("snippet")


@query("""SELECT o_orderkey, 2020 AS year FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'F' AND o_orderkey % 4 <> 0""")
def listed_sources(spark, d):
    """Playlists by name, categories but the unknown one, comments at the top, and a year so many before now."""
    category = F.when(F.col("o_orderstatus") == "F", "Unknown").otherwise(F.col("o_orderstatus"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), category.alias("category"), F.when(F.col("o_orderkey") % 4 == 0, "above").alias("parent_id"))
    named = incremental.named_lists(incremental.known_categories(rows), ["1-URGENT", "5-LOW"])
    kept = incremental.top_level(incremental.top_level(incremental.named_lists(named, None), False), True)
    return kept.select("o_orderkey", timeparse.target_year(F.lit(1735689600), 5).alias("year"))


# ---------------------------------------------------------------- pages, stores and state


@query("SELECT event_id::VARCHAR AS item, 1 AS times FROM events")
def paged_items(spark, d):
    """Events as pages; the stream reads those that are there, ends, and goes on from its checkpoint when the others have come: no page comes twice."""
    path, out, state = fresh_path(spark, "pages"), fresh_path(spark, "items"), fresh_path(spark, "state")
    for numbers in (range(3), range(3, 1 << 40)):
        paged.write_pages(table(spark, d, "events").select("event_id"), path, "event_id", ["event_id"], 250, numbers)
        stream = paged.pages(spark, path, per_batch=1000)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("cursor string, place int, item string").parquet(out).groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("SELECT user_id::VARCHAR AS user_id, 'entries: ' || count(*) AS persona FROM events GROUP BY user_id")
def persona_batches(spark, d):
    """Two batches, then a second run that makes what is missing."""
    told = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"))
    store = stores.PersonaStore(fresh_path(spark, "personas"))
    provider = lambda rows: rows.select("user_id", F.concat(F.lit("entries: "), F.col("entries").cast("string")).alias("persona"))
    store.run(told, provider, batch=40, most=2)
    return store.run(told, provider, batch=200)


@query("""WITH o AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_id % 5 <> 0 GROUP BY user_id), w AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_id % 5 = 0 AND user_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(w.user_id, o.user_id) AS user_id, CASE WHEN w.user_id IS NULL THEN o.n ELSE w.n END + CASE WHEN coalesce(w.user_id, o.user_id) % 7 = 0 THEN 100 ELSE 0 END AS n, coalesce(w.last, o.last) AS last FROM o FULL JOIN w ON o.user_id = w.user_id""")
def keyed_profiles(spark, d):
    """Profiles by user: written, upserted, then some read, changed and written back."""
    profiles = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    events, store = table(spark, d, "events"), stores.KeyStore(fresh_path(spark, "profiles"), ["user_id"], 16)
    store.upsert(profiles(events.where("event_id % 5 <> 0")))
    store.upsert(profiles(events.where("event_id % 5 = 0 AND user_id % 3 = 0")))
    store.modify(store.read(spark).where("user_id % 7 = 0"), lambda held: held.withColumn("n", F.col("n") + 100))
    return store.read(spark)


@query("SELECT user_id, count(*) AS n FROM events WHERE event_id % 10 < 8 GROUP BY user_id HAVING count(*) BETWEEN 20 AND 60")
def staged_interactions(spark, d):
    """Stages raw, sampled and filtered: built once, then read at the most processed one that is stored."""
    store, root = stores.StageStore, fresh_path(spark, "stages")
    sample = lambda df: df.where("event_id % 10 < 8")
    keep = lambda df: activity.active_rows(df, 20, 60)
    stages = stores.processing_stages(lambda: table(spark, d, "events"), sample, keep, 20, 60, None, 0.8)
    first, second = store(root), store(root)
    first.resolve(spark, stages)
    df = second.resolve(spark, stages)
    if (first.built, second.built) != ([s.name for s in stages], []):
        raise RuntimeError(f"stages were built {first.built}, then {second.built}")
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id::VARCHAR AS list_id, max(turn) + 1 + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS items, count(DISTINCT turn) AS have,
CASE WHEN count(DISTINCT turn) >= max(turn) + 1 + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END THEN 'complete' ELSE 'incomplete' END AS state FROM conversations GROUP BY conv_id""")
def playlist_completeness(spark, d):
    """Conversations as playlists, every third expecting one more item than there is; a last row far ahead ends the wait of all."""
    rows = table(spark, d, "conversations")
    expected = rows.groupBy("conv_id").agg((F.max("turn") + 1 + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).alias("items"))
    rows = rows.join(expected, "conv_id").select(F.col("conv_id").cast("string").alias("list_id"), F.col("turn").cast("string").alias("item"), F.col("items").cast("long").alias("items"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("turn") * 60).alias("ts"))
    end = spark.sql("SELECT 'end' AS list_id, 'end' AS item, 1L AS items, timestamp_seconds(1700000000) AS ts")
    path, out, state = (fresh_path(spark, x) for x in ("lists", "answers", "state"))
    stored(rows.unionByName(end), path)
    stream = playlists.completeness(spark.readStream.schema(rows.schema).parquet(path), 86400)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(playlists.OUT).parquet(out).where("list_id <> 'end'")


# ---------------------------------------------------------------- hot users


_HOT = f"""{EVENTS_SQL}, h AS (SELECT event_id, timestamp, CASE WHEN event_id % 10 < 9 THEN 0 ELSE user_id END AS user_id FROM e)"""


def _hot(spark, d):
    return adapters.events(spark, d).select("event_id", "timestamp", F.when(F.col("event_id") % 10 < 9, 0).otherwise(F.col("user_id")).cast("long").alias("user_id"))


@query(f"""WITH {_HOT}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > 600 THEN 1 ELSE 0 END AS f FROM h WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id))
SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS thread_no FROM g""")
def hot_gap_sessions(spark, d):
    return threads.gap_sessions(_hot(spark, d), 600, ["user_id"], "timestamp", ["event_id"], F.floor(F.col("timestamp") / 86400)).select("event_id", "user_id", "thread_no")


@query(f"""WITH {_HOT} SELECT event_id, max_by(event_id, event_id) FILTER (event_id % 7 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried,
row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS rn FROM h""")
def hot_carried_values(spark, d):
    rows = conversations.carried_last(_hot(spark, d), F.col("event_id"), F.col("event_id") % 7 == 0, "carried", "user_id", "event_id", F.floor(F.col("event_id") / 500))
    return history.ranked(rows, ["timestamp", "event_id"], spread=F.floor(F.col("timestamp") / 86400)).select("event_id", "carried", F.col("rn").cast("long").alias("rn"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, turn, md5(coalesce(string_agg(role || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS prompt_md5 FROM t""")
def bucketed_prefixes(spark, d):
    rows = conversations.with_prefix(table(spark, d, "conversations"), F.concat_ws(":", "role", "text"), spread=F.floor(F.col("turn") / 3))
    return rows.select("conv_id", "turn", F.md5(F.array_join("prompt", "|")).alias("prompt_md5"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > 86400 THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id)),
t AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS thread_no FROM g)
SELECT user_id, thread_no, count(*) AS rows FROM t GROUP BY user_id, thread_no""")
def unique_thread_ids(spark, d):
    """Threads counted by their ids, of five digits: those that collide are hashed again, a digit longer."""
    rows = threads.gap_sessions(adapters.events(spark, d), 86400, ["user_id"], "timestamp", ["event_id"])
    named = threads.unique_thread_ids(rows, ["user_id"], "timestamp", ["event_id"], ["event_id", "timestamp"], digits=5)
    return named.groupBy("thread_id").agg(F.min("user_id").alias("user_id"), F.min("thread_no").alias("thread_no"), F.count(F.lit(1)).alias("rows")).drop("thread_id")


# ---------------------------------------------------------------- prompts, personas, sinks


@query("""WITH q AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS asked, min(turn) AS head, max(turn) AS tail FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' AND turn = head THEN '<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10)
  WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) || CASE WHEN turn % 2 = 0 THEN '<name>N' || turn || '</name>' || chr(10) ELSE '' END
    || CASE WHEN turn > coalesce(asked, tail) THEN '<think>' || chr(10) || 'so ' || turn || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text
    || CASE WHEN turn % 3 = 0 THEN chr(10) || '<tool_call>' || chr(10) || '{"name": "f", "arguments": {"k": ' || turn || '}}' || chr(10) || '</tool_call>' ELSE '' END || '<|im_end|>' || chr(10)
    || CASE WHEN turn % 3 = 0 THEN '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || '1' || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || '2' || chr(10) || '</tool_response><|im_end|>' || chr(10) ELSE '' END
  ELSE '<|im_start|>' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN '<name>N' || turn || '</name>' ELSE '' END || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '<|im_end|>' || chr(10) END, '' ORDER BY turn)
  || '<|im_start|>user' || chr(10) || '<name>HUMAN</name>' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS prompt_md5 FROM conversations JOIN q USING (conv_id) GROUP BY conv_id""")
def chat_prompts(spark, d):
    """Names on even turns; assistants think, and on every third turn call a tool that answers twice."""
    said = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>\nso "), F.col("turn").cast("string"), F.lit("\n</think>\n\n"), "text")).otherwise(F.col("text"))
    call = F.when((F.col("turn") % 3 == 0) & (F.col("role") == "assistant"), F.array(F.struct(F.lit("f").alias("name"), F.format_string('{"k": %d}', "turn").alias("arguments"))))
    turn = lambda role, content, name, calls: F.struct(role.alias("role"), content.alias("content"), name.alias("name"), F.lit(None).cast("string").alias("reasoning_content"), calls.alias("tool_calls"))
    none = F.lit(None).cast("string")
    own = turn(F.col("role"), said, F.when(F.col("turn") % 2 == 0, _id("N", "turn")), call)
    answers = [turn(F.lit("tool"), F.lit(x), none, F.lit(None).cast("array<struct<name:string,arguments:string>>")) for x in "12"]
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(call.isNotNull(), F.array(own, *answers)).otherwise(F.array(own)).alias("said"))
    convs = rows.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"])).alias("turns"))
    return convs.select("conv_id", F.md5(chat.chat_prompt(F.col("turns"), speak_as=F.lit("HUMAN"), thinking=False)).alias("prompt_md5"))


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT s_suppkey AS video, CASE WHEN s_suppkey % 2 = 0 THEN 'words of ' || s_name ELSE 'Not available.' END AS transcript FROM supplier)
SELECT event_id, coalesce(transcript, 'Not available.') AS transcript FROM e LEFT JOIN v ON video = event_id % 10 + 1 WHERE user_id IN (SELECT user_id FROM e GROUP BY user_id HAVING count(*) >= 20)""")
def completed_rows(spark, d):
    """The processor's hook of a dataset: transcripts joined to rows by their post."""
    have = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(_id("v", "s_suppkey").alias("post_id"), F.concat(F.lit("words of "), "s_name").alias("transcript"))
    complete = lambda rows: rows.join(have, "post_id", "left").withColumn("transcript", F.coalesce("transcript", F.lit(builders.NO_TRANSCRIPT)))
    prompt = F.array(F.struct(F.lit("post").alias("role"), F.col("post_id").alias("content"), F.lit(None).cast("string").alias("metadata")))
    rows = adapters.events(spark, d).withColumn("post_id", F.concat(F.lit("v"), (F.col("event_id") % 10 + 1).cast("string"))).withColumn("prompt", prompt).withColumn("metadata", F.col("props"))
    return processor.prepared(rows, processor.Config(least=20, complete=complete)).select("event_id", "transcript")


@query("""WITH h AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, 'P' || n AS asked, 0.5::DOUBLE AS usd, 'fixed' AS fixed, 'preview of ' || n || ' entries, 2 words' AS preview FROM h""")
def persona_modes(spark, d):
    """Personas by calls from tasks, of one text, and as a preview."""
    told = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("entries")).withColumn("history", F.concat(F.lit("P "), F.col("entries").cast("string")))
    asked = personas.calling(lambda history: (history.replace(" ", ""), {"usd": 0.5}), lambda answer: answer.startswith("P"), "none", pause=0.0)(told)
    out = asked.select("user_id", F.col("persona").alias("asked"), F.col("usage.usd").alias("usd"))
    for name, provider in (("fixed", personas.fixed("fixed")), ("preview", personas.preview)):
        out = out.join(provider(told).withColumnRenamed("persona", name), "user_id")
    return out


@query("SELECT event_id::VARCHAR AS file, 'm ' || event_type AS message FROM events ORDER BY event_id::VARCHAR LIMIT 40")
def capped_mail_csv(spark, d):
    path = fresh_path(spark, "mails")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("file"), F.concat(F.lit("m "), "event_type").alias("message"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.mail_csv(spark, path, 40)


@query("SELECT n_nationkey AS id, n_name || ' é' AS name, CASE WHEN n_regionkey = 2 THEN 'saved twice' ELSE 'saved' END AS state FROM nation")
def submission_states(spark, d):
    """States saved one file each, some of them again; those of other keys stay."""
    path = fresh_path(spark, "states")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" é")).alias("name"), "n_regionkey")
    writers.write_states(rows.select("id", "name", F.lit("saved").alias("state")), path, "id")
    writers.write_states(rows.where("n_regionkey = 2").select("id", "name", F.lit("saved twice").alias("state")), path, "id")
    return spark.read.schema("id long, name string, state string").json(path).select("id", "name", "state")


@query("SELECT r_regionkey AS id, r_name || ' é' AS name, NULL::VARCHAR AS more FROM region")
def pretty_documents(spark, d):
    path = fresh_path(spark, "pretty")
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.concat("r_name", F.lit(" é")).alias("name"), F.lit(None).cast("string").alias("more"))
    writers.write_pretty(rows, path, "id", 1)
    return readers.json_document(spark, path, rows.schema)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM events")
def guarded_target(spark, d):
    """A second write to a target with data is refused and changes nothing; a split without rows keeps the others' columns."""
    path = fresh_path(spark, "guarded")
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "val").otherwise("train").alias("split"))
    writers.write_splits(rows, path, ["event_id"])
    try:
        writers.write_splits(rows.where("event_id < 10"), path, ["event_id"])
        raise RuntimeError("the write was not refused")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    held = spark.read.parquet(path)
    return held.unionByName(writers.empty_like(held)).select("event_id", "split")
