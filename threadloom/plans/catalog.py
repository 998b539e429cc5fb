"""Every query over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from threadloom.functions import jsonops, study, text, timeparse
from threadloom.operators import activity, conversations, dedupe, history, incremental, joins, personas, splits, threads, trees
from threadloom.plans import processor
from threadloom.sources import adapters, readers
from threadloom.sources.adapters import EVENTS_SQL, LINE_KEY, LINE_KEY_SQL, PURCHASES_SQL, table
from threadloom.streaming import drain, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- activity


@query("SELECT user_id, count(*) AS count FROM events GROUP BY user_id")
def user_activity_counts(spark, d):
    return activity.user_counts(table(spark, d, "events"))


@query("""SELECT event_id, user_id, event_type, value FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) BETWEEN 60 AND 75)""")
def active_user_events(spark, d):
    return activity.active_rows(table(spark, d, "events"), 60, 75).select("event_id", "user_id", "event_type", "value")


@query("""SELECT event_id, user_id FROM events WHERE event_type <> 'error'
AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) BETWEEN 50 AND 80)""")
def active_rows_with_filter(spark, d):
    return activity.active_rows(table(spark, d, "events"), 50, 80, predicate=F.col("event_type") != "error").select("event_id", "user_id")


@query(f"""WITH {PURCHASES_SQL}, c AS (SELECT user_id, count(*) AS n FROM (SELECT user_id FROM l UNION ALL SELECT user_id FROM events) GROUP BY user_id)
SELECT user_id, n AS count FROM c""")
def counts_over_sources(spark, d):
    return activity.counts_of_sources([adapters.purchases(spark, d), table(spark, d, "events")])


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(*) < 65")
def users_below_cap(spark, d):
    return activity.users_below(table(spark, d, "events"), 65)


@query("SELECT count(*) AS users, avg(n) AS avg_count, min(n) AS min_count, max(n) AS max_count FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def user_count_summary(spark, d):
    return activity.count_summary(activity.user_counts(table(spark, d, "events")))


@query(f"""WITH {PURCHASES_SQL}, c AS (SELECT user_id, count(*) AS n FROM l GROUP BY user_id), r AS (SELECT min(n) AS a, max(n) AS b FROM c),
e AS (SELECT [0, (a*0.25)::DOUBLE, (a*0.5)::DOUBLE, (a*0.75)::DOUBLE, a, a, a + (b-a)*0.25, a + (b-a)*0.5, a + (b-a)*0.75, b, 10000] AS raw FROM r),
f AS (SELECT list_transform(raw, lambda x: floor(x)::BIGINT) AS g FROM e),
p AS (SELECT i AS bucket_idx, g[i+1] AS lo, g[i+2] AS hi FROM f, range(10) AS t(i)),
m AS (SELECT c.user_id, min(bucket_idx) AS bucket_idx FROM c JOIN p ON n >= lo AND (n < hi OR (bucket_idx = 9 AND n <= hi)) GROUP BY c.user_id)
SELECT m.bucket_idx::INT AS bucket_idx, count(*) AS users, any_value(lo || '-' || hi) AS bucket FROM m JOIN p USING (bucket_idx) GROUP BY m.bucket_idx""")
def user_count_histogram(spark, d):
    return activity.count_histogram(activity.user_counts(adapters.purchases(spark, d)))


@query("""SELECT count(*) FILTER (n <= 60) AS users_dropped, sum(least(n, 60))::BIGINT AS rows_dropped
FROM (SELECT count(*) AS n FROM events GROUP BY user_id)""")
def history_drop_stats(spark, d):
    return activity.history_drop_stats(activity.user_counts(table(spark, d, "events")), 60)


@query(f"WITH {PURCHASES_SQL} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT post_id) AS n_posts FROM l")
def distinct_users_posts(spark, d):
    return activity.distinct_counts(adapters.purchases(spark, d))


# ---------------------------------------------------------------- histories and personas


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id)::INT AS rn FROM e QUALIFY rn <= 20")
def first_h_history(spark, d):
    return history.first_rows(adapters.events(spark, d), 20, ["timestamp", "event_id"]).select("user_id", "event_id", "rn")


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id)::INT AS rn FROM e QUALIFY rn > 20")
def non_history_rows(spark, d):
    return history.later_rows(adapters.events(spark, d), 20, ["timestamp", "event_id"]).select("user_id", "event_id", "rn")


@query(f"""WITH {EVENTS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS rn FROM e)
SELECT user_id, count(*) AS entries, md5(string_agg('[' || strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC] ' || event_type, chr(10) ORDER BY rn)) AS history_md5
FROM h WHERE rn <= 10 GROUP BY user_id""")
def history_texts(spark, d):
    df = history.history_text(adapters.events(spark, d), 10, ["timestamp", "event_id"], text="event_type")
    return df.select("user_id", "entries", F.md5("history").alias("history_md5"))


@query("""WITH t AS (SELECT conv_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM conversations WHERE role = 'user')
SELECT conv_id AS user_id, count(*) AS texts, avg(n) AS avg_words, min(n) AS min_words, max(n) AS max_words FROM t GROUP BY conv_id""")
def persona_text_stats(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("user_id"), "text")
    return personas.statistics(rows, "text")


@query("""WITH c AS (SELECT user_id, 'a' || user_id AS persona FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0),
f AS (SELECT user_id, 'b' || user_id AS persona FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0)
SELECT user_id, persona FROM f UNION ALL SELECT user_id, persona FROM c WHERE user_id NOT IN (SELECT user_id FROM f)""")
def persona_checkpoint_merge(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    named = lambda k, mark: users.where(F.col("user_id") % k == 0).select("user_id", F.concat(F.lit(mark), F.col("user_id").cast("string")).alias("persona"))
    return personas.merged(named(2, "a"), named(3, "b"))


@query("""SELECT event_id, e.user_id, coalesce('p' || p.user_id, 'No training data available for this user') AS persona
FROM events e LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) p ON e.user_id = p.user_id""")
def persona_join(spark, d):
    events = table(spark, d, "events")
    named = events.where("user_id % 2 = 0").select("user_id").distinct().withColumn("persona", F.concat(F.lit("p"), F.col("user_id").cast("string")))
    return personas.with_personas(events.select("event_id", "user_id"), named).select("event_id", "user_id", "persona")


@query("""SELECT 100.0::DOUBLE * count(*) AS usd, sum(turn)::BIGINT AS prompt_tokens, sum(length(text))::BIGINT AS completion_tokens,
sum(turn + length(text))::BIGINT AS total_tokens, count(*) AS calls FROM conversations""")
def usage_totals(spark, d):
    rows = table(spark, d, "conversations").select(F.struct(F.lit(100.0).alias("usd"), F.col("turn").alias("prompt_tokens"), F.length("text").cast("long").alias("completion_tokens")).alias("usage"))
    return personas.usage(rows)


# ---------------------------------------------------------------- samples and splits


def _hash_sql(seed: int, *keys: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"{k}::VARCHAR" for k in keys) + "))"


@query(f"""WITH s AS (SELECT event_id, row_number() OVER (ORDER BY {_hash_sql(42, "event_id")}, event_id) AS rn, count(*) OVER () AS n FROM events)
SELECT event_id FROM s WHERE rn <= floor(n * 0.25)""")
def sample_rows_hash(spark, d):
    return splits.sample_rows(table(spark, d, "events").select("event_id"), 0.25, 42, ["event_id"])


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, row_number() OVER (ORDER BY {_hash_sql(7, "user_id")}, user_id) AS rn, count(*) OVER () AS n FROM u)
SELECT user_id FROM s WHERE rn <= floor(n * 0.1)""")
def sample_users_hash(spark, d):
    return splits.sample_users(table(spark, d, "events"), 0.1, 7)


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT user_id, row_number() OVER (ORDER BY {_hash_sql(42, "user_id")}, user_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM e)),
r AS (SELECT e.event_id, e.user_id, u.rn <= round_even(u.n * 0.15::DOUBLE, 0) AS held, row_number() OVER (PARTITION BY e.user_id ORDER BY timestamp, event_id) AS k, count(*) OVER (PARTITION BY e.user_id) AS m FROM e JOIN u USING (user_id)),
s AS (SELECT *, CASE WHEN held THEN 'unseen_test' WHEN k > m - round_even(m * 0.2::DOUBLE, 0) THEN 'seen_test' END AS s FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql(42, "event_id")}, event_id) AS rn, count(*) OVER () AS n FROM s WHERE s IS NULL)
SELECT event_id, user_id, s AS split FROM s WHERE s IS NOT NULL
UNION ALL SELECT event_id, user_id, CASE WHEN rn <= round_even(n * (1.0::DOUBLE - 0.1::DOUBLE), 0) THEN 'train' ELSE 'val' END FROM p""")
def split_by_user(spark, d):
    return splits.split_by_user(adapters.events(spark, d), 0.15, 0.2, 0.1, 42, ["timestamp", "event_id"], ["event_id"]).select("event_id", "user_id", "split")


_POST_SPLIT = f"""{PURCHASES_SQL}, p AS (SELECT post_id, min(timestamp) AS start FROM l GROUP BY post_id),
q AS (SELECT post_id, row_number() OVER (ORDER BY start, post_id) AS rn, count(*) OVER () AS n FROM p),
z AS (SELECT post_id, rn, n - round_even(n * 0.1::DOUBLE, 0) - round_even(n * 0.1::DOUBLE, 0) AS tr, round_even(n * 0.1::DOUBLE, 0) AS va FROM q),
s AS (SELECT l.*, CASE WHEN rn <= tr THEN 'train' WHEN rn <= tr + va THEN 'val' ELSE 'test' END AS split FROM l JOIN z USING (post_id))"""


@query(f"WITH {_POST_SPLIT} SELECT {LINE_KEY_SQL}, timestamp, split FROM s")
def split_by_post_time(spark, d):
    return splits.split_by_post_time(adapters.purchases(spark, d), 0.1, 0.1).select(*LINE_KEY, "timestamp", "split")


@query(f"WITH {_POST_SPLIT} SELECT {LINE_KEY_SQL}, split FROM s WHERE split = 'train' OR user_id IN (SELECT user_id FROM s WHERE split = 'train')")
def split_by_post_time_train_users(spark, d):
    return splits.train_users_only(splits.split_by_post_time(adapters.purchases(spark, d), 0.1, 0.1)).select(*LINE_KEY, "split")


@query(f"""WITH {_POST_SPLIT} SELECT split, min(timestamp) AS first, max(timestamp) AS last, count(*) AS rows FROM s GROUP BY split""")
def post_time_ranges(spark, d):
    return splits.time_ranges(splits.split_by_post_time(adapters.purchases(spark, d), 0.1, 0.1))


_TURNS = """v AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE role <> 'system'),
x AS (SELECT conv_id, turn, k AS turn_id FROM v WHERE role = 'user' AND k > 0)"""


@query(f"""WITH {_TURNS}, y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM x),
z AS (SELECT *, greatest(1, n - (ceil(n * 0.1::DOUBLE) + 1) - greatest(floor(n * 0.1::DOUBLE), 1)) AS tr, greatest(floor(n * 0.1::DOUBLE), 1) AS va FROM y WHERE n BETWEEN 2 AND 10)
SELECT conv_id, turn_id, unnest(CASE WHEN r <= tr THEN ['train'] WHEN r <= tr + va THEN ['val'] ELSE ['seen_test', 'unseen_test'] END) AS split FROM z""")
def split_by_turn(spark, d):
    rows = adapters.turns(spark, d).where("role = 'user' AND k > 0").select("conv_id", F.col("k").cast("long").alias("turn_id"))
    return splits.split_by_turn(rows, 2, 10, 0.1, 0.1, 1, post="conv_id").select("conv_id", "turn_id", "split")


@query(f"""WITH {_TURNS}, y AS (SELECT conv_id, turn_id + CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS turn_id FROM x)
SELECT conv_id, count(DISTINCT turn_id) AS n, max(turn_id) AS top FROM y GROUP BY conv_id
HAVING count(*) FILTER (turn_id % 2 <> 0) > 0 OR max(turn_id) <> 2 * count(DISTINCT turn_id)""")
def badly_numbered_turns(spark, d):
    # a third of the conversations miss their first turn
    k = F.col("k").cast("long") + F.when(F.col("conv_id") % 3 == 0, 2).otherwise(0)
    rows = adapters.turns(spark, d).where("role = 'user' AND k > 0").select("conv_id", k.alias("turn_id"))
    return splits.badly_numbered(rows, "conv_id").select("conv_id", "n", "top")


@query(f"""WITH {PURCHASES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY timestamp, {LINE_KEY_SQL}) AS rn, count(*) OVER () AS n FROM l)
SELECT {LINE_KEY_SQL}, least(floor((rn - 1) / greatest(n // 7, 1)), 6)::INT AS chunk FROM r""")
def chunk_assignment(spark, d):
    df = splits.chunks(adapters.purchases(spark, d), 7, F.floor(F.col("timestamp") / 86400), [F.col("timestamp"), *[F.col(c) for c in LINE_KEY]])
    return df.select(*LINE_KEY, "chunk")


@query(f"""SELECT event_id, ((row_number() OVER (ORDER BY {_hash_sql(3, "event_id")}, event_id) - 1) % 5)::INT AS bucket FROM events""")
def round_robin_buckets(spark, d):
    return splits.assigned_bucket(table(spark, d, "events").select("event_id"), 5, 3, ["event_id"])


@query(f"WITH {PURCHASES_SQL} SELECT {LINE_KEY_SQL}, l_quantity FROM l ORDER BY l_extendedprice DESC, {LINE_KEY_SQL} LIMIT 100")
def sorted_topk(spark, d):
    return incremental.top_rows(adapters.purchases(spark, d).select(*LINE_KEY, "l_quantity"), [F.col("l_extendedprice").desc(), *LINE_KEY], 100)


@query(f"WITH {EVENTS_SQL} SELECT post_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY timestamp, event_id) <= 3")
def rows_per_post_cap(spark, d):
    return history.first_rows(adapters.events(spark, d), 3, ["timestamp", "event_id"], user="post_id").select("post_id", "event_id")


@query(f"WITH {EVENTS_SQL} SELECT post_id, min(timestamp) AS start FROM e GROUP BY post_id")
def post_start_times(spark, d):
    return splits.post_starts(adapters.events(spark, d))


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id HAVING count(*) BETWEEN 55 AND 80),
r AS (SELECT e.*, event_type || CASE WHEN event_id % 3 = 0 THEN ' and more' ELSE '' END AS completion FROM e JOIN a USING (user_id)),
u AS (SELECT user_id, row_number() OVER (ORDER BY {_hash_sql(42, "user_id")}, user_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM r)),
h AS (SELECT r.*, u.rn <= round_even(u.n * 0.1::DOUBLE, 0) AS held, row_number() OVER (PARTITION BY r.user_id ORDER BY timestamp, post_id) AS k, count(*) OVER (PARTITION BY r.user_id) AS m FROM r JOIN u USING (user_id)),
s AS (SELECT *, CASE WHEN held THEN 'unseen_test' WHEN k > m - round_even(m * 0.1::DOUBLE, 0) THEN 'seen_test' END AS part FROM h),
p AS (SELECT event_id, row_number() OVER (ORDER BY {_hash_sql(42, "user_id", "timestamp", "post_id", "completion")}, user_id, timestamp, post_id, completion) AS rn, count(*) OVER () AS n FROM s WHERE part IS NULL),
w AS (SELECT user_id, sum(4 + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END) FILTER (k <= 5) AS words FROM h GROUP BY user_id)
SELECT s.event_id, coalesce(part, CASE WHEN p.rn <= round_even(p.n * 0.9::DOUBLE, 0) THEN 'train' ELSE 'val' END) AS split, coalesce(nullif(props, ''), '{{}}') AS metadata,
  '{{"statistics":["entries: 5","words: ' || words || '"]}}' AS persona, 1::INT AS turn_id FROM s JOIN w USING (user_id) LEFT JOIN p ON p.event_id = s.event_id""")
def processed_interactions(spark, d):
    prompt = F.array(F.struct(F.lit("post").alias("role"), F.col("post_id").alias("content"), F.lit(None).cast("string").alias("metadata")))
    said = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " and more").otherwise(""))
    rows = adapters.events(spark, d).select(prompt.alias("prompt"), said.alias("completion"), "post_id", "user_id", "timestamp", F.col("props").alias("metadata"), "event_id")
    return processor.process(rows, processor.Config(least=55, most=80, history=5)).select("event_id", "split", "metadata", "persona", "turn_id")


# ---------------------------------------------------------------- conversations


@query(f"""WITH {_TURNS}, p AS (SELECT conv_id, turn, role, k, coalesce(list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS q, text FROM v)
SELECT conv_id, turn, k::INT AS turn_id, md5(text) AS completion_md5,
 md5(array_to_string(list_transform(q, lambda x: 'Message from ' || x.role || ': ' || chr(10) || '''''''' || chr(10) || x.text || chr(10) || ''''''''), chr(10))) AS prompt_md5
FROM p WHERE role = 'user' AND k > 0""")
def conversation_examples(spark, d):
    df = conversations.examples(table(spark, d, "conversations"))
    return df.select("conv_id", "turn", "turn_id", F.md5("completion").alias("completion_md5"), F.md5(text.format_messages(F.col("prompt"))).alias("prompt_md5"))


@query("""WITH b AS (SELECT *, min(CASE WHEN length(text) % 5 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS f FROM conversations)
SELECT conv_id, turn FROM b WHERE f IS NULL OR turn < f""")
def conversation_takewhile(spark, d):
    return conversations.take_while_good(table(spark, d, "conversations"), F.length("text") % 5 == 0).select("conv_id", "turn")


@query("""WITH b AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn FROM b WHERE NOT (role <> 'assistant' AND n = 1)""")
def conversation_skip_first(spark, d):
    return conversations.without_first(table(spark, d, "conversations"), F.col("role") != "assistant").select("conv_id", "turn")


@query("""SELECT conv_id, turn, arg_max(length(text), CASE WHEN role = 'assistant' THEN turn END) FILTER (role = 'assistant')
 OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::INT AS last_assistant FROM conversations""")
def last_assistant_carry(spark, d):
    df = conversations.carried_last(table(spark, d, "conversations"), F.length("text"), F.col("role") == "assistant", "last_assistant")
    return df.select("conv_id", "turn", "last_assistant")


@query("""SELECT conv_id, coalesce(arg_min('u' || length(text), turn) FILTER (role = 'user' AND length(text) % 2 = 0), 'unknown_user') AS user_id FROM conversations GROUP BY conv_id""")
def first_user_value(spark, d):
    value = F.concat(F.lit("u"), F.length("text").cast("string"))
    return conversations.first_value(table(spark, d, "conversations"), value, (F.col("role") == "user") & (F.length("text") % 2 == 0))


# ---------------------------------------------------------------- joins


@query("""WITH p AS (SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1)
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, x.p_brand AS brand, p.p_name AS item FROM lineitem JOIN part x ON l_partkey = x.p_partkey JOIN p ON p.p_brand = x.p_brand""")
def item_join_last_wins(spark, d):
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    out = joins.last_item_wins(rows, part.select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.col("p_brand").alias("brand"), F.col("p_name").alias("item"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def item_join_missing(spark, d):
    items = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return joins.without_item(table(spark, d, "lineitem"), items, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_default_join(spark, d):
    return joins.with_default(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], quality=-1, toxic=-1)


@query(f"""WITH {PURCHASES_SQL}, m AS (SELECT post_id, user_id, timestamp, l_quantity AS meta FROM l WHERE l_quantity > 25)
SELECT l.l_orderkey, l.l_linenumber, l.post_id, l.l_suppkey, l.l_extendedprice, m.meta FROM l LEFT JOIN m ON l.post_id = m.post_id AND l.user_id = m.user_id AND l.timestamp = m.timestamp""")
def composite_left_join(spark, d):
    rows = adapters.purchases(spark, d)
    side = rows.where("l_quantity > 25").select("post_id", "user_id", "timestamp", F.col("l_quantity").alias("meta"))
    return joins.rejoin(rows, side, ["post_id", "user_id", "timestamp"]).select(*LINE_KEY, "meta")


@query("""SELECT n_nationkey AS nation, n_name AS name, c.n AS customers, s.n AS suppliers FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def bundle_join(spark, d):
    per = lambda t, k: table(spark, d, t).groupBy(F.col(k).alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    out = joins.bundle({"own": names, "customers": per("customer", "c_nationkey"), "suppliers": per("supplier", "s_nationkey")}, "nation")
    return out.select("nation", "own.name", F.col("customers.n").alias("customers"), F.col("suppliers.n").alias("suppliers"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',b' ELSE 'b,' || event_type || ',a' END AS picked FROM events""")
def ordered_lookup(spark, d):
    options = F.create_map(F.lit("x"), F.col("event_type"), F.lit("y"), F.lit("a"), F.lit("z"), F.lit("b"))
    order = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("x"), F.lit("z"))).otherwise(F.array(F.lit("z"), F.lit("x"), F.lit("y")))
    return table(spark, d, "events").select("event_id", F.array_join(study.in_order(options, order), ",").alias("picked"))


# ---------------------------------------------------------------- one row a key


@query("""WITH f AS (SELECT *, CASE WHEN lang = 'en' THEN '' ELSE source || lang END AS k1, md5(text) AS k2 FROM documents),
a AS (SELECT * FROM f WHERE k1 = '' UNION ALL (SELECT * FROM f WHERE k1 <> '' QUALIFY row_number() OVER (PARTITION BY k1 ORDER BY doc_id) = 1))
SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY k2 ORDER BY doc_id) = 1""")
def dedupe_two_key(spark, d):
    df = table(spark, d, "documents")
    return dedupe.two_keys(df, F.when(F.col("lang") == "en", "").otherwise(F.concat("source", "lang")), F.md5("text"), ["doc_id"]).select("doc_id")


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, event_id DESC) = 1")
def last_per_key(spark, d):
    return dedupe.last_per_key(adapters.events(spark, d), ["user_id"], ["timestamp", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def first_per_key(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return dedupe.first_per_key(df, ["h"], [F.col("doc_id")])


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE user_id % 2 = 0)")
def upsert_new_only(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id")
    return dedupe.append_new(events.where("user_id % 2 = 0"), events.where("event_id % 3 = 0"), ["user_id"])


@query("""SELECT event_id, 2 AS version FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 1 FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0""")
def upsert_last_wins(spark, d):
    events = table(spark, d, "events").select("event_id")
    return dedupe.upsert_last(events.where("event_id % 2 = 0").withColumn("version", F.lit(1)), events.where("event_id % 3 = 0").withColumn("version", F.lit(2)), ["event_id"])


@query(f"WITH {PURCHASES_SQL}, {EVENTS_SQL} SELECT user_id, timestamp, 'l' AS config FROM l UNION ALL SELECT user_id, timestamp, 'e' FROM e")
def union_all_sources(spark, d):
    tag = lambda df, name: readers.tagged(df.select("user_id", "timestamp"), name, "all").select("user_id", "timestamp", F.col("__config_name__").alias("config"))
    return dedupe.union_all(tag(adapters.purchases(spark, d), "l"), tag(adapters.events(spark, d), "e"))


@query("SELECT user_id FROM events UNION SELECT o_custkey FROM orders")
def union_keys(spark, d):
    return dedupe.union_keys(table(spark, d, "events").select("user_id"), table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")))


@query("SELECT c_custkey AS user_id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0")
def except_keys(spark, d):
    some = table(spark, d, "orders").where("o_orderkey % 5 = 0")
    return dedupe.missing_keys(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), some.select(F.col("o_custkey").alias("user_id")), ["user_id"])


# ---------------------------------------------------------------- threads and trees

_GAPS = f"""{EVENTS_SQL}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > 86400 THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id)),
t AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS thread_no FROM g)"""


@query(f"WITH {_GAPS} SELECT event_id, user_id, thread_no FROM t")
def gap_sessions(spark, d):
    return threads.gap_sessions(adapters.events(spark, d), 86400, ["user_id"], "timestamp", ["event_id"]).select("event_id", "user_id", "thread_no")


@query(f"""WITH {_GAPS} SELECT event_id, 'thread_' || substr(md5(concat_ws('|', user_id::VARCHAR, first_value(event_id::VARCHAR) OVER w, first_value(timestamp::VARCHAR) OVER w)), 1, 16) AS thread_id
FROM t WINDOW w AS (PARTITION BY user_id, thread_no ORDER BY timestamp, event_id)""")
def thread_ids(spark, d):
    df = threads.gap_sessions(adapters.events(spark, d), 86400, ["user_id"], "timestamp", ["event_id"])
    return threads.thread_ids(df, ["user_id"], "timestamp", ["event_id"], ["event_id", "timestamp"]).select("event_id", "thread_id")


@query("""WITH m AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
SELECT conv_id, turn, k::INT AS turn_id, md5(text) AS completion_md5 FROM m WHERE n >= 2 AND k > 0 AND length(trim(text)) >= 10 AND trim(before) <> trim(text)""")
def thread_replies(spark, d):
    mails = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("user_id"), F.col("text").alias("body"))
    out = threads.reply_examples(mails, ["turn"], thread="conv_id")
    return out.select("conv_id", "turn", F.size("prompt").alias("turn_id"), F.md5("completion").alias("completion_md5"))


_NODES = """nodes AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def _nodes(spark, d):
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    regions = table(spark, d, "region").select(key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    nations = table(spark, d, "nation").select(key("n", "n_nationkey").alias("node_id"), key("r", "n_regionkey").alias("parent_id"))
    suppliers = table(spark, d, "supplier").select(key("s", "s_suppkey").alias("node_id"), key("n", "s_nationkey").alias("parent_id"))
    return dedupe.union_all(regions, nations, suppliers)


@query(f"""WITH RECURSIVE {_NODES}, w AS (SELECT node_id, 0 AS depth, [node_id] AS path FROM nodes WHERE parent_id IS NULL
UNION ALL SELECT n.node_id, depth + 1, list_append(path, n.node_id) FROM w JOIN nodes n ON n.parent_id = w.node_id)
SELECT node_id, depth::INT AS depth, array_to_string(path, '/') AS path FROM w""")
def category_edges_tree(spark, d):
    return trees.flatten(_nodes(spark, d)).select("node_id", "depth", F.array_join("path", "/").alias("path"))


@query(f"""WITH RECURSIVE {_NODES}, k AS (SELECT * FROM nodes WHERE node_id NOT LIKE 'n%3'), w AS (SELECT node_id, 0 AS depth FROM k WHERE parent_id IS NULL
UNION ALL SELECT n.node_id, depth + 1 FROM w JOIN k n ON n.parent_id = w.node_id)
SELECT node_id, depth::INT AS depth FROM w""")
def pruned_tree(spark, d):
    return trees.flatten(_nodes(spark, d), ~F.col("node_id").like("n%3")).select("node_id", "depth")


@query("SELECT n_regionkey AS parent_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS ord, n_nationkey AS node_id FROM nation")
def response_edges(spark, d):
    nodes = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("responses"))
    return trees.edges_of(nodes)


# ---------------------------------------------------------------- sources


@query("SELECT r_name AS name, p.pattern FROM region, (VALUES ('A'), ('.*A$'), ('EUR')) p(pattern) WHERE regexp_matches(r_name, '^(?:' || p.pattern || ')')")
def source_regex_select(spark, d):
    patterns = spark.createDataFrame([("A",), (".*A$",), ("EUR",)], "pattern string")
    return readers.select_sources(table(spark, d, "region").select(F.col("r_name").alias("name")), patterns).select("name", "pattern")


@query("SELECT event_id FROM (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 50) UNION ALL SELECT event_id FROM (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 50)")
def sliced_scan(spark, d):
    events = table(spark, d, "events")
    return readers.sliced([events.where(F.col("event_type") == t).select("event_id") for t in ("click", "view")], 80, 1, ["event_id"])


# ---------------------------------------------------------------- text


@query("""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(CASE WHEN len(w) > 50 THEN array_to_string(w[1:50], ' ') ELSE text END) AS cut_md5 FROM w""")
def word_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.word_truncate(F.col("text"), 50)).alias("cut_md5"))


@query("""SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INT AS words FROM documents WHERE words >= 40""")
def word_count_filter(spark, d):
    return table(spark, d, "documents").where(text.enough_words(F.col("text"), 40)).select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^\\w\\-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS name, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS safe FROM pages")
def sanitize_name(spark, d):
    return table(spark, d, "pages").select("page_id", text.sanitize_name(F.col("url")).alias("name"), text.safe_id(F.col("url")).alias("safe"))


@query(f"SELECT doc_id, regexp_extract(text, '{text.EMAIL}') AS email FROM documents WHERE regexp_matches(text, '{text.EMAIL}')")
def email_extract(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike(text.EMAIL))
    return docs.select("doc_id", text.email_field(F.col("text")).alias("email"))


@query(f"""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Re: Fwd:  ' || event_type WHEN 1 THEN 'FW: RE:' WHEN 2 THEN event_type || ' re:  x' ELSE NULL END AS s FROM events),
n AS (SELECT event_id, trim(regexp_replace(regexp_replace(coalesce(s, ''), '{text.SUBJECT_MARKS}', '', 'g'), '\\s+', ' ', 'g')) AS n FROM s)
SELECT event_id, CASE WHEN n = '' THEN '(no subject)' ELSE n END AS subject FROM n""")
def subject_normalize(spark, d):
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.concat(F.lit("Re: Fwd:  "), "event_type")).when(k == 1, "FW: RE:").when(k == 2, F.concat("event_type", F.lit(" re:  x")))
    return table(spark, d, "events").select("event_id", text.normalize_subject(s).alias("subject"))


@query("""WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(replace(text, '```', ''), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT r, doc_id, unnest(a) AS x, unnest(range(len(a))) AS i, len(a) AS n FROM l),
f AS (SELECT *, i % 3 <> 2 OR x SIMILAR TO '\\s*>.*' AS q FROM e),
g AS (SELECT *, coalesce(lag(q) OVER w, false) AS before, lead(q) OVER w AS after, CASE WHEN i % 3 <> 2 THEN '> ' || x ELSE x END AS line FROM f WINDOW w AS (PARTITION BY r ORDER BY i)),
k AS (SELECT *, CASE WHEN NOT q THEN line ELSE concat_ws(chr(10), CASE WHEN NOT before THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') END, CASE WHEN after = false THEN '[...quoted text...]' END) END AS shown, NOT q OR NOT before OR after = false AS kept FROM g)
SELECT doc_id, md5(regexp_replace(coalesce(string_agg(shown, chr(10) ORDER BY i) FILTER (kept), ''), '^\\s+|\\s+$', '', 'g')) AS clean_md5 FROM k GROUP BY r, doc_id""")
def quote_collapse(spark, d):
    """The first two of every three lines of a document quoted."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 != 2, F.concat(F.lit("> "), x)).otherwise(x))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.clean_text(F.array_join(lines, "\n"))).alias("clean_md5"))


@query("SELECT p_partkey, ltrim('r/' || p_name, 'r/') AS name FROM part")
def charset_strip(spark, d):
    return table(spark, d, "part").select("p_partkey", text.strip_prefix_letters(F.concat(F.lit("r/"), "p_name")).alias("name"))


@query("""SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>')) AS html_md5 FROM conversations""")
def html_escape(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.escape(F.col("text"))).alias("html_md5"))


@query("""SELECT conv_id, turn, md5(trim(text)) AS answer_md5 FROM conversations WHERE turn % 2 = 0 UNION ALL
SELECT conv_id, turn, md5(trim(text)) FROM conversations WHERE turn % 2 = 1""")
def response_extract(spark, d):
    marked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>no</think><response>"), "text", F.lit("</response> x"))).otherwise(F.concat(F.lit("a</think> "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.response_of(marked)).alias("answer_md5"))


@query("""SELECT event_id, (('0x' || substr(md5('42_' || user_id || '_age'), 1, 16))::UBIGINT::HUGEINT * 1616 + ('0x' || substr(md5('42_' || user_id || '_age'), 17, 16))::UBIGINT::HUGEINT) % 10000 / 10000.0::DOUBLE AS draw FROM events""".replace("1616", str(2**64 % 10000)))
def md5_draw(spark, d):
    return table(spark, d, "events").select("event_id", text.md5_share(F.concat_ws("_", F.lit("42"), F.col("user_id").cast("string"), F.lit("age"))).alias("draw"))


@query("""SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS chat_md5 FROM conversations GROUP BY conv_id""")
def chat_template(spark, d):
    item = F.struct("turn", "role", F.col("text").alias("content"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m")).select("conv_id", F.md5(text.chat_template(F.col("m"))).alias("chat_md5"))


@query("""WITH v AS (SELECT doc_id, n_chars * 1000 AS n, CASE WHEN n >= 1073741824 THEN 1073741824.0 WHEN n >= 1048576 THEN 1048576.0 ELSE 1024.0 END AS u FROM documents)
SELECT doc_id, printf('%.2f', floor(n * 100.0::DOUBLE / u + 0.5) / 100) || CASE u WHEN 1024.0 THEN ' KB' WHEN 1048576.0 THEN ' MB' ELSE ' GB' END AS size FROM v""")
def size_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.size_text(F.col("n_chars") * 1000).alias("size"))


@query("""SELECT event_id, 'User ' || user_id || ' did ' || event_type || '.' AS line, string_split(event_type || '_' || event_id, '_')[-1] AS suffix FROM events""")
def template_fill(spark, d):
    return table(spark, d, "events").select(
        "event_id", text.fill("User {u} did {what}.", u=F.col("user_id"), what=F.col("event_type")).alias("line"), text.id_suffix(F.concat_ws("_", "event_type", F.col("event_id").cast("string"))).alias("suffix")
    )


@query("""SELECT o_orderkey, split_part(a, ' ', 1) <> split_part(b, ' ', 1) AS distinct_ranks, s BETWEEN 1 AND 10 AS in_range FROM
(SELECT o_orderkey, o_orderpriority AS a, o_orderstatus || ' x' AS b, o_orderkey % 12 AS s FROM orders)""")
def study_validation(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", text.distinct_ranks(F.col("o_orderpriority"), F.concat("o_orderstatus", F.lit(" x"))).alias("distinct_ranks"), (F.col("o_orderkey") % 12).between(1, 10).alias("in_range"))


# ---------------------------------------------------------------- JSON and time


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field_extract(spark, d):
    named = jsonops.renamed_fields(F.col("props"), {"k": "deep"})
    return table(spark, d, "events").select("event_id", F.get_json_object(named, "$.deep").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN (props->>'$.k') = '0' THEN '' ELSE 'k=' || (props->>'$.k') END AS enrichment FROM events")
def json_enrichment_text(spark, d):
    return table(spark, d, "events").select("event_id", jsonops.enrichment_text(F.col("props"), ["k", "absent.path"]).alias("enrichment"))


@query("""SELECT event_id, event_type || CASE WHEN (props->>'$.k') = '0' THEN '' ELSE chr(10) || '[Additional Context: k=' || (props->>'$.k') || ']' END AS described FROM events""")
def context_suffix(spark, d):
    return table(spark, d, "events").select("event_id", jsonops.with_context(F.col("event_type"), F.col("props"), ["k"]).alias("described"))


@query("""SELECT event_id, (props->>'$.k') AS value FROM events""")
def renamed_json(spark, d):
    renamed = jsonops.renamed_fields(F.col("props"), {"k": "kind", "none": "gone"})
    return table(spark, d, "events").select("event_id", F.get_json_object(renamed, "$.kind").alias("value"))


@query("SELECT event_id, event_type AS type, (props->>'$.k')::BIGINT AS k FROM events")
def tolerant_json(spark, d):
    near = F.concat(F.lit("here: {'type': '"), "event_type", F.lit("', 'props': "), "props", F.lit(", 'ok': true,}"))
    parsed = jsonops.read_object(near)
    return table(spark, d, "events").select("event_id", F.get_json_object(parsed, "$.type").alias("type"), F.get_json_object(parsed, "$.props.k").cast("long").alias("k"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, timestamp AS seconds, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC' AS readable FROM e")
def epoch_normalize(spark, d):
    ts = F.when(F.col("event_id") % 2 == 0, F.col("timestamp") * 1000).otherwise(F.col("timestamp"))
    return adapters.events(spark, d).select("event_id", timeparse.epoch_seconds(ts).alias("seconds"), timeparse.readable_time(ts).alias("readable"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, timestamp - CASE WHEN event_id % 5 = 2 THEN timestamp % 60 ELSE 0 END AS seconds, timestamp AS iso, CASE WHEN event_id % 2 = 0 THEN timestamp ELSE 0 END AS article FROM e")
def multi_format_date(spark, d):
    e = adapters.events(spark, d).withColumn("t", F.timestamp_seconds("timestamp"))
    forms = ["EEE, d MMM yyyy HH:mm:ss '+0000 (UTC)'", "yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy h:mm a", "MM/dd/yyyy hh:mm:ss a", "d MMM yyyy HH:mm:ss '+0000'"]
    shown = F.date_format("t", forms[-1])
    for i, f in enumerate(forms[:-1]):
        shown = F.when(F.col("event_id") % 5 == i, F.date_format("t", f)).otherwise(shown)
    article = F.when(F.col("event_id") % 2 == 0, F.date_format("t", "yyyy-MM-dd HH:mm:ss")).otherwise("never")
    return e.select("event_id", timeparse.mail_epoch(shown).alias("seconds"), timeparse.iso_epoch(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), timeparse.article_epoch(article).alias("article"))


# ---------------------------------------------------------------- book-style rows, and windows beyond the batch operators


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, p_name || ': ' || p_brand || ', ' || p_type AS content, l_partkey::VARCHAR AS post_id, o_custkey::VARCHAR AS user_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""")
def review_rows(spark, d):
    rows = adapters.purchases(spark, d)
    items = table(spark, d, "part").select(F.col("p_partkey").alias("post_id"), F.concat_ws(": ", "p_name", F.array_join(F.array("p_brand", "p_type"), ", ")).alias("content"))
    out = joins.last_item_wins(rows, items.withColumn("seq", F.lit(0)), ["post_id"], ["seq"])
    prompt = F.array(F.struct(F.lit("item").alias("role"), "content", F.to_json(F.struct("l_quantity")).alias("metadata")))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", prompt[0]["content"].alias("content"), F.col("post_id").cast("string"), F.col("user_id").cast("string"))


@query("SELECT date_trunc('day', ts) AS start, count(*) AS rows FROM events GROUP BY 1")
def daily_windows(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "rows")


@query(f"WITH {_GAPS} SELECT user_id, thread_no, count(*) AS rows FROM t GROUP BY user_id, thread_no")
def session_sizes(spark, d):
    return threads.gap_sessions(adapters.events(spark, d), 86400, ["user_id"], "timestamp", ["event_id"]).groupBy("user_id", "thread_no").agg(F.count(F.lit(1)).alias("rows"))




# ---------------------------------------------------------------- studies, listings, completeness

_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@query(f"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN {_WORDS} < 25 THEN 'user_response' END, CASE WHEN turn NOT BETWEEN 1 AND 10 THEN 'score_0' END,
CASE WHEN role = 'user' THEN 'ranks' END], lambda x: x IS NOT NULL), ',') AS problems FROM conversations""")
def submission_problems(spark, d):
    df = table(spark, d, "conversations")
    found = study.problems({"user_response": F.col("text")}, [F.col("turn")], [F.col("role"), F.lit("user")])
    return df.select("conv_id", "turn", F.array_join(found, ",").alias("problems"))


@query("""SELECT o_orderkey, array_to_string(list_transform(list_sort([{'r': substr(o_orderpriority, 1, 1), 'k': 'a'}, {'r': coalesce(CASE WHEN o_orderkey % 2 = 0 THEN '2' END, '9'), 'k': 'b'}, {'r': '3', 'k': 'c'}]), lambda x: x.k), '') AS ranked FROM orders""")
def ranked_options(spark, d):
    ranks = F.create_map(F.lit("a"), F.substring("o_orderpriority", 1, 1), F.lit("b"), F.when(F.col("o_orderkey") % 2 == 0, "2"), F.lit("c"), F.lit("3"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(study.by_rank(ranks), "").alias("ranked"))


@query("""SELECT user_id, array_to_string(list_transform(list_sort(list_transform(['base', 'tuned', 'user'], lambda o: {'h': md5('5|' || user_id || '|' || o), 'o': o})), lambda x: x.o), ',') AS shown
FROM (SELECT DISTINCT user_id FROM events)""")
def shown_orders(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.array_join(study.shown_order(["base", "tuned", "user"], F.col("user_id"), 5), ",").alias("shown"))


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT max(timestamp) AS now FROM e) SELECT event_id FROM e, m WHERE now - timestamp <= 30 * 86400 ORDER BY value DESC, timestamp DESC, event_id LIMIT 40""")
def top_of_month(spark, d):
    events = adapters.events(spark, d)
    now = events.agg(F.max("timestamp")).first()[0] or 0
    posts = events.select(F.col("event_id").alias("id"), F.col("timestamp").alias("created"), F.col("value").alias("score"), F.lit(0).alias("comments"))
    return incremental.listing(posts, "top", "month", now, 40).select(F.col("id").alias("event_id"))


@query("""WITH h AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1), x AS (SELECT o_orderkey AS key, 3 AS items FROM orders)
SELECT key, items, coalesce(n, 0) AS have FROM x LEFT JOIN h ON key = l_orderkey WHERE coalesce(n, 0) < items""")
def incomplete_orders(spark, d):
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit(3).alias("items"))
    return incremental.incomplete(expected, table(spark, d, "lineitem").where("l_linenumber < 4").select(F.col("l_orderkey").alias("key")), "key")


@query("""SELECT conv_id, coalesce(nullif(string_agg(replace(text, chr(10), ' '), ' ' ORDER BY turn) FILTER (role = 'assistant'), ''), nullif(string_agg(replace(text, chr(10), ' '), ' ' ORDER BY turn) FILTER (role = 'user'), ''), 'Not available.') AS line
FROM conversations GROUP BY conv_id""")
def transcript_lines(spark, d):
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    only = lambda role: F.filter("t", lambda x: x["role"] == role)
    return lines.select("conv_id", study.transcript_text(only("assistant"), only("user")).alias("line"))


@query("""SELECT event_id, CASE WHEN (props->>'$.k') IS NULL THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, true AS empties_gone FROM events""")
def cleaned_objects(spark, d):
    nested = F.concat(F.lit('{"drop": 1, "a": {"b": {}}, "keep": '), "props", F.lit("}"))
    clean = jsonops.cleaned_json(nested, ["drop"])
    return table(spark, d, "events").select("event_id", F.get_json_object(clean, "$.keep.k").cast("long").alias("k"), (F.get_json_object(clean, "$.a").isNull() & F.get_json_object(clean, "$.drop").isNull()).alias("empties_gone"))


# ---------------------------------------------------------------- streams, read to their end


def _event_stream(spark, d):
    path = f"{d}/event[s].parquet"  # a pattern: a stream reads folders and patterns, not single files
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return stream.withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))


@query(f"WITH {_GAPS} SELECT user_id, count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last FROM t GROUP BY user_id, thread_no")
def streaming_sessions(spark, d):
    out = drain.drained(stateful.sessions(_event_stream(spark, d), ["user_id"], "ts", "1 day", "10000 days"), "complete")
    return out.select("user_id", "rows", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_new_only(spark, d):
    return drain.drained(stateful.new_only(_event_stream(spark, d), ["user_id", "event_type"], "ts", "10000 days"), "append").select("user_id", "event_type")


@query("SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS rows FROM events GROUP BY 1")
def streaming_hours(spark, d):
    out = drain.drained(stateful.windowed_counts(_event_stream(spark, d), "ts", "1 hour", delay="10000 days"), "complete")
    return out.select(F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "rows")

from threadloom.plans import extended, products  # noqa: E402, F401  their queries register themselves
