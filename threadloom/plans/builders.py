"""Builders: each source's raw rows become interactions (prompt, completion, post_id, user_id, timestamp, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text, timeparse
from threadloom.functions.mailparse import parsed_mail
from threadloom.operators import dedupe, joins, threads, trees

UNKNOWN_USER, NO_TRANSCRIPT, TRANSCRIPT_WORDS = "unknown_user", "Not available.", 2048
COLUMNS = ["prompt", "completion", "post_id", "user_id", "timestamp", "metadata"]


def item(role: Column, content: Column, metadata: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), content.alias("content"), metadata.alias("metadata"))


def chat(conversations: DataFrame, language: str = "English") -> DataFrame:
    """One row for each user turn after the first; the prompt is all turns before, users named by their address, the
    assistant by its model. A conversation stops at its first turn in another language or without text. All of it
    happens within a conversation's own row."""
    named = F.coalesce(F.nullif(F.col("hashed_ip"), F.lit("")), F.lit(UNKNOWN_USER))
    turns = F.col("conversation")
    bad = F.transform(turns, lambda t: ~t["language"].eqNullSafe(F.lit(language)) | (text.strip(F.coalesce(t["content"], F.lit(""))) == ""))
    stop = F.array_position(bad, F.lit(True))
    df = conversations.withColumn("good", F.slice(turns, F.lit(1), F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.size(turns))))
    about = lambda t, *more: F.to_json(F.struct(*more, *[t[c].alias(c) for c in ("language", "state", "country")], *[F.coalesce(t[c], F.lit(False)).alias(c) for c in ("redacted", "toxic")], t["turn_identifier"].alias("turn_identifier")))
    assistant_about = lambda t: F.to_json(F.struct(F.col("model").alias("model"), t["language"].alias("language"), *[F.coalesce(t[c], F.lit(False)).alias(c) for c in ("redacted", "toxic")], t["turn_identifier"].alias("turn_identifier")))
    is_assistant = lambda t: t["role"] == "assistant"
    person = lambda t: F.coalesce(F.nullif(t["hashed_ip"], F.lit("")), F.lit(UNKNOWN_USER))
    items = F.transform("good", lambda t: item(F.when(is_assistant(t), F.col("model")).otherwise(person(t)), t["content"], F.when(is_assistant(t), assistant_about(t)).otherwise(about(t))))
    first_ip = F.get(F.filter(turns, lambda t: (t["role"] == "user") & (t["hashed_ip"] != "")), F.lit(0))["hashed_ip"]
    df = df.withColumn("items", items).withColumn("user_id", F.coalesce(first_ip, named))
    df = df.select("*", F.posexplode("good").alias("at", "own"))
    before = F.slice("good", F.lit(1), F.col("at"))
    df = df.where(~is_assistant(F.col("own")) & F.exists(before, lambda t: ~is_assistant(t)))
    answered = F.filter(before, is_assistant)
    last = F.when(F.size(answered) > 0, F.element_at(answered, -1)["timestamp"])
    seconds = F.coalesce(F.nullif(F.unix_timestamp(last), F.lit(0)), F.unix_timestamp("timestamp"), F.lit(0))
    return df.select(
        F.slice("items", F.lit(1), F.col("at")).alias("prompt"), F.col("own.content").alias("completion"), F.col("conversation_hash").alias("post_id"), "user_id",
        seconds.alias("timestamp"), about(F.col("own"), F.col("conversation_hash").alias("conversation_hash")).alias("metadata"),
    )


def book(reviews: DataFrame, items: DataFrame, seq: str) -> DataFrame:
    """One row a review of a known item; of items that come twice the last by `seq` counts. Descriptions are joined by blanks."""
    kept = [c for c in items.columns if c != seq]
    post = item(F.col("store"), F.concat(F.col("title"), F.lit(": "), F.array_join("description", " ")), F.to_json(F.struct(*kept)))
    known = items.withColumn("post", post).select("parent_asin", "post", seq)
    mine = reviews.withColumn("metadata", F.to_json(F.struct(*reviews.columns)))
    out = joins.last_item_wins(mine, known, ["parent_asin"], [seq])
    return out.select(F.array("post").alias("prompt"), F.concat_ws(": ", "title", "text").alias("completion"), F.col("parent_asin").alias("post_id"), "user_id", "timestamp", "metadata")


def lifted_comments(comments: DataFrame) -> DataFrame:
    """Comments with the fields of their snippet that rows are made of."""
    s = F.col("snippet")
    return comments.withColumns({"user_id": s["authorChannelId"]["value"], "timestamp": timeparse.iso_epoch(s["publishedAt"]), "video_id": s["videoId"], "text": s["textOriginal"]})


def news(comments: DataFrame, videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row a comment: the video with its transcript (cut to 2048 words), then the comments above it.

    comments: id, user_id, video_id, timestamp, text, upper_comments array<struct<user_id,text,...>>. Comments whose
    video is missing are `joins.without_item`'s to report."""
    cut = text.word_truncate(F.col("video_transcript"), TRANSCRIPT_WORDS)
    last = transcripts.select("video_id", cut.alias("transcript"))
    told = joins.with_default(videos, last, ["video_id"], transcript=NO_TRANSCRIPT)
    post = told.select("video_id", item(F.col("title"), F.col("description"), F.to_json(F.struct(*told.columns))).alias("post"))
    mine = comments.withColumn("metadata", F.to_json(F.struct(*comments.columns)))
    above = F.transform("upper_comments", lambda c: item(c["user_id"], c["text"], F.to_json(c)))
    return mine.join(post, "video_id").select(F.concat(F.array("post"), above).alias("prompt"), F.col("text").alias("completion"), F.col("video_id").alias("post_id"), "user_id", "timestamp", "metadata")


def alive(body: Column) -> Column:
    return ~F.lower(text.strip(F.coalesce(body, F.lit("")))).isin(*text.DELETED)


def opinion(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """One row a live comment: the post, then the comments above it. A deleted comment takes its replies with it.

    posts: id, title, selftext, author, is_self, subreddit; comments: comment_id, parent_id (null at the top), post_id,
    author, body, created_utc."""
    about = F.to_json(F.struct(*[c for c in posts.columns], F.concat(F.lit("t3_"), F.col("id")).alias("thread_id")))
    post = posts.select(F.col("id").alias("post_id"), item(F.coalesce("author", F.lit("poster")), text.post_content(F.col("title"), F.coalesce("selftext", F.lit("")), F.coalesce("is_self", F.lit(False))), about).alias("post"))
    mine = comments.withColumn("author", F.coalesce("author", F.lit("NA"))).where(alive(F.col("body"))).withColumn("clean", text.clean_text(F.col("body")))
    mine = mine.withColumn("metadata", F.to_json(F.struct("comment_id", "parent_id", "post_id", "author", "created_utc")))
    nodes = mine.select(F.col("comment_id").alias("node_id"), "parent_id", item(F.col("author"), F.col("clean"), F.col("metadata")).alias("item"))
    placed = trees.with_ancestors(nodes).select(F.col("node_id").alias("comment_id"), "above")
    out = mine.join(placed, "comment_id").join(post, "post_id")
    return out.select(F.concat(F.array("post"), "above").alias("prompt"), F.col("clean").alias("completion"), "post_id", F.col("author").alias("user_id"), F.col("created_utc").cast("long").alias("timestamp"), "metadata")


def politics(articles: DataFrame, responses: DataFrame) -> DataFrame:
    """One row a response: its article, then the responses above it; its own id is the post's, its time the article's.

    Both have id, author, content, responses (ids of those below); articles also published_at."""
    about = F.to_json(F.struct("id", "author", F.size("responses").alias("n_responses")))
    entry = item(F.coalesce("author", F.lit("")), F.col("content"), about).alias("item")
    below = trees.edges_of(articles.select("id", "responses")).unionByName(trees.edges_of(responses.select("id", "responses"))).select("parent_id", "node_id")
    known = articles.select(F.col("id").alias("node_id"), entry).unionByName(responses.select(F.col("id").alias("node_id"), entry))
    nodes = known.join(below, "node_id", "left").join(articles.select(F.col("id").alias("node_id"), F.lit(True).alias("root")), "node_id", "left")
    nodes = nodes.where(F.col("root") | F.col("parent_id").isNotNull()).withColumn("parent_id", F.when(F.col("root").isNull(), F.col("parent_id")))
    placed = trees.with_ancestors(nodes).where("depth > 0").select(F.col("node_id").alias("id"), "above", F.element_at("path", 1).alias("article"))
    times = articles.select(F.col("id").alias("article"), timeparse.article_epoch(F.coalesce("published_at", F.lit(""))).alias("timestamp"))
    out = responses.withColumn("metadata", about).join(placed, "id").join(times, "article")
    return out.select(F.col("above").alias("prompt"), F.col("content").alias("completion"), F.col("id").alias("post_id"), F.coalesce("author", F.lit("")).alias("user_id"), "timestamp", "metadata")


def flat_mail(files: DataFrame) -> DataFrame:
    """Mails of files (file, message): seq, file, message_id, user_id, subject, body, timestamp, metadata."""
    rows = files.withColumn("arrival", F.monotonically_increasing_id()).select("file", "arrival", F.posexplode(parsed_mail("message")).alias("at", "m"))
    head = lambda name: F.coalesce(F.element_at(F.col("m.headers"), name), F.lit(""))
    names = {"from": "from", "to": "to", "subject": "subject", "in_reply_to": "in-reply-to", "references": "references", "cc": "cc", "bcc": "bcc", "x_from": "x-from", "x_to": "x-to", "x_folder": "x-folder", "x_origin": "x-origin", "x_filename": "x-filename"}
    body = text.strip(F.col("m.body"))
    about = F.to_json(F.struct(F.trim(head("message-id")).alias("message_id"), *[head(h).alias(n) for n, h in names.items()], F.length(body).alias("body_length"), "file"))
    return rows.select(
        F.struct("arrival", "at").alias("seq"), "file", F.trim(head("message-id")).alias("message_id"), F.nullif(F.lower(head("from")), F.lit("")).alias("user_id"),
        head("subject").alias("subject"), body.alias("body"), F.floor("m.seconds").alias("timestamp"), about.alias("metadata"),
    )


def email(files: DataFrame, gap: int = threads.WEEK, least: int = 2, shortest: int = 10) -> DataFrame:
    """One row a reply in a thread of mails: mails of one file (or subject) without a gap of more than a week.

    Mails that come twice, by id or by sender, time and body, count once, in order of arrival."""
    mails = flat_mail(files).where((F.length("body") >= shortest) & F.col("user_id").isNotNull() & (F.coalesce("timestamp", F.lit(0)) != 0))
    content = F.concat_ws("|", "user_id", F.col("timestamp").cast("string"), F.md5("body"))
    mails = dedupe.two_keys(mails, F.col("message_id"), content, ["seq"])
    mails = mails.withColumn("thread_key", F.coalesce(F.nullif(F.col("file"), F.lit("")), text.normalize_subject(F.col("subject"))))
    mails = threads.gap_sessions(mails, gap, ["thread_key"], "timestamp", ["seq"])
    mails = threads.thread_ids(mails, ["thread_key"], "timestamp", ["seq"], ["message_id", "timestamp"], "mail_")
    out = threads.reply_examples(mails, ["timestamp", "seq"], least, shortest)
    return out.withColumnRenamed("thread_id", "post_id").select(*COLUMNS)
