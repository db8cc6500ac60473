"""Streaming queries over ``events``: a stream over what is there gives the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators.graph import settled
from quillmesh.plans.book import Book
from quillmesh.streaming import timers, windows

BOOK = Book()


def _shared(spark):
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quillmesh.shared.dir", None)
    if not at:  # settled() makes and remembers the folder of sessions without one
        settled(spark.range(1), "probe")
        at = spark.conf.get("spark.quillmesh.shared.dir")
    return at


def _events(spark, d):
    return windows.stream_of(spark, d, "events")


def _start(df, *more):
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *more)


@BOOK.add("st_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_tumbling(spark, d):
    out = windows.run_to_table(windows.tumbling(_events(spark, d), "ts", "1 hour", ("event_type",), "value", "1 day"), _shared(spark), "complete")
    return _start(out, "event_type", "n", F.round("total", 4).alias("total"))


@BOOK.add(
    "st_sliding",
    "WITH x AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s, event_type, value FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL",
)
def st_sliding(spark, d):
    out = windows.run_to_table(windows.sliding(_events(spark, d), "ts", "12 hours", "6 hours", ("event_type",), "value", "1 day"), _shared(spark), "complete")
    return _start(out, "event_type", "n", F.round("total", 4).alias("total"))


@BOOK.add(
    "st_session",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def st_session(spark, d):
    out = windows.run_to_table(windows.sessions(_events(spark, d), "ts", "12 hours", ("user_id",), "1 day"), _shared(spark), "complete")
    return _start(out, "user_id", "n")


@BOOK.add("st_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def st_dedup(spark, d):
    """Every event twice in the stream, counted once."""
    twice = _events(spark, d).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    kept = windows.deduplicated(twice, ["event_id"], "ts", "40 days")
    return windows.run_to_table(kept.select("event_id", "user_id", "event_type"), _shared(spark)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@BOOK.add("stream_redact")
def stream_redact(spark, d):
    """Conversations as streams of pieces, redacted with what is held back between them."""
    from quillmesh.streaming.redactor import redact_stream, state_store

    pieces = windows.stream_of(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("int").alias("seq"), F.col("text").alias("piece"), F.lit(True).alias("last"))
    with state_store(spark):
        return windows.run_to_table(redact_stream(pieces), _shared(spark))


_MS = "(epoch_us(ts) // 1000)"


@BOOK.add(
    "st_expired",
    f"""WITH a AS (SELECT user_id, {_MS} AS ms, lead({_MS}) OVER (PARTITION BY user_id ORDER BY ts) AS nx, max({_MS}) OVER () - 86400000 AS mark FROM events)
    SELECT user_id::VARCHAR AS key, ms + 43200000 AS ended FROM a WHERE nx - ms > 43200000 OR (nx IS NULL AND ms + 43200000 <= mark)""",
)
def st_expired(spark, d):
    """Sessions of users that timers ended twelve hours after their last event."""
    from quillmesh.streaming.redactor import state_store

    with state_store(spark):
        return windows.run_to_table(timers.expiries(_events(spark, d), "user_id", "ts", 720, "1 day"), _shared(spark))


@BOOK.add(
    "st_stale_runs",
    f"""WITH RECURSIVE e AS (SELECT user_id, {_MS} AS ms, (event_type = 'purchase')::INTEGER AS mark, row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_type = 'purchase') AS k FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS open, NULL::BIGINT AS started, NULL::VARCHAR AS status FROM e
          UNION ALL SELECT r.user_id, e.k, CASE WHEN mark = 1 THEN NULL WHEN open IS NULL OR ms - open > 18000000 THEN ms ELSE open END,
            CASE WHEN ms - open > 18000000 OR mark = 1 THEN open END, CASE WHEN ms - open > 18000000 THEN 'abandoned' WHEN mark = 1 AND open IS NOT NULL THEN 'finished' END
          FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
    z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS last FROM r)
    SELECT user_id::VARCHAR AS key, started, status FROM r WHERE status IS NOT NULL
    UNION ALL SELECT user_id::VARCHAR, open, 'abandoned' FROM z WHERE last = 1 AND open + 18000000 <= (SELECT max({_MS}) - 86400000 FROM events)""",
)
def st_stale_runs(spark, d):
    """Runs of users, from an event to a purchase, that finished or were abandoned after five hours."""
    from quillmesh.streaming.redactor import state_store

    with state_store(spark):
        return windows.run_to_table(timers.run_ends(_events(spark, d), "user_id", "ts", F.col("event_type") == "purchase", 300, "1 day"), _shared(spark))
