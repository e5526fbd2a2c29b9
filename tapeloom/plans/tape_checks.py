"""Scans, predicates, validation and identity queries over the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import clock as C
from ..operators.slices import ordered_scan, prev, run_sum
from ..sources import masters, tape as T
from .bindings import BOOKS_SQL, DAY, KEYS, TAPE_SQL, books, slices_for, table, tape, time_slices
from .registry import query


@query(
    "tape_range_scan",
    f"""WITH {TAPE_SQL} SELECT instrument_id, seq, ts_us, channel, value FROM tape
    WHERE ts_us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-20 12:00:00')
      AND channel IN ('view', 'purchase') AND instrument_id IN (1, 3, 7, 8, 46, 52)""",
)
def tape_range_scan(spark, sf):
    rows = T.tape_filter(
        table(spark, sf, "events"),
        start="2024-01-05 00:00:00",
        end="2024-01-20 12:00:00",
        channels=["view", "purchase"],
        instrument_ids=[1, 3, 7, 8, 46, 52],
        ts="ts",
        event_type="event_type",
        instrument="user_id",
    )
    return rows.select(
        F.col("user_id").alias("instrument_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_type").alias("channel"),
        "value",
    )


@query(
    "segment_metadata",
    f"""WITH {TAPE_SQL} SELECT ts_us // {DAY} AS segment, count(*) AS rows, min(seq) AS first_sequence,
      max(seq) AS last_sequence, min(ts_us) AS coverage_start, max(ts_us) AS coverage_end,
      string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(DISTINCT instrument_id) AS instruments
    FROM tape GROUP BY 1""",
)
def segment_metadata(spark, sf):
    rows = tape(spark, sf).withColumn("segment", F.expr(f"ts_us div {DAY}"))
    return T.describe_groups(
        rows, [F.col("segment")], ts="ts_us", seq="seq", channel="channel", instrument="instrument_id"
    ).withColumn("channels", F.array_join("channels", ","))


@query(
    "segment_pruned_scan",
    f"""WITH {TAPE_SQL} SELECT count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seq_sum, round(sum(value), 4) AS value_sum
    FROM tape WHERE ts_us BETWEEN epoch_us(TIMESTAMP '2024-01-10 06:00:00') AND epoch_us(TIMESTAMP '2024-01-12 18:00:00')
      AND channel = 'click'""",
)
def segment_pruned_scan(spark, sf):
    rows = tape(spark, sf).withColumn("segment", F.expr(f"ts_us div {DAY}"))
    lo, hi = 1704866400000000, 1705082400000000
    # The day key prunes a layout partitioned by date; the bounds then cut inside the day.
    kept = rows.where(F.col("segment").between(lo // DAY, hi // DAY)).where(
        F.col("ts_us").between(lo, hi) & (F.col("channel") == "click")
    )
    return kept.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("seq").alias("seq_sum"),
        F.round(F.sum("value"), 4).alias("value_sum"),
    )


@query(
    "receive_sequence_breaks",
    f"""WITH {TAPE_SQL}, s AS (SELECT channel, seq, lag(seq) OVER (PARTITION BY channel ORDER BY seq) AS previous_sequence FROM tape)
    SELECT channel, seq, previous_sequence, seq - previous_sequence - 1 AS missing FROM s
    WHERE previous_sequence IS NOT NULL AND seq - previous_sequence <> 1""",
)
def receive_sequence_breaks(spark, sf):
    rows = tape(spark, sf)
    cuts = slices_for(spark, sf, "tape.seq", rows, "seq")
    return T.sequence_breaks(rows.select("channel", "seq"), ["channel"], "seq", cuts)


@query(
    "source_sequence_flags",
    f"""WITH {TAPE_SQL}, s AS (SELECT *, CASE WHEN seq % 11 = 0 THEN NULL ELSE CAST(floor(value / 10) AS BIGINT) END AS src FROM tape),
    d AS (SELECT *, lag(src) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS prior FROM s),
    f AS (SELECT instrument_id, CASE WHEN src IS NULL THEN 'source_sequence_unavailable'
       WHEN prior IS NULL OR src = prior + 1 THEN NULL WHEN src = prior THEN 'duplicate_sequence'
       WHEN src < prior THEN 'sequence_regression' ELSE 'sequence_gap' END AS flag FROM d)
    SELECT instrument_id, flag, count(*) AS rows FROM f WHERE flag IS NOT NULL GROUP BY 1, 2""",
)
def source_sequence_flags(spark, sf):
    rows = tape(spark, sf).withColumn(
        "src", F.when(F.col("seq") % 11 != 0, F.floor(F.col("value") / 10))
    )
    seen = ordered_scan(rows, KEYS, ["ts_us", "seq"], time_slices(spark, sf), {"prior": prev("src")})
    return (
        seen.withColumn("flag", T.source_sequence_flag(F.col("src"), F.col("prior")))
        .where(F.col("flag").isNotNull())
        .groupBy("instrument_id", "flag")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "break_segments",
    f"""WITH {TAPE_SQL}, s AS (SELECT *, 1 + sum(CASE WHEN channel = 'error' THEN 1 ELSE 0 END)
      OVER (PARTITION BY instrument_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS segment FROM tape)
    SELECT instrument_id, CAST(segment AS BIGINT) AS segment, count(*) AS rows, min(seq) AS first_sequence,
      max(seq) AS last_sequence, min(ts_us) AS first_ts, max(ts_us) AS last_ts FROM s GROUP BY 1, 2""",
)
def break_segments(spark, sf):
    flag = F.when(F.col("channel") == "error", 1).otherwise(0).cast("long")
    seen = ordered_scan(
        tape(spark, sf), KEYS, ["ts_us", "seq"], time_slices(spark, sf), {"breaks": run_sum(flag)}
    )
    return seen.groupBy("instrument_id", (F.col("breaks") + 1).alias("segment")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("seq").alias("first_sequence"),
        F.max("seq").alias("last_sequence"),
        F.min("ts_us").alias("first_ts"),
        F.max("ts_us").alias("last_ts"),
    )


@query(
    "depth_quality_flags",
    f"""WITH {BOOKS_SQL}, f AS (SELECT instrument_id,
      len(bids) = 0 OR len(asks) = 0 AS partial_book,
      coalesce(list_any_value([x FOR x IN [i FOR i IN range(1, len(bids))] IF bids[x].price <= bids[x + 1].price]) IS NOT NULL, false)
        OR coalesce(list_any_value([x FOR x IN [i FOR i IN range(1, len(asks))] IF asks[x].price >= asks[x + 1].price]) IS NOT NULL, false) AS invalid_depth,
      coalesce(bids[1].price >= asks[1].price, false) AS crossed_book FROM books),
    u AS (SELECT instrument_id, unnest(list_filter([CASE WHEN crossed_book THEN 'crossed_book' END,
      CASE WHEN invalid_depth THEN 'invalid_depth' END, CASE WHEN partial_book THEN 'partial_book' END], lambda x: x IS NOT NULL)) AS flag FROM f)
    SELECT instrument_id, flag, count(*) AS rows FROM u GROUP BY 1, 2""",
)
def depth_quality_flags(spark, sf):
    flags = books(spark, sf).select(
        "instrument_id", F.explode(B.depth_flags(F.col("bids"), F.col("asks"))).alias("flag")
    )
    return flags.groupBy("instrument_id", "flag").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "tape_contract_violations",
    """WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 'buy' END AS side,
        CASE WHEN event_id % 10 = 0 THEN 3 WHEN event_id % 7 = 0 THEN -1 END AS incr,
        CASE WHEN event_id % 6 = 0 THEN 'middle' WHEN event_id % 2 = 0 THEN 'bid' END AS update_side,
        event_type FROM events),
    v AS (SELECT unnest(list_filter([
        CASE WHEN event_id < 1 THEN 'sequence_and_epoch_positive' END,
        CASE WHEN update_side IS NOT NULL AND update_side NOT IN ('bid', 'ask', 'both') THEN 'update_side_domain' END,
        CASE WHEN incr <= 0 THEN 'volume_increment_positive' END,
        CASE WHEN side IS NOT NULL THEN 'classification_complete' END,
        CASE WHEN side IS NOT NULL AND event_type NOT IN ('quote', 'full') THEN 'classification_on_prints_only' END
      ], lambda x: x IS NOT NULL)) AS rule FROM t)
    SELECT rule, count(*) AS rows FROM v GROUP BY 1""",
)
def tape_contract_violations(spark, sf):
    i = F.col("event_id")
    none = F.lit(None)
    rows = table(spark, sf, "events").select(
        F.lit("run").alias("run_id"),
        i.alias("receive_sequence"),
        none.cast("long").alias("source_sequence"),
        F.lit(1).alias("connection_epoch"),
        "event_type",
        F.col("user_id").cast("string").alias("instrument_id"),
        F.col("user_id").cast("string").alias("broker_security_id"),
        F.col("ts").cast("timestamp").alias("receive_ts"),
        F.lit(100).cast("long").alias("raw_message_size_bytes"),
        F.lit("primary").alias("connection_id"),
        F.when(i % 6 == 0, "middle").when(i % 2 == 0, "bid").alias("update_side"),
        F.when(i % 10 == 0, 3).when(i % 7 == 0, -1).cast("long").alias("cumulative_volume_increment"),
        *[none.cast("double").alias(c) for c in ("trade_quote_bid", "trade_quote_ask", "trade_quote_age_ms", "trade_quote_freshness_bound_ms")],
        *[none.cast("timestamp").alias(c) for c in ("trade_quote_bid_receive_ts", "trade_quote_ask_receive_ts", "trade_quote_receive_ts")],
        *[none.cast("string").alias(c) for c in ("trade_quote_channel", "trade_classifier_version", "trade_alignment_version", "trade_classification_reason")],
        *[none.cast("boolean").alias(c) for c in ("trade_classification_degraded", "trade_coalesced")],
        F.when(i % 5 == 0, "buy").alias("trade_side"),
    )
    return (
        rows.select(F.explode(T.contract_violations()).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "session_clock_buckets",
    f"""WITH {TAPE_SQL}, l AS (SELECT *, (ts_us + 19800000000) % {DAY} / 1000000.0 AS s FROM tape),
    b AS (SELECT CASE WHEN s >= 33300 AND s < 36000 THEN 'open' WHEN s >= 36000 AND s < 43200 THEN 'morning'
        WHEN s >= 43200 AND s < 50400 THEN 'midday' WHEN s >= 50400 AND s < 54000 THEN 'late'
        WHEN s >= 54000 AND s <= 55800 THEN 'close' END AS bucket,
      strftime(make_timestamp(CAST(floor(s / 1800) * 1800 * 1000000 AS BIGINT)), '%H:%M') || '-' ||
      strftime(make_timestamp(CAST((floor(s / 1800) + 1) * 1800 * 1000000 AS BIGINT)), '%H:%M') AS half_hour,
      s >= 33300 AND s <= 55800 AS in_session FROM l)
    SELECT bucket, half_hour, in_session, count(*) AS rows FROM b GROUP BY ALL""",
)
def session_clock_buckets(spark, sf):
    t = F.col("ts_us")
    return (
        tape(spark, sf)
        .select(
            C.clock_bucket(t).alias("bucket"),
            C.half_hour_label(t).alias("half_hour"),
            C.in_session(t).alias("in_session"),
        )
        .groupBy("bucket", "half_hour", "in_session")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "session_phase_features",
    f"""WITH {TAPE_SQL}, l AS (SELECT *, (ts_us + 19800000000) % {DAY} / 1000000.0 AS s FROM tape),
    f AS (SELECT *, 2 * 3.141592653589793 * (s - 33300) / 22500 AS a FROM l WHERE s >= 33300 AND s <= 55800)
    SELECT seq, round(sin(a), 6) AS phase_sin, round(cos(a), 6) AS phase_cos,
      round((s - 33300) / 60.0, 8) AS minutes_from_open, round((55800 - s) / 60.0, 8) AS minutes_to_close,
      CAST(date_diff('day', CAST(make_timestamp(ts_us + 19800000000) AS DATE), DATE '2024-02-01') AS INTEGER) AS dte FROM f""",
)
def session_phase_features(spark, sf):
    t = F.col("ts_us")
    expiry = F.lit(1706781600000000)
    rows = tape(spark, sf).where(C.in_session(t))
    return rows.select(
        "seq",
        *[F.round(c, 8 if n.startswith("minutes") else 6).alias(n) for n, c in C.session_phase(t).items()],
        C.calendar_days(t, expiry).alias("dte"),
    )


@query(
    "dataset_digest",
    """WITH r AS (SELECT sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type, props)) AS h FROM events)
    SELECT count(*) AS rows, bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS digest FROM r""",
)
def dataset_digest(spark, sf):
    digest = F.sha2(
        F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props"), 256
    )
    return T.dataset_digest(table(spark, sf, "events"), digest)


@query(
    "instrument_identity",
    """WITH i AS (SELECT s_suppkey, 'NSE:NSE_FNO:' || upper(n_name) || ':option:2026-08-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0')
       || ':' || CAST(100 + 50 * (s_suppkey % 40) AS VARCHAR) || ':' || CASE WHEN s_suppkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS instrument_id
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, instrument_id, split_part(instrument_id, ':', 3) AS underlying, split_part(instrument_id, ':', 4) AS kind,
      CAST(split_part(instrument_id, ':', 5) AS DATE) AS expiry, CAST(split_part(instrument_id, ':', 6) AS DOUBLE) AS strike,
      split_part(instrument_id, ':', 7) AS option_type, split_part(instrument_id, ':', 3) || '_OPTIONS' AS tag FROM i""",
)
def instrument_identity(spark, sf):
    key = F.col("s_suppkey")
    named = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    built = named.select(
        "s_suppkey",
        masters.canonical_id(
            F.lit("NSE"),
            F.lit("NSE_FNO"),
            F.col("n_name"),
            F.lit("option"),
            F.concat(F.lit("2026-08-"), F.lpad((1 + key % 28).cast("string"), 2, "0")),
            (100 + 50 * (key % 40)).cast("string"),
            F.when(key % 2 == 0, "CE").otherwise("PE"),
        ).alias("instrument_id"),
    )
    parts = masters.parse_id(F.col("instrument_id"))
    return built.select(
        "s_suppkey",
        "instrument_id",
        *[parts[p].alias(p) for p in ("underlying", "kind", "expiry", "strike", "option_type")],
        F.get(masters.applicability_tags(F.col("instrument_id")), 1).alias("tag"),
    )


@query(
    "iso_timestamps_to_ns",
    """SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ts_ns FROM events""",
)
def iso_timestamps_to_ns(spark, sf):
    text = F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
        F.lit("+00:00"),
    )
    return table(spark, sf, "events").select("event_id", C.iso_to_ns(text).alias("ts_ns"))


@query(
    "open_mapping_decode",
    """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS rows,
      min(sha256('{"channel":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}')) AS identity
    FROM events GROUP BY 1""",
)
def open_mapping_decode(spark, sf):
    k = F.from_json("props", "struct<k:bigint>")["k"]
    rows = table(spark, sf, "events").select(F.col("event_type").alias("channel"), k.alias("k"))
    identity = F.sha2(F.to_json(F.struct("channel", "k")), 256)
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min(identity).alias("identity"))


@query(
    "replay_preview",
    f"""WITH {TAPE_SQL} SELECT instrument_id, seq, ts_us, channel, value FROM tape ORDER BY ts_us, seq LIMIT 200""",
)
def replay_preview(spark, sf):
    return tape(spark, sf).orderBy("ts_us", "seq").limit(200)


@query(
    "channel_counters",
    f"""WITH {TAPE_SQL} SELECT channel, count(*) AS rows, count(DISTINCT instrument_id) AS instruments,
      min(ts_us) AS first_ts, max(ts_us) AS last_ts,
      round(count(*) * 1000000.0 / nullif(max(ts_us) - min(ts_us), 0), 9) AS rows_per_second FROM tape GROUP BY 1""",
)
def channel_counters(spark, sf):
    span = F.max("ts_us") - F.min("ts_us")
    return tape(spark, sf).groupBy("channel").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("instrument_id").alias("instruments"),
        F.min("ts_us").alias("first_ts"),
        F.max("ts_us").alias("last_ts"),
        F.round(F.count(F.lit(1)) * 1e6 / F.when(span > 0, span), 9).alias("rows_per_second"),
    )
