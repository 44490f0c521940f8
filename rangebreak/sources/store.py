"""The bar store: scans with the holdout seal, session replacement, verdict and event logs.

Bars lie in Parquet under ``interval=.../month=...``; ``tier`` is a column, so a session that moves
between tiers is replaced inside one partition. Times are stored in UTC without zone and read as
local times of the market's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangebreak.functions.frames import require_none, write_stage
from rangebreak.functions.scalars import count_when
from rangebreak.operators.quality import tier_routing

STORE_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("tier", T.StringType()),
        T.StructField("interval", T.StringType()),
        T.StructField("month", T.StringType()),
    ]
)
BAR_FIELDS = ("open", "high", "low", "close", "volume")


class HoldoutIsSealed(Exception):
    """Sealed sessions were asked for without breaking the seal."""


def to_utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def to_local(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


# ---- writes ----------------------------------------------------------------------------


def stored(bars: DataFrame, interval: str, zone: str) -> DataFrame:
    """Bars with a ``tier`` in the stored layout."""
    return bars.select(
        "symbol",
        "session_date",
        F.col("slot").cast("int").alias("slot"),
        to_utc(F.col("ts"), zone).alias("ts"),
        *BAR_FIELDS,
        "tier",
        F.lit(interval).alias("interval"),
        F.date_format("session_date", "yyyy-MM").alias("month"),
    )


def write_store(rows: DataFrame, root: str) -> None:
    """Replace exactly the months present in ``rows``, which must not be read from ``root``.

    Spark rebalances the rows by month to files of its advisory size: a large month gets more
    writers, small ones share one. Rows are sorted within files, which lets a scan skip row groups
    by tier and symbol.
    """
    (
        rows.hint("rebalance", "interval", "month")
        .sortWithinPartitions("interval", "month", "tier", "symbol", "session_date", "slot")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("interval", "month")
        .parquet(root)
    )


def merged_months(existing: DataFrame, incoming: DataFrame, verdicts: DataFrame, zone: str) -> DataFrame:
    """The months that an upsert rewrites, merged, checked and staged outside the store.

    Nothing in the store has changed when this returns or fails. The write that follows reads the stage, so
    it can be repeated if it fails half-way.
    """
    merged = write_stage(upsert_sessions(touched_months(existing, incoming), incoming), "upsert")
    # Quarantine holds sessions for their faults; the rules on bars are for the research tier.
    sound = F.col("tier") == "bars"
    require_none(upsert_violations(incoming.where(sound), verdicts, merged.where(sound), zone), "upsert")
    return merged


def upsert_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming sessions replace their earlier copies in whichever tier holds them."""
    key = ["interval", "symbol", "session_date"]
    kept = existing.join(incoming.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def touched_months(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The existing rows that share a partition with incoming ones: all that a write must rewrite."""
    return existing.join(incoming.select("interval", "month").distinct(), ["interval", "month"], "left_semi")


def upsert_violations(
    incoming: DataFrame, verdicts: DataFrame, merged: DataFrame, zone: str
) -> DataFrame:
    """Duplicate sessions, bars dated outside their session, and timestamps doubled by the merge."""
    session = ["symbol", "session_date"]
    twice = verdicts.groupBy(*session).count().where("count > 1").select(
        *session, F.lit("duplicate session").alias("violation")
    )
    strays = incoming.where(F.to_date(to_local(F.col("ts"), zone)) != F.col("session_date")).select(
        *session, F.lit("bar dated outside its session").alias("violation")
    )
    doubled = (
        merged.groupBy("interval", "tier", "symbol", "ts")
        .agg(F.count("*").alias("n"), F.max("session_date").alias("session_date"))
        .where("n > 1")
        .select(*session, F.lit("duplicate timestamp after merge").alias("violation"))
    )
    return twice.unionByName(strays).unionByName(doubled)


def upsert_audit(existing: DataFrame, incoming: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per incoming session: added or replaced, and what it replaced."""
    key = ["interval", "symbol", "session_date"]
    before = existing.groupBy(*key).agg(
        F.max("tier").alias("previous_tier"), F.count("*").alias("previous_rows")
    )
    arriving = incoming.groupBy(*key, "tier").agg(F.count("*").alias("rows"))
    return (
        arriving.join(before, key, "left")
        .join(verdicts.select("symbol", "session_date", "verdict"), ["symbol", "session_date"], "left")
        .select(
            F.when(F.col("previous_rows").isNull(), F.lit("added")).otherwise(F.lit("replaced")).alias("event"),
            *key,
            "tier",
            "verdict",
            "rows",
            "previous_tier",
            "previous_rows",
        )
    )


def route(bars: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Give each bar the tier of its session's verdict."""
    tiers = tier_routing(verdicts).select("symbol", "session_date", "tier")
    return bars.join(tiers, ["symbol", "session_date"])


# ---- reads -----------------------------------------------------------------------------


def scan_bars(
    spark: SparkSession, root: str, interval: str, zone: str, tier: str = "bars", symbol: str | None = None
) -> DataFrame:
    """Bars of one tier and interval. Interval and month prune partitions; tier and symbol push down."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(root).where(
        (F.col("interval") == interval) & (F.col("tier") == tier)
    )
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    return rows.withColumn("ts", to_local(F.col("ts"), zone)).drop("tier", "interval", "month")


def scan_research_sealed(
    spark: SparkSession, root: str, interval: str, zone: str, holdout_from=None, unsealed: bool = False
) -> DataFrame:
    """Research bars without the sealed sessions. Every consumer reads bars through here."""
    bars = scan_bars(spark, root, interval, zone)
    if holdout_from is None or unsealed:
        return bars
    return bars.where(F.col("session_date") < F.lit(holdout_from).cast("date"))


def scan_holdout(
    spark: SparkSession, root: str, interval: str, zone: str, holdout_from=None, unsealed: bool = False
) -> DataFrame:
    """The sealed sessions; an error while sealed, empty when no seal is set."""
    bars = scan_bars(spark, root, interval, zone)
    if holdout_from is None:
        return bars.where(F.lit(False))
    if not unsealed:
        raise HoldoutIsSealed(f"sessions from {holdout_from} are sealed")
    return bars.where(F.col("session_date") >= F.lit(holdout_from).cast("date"))


def scan_quarantine(spark: SparkSession, root: str, interval: str, zone: str) -> DataFrame:
    return scan_bars(spark, root, interval, zone, tier="quarantine")


def list_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def research_sessions(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "session_date").distinct().orderBy("symbol", "session_date")


# ---- logs ------------------------------------------------------------------------------


#: What a run counts.
RUN_COUNTS = (
    "symbols attempted received missing clean tail_collapsed partial suspect corrupt research "
    "daily_rows daily_corrupt daily_suspect"
).split()
#: Kinds of record in the event log, and their fields. ``seq`` is the order in which records were appended.
EVENT_KINDS = {
    "verdict": "seq int, interval string, symbol string, session_date date, verdict string, bar_count int, reasons array<string>",
    "fetch_run": "seq int, interval string, ts timestamp_ntz, " + ", ".join(f"{c} bigint" for c in RUN_COUNTS),
}


def append_events(records: DataFrame, kind: str, path: str) -> None:
    """Append one JSON line per record; records of every kind share one log."""
    fields = T.StructType.fromDDL(EVENT_KINDS[kind]).fieldNames()
    lines = records.select(F.to_json(F.struct(F.lit(kind).alias("event"), *fields)).alias("value"))
    lines.write.mode("append").text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``event, record`` of every line, parsed once; blank lines are skipped, and a broken line fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.parse_json("value").alias("record")).select(
        F.variant_get("record", "$.event", "string").alias("event"), "record"
    )


def event_violations(events: DataFrame) -> DataFrame:
    """Records of an unknown kind, and records without an interval or a place in the order."""
    unknown = ~F.coalesce(F.col("event").isin(*EVENT_KINDS), F.lit(False))
    lacking = [
        F.when(F.variant_get("record", f"$.{c}", "string").isNull(), F.lit(f"no {c}")) for c in ("interval", "seq")
    ]
    return events.select(
        "event",
        F.coalesce(F.when(unknown, F.lit("unknown kind")), *lacking).alias("violation"),
        F.to_json("record").alias("line"),
    ).where("violation is not null")


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """The records of one kind with its fields as columns; fields that a record lacks are NULL."""
    fields = T.StructType.fromDDL(EVENT_KINDS[kind]).fields
    return events.where(F.col("event") == kind).select(
        *[F.variant_get("record", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields]
    )


def fetch_run(tally: DataFrame, seq: int, interval: str, ts: Column) -> DataFrame:
    """The record of one run, to be appended to the event log."""
    return tally.select(F.lit(seq).alias("seq"), F.lit(interval).alias("interval"), ts.alias("ts"), *RUN_COUNTS)


def latest_verdict(log: DataFrame, interval: str) -> DataFrame:
    """The last record per session within one interval; the log is append-only."""
    newest = W.partitionBy("symbol", "session_date").orderBy(F.desc("seq"))
    return (
        log.where(F.col("interval") == interval)
        .withColumn("age", F.row_number().over(newest))
        .where("age = 1")
        .drop("age")
    )


# ---- delivered rows --------------------------------------------------------------------


def contract_violations(bars: DataFrame) -> DataFrame:
    """Breaches of the bar contract, counted per symbol, plus breaches of the schema itself.

    ``ingest_seq`` is the order of delivery.
    """
    expected = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}
    have = dict(bars.dtypes)
    wrong = [f"column {c} is {have.get(c)}" for c, t in expected.items() if have.get(c) != t]
    spark = bars.sparkSession
    schema = spark.createDataFrame(
        [(None, w, 1) for w in wrong], "symbol string, violation string, rows bigint"
    )
    delivered = W.partitionBy("symbol", "session_date").orderBy("ingest_seq")
    in_time = W.partitionBy("symbol", "session_date").orderBy("ts", "ingest_seq")
    marked = bars.select(
        "symbol",
        (F.lag("ts").over(delivered) > F.col("ts")).alias("backward"),
        (F.lag("ts").over(in_time) == F.col("ts")).alias("repeated"),
    )
    counts = marked.groupBy("symbol").agg(
        count_when(F.col("backward")).alias("backward"), count_when(F.col("repeated")).alias("repeated")
    )
    kinds = F.array(
        F.struct(F.lit("not ascending").alias("violation"), F.col("backward").alias("rows")),
        F.struct(F.lit("duplicate timestamp").alias("violation"), F.col("repeated").alias("rows")),
    )
    empty = bars.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(None).cast("string").alias("symbol"), F.lit("no bars").alias("violation"),
        F.lit(0).cast("bigint").alias("rows"),
    )
    return counts.select("symbol", F.inline(kinds)).where("rows > 0").unionByName(schema).unionByName(empty)


# How vendors name the bar columns.
VENDOR_COLUMNS = {
    "lower": {c: c for c in ("open", "high", "low", "close", "volume")},
    "title": {c: c.title() for c in ("open", "high", "low", "close", "volume")},
}


def vendor_to_bars(raw: DataFrame, zone: str, time_column: str, names: str = "lower", keep_last: bool = True) -> DataFrame:
    """Vendor rows in the bar layout: renamed, cast, in local time, without repeated timestamps.

    A column with a zone is converted; one without is taken as local. With ``keep_last`` the last
    delivered of repeated rows wins, else all stay and ``vendor_violations`` reports them.
    """
    zoned = dict(raw.dtypes)[time_column] == "timestamp"
    ts = F.convert_timezone(None, F.lit(zone), F.col(time_column)) if zoned else F.col(time_column)
    rows = raw.select(
        "symbol",
        ts.alias("ts"),
        *[
            F.col(VENDOR_COLUMNS[names][c]).cast("bigint" if c == "volume" else "double").alias(c)
            for c in BAR_FIELDS
        ],
        "ingest_seq",
    ).withColumn("session_date", F.to_date("ts"))
    if not keep_last:
        return rows
    newest = W.partitionBy("symbol", "ts").orderBy(F.desc("ingest_seq"))
    return rows.withColumn("age", F.row_number().over(newest)).where("age = 1").drop("age")


def vendor_violations(bars: DataFrame) -> DataFrame:
    """Rows with a missing value, and repeated timestamps."""
    null_row = F.greatest(*[F.col(c).isNull().cast("int") for c in BAR_FIELDS]) == F.lit(1)
    missing = bars.where(null_row).select("symbol", "ts", F.lit("missing value").alias("violation"))
    repeated = (
        bars.groupBy("symbol", "ts").count().where("count > 1")
        .select("symbol", "ts", F.lit("repeated timestamp").alias("violation"))
    )
    return missing.unionByName(repeated)
