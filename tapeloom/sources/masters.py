"""Instrument masters, option-chain payloads, registries and minute files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_id(
    exchange: Column,
    segment: Column,
    underlying: Column,
    kind: Column,
    expiry: Column | None = None,
    strike: Column | None = None,
    option_type: Column | None = None,
) -> Column:
    """``EXCH:SEG:UNDERLYING:kind[:expiry[:strike[:CE|PE]]]``; missing parts are skipped."""
    parts = [exchange, segment, F.upper(underlying), kind]
    parts += [c.cast("string") for c in (expiry, strike, option_type) if c is not None]
    return F.concat_ws(":", *parts)


def parse_id(instrument_id: Column) -> dict[str, Column]:
    """Parts of a canonical id; strike is null unless numeric."""
    part = F.split(instrument_id, ":")
    kind = F.get(part, 3)
    return {
        "exchange": F.get(part, 0),
        "segment": F.get(part, 1),
        "underlying": F.get(part, 2),
        "kind": kind,
        "expiry": F.try_to_date(F.get(part, 4)),
        "strike": F.when(kind == "option", F.get(part, 5).try_cast("double")),
        "option_type": F.when(kind == "option", F.get(part, 6)),
    }


def applicability_tags(instrument_id: Column) -> Column:
    """Tags a registry rule may name: the id itself and ``SYMBOL_FUTURES`` / ``SYMBOL_OPTIONS``."""
    part = F.split(F.upper(instrument_id), ":")
    plural = F.concat(
        F.get(part, 2), F.lit("_"), F.when(F.get(part, 3) == "FUTURE", "FUTURES").otherwise(F.concat(F.get(part, 3), F.lit("S")))
    )
    return F.array_compact(
        F.array(F.upper(instrument_id), F.when(F.size(part) >= 5, plural))
    )


def _require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"master is missing columns: {missing}")
    return df


def read_master_a(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Compact security master (layout A): one exchange, known kinds, positive numeric ids."""
    raw = _require(
        spark.read.option("header", True).csv(path),
        [
            "SEM_EXM_EXCH_ID", "SEM_SEGMENT", "SEM_SMST_SECURITY_ID", "SEM_INSTRUMENT_NAME",
            "SEM_TRADING_SYMBOL", "SEM_EXPIRY_DATE", "SEM_STRIKE_PRICE", "SEM_OPTION_TYPE",
        ],
    )

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) if name in raw.columns else F.lit("")

    name, segment_code = F.upper(text("SEM_INSTRUMENT_NAME")), F.upper(text("SEM_SEGMENT"))
    kind = (
        F.when(name.startswith("OPT"), "option")
        .when(name.startswith("FUT"), "future")
        .when(name.isin("INDEX", "IDX") | (segment_code == "I"), "index")
        .when((segment_code == "E") | name.isin("EQUITY", "EQ"), "equity")
    )
    segment = (
        F.when(kind.isin("option", "future"), "NSE_FNO")
        .when(kind == "index", "IDX_I")
        .when(kind == "equity", "NSE_EQ")
    )
    trading, custom = text("SEM_TRADING_SYMBOL"), text("SEM_CUSTOM_SYMBOL")
    underlying = (
        F.when(text("SM_SYMBOL_NAME") != "", text("SM_SYMBOL_NAME"))
        .when(trading.contains("-"), F.get(F.split(trading, "-", 2), 0))
        .when(custom != "", F.get(F.split(custom, r"\s+"), 0))
        .otherwise(trading)
    )
    strike = F.when(kind == "option", text("SEM_STRIKE_PRICE").try_cast("double"))
    option_raw = F.upper(text("SEM_OPTION_TYPE"))
    typed = raw.select(
        kind.alias("kind"),
        segment.alias("segment"),
        underlying.alias("underlying"),
        F.try_to_date(F.substring(text("SEM_EXPIRY_DATE"), 1, 10)).alias("expiry"),
        F.when(strike >= 0, strike).alias("strike"),
        F.when((kind == "option") & option_raw.isin("CE", "PE"), option_raw).alias("option_type"),
        text("SEM_SMST_SECURITY_ID").alias("security_id"),
        trading.alias("trading_symbol"),
        text("SEM_LOT_UNITS").try_cast("double").cast("int").alias("lot_size"),
        text("SEM_TICK_SIZE").try_cast("decimal(20,6)").alias("tick_size_paise"),
        F.upper(text("SEM_EXM_EXCH_ID")).alias("exchange"),
    )
    return (
        typed.where(
            (F.col("exchange") == "NSE")
            & F.col("kind").isNotNull()
            & F.col("security_id").rlike("^0*[1-9][0-9]*$")
        )
        .withColumn("instrument_id", _typed_id())
        .withColumn("as_of_date", F.lit(as_of).cast("date"))
    )


def read_master_b(spark: SparkSession, path: str, as_of: str, segment: str = "nse_fo") -> DataFrame:
    """Scrip master (layout B): index futures and options with a resolvable expiry."""
    raw = _require(
        spark.read.option("header", True).csv(path),
        ["pSymbol", "pSymbolName", "pTrdSymbol", "pInstType", "pOptionType"],
    )

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in raw.columns else F.lit("")

    inst = F.upper(text("pInstType"))
    reference = F.upper(text("pScripRefKey"))
    day, month, year = (F.regexp_extract(reference, r"(\d{1,2})([A-Z]{3})(\d{2})", g) for g in (1, 2, 3))
    rebuilt = F.concat(F.lpad(day, 2, "0"), F.initcap(month), F.lit("20"), year)
    expiry = F.coalesce(
        F.try_to_date(F.initcap(F.regexp_replace(text("pExpiryDate"), "-", "")), "ddMMMyyyy"),
        F.try_to_date(text("pExpiryDate")),
        F.when(day != "", F.try_to_date(rebuilt, "ddMMMyyyy")),
    )
    raw_strike = F.coalesce(
        F.when(~text("dStrikePrice").isin("", "-1"), text("dStrikePrice")),
        F.when(~text("dStrikePrice;").isin("", "-1"), text("dStrikePrice;")),
    ).try_cast("double")
    # Strikes may be stored in hundredths, possibly twice over.
    scaled = raw_strike
    for _ in range(4):
        scaled = F.when(scaled >= 100000, scaled / 100).otherwise(scaled)
    kind = F.when(inst == "OPTIDX", "option").otherwise("future")
    option_raw = F.upper(text("pOptionType"))
    typed = raw.where(inst.isin("FUTIDX", "OPTIDX")).select(
        kind.alias("kind"),
        F.lit("NSE_FNO").alias("segment"),
        text("pSymbolName").alias("underlying"),
        expiry.alias("expiry"),
        F.when((kind == "option") & (scaled > 0), scaled).alias("strike"),
        F.when((kind == "option") & option_raw.isin("CE", "PE"), option_raw).alias("option_type"),
        text("pSymbol").alias("instrument_token"),
        text("pTrdSymbol").alias("trading_symbol"),
        F.lit("NSE").alias("exchange"),
        F.lit(segment).alias("exchange_segment"),
    )
    keep = (
        F.col("expiry").isNotNull()
        & (F.col("instrument_token") != "")
        & (F.col("trading_symbol") != "")
        & (
            (F.col("kind") == "future")
            | (F.col("strike").isNotNull() & F.col("option_type").isNotNull())
        )
    )
    return (
        typed.where(keep)
        .withColumn("instrument_id", _typed_id())
        .withColumn("as_of_date", F.lit(as_of).cast("date"))
    )


def _typed_id() -> Column:
    strike = F.regexp_replace(F.col("strike").cast("decimal(20,4)").cast("string"), r"\.?0+$", "")
    return canonical_id(
        F.col("exchange"), F.col("segment"), F.col("underlying"), F.col("kind"),
        F.col("expiry"), strike, F.col("option_type"),
    )


def lookup_unique(requests: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Join requests to a master by ``key``; says ``found``, ``missing`` or ``ambiguous``."""
    counted = master.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*[F.col(c) for c in master.columns if c != key])).alias("__m")
    )
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("found")
    cols = [c for c in master.columns if c != key]
    return requests.join(counted, key, "left").select(
        *requests.columns,
        status.alias("lookup"),
        *[F.when(F.col("__n") == 1, F.col(f"__m.{c}")).alias(c) for c in cols],
    )


CHAIN_SIDE = (
    "struct<security_id:string,last_price:double,top_bid_price:double,top_ask_price:double,"
    "implied_volatility:double,oi:bigint,volume:bigint>"
)


def explode_chain(payloads: DataFrame, payload: str, carry: Sequence[str]) -> DataFrame:
    """Nested chain payload to one row per contract (strike, side)."""
    body = F.from_json(F.col(payload), f"struct<last_price:double,oc:map<string,struct<ce:{CHAIN_SIDE},pe:{CHAIN_SIDE}>>>")
    opened = payloads.select(*carry, body.alias("b")).select(
        *carry, F.col("b.last_price").alias("underlying_last_price"), F.explode("b.oc").alias("strike_raw", "pair")
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("CE").alias("option_type"), F.col("pair.ce").alias("q")),
            F.struct(F.lit("PE").alias("option_type"), F.col("pair.pe").alias("q")),
        )
    )
    return (
        opened.withColumn("s", sides)
        .where(F.col("s.q").isNotNull())
        .select(
            *carry,
            "underlying_last_price",
            F.col("strike_raw").cast("double").alias("strike"),
            F.col("s.option_type").alias("option_type"),
            F.col("s.q.security_id").alias("security_id"),
            F.col("s.q.last_price").alias("last_price"),
            F.col("s.q.top_bid_price").alias("bid"),
            F.col("s.q.top_ask_price").alias("ask"),
            F.col("s.q.implied_volatility").alias("implied_volatility"),
            F.col("s.q.oi").alias("open_interest"),
            F.col("s.q.volume").alias("volume"),
        )
    )


def check_chain(contracts: DataFrame, master: DataFrame) -> DataFrame:
    """Flag contracts that the master does not know under the same strike and side."""
    known = master.select(
        "security_id", F.col("strike").alias("m_strike"), F.col("option_type").alias("m_type"), "instrument_id"
    )
    reason = (
        F.when(F.col("instrument_id").isNull(), "absent_from_master")
        .when((F.col("strike") != F.col("m_strike")) | (F.col("option_type") != F.col("m_type")), "identity_mismatch")
    )
    return contracts.join(known, "security_id", "left").withColumn("problem", reason).drop("m_strike", "m_type")


def read_registry(spark: SparkSession, path: str, list_field: str, schema: T.StructType) -> DataFrame:
    """One row per registry entry from a multi-line JSON document."""
    wrapped = T.StructType([T.StructField(list_field, T.ArrayType(schema))])
    return spark.read.schema(wrapped).option("multiLine", True).json(path).select(F.inline(list_field))


MINUTE = T.StructType(
    [
        T.StructField("datetime", T.StringType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("iv", T.DoubleType()),
        T.StructField("oi", T.DoubleType()),
        T.StructField("spot", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)


def read_minute_files(
    spark: SparkSession, pattern: str, side: str, clocks: Sequence[str] | None = None
) -> DataFrame:
    """Minute CSV files to the quote-panel shape: date and clock cut from the datetime text."""
    rows = (
        spark.read.schema(MINUTE).option("header", True).csv(pattern)
        .withColumn("date", F.substring("datetime", 1, 10))
        .withColumn("clock", F.substring("datetime", 12, 5))
        .withColumn("side", F.lit(side))
    )
    return rows if clocks is None else rows.where(F.col("clock").isin(*clocks))


def read_daily_index(spark: SparkSession, path: str, start: str = "09:15", end: str = "15:30") -> DataFrame:
    """Index prints (datetime, open, close) of CSV files to one row a date: date, open, close, prints.

    Of prints with one timestamp the last in file order counts. A date opens with its first print from
    ``start`` on and closes with its last one up to ``end``; dates without a print in between have no row.
    """
    rows = spark.read.option("header", True).csv(path).select(
        F.col("datetime"), F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("place"),
    )
    prints = rows.where(F.col("datetime").isNotNull()).groupBy("datetime").agg(F.max_by(F.struct("open", "close"), "place").alias("r"))
    prints = prints.select(F.to_date(F.substring("datetime", 1, 10)).alias("date"), F.substring("datetime", 12, 5).alias("clock"), "datetime", "r.*")
    session = prints.where(F.col("clock").between(start, end))
    return session.groupBy("date").agg(F.min_by("open", "datetime").alias("open"), F.max_by("close", "datetime").alias("close"), F.count("*").alias("prints"))
