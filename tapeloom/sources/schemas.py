"""Stored row layouts and the check that a table honours one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICE = T.DecimalType(38, 12)
LEVEL = T.StructType(
    [
        T.StructField("price", PRICE, False),
        T.StructField("quantity", T.LongType(), False),
        T.StructField("orders", T.IntegerType(), False),
    ]
)


def _fields(text: str) -> list[T.StructField]:
    """``name type`` lines; a trailing ``!`` marks a required field."""
    kinds = {
        "string": T.StringType(),
        "long": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "bool": T.BooleanType(),
        "time": T.TimestampType(),
        "price": PRICE,
        "ladder": T.ArrayType(LEVEL, containsNull=False),
        "strings": T.ArrayType(T.StringType()),
    }
    out = []
    for line in text.strip().splitlines():
        name, kind = line.split()
        out.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return out


# The stored tape row (instants in UTC; prices as decimal(38,12)).
TAPE = T.StructType(
    _fields(
        """
        run_id string!
        receive_sequence long!
        source_sequence long
        connection_epoch int!
        source string!
        event_type string!
        instrument_id string!
        broker_security_id string!
        exchange_segment string!
        exchange_ts time
        receive_ts time!
        raw_message_size_bytes long!
        connection_id string!
        update_side string
        last_price price
        last_quantity long
        cumulative_volume long
        cumulative_volume_increment long
        open_interest long
        trade_quote_bid price
        trade_quote_ask price
        trade_quote_channel string
        trade_quote_bid_receive_ts time
        trade_quote_ask_receive_ts time
        trade_quote_receive_ts time
        trade_quote_age_ms double
        trade_quote_freshness_bound_ms double
        trade_side string
        trade_classifier_version string
        trade_alignment_version string
        trade_classification_degraded bool
        trade_classification_reason string
        trade_coalesced bool
        bids ladder!
        asks ladder!
        quality_flags strings!
        """
    )
)

# The stored bar row.
BARS = T.StructType(
    _fields(
        """
        schema_version string!
        instrument_id string!
        broker_security_id string!
        interval string!
        bar_start time!
        bar_end time!
        open price!
        high price!
        low price!
        close price!
        volume long!
        open_interest long
        source string!
        category string!
        """
    )
)


def schema_problems(df: DataFrame, expected: T.StructType) -> list[str]:
    """Missing, mistyped or non-nullable extra fields; an empty list means the table conforms."""
    have = {f.name: f for f in df.schema}
    problems = []
    for field in expected:
        found = have.pop(field.name, None)
        if found is None:
            problems.append(f"missing field {field.name}")
        elif found.dataType.simpleString() != field.dataType.simpleString():
            problems.append(
                f"field {field.name} is {found.dataType.simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    problems += [f"extra field {name} must be nullable" for name, f in have.items() if not f.nullable]
    return problems
