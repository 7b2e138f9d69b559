"""Small builders for hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

EVENT_SCHEMA = (
    "device string, device_order bigint, input_order bigint, event_id string, ts timestamp_ntz, source string, session string, "
    "model string, project string, fingerprint string, activity string, cost decimal(28,9), calls bigint, fresh_input bigint, "
    "cache_read bigint, cache_write bigint, output bigint"
)
START = datetime(2024, 3, 1, 12, 0, 0)
BASE, INC = "ccSwitch", "codeburnIncrement"


def at(ms: int) -> datetime:
    return START + timedelta(milliseconds=ms)


def event(event_id, ms=0, source=BASE, session="s", model="m", project=None, fingerprint=None, activity=None, device="A",
          order=None, cost="1.0", tokens=(10, 0, 0, 1)):
    return (
        device, ord(device) - ord("A"), order if order is not None else int.from_bytes(str(event_id).encode()[-4:], "big"),
        str(event_id), at(ms), source, session, model, project, fingerprint, activity, Decimal(cost), 1, *tokens,
    )


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


USAGE_SCHEMA = (
    "ts timestamp_ntz, session string, model string, project string, activity string, fresh_input bigint, cache_read bigint, "
    "cache_write bigint, output bigint, calls bigint, cost decimal(28,9), account string"
)


def usage(spark, rows):
    return spark.createDataFrame(rows, USAGE_SCHEMA)


def call(ts, session="s1", model="m1", project="p1", activity="coding", tokens=(1, 0, 0, 0), calls=1, cost="1", account="x"):
    return (datetime.fromisoformat(ts), session, model, project, activity, *tokens, calls, Decimal(cost), account)
