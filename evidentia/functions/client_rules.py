"""Column rules of the review client: sizes, values, errors, readiness and state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The client's texts and accepted media types.
UNKNOWN_TYPE = "Unknown browser MIME type"
NOT_JSON = "Backend returned a response that was not valid JSON."
CONNECTIONS = {"unknown": "Not checked", "checking": "Checking", "online": "Online", "offline": "Offline"}
MEDIA_TYPES = ("image/png", "image/jpeg", "image/webp")
WORKFLOWS = ("document", "media")
#: All Unicode white space; the client's trim takes these off, SQL's only spaces.
_SPACES = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def format_bytes(size: Column) -> Column:
    """Bytes, then KB and MB with one decimal; a tie goes to the larger value. There is no GB."""
    tenths = lambda unit: F.floor(size * 10 / unit + 0.5).cast("long")
    shown = lambda t, name: F.concat((t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {name}"))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, shown(tenths(1024), "KB"))
        .otherwise(shown(tenths(1024 * 1024), "MB"))
    )


def client_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACES}+|{_SPACES}+$", "")


def humanize(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(" "))


def _indented(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False))


def pretty_value(value: Column) -> Column:
    """A VARIANT as the client shows it: null as the word, scalars as text, the rest as indented JSON.

    Only objects and arrays reach the Python formatter; scalars stay in the JVM."""
    kind = F.schema_of_variant(value)
    pretty = F.pandas_udf(_indented, StringType())
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit("null"))
        .when(nested, pretty(F.when(nested, F.to_json(value))))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def file_type(media_type: Column) -> Column:
    return F.coalesce(F.nullif(media_type, F.lit("")), F.lit(UNKNOWN_TYPE))


def route(workflow: Column) -> Column:
    return F.when(workflow == "document", "document").otherwise("media")


def backend_url(configured: Column, default: str) -> Column:
    """The configured address or the default, less one trailing slash."""
    return F.regexp_replace(F.coalesce(F.nullif(configured, F.lit("")), F.lit(default)), "/$", "")


def can_analyze(has_file: Column, key: Column, run_state: Column) -> Column:
    return F.coalesce(has_file & (client_trim(key) != "") & (run_state != "running"), F.lit(False))


def response_payload(body: Column) -> Column:
    """The body as a VARIANT; what is not JSON becomes an object with an error."""
    return F.coalesce(F.try_parse_json(body), F.parse_json(F.lit(json.dumps({"error": NOT_JSON}))))


def error_message(payload: Column, http_status: Column) -> Column:
    """Null where the request went well. Only a text counts as the backend's own message."""
    own = F.try_variant_get(payload, "$.error", "string")
    is_text = F.schema_of_variant(F.try_variant_get(payload, "$.error", "variant")) == "STRING"
    general = F.format_string("Backend request failed with HTTP %d.", http_status)
    failed = (http_status < 200) | (http_status > 299)
    return F.when(failed, F.coalesce(F.when(is_text, own), general))


def shows_panel(payload: Column, error: Column) -> Column:
    """A JSON null is a success without anything to show."""
    falsy = F.is_variant_null(payload) | F.try_variant_get(payload, "$", "string").isin("", "0", "false") & ~F.schema_of_variant(payload).startswith("OBJECT")
    result = F.when(error.isNull(), ~F.coalesce(falsy, F.lit(False))).otherwise(F.lit(False))
    return result | (F.coalesce(error, F.lit("")) != "")


def response_entries(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row for each top-level entry: the other columns, key, label and value as the client shows it.

    Objects give their keys, arrays their places; a body that is not JSON gives one entry, ``error``;
    null, texts, numbers and flags give none."""
    own = [c for c in responses.columns if c != body]
    payloads = responses.withColumn("payload", response_payload(F.col(body))).withColumn("kind", F.schema_of_variant("payload"))
    as_map = F.from_json(F.to_json("payload"), "map<string,variant>")
    as_list = F.from_json(F.to_json("payload"), "array<variant>")
    keyed = payloads.filter(F.col("kind").startswith("OBJECT")).select(*own, F.explode(as_map).alias("key", "value"))
    placed = payloads.filter(F.col("kind").startswith("ARRAY")).select(*own, F.posexplode(as_list).alias("at", "value"))
    rows = keyed.unionByName(placed.select(*own, F.col("at").cast("string").alias("key"), "value"))
    return rows.select(*own, "key", humanize(F.col("key")).alias("label"), pretty_value(F.col("value")).alias("value"))


def readiness(files: DataFrame) -> DataFrame:
    """The client's three readiness rows as columns; needs has_file, api_key and connection."""
    return files.withColumns({
        "file_ready": F.when(F.col("has_file"), "Ready").otherwise("Required"),
        "key_ready": F.when(client_trim(F.col("api_key")) != "", "Provided").otherwise("Required"),
        "connection_text": F.create_map(*[F.lit(x) for pair in CONNECTIONS.items() for x in pair])[F.col("connection")],
    })


def connection_after(event: Column, ok: Column) -> Column:
    """Connection state after one event; null where the event leaves it alone."""
    return (
        F.when(event == "health_started", "checking")
        .when(event == "health", F.when(F.coalesce(ok, F.lit(False)), "online").otherwise("offline"))
        .when((event == "run") & F.coalesce(ok, F.lit(False)), "online")
    )


def run_after(event: Column, ok: Column) -> Column:
    return F.when(event == "file", "idle").when(event == "run_started", "running").when(event == "run", F.when(F.coalesce(ok, F.lit(False)), "success").otherwise("error"))


def last_states(events: DataFrame) -> DataFrame:
    """Each case's states after its last events: case_id, connection, run_state."""
    connection, run = connection_after(F.col("event"), F.col("ok")), run_after(F.col("event"), F.col("ok"))
    stated = events.withColumns({"connection": connection, "run": run})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id")))
    return stated.groupBy("case_id").agg(F.coalesce(last("connection"), F.lit("unknown")).alias("connection"), F.coalesce(last("run"), F.lit("idle")).alias("run_state"))


def file_sessions(events: DataFrame) -> DataFrame:
    """Events with the number of the file they belong to: choosing a file resets the rest, removing it does not."""
    walked = Window.partitionBy("case_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("file_no", F.sum((F.col("event") == "file").cast("int")).over(walked))
