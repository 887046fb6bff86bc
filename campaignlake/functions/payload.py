"""JSON payload expressions. Everything stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Derived column -> payload key.
PAYLOAD_COLUMNS = {
    "payload_language": "language",
    "payload_utm_source": "utm_source",
    "payload_score": "score",
}

PAYLOAD_KEYS = ", ".join(f"{key} STRING" for key in PAYLOAD_COLUMNS.values())

OBJECT = r"^\s*\{"
CONTAINER = r"^\s*[{\[]"
EMPTY_CONTAINER = r"^\s*[{\[]\s*[}\]]\s*$"
# White space at an end of a text value, as it is or escaped, once `\\\\` and `\\"` are masked.
EDGE = r"(?:\s|\\[tnr]|\\u00(?:00|09|0[aAbBdD]|20))"
# Such an end, or an empty value: what makes a payload worth writing anew. A literal opens after one of `[{,:` and closes
# before one of `]},:`, so that blanks between literals mark nothing.
MAY_NEED_TRIM = rf'[\[{{,:]\s*+"(?:{EDGE}|")|{EDGE}"\s*+[\]}},:]'
# A key, which stays, or a value without the blanks at its ends; and an empty value. Possessive loops need no stack.
LITERAL = rf'("[^"]*+"\s*+:)|("){EDGE}*+([^"]*?){EDGE}*+(")'
BLANK = r'""(?!\s*+:)'
# Control characters, which JSON text cannot hold, stand for an escaped backslash and an escaped quote.
MASKS = {"\\\\": "\u0001", '\\"': "\u0002"}


def rounded_int(text: Column) -> Column:
    """Number text rounded to an integer; anything non-numeric reads as NULL."""
    return F.round(text.try_cast("double")).try_cast("int")


def with_payload_columns(events: DataFrame) -> DataFrame:
    """Expose the hot payload keys as columns, unless the table already stores them.

    One parse serves all three, and Spark narrows it to the keys a query uses. A JSON null reads
    as NULL; a payload that is no object has no keys.
    """
    missing = [c for c in PAYLOAD_COLUMNS if c not in events.columns]
    if not missing:
        return events
    payload = F.col("payload")
    # A key stands in the text as it is, or with a code of its letters: other payloads are not parsed.
    named = [payload.contains(key) for key in PAYLOAD_COLUMNS.values()] + [payload.contains("\\u")]
    keys = F.from_json(F.when(reduce(Column.__or__, named) & payload.rlike(OBJECT), payload), PAYLOAD_KEYS)
    derived = {
        "payload_language": F.col("_keys.language"),
        "payload_utm_source": F.col("_keys.utm_source"),
        "payload_score": rounded_int(F.col("_keys.score")),
    }
    return events.withColumn("_keys", keys).withColumns({c: derived[c] for c in missing}).drop("_keys")


def payload_map(payload: Column) -> Column:
    """Top-level keys as text (nested values keep their JSON text)."""
    return F.from_json(payload, "map<string,string>")


def is_json_container(payload: Column) -> Column:
    """True for a JSON object or array, False for scalars, broken text and NULL."""
    return F.json_object_keys(payload).isNotNull() | F.json_array_length(payload).isNotNull()


def is_empty_payload(payload: Column) -> Column:
    """True for `{}` and `[]`. Each JSON function is NULL on the other kind."""
    return F.coalesce(
        F.size(F.json_object_keys(payload)) == 0, F.json_array_length(payload) == 0, F.lit(False)
    )


def trimmed_payload(payload: Column) -> Column:
    """JSON text with every text value trimmed, at any depth, and blank ones null; keys and all else as they are.

    Without escaped quotes a literal is what stands between two quotes, and two patterns that walk from literal to literal
    do the work: a lambda over the split text would run interpreted, and split it again for each part.
    """
    masked = payload
    for text, mask in MASKS.items():
        masked = F.replace(masked, F.lit(text), F.lit(mask))
    joined = F.regexp_replace(F.regexp_replace(masked, LITERAL, "$1$2$3$4"), BLANK, "null")
    for text, mask in MASKS.items():
        joined = F.replace(joined, F.lit(mask), F.lit(text))
    return joined


def with_stored_payload(rows: DataFrame) -> DataFrame:
    """Payload as stored: text values trimmed, blank ones null; a missing, empty or scalar
    payload becomes `[]`. A payload that no pattern marks is stored as it came."""
    payload = F.col("payload")
    stored = (
        F.when(F.coalesce(~payload.rlike(CONTAINER) | payload.rlike(EMPTY_CONTAINER), F.lit(True)), F.lit("[]"))
        .when(payload.rlike(MAY_NEED_TRIM) & is_json_container(payload), trimmed_payload(payload))
        .otherwise(payload)
    )
    return rows.withColumn("payload", stored)
