"""Column expressions of the cell algebra.  ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest TTL in seconds, the last 32-bit epoch second, and
#: how far before it a clamped expiry stays.
MAX_TTL, LAST_SECOND, MARGIN = 630_720_000, 2_147_483_647, 300


def resolve_expiry(duration: Column, offset: Column, base: Column, now: int) -> Column:
    """Expiry second of a [duration, offset] pair; null: never expires."""
    at = base + offset
    return F.when(duration.isNull() | (duration <= 0), None).when(at > 0, at).otherwise(F.lit(now) + duration)


def longest_expiry(expiries: Column) -> Column:
    """The latest of an array of expiries; one that never comes (null) wins."""
    return F.when(F.exists(expiries, lambda e: e.isNull()), None).otherwise(F.array_max(expiries))


def longest_expiry_of(expiry: Column) -> Column:
    """The same as an aggregate over rows."""
    return F.when(F.bool_or(expiry.isNull()), None).otherwise(F.max(expiry))


def remaining_ttl(expiry: Column, now: int, before_2038: bool = False) -> Column:
    """Seconds left: 0 for no expiry, 1 for a past one, at most MAX_TTL (and,
    if asked, nothing past the last 32-bit second)."""
    most = min(MAX_TTL, LAST_SECOND - MARGIN - now) if before_2038 else MAX_TTL
    return F.when(expiry.isNull(), F.lit(0)).otherwise(F.least(F.greatest(expiry - now, F.lit(1)), F.lit(most))).cast("long")


def ttl_clamped(expiry: Column, now: int, before_2038: bool = False) -> Column:
    most = min(MAX_TTL, LAST_SECOND - MARGIN - now) if before_2038 else MAX_TTL
    return F.coalesce(expiry - now > most, F.lit(False))


def is_expired(expiry: Column, now: int) -> Column:
    """Whether a cell with a TTL is past it."""
    return F.coalesce(expiry <= now, F.lit(False))


def latest_writetime(marker: Column, cells: Column) -> Column:
    """The newest of a marker's writetime and an array of cell writetimes."""
    return F.greatest(marker, F.array_max(cells))


def unit_id(keyspace: Column, table: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``keyspace.table``."""
    return F.substring(F.sha2(F.concat_ws(".", keyspace, table).cast("binary"), 256), 1, 16)


def effective_target(override: Column, source: Column) -> Column:
    return F.coalesce(F.when(F.trim(override) != "", override), source)


def normalize_type(type_text: Column) -> Column:
    return F.lower(F.regexp_replace(type_text, r"\s", ""))


def column_class(type_text: Column, user_type: Column | None = None) -> Column:
    """How fine a column's cells are, from its type's text: frozen, list, set,
    map, udt (a type that ``user_type`` says users defined) or simple."""
    t = F.trim(type_text)
    starts = lambda p: F.startswith(F.lower(t), F.lit(p))
    return F.when(starts("frozen<"), "frozen").when(starts("list<"), "list").when(starts("set<"), "set").when(starts("map<"), "map").when(F.lit(False) if user_type is None else user_type, "udt").otherwise("simple")


def eta_seconds(remaining: Column, per_second: Column) -> Column:
    return F.when((remaining > 0) & (per_second > 0), remaining / per_second)


def duration_seconds(start: Column, end: Column) -> Column:
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def poll_age_seconds(checked: Column, now: int) -> Column:
    age = F.lit(now) - F.unix_seconds(checked.cast("timestamp"))
    return F.when(age >= 0, age)


#: Error type names and message markers of each class.
AUTH_TYPES = ["AuthenticationException", "UnauthorizedException"]
FATAL_TYPES = ["AuthenticationException", "UnauthorizedException", "InvalidQueryException", "SyntaxError"]
THROTTLE_TYPES = ["OverloadedException"]
TRANSIENT_TYPES = ["NoHostAvailableException", "WriteTimeoutException", "ReadTimeoutException", "UnavailableException", "TimeoutException", "IOException", "SocketException", "ObjectDisposedException"]
THROTTLE_MARKERS = ["429", "TooManyRequests", "OverloadedException", "Request rate is large", "RetryAfterMs", "rate limit"]
NOT_FOUND_MARKERS = ["unconfigured table", "not found", "does not exist"]


def classify_error(error_type: Column, message: Column, auth: list[str] = AUTH_TYPES, fatal: list[str] = FATAL_TYPES, transient: list[str] = TRANSIENT_TYPES) -> Column:
    """fatal, auth, throttle, transient, not_found or other; auth is the fatal
    class of credentials, fatal outranks throttle, and throttle (by type or by
    message) outranks transient.  Callers may pass error types of their own."""
    text = F.coalesce(message, F.lit(""))
    has = lambda words: F.lower(text).rlike("|".join(w.lower() for w in words))
    return (
        F.when(error_type.isin(auth), "auth")
        .when((error_type == "InvalidQueryException") & has(NOT_FOUND_MARKERS), "not_found")
        .when(error_type.isin(fatal), "fatal")
        .when(error_type.isin(THROTTLE_TYPES) | has(THROTTLE_MARKERS), "throttle")
        .when(error_type.isin(transient), "transient")
        .otherwise("other")
    )


def retry_delay_ms(message: Column, attempt: Column) -> Column:
    """The server's ``RetryAfterMs`` hint, else doubling seconds up to 30."""
    hint = F.regexp_extract(F.coalesce(message, F.lit("")), r"RetryAfterMs=(\d+)", 1)
    grown = F.least(F.lit(30_000), (F.pow(F.lit(2.0), F.least(attempt, F.lit(10)) - 1) * 1000).cast("long"))
    return F.when(hint != "", hint.cast("long")).otherwise(grown).cast("long")
