"""Column expressions over a request log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Id patterns in paths, and paths left out of the request metrics.
UUID_PATTERN = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
NUMBER_SEGMENT = "/[0-9]+(/|$)"
EXCLUDED_PREFIXES = ("/healthz", "/ready", "/metrics")


def endpoint(path: str) -> Column:
    """Path with UUIDs and numeric segments replaced by ``{id}``.

    Of two numeric segments in a row only the first is replaced, as a match takes the slash after it.
    """
    return F.regexp_replace(
        F.regexp_replace(F.col(path), UUID_PATTERN, "{id}"), NUMBER_SEGMENT, "/{id}$1"
    )


def is_excluded(path: str, prefixes: tuple[str, ...] = EXCLUDED_PREFIXES) -> Column:
    return reduce(lambda a, b: a | b, [F.col(path).startswith(p) for p in prefixes])


def client_ip(forwarded: str, peer: str) -> Column:
    """First address of the forwarded header, else the peer, else ``unknown``."""
    first = F.btrim(F.split(F.col(forwarded), ",")[0], F.lit(" \t\r\n"))
    return F.when(F.length(forwarded) > 0, first).otherwise(F.coalesce(F.col(peer), F.lit("unknown")))


def error_type(status: str, exception: str | None = None) -> Column:
    """Exception name or ``http_<status>`` for failed requests, null for the others."""
    code = F.concat(F.lit("http_"), F.col(status).cast("string"))
    name = F.coalesce(F.col(exception), code) if exception else code
    return F.when(F.col(status) >= 400, name)


def log_level(status: str) -> Column:
    return (
        F.when(F.col(status) >= 500, "error").when(F.col(status) >= 400, "warning").otherwise("debug")
    )
