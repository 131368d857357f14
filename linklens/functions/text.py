"""Text rules as Column expressions: aliases, label escaping, masking, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference) ---
ALIAS_MIN_LENGTH = 3
ALIAS_MAX_LENGTH = 32
ALIAS_PATTERN = "^[A-Za-z0-9_-]+$"
# Paths the router owns plus confusing names; matched case-insensitively.
RESERVED_ALIASES = [
    "api", "health", "healthz", "ready", "readyz", "live", "metrics", "admin", "static", "assets",
    "public", "favicon.ico", "robots.txt", "sitemap.xml", "login", "logout", "signin", "signup",
    "register", "account", "settings", "dashboard", "docs", "doc", "help", "support", "about",
    "terms", "privacy", "security", "status", "null", "undefined", "new", "edit", "delete",
]
# Field names masked in structured logs (compared lower-cased).
REDACT_KEYS = [
    "password", "secret", "token", "authorization", "cookie", "apikey", "api_key", "x-api-key",
    "databaseurl", "database_url", "redisurl", "redis_url", "connectionstring",
]
# -----------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_reserved(col) -> Column:
    return F.lower(_c(col)).isin(RESERVED_ALIASES)


def is_plausible_code(col) -> Column:
    """Shape screen for a code on the redirect path: 1..32 chars, pattern, not reserved.

    The code is bound once (one-element ``transform``) so that when the filter is
    pushed below the projection that derives the code, the derivation is not
    copied into each of the four checks.
    """
    def check(c: Column) -> Column:
        return ((F.length(c) > 0) & (F.length(c) <= ALIAS_MAX_LENGTH) & c.rlike(ALIAS_PATTERN) & ~is_reserved(c))

    bound = F.element_at(F.transform(F.array(_c(col)), check), 1)
    return F.coalesce(bound, F.lit(False))


def alias_error(col) -> Column:
    """Null when the alias is acceptable, else the error code of the first failing rule."""
    v = F.trim(_c(col))
    return (F.when((F.length(v) < ALIAS_MIN_LENGTH) | (F.length(v) > ALIAS_MAX_LENGTH), "VALIDATION_FAILED")
            .when(~v.rlike(ALIAS_PATTERN), "VALIDATION_FAILED")
            .when(is_reserved(v), "RESERVED_ALIAS"))


def escape_label(col) -> Column:
    """Prometheus label value escaping: backslash, newline, double quote, in that order."""
    c = F.replace(_c(col), F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.replace(c, F.lit('"'), F.lit('\\"'))


def mask_secret(col) -> Column:
    """Strings of length <= 8 -> ``***``; else first 4 + ``***`` + last 2."""
    c = _c(col)
    return F.when(F.length(c) <= 8, F.lit("***")).otherwise(
        F.concat(F.substring(c, 1, 4), F.lit("***"), F.substring(c, -2, 2)))


def percent(part, whole) -> Column:
    """Share in percent with one decimal, rounding half up; 0 when whole is 0.

    Computed as floor(part / whole * 1000 + 0.5) / 10 in doubles.
    """
    p, w = _c(part), _c(whole)
    return F.when(w == 0, F.lit(0.0)).otherwise(
        F.floor(p.cast("double") / w * 1000.0 + 0.5) / 10.0)
