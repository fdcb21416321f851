"""Decision rules as expressions: commitments, severity, verdicts, costs, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marker of a field that a bidder could not determine.
UNKNOWN = "CANNOT_DETERMINE"
#: USD per million tokens in and out, per million embedded characters, and INR per USD.
PRICES = [("gemini-2.5-flash", 0.075, 0.30), ("gemini-2.5-flash-lite", 0.040, 0.15), ("gemini-2.5-pro", 1.25, 5.00), ("gemini-1.5-flash", 0.075, 0.30), ("gemini-1.5-pro", 1.25, 5.00)]
EMBEDDING_PRICES = [("text-embedding-004", 0.025), ("gemini-embedding-001", 0.025)]
INR_PER_USD = 84.0
_FIELDS = ("quantity", "method", "standard")


def normalise_commitments(commitments: Column) -> Column:
    """Trim fields; an absent or empty one becomes UNKNOWN (one of white space
    alone becomes empty); blank questions go."""
    field = lambda c, f: F.btrim(F.coalesce(F.nullif(c[f], F.lit("")), F.lit(UNKNOWN))).alias(f)
    asked = lambda c: F.filter(F.transform(F.coalesce(c["missing_info"], F.array().cast("array<string>")), lambda q: F.btrim(q)), lambda q: q != "")
    return F.transform(commitments, lambda c: F.struct(F.btrim(c["obligation"]).alias("obligation"), *[field(c, f) for f in _FIELDS], asked(c).alias("missing_info")))


def gaps(c: Column) -> Column:
    """Names of the fields of a commitment that are unknown."""
    return F.filter(F.array(*[F.when(c[f] == UNKNOWN, f) for f in _FIELDS]), lambda g: g.isNotNull())


def _triggers(commitments: Column) -> Column:
    asked = lambda c: F.size(F.coalesce(c["missing_info"], F.array().cast("array<string>")))
    named = lambda c: F.concat(gaps(c), F.filter(F.array(F.when(asked(c) > 0, F.format_string("missing_info(%d questions)", asked(c)))), lambda g: g.isNotNull()))
    said = F.transform(commitments, lambda c: F.when(F.size(named(c)) > 0, F.concat(F.lit("obligation '"), F.substring(c["obligation"], 1, 60), F.lit("': "), F.array_join(named(c), ", "))))
    return F.filter(said, lambda t: t.isNotNull())


def is_flagged(commitments: Column) -> Column:
    """Whether any commitment has an unknown field or an open question; puts no text together."""
    asked = lambda c: F.size(F.coalesce(c["missing_info"], F.array().cast("array<string>"))) > 0
    return F.coalesce(F.exists(commitments, lambda c: F.coalesce(c["quantity"] == UNKNOWN, F.lit(False)) | F.coalesce(c["method"] == UNKNOWN, F.lit(False)) | F.coalesce(c["standard"] == UNKNOWN, F.lit(False)) | asked(c)), F.lit(False))


def evaluate_flag(commitments: Column) -> Column:
    """``struct<flagged, reason>``: flagged if any commitment has an unknown
    field or an open question; the reason tells three triggers at most."""
    found = _triggers(commitments)
    n = F.size(found)
    more = F.when(n > 3, F.format_string("; ... (+%d more)", n - 3)).otherwise("")
    empty = F.coalesce(F.size(commitments), F.lit(0)) <= 0
    reason = F.when(empty, "no commitments extracted (clause has no actionable obligation)").when(n == 0, "all commitments specify quantity, method, and standard")
    return F.struct(is_flagged(commitments).alias("flagged"), reason.otherwise(F.concat(F.array_join(F.slice(found, 1, 3), "; "), more)).alias("reason"))


def unknown_count(commitments: Column) -> Column:
    """How many fields of all commitments are unknown; null commitments have none."""
    return F.coalesce(F.aggregate(commitments, F.lit(0), lambda n, c: n + F.size(gaps(c))), F.lit(0))


def composite_severity(exposure: Column, dispute: Column) -> Column:
    """Commercial exposure plus likelihood of dispute; reviewer cost has no part."""
    return exposure + dispute


def severity_tier(composite: Column) -> Column:
    return F.when(composite >= 8, "high").when(composite >= 5, "medium").when(composite >= 2, "low").otherwise("n/a")


def sentinel_class(value: Column) -> Column:
    return F.when(value == UNKNOWN, "cannot").when(value == "CONTRACT_DEFINED", "contract").otherwise("set")


def coerce(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def _mentions(message: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.lower(message).contains(p)
    return F.coalesce(out, F.lit(False))


def is_quota_error(message: Column) -> Column:
    # fixed values: what back ends say
    return _mentions(message, "429", "rate limit", "resource_exhausted", "quota", "too many requests", "exceeded", "free_tier_requests")


def is_transient_error(message: Column) -> Column:
    # fixed values: what back ends say
    return _mentions(message, "429", "503", "500", "rate limit", "unavailable", "deadline")


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Exact model, else the first price whose name contains it or is contained; unknown models are free."""
    exact, fuzzy = F.lit(None).cast("double"), F.lit(0.0)
    for name, per_in, per_out in reversed(PRICES):
        cost = tokens_in / 1_000_000 * per_in + tokens_out / 1_000_000 * per_out
        exact = F.when(model == name, cost).otherwise(exact)
        fuzzy = F.when(model.contains(name) | F.lit(name).contains(model), cost).otherwise(fuzzy)
    return F.coalesce(exact, fuzzy)


def embedding_cost_usd(model: Column, chars: Column) -> Column:
    out = F.lit(0.0)
    for name, price in EMBEDDING_PRICES:
        out = F.when(model == name, chars / 1_000_000 * price).otherwise(out)
    return out


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero if either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(d: Column) -> Column:
    return 1 / (1 + d)
