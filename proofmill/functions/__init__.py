"""Scalar functions with exact semantics."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from decimal import Decimal, localcontext
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = 2**53 - 1


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def once(c: Column) -> Column:
    """``c`` behind a generator: a filter above stays there and does not repeat it, as it would repeat a
    parse for every member that the filter's columns read.  For use in ``select`` alone."""
    return F.explode(F.array(c))


def half_even_ratio(a: Column, b: Column, places: int = 4) -> Column:
    """a / b of non-negative integers as text, rounded half to even once; null where b <= 0.

    Integer arithmetic: a decimal quotient would already have been rounded before.
    """
    scale = 10**places
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    whole = _div(a * scale, b)
    rest = (a * scale) - whole * b
    up = (2 * rest > b) | ((2 * rest == b) & (whole % 2 == 1))
    q = (whole + F.when(up, 1).otherwise(0)).cast("long")
    text = F.concat(_div(q, F.lit(scale)).cast("string"), F.lit("."), F.lpad((q % scale).cast("string"), places, "0"))
    return F.when(b > 0, text)


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of non-negative numbers, exact for any size: take the remainder off first."""
    return ((a - a % b) / b).cast("decimal(28,0)")


def compares(left_num: Column, left_den: Column, op: str, num: int, den: int) -> Column:
    """left_num / left_den against num / den by cross-multiplication; denominators are positive."""
    a = left_num.cast("decimal(19,0)") * F.lit(den).cast("decimal(18,0)")
    b = left_den.cast("decimal(19,0)") * F.lit(num).cast("decimal(18,0)")
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


def text_of_value(c: Column, kind: str) -> Column:
    """The text under which a value is grouped or matched: True, False, None, plain numbers."""
    shown = F.when(c, "True").when(~c, "False") if kind == "boolean" else c.cast("string")
    return F.coalesce(shown, F.lit("None"))


def family(control: Column) -> Column:
    return F.substring_index(control, "-", 1)


def pseudonym(principal: Column, key: bytes = bytes(32)) -> Column:
    """HMAC-SHA-256 of a principal's id, from two SHA-256 calls of the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(x ^ 0x36 for x in block))
    outer = F.lit(bytes(x ^ 0x5C for x in block))
    first = F.sha2(F.concat(inner, F.encode(principal, "UTF-8")), 256)
    return F.concat(F.lit("principal:"), F.sha2(F.concat(outer, F.unhex(first)), 256))


def event_iri(event_id: Column) -> Column:
    return F.concat(F.lit("urn:event:"), event_id)


def compact_iri(iri: Column, prefixes: dict[str, str]) -> Column:
    """``prefix:rest`` of an IRI under one of a few namespaces, the longest that fits; others stay as they are."""
    out = iri
    for name, base in sorted(prefixes.items(), key=lambda p: len(p[1])):
        out = F.when(iri.startswith(base), F.concat(F.lit(f"{name}:"), F.substring(iri, F.lit(len(base) + 1), F.length(iri)))).otherwise(out)
    return out


def nanoseconds_to_time(ns: Column) -> Column:
    """RFC 3339 text with milliseconds, cut and never rounded; null for negative values."""
    ms = _div(ns.cast("decimal(20,0)"), F.lit(1_000_000)).cast("long")
    return F.when(ns >= 0, F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))


def plain_decimal(text: Column, kind: str = "decimal(38,10)") -> Column:
    """A decimal without exponent; null for any other text."""
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.try_cast(kind))


def digest_form(digest: Column) -> Column:
    return F.lower(F.regexp_replace(digest, "^sha256:", ""))


def first_present(attributes: Column, *keys: str) -> Column:
    """The first of several attribute names that holds a non-empty text."""
    return F.coalesce(*[F.nullif(attributes[k], F.lit("")) for k in keys])


def canonical(value) -> str:
    """Canonical JSON text: keys in UTF-16 order after composition, integers only, least escapes."""

    def checked(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, float):
            raise ValueError("number is not an integer")
        if isinstance(v, int):
            if abs(v) > SAFE:
                raise ValueError("integer out of range")
            return v
        if isinstance(v, str):
            v.encode("utf-8")
            return unicodedata.normalize("NFC", v)
        if isinstance(v, list):
            return [checked(x) for x in v]
        out = {unicodedata.normalize("NFC", k): checked(x) for k, x in v.items()}
        if len(out) != len(v):
            raise ValueError("keys collide after composition")
        return {k: out[k] for k in sorted(out, key=lambda s: s.encode("utf-16-be"))}

    return json.dumps(checked(value), ensure_ascii=False, separators=(",", ":"))


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def content_hash(line: str | None) -> tuple[str | None, str | None]:
    """(hash, refusal) of an event's canonical text without its own integrity block."""
    try:
        event = json.loads(line, object_pairs_hook=_unique, parse_constant=_refuse)
        if not isinstance(event, dict):
            raise ValueError("not an object")
        if isinstance(event.get("data"), dict):
            event["data"].pop("integrity", None)
        return hashlib.sha256(canonical(event).encode("utf-8")).hexdigest(), None
    except (ValueError, TypeError, RecursionError) as e:
        return None, str(e)[:200]


def _refuse(token: str):
    raise ValueError(f"number {token} refused")


@F.pandas_udf(_texts("hash", "error"))
def canonical_hash(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([content_hash(x) for x in lines], columns=["hash", "error"])


def _beta_fraction(a: Decimal, b: Decimal, x: Decimal) -> Decimal:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    tiny, one = Decimal("1e-60"), Decimal(1)
    c, d = one, one - (a + b) * x / (a + 1)
    d = one / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000 + 20 * math.isqrt(int(a + b))):  # settles in a multiple of the root of the trials
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = one + num * d
            d = one / (d if abs(d) > tiny else tiny)
            c = one + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - one) < Decimal("1e-26"):
            return h
    raise ArithmeticError("the continued fraction did not settle")


#: Bernoulli numbers of index 2, 4, ..., 26, and the argument from which Stirling's series with them has 40 digits.
BERNOULLI = [Fraction(*f) for f in ((1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510), (43867, 798), (-174611, 330), (854513, 138), (-236364091, 2730), (8553103, 6))]
STIRLING = 300
HALF_LOG_TAU = Decimal("0.91893853320467274178032973640561763986139747363778")


def _log_factorial(n: int) -> Decimal:
    """ln(n!) to 40 digits at any size: Stirling's series, from STIRLING on."""
    if n < STIRLING:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = sum((Decimal(f.numerator) / (f.denominator * 2 * i * (2 * i - 1) * x ** (2 * i - 1)) for i, f in enumerate(BERNOULLI, 1)), Decimal(0))
    return (x + Decimal("0.5")) * x.ln() - x + HALF_LOG_TAU + series


def _beta_cdf(k: int, n: int, x: Decimal, log_choose: Decimal) -> Decimal:
    """P(at least k of n) at success probability x: the regularised incomplete beta I_x(k, n - k + 1).

    ``log_choose`` is ln(n! / ((k - 1)! (n - k)!)).
    """
    if x <= 0:
        return Decimal(0)
    if x >= 1:
        return Decimal(1)
    a, b = Decimal(k), Decimal(n - k + 1)
    scale = (a * x.ln() + b * (1 - x).ln() + log_choose).exp()
    if x < (a + 1) / (a + b + 2):
        return scale * _beta_fraction(a, b, x) / a
    return 1 - scale * _beta_fraction(b, a, 1 - x) / b


#: Trials up to which intervals come from whole numbers alone.
EXACT = 2_000


def _tail(k: int, n: int, a: int, d: int) -> int:
    """P(at least k of n) at success probability a / d, times d to the n; each term follows from the one before without remainder."""
    if k > n:
        return 0
    term = math.comb(n, k) * a**k * (d - a) ** (n - k)
    total = term
    for i in range(k, n):
        term = term * (n - i) * a // ((i + 1) * (d - a))
        total += term
    return total


def exact_interval(k: int, n: int, alpha: str = "0.05") -> tuple[str, str]:
    """The interval by tail sums in whole numbers: a bound is rounded to the fourth decimal whose upper and
    lower half steps have the two tails on either side of alpha / 2; a bound on a half step goes to the even one."""
    half = Fraction(alpha) / 2
    d = 20_000

    def steps(past) -> int:
        """How many half steps lie before the bound; ``past`` gives the sign of the bound less the step."""
        lo, hi = 0, d // 2
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if past(2 * mid + 1) > 0 else (lo, mid)
        return lo + (lo < d // 2 and past(2 * lo + 1) == 0 and lo % 2)

    low = steps(lambda a: half.numerator * d**n - half.denominator * _tail(k, n, a, d))
    high = steps(lambda a: half.denominator * (d**n - _tail(k + 1, n, a, d)) - half.numerator * d**n)
    return tuple(f"{x // 10_000}.{x % 10_000:04d}" for x in (0 if k == 0 else low, 10_000 if k == n else high))


def clopper_pearson(k: int, n: int, alpha: str = "0.05") -> tuple[str, str]:
    """Exact binomial interval as text with four places, half to even; up to EXACT trials from whole numbers alone."""
    if n <= EXACT:
        return exact_interval(k, n, alpha)
    return decimal_interval(k, n, alpha)


def decimal_interval(k: int, n: int, alpha: str = "0.05") -> tuple[str, str]:
    """The interval by the incomplete beta function at the half steps of the fourth decimal, to 50 digits.

    A bound is rounded by the sides of the half steps on which its tail passes its goal; about 14 tails a
    bound, each of a number of terms that grows with the root of n.
    """
    with localcontext() as ctx:
        ctx.prec = 50
        half = Decimal(alpha) / 2

        def steps(k, goal) -> int:
            """How many half steps lie before the place where P(at least k of n) is ``goal``; one on that place counts where it is odd."""
            log_choose = _log_factorial(n) - _log_factorial(k - 1) - _log_factorial(n - k)
            less = lambda m: _beta_cdf(k, n, Decimal(2 * m + 1) / 20_000, log_choose) - goal
            lo, hi = 0, 10_000
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if less(mid) < 0 else (lo, mid)
            return lo + (lo < 10_000 and less(lo) == 0 and lo % 2)

        low = 0 if k == 0 else steps(k, half)
        high = 10_000 if k == n else steps(k + 1, 1 - half)
        return tuple(f"{x // 10_000}.{x % 10_000:04d}" for x in (low, high))


@F.pandas_udf(_texts("low", "high"))
def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Clopper-Pearson interval of aggregated counts: a few rows, one per group."""
    return pd.DataFrame([clopper_pearson(int(a), int(b)) if b else (None, None) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


def register(spark: SparkSession) -> None:
    """Makes canonical_hash(json), clopper_pearson(k, n) and sha256 pseudonyms callable from SQL."""
    spark.udf.register("canonical_hash", canonical_hash)
    spark.udf.register("clopper_pearson", interval)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION principal_pseudonym(id STRING) RETURNS STRING RETURN concat('principal:', sha2(concat(unhex(repeat('5C', 64)), unhex(sha2(concat(unhex(repeat('36', 64)), encode(id, 'UTF-8')), 256))), 256))")
