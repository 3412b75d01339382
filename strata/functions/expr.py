"""Column expressions.  All are built-in Catalyst expressions (codegen, no Python UDF)
and ANSI-safe: no expression can raise on division by zero or on an unmapped key."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arithmetic hash shared with SQL engines that lack xxhash64.  Reduce the key first so the
# product stays far inside BIGINT for any key size (no ANSI overflow at 10^12 keys).
HASH_MODULUS = 1000003
HASH_MULTIPLIER = 2654435761
HASH_SEED_MULTIPLIER = 40503


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den`` as double, NULL when the denominator is 0 or NULL (never raises)."""
    return col_(num).cast("double") / F.nullif(col_(den).cast("double"), F.lit(0.0))


def nan_to_null(c) -> Column:
    """NaN -> NULL so that later code only sees one missing marker."""
    c = col_(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def nan_to_num(c, fill: float = 0.0) -> Column:
    """NULL / NaN -> ``fill``; +-inf -> +-max double (numpy ``nan_to_num`` rule)."""
    c = col_(c).cast("double")
    big = 1.7976931348623157e308
    return (F.when(c.isNull() | F.isnan(c), F.lit(fill))
            .when(c == float("inf"), F.lit(big))
            .when(c == float("-inf"), F.lit(-big))
            .otherwise(c))


def is_missing(c, numeric: bool) -> Column:
    c = col_(c)
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def recode(c, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup; an unmapped key gives NULL (or ``default``).

    A ``create_map`` literal is evaluated inside the projection: no join, no shuffle.
    For dictionaries with many entries use ``recode_join``.
    """
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.try_element_at(m, col_(c))
    return v if default is None else F.coalesce(v, F.lit(default))


def indicator(c, value) -> Column:
    """``(c == value)`` as 0/1 int where NULL counts as not equal (pandas rule)."""
    return col_(c).eqNullSafe(F.lit(value)).cast("int")


def clamp_decrement(c, floor_: int = 1, step: int = 1) -> Column:
    return F.greatest(F.lit(floor_), col_(c) - step)


def clamp_increment(c, ceil_: int = 4, step: int = 1) -> Column:
    return F.least(F.lit(ceil_), col_(c) + step)


def threshold_label(p, threshold: float = 0.5, inclusive: bool = False,
                    positive: str = "Survived", negative: str = "Deceased") -> Column:
    p = nan_to_null(col_(p).cast("double"))  # NaN would compare as the greatest number
    cond = (p >= threshold) if inclusive else (p > threshold)
    return F.when(cond, F.lit(positive)).when(p.isNotNull(), F.lit(negative))  # no score, no label


def flip_binary(c) -> Column:
    """``1 if c == 0 else 0``."""
    return F.when(col_(c) == 0, F.lit(1)).otherwise(F.lit(0))


def band(c, edges: list, names: list | None = None) -> Column:
    """Bucket a value into right-open bands ``[e_i, e_{i+1})``; the last band is closed.
    Returns the band name (or its 0-based index when ``names`` is None)."""
    c = col_(c)
    names = names if names is not None else list(range(len(edges) - 1))
    out = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (c >= lo) & ((c <= hi) if i == len(edges) - 2 else (c < hi))
        out = F.when(cond, F.lit(names[i])) if out is None else out.when(cond, F.lit(names[i]))
    return out


def compare(c, op: str, value) -> Column:
    c = col_(c)
    return {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value,
            "==": c == value, "!=": c != value}[op]


def arith_hash(key, seed: int = 0) -> Column:
    """Deterministic, partition-independent hash in [0, HASH_MODULUS) that any SQL engine
    can reproduce: ``((key mod P) * A + seed * B) mod P``."""
    k = F.pmod(col_(key).cast("long"), F.lit(HASH_MODULUS))
    return F.pmod(k * F.lit(HASH_MULTIPLIER) + F.lit(seed * HASH_SEED_MULTIPLIER), F.lit(HASH_MODULUS))


def arith_hash_sql(key: str, seed: int = 0) -> str:
    """The same hash as SQL text (for oracle queries)."""
    p = HASH_MODULUS
    return (f"((((({key}) % {p}) + {p}) % {p}) * {HASH_MULTIPLIER} + {seed * HASH_SEED_MULTIPLIER}) % {p}")


def row_hash(keys: Iterable, seed: int = 42) -> Column:
    """64-bit hash of the key columns (xxhash64) used for sampling and splitting at scale."""
    return F.xxhash64(F.lit(seed), *[col_(k) for k in keys])


def fmt_fixed(c, digits: int) -> Column:
    """Presentation-only rounding (``{:.Nf}``)."""
    return F.format_number(col_(c), digits)


def today_iso() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")
