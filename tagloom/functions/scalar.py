"""Scalar functions of tags, text, time and hyperbolic space as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.vectors import dot, norm


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def decay(age: Column, half_life: float) -> Column:
    """2 ** (-age / half_life)."""
    return F.exp(-F.lit(math.log(2.0)) * age / F.lit(float(half_life)))


def tiered_decay(age: Column, tiers: tuple[tuple[float, float], ...] = ((0.5, 24.0), (0.3, 168.0), (0.2, 720.0))) -> Column:
    """Weighted sum of decays, (weight, half-life) each."""
    out = F.lit(0.0)
    for weight, half_life in tiers:
        out = out + F.lit(weight) * decay(age, half_life)
    return out


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def normalize_tag(name: Column) -> Column:
    """Trimmed, lower-cased, white space to hyphens, other than a-z 0-9 - : dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", "-"), r"[^a-z0-9\-:]", "")


def canonical_tag(name: Column, prefix: str = "") -> Column:
    """A tag's name across projects: prefix off, underscores to hyphens, runs of hyphens to one."""
    plain = F.lower(F.trim(name))
    if prefix:
        plain = F.regexp_replace(plain, "^" + prefix.lower() + "[-_:]+", "")
    return F.regexp_replace(F.regexp_replace(plain, "_", "-"), "-+", "-")


def source_name(summary: Column) -> Column:
    """A summary without its part number, ``file [2/5]`` or ``file (part 2/5)``."""
    return F.trim(F.regexp_replace(F.regexp_replace(summary, r"\s*\[\d+/\d+\]\s*$", ""), r"\s*\(part \d+/\d+\)\s*$", ""))


def source_tag(summary: Column) -> Column:
    """The tag of a summary's file: no part number, no extension."""
    return normalize_tag(F.regexp_replace(source_name(summary), r"\.[A-Za-z0-9]+$", ""))


def content_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def key_of(ids: Column, length: int = 32) -> Column:
    """Hash of a set of ids: sorted, joined by commas."""
    return content_hash(F.concat_ws(",", F.array_sort(F.transform(ids, lambda x: x.cast("string")))), length)


def hash_angle(name: Column) -> Column:
    """An angle in [0, 2 pi) from the first 8 bytes of the name's SHA-256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64) * F.lit(2 * math.pi)


def slot(angle: Column, prime: Column) -> Column:
    return F.pmod(F.floor(angle * prime / F.lit(2 * math.pi)), prime).cast("int")


def angular_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(2 * math.pi) - d)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def usage_salience(accesses: Column, age_hours: Column, successes: Column, uses: Column, half_life: float = 168.0) -> Column:
    """Logistic of frequency, recency and success of use; success counts half where there is none."""
    frequency = F.least(F.log1p(accesses.cast("double")) / F.lit(math.log(101)), F.lit(1.0))
    success = F.when(uses > 0, successes / uses).otherwise(F.lit(0.5))
    x = F.lit(0.4) * frequency + F.lit(0.4) * decay(age_hours, half_life) + F.lit(0.2) * success
    return sigmoid(F.lit(6.0) * (x - F.lit(0.5)))


def composite_salience(model: Column, usage: Column) -> Column:
    return F.lit(0.6) * model + F.lit(0.4) * usage


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def effective_strength(strength: Column, reinforcements: Column, step: float = 0.15, cap: float = 3.0) -> Column:
    return strength * F.least(F.lit(1.0) + F.lit(step) * reinforcements, F.lit(cap))


def temporal_proximity(hours: Column) -> Column:
    return F.exp(F.lit(-0.693) * hours / F.lit(720.0))


# ---- the Poincare ball, curvature 1 -------------------------------------------------------------

EDGE = 1 - 1e-5


def _scaled(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def ball_clamp(v: Column) -> Column:
    n = norm(v)
    return F.when(n > EDGE, _scaled(v, F.lit(EDGE) / n)).otherwise(v)


def exp_origin(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 1e-12, ball_clamp(_scaled(v, F.tanh(n) / n))).otherwise(v)


def log_origin(p: Column) -> Column:
    n = norm(p)
    return F.when(n > 1e-12, _scaled(p, F.atanh(F.least(n, F.lit(EDGE))) / n)).otherwise(p)


def ball_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    z = F.lit(1.0) + F.lit(2.0) * dot(d, d) / F.greatest((F.lit(1.0) - dot(a, a)) * (F.lit(1.0) - dot(b, b)), F.lit(1e-12))
    return F.acosh(F.greatest(z, F.lit(1.0)))


def mobius_add(a: Column, b: Column) -> Column:
    ab, aa, bb = dot(a, b), dot(a, a), dot(b, b)
    below = F.lit(1.0) + 2 * ab + aa * bb
    return ball_clamp(F.zip_with(a, b, lambda x, y: ((F.lit(1.0) + 2 * ab + bb) * x + (F.lit(1.0) - aa) * y) / below))


def conformal_factor(p: Column) -> Column:
    return F.lit(2.0) / F.greatest(F.lit(1.0) - dot(p, p), F.lit(1e-12))


def polar(p: Column) -> tuple[Column, Column]:
    """(radius, angle in [0, 2 pi)) of a point of the disc."""
    x, y = F.element_at(p, 1), F.element_at(p, 2)
    return F.sqrt(x * x + y * y), F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def from_polar(radius: Column, angle: Column) -> Column:
    return F.array(radius * F.cos(angle), radius * F.sin(angle))
