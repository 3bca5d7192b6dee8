"""Column expressions: distances, geodesy, intervals, divergences, keys and names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
Z95 = 1.959963984540054


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dissimilarity(a: Column, b: Column, vector: bool = False) -> Column:
    """Absolute difference of numbers, Euclidean distance of arrays."""
    return F.sqrt(squared_distance(a, b)) if vector else F.abs(a - b)


def relative_state(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def ecef_km(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, t = F.radians(lat), F.radians(lon)
    return EARTH_KM * F.cos(p) * F.cos(t), EARTH_KM * F.cos(p) * F.sin(t), EARTH_KM * F.sin(p)


def chord_km(arc_km: float) -> float:
    """Straight-line length under an arc of the sphere."""
    return 2 * EARTH_KM * math.sin(arc_km / (2 * EARTH_KM))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """Both parse, are finite and in range, and are not both zero."""
    inside = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(inside & ~((lat == 0) & (lon == 0)), F.lit(False))


def density_scaled_k(n: Column, fraction: float = 0.15) -> Column:
    return F.least(n - 1, F.greatest(F.lit(2), F.floor(F.lit(fraction) * n + 0.5))).cast("int")


def scott_factor(n: Column, dimensions: int) -> Column:
    return F.pow(n.cast("double"), F.lit(-1.0 / (dimensions + 4)))


def wilson(successes: Column, trials: Column, z: float = Z95, clamp: bool = True) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval, held within 0 and 1 if clamp."""
    n, p, zz = trials.cast("double"), successes / trials.cast("double"), z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = centre - half, centre + half
    return (F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)) if clamp else (low, high)


def wrapped_angle(a: Column) -> Column:
    """In (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def crossing_probability(angle_a: Column, angle_b: Column) -> Column:
    """That a front at a uniform phase parts two points on a circle."""
    return F.abs(wrapped_angle(angle_b - angle_a)) / F.lit(math.pi)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two arrays of shares; terms of zero share are zero."""
    half = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v
    )
    return half(p, q) / 2 + half(q, p) / 2


def masked_distance(left: Column, right: Column, least: int, alphabet: str = "ACGT") -> Column:
    """Share of differing columns among those where both aligned sequences have a letter of alphabet; null under `least` of them."""
    pairs = F.arrays_zip(F.split(F.upper(left), "").alias("l"), F.split(F.upper(right), "").alias("r"))
    letters = F.array(*(F.lit(c) for c in alphabet))
    both = F.filter(pairs, lambda x: F.array_contains(letters, x["l"]) & F.array_contains(letters, x["r"]))
    n = F.size(both)
    return F.when(n >= least, F.size(F.filter(both, lambda x: x["l"] != x["r"])) / F.when(n > 0, n))


def collapse_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalized_name(x: Column) -> Column:
    return F.lower(collapse_whitespace(x))


def normalized_token(x: Column) -> Column:
    """Upper case, runs of underscores, hyphens and white space as one space."""
    return F.trim(F.regexp_replace(F.upper(x), r"[_\-\s]+", " "))


def without_prefix(token: Column, prefix: Column) -> Column:
    return F.when(F.startswith(token, F.concat(prefix, F.lit(" "))), F.substr(token, F.length(prefix) + 2)).otherwise(token)


def hash_key(*parts: Column | str) -> Column:
    """Lower-case hex SHA-256 of the parts joined by bars; orders rows without regard to where they lie."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *cols).cast("binary"), 256)


def seed(*parts: Column | str, little_endian: bool = True) -> Column:
    """Unsigned 64-bit seed, as decimal(20,0), from the first eight bytes of hash_key()."""
    head = F.substring(hash_key(*parts), 1, 16)
    if little_endian:
        head = F.concat(*(F.substring(head, 15 - 2 * i, 2) for i in range(8)))
    return F.conv(head, 16, 10).cast("decimal(20,0)")


def retention_label(fraction: Column) -> Column:
    return F.rtrim(F.rtrim(F.format_string("%.6f", fraction), F.lit("0")), F.lit("."))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def harmonized(value: Column, unit: Column) -> Column:
    """Degrees Celsius of a value in K, C or F; null for another unit."""
    u = F.upper(F.trim(unit))
    return F.when(u == "K", celsius(value)).when(u == "C", value).when(u == "F", (value - 32) / 1.8)


def displacement(past: Column, present: Column) -> Column:
    """What has to be added to the present to get the past: past less present, of numbers or arrays."""
    return past - present


def vector_displacement(past: Column, present: Column) -> Column:
    return F.zip_with(past, present, lambda x, y: x - y)


def name_match(requested: Column, key: Column, kind: Column, rank: Column, name: Column) -> Column:
    """struct<accepted, reason> of an authority's answer: an exact match of a species whose canonical name is the requested one."""
    same = F.upper(F.coalesce(kind, F.lit(""))).isin("EXACT", "CONFIDENCE") & (F.upper(F.coalesce(rank, F.lit(""))) == "SPECIES")
    same = same & (normalized_name(F.coalesce(name, F.lit(""))) == normalized_name(F.coalesce(requested, F.lit(""))))
    has_key = F.coalesce(key.cast("long"), F.lit(0)) > 0
    reason = F.when(~has_key, "missing_usage_key").when(same, "exact_canonical_species").otherwise("rejected_nonexact_species_match")
    return F.struct((has_key & same).alias("accepted"), reason.alias("reason"))


#: How a simulated response follows from its latent value.
RESPONSES = {"identity": lambda x: x, "tanh": F.tanh}


def response(latent: Column, transform: str = "tanh") -> Column:
    if transform not in RESPONSES:
        raise ValueError(f"no response transform {transform}")
    return RESPONSES[transform](latent)
