"""Numeric, hash, vector, time and JSON functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR, DAY = 3_600_000, 86_400_000


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rescale(x: Column, low: float, high: float) -> Column:
    return clamp((x - low) / (high - low)) if high > low else F.lit(0.0)


def decay_at(decay: list[float], tail: float, index: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, decay)), index.cast("int")), F.lit(tail))


def half_up(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over code units, as a long."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(2166136261).cast("long"),
                       lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def hash_unit(s: Column) -> Column:
    return (fnv1a(s) % 100000) / F.lit(1e5)


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 20)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def top_mean(xs: Column, k: int = 3) -> Column:
    top = F.slice(F.reverse(F.array_sort(xs)), 1, k)
    return F.when(F.size(xs) > 0, F.aggregate(top, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(top))).otherwise(0.0)


def half_life(age_days: Column, half: Column, floor: Column) -> Column:
    return clamp(floor + (1 - floor) * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half))


def proximity(hours: Column, window: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - hours / window)


def run_rate(spent: Column, day: Column) -> Column:
    """Month projection: spent so far over the day of the month, times the days of the month."""
    return spent / F.dayofmonth(day) * F.dayofmonth(F.last_day(day))


def clock_minutes(s: Column) -> Column:
    """`h:m:s`, `m:s` or plain seconds, to minutes."""
    return F.aggregate(F.split(s, ":"), F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double")) / 60


def iso_minutes(s: Column) -> Column:
    n = lambda unit: F.coalesce(F.regexp_extract(s, rf"T.*?(\d+){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(s.rlike(r"^P.*T"), n("H") * 60 + n("M") + n("S") / 60)


def parse_date(s: Column) -> Column:
    """Tolerant: ISO forms, RFC 822 and `19 August 2026 - 12:50`; without a zone it is UTC."""
    s = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3}, ", "")
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMMM yyyy - HH:mm")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms])


def token_cost(fresh: Column, cached: Column, out: Column, prices: tuple[float, float, float]) -> Column:
    return (fresh * prices[0] + cached * prices[1] + out * prices[2]) / 1e6


def shrunk_priority(p: Column, confidence: Column) -> Column:
    return F.floor((5 + (p - 5) * confidence) * 100 + 0.5) / 100


def string_array(s: Column) -> Column:
    """JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(s, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def json_number(s: Column, path: str, default: float = 0.5) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(s), path, "double"), F.lit(default))


def score(s: Column) -> Column:
    """0..1 from "85%", "0,7", 85 or 0.85; not a number is 0."""
    percent = s.contains("%")
    x = F.replace(F.regexp_replace(s, r"[%\s]", ""), F.lit(","), F.lit(".")).try_cast("double")
    x = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).when(percent | ((x >= 2) & (x <= 100)), x / 100).otherwise(x)
    return clamp(x)


def truthy(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(s)).isin("true", "yes", "1", "y"), F.lit(False))


def action(s: Column) -> Column:
    up = F.upper(F.trim(s))
    return F.when(up.isin("KEEP", "DROP", "UNCERTAIN"), up).otherwise("UNCERTAIN")


def repair_json(s: Column) -> Column:
    """Curly quotes, trailing commas, Python and JS constants; then parsed to a variant, or null."""
    s = F.regexp_replace(F.regexp_replace(s, "[“”]", '"'), r",\s*([}\]])", "$1")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\b(NaN|None|Infinity)\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.try_parse_json(s)


def hash_embedding(tokens: DataFrame, key: str, token: str, size: int = 256) -> DataFrame:
    """key, bucket, weight of the entries other than 0 of each key's vector, which has length 1; tokens that repeat count each time."""
    h = F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("long")))
    hashed = tokens.select(key, h.alias("_h"))
    adds = F.explode(F.array(F.struct((F.col("_h") % size).alias("bucket"), F.lit(1.0).alias("w")), F.struct((F.shiftright("_h", 7) % size).alias("bucket"), F.lit(0.5).alias("w"))))
    sums = hashed.select(key, adds.alias("add")).groupBy(key, "add.bucket").agg(F.sum("add.w").alias("w"))
    return sums.select(key, "bucket", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))
