"""Scalar expressions of the evaluation algebra. Undefined values are null, never NaN and never silently 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_floor(a: Column, b: Column) -> Column:
    """a / max(b, 1): 0 where ratio() is null and a is 0."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def ratio_zero(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def finite(x: Column) -> Column:
    """null for NaN and infinities, as published values are."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def draw(tag: str | Column, *key: Column) -> Column:
    """A reproducible draw from 0 to 9999: the first 32 bits of md5(tag|key...) modulo 10000."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.conv(F.substring(F.md5(F.concat_ws("|", tag, *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") % 10000


def uniform(tag: str | Column, *key: Column) -> Column:
    return draw(tag, *key) / F.lit(10000.0)


def hash_order(tag: str | Column, *key: Column) -> Column:
    """The string by which a seeded permutation orders rows."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.md5(F.concat_ws("|", tag, *[k.cast("string") for k in key]))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, also inside lambdas."""
    return F.transform(F.array(x), f)[0]


def softmax(z: Column) -> Column:
    """Stable softmax of an array."""
    scaled = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(e, lambda v: v / t))
    return let(z, lambda a: let(F.array_max(a), lambda m: let(F.transform(a, lambda v: F.exp(v - m)), scaled)))


def grade_probabilities(logits: Column) -> Column:
    """Of the five grade logits, which stand before the referral logit."""
    return softmax(F.slice(logits, 1, 5))


def expected_grade(p: Column) -> Column:
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1), lambda a, k: a * k), F.lit(0.0), lambda a, x: a + x)


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def sigmoid_clipped(x: Column, bound: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))))


def decode(score: Column, thresholds: Sequence[float]) -> Column:
    """The number of thresholds reached; on a threshold counts as reached."""
    return sum((F.when(score >= F.lit(float(t)), 1).otherwise(0) for t in thresholds), F.lit(0))


def temperature_logits(z: Column, t: float) -> Column:
    return softmax(F.transform(z, lambda v: v / F.lit(float(t))))


def temperature_probabilities(p: Column, t: float, clip: float = 1e-12) -> Column:
    """Normalise, take logarithms clipped from below, scale, and normalise again."""
    scaled = lambda q: let(F.aggregate(q, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(q, lambda v: F.ln(F.greatest(v / s, F.lit(clip))) / F.lit(float(t))))
    return softmax(let(p, scaled))


def temperature_probabilities_shifted(p: Column, t: float, shift: float = 1e-10) -> Column:
    """The other variant: log(p + shift), without the first normalisation."""
    return softmax(F.transform(p, lambda v: F.ln(v + F.lit(shift)) / F.lit(float(t))))


def any_disease(p: Column) -> Column:
    return 1 - F.element_at(p, 1)


def tail_probability(p: Column, grade: int = 2) -> Column:
    return F.aggregate(F.slice(p, grade + 1, 5 - grade), F.lit(0.0), lambda a, x: a + x)


def arg_max(p: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def restricted_arg_max(p: Column, referable: Column, bias: Sequence[float] = (0.0,) * 5, clip: float = 1e-12) -> Column:
    """The likeliest grade on the chosen side (0-1 or 2-4), with log-prior biases."""
    z = F.transform(p, lambda v, i: F.ln(F.greatest(v, F.lit(clip))) + F.element_at(F.array(*[F.lit(float(b)) for b in bias]), i + 1))
    low, high = F.slice(z, 1, 2), F.slice(z, 3, 3)
    return F.when(referable, arg_max(high) + 2).otherwise(arg_max(low))


def log_odds(p: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return F.ln(q / (1 - q))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def nearest_index(x: Column, grid: Sequence[float]) -> Column:
    """Place of the nearest grid value, from 0; the first of equally near ones."""
    d = F.array(*[F.abs(x - F.lit(float(g))) for g in grid])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit patterns."""
    return F.bit_count(a.bitwiseXOR(b))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Both ends of Wilson's score interval, null without observations."""
    n, p, zz = total.cast("double"), ratio(successes, total), z * z
    mid = F.try_divide(p + F.try_divide(F.lit(zz / 2), n), 1 + F.try_divide(F.lit(zz), n))
    half = F.try_divide(F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(zz / 4), n * n)), 1 + F.try_divide(F.lit(zz), n))
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def triage(rejected: Column, grade_referable: Column, head_positive: Column) -> Column:
    """Recapture goes first, then a disagreement of grade and head."""
    return F.when(rejected, "recapture").when(grade_referable != head_positive, "uncertain_human_review").when(grade_referable, "refer").otherwise("auto_clear")


def cut_classes(score: Column, low: float, high: float) -> Column:
    """reject, usable or good by two cuts."""
    return F.when(score < low, "reject").when(score < high, "usable").otherwise("good")


def monotone_thresholds(base: Sequence[float], cut: Column, gap: float = 1e-6) -> Column:
    """Four thresholds around a new referral cut, which stands second; the others give way by gap."""
    t2 = F.greatest(F.lit(base[2]), cut + gap)
    return F.array(F.least(F.lit(base[0]), cut - gap), cut, t2, F.greatest(F.lit(base[3]), t2 + gap))


def crossed_threshold(a: Column, b: Column, thresholds: Sequence[float]) -> Column:
    """The threshold between two scores that is nearest to their midpoint; null if none is."""
    low, high = F.least(a, b), F.greatest(a, b)
    between = [F.when((low < t) & (high >= t), F.struct(F.abs((a + b) / 2 - t).alias("d"), F.lit(float(t)).alias("t"))) for t in thresholds]
    return F.array_min(F.array_compact(F.array(*between)))["t"]


def quality_index(sharpness: Column, illumination: Column, coverage: Column) -> Column:
    return 0.40 * sharpness + 0.35 * illumination + 0.25 * coverage


def feedback(rules: Sequence[tuple[Column, str]]) -> Column:
    """The texts of the rules that hold, joined by '; '."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])), "; ")


def acceptance_probability(first: Column, again: Column, retries: int, leave: Column) -> Column:
    """Chance that a capture is accepted in the end: rejections come back up to retries times unless the patient leaves."""
    step = F.struct(F.lit(0.0).alias("p"), F.lit(1.0).alias("reach"))
    def move(s, k):
        reject = F.when(k == 0, first).otherwise(again)
        return F.struct((s["p"] + s["reach"] * (1 - reject)).alias("p"), (s["reach"] * reject * (1 - leave)).alias("reach"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(retries)), step, move)["p"]


def required_servers(rate: Column, service_seconds: Column, utilisation: float = 0.8) -> Column:
    """Servers that keep utilisation at most as given, at least one."""
    return F.greatest(F.lit(1), F.ceil(rate * service_seconds / utilisation)).cast("long")


def utc_iso(ts: Column) -> Column:
    """A timestamp as ISO text; in UTC where the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def explanation_flags(border: Column, centre: Column, spread: Column, border_most: float = 0.25, centre_least: float = 0.1, spread_most: float = 0.6) -> Column:
    """Flags of a heat map's precomputed shares, joined by '; ': energy at the border, outside the field, or everywhere."""
    return feedback([(border > border_most, "border"), (centre < centre_least, "off_field"), (spread > spread_most, "diffuse")])
