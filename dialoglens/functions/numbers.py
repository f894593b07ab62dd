"""Number expressions: vectors, bins, bands, and draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoglens.config import DEFAULT_SLA, SLA
from dialoglens.functions.text import hex_number


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """At unit length; a zero vector stays."""
    # the norm is an array's one element, so that it is taken once a vector and not once a component
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0]


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors have cosine 0 with any other."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))


def exact_mean(score: Column) -> Column:
    """The mean of scores in whole billionths: their sum is exact, so it doesn't depend on the order of rows."""
    return F.sum(F.round(score * 1e9, 0).cast("decimal(19,0)")).cast("double") / F.count(score) / 1e9


def five_bins(score: Column) -> Column:
    """0 to 4, the nearest quarter, halves to even."""
    return F.least(F.lit(4), F.greatest(F.lit(0), F.bround(score * 4, 0).cast("int")))


def status_band(rate: Column) -> Column:
    """Of an SLA pass rate."""
    return F.when(rate >= 0.9, "good").when(rate >= 0.7, "fair").otherwise("poor")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "middle").otherwise("low")


def threshold(metric: Column, default: float | None = DEFAULT_SLA) -> Column:
    """A metric's SLA threshold as a chain of conditions, without a join."""
    out = F.lit(default).cast("double")
    for name, value in SLA.items():
        out = F.when(metric == name, value).otherwise(out)
    return out


def draw(*parts: Column) -> Column:
    """60 bits of the md5 of the parts joined with ``|``: the same long wherever it is computed."""
    return hex_number(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 15)


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens; models without a price cost nothing."""
    return (tokens_in * F.coalesce(price_in, F.lit(0.0)) + tokens_out * F.coalesce(price_out, F.lit(0.0))) / 1e6
