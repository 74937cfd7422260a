"""Vector arithmetic on arrays, and box overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 for vectors of different or no length, or nearly none."""
    fits = (F.size(_col(a)) == F.size(_col(b))) & (F.size(_col(a)) > 0) & (norm(a) >= 1e-6) & (norm(b) >= 1e-6)
    return F.when(fits, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def unit(a) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda x: x.cast("double") / n)).otherwise(_col(a).cast("array<double>"))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes given by corner and size."""
    ax, ay, aw, ah, bx, by, bw, bh = (_col(c) for c in (ax, ay, aw, ah, bx, by, bw, bh))
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def softmax(a) -> Column:
    """Exponentials over their sum, safe for large values."""
    top = F.array_max(_col(a))
    e = F.transform(_col(a), lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def decode_floats(data) -> Column:
    """Little-endian 32-bit floats of binary data as an array; bytes after the last whole float are left out."""
    b = _col(data)

    def number(at: Column) -> Column:
        h = F.hex(F.substr(b, at * 4 + 1, F.lit(4)))
        bits = F.conv(F.concat(*[F.substr(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
        power, rest = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND((1 << 23) - 1)
        size = (
            F.when((power == 255) & (rest == 0), F.lit(float("inf")))
            .when(power == 255, F.lit(float("nan")))
            .when(power == 0, rest * F.lit(2.0**-149))
            .otherwise((1 + rest / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), power - 127))
        )
        return F.when(F.shiftright(bits, 31) == 1, -size).otherwise(size).cast("float")

    n = F.floor(F.octet_length(b) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).when(n == 0, F.array().cast("array<float>"))
