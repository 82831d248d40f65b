"""Pixel arithmetic on arrays in row order. Everything stays inside a row: no pixel is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def binary(v: Column, threshold: float) -> Column:
    """1 where a value exceeds a threshold, else 0."""
    return F.transform(v, lambda x: (x > threshold).cast("int"))


def zip_shorter(a: Column, b: Column) -> Column:
    """Elements side by side, as far as the shorter array goes."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def linear_light(x: Column) -> Column:
    """8-bit values to linear light by a power of 2.2."""
    return F.pow(x / 255.0, F.lit(2.2))


def log_difference(a: Column, b: Column, eps: float = 1e-3) -> Column:
    return F.abs(F.log(a + eps) - F.log(b + eps))


def positive_quantile(v: Column, q: float) -> Column:
    """The quantile of the positive values with linear interpolation; null without any."""

    def pick(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (at - low)

    return bound(F.array_sort(F.filter(v, lambda x: x > 0)), pick)


def scaled_by_quantile(v: Column, q: float = 0.99, eps: float = 1e-6) -> Column:
    """Values over the quantile of the positive ones, clipped to 0..1; zeros where there is none."""
    scale = lambda p: F.transform(v, lambda x: F.when(p > 0, clipped(x / (p + eps))).otherwise(F.lit(0.0)))
    return bound(F.coalesce(positive_quantile(v, q), F.lit(0.0)), scale)


def weighted_heat(light: Column, color: Column, texture: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    mixed = F.zip_with(F.zip_with(light, color, lambda a, b: a * weights[0] + b * weights[1]), texture, lambda a, b: a + b * weights[2])
    return F.transform(mixed, lambda x: clipped(x))


def block_values(v: Column, width: int, height: int, size: int) -> Column:
    """The values of each size x size block, blocks in row order."""
    across = width // size
    places = [[(b // across * size + i) * width + b % across * size + j for i in range(size) for j in range(size)] for b in range(across * (height // size))]
    return F.array(*[F.array(*[F.get(v, F.lit(p)) for p in block]) for block in places])


def block_max(v: Column, width: int, height: int, size: int) -> Column:
    return F.transform(block_values(v, width, height, size), F.array_max)


def block_mean(v: Column, width: int, height: int, size: int) -> Column:
    return F.transform(block_values(v, width, height, size), lambda b: total(b) / float(size * size))


def packed(v: Column, width: int, height: int) -> Column:
    """2 x 2 patches as rows of four values."""
    return block_values(v, width, height, 2)


def unpacked(patches: Column, width: int, height: int) -> Column:
    """The inverse of packed."""
    across = width // 2
    return F.array(*[F.get(F.get(patches, F.lit(r // 2 * across + c // 2)), F.lit(r % 2 * 2 + c % 2)) for r in range(height) for c in range(width)])


def position_grid(width: int, height: int) -> Column:
    """(y, x) of every pixel in row order."""
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.struct(F.floor(i / width).cast("int").alias("y"), (i % width).alias("x")))


def shifted(v: Column, width: int, height: int, dx: Column, dy: Column) -> Column:
    """The picture moved right by dx and down by dy; what comes in is zero."""

    def at(i: Column) -> Column:
        r, c = F.floor(i / width).cast("int") - dy, i % width - dx
        return F.when((r >= 0) & (r < height) & (c >= 0) & (c < width), F.get(v, (r * width + c).cast("int"))).otherwise(0)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), at)


def mask_bounds(mask: Column, width: int, half_open: bool = False) -> Column:
    """x1, y1, x2, y2 of the set pixels, the largest included unless half open; null for an empty mask."""
    at = F.filter(F.transform(mask, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(at, lambda i: i % width), F.transform(at, lambda i: F.floor(i / width).cast("int"))
    more = 1 if half_open else 0
    box = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), (F.array_max(xs) + more).alias("x2"), (F.array_max(ys) + more).alias("y2"))
    return F.when(F.size(at) > 0, box)


def nearest_resize(v: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    return F.array(*[F.get(v, F.lit(r * height // to_height * width + c * width // to_width)) for r in range(to_height) for c in range(to_width)])


def gradient_magnitude(v: Column, width: int, height: int) -> Column:
    """Sobel magnitude; pixels beyond the border mirror those inside it."""
    mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k
    at = lambda r, c: F.get(v, F.lit(mirror(r, height) * width + mirror(c, width)))
    out = []
    for r in range(height):
        for c in range(width):
            gx = sum(k * (at(r + d, c + 1) - at(r + d, c - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(r + 1, c + d) - at(r - 1, c + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            out.append(F.sqrt(gx * gx + gy * gy))
    return F.array(*out)


# --- ranges and blends ----------------------------------------------------------------------------------------------


def signed_range(x: Column) -> Column:
    return x * 2.0 - 1.0


def unit_range(x: Column) -> Column:
    return clipped((x + 1.0) / 2.0)


def to_byte(x: Column) -> Column:
    """0..1 to 0..255, fractions cut off."""
    return (clipped(x) * 255.0).cast("int")


def hard_blend(new: Column, old: Column, mask: Column) -> Column:
    return new * mask + old * (1.0 - mask)


def alpha_blend(new: Column, old: Column, logit: Column) -> Column:
    alpha = 1.0 / (1.0 + F.exp(-logit))
    return new * alpha + old * (1.0 - alpha)


def noised(x: Column, noise: Column, t: float) -> Column:
    return x * (1.0 - t) + noise * t


def denoised(z: Column, velocity: Column, t: float) -> Column:
    return z - velocity * t


def normalised(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / std


# --- sizes ----------------------------------------------------------------------------------------------------------


def up_to_multiple(n: Column, step: int = 16) -> Column:
    return (F.floor((n + step - 1) / step) * step).cast("long")


def capped_size(w: Column, h: Column, most: int = 1024, step: int = 16) -> Column:
    """width and height with the long edge capped, then down to a multiple, one step at least; raises if not positive."""
    long = F.greatest(w, h)
    scale = F.when(long > most, F.lit(float(most)) / long).otherwise(F.lit(1.0))
    side = lambda n: F.greatest(F.lit(step), (F.floor(F.floor(n * scale + 1e-9) / step) * step).cast("long")).cast("long")
    bad = F.raise_error(F.lit("width and height must be positive")).cast("struct<width:bigint,height:bigint>")
    return F.when((w <= 0) | (h <= 0), bad).otherwise(F.struct(side(w).alias("width"), side(h).alias("height")))


def short_edge_size(w: Column, h: Column, edge: int, enlarge: bool, step: int = 16) -> Column:
    """width and height with the short edge at `edge` (small pictures grow only if enlarge), up to a multiple."""
    scale = F.lit(float(edge)) / F.least(w, h)
    scale = scale if enlarge else F.least(scale, F.lit(1.0))
    side = lambda n: up_to_multiple(F.floor(n * scale + 0.5), step)
    return F.struct(side(w).alias("width"), side(h).alias("height"))


# --- losses ---------------------------------------------------------------------------------------------------------


def logit_loss(x: Column, z: Column) -> Column:
    """Binary cross-entropy of a logit against a soft label, stable for large logits."""
    return F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))


def masked_error(pred: Column, target: Column, mask: Column, least: float = 1e-4) -> Column:
    """Absolute error inside a mask over the mask's sum."""
    off = F.zip_with(F.zip_with(pred, target, lambda a, b: a - b), mask, lambda d, m: F.abs(d * m))
    return total(off) / F.greatest(total(mask), F.lit(least))


def masked_logit_loss(logits: Column, mask: Column, least: float = 1e-4) -> Column:
    """The loss against ones, weighted by a mask, over the mask's sum."""
    return total(F.zip_with(logits, mask, lambda x, m: logit_loss(x, F.lit(1.0)) * m)) / F.greatest(total(mask), F.lit(least))
