"""Number formatting, equal-width bins and keyed noise as native expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

TWO_52 = float(2**52)
TWO_63 = float(2**63)
FINE = float(2**49)  # below, tenths are found from the product with ten; above, fractions are eighths


def tenths(value: Column) -> Column:
    """``|value| * 10`` as a whole number, the exact product rounded half to even; NULL from ``FINE`` on.

    The product is 8x + 2x, both exact, so what their sum lost to rounding is
    known exactly; it decides where the sum looks like a tie but is none.
    """
    size = F.abs(value)
    product = size * 8.0 + size * 2.0
    lost = (size * 8.0 - product) + size * 2.0
    looks_tied = (product - F.floor(product).cast("double") == 0.5) & (lost != 0.0)
    nearest = F.when(looks_tied, F.floor(product).cast("double") + (lost > 0.0).cast("double")).otherwise(F.rint(product))
    return F.when(size < FINE, nearest.cast("bigint"))


def _whole_text(size: Column) -> Column:
    """The digits of a whole, non-negative double.

    Two parts of 63 bits each convert exactly. Beyond the range of decimals the
    shortest digits that name the double stand for it.
    """
    head = F.floor(size / F.lit(TWO_63))
    exact = head.cast("decimal(38,0)") * F.lit(Decimal(2**63)) + (
        size - head.cast("double") * F.lit(TWO_63)
    ).cast("bigint").cast("decimal(38,0)")
    small = size.cast("bigint").cast("string")
    large = F.regexp_replace(F.format_string("%.1f", size), r"\.0$", "")
    return F.when(size < TWO_63, small).when(size < 1e37, exact.cast("string")).otherwise(large)


def fixed_point_1(value: Column, in_tenths: Column) -> Column:
    """``%.1f`` of a value whose ``tenths`` are at hand.

    ``format_string`` rounds the shortest decimal text half up, so 0.25 and 0.15
    would come out differently.
    """
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    last = in_tenths % 10
    whole = ((in_tenths - last) / 10).cast("bigint")
    near = F.concat(sign, whole.cast("string"), F.lit("."), last.cast("string"))
    size = F.abs(value)
    part = F.when(size < TWO_52, size - F.floor(size).cast("double")).otherwise(F.lit(0.0))
    far = F.concat(sign, _whole_text(size - part), F.lit("."), F.rint(part * 10.0).cast("int").cast("string"))
    return F.when(size < FINE, near).when(value.isNotNull(), far)


def bin_edge(index: Column, low: float, high: float, bins: int) -> Column:
    """Edge ``index`` of ``bins`` equal intervals; the last edge is ``high`` itself."""
    step = (high - low) / bins
    return F.when(index >= bins, F.lit(high)).otherwise(index.cast("double") * F.lit(step) + F.lit(low))


def _clipped(guess: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(guess, F.lit(low).cast("bigint")), F.lit(high).cast("bigint"))


def _moved(guess: Column, down: Column, up: Column) -> Column:
    return guess - down.cast("bigint") + up.cast("bigint")


def right_closed_guess(value: Column, low: float, high: float, bins: int) -> Column:
    """1-based bin up to rounding; see ``right_closed_bin``."""
    return _clipped(F.ceil((value - F.lit(low)) / F.lit((high - low) / bins)), 1, bins)


def right_closed_bin(value: Column, guess: Column, low: float, high: float, bins: int) -> Column:
    """1-based bin of (e[i-1], e[i]], the lowest value included in bin 1.

    The guess is off by at most one, which the exact edges around it tell.
    """
    down = (guess > 1) & (value <= bin_edge(guess - 1, low, high, bins))
    up = (guess < bins) & (value > bin_edge(guess, low, high, bins))
    return _moved(guess, down, up)


def left_closed_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of [e[i], e[i+1]), the highest value included in the last bin."""
    guess = _clipped(F.floor((value - F.lit(low)) / F.lit((high - low) / bins)), 0, bins - 1)
    down = (guess > 0) & (value < bin_edge(guess, low, high, bins))
    up = (guess < bins - 1) & (value >= bin_edge(guess + 1, low, high, bins))
    return _moved(guess, down, up)


def keyed_uniform(secret: str, purpose: str, row_key: Column) -> Column:
    """A uniform number in (0, 1) that depends only on secret, purpose and key.

    A retried task draws the same number again, so no row can be observed under
    two different draws.
    """
    digest = F.sha2(F.concat(F.lit(f"{secret}|{purpose}|"), row_key.cast("string")), 256)
    leading = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (leading.cast("double") + F.lit(0.5)) / F.lit(TWO_52)


def laplace(uniform: Column, scale: float) -> Column:
    """Laplace(0, scale) by inversion of its distribution function."""
    centred = uniform - F.lit(0.5)
    return F.lit(-float(scale)) * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))
