"""Column expressions: IEEE division, complex numbers, kernels on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: a signed infinity or NaN for a zero divisor (whose own sign doesn't count), never an error."""
    none = F.lit(0.0)
    at_zero = F.when(F.isnan(a) | (a == none), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b != none, a / b).when(b.isNull() | a.isNull(), F.lit(None)).otherwise(at_zero)


def scaled(alpha: float, v: Column) -> Column:
    """alpha * v; a zero alpha gives zero even for NaN and infinity."""
    if alpha == 0:
        return F.lit(0.0)
    return v if alpha == 1 else F.lit(float(alpha)) * v


# Complex numbers


def cplx(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def conj(z: Column) -> Column:
    return cplx(z["re"], -z["im"])


def cmul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cadd(a: Column, b: Column) -> Column:
    return cplx(a["re"] + b["re"], a["im"] + b["im"])


def cabs(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


# Arrays: one row, one small vector or matrix (an array of rows)


def arr_scal(alpha, x) -> Column:
    return F.transform(x, lambda v: v * alpha)


def arr_set(alpha: float, x) -> Column:
    return F.transform(x, lambda _: F.lit(float(alpha)))


def arr_axpy(alpha, x, y) -> Column:
    return F.zip_with(x, y, lambda a, b: alpha * a + b)


def arr_axpby(alpha, x, beta, y) -> Column:
    return F.zip_with(x, y, lambda a, b: alpha * a + beta * b)


def arr_mult(x, y) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def arr_sum(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def arr_dot(x, y) -> Column:
    return arr_sum(arr_mult(x, y))


def arr_nrm2(x) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def arr_iamax(x) -> Column:
    """Index, from 0, of the first largest magnitude; 0 for an empty array."""
    mags = F.transform(x, lambda v: F.abs(v))
    return F.when(F.size(x) == 0, F.lit(0).cast("long")).otherwise(F.array_position(mags, F.array_max(mags)) - 1)


def mat_gemv(a, x) -> Column:
    return F.transform(a, lambda row: arr_dot(row, x))


def mat_transpose(a) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.element_at(a, 1)) - 1), lambda j: F.transform(a, lambda row: F.get(row, j)))


def mat_gemm(a, b) -> Column:
    return F.transform(a, lambda row: F.transform(mat_transpose(b), lambda col: arr_dot(row, col)))


def mat_ger(alpha, x, y, a) -> Column:
    return F.zip_with(a, x, lambda row, xi: F.zip_with(row, y, lambda v, yj: v + alpha * xi * yj))


def mat_set_identity(a) -> Column:
    return F.transform(a, lambda row, i: F.transform(row, lambda _, j: F.when(i == j, 1.0).otherwise(0.0)))


def mat_add_radial(tiny, a) -> Column:
    """Each diagonal entry's magnitude grown by tiny."""
    return F.transform(a, lambda row, i: F.transform(row, lambda v, j: F.when(i == j, v + F.when(v < 0, -tiny).otherwise(tiny)).otherwise(v)))


def mat_permute_rows(a, pivots, forward: bool = True) -> Column:
    """Row interchanges: row k with row pivots[k], in order or in reverse."""
    steps = F.sequence(F.lit(0), F.size(pivots) - 1)
    steps = steps if forward else F.reverse(steps)

    def swap(m, k):
        p = F.get(pivots, k)
        return F.transform(m, lambda row, i: F.when(i == k, F.get(m, p)).when(i == p, F.get(m, k)).otherwise(row))

    return F.aggregate(steps, a, swap)


def lower_bound(sorted_array, key) -> Column:
    return F.size(F.filter(sorted_array, lambda v: v < key))


def upper_bound(sorted_array, key) -> Column:
    return F.size(F.filter(sorted_array, lambda v: v <= key))


def popcount(x) -> Column:
    return F.bit_count(x)


def least_set_bit(x) -> Column:
    """Place of the lowest set bit, from 1; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1) + 1)


def xorshift(x) -> Column:
    """64-bit xorshift (13, 7, 17)."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))
