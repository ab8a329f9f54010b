"""Sums and products of rates against exact fractions."""

import random
from fractions import Fraction

from cutlake.operators import timejobs


def test_combined_rates_are_exact(spark):
    rng = random.Random(3)
    rows = [
        (4_000_000_000, 3_000_000_000, 3_000_000_000, 4_000_000_000), (1, 0, 1, 2), (None, 1, 1, 2), (-(1 << 63), 1, 1, 1), (0, 5, 0, 7),
        (1 << 62, 1, 1 << 62, 1), ((1 << 62) + 1, 3, (1 << 62) + 3, 5), (-3, -6, 1, -2), ((1 << 63) - 1, 1, 1, 1), ((1 << 62) - 1, 1, 1 << 62, 1),
    ]
    for _ in range(200):
        top = 1 << rng.choice([4, 20, 40, 62])
        part = lambda top=top: rng.randint(-top, top)
        rows.append((part(), part() or 1, part(), part() or 1))
    for _ in range(40):
        k, m = rng.randint(1, 1 << 31), rng.randint(1, 1 << 31)
        rows += [(k * 3, m, m * 5, k), (m, k * 7, m, k * 7)]
    found = timejobs.combine_rates(spark.createDataFrame(rows, "a_num long, a_den long, b_num long, b_den long")).collect()
    assert len(found) == len(rows)
    for r in found:
        parts = (r.a_num, r.a_den, r.b_num, r.b_den)
        void = "MissingPart" if None in parts else "ZeroDenominator" if 0 in parts[1::2] else "Overflow" if -(1 << 63) in parts else None
        if void:
            assert (r.error, r.sum_num, r.product_den) == (void, None, None)
            continue
        x, y = Fraction(*parts[:2]), Fraction(*parts[2:])
        fits = []
        for name, exact in (("sum", x + y), ("product", x * y)):
            fits.append(abs(exact.numerator) < 1 << 63 and exact.denominator < 1 << 63)
            assert (r[f"{name}_num"], r[f"{name}_den"]) == ((exact.numerator, exact.denominator) if fits[-1] else (None, None))
        assert r.error == (None if all(fits) else "Overflow")
