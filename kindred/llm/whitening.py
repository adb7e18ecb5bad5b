"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm.common import table
from kindred.session import pin

#: Fixed-point grid of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Digits of a long in base 2**LIMB, and rows whose products of two digits sum exactly in doubles.
LIMB, ROWS = 20, 4096
#: Bits to which an eigenvalue is known, relative to itself, and decimal digits of the vectors' arithmetic.
ROOT_BITS, DIGITS = 160, 90
PRIMES = 8  # primes in one task


def integers(v) -> np.ndarray | None:
    """floor(SCALE * c) of each entry as int64, or None for a vector that takes no part."""
    if v is None or not len(v):
        return None
    c = np.array([np.nan if x is None else x for x in v], float) if isinstance(v, list) else np.asarray(v, float)
    if not np.isfinite(c).all():
        return None
    edge = 2.0**62
    return np.floor(np.clip(c * SCALE, -edge, edge)).astype(np.int64)


def _scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of y and of y yᵀ of this task's rows, exact: products of base 2**20 digits in doubles."""
    sums: dict[int, list] = {}
    for batch in batches:
        rows: dict[int, list] = {}
        for v in batch["embedding"]:
            y = integers(v)
            if y is not None:
                rows.setdefault(len(y), []).append(y)
        for d, part in rows.items():
            held = sums.setdefault(d, [0, np.zeros(d, object), {}])
            held[0] += len(part)
            for i in range(0, len(part), ROWS):
                y = np.array(part[i : i + ROWS])
                digits, rest = [], y.copy()
                while rest.any():
                    low = ((rest + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
                    digits.append(low.astype(float))
                    rest = (rest - low) >> LIMB
                for a, left in enumerate(digits):
                    held[1] += left.sum(axis=0).astype(np.int64).astype(object) << (LIMB * a)
                    for b, right in enumerate(digits):
                        gram = (left.T @ right).astype(np.int64).astype(object)
                        held[2][a + b] = held[2].get(a + b, 0) + gram
    for d, (n, total, grams) in sums.items():
        yield pd.DataFrame({"d": [d], "place": [-1], "i": [0], "row": [[str(n), *map(str, total)]]})
        for place, gram in grams.items():
            yield pd.DataFrame({"d": d, "place": place, "i": range(d), "row": [list(map(str, g)) for g in gram]})


def scatter(vectors: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each length of vectors: n, sums, and n * (sum of y yᵀ) - sums sumsᵀ, all exact integers.

    Only tables of d rows come to the driver; tasks' sums meet in a distributed aggregate.
    """
    parts = vectors.select("embedding").mapInPandas(_scatter, "d int, place int, i int, row array<string>")
    cells = parts.select("d", "place", "i", F.posexplode("row").alias("j", "v"))
    cells = cells.groupBy("d", "place", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found: dict[int, dict] = {}
    for d, place, i, j, v in cells.collect():  # (d * d + d + 1) numbers a length and place of digits
        found.setdefault(d, {})[place, i, j] = int(v)
    out = {}
    for d, cell in found.items():
        n = cell[-1, 0, 0]
        s = [cell[-1, 0, j + 1] for j in range(d)]
        m = [[-a * b for b in s] for a in s]
        for (place, i, j), v in cell.items():
            if place >= 0:
                m[i][j] += n * (v << (LIMB * place))
        out[d] = (n, s, m)
    return out


def primes(count: int) -> list[int]:
    """The `count` largest primes below 2**31."""
    found, at = [], 2**31 - 1
    while len(found) < count:
        small = all(at % q for q in (3, 5, 7, 11, 13))
        # Miller and Rabin's test with these four bases is exact below 3.2e9.
        if small and all(_witness(at, a) for a in (2, 3, 5, 7)):
            found.append(at)
        at -= 2
    return found


def _witness(n: int, a: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    x = pow(a, d, n)
    return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(r - 1))


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - m) modulo p, the constant one first: reduction to Hessenberg form.

    Entries are below 2**31, so products fit int64.
    """
    h, d = m % p, len(m)
    for k in range(1, d - 1):
        at = np.flatnonzero(h[k:, k - 1])
        if not len(at):
            continue
        swap = k + int(at[0])
        if swap != k:
            h[[k, swap]] = h[[swap, k]]
            h[:, [k, swap]] = h[:, [swap, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    # Polynomials of the leading blocks, each from those before it.
    chain = np.zeros((d + 1, d + 1), np.int64)
    chain[0, 0] = 1
    for k in range(1, d + 1):
        chain[k, 1:] = chain[k - 1, :-1]
        chain[k] = (chain[k] - h[k - 1, k - 1] * chain[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            chain[k] = (chain[k] - int(h[i - 1, k - 1]) * below % p * chain[i - 1]) % p
    return chain[d].tolist()


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(t - m) for a symmetric matrix without negative eigenvalues, constant first.

    Every task takes a few primes; Chinese remaindering puts the residues together. A coefficient is a
    sum of products of eigenvalues, none of them negative.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # Maclaurin: the k-th coefficient is at most comb(d, k) * (trace / d) ** k.
    bits = 2 + max((math.comb(d, k) * max(1, -(-trace // d)) ** k).bit_length() for k in range(d + 1))
    moduli = primes(-(-bits // 30) + 1)
    frame = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(max(1, len(moduli) // PRIMES), "p")

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["p"].tolist():
                mod = np.array([[x % p for x in row] for row in m], np.int64).reshape(d, d)
                yield pd.DataFrame({"p": [p], "c": [polynomial_mod(mod, p)]})

    found = {r["p"]: r["c"] for r in frame.mapInPandas(residues, "p long, c array<long>").collect()}
    product = math.prod(moduli)
    out = [0] * (d + 1)
    for p in moduli:
        rest = product // p
        weight = rest * pow(rest, -1, p)
        out = [(c + weight * x) % product for c, x in zip(out, found[p])]
    return [c - product if 2 * c > product else c for c in out]


def _above(poly: list[int], num: int, shift: int) -> int:
    """Number of roots above num / 2**shift, each as often as it occurs.

    Sign changes of the polynomial moved there; exact, as all roots are real (Descartes).
    """
    d = len(poly) - 1
    c = [x << (shift * (d - i)) for i, x in enumerate(poly)]  # roots times 2**shift
    for i in range(d):  # Horner's scheme, once for each power
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], num: int, shift: int) -> int:
    value, unit = 0, 0
    for x in reversed(poly):
        value = value * num + (x << unit)
        unit += shift
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """The `count` largest positive roots as (numerator, shift, times), descending: root in (num, num + 1] / 2**shift.

    Intervals are halved until each holds one root, then by the polynomial's sign alone. An interval that
    still holds several at ROOT_BITS is one root of that multiplicity.
    """
    if len(poly) < 2 or not any(poly[:-1]):
        return []
    top = 1 + max(abs(x) for x in poly[:-1]).bit_length()
    # All roots are below the sum of them, the coefficient under the leading one.
    top = min(top, max(1, (-poly[-2]).bit_length()))
    out: list[tuple[int, int, int]] = []
    spans = [(0, -top, _above(poly, 0, 0))]  # roots above num / 2**shift, in an interval of one unit
    while spans and sum(x[2] for x in out) < count:
        num, shift, many = spans.pop()  # the highest interval left
        if many == 0:
            continue
        known = num.bit_length() if num else 0
        if many == 1 and num:
            out.append((*_refine(poly, num, shift), 1))
        elif known > ROOT_BITS:
            out.append((num, shift, many))
        else:
            num, shift = 2 * num, shift + 1
            high = _count_in(poly, num + 1, shift, num + 2)
            spans += [(num, shift, many - high), (num + 1, shift, high)]
    return out


def _count_in(poly: list[int], low: int, shift: int, high: int) -> int:
    """Roots in (low, high] / 2**shift."""
    if shift < 0:
        return _above(poly, low << -shift, 0) - _above(poly, high << -shift, 0)
    return _above(poly, low, shift) - _above(poly, high, shift)


def _refine(poly: list[int], num: int, shift: int) -> tuple[int, int]:
    """One simple root in (num, num + 1] / 2**shift, to ROOT_BITS."""
    def sign(n, s):
        return _sign(poly, n << max(0, -s), max(0, s))

    upper = sign(num + 1, shift)
    while num.bit_length() <= ROOT_BITS:
        if upper == 0:  # the root is the upper end
            num, shift = 2 * num + 1, shift + 1
            continue
        num, shift = 2 * num, shift + 1
        middle = sign(num + 1, shift)
        if middle == 0:
            upper = 0
        elif middle != upper:
            num += 1
        else:
            upper = middle
    return num, shift


def null_vectors(m: list[list[int]], num: int, shift: int, times: int) -> list[list[float]]:
    """`times` orthonormal vectors that m times itself by num / 2**shift: inverse iteration.

    m less a number just beside the root is factored once; solving turns any start towards the null
    space. Decimal arithmetic, so vectors of close roots are told apart.
    """
    d = len(m)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        root = Decimal(2 * num + 1) / (Decimal(2) ** (shift + 1))
        scale = root
        a = [[Decimal(x) / scale for x in row] for row in m]
        for i in range(d):
            a[i][i] -= 1
        a = np.array(a, object).reshape(d, d)
        order = list(range(d))
        tiny = Decimal(10) ** (20 - DIGITS)
        for k in range(d):
            pivot = max(range(k, d), key=lambda r: abs(a[r, k]))
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(b):
            x = np.array([b[i] for i in order], object)
            for k in range(d):
                x[k + 1 :] = x[k + 1 :] - a[k + 1 :, k] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] = x[k] / a[k, k]
                x[:k] = x[:k] - a[:k, k] * x[k]
            return x

        found: list[np.ndarray] = []
        start = 0
        while len(found) < times and start < 4 * d + 4:
            # Starts differ in every entry, and no two of them are alike.
            x = np.array([Decimal((7919 * (i + 1) * (start + 3) + 104729 * start * start) % 10007 + 1) for i in range(d)], object)
            start += 1
            for _ in range(4):
                for v in found + found:
                    x = x - v * (x @ v)
                x = solve(x / (x @ x).sqrt())
            for v in found + found:
                x = x - v * (x @ v)
            if x @ x > 0:
                found.append(x / (x @ x).sqrt())
        out = []
        for v in found:
            lead = max(range(d), key=lambda i: (abs(v[i]), -i))
            out.append([float(x if v[lead] > 0 else -x) for x in v])
    return out


def components(spark: SparkSession, n: int, m: list[list[int]], count: int) -> list[tuple[float, float, list[float]]]:
    """(eigenvalue of the covariance, its share of the trace, unit vector), descending; a task for each root."""
    trace = sum(m[i][i] for i in range(len(m)))
    roots = largest_roots(characteristic(spark, m), count)
    if not roots:
        return []
    jobs = [(i, str(num), shift, min(times, count)) for i, (num, shift, times) in enumerate(roots)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, num, shift, times in batch.itertuples(index=False):
                found = null_vectors(m, int(num), int(shift), int(times))
                yield pd.DataFrame({"i": i, "j": range(len(found)), "v": found})

    frame = spark.createDataFrame(jobs, "i int, num string, shift int, times int").repartition(len(jobs), "i")
    found = sorted((r["i"], r["j"], r["v"]) for r in frame.mapInPandas(work, "i int, j int, v array<double>").collect())
    out = []
    for i, _, v in found[:count]:
        num, shift, _ = roots[i]
        with localcontext() as ctx:
            ctx.prec = DIGITS
            e = Decimal(2 * num + 1) / (Decimal(2) ** (shift + 1))
            out.append((float(e / n / n), float(e / trace), v))
    return out


def whiten(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component.

    Entries become integers x = floor(1024 c) + 100000; entries of 2**62 and more in size are held at that.
    Rows whose vector is null, empty or holds null or non-finite entries are left out. Vectors of
    different lengths have no common covariance: each length is a fit list of its own, with its own
    n, components and identity_error. A component of eigenvalue 0 (equal rows, fewer rows than
    dimensions) cannot be whitened and is left out, so that a single vector gives no rows. Where
    deviation does not fit a long it is null. Repeated rows and null vec_ids count as they stand.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fits = {}
    for d, (n, s, m) in scatter(rows).items():
        found = components(spark, n, m, min(count, d))
        if found:
            fits[d] = (n, s, found)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases = {d: np.array([v for *_, v in found]) / np.sqrt([[e] for e, *_ in found]) for d, (_, _, found) in fits.items()}
        for batch in batches:
            groups: dict[int, list] = {}
            for vec_id, v in zip(batch["vec_id"], batch["embedding"]):
                y = integers(v)
                if y is not None and len(y) in fits:
                    groups.setdefault(len(y), []).append((vec_id, y))
            for d, part in groups.items():
                n, s, _ = fits[d]
                y = np.array([x for _, x in part])
                most = max(abs(int(y.min())), abs(int(y.max())))
                # n * x - S is the same for shifted x.
                small = 2 * n * most < 2**62
                z = y * n - np.array(s, np.int64) if small else y.astype(object) * n - np.array(s, object)
                about = (z.astype(float) ** 2).sum(axis=1)
                deviation: list = [None] * len(part)
                for at, kind in ((about < 9.2e18, None), ((about >= 9.2e18) & (about < 9.3e18), object)):
                    own = z[at] if kind is None else z[at].astype(object)
                    for i, x in zip(np.flatnonzero(at), (own * own).sum(axis=1).tolist()):
                        deviation[i] = int(x) if x < 2**63 else None
                w = (z / n).astype(float) @ bases[d].T
                yield pd.DataFrame({
                    "vec_id": pd.array([None if pd.isna(i) else int(i) for i, _ in part], "Int64"), "d": d,
                    "deviation": pd.array(deviation, "Int64"), "w": list(w),
                })

    white = pin(rows.mapInPandas(project, "vec_id long, d int, deviation long, w array<double>"))
    summary = _identity(white, {d: len(found) for d, (_, _, found) in fits.items()})
    facts = [
        (d, k + 1, n, share, summary[d]) for d, (n, _, found) in fits.items() if d in summary for k, (_, share, _) in enumerate(found)
    ]
    about = spark.createDataFrame(facts, "d int, component int, n long, explained double, identity_error double")
    parts = white.select("vec_id", "d", "deviation", F.posexplode("w").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return parts.join(F.broadcast(about), ["d", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )


def _identity(white: DataFrame, sizes: dict[int, int]) -> dict[int, float]:
    """By length: the largest entry of the covariance of whitened values less the identity."""
    out = {}
    for d, k in sizes.items():
        own = white.where(F.col("d") == d).select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
        means = own.agg(*[F.avg(c) for c in own.columns]).first()
        if means[0] is None:
            continue
        centred = own.select(*[(F.col(c) - F.lit(means[i])).alias(c) for i, c in enumerate(own.columns)])
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        cov = centred.agg(*[F.avg(F.col(f"w{i}") * F.col(f"w{j}")) for i, j in pairs]).first()
        out[d] = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
