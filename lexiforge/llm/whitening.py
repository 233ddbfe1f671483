"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Each entry c becomes the integer x = floor(64 c) + 1000000. With y = x - m, m the mean rounded to an integer, the scatter
A = n * sum(y y') - sum(y) sum(y)' is n^2 times the covariance, exactly; tasks sum it in integers and Spark adds the
tasks' parts. The characteristic polynomial of A is found modulo enough primes, each by reduction to Hessenberg form in a
Spark task, and put together by Chinese remaindering. All its roots are real and none is negative, so the sign changes of
the polynomial shifted to a point count the roots beyond it, multiple ones included (Budan and Fourier are exact then):
bisection with exact integers isolates each eigenvalue and refines it to 80 bits. Its null space comes from inverse
iteration on A less the eigenvalue, with residuals in exact integers, so components are right to double precision even
where eigenvalues are close; a multiple eigenvalue gets as many orthonormal components.

What reaches the driver are sums over dimensions (d^2 / 2 cells) and polynomials (d + 1 coefficients a prime); `max_dims`
bounds d, more raise ValueError. Rows are never collected.

Defined results: rows are dropped whose vector is null, or holds entries that are null, not finite or at least 2^47 (64 of
which double precision can no longer floor), or has another length than most vectors have (ties: the longest). A null
id stays null; repeated rows and ids are rows each. Directions in which no vector differs have eigenvalue 0 and are no
components, so equal vectors, a single one or an empty table give an empty result. `deviation` is null beyond a long;
`deviation_exact` holds its digits. Columns other than id and vector are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, stored

SCALE, OFFSET, COMPONENTS, MAX_DIMS = 64, 1_000_000, 32, 1024
#: Entries from here on are dropped; bits of an eigenvalue; primes are less than this.
MOST_ENTRY, BITS, PRIME_TOP = 2.0**47, 80, 1 << 31
#: Sums leave a task in parts of so many bits, so that no sum of parts overflows.
PART_BITS = 48
LONG = 1 << 63
PARTS = "cell int, limb int, part long"
PROJECTED = "vec_id long, deviation long, deviation_exact string, whitened array<double>"


class Whitening(NamedTuple):
    """n vectors with these sums per dimension; eigenvalues of n^2 times their covariance, exact to 80 bits, falling; the
    components as columns; trace and characteristic polynomial (from the leading coefficient) of that matrix."""

    n: int
    sums: list[int]
    eigenvalues: list[Fraction]
    components: np.ndarray
    trace: int
    polynomial: list[int]

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def valid(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows whose entries are all numbers."""
    v = F.col(column).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST_ENTRY))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & good)


def integers(column: pa.Array) -> np.ndarray:
    """rows x dimensions of x, from vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(len(column), -1)


def parts(values: list[int]) -> pa.RecordBatch:
    rows = [(cell, limb, (abs(v) >> (PART_BITS * limb) & ((1 << PART_BITS) - 1)) * (1 if v > 0 else -1)) for cell, v in enumerate(values) for limb in range(-(-v.bit_length() // PART_BITS))]
    kinds = [pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=[c.split()[0] for c in PARTS.split(", ")])


def added(made: DataFrame) -> dict[int, int]:
    """cell -> exact sum over all tasks."""
    rows = made.groupBy("cell", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, int] = {}
    for r in rows:
        out[r["cell"]] = out.get(r["cell"], 0) + (int(r["total"]) << (PART_BITS * r["limb"]))
    return out


def sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: list[int] | None = None
    for batch in batches:
        x = integers(batch.column("v"))
        # entries are below 2^54, so 512 of them stay inside 64 bits
        now = [sum(map(int, s)) for s in zip(*[x[i : i + 512].sum(axis=0) for i in range(0, len(x), 512)], strict=True)]
        totals = now if totals is None else [a + b for a, b in zip(totals, now, strict=True)]
    if totals is not None:
        yield parts(totals)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y in exact integers, by products that doubles hold exactly."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    low, out = 20, 0
    limbs = [((np.abs(y) >> (low * k)) & ((1 << low) - 1)) * np.sign(y) for k in range(-(-top.bit_length() // low))]
    for i in range(0, len(y), 4096):
        f = [x[i : i + 4096].astype(np.float64) for x in limbs]
        for a in range(len(f)):
            for b in range(len(f)):
                out = out + (f[a].T @ f[b]).astype(np.int64).astype(object) * (1 << (low * (a + b)))
    return out


def scatter_parts(batches: Iterator[pa.RecordBatch], centre: list[int]) -> Iterator[pa.RecordBatch]:
    d, at = len(centre), np.array(centre, dtype=np.int64)
    upper, total = np.triu_indices(d), 0
    for batch in batches:
        total = total + exact_gram(integers(batch.column("v")) - at)
    if isinstance(total, np.ndarray):
        yield parts([int(x) for x in total[upper]])


def primes(n: int) -> list[int]:
    """The n largest primes below PRIME_TOP."""
    def is_prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for a in (2, 3, 5, 7):  # enough below 3,215,031,751
            x = pow(a, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, p = [], PRIME_TOP - 1
    while len(found) < n:
        if is_prime(p):
            found.append(p)
        p -= 2
    return found


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix in Hessenberg form similar to a modulo p."""
    h, d = a.copy(), len(a)
    for k in range(d - 2):
        found = np.flatnonzero(h[k + 1 :, k])
        if not len(found):
            continue
        j = k + 1 + int(found[0])
        if j > k + 1:
            h[[k + 1, j]] = h[[j, k + 1]]
            h[:, [k + 1, j]] = h[:, [j, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo p, the constant first."""
    h, d = hessenberg(a, p), len(a)
    made = np.zeros((d + 1, d + 1), dtype=np.int64)
    made[0, 0] = 1
    for k in range(1, d + 1):
        weights, product = np.zeros(k, dtype=np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            weights[i - 1] = int(h[i - 1, k - 1]) * product % p
        made[k, 1:] = made[k - 1, :-1]
        made[k] = (made[k] - (weights[:, None] * made[:k] % p).sum(axis=0)) % p
    return made[d].tolist()


def residues(batches: Iterator[pa.RecordBatch], a: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ps = batch.column("prime").to_pylist()
        rows = [polynomial_mod(np.array([[x % p for x in row] for row in a], dtype=np.int64), p) for p in ps]
        yield pa.RecordBatch.from_arrays([batch.column("prime"), pa.array(rows, pa.list_(pa.int64()))], names=["prime", "coefficients"])


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Coefficients of det(x - a) from the leading one, for a symmetric integer matrix without negative eigenvalues: they
    alternate in sign, and the k-th is at most binomial(d, k) (trace / d)^k."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    most = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    ps = primes(most.bit_length() // (PRIME_TOP.bit_length() - 2) + 1)
    table = spark.createDataFrame([(p,) for p in ps], "prime long").repartition(min(len(ps), 64), "prime")
    modulus, sizes = 1, [0] * (d + 1)  # of the k-th coefficient without its sign
    for row in table.mapInArrow(lambda batches: residues(batches, a), "prime long, coefficients array<long>").collect():
        p = row["prime"]
        inverse = pow(modulus, -1, p)
        signed = [(c if k % 2 == 0 else -c) for k, c in enumerate(reversed(row["coefficients"]))]
        sizes = [x + modulus * ((c - x) * inverse % p) for x, c in zip(sizes, signed, strict=True)]
        modulus *= p
    return [x if k % 2 == 0 else -x for k, x in enumerate(sizes)]


def roots_above(polynomial: list[int], at: int, bits: int) -> int:
    """How many roots are greater than at / 2^bits, with their multiplicities, where all roots are real."""
    c = [x << (bits * k) for k, x in enumerate(polynomial)]
    for stop in range(len(c), 1, -1):  # the polynomial moved so that the point is 0
        carry = c[0]
        for i in range(1, stop):
            carry = c[i] = c[i] + carry * at
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def value_sign(polynomial: list[int], at: int, bits: int) -> int:
    value = 0
    for k, x in enumerate(polynomial):
        value = value * at + (x << (bits * k))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots, falling, until there are `count`. Roots that agree in BITS
    bits are one."""
    while len(polynomial) > 1 and not polynomial[-1]:
        polynomial = polynomial[:-1]
    top = 1 << max(1, -polynomial[1] if len(polynomial) > 1 else 1).bit_length()
    found: list[tuple[Fraction, int]] = []
    have = 0
    # intervals (a, b] over 2^bits with the roots above either end, the highest last
    todo = [(0, top, 0, roots_above(polynomial, 0, 0), 0)] if len(polynomial) > 1 else []
    while todo and have < count:
        a, b, bits, over_a, over_b = todo.pop()
        several = over_a - over_b
        if not several:
            continue
        if several == 1 and a:
            after = value_sign(polynomial, b, bits)
            while after and (b - a) << BITS > a:
                a, b, bits = 2 * a, 2 * b, bits + 1
                middle = (a + b) // 2
                now = value_sign(polynomial, middle, bits)
                if now == 0:
                    b, after = middle, 0
                elif now == after:
                    b = middle
                else:
                    a = middle
            found.append((Fraction(b if not after else a + b, (1 if not after else 2) << bits), 1))
            have += 1
        elif a and (b - a) << BITS <= a:
            found.append((Fraction(a + b, 2 << bits), several))
            have += several
        else:
            a, b, bits = 2 * a, 2 * b, bits + 1
            middle = (a + b) // 2
            over = roots_above(polynomial, middle, bits)
            todo += [(a, middle, bits, over_a, over), (middle, b, bits, over, over_b)]
    return found


def null_space(a: list[list[int]], root: Fraction, many: int, seed: int = 1) -> np.ndarray:
    """d x many orthonormal columns that a less the root sends to 0, by inverse iteration; residuals are exact."""
    d, trace, fixed = len(a), sum(a[i][i] for i in range(len(a))), 120
    exact = np.array(a, dtype=object)
    near = np.array([[x / trace for x in row] for row in a]) - float(root / trace) * np.eye(d)
    moved = near - 2.0**-44 * np.eye(d)  # invertible
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, many)))[0]
    for _ in range(4):
        v = np.linalg.qr(np.linalg.solve(moved, v))[0]
    whole = np.array([[int(x * 2.0**60) << (fixed - 60) for x in row] for row in v], dtype=object)
    for _ in range(12):
        v = (whole / (1 << fixed)).astype(np.float64)
        left = exact.dot(whole) * root.denominator - whole * root.numerator
        left = (left / (trace * root.denominator << fixed)).astype(np.float64)
        bordered = np.block([[near, v], [v.T, np.zeros((many, many))]])
        step = np.linalg.lstsq(bordered, np.concatenate([-left, np.zeros((many, many))]), rcond=None)[0][:d]
        whole = whole + np.array([[int(Decimal(float(x)) * (1 << fixed)) for x in row] for row in step], dtype=object)
        if np.abs(step).max(initial=0) < 2.0**-58:
            break
    v = np.linalg.qr((whole / (1 << fixed)).astype(np.float64))[0]
    largest = np.abs(v).argmax(axis=0)
    return v * np.where(v[largest, np.arange(many)] < 0, -1.0, 1.0)


def fit_whitening(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, max_dims: int = MAX_DIMS) -> Whitening | None:
    """The whitening of all valid vectors, or None without any."""
    spark, rows = vectors.sparkSession, valid(vectors, vec_id, column)
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not lengths:
        return None
    d, n = lengths[0]["size"], lengths[0]["n"]
    if d > max_dims:
        raise ValueError(f"vectors of {d} dimensions; at most {max_dims}")
    rows = rows.filter(F.size("v") == d).select("v")
    found = added(rows.mapInArrow(sum_parts, PARTS)) if d else {}
    sums = [found.get(i, 0) for i in range(d)]
    centre = [round(Fraction(s, n)) for s in sums]
    cells = added(rows.mapInArrow(lambda batches: scatter_parts(batches, centre), PARTS)) if d else {}
    rest, a = [s - n * m for s, m in zip(sums, centre, strict=True)], [[0] * d for _ in range(d)]
    for cell, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
        a[i][j] = a[j][i] = n * cells.get(cell, 0) - rest[i] * rest[j]
    trace = sum(a[i][i] for i in range(d))
    if not trace:
        return Whitening(n, sums, [], np.zeros((d, 0)), 0, [1] + [0] * d)
    polynomial = characteristic_polynomial(spark, a)
    roots = largest_roots(polynomial, components)
    columns = np.concatenate([null_space(a, root, many) for root, many in roots], axis=1)[:, :components]
    return Whitening(n, sums, [root for root, many in roots for _ in range(many)][:components], columns, trace, polynomial)


def projected(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    n, d = model.n, len(model.sums)
    centre = [round(Fraction(s, n)) for s in model.sums]
    rest = [s - n * m for s, m in zip(model.sums, centre, strict=True)]
    shift = np.array([Fraction(r, n) for r in rest], dtype=np.float64)
    scaled = model.components / np.sqrt([float(e / (n * n)) for e in model.eigenvalues])
    for batch in batches:
        y = integers(batch.column("v")) - np.array(centre, dtype=np.int64)
        top = n * int(np.abs(y).max(initial=0)) + n
        apart = n * (y if top * top * d < LONG else y.astype(object)) - np.array(rest, dtype=np.int64 if top * top * d < LONG else object)
        deviation = [int(x) for x in (apart * apart).sum(axis=1)]
        made = (y - shift) @ scaled
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                pa.array([x if x < LONG else None for x in deviation], pa.int64()),
                pa.array([str(x) for x in deviation], pa.string()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.reshape(-1))),
            ],
            names=[c.split()[0] for c in PROJECTED.split(", ")],
        )


def project(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, deviation, deviation_exact, whitened of each valid vector of the model's length."""
    rows = valid(vectors, vec_id, column).filter(F.size("v") == len(model.sums))
    return rows.mapInArrow(lambda batches: projected(batches, model), PROJECTED)


def double_parts(batches: Iterator[pa.RecordBatch], mean: list[float] | None) -> Iterator[pa.RecordBatch]:
    """Sums of whitened, or of the products of its entries less the mean."""
    total: np.ndarray | None = None
    for batch in batches:
        w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        now = w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean))
        total = now.reshape(-1) if total is None else total + now.reshape(-1)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the column `whitened` less the identity, from all rows."""
    k, rows = len(model.eigenvalues), whitened.select("whitened")

    def summed(mean: list[float] | None) -> np.ndarray:
        made = rows.mapInArrow(lambda batches: double_parts(batches, mean), "cell int, value double")
        found = made.groupBy("cell").agg(F.sum("value").alias("value")).collect()
        return np.array([x for _, x in sorted((r["cell"], r["value"]) for r in found)]) / model.n

    mean = summed(None).tolist()
    return float(np.abs(summed(mean).reshape(k, k) - np.eye(k)).max())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    if model is None or not model.eigenvalues:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    rows = stored(project(vectors, model), "whitened")
    error = identity_error(rows, model)
    explained = F.array(*[F.lit(x) for x in model.explained])
    each = rows.select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_exact",
    )
