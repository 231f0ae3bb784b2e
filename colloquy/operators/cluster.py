"""Soft clustering of a dialogue's nodes by a Gaussian mixture whose size minimises the BIC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.functions.fixed import GUARD_DIMENSION, MEMBERSHIP, MOST_COMPONENTS, SEED

REGULAR, TOLERANCE, ROUNDS = 1e-6, 1e-3, 100
#: Dimensions in which the EM works on products of coordinates, and the squared length up to which these keep precision enough.
WIDE, SHORT = range(8, 257), 1e4
#: Points whose products are made at once; points of a group from which its sizes are dealt out, to so many tasks of equal work.
BLOCK, LARGE, SHARES = 512, 256, 13


class Mixture:
    """Full-covariance EM from k-means centres (or given means)."""

    def __init__(self, x: np.ndarray, k: int, means: np.ndarray | None = None, seed: int = SEED):
        self._begin(x, k)
        centre = means if means is not None else _kmeans(x, k, _seeds(x, k, seed))
        if _wide(x):
            _together(x, [self], [_closest(x, centre)], means)
            return
        resp = np.zeros((self.n, k))
        resp[np.arange(self.n), _closest(x, centre)] = 1
        self._maximise(resp)
        if means is not None:
            self.means = np.asarray(means, float)
        for _ in range(ROUNDS):
            log = self._log()
            total = np.logaddexp.reduce(log, axis=1)
            self.bounds.append(float(total.mean()))
            self.posterior = np.exp(log - total[:, None])
            if self._still():
                break
            self._maximise(self.posterior)
        log = self._log()
        total = np.logaddexp.reduce(log, axis=1)
        self.posterior = np.exp(log - total[:, None])
        self._judge(total.sum())

    def _begin(self, x: np.ndarray, k: int) -> Mixture:
        self.x, self.k, (self.n, self.d) = x, k, x.shape
        self.bounds: list[float] = []
        return self

    def _still(self) -> bool:
        return len(self.bounds) > 1 and abs(self.bounds[-1] - self.bounds[-2]) < TOLERANCE

    def _judge(self, likelihood: float) -> None:
        free = self.k * self.d * (self.d + 1) / 2 + self.k * self.d + self.k - 1
        self.bic = float(-2 * likelihood + free * np.log(self.n))

    def _maximise(self, resp: np.ndarray) -> None:
        mass = resp.sum(0) + 10 * np.finfo(float).eps
        self.weights, self.means = mass / self.n, resp.T @ self.x / mass[:, None]
        apart = self.x[None] - self.means[:, None]
        cov = np.einsum("kni,knj->kij", apart * resp.T[:, :, None], apart) / mass[:, None, None] if self.d < 8 else np.matmul((apart * resp.T[:, :, None]).transpose(0, 2, 1), apart) / mass[:, None, None]
        cov[:, np.arange(self.d), np.arange(self.d)] += REGULAR
        self.roots = np.linalg.cholesky(cov)

    def _log(self) -> np.ndarray:
        y = np.linalg.solve(self.roots, (self.x[None] - self.means[:, None]).transpose(0, 2, 1))
        size = np.log(np.diagonal(self.roots, axis1=1, axis2=2)).sum(1)
        return (-0.5 * (self.d * np.log(2 * np.pi) + (y**2).sum(1)) - size[:, None]).T + np.log(self.weights)

    def _from_sums(self, sums: np.ndarray, middle: np.ndarray) -> None:
        """_maximise from the weighted sums of the products: pairs of coordinates less the middle, coordinates, ones."""
        d, (up, across) = self.d, np.triu_indices(self.d)
        first, ones = sums[:, -d - 1 : -1], sums[:, -1]
        mass = ones + 10 * np.finfo(float).eps
        self.weights, self.means = mass / self.n, (first + ones[:, None] * middle) / mass[:, None]
        off = self.means - middle
        cov = np.empty((len(sums), d, d))
        cov[:, up, across] = cov[:, across, up] = sums[:, : -d - 1]
        cross = off[:, :, None] * first[:, None]
        cov += ones[:, None, None] * off[:, :, None] * off[:, None] - cross - cross.transpose(0, 2, 1)
        cov /= mass[:, None, None]
        cov[:, np.arange(d), np.arange(d)] += REGULAR
        self.roots = np.linalg.cholesky(cov)

    def _factors(self, middle: np.ndarray) -> np.ndarray:
        """What the products are multiplied with for _log."""
        (up, across), off = np.triu_indices(self.d), self.means - middle
        half = np.linalg.inv(self.roots)
        inner = np.matmul(half.transpose(0, 2, 1), half)
        line = np.matmul(inner, off[:, :, None])[:, :, 0]
        size = np.log(np.diagonal(self.roots, axis1=1, axis2=2)).sum(1)
        rest = np.log(self.weights) - size - 0.5 * (self.d * np.log(2 * np.pi) + (off * line).sum(1))
        return np.hstack((inner[:, up, across] * np.where(up == across, -0.5, -1.0), line, rest[:, None]))


def _wide(x: np.ndarray) -> bool:
    return x.shape[1] in WIDE and ((x - x.mean(0)) ** 2).sum(1).max() <= SHORT


def _products(z: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A column a point: its pairs of coordinates, its coordinates, and 1."""
    (d, n), at = z.shape, 0
    out = out[:, :n]
    for i in range(d):
        np.multiply(z[i], z[i:], out=out[at : at + d - i])
        at += d - i
    out[at:-1], out[-1] = z, 1
    return out


def _together(x: np.ndarray, fits: list[Mixture], own: list[np.ndarray], means: np.ndarray | None = None, posterior: bool = True) -> None:
    """The EM of several mixtures over the same points. A log density is linear in a point's products, and so are the
    sums that the next round needs: a block's products are made once a round, for all components of all mixtures."""
    (n, d), middle = x.shape, x.mean(0)
    made = np.empty((d * (d + 1) // 2 + d + 1, min(n, BLOCK)))
    blocks = [(slice(i, i + BLOCK), np.ascontiguousarray((x[i : i + BLOCK] - middle).T)) for i in range(0, n, BLOCK)]
    sums = [np.zeros((f.k, len(made))) for f in fits]
    for b, z in blocks:
        p = _products(z, made)
        for f, o, s in zip(fits, own, sums):
            s += (o[b] == np.arange(f.k)[:, None]).astype(float) @ p.T
    for f, s in zip(fits, sums):
        f._from_sums(s, middle)
        if means is not None:
            f.means = np.asarray(means, float)
    going, resp = fits, {}
    for turn in range(ROUNDS + 1):
        factors = np.vstack([f._factors(middle) for f in going])
        sums, totals = np.zeros(factors.shape), [0.0] * len(going)
        if posterior:
            resp = {id(f): np.empty((f.k, n)) for f in going}
        for b, z in blocks:
            p = _products(z, made)
            log, at = factors @ p, 0
            for i, f in enumerate(going):
                part = log[at : at + f.k]
                most = part.max(0)
                part -= most
                np.exp(part, out=part)
                total = part.sum(0)
                part /= total
                totals[i] += float((np.log(total) + most).sum())
                if posterior:
                    resp[id(f)][:, b] = part
                at += f.k
            if turn < ROUNDS:
                sums += log @ p.T
        left, at = [], 0
        for f, total in zip(going, totals):
            if turn < ROUNDS:
                f.bounds.append(total / n)
            if turn == ROUNDS or f._still():
                f._judge(total)
                if posterior:
                    f.posterior = np.ascontiguousarray(resp[id(f)].T)
            else:
                f._from_sums(sums[at : at + f.k], middle)
                left.append(f)
            at += f.k
        going = left
        if not going:
            return


def _closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The first of the nearest centres. Where rounding might decide, differences are squared and added up."""
    plain = lambda rows: ((rows[:, None] - centre[None]) ** 2).sum(2)
    if len(x) * centre.size <= 2**20:
        return plain(x).argmin(1)
    gap = (centre**2).sum(1) - 2 * (x @ centre.T)
    own, least = gap.argmin(1), gap.min(1)
    gap[np.arange(len(x)), own] = np.inf
    close = np.flatnonzero(gap.min(1) - least <= 1e-10 * ((x**2).sum(1).max() + (centre**2).sum(1).max()))
    for i in range(0, len(close), BLOCK):
        own[close[i : i + BLOCK]] = plain(x[close[i : i + BLOCK]]).argmin(1)
    return own


def _seeds(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """First centres for k-means; those for fewer are the first of them."""
    rng, n = np.random.default_rng(seed), len(x)
    centre, gap = [x[rng.integers(n)]], np.full(n, np.inf)
    while len(centre) < k:
        gap = np.minimum(gap, ((x - centre[-1]) ** 2).sum(1))
        centre.append(x[rng.choice(n, p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(n)])
    return np.stack(centre)


def _kmeans(x: np.ndarray, k: int, centre: np.ndarray) -> np.ndarray:
    for _ in range(30):
        own = _closest(x, centre)
        new = np.stack([x[own == j].mean(0) if (own == j).any() else centre[j] for j in range(k)])
        if np.allclose(new, centre):
            break
        centre = new
    return centre


def criteria(x: np.ndarray, sizes: list[int], seed: int = SEED) -> list[float]:
    """The BIC of a mixture of each size."""
    if not _wide(x):
        return [Mixture(x, k, seed=seed).bic for k in sizes]
    first, fits, own = _seeds(x, max(sizes), seed), [], []
    for k in sizes:
        fits.append(Mixture.__new__(Mixture)._begin(x, k))
        own.append(_closest(x, _kmeans(x, k, first[:k])))
    _together(x, fits, own, posterior=False)
    return [f.bic for f in fits]


def shares(n: int, most: int = MOST_COMPONENTS) -> list[list[int]]:
    """The sizes from 1 to min(most, n) - 1 in up to SHARES runs of about equal sums: neighbours take as many rounds."""
    sizes = np.arange(1, max(2, min(most, n)))
    part = (sizes.cumsum() - 1) * SHARES // sizes.sum()
    return [sizes[part == i].tolist() for i in np.unique(part)]


def best_size(x: np.ndarray, most: int = MOST_COMPONENTS, seed: int = SEED) -> int:
    """The k from 1 to min(most, n) - 1 of least BIC, the first of equals."""
    return min((bic, k) for own in shares(len(x), most) for bic, k in zip(criteria(x, own, seed), own))[1]


def memberships(posterior: np.ndarray, threshold: float = MEMBERSHIP) -> list[list[int]]:
    """Components whose probability is over the threshold: none, one or more for each point."""
    return [np.flatnonzero(row > threshold).tolist() for row in posterior]


def labels(x: np.ndarray, dimension: int = GUARD_DIMENSION, threshold: float = MEMBERSHIP, means: np.ndarray | None = None, size: int | None = None) -> list[list[int]]:
    """Labels of points; samples of up to dimension + 1 points share label 0; equal points share all labels."""
    if len(x) <= dimension + 1:
        return [[0] for _ in x]
    own = memberships(Mixture(x, len(means) if means is not None else size or best_size(x), means).posterior, threshold)
    _, same = np.unique(x, axis=0, return_inverse=True)
    same, union = same.reshape(-1), {}
    for g, found in zip(same.tolist(), own):
        union.setdefault(g, set()).update(found)
    return [sorted(union[g]) for g in same.tolist()]


def _best_sizes(rows: DataFrame, key: str, node: str) -> DataFrame:
    """key and `size__` of each group, whose sizes are dealt out to SHARES tasks. A group's points are one packed row."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values(node, kind="stable")["v__"].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[:1].to_numpy(), "n__": [len(x)], "x__": [x.astype(float).tobytes()]})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group, n, packed, share in zip(pdf[key], pdf["n__"], pdf["x__"], pdf["share__"]):
                x, own = np.frombuffer(packed).reshape(n, -1), shares(n)
                if share < len(own):
                    own = own[share]
                    yield pd.DataFrame({key: [group] * len(own), "k__": own, "bic__": criteria(x, own)})

    held = rows.schema[key]
    packed = rows.groupBy(key).applyInPandas(pack, T.StructType([held, T.StructField("n__", T.LongType()), T.StructField("x__", T.BinaryType())]))
    dealt = packed.withColumn("share__", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(_tasks(rows), key, "share__")
    judged = dealt.mapInPandas(judge, T.StructType([held, T.StructField("k__", T.IntegerType()), T.StructField("bic__", T.DoubleType())]))
    return judged.groupBy(key).agg(F.min(F.struct("bic__", "k__")).getField("k__").alias("size__"))


def _tasks(df: DataFrame) -> int:
    """A number of tasks that spreads few heavy rows; given numbers aren't merged by their bytes."""
    return max(16 * SHARES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cluster(df: DataFrame, key: str, node: str, vector: str, dimension: int = GUARD_DIMENSION, threshold: float = MEMBERSHIP, means: np.ndarray | None = None) -> DataFrame:
    """key, node and `labels` of every row. Groups under the guard never reach Python; the sizes of large ones are tried in several tasks."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n__"))
    sized = df.select(key, node, F.col(vector).cast("array<double>").alias("v__")).join(sizes, key)
    few = sized.where(F.col("n__") <= dimension + 1).select(key, node, F.array(F.lit(0)).alias("labels"))
    many = sized.where(F.col("n__") > dimension + 1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(node, kind="stable")
        size = int(pdf["size__"].iloc[0]) if "size__" in pdf else None
        return pd.DataFrame({key: pdf[key], node: pdf[node], "labels": labels(np.stack(pdf["v__"].to_numpy()), dimension, threshold, means, size)})

    schema = T.StructType([df.schema[key], df.schema[node], T.StructField("labels", T.ArrayType(T.IntegerType()))])
    if means is not None:
        return few.unionByName(many.groupBy(key).applyInPandas(fit, schema))
    whole = many.where(F.col("n__") <= LARGE).repartition(_tasks(df), key).groupBy(key).applyInPandas(fit, schema)
    large = many.where(F.col("n__") > LARGE)
    fitted = large.join(_best_sizes(large, key, node), key).repartition(_tasks(df), key).groupBy(key).applyInPandas(fit, schema)
    return few.unionByName(whole).unionByName(fitted)


def regroup(labelled: DataFrame, key: str, node: str) -> DataFrame:
    """(key, label, node) rows: a node with several labels is in each, one without is in none."""
    return labelled.select(key, F.explode("labels").alias("label"), node)


def unassigned(labelled: DataFrame, key: str) -> DataFrame:
    return labelled.groupBy(key).agg(F.count_if(F.size("labels") == 0).alias("unassigned"))


def duplicates(df: DataFrame, key: str, node: str, vector: str) -> DataFrame:
    """Every node with its class of equal vectors in the group: `first_same`, the least node of it, and `n_same`, its size."""
    classes = df.groupBy(F.col(key).alias("k__"), F.col(vector).alias("v__")).agg(F.min(node).alias("first_same"), F.count("*").alias("n_same"))
    same = F.col(key).eqNullSafe(F.col("k__")) & F.col(vector).eqNullSafe(F.col("v__"))
    return df.select(key, node, vector).join(classes, same).select(key, node, "first_same", "n_same")
