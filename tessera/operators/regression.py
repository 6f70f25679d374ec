"""Linear models: sums of products by Spark, small dense algebra on the driver or in one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Gram:
    """Sums of products of (1, predictors, response): all that a least-squares fit needs."""

    def __init__(self, names: list[str], products: np.ndarray):
        self.names, self.products = ["1", *names], products

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names[1:], self.products - other.products)

    @property
    def xx(self) -> np.ndarray:
        return self.products[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.products[:-1, -1]

    def solve(self, penalty: float = 0.0, jitter: float = 0.0) -> np.ndarray:
        """Coefficients, intercept first and never penalised; jitter is a share of the mean diagonal."""
        a = self.xx.copy()
        a[np.diag_indices_from(a)] += jitter * np.trace(a) / len(a)
        a[range(1, len(a)), range(1, len(a))] += penalty
        return np.linalg.solve(a, self.xy)

    def squared_error(self, b: np.ndarray) -> float:
        return float(self.products[-1, -1] - 2 * b @ self.xy + b @ self.xx @ b)

    def explained(self) -> float:
        """R2 of the fit: the share of the response's variation about its mean that it takes away."""
        n, y = self.products[0, 0], self.products[0, -1]
        return float(1 - self.squared_error(self.solve()) / (self.products[-1, -1] - y * y / n))

    def fit_report(self) -> dict[str, tuple[float, float]]:
        """Coefficient and t value of each predictor and of the intercept."""
        b, n = self.solve(), self.products[0, 0]
        inverse, noise = np.linalg.inv(self.xx), self.squared_error(self.solve()) / (n - len(self.xx))
        return {name: (float(b[i]), float(b[i] / np.sqrt(noise * inverse[i, i]))) for i, name in enumerate(self.names)}


def grams(df: DataFrame, predictors: list[str], response: str, by: Column | None = None) -> dict:
    """Gram of each value of `by`, in one pass; rows with a null among the columns are left out."""
    names = [*predictors, response]
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = df.na.drop(subset=names).groupBy((by if by is not None else F.lit(0)).alias("__by")).agg(*[F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for row in rows:
        products = np.zeros((k, k))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        out[row["__by"]] = Gram(predictors, products)
    return out


def predicted(coefficients: np.ndarray, predictors: list[str]) -> Column:
    """The fitted line as a column."""
    out = F.lit(float(coefficients[0]))
    for b, name in zip(coefficients[1:], predictors, strict=True):
        out = out + float(b) * F.col(name)
    return out


def cross_validated_penalty(folds: dict, penalties: list[float]) -> tuple[float, list[float]]:
    """The first of the penalties with least summed squared error over folds, each fitted on the others."""
    whole = None
    for g in folds.values():
        whole = g.products if whole is None else whole + g.products
    names = next(iter(folds.values())).names[1:]
    errors = [sum(g.squared_error((Gram(names, whole) - g).solve(p)) for g in folds.values()) for p in penalties]
    return penalties[int(np.argmin(errors))], errors


def marginal_scan(genotype: DataFrame, response: DataFrame, covariate: str, y: str) -> DataFrame:
    """By variant: slope, standard error and z of the dosage beside one covariate and an intercept.

    One aggregation; the covariate is taken out of dosage and response by its moments.
    """
    joined = genotype.where("dosage is not null").join(response, "sample")
    g, c, t = F.col("dosage").cast("double"), F.col(covariate), F.col(y)
    sums = joined.groupBy("variant").agg(F.count("*").alias("n"), F.sum(g).alias("g"), F.sum(c).alias("c"), F.sum(t).alias("t"), F.sum(g * g).alias("gg"), F.sum(c * c).alias("cc"), F.sum(t * t).alias("tt"), F.sum(g * c).alias("gc"), F.sum(g * t).alias("gt"), F.sum(c * t).alias("ct"))
    central = lambda a, b: F.col("".join(sorted(a + b, key="gct".index))) - F.col(a) * F.col(b) / F.col("n")
    cc = F.nullif(central("c", "c"), F.lit(0.0))
    gg = central("g", "g") - central("g", "c") ** 2 / cc
    gt = central("g", "t") - central("g", "c") * central("c", "t") / cc
    tt = central("t", "t") - central("c", "t") ** 2 / cc
    rows = sums.select("variant", "n", gg.alias("gg"), gt.alias("gt"), tt.alias("tt")).where("gg > 1e-9 and n > 3")
    beta = F.col("gt") / F.col("gg")
    se = F.sqrt((F.col("tt") - F.col("gt") * F.col("gt") / F.col("gg")) / (F.col("n") - 3) / F.col("gg"))
    return rows.select("variant", "n", beta.alias("beta"), se.alias("se"), (beta / se).alias("z"))


def threshold_scores(genotype: DataFrame, effects: DataFrame, thresholds: list[float], level: str = "p") -> DataFrame:
    """By sample: score_<k>, the sum of dosage times beta over variants under the k-th threshold."""
    joined = genotype.where("dosage is not null").join(effects.select("variant", "beta", level), "variant")
    return joined.groupBy("sample").agg(*[F.sum(F.when(F.col(level) < t, F.col("dosage") * F.col("beta")).otherwise(0.0)).alias(f"score_{k}") for k, t in enumerate(thresholds)])


def kernel_ridge(train: np.ndarray, y: np.ndarray, valid: np.ndarray, y_valid: np.ndarray, penalties: list[float]) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """Dual ridge on columns standardised by the training rows (those with sd under 1e-8 dropped).

    The penalty has least validation error, the larger of equals; returns it with weights, intercept, means and scales.
    """
    mean, sd = train.mean(0), train.std(0)
    used = sd >= 1e-8
    scale = np.where(used, sd, np.inf)
    x, center = (train - mean) / scale, y.mean()
    values, vectors = np.linalg.eigh(x @ x.T)
    turned = vectors.T @ (y - center)
    best = None
    for penalty in sorted(penalties):
        w = x.T @ (vectors @ (turned / (values + penalty)))
        error = float((((valid - mean) / scale) @ w + center - y_valid).__pow__(2).mean())
        if best is None or error <= best[0] + 1e-12:  # the larger of penalties that differ by no more
            best = (error, penalty, w)
    return best[1], best[2], float(center), mean, scale


def ridge_from_sums(train: np.ndarray, valid: np.ndarray, penalties: list[float]) -> tuple[float, np.ndarray, float]:
    """kernel_ridge from sums of products of (1, columns, y): the penalty, and weights and intercept for columns as they are."""
    n = train[0, 0]
    mean = train[0, 1:] / n
    cov = train[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    inverse = np.where(sd >= 1e-8, 1 / np.where(sd >= 1e-8, sd, 1.0), 0.0)
    values, vectors = np.linalg.eigh(n * cov[:-1, :-1] * np.outer(inverse, inverse))
    turned = vectors.T @ (n * cov[:-1, -1] * inverse)
    best = None
    for penalty in sorted(penalties):
        w = inverse * (vectors @ (turned / (np.maximum(values, 0) + penalty)))
        residual = np.concatenate([[mean[-1] - mean[:-1] @ w], w, [-1.0]])
        error = float(residual @ valid @ residual / valid[0, 0])
        if best is None or error <= best[0] + 1e-12:  # the larger of penalties that differ by no more
            best = (error, penalty, residual)
    return best[1], best[2], float(mean[-1])


def grouped_ridge(df: DataFrame, group: str, features: str, y: str, role: str, penalties: list[float]) -> DataFrame:
    """By group: the chosen penalty, and R2 on evaluation rows from the training mean; roles are train, validation, evaluation.

    The dual's solution from sums of products, added up by group and role where the rows are, about the table's first row:
    a group's own task sees columns x columns numbers, not its rows. Penalties are above 0.
    """
    kinds, roles = dict(df.dtypes), ("train", "validation", "evaluation")
    rows = df.select(group, role, F.col(features).alias("__x"), F.col(y).cast("double").alias("__y"))
    first = rows.where(F.col(role).isin(*roles)).first()
    base = np.array([*first["__x"], first["__y"]], float) if first is not None else np.zeros(1)

    def partial(frames):
        for frame in frames:
            for own, part in frame.groupby([group, role], dropna=False, sort=False):
                if own[1] not in roles:  # the group is named all the same
                    yield pd.DataFrame({group: part[group][:1], role: [own[1]], "q": [[0.0]]})
                    continue
                z = np.column_stack([np.ones(len(part)), np.vstack(part["__x"].to_list()).astype(float) - base[:-1], part["__y"].to_numpy(float) - base[-1]])
                yield pd.DataFrame({group: part[group][:1], role: [own[1]], "q": [(z.T @ z).ravel().tolist()]})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        d = len(base) + 1
        sums = {r: own.sort_values("i")["v"].to_numpy().reshape(d, d) for r, own in frame.groupby(role) if r in roles}
        if any(r not in sums or sums[r][0, 0] < 2 for r in roles):
            return pd.DataFrame({group: frame[group][:1], "penalty": [np.nan], "r2": [np.nan]})
        penalty, residual, center = ridge_from_sums(sums["train"], sums["validation"], penalties)
        last = sums["evaluation"]
        error = residual @ last @ residual
        spread = last[-1, -1] - 2 * center * last[0, -1] + center**2 * last[0, 0]
        return pd.DataFrame({group: frame[group][:1], "penalty": [penalty], "r2": [1 - error / spread if spread > 0 else np.nan]})

    parts = rows.mapInPandas(partial, f"{group} {kinds[group]}, {role} {kinds[role]}, q array<double>")
    sums = parts.select(group, role, F.posexplode("q").alias("i", "v")).groupBy(group, role, "i").agg(F.sum("v").alias("v"))
    return sums.groupBy(group).applyInPandas(fit, f"{group} {kinds[group]}, penalty double, r2 double")


def principal_axes(df: DataFrame, vector: str, k: int, sums: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k leading axes (largest loading positive) and all variances of an array column, from its moments."""
    n, mean, cov = moments(df, vector)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :k]
    sign = np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    return mean, axes * np.where(sign == 0, 1, sign), values[::-1]


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and population covariance of an array column; partial sums by task, one small row each."""

    def partial(frames):
        for frame in frames:
            x = np.vstack(frame[vector].to_list()).astype(float) if len(frame) else np.zeros((0, 0))
            if len(x):
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    width = F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "q")).alias("i", "v")
    rows = df.select(vector).where(F.col(vector).isNotNull()).mapInPandas(partial, "n bigint, s array<double>, q array<double>")
    flat = rows.select(width).groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    total, flat = int(flat[0]) if len(flat) else 0, flat[1:]
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:d] / max(total, 1)
    return total, mean, flat[d:].reshape(d, d) / max(total, 1) - np.outer(mean, mean)


def projected(vector: str, mean: np.ndarray, axes: np.ndarray) -> list[Column]:
    """Scores on each axis, as columns."""
    centered = F.transform(F.col(vector).cast("array<double>"), lambda x, i: x - F.element_at(F.array(*map(F.lit, mean.tolist())), i + 1))
    return [F.aggregate(F.zip_with(centered, F.array(*map(F.lit, a.tolist())), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for a in axes.T]


def canonical_correlations(df: DataFrame, left: str, right: str, top: int) -> np.ndarray:
    """Correlations of two array columns after whitening each."""
    joined = df.select(F.concat(left, right).alias("both"), F.size(left).alias("d"))
    d = joined.first()["d"]
    _, _, cov = moments(joined, "both")
    whiten = lambda c: (lambda w, v: v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ v.T)(*np.linalg.eigh(c))
    return np.clip(np.linalg.svd(whiten(cov[:d, :d]) @ cov[:d, d:] @ whiten(cov[d:, d:]), compute_uv=False)[:top], 0, 1)


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles in degrees between the column spaces of two matrices, smallest first."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.degrees(np.arccos(np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), -1, 1)))


def subspace_features(df: DataFrame, groups: list[str], vector: str, rank: int) -> DataFrame:
    """By group of rows: upper triangle of the projector on its leading axes, and its normalised log spectrum."""

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(frame[vector].to_list()).astype(float)
        values, axes = np.linalg.eigh(np.cov(x, rowvar=False, bias=True) if len(x) > 1 else np.zeros((x.shape[1],) * 2))
        axes, spectrum = axes[:, ::-1][:, :rank], np.log1p(np.maximum(values[::-1][:rank], 0))
        projector = axes @ axes.T
        spectrum = spectrum / max(spectrum.sum(), 1e-12)
        return frame[groups][:1].assign(projector=[projector[np.triu_indices(len(projector))].tolist()], spectrum=[spectrum.tolist()])

    kinds = dict(df.dtypes)
    return df.groupBy(*groups).applyInPandas(made, ", ".join(f"{g} {kinds[g]}" for g in groups) + ", projector array<double>, spectrum array<double>")


def squared_distances(a: np.ndarray, b: np.ndarray, exact: bool = False) -> np.ndarray:
    """Squared distances of all rows of a and b, from their products; if exact, near ones from differences, so that equal rows have none."""
    squares, others = (a * a).sum(1), (b * b).sum(1)
    far = a @ b.T
    far *= -2
    far += squares[:, None]
    far += others
    np.maximum(far, 0, out=far)
    if exact and far.size:
        near = np.flatnonzero(far.ravel() <= 1e-10 * (squares.max() + others.max()))
        for at in range(0, len(near), 50_000):
            i, j = np.divmod(near[at : at + 50_000], len(b))
            far[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return far


def kernel_axes(x: np.ndarray, train: np.ndarray, k: int) -> np.ndarray:
    """Scores of all rows on the k leading axes of a Gaussian kernel over the training rows.

    The width is the median of the positive squared distances; axes with an eigenvalue of 1e-10 or less score zero.
    Memory is rows x training rows; kernels.kernel_scores takes larger tables.
    """
    own = squared_distances(train, train, True)
    pairs = own[np.triu_indices(len(own), 1)]
    gamma = 1 / np.median(pairs[pairs > 0]) if (pairs > 0).any() else 1.0
    kernel, cross = np.exp(-gamma * own), np.exp(-gamma * squared_distances(x, train))
    row, mean = kernel.mean(0), kernel.mean()
    centered = kernel - row - row[:, None] + mean
    values, vectors = np.linalg.eigh((centered + centered.T) / 2)
    top = np.argsort(values)[::-1][:k]
    some = values[top] > 1e-10
    axes = np.where(some, vectors[:, top] / np.sqrt(np.where(some, values[top], 1.0)), 0.0)
    return (cross - cross.mean(1, keepdims=True) - row + mean) @ axes


def grams_by_group(df: DataFrame, group: str, vector: str, most: int = 1000) -> dict:
    """Sums of products of an array column by group, from partial sums by task; a refusal beyond `most` groups."""

    def partial(frames):
        for frame in frames:
            for name, own in frame.groupby(group):
                x = np.vstack(own[vector].to_list()).astype(float)
                yield pd.DataFrame({group: [name], "q": [(x.T @ x).ravel().tolist()]})

    kinds = dict(df.dtypes)
    parts = df.select(group, vector).mapInPandas(partial, f"{group} {kinds[group]}, q array<double>")
    sums = parts.select(group, F.posexplode("q").alias("i", "v")).groupBy(group, "i").agg(F.sum("v").alias("v"))
    rows = sums.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("q")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    return {r[group]: np.array(r["q"]).reshape(int(len(r["q"]) ** 0.5), -1) for r in rows}


class ResidualRidge:
    """Ridge on features from which covariates (an intercept first) have been taken out, standardised by the training rows.

    All of it comes from the training rows' sums of products of (covariates, features, response).
    """

    def __init__(self, products: np.ndarray, covariates: int, penalties: list[float]):
        a, n = slice(0, covariates), products[0, 0]
        x = slice(covariates, len(products) - 1)
        inverse = np.linalg.pinv(products[a, a])
        self.out_x, self.out_y = inverse @ products[a, x], inverse @ products[a, -1]
        spread = products[x, x] - products[x, a] @ self.out_x
        sd = np.sqrt(np.maximum(np.diag(spread), 0) / n)
        self.kept, self.covariates = sd >= 1e-8, covariates
        self.sd = sd[self.kept]
        values, self.axes = np.linalg.eigh(spread[np.ix_(self.kept, self.kept)] / np.outer(self.sd, self.sd))
        values = np.maximum(values, 0)
        turned = self.axes.T @ ((products[x, -1] - products[x, a] @ self.out_y)[self.kept] / self.sd)
        self.mean = products[0, -1] / n
        self.penalties = penalties
        self.shrink = [1 / np.maximum(values + p, 1e-300) for p in penalties]
        self.weights = [turned * s for s in self.shrink]

    def turned(self, rows: np.ndarray) -> np.ndarray:
        """Standardised residual features of rows (covariates, features, response) on the axes."""
        a, x = rows[:, : self.covariates], rows[:, self.covariates : -1]
        return ((x - a @ self.out_x)[:, self.kept] / self.sd) @ self.axes

    def left_out_errors(self, rows: np.ndarray) -> np.ndarray:
        """Summed squared leave-one-out errors of training rows, for each penalty."""
        z, residual = self.turned(rows), rows[:, -1] - rows[:, : self.covariates] @ self.out_y
        errors = [(residual - z @ w) / np.maximum(1 - (z * z) @ s, 1e-8) for w, s in zip(self.weights, self.shrink, strict=True)]
        return np.array([float((e * e).sum()) for e in errors])

    def errors(self, rows: np.ndarray, best: int) -> tuple[float, float, float]:
        """Summed squared errors of the covariates alone, with the features too, and about the training mean."""
        y, base = rows[:, -1], rows[:, : self.covariates] @ self.out_y
        full = base + self.turned(rows) @ self.weights[best]
        return tuple(float(((y - p) ** 2).sum()) for p in (base, full, self.mean))


def least_penalty(errors: list[float], penalties: list[float], near: float = 1e-12) -> int:
    """The place of the least error; of errors that differ by `near` or less the larger penalty."""
    best = 0
    for i in range(1, len(errors)):
        if errors[i] < errors[best] - near or (abs(errors[i] - errors[best]) <= near and penalties[i] > penalties[best]):
            best = i
    return best


def leave_one_out_ridge(df: DataFrame, group: str, rows: str, covariates: int, role: str, penalties: list[float]) -> DataFrame:
    """By group: the penalty of least leave-one-out error on train rows, that error, and R2 on test rows without and with the features.

    rows: an array of covariates (1 first), features and response. Three passes; only sums of products meet.
    """
    train = df.where(F.col(role) == "train")
    fits = {g: ResidualRidge(q, covariates, penalties) for g, q in grams_by_group(train, group, rows).items()}
    shared = df.sparkSession.sparkContext.broadcast(fits)
    kind = dict(df.dtypes)[group]

    def summed(run):
        def each(frames):
            for frame in frames:
                for name, own in frame.groupby(group):
                    if name in shared.value:
                        x = np.vstack(own[rows].to_list()).astype(float)
                        yield pd.DataFrame([[name, i, float(v), len(x)] for i, v in enumerate(run(name, x))], columns=[group, "i", "v", "n"])

        return each

    def totals(part: DataFrame, run) -> dict:
        sums = part.select(group, rows).mapInPandas(summed(run), f"{group} {kind}, i int, v double, n bigint").groupBy(group, "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        return {(r[group], r["i"]): (r["v"], r["n"]) for r in sums.collect()}

    left_out = totals(train, lambda g, x: shared.value[g].left_out_errors(x))
    mean_errors = {g: [left_out[g, i][0] / left_out[g, i][1] for i in range(len(penalties))] for g in fits}
    best = {g: least_penalty(e, penalties) for g, e in mean_errors.items()}
    tested = totals(df.where(F.col(role) == "test"), lambda g, x: shared.value[g].errors(x, best[g]))
    r2 = lambda g, i: 1 - tested[g, i][0] / tested[g, 2][0] if (g, 2) in tested and tested[g, 2][0] > 0 else None
    found = [(g, float(penalties[best[g]]), mean_errors[g][best[g]], r2(g, 0), r2(g, 1)) for g in sorted(fits)]
    return df.sparkSession.createDataFrame(found, f"{group} {kind}, penalty double, left_out_error double, r2_a double, r2_b double")


def chosen_threshold(scores: DataFrame, thresholds: list[float], covariate: str, y: str) -> list[tuple]:
    """(place, r2_a, r2_b, gain, chosen) of each threshold: R2 on validation rows about the training mean.

    scores: place, split, covariate, score, y. Both fits are on train rows; the largest gain is chosen, the first of equals.
    """
    by = F.concat_ws(":", F.col("place").cast("string"), "split")
    sums = grams(scores.where(F.col("split").isin("train", "validation")), [covariate, "score"], y, by)
    out, best = [], None
    for place in range(len(thresholds)):
        train, valid = (sums.get(f"{place}:{s}") for s in ("train", "validation"))
        if train is None or valid is None:
            continue
        mean = train.products[0, -1] / train.products[0, 0]
        spread = valid.products[-1, -1] - 2 * mean * valid.products[0, -1] + mean * mean * valid.products[0, 0]
        alone = np.append(np.linalg.solve(train.xx[:2, :2], train.xy[:2]), 0.0)
        r2 = [1 - valid.squared_error(b) / spread for b in (alone, np.linalg.lstsq(train.xx, train.xy, rcond=None)[0])]
        out.append((place, float(r2[0]), float(r2[1]), float(r2[1] - r2[0])))
        if best is None or out[-1][3] > out[best][3]:
            best = len(out) - 1
    return [(*o, i == best) for i, o in enumerate(out)]


def block_components(df: DataFrame, key: str, vector: str, is_train: Column, size: int, k: int) -> DataFrame:
    """(key, block, scores, share): each block of `size` neighbouring components on its own k leading axes over the train rows.

    Largest loadings are positive, scores are standardised by the train rows, and share is the axes' part of the block's variance.
    """
    blocks = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / size).cast("int")), lambda b: F.concat(F.array(F.lit(1.0)), F.slice(F.col(vector).cast("array<double>"), b * size + 1, size)))).alias("block", "x")
    rows = df.select(key, is_train.alias("__train"), blocks)
    fitted = {}
    for block, q in grams_by_group(rows.where("__train"), "block", "x").items():
        mean = q[0, 1:] / q[0, 0]
        values, axes = np.linalg.eigh(q[1:, 1:] / q[0, 0] - np.outer(mean, mean))
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1][:, :k]
        sign = np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
        sd = np.sqrt(values[: axes.shape[1]])
        fitted[block] = (mean, axes * np.where(sign == 0, 1, sign) / np.where(sd > 1e-12, sd, np.inf), float(values[:k].sum() / max(values.sum(), 1e-300)))
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def project(frames):
        for frame in frames:
            for block, own in frame.groupby("block"):
                mean, axes, share = shared.value[block]
                scores = (np.vstack(own["x"].to_list())[:, 1:] - mean) @ axes
                yield pd.DataFrame({key: own[key], "block": block, "scores": scores.tolist(), "share": share})

    return rows.select(key, "block", "x").mapInPandas(project, f"{key} {dict(df.dtypes)[key]}, block int, scores array<double>, share double")
