"""Estimators on a matrix of returns (dates by assets), used inside one window's kernel."""

from __future__ import annotations

import numpy as np


def covariance(r: np.ndarray) -> np.ndarray:
    """Sample covariance of the rows that each pair has in common."""
    ok = np.isfinite(r)
    if ok.all():
        return np.atleast_2d(np.cov(r, rowvar=False))
    k = r.shape[1]
    out = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(i, k):
            both = ok[:, i] & ok[:, j]
            if both.sum() > 1:
                out[i, j] = out[j, i] = np.cov(r[both, i], r[both, j])[0, 1]
    return out


def empirical(r: np.ndarray) -> np.ndarray:
    return np.atleast_2d(np.cov(r, rowvar=False, bias=True))


def semi_covariance(r: np.ndarray, thresh: float = 0.0) -> np.ndarray:
    """Of returns below a threshold, over the number of all entries."""
    d = np.minimum(r, thresh)
    return d.T @ d / d.size


def shrunk(r: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    s = empirical(r)
    return (1 - shrinkage) * s + shrinkage * np.trace(s) / len(s) * np.eye(len(s))


def ledoit_wolf(r: np.ndarray) -> np.ndarray:
    """Shrunk towards the scaled identity by the intensity that minimises the expected loss."""
    x = r - r.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, ((x**2).T @ (x**2) / n - s**2).sum() / n / p)
    k = b2 / d2 if d2 > 0 else 0.0
    return (1 - k) * s + k * mu * np.eye(p)


def oas(r: np.ndarray) -> np.ndarray:
    """Oracle approximating shrinkage."""
    s = empirical(r)
    n, p = r.shape
    mu, a = np.trace(s) / p, (s**2).mean()
    den = (n + 1) * (a - mu**2 / p)
    k = 1.0 if den == 0 else min(1.0, (a + mu**2) / den)
    return (1 - k) * s + k * mu * np.eye(p)


def exponential(r: np.ndarray, span: float = 60) -> np.ndarray:
    q = 1 - 2 / (span + 1)
    w = q ** np.arange(len(r) - 1, -1, -1)
    w /= w.sum()
    x = r - w @ r
    return (x * w[:, None]).T @ x / (1 - (w**2).sum())


def graphical_lasso(r: np.ndarray, alpha: float = 0.01, rounds: int = 100) -> np.ndarray:
    """Covariance whose inverse is sparse: block coordinate descent on the columns. Entries off the diagonal are penalised, variances stay the sample's."""
    s = empirical(r)
    w, p = 0.95 * s, len(s)
    np.fill_diagonal(w, np.diag(s))
    b = np.zeros((p, p))
    for _ in range(rounds):
        old = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            v, t, beta = w[np.ix_(rest, rest)], s[rest, j], b[rest, j]
            for _ in range(100):
                last = beta.copy()
                for i in range(p - 1):
                    g = t[i] - v[i] @ beta + v[i, i] * beta[i]
                    beta[i] = np.sign(g) * max(abs(g) - alpha, 0) / v[i, i]
                if np.abs(beta - last).max(initial=0) < 1e-9:
                    break
            b[rest, j] = beta
            w[rest, j] = w[j, rest] = v @ beta
        if np.abs(w - old).max() < 1e-9:
            break
    return w


def to_corr(c: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(c))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(c / np.outer(d, d), -1, 1)


def graphical_lasso_cv(r: np.ndarray, folds: int = 5, points: int = 8) -> np.ndarray:
    """With the penalty, of a geometric grid below the largest covariance, that makes stretches of rows left out likeliest."""
    s = empirical(r)
    top = np.abs(s - np.diag(np.diag(s))).max(initial=0)
    parts = [p for p in np.array_split(np.arange(len(r)), folds) if len(p)]
    if not top or len(parts) < 2:
        return graphical_lasso(r, 0.0)

    def likelihood(alpha: float) -> float:
        total = 0.0
        for p in parts:
            inv = np.linalg.pinv(graphical_lasso(np.delete(r, p, 0), alpha))
            sign, log = np.linalg.slogdet(inv)
            x = r[p] - np.delete(r, p, 0).mean(0)
            total += len(p) * ((log if sign > 0 else -np.inf) - np.trace(x.T @ x / len(p) @ inv))
        return total

    return graphical_lasso(r, max(np.geomspace(top, top * 0.01, points), key=likelihood))


def to_cov(c: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return c * np.outer(sd, sd)


def eigen(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest first."""
    v, e = np.linalg.eigh(c)
    return v[::-1], e[:, ::-1]


def marcenko_pastur(var: float, q: float, points: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalue density of noise with q observations per asset."""
    lo, hi = var * (1 - q**-0.5) ** 2, var * (1 + q**-0.5) ** 2
    x = np.linspace(lo, hi, points)
    return x, q / (2 * np.pi * var * x) * np.sqrt(np.maximum((hi - x) * (x - lo), 0))


def kde(values: np.ndarray, at: np.ndarray, width: float = 0.01) -> np.ndarray:
    z = (at[:, None] - values[None, :]) / width
    return np.exp(-0.5 * z**2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))


def noise_edge(values: np.ndarray, q: float, width: float = 0.01) -> float:
    """The largest eigenvalue that noise explains: the noise variance whose density is nearest to that of the eigenvalues."""
    best = min(np.linspace(0.02, 0.99, 98), key=lambda var: ((marcenko_pastur(var, q)[1] - kde(values, marcenko_pastur(var, q)[0], width)) ** 2).sum())
    return best * (1 + q**-0.5) ** 2


def denoise(c: np.ndarray, q: float, method: str = "constant", alpha: float = 0.0) -> np.ndarray:
    """Noise eigenvalues averaged, or their block shrunk towards its diagonal."""
    v, e = eigen(c)
    k = int((v > noise_edge(v, q)).sum())
    if method == "constant":
        w = v.copy()
        if k < len(v):
            w[k:] = v[k:].mean()
        return to_corr(e @ np.diag(w) @ e.T)
    signal, noise = e[:, :k] @ np.diag(v[:k]) @ e[:, :k].T, e[:, k:] @ np.diag(v[k:]) @ e[:, k:].T
    return signal + alpha * noise + (1 - alpha) * np.diag(np.diag(noise))


def detone(c: np.ndarray, k: int = 1) -> np.ndarray:
    """Without its first components."""
    v, e = eigen(c)
    return to_corr(c - e[:, :k] @ np.diag(v[:k]) @ e[:, :k].T)


def denoised_covariance(r: np.ndarray, detoned: bool = False) -> np.ndarray:
    s = covariance(r)
    c = denoise(to_corr(s), len(r) / r.shape[1])
    return to_cov(detone(c) if detoned else c, np.sqrt(np.diag(s)))


def minimum_covariance_determinant(r: np.ndarray, share: float = 0.75, starts: int = 20, seed: int = 0) -> np.ndarray:
    """Of the share of rows with the least determinant found from random starts by concentration steps."""
    rng, n = np.random.default_rng(seed), len(r)
    h = max(int(share * n), r.shape[1] + 1)
    best, low = covariance(r), np.inf
    for _ in range(starts):
        at = rng.choice(n, min(n, r.shape[1] + 1), replace=False)
        for _ in range(20):
            m, s = r[at].mean(0), np.atleast_2d(np.cov(r[at], rowvar=False, bias=True))
            x = r - m
            new = np.argsort(np.einsum("ij,jk,ik->i", x, np.linalg.pinv(s), x), kind="stable")[:h]
            if set(new) == set(at):
                break
            at = new
        s = np.atleast_2d(np.cov(r[at], rowvar=False, bias=True))
        det = np.linalg.slogdet(s)[1]
        if det < low:
            best, low = s, det
    return best


def turbulence(r: np.ndarray, now: np.ndarray) -> dict:
    """Mahalanobis distance over the number of assets; how much of it is magnitude and how much correlation."""
    s, x = covariance(r), now - r.mean(0)
    full = float(x @ np.linalg.pinv(s) @ x) / len(x)
    size = float((x**2 / np.diag(s)).sum()) / len(x)
    return {"turbulence": full, "magnitude": size, "correlation": full / size if size else np.nan}


ESTIMATORS = {
    "covariance": covariance, "empirical_covariance": empirical, "semi_covariance": semi_covariance, "shrunk_covariance": shrunk, "ledoit_wolf": ledoit_wolf, "oas": oas,
    "exponential_covariance": exponential, "graphical_lasso": graphical_lasso, "graphical_lasso_cv": graphical_lasso_cv, "denoised_covariance": denoised_covariance, "minimum_covariance_determinant": minimum_covariance_determinant,
}
