"""Losses and regularization steps on arrays of a bounded sample or a block, as the DataFrame operators define them."""

from __future__ import annotations

import numpy as np


def loss(name: str, args: tuple, i, j, x, w, h, n1, n2) -> float:
    """A loss such as ``Nzsl_L2`` with its arguments; NaN where it is not finite."""
    with np.errstate(all="ignore"):
        dot = (w[i] * h[j]).sum(axis=1)
        counted = lambda f, n, a, b: (n * (f[:, a:b] ** 2).sum(axis=1)).sum()
        if name.startswith("Nzsl"):
            out = ((x - dot) ** 2).sum()
        elif name == "NzRmse":
            out = np.sqrt(((x - dot) ** 2).mean())
        elif name == "Biased":
            out = ((x - (dot - w[i, 0] * h[j, 0]) - w[i, 0] - h[j, 0]) ** 2).sum()
        elif name == "Sl":
            out = (x * x - 2 * x * dot).sum() + ((w.T @ w) * (h.T @ h)).sum()
        else:
            some = x != 0
            out = (x[some] * np.log(x[some] / np.abs(dot[some]))).sum()
            if name == "Gkl":
                out = max(0.0, out - x[some].sum() + (w.sum(axis=0) * h.sum(axis=0)).sum())
        if name == "Nzsl_L2":
            out += args[0] * ((w**2).sum() + (h**2).sum())
        elif name == "Nzsl_L1":
            out += args[0] * np.abs(w).sum() + args[-1] * np.abs(h).sum()
        elif name == "Nzsl_Nzl2":
            out += args[0] * (counted(w, n1, 0, None) + counted(h, n2, 0, None))
        elif name == "Biased" and args and any(args):
            lw, lh, lr, lc = args * 4 if len(args) == 1 else (args[0], args[0], args[1], args[1]) if len(args) == 2 else args
            out += lw * counted(w, n1, 1, None) + lh * counted(h, n2, 1, None) + lr * counted(w, n1, 0, 1) + lc * counted(h, n2, 0, 1)
    return float(out) if np.isfinite(out) else float("nan")


def safe_nzl2_step(eps: float, lam: float, most: float) -> float:
    """The step, lowered where the largest count of entries would turn signs."""
    a = 2 * lam * most
    return (1 / a) * (1 - 0.25 / (eps * a)) if 1 - eps * a < 0.5 else eps


def regularize(name: str, args: tuple, w, h, eps: float, n1=None, n2=None, most: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """One step on both factors; ``n1``, ``n2`` and ``most`` (counts of entries, and the largest of all) serve ``Nzl2`` alone."""
    if name == "None":
        return w, h
    if name == "L1":
        return tuple(np.where(f >= 0, f - eps * lam, f + eps * lam) for f, lam in ((w, args[0]), (h, args[-1])))
    if name == "L2":
        f = 1 - 2 * eps * args[0]
        f = 0.25 / (1 - f) if f < 0.5 else f
        return w * f, h * f
    if name == "Nzl2":
        eps = safe_nzl2_step(eps, args[0], most)
        return w * (1 - 2 * eps * args[0] * n1)[:, None], h * (1 - 2 * eps * args[0] * n2)[:, None]
    if name == "Sl":
        return w - 2 * eps * w @ (h.T @ h), h - 2 * eps * h @ (w.T @ w)
    if name == "Gkl":
        return w - eps * h.sum(axis=0), h - eps * w.sum(axis=0)
    raise ValueError(f"unknown regularizer {name!r}")
