"""Causal self-attention blocks for a batch of short sequences: forward and backward in numpy."""

from __future__ import annotations

from math import erf, pi, sqrt

import numpy as np

from kindred.operators.training import linear

MASKED = -10_000.0
LN_EPS = 1e-5
Weights = dict[str, np.ndarray]


def block_weights(length: int, dim: int, layers: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {"positions": rng.normal(0.0, 0.02, (length, dim))}
    for n in range(layers):
        for name, a, b in (("q", dim, dim), ("k", dim, dim), ("v", dim, dim), ("o", dim, dim),
                           ("f", dim, 2 * dim), ("e", 2 * dim, dim)):
            w[f"{n}{name}W"], w[f"{n}{name}b"] = linear(rng, a, b)
        for name in ("s", "t"):
            w[f"{n}{name}g"], w[f"{n}{name}b"] = np.ones(dim), np.zeros(dim)
    return w


def dropout_masks(keys: list, layers: int, length: int, dim: int, rate: float) -> np.ndarray | None:
    """One generator per example, so that forward and backward passes agree in any partitioning."""
    if rate <= 0:
        return None
    draws = [np.random.default_rng(k).random((layers, 2, length, dim)) >= rate for k in keys]
    return np.stack(draws, axis=2) / (1.0 - rate)


def _normalize(x: np.ndarray, g: np.ndarray, b: np.ndarray):
    centered = x - x.mean(axis=-1, keepdims=True)
    inv = 1.0 / np.sqrt((centered**2).mean(axis=-1, keepdims=True) + LN_EPS)
    hat = centered * inv
    return hat * g + b, (hat, inv)


def _normalize_back(grad, cache, g):
    hat, inv = cache
    gh = grad * g
    mean, along = gh.mean(axis=-1, keepdims=True), (gh * hat).mean(axis=-1, keepdims=True)
    axes = tuple(range(grad.ndim - 1))
    return inv * (gh - mean - hat * along), (grad * hat).sum(axis=axes), grad.sum(axis=axes)


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.frompyfunc(erf, 1, 1)(x / sqrt(2.0)).astype(np.float64))


def forward(emb: np.ndarray, pad: np.ndarray, w: Weights, layers: int, masks=None):
    """(last-slot output, caches) of embedded sequences (batch, length, dim); pads are True.

    Only the last slot of the last layer is read, so that layer works on it alone.
    """
    length, dim = emb.shape[1:]
    blocked = np.triu(np.ones((length, length), dtype=bool), 1)[None] | pad[:, None, :]
    live = ~pad[:, :, None]
    x, caches = (emb + w["positions"]) * live, []
    for n in range(layers):
        read = slice(-1, None) if n == layers - 1 else slice(None)
        one, two = (1.0, 1.0) if masks is None else (masks[n][0][:, read], masks[n][1][:, read])
        own = x[:, read]
        q = own @ w[f"{n}qW"] + w[f"{n}qb"]
        k, v = (x @ w[f"{n}{c}W"] + w[f"{n}{c}b"] for c in "kv")
        scores = np.where(blocked[:, read], MASKED, q @ k.transpose(0, 2, 1) / sqrt(dim))
        att = np.exp(scores - scores.max(axis=-1, keepdims=True))
        att /= att.sum(axis=-1, keepdims=True)
        mix = att @ v
        y, ln1 = _normalize(own + one * (mix @ w[f"{n}oW"] + w[f"{n}ob"]), w[f"{n}sg"], w[f"{n}sb"])
        f = y @ w[f"{n}fW"] + w[f"{n}fb"]
        cdf = _cdf(f)
        r = y + two * ((f * cdf) @ w[f"{n}eW"] + w[f"{n}eb"])
        z, ln2 = _normalize(r, w[f"{n}tg"], w[f"{n}tb"])
        caches.append((x, q, k, v, att, mix, y, ln1, f, cdf, ln2, one, two))
        x = z * live[:, read]
    return x[:, -1], (caches, live, blocked)


def backward(grad_last: np.ndarray, cache, w: Weights, layers: int):
    """Gradients of the embedded inputs and of all weights, given the last-slot gradient."""
    caches, live, blocked = cache
    grads: Weights = {}

    def dense(n: int, name: str, inputs: np.ndarray, g: np.ndarray) -> np.ndarray:
        flat_in, flat_g = inputs.reshape(-1, inputs.shape[-1]), g.reshape(-1, g.shape[-1])
        grads[f"{n}{name}W"] = flat_in.T @ flat_g
        grads[f"{n}{name}b"] = flat_g.sum(axis=0)
        return g @ w[f"{n}{name}W"].T

    g = grad_last[:, None, :]
    dim = g.shape[-1]
    for n in reversed(range(layers)):
        read = slice(-1, None) if n == layers - 1 else slice(None)
        x, q, k, v, att, mix, y, ln1, f, cdf, ln2, one, two = caches[n]
        g, grads[f"{n}tg"], grads[f"{n}tb"] = _normalize_back(g * live[:, read], ln2, w[f"{n}tg"])
        g_act = dense(n, "e", f * cdf, g * two)
        slope = cdf + f * np.exp(-0.5 * f * f) / sqrt(2 * pi)
        g_y = g + dense(n, "f", y, g_act * slope)
        g, grads[f"{n}sg"], grads[f"{n}sb"] = _normalize_back(g_y, ln1, w[f"{n}sg"])
        g_mix = dense(n, "o", mix, g * one)
        g_att = g_mix @ v.transpose(0, 2, 1)
        g_v = att.transpose(0, 2, 1) @ g_mix
        g_s = att * (g_att - (g_att * att).sum(axis=-1, keepdims=True))
        g_s = np.where(blocked[:, read], 0.0, g_s) / sqrt(dim)
        g_q, g_k = g_s @ k, g_s.transpose(0, 2, 1) @ q
        own = g + dense(n, "q", x[:, read], g_q)
        g = dense(n, "k", x, g_k) + dense(n, "v", x, g_v)
        g[:, read] += own
    g = g * live
    grads["positions"] = g.sum(axis=0)
    return g, grads
