"""A small bidirectional LSTM with a CRF on top, in numpy: training by back-propagation, and scoring of windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass(frozen=True)
class Shape:
    """Numbers of input symbols, embedding and hidden units per direction, and tags."""

    symbols: int
    embedding: int
    hidden: int
    tags: int


def start(shape: Shape, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(*size: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(size[0]), size)

    weights = {"symbols": rng.normal(0, 0.5, (shape.symbols, shape.embedding))}
    for side in "fb":
        weights[f"in_{side}"] = draw(shape.embedding, 4 * shape.hidden)
        weights[f"back_{side}"] = draw(shape.hidden, 4 * shape.hidden)
        bias = np.zeros(4 * shape.hidden)
        bias[shape.hidden : 2 * shape.hidden] = 1  # remember at first
        weights[f"bias_{side}"] = bias
    weights["out"] = draw(2 * shape.hidden, shape.tags)
    weights["out_bias"] = np.zeros(shape.tags)
    weights["transitions"] = np.zeros((shape.tags, shape.tags))
    return {k: v.astype(np.float32) for k, v in weights.items()}


def run_side(weights: dict[str, np.ndarray], side: str, x: np.ndarray, keep: bool = False):
    """Hidden states of one direction over ``x`` (time, window, embedding), and the gates if they are kept."""
    back = weights[f"back_{side}"]
    size = back.shape[0]
    fed = x @ weights[f"in_{side}"] + weights[f"bias_{side}"]
    h = np.zeros((x.shape[1], size), x.dtype)
    c = np.zeros_like(h)
    states, gates = np.empty((*x.shape[:2], size), x.dtype), []
    times = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    for t in times:
        z = fed[t] + h @ back
        ifo = sigmoid(z[:, : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        i, f, o = ifo[:, :size], ifo[:, size : 2 * size], ifo[:, 2 * size :]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep:
            gates.append((t, i, f, o, g, before, tc, h))
        h = o * tc
        states[t] = h
    return states, gates


def emissions(weights: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """Tag scores (window, time, tag) of ``symbols`` (window, time)."""
    x = weights["symbols"][symbols.T]
    both = np.concatenate([run_side(weights, side, x)[0] for side in "fb"], axis=2)
    return (both @ weights["out"] + weights["out_bias"]).transpose(1, 0, 2)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_loss(scores: np.ndarray, transitions: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood of ``tags`` (time, window), and gradients of ``scores`` and ``transitions``."""
    steps, n, k = scores.shape
    rows = np.arange(n)
    alpha, beta = np.empty_like(scores), np.empty_like(scores)
    alpha[0], beta[-1] = scores[0], 0
    for t in range(1, steps):
        alpha[t] = log_sum(alpha[t - 1][:, :, None] + transitions, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = log_sum(transitions + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = log_sum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - total[None, :, None])
    d_moves = np.zeros((k, k), scores.dtype)
    gold = scores[0][rows, tags[0]].copy()
    d_scores[0, rows, tags[0]] -= 1
    for t in range(1, steps):
        joint = alpha[t - 1][:, :, None] + transitions + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
        d_moves += np.exp(joint).sum(axis=0)
        np.subtract.at(d_moves, (tags[t - 1], tags[t]), 1)
        gold += transitions[tags[t - 1], tags[t]] + scores[t][rows, tags[t]]
        d_scores[t, rows, tags[t]] -= 1
    return (total - gold).mean(), d_scores / n, d_moves / n


def gradients(weights: dict[str, np.ndarray], symbols: np.ndarray, tags: np.ndarray):
    """Loss and gradients for windows of ``symbols`` and ``tags`` (window, time)."""
    x = weights["symbols"][symbols.T]
    runs = {side: run_side(weights, side, x, keep=True) for side in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    scores = both @ weights["out"] + weights["out_bias"]
    loss, d_scores, d_moves = crf_loss(scores, weights["transitions"], tags.T)
    size = both.shape[2] // 2
    flat = lambda a: a.reshape(-1, a.shape[-1])
    grads = {
        "transitions": d_moves,
        "out": flat(both).T @ flat(d_scores),
        "out_bias": d_scores.sum(axis=(0, 1)),
    }
    d_both = d_scores @ weights["out"].T
    d_x = np.zeros_like(x)
    for side in "fb":
        d_states = d_both[:, :, :size] if side == "f" else d_both[:, :, size:]
        back = weights[f"back_{side}"]
        d_z = np.empty((*x.shape[:2], 4 * size), x.dtype)
        d_back = np.zeros_like(back)
        d_h = np.zeros((x.shape[1], size), x.dtype)
        d_c = np.zeros_like(d_h)
        for t, i, f, o, g, before, tc, h in reversed(runs[side][1]):
            d_h = d_h + d_states[t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            z = d_z[t]
            z[:, :size] = d_c * g * i * (1 - i)
            z[:, size : 2 * size] = d_c * before * f * (1 - f)
            z[:, 2 * size : 3 * size] = d_h * tc * o * (1 - o)
            z[:, 3 * size :] = d_c * i * (1 - g * g)
            d_back += h.T @ z
            d_h = z @ back.T
            d_c = d_c * f
        grads[f"back_{side}"] = d_back
        grads[f"in_{side}"] = flat(x).T @ flat(d_z)
        grads[f"bias_{side}"] = d_z.sum(axis=(0, 1))
        d_x += d_z @ weights[f"in_{side}"].T
    d_symbols = np.zeros_like(weights["symbols"])
    np.add.at(d_symbols, symbols.T.ravel(), flat(d_x))
    grads["symbols"] = d_symbols
    return loss, grads


def train(
    shape: Shape, symbols: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int
) -> dict[str, np.ndarray]:
    """Weights after ``steps`` of Adam on random batches; the same inputs give the same weights."""
    weights = start(shape, seed)
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(symbols), batch)
        _, grads = gradients(weights, symbols[rows], tags[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = (g * np.float32(scale)).astype(np.float32)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            even = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            weights[k] = (weights[k] - now * even).astype(np.float32)
    return weights


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best tags for ``scores`` (time, tag)."""
    back = np.empty(scores.shape, np.int64)
    best = scores[0]
    columns = np.arange(scores.shape[1])
    for t in range(1, len(scores)):
        moved = best[:, None] + transitions
        back[t] = moved.argmax(axis=0)
        best = moved[back[t], columns] + scores[t]
    tags = np.empty(len(scores), np.int64)
    tags[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags
