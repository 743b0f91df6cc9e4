"""A bidirectional LSTM in numpy that labels the steps of sequences, with its training."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def initial(rng: np.random.Generator, buckets: dict[str, tuple[int, int]], dense: int, hidden: int) -> Params:
    """Tables of hashed features by name (buckets, size), both directions' weights, and the output layer."""
    params = {f"{k}_table": rng.normal(0, 0.3, shape) for k, shape in buckets.items()}
    inputs = sum(size for _, size in buckets.values()) + dense
    for side in ("ahead", "back"):
        params[f"{side}_in"] = rng.normal(0, inputs**-0.5, (inputs, 4 * hidden))
        params[f"{side}_own"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
        params[f"{side}_bias"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])  # forget gate first
    params["out"] = rng.normal(0, hidden**-0.5, 2 * hidden)
    params["out_bias"] = np.zeros(1)
    return params


def pooled(table: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of table rows for each run of ids; zeros for an empty run."""
    size = np.diff(bounds)
    out = np.zeros((size.size, table.shape[1]), table.dtype)
    full = size > 0
    if full.any():
        out[full] = np.add.reduceat(table[ids], bounds[:-1][full], axis=0) / size[full, None]
    return out


def reversal(lengths: np.ndarray, steps: int) -> np.ndarray:
    """For each step and sequence the step that mirrors it; steps past the end stay."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def run(x: np.ndarray, w_in: np.ndarray, w_own: np.ndarray, bias: np.ndarray, keep: bool):
    """Hidden states of (steps, sequences, inputs), and what the way back needs."""
    steps, n, _ = x.shape
    size = w_own.shape[0]
    pre = x @ w_in + bias
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    states, trace = np.empty((steps, n, size), x.dtype), []
    for t in range(steps):
        z = pre[t] + h @ w_own
        gates = sigmoid(z[:, : 3 * size])
        f, i, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before = c
        c = f * c + i * g
        squashed = np.tanh(c)
        if keep:
            trace.append((f, i, o, g, before, squashed, h))
        h = o * squashed
        states[t] = h
    return states, trace


def run_back(d_states: np.ndarray, x: np.ndarray, w_in: np.ndarray, w_own: np.ndarray, trace: list):
    steps, n, size = d_states.shape
    d_pre, dh, dc = np.empty((steps, n, 4 * size)), np.zeros((n, size)), np.zeros((n, size))
    d_own = np.zeros_like(w_own)
    for t in range(steps - 1, -1, -1):
        f, i, o, g, before, squashed, h = trace[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - squashed**2)
        d_pre[t] = np.concatenate([dc * before * f * (1 - f), dc * g * i * (1 - i), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1)
        d_own += h.T @ d_pre[t]
        dh, dc = d_pre[t] @ w_own.T, dc * f
    d_in = np.tensordot(x, d_pre, ((0, 1), (0, 1)))
    return d_pre @ w_in.T, d_in, d_own, d_pre.sum((0, 1))


class Batch:
    """Sequences of steps side by side. A step has runs of ids by table name and dense numbers; steps lie one after the other."""

    def __init__(self, lengths: np.ndarray, ids: dict[str, tuple[np.ndarray, np.ndarray]], dense: np.ndarray):
        self.lengths, self.ids, self.dense = lengths, ids, dense
        self.seq = np.repeat(np.arange(lengths.size), lengths)
        self.step = np.arange(self.seq.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.mirror = reversal(lengths, int(lengths.max(initial=0)))


def forward(params: Params, batch: Batch, keep: bool = False):
    """Logit of each step, and what the way back needs."""
    parts = [pooled(params[f"{k}_table"], *runs) for k, runs in batch.ids.items()] + [batch.dense.astype(params["out"].dtype)]
    flat = np.concatenate(parts, 1)
    x = np.zeros((batch.mirror.shape[0], batch.lengths.size, flat.shape[1]), flat.dtype)
    x[batch.step, batch.seq] = flat
    columns = np.arange(batch.lengths.size)
    turned = x[batch.mirror, columns]
    ahead, ahead_trace = run(x, params["ahead_in"], params["ahead_own"], params["ahead_bias"], keep)
    back, back_trace = run(turned, params["back_in"], params["back_own"], params["back_bias"], keep)
    both = np.concatenate([ahead, back[batch.mirror, columns]], 2)[batch.step, batch.seq]
    return both @ params["out"] + params["out_bias"][0], (x, turned, both, ahead_trace, back_trace)


def gradients(params: Params, batch: Batch, labels: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy of the steps and its gradients."""
    logits, (x, turned, both, ahead_trace, back_trace) = forward(params, batch, keep=True)
    loss = float(np.mean(np.logaddexp(0, logits) - labels * logits))
    d_logits = (sigmoid(logits) - labels) / labels.size
    grads: Params = {"out": both.T @ d_logits, "out_bias": np.array([d_logits.sum()])}
    hidden, columns = params["out"].size // 2, np.arange(batch.lengths.size)
    d_states = np.zeros((*x.shape[:2], 2 * hidden))
    d_states[batch.step, batch.seq] = d_logits[:, None] * params["out"]
    d_x = np.zeros_like(x)
    for side, inputs, d_side, trace in (("ahead", x, d_states[..., :hidden], ahead_trace), ("back", turned, d_states[..., hidden:], back_trace)):
        if side == "back":
            d_side = d_side[batch.mirror, columns]
        d_inputs, *own = run_back(d_side, inputs, params[f"{side}_in"], params[f"{side}_own"], trace)
        grads |= dict(zip((f"{side}_in", f"{side}_own", f"{side}_bias"), own))
        d_x += d_inputs[batch.mirror, columns] if side == "back" else d_inputs
    d_flat, at = d_x[batch.step, batch.seq], 0
    for k, (ids, bounds) in batch.ids.items():
        table, size = params[f"{k}_table"], np.diff(bounds)
        width = table.shape[1]
        each = d_flat[:, at : at + width] / np.maximum(size, 1)[:, None]
        grads[f"{k}_table"] = np.zeros_like(table)
        np.add.at(grads[f"{k}_table"], ids, np.repeat(each, size, axis=0))
        at += width
    return loss, grads


def train(params: Params, batches, steps: int, rate: float = 0.015) -> Params:
    """Adam over so many (batch, labels) pairs; the rate falls to a twentieth, gradients are clipped by their norm."""
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for step, (batch, labels) in enumerate(batches, 1):
        _, grads = gradients(params, batch, labels)
        now = rate * (1 - 0.95 * step / steps)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            params[k] = params[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return params
