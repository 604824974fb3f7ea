"""A gated recurrent language model in numpy with a class-factored output, trained by truncated backpropagation.

P(token | state) = P(class | state) * P(member | class, state), with CLASSES classes of MEMBERS tokens each. Whole texts lie end to
end in lanes that advance side by side; a text starts from state zero, a window covers WINDOW steps, gradients stop at its start, and
the state is carried on from window to window until the text ends, however long it is.
"""

from __future__ import annotations

import heapq
import random

import numpy as np

CLASSES, MEMBERS = 32, 32
TOKENS = CLASSES * MEMBERS
WINDOW = 24
#: Lanes that train and that are scored side by side, at most. Fewer train where one long text would else run on alone.
LANES, LEAST_LANES, SCORE_LANES = 256, 64, 512
#: Tokens of a window from which steps have their full rate; below, when few long texts are left, the rate falls with the noise of the mean.
FULL = 32 * WINDOW
_GATES = ("r", "z", "c")


def fresh(hidden: int, counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters that give the unigram distribution of counts (one for each token id) whatever the state."""
    rng = np.random.default_rng(seed)
    p = (counts + 0.5).reshape(CLASSES, MEMBERS).astype(np.float64)
    f = lambda *shape: rng.normal(0, 0.08, shape).astype(np.float32)
    out = {f"in_{g}": f(TOKENS + 1, hidden) for g in _GATES} | {f"state_{g}": f(hidden, hidden) for g in _GATES} | {f"bias_{g}": np.zeros(hidden, np.float32) for g in _GATES}
    return out | {
        "class": np.zeros((hidden, CLASSES), np.float32), "class_bias": np.log(p.sum(1) / p.sum()).astype(np.float32),
        "member": np.zeros((CLASSES, hidden, MEMBERS), np.float32), "member_bias": np.log(p / p.sum(1, keepdims=True)).astype(np.float32),
    }


def packed(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in params])


def views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters as parts of one flat array."""
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return views(flat.astype(np.float32), like)


def _sigmoid_of_minus(x: np.ndarray) -> None:
    """1 / (exp(x) + 1) in place; where exp overflows, its inverse is 0, as it should be."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _tanh_of_half(x: np.ndarray) -> None:
    """1 - 2 / (exp(x) + 1) in place."""
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1


def _powers(x: np.ndarray) -> np.ndarray:
    """exp(x) in place, and its row sums; x is cut off far above what training can reach, so that nothing overflows."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


class Lanes:
    """Texts end to end in lanes of about equal length, the longest first, so that the lanes still running are always the first rows."""

    def __init__(self, texts: list[np.ndarray], lanes: int, seed: int | None = None) -> None:
        free = [(0, i) for i in range(max(1, min(lanes, len(texts))))]
        mine: list[list[int]] = [[] for _ in free]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            load, lane = free[0]
            mine[lane].append(i)
            heapq.heapreplace(free, (load + len(texts[i]), lane))
        if seed is not None:
            rng = random.Random(seed)
            for own in mine:
                rng.shuffle(own)
        loads = {lane: load for load, lane in free}
        lanes_in_order = sorted(range(len(mine)), key=lambda lane: -loads[lane])
        order = [i for lane in lanes_in_order for i in mine[lane]]
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.length = np.array([loads[lane] for lane in lanes_in_order], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([texts[i] for i in order]).astype(np.int64) if order else np.zeros(0, np.int64)
        self.text = np.repeat(np.array(order, np.int64), sizes)
        self.first = np.zeros(len(self.flat), bool)
        self.first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        self.fed = np.concatenate([[TOKENS], self.flat[:-1]])[: len(self.flat)]
        self.fed[self.first] = TOKENS

    def window(self, t: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat of the next steps, one step after the other, and where each step begins in them."""
        running = np.searchsorted(-self.length, -np.arange(t, t + steps), side="left")
        running = running[running > 0]
        return np.concatenate([self.start[:n] + (t + s) for s, n in enumerate(running.tolist())]), np.concatenate([[0], np.cumsum(running)])


def _forward(p: dict, h: np.ndarray, fed: np.ndarray, first: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """States of all steps, and what the way back needs: the states before, the gates r and z, the cell c, and r * before."""
    # The parameters carry the signs and factors that sigmoid and tanh need, so that no pass over the tokens is spent on them.
    factor = {"r": -1, "z": -1, "c": 2}
    table, state = ([f * (p[f"{kind}_{g}"] + (p[f"bias_{g}"] if kind == "in" else 0)) for g, f in factor.items()] for kind in ("in", "state"))
    x = np.empty((3, len(fed), h.shape[1]), h.dtype)
    for own, t in zip(x, table, strict=True):
        np.take(t, fed, axis=0, out=own, mode="clip")
    r, z, c = x
    two, third = np.stack(state[:2]), state[2]
    before, states, rh = (np.empty_like(r) for _ in range(3))
    begins = np.add.reduceat(first, cuts[:-1], dtype=np.int64).tolist()
    at = cuts.tolist()
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        now, gates, rt, zt, ct, q = before[a:b], x[:2, a:b], r[a:b], z[a:b], c[a:b], rh[a:b]
        now[...] = h[: b - a]
        if begins[i]:
            now[first[a:b]] = 0
        gates += now @ two
        _sigmoid_of_minus(gates)
        np.multiply(rt, now, out=q)
        ct += q @ third
        _tanh_of_half(ct)
        h = states[a:b]
        np.subtract(ct, now, out=h)
        h *= zt
        h += now
    return states, before, r, z, c, rh


def _output(p: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target, and with grads the gradient of the mean loss by state. Rows are grouped by class once."""
    n = len(targets)
    cls = (targets // MEMBERS).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    cls, member, some = cls[order], (targets % MEMBERS)[order], states[order]
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
    present = np.nonzero(np.diff(cuts))[0].tolist()
    rows = np.arange(n)
    pc = some @ p["class"]
    pc += p["class_bias"]
    total_c = _powers(pc)
    pm = np.empty((n, MEMBERS), some.dtype)
    for c in present:
        own = pm[cuts[c] : cuts[c + 1]]
        np.matmul(some[cuts[c] : cuts[c + 1]], p["member"][c], out=own)
        own += p["member_bias"][c]
    total_m = _powers(pm)
    logp = np.empty(n)
    logp[order] = np.log(np.maximum(pc[rows, cls] / total_c, 1e-30)).astype(np.float64) + np.log(np.maximum(pm[rows, member] / total_m, 1e-30))
    if grads is None:
        return logp, None
    for x, total, hit in ((pc, total_c, cls), (pm, total_m, member)):
        total *= n
        x /= total[:, None]
        x[rows, hit] -= 1 / n
    grads["class"] += some.T @ pc
    ones = np.ones(n, some.dtype)
    grads["class_bias"] += ones @ pc
    sorted_back = pc @ p["class"].T
    for c in present:
        a, b = cuts[c], cuts[c + 1]
        grads["member"][c] += some[a:b].T @ pm[a:b]
        grads["member_bias"][c] += ones[a:b] @ pm[a:b]
        sorted_back[a:b] += pm[a:b] @ p["member"][c].T
    back = np.empty_like(sorted_back)
    back[order] = sorted_back
    return logp, back


def _even(texts: list[np.ndarray], most: int) -> int:
    """As many lanes as the longest text fills one of, within bounds."""
    return min(most, max(LEAST_LANES, sum(map(len, texts)) // max(map(len, texts), default=1)))


def score(p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole text; its state starts at zero and runs on across windows."""
    lanes = Lanes(texts, _even(texts, SCORE_LANES))
    total = np.zeros(len(texts))
    h = np.zeros((len(lanes.length), p["state_r"].shape[0]), p["state_r"].dtype)
    t, longest = 0, int(lanes.length.max(initial=0))
    with np.errstate(over="ignore"):
        while t < longest:
            running = int(np.searchsorted(-lanes.length, -t, side="left"))
            at, cuts = lanes.window(t, max(WINDOW, min(longest - t, 12_000 // running)))
            states = _forward(p, h, lanes.fed[at], lanes.first[at], cuts)[0]
            h = states[cuts[-2] :]
            total += np.bincount(lanes.text[at], weights=_output(p, states, lanes.flat[at], None)[0], minlength=len(texts))
            t += len(cuts) - 1
    return total


class Trainer:
    """Adam over windows of lanes; the parameters, their gradients and both moments are flat arrays."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 4e-3) -> None:
        self.flat = packed(p)
        self.p, self.rate, self.steps, self.tokens = views(self.flat, p), rate, 0, 0
        self.g, self.m, self.v, self.free = (np.zeros_like(self.flat) for _ in range(4))
        self.grads = views(self.g, p)

    def _window(self, h: np.ndarray, fed: np.ndarray, first: np.ndarray, targets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        p, grads = self.p, self.grads
        self.g.fill(0)
        states, before, r, z, c, rh = _forward(p, h, fed, first, cuts)
        _, back = _output(p, states, targets, grads)
        d_r, d_z, d_c = (np.empty_like(r) for _ in range(3))
        ones = np.ones(len(fed), r.dtype)
        back_r, back_z, back_c = (np.ascontiguousarray(p[f"state_{g}"].T) for g in _GATES)
        begins = np.add.reduceat(first, cuts[:-1], dtype=np.int64).tolist()
        carried = back[:0]
        at = cuts.tolist()
        for i in range(len(at) - 2, -1, -1):
            a, b = at[i], at[i + 1]
            d, rt, zt, ct = back[a:b], r[a:b], z[a:b], c[a:b]
            d[: len(carried)] += carried
            through = d * zt
            own = d_c[a:b]
            np.multiply(ct, ct, out=own)
            np.subtract(1, own, out=own)
            own *= through
            to_rh = own @ back_c
            carried = d - through
            own = d_z[a:b]
            np.subtract(ct, before[a:b], out=own)
            own *= through
            np.subtract(1, zt, out=through)
            own *= through
            carried += own @ back_z
            own = d_r[a:b]
            np.multiply(to_rh, rh[a:b], out=own)
            np.subtract(1, rt, out=through)
            own *= through
            carried += own @ back_r
            to_rh *= rt
            carried += to_rh
            if begins[i]:
                carried[first[a:b]] = 0
        order = np.argsort(fed.astype(np.uint16), kind="stable")
        heads = np.nonzero(np.diff(fed[order], prepend=-1))[0]
        known = fed[order][heads]
        by_token = np.add.reduceat(np.concatenate((d_r, d_z, d_c), axis=1)[order], heads, axis=0)
        n = d_r.shape[1]
        for i, (g, d, seen) in enumerate((("r", d_r, before), ("z", d_z, before), ("c", d_c, rh))):
            grads[f"state_{g}"] += seen.T @ d
            grads[f"bias_{g}"] += ones @ d
            grads[f"in_{g}"][known] += by_token[:, i * n : (i + 1) * n]
        self.tokens = len(fed)
        self._update(grads)
        return states[cuts[-2] :]

    def _update(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        g, m, v, free = self.g, self.m, self.v, self.free
        g *= min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9))
        fix = min(1.0, self.tokens / FULL) ** 0.5 * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        np.subtract(g, m, out=free)
        free *= 0.1
        m += free
        g *= g
        g -= v
        g *= 0.01
        v += g
        np.sqrt(v, out=free)
        free += 1e-7
        np.divide(m, free, out=free)
        free *= self.rate * fix
        self.flat -= free

    def train(self, texts: list[np.ndarray]) -> None:
        """Trains once on each text, from its start to its end; texts have at least one token."""
        lanes = Lanes(texts, _even(texts, LANES), seed=5)
        h = np.zeros((len(lanes.length), self.p["state_r"].shape[0]), self.flat.dtype)
        end = int(lanes.length.max(initial=0))
        with np.errstate(over="ignore"):
            for t in range(0, end, WINDOW):
                at, cuts = lanes.window(t, WINDOW)
                h = self._window(h, lanes.fed[at], lanes.first[at], lanes.flat[at], cuts)
