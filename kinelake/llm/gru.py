"""A gated recurrent language model in numpy with a class-factored softmax.

Token classes are of two kinds.  The words of a head class are told apart by a
softmax over the class; a tail class is one output, and its words share it by
their frequency, which the caller knows.  Lanes read documents one after the
other; a lane's state is carried from window to window and set back where a
document begins.
"""

from __future__ import annotations

import numpy as np


#: Rows of the output layer that are worked on at a time; their logits stay in a core's cache.
ROWS = 1024


def exponentials(logits: np.ndarray, target: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of each row's target, the places of the targets, and the sums of exponentials, which overwrite logits.

    bound: no logit is larger; where it is large, exponentials are of the distance to the row's largest.
    """
    if bound > 60:
        logits -= logits.max(axis=1, keepdims=True)
    at = np.arange(0, logits.size, logits.shape[1]) + target
    logp = logits.ravel()[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    logp -= np.log(total)
    return logp, at, total


def segment_sums(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; begins: where each sum begins.  Short segments are added all at once, long ones each."""
    sizes, short = np.diff(np.append(begins, len(rows))), 8
    out = rows[begins]
    for j in range(1, short):
        own = np.flatnonzero((sizes > j) & (sizes <= short))
        out[own] += rows[begins[own] + j]
    for i in np.flatnonzero(sizes > short).tolist():
        np.add.reduce(rows[begins[i] : begins[i] + sizes[i]], axis=0, out=out[i])
    return out


class Gru:
    """Parameters: gate inputs of each token, recurrence, classes, and words of head classes (the last two with biases)."""

    NAMES = ("x", "u", "c", "w")

    def __init__(self, inputs: int, hidden: int, classes: int, bounds: np.ndarray, seed: int = 1):
        """bounds: where the words of each head class begin, and their number; head classes come first."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.hidden, self.bounds = hidden, bounds
        self.x, self.u = draw(inputs, 3 * hidden), draw(hidden, 3 * hidden)
        self.c, self.w = draw(hidden + 1, classes), draw(int(bounds[-1]), hidden + 1)
        self.c[-1], self.w[:, -1] = 0, 0

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def load(self, parameters: list[np.ndarray]) -> None:
        for n, p in zip(self.NAMES, parameters, strict=True):
            setattr(self, n, p.reshape(getattr(self, n).shape).astype(np.float32))

    def _bound(self) -> float:
        """No logit is larger: states lie in (-1, 1)."""
        return float(max(np.abs(self.c).sum(axis=0).max(), np.abs(self.w).sum(axis=1).max(initial=0)))

    def _ordered(self, states: np.ndarray, cls: np.ndarray, member: np.ndarray):
        """By class: the order, states with a component of 1 for the biases, and (rows, words from, to, targets) of each piece of a layer.

        Pieces of the classes' own layer have no words.
        """
        by, runs = self._by_class(cls)
        ordered = np.empty((len(cls), self.hidden + 1), states.dtype)
        ordered[:, :-1], ordered[:, -1] = np.take(states, by, axis=0), 1
        cls, member = cls[by], member[by]
        parts = [(slice(i, min(i + ROWS, len(cls))), None, None, cls[i : i + ROWS]) for i in range(0, len(cls), ROWS)]
        for a, b, mine in runs:
            for i in range(mine.start, mine.stop, ROWS):
                rows = slice(i, min(i + ROWS, mine.stop))
                parts.append((rows, a, b, member[rows] - a))
        return by, ordered, parts

    def outputs(self, states: np.ndarray, cls: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Log-probability of each target's class and, in head classes, of the word."""
        bound = self._bound()
        by, states, parts = self._ordered(states, cls, member)
        logp = np.zeros(len(cls), states.dtype)
        for rows, a, b, target in parts:
            logits = states[rows] @ (self.c if a is None else self.w[a:b].T)
            logp[rows] += exponentials(logits, target, bound)[0]
        out = np.empty_like(logp)
        out[by] = logp
        return out

    def _by_class(self, cls: np.ndarray):
        """The order by class, and of each head class that occurs its first and last word and its run in that order."""
        by = np.argsort(cls.astype(np.int16), kind="stable")  # short integers sort by radix
        cuts = np.searchsorted(cls[by], np.arange(len(self.bounds))).tolist()
        bounds = self.bounds.tolist()
        return by, [(bounds[k], bounds[k + 1], slice(cuts[k], cuts[k + 1])) for k in range(len(bounds) - 1) if cuts[k] < cuts[k + 1]]

    def output_gradients(self, states: np.ndarray, cls: np.ndarray, member: np.ndarray):
        """As outputs(), with the gradients of minus the mean by states and by parameters."""
        bound, k, kind = self._bound(), self.hidden, states.dtype.type
        by, states, parts = self._ordered(states, cls, member)
        logp, d = np.zeros(len(cls), states.dtype), np.zeros((len(cls), k), states.dtype)
        c, grads = np.zeros(self.c.shape[::-1], self.c.dtype), {"w": np.zeros_like(self.w)}
        by_class = np.ascontiguousarray(self.c[:k].T)
        for rows, a, b, target in parts:
            s = states[rows]
            p = s @ (self.c if a is None else self.w[a:b].T)
            more, at, total = exponentials(p, target, bound)
            logp[rows] += more
            # exponentials less their sum at the target; the sum divides what is narrower than they are
            p.ravel()[at] -= total
            share = (kind(1 / len(cls)) / total)[:, None]
            back = p @ (by_class if a is None else self.w[a:b, :k])
            back *= share
            d[rows] += back
            own = c if a is None else grads["w"][a:b]
            own += p.T @ (s * share)
        grads["c"] = np.ascontiguousarray(c.T)
        out_logp, out = np.empty_like(logp), np.empty_like(d)
        out_logp[by], out[by] = logp, d
        return out_logp, out, grads

    def _by_gate(self, p: np.ndarray) -> np.ndarray:
        return p.reshape(len(p), 3, self.hidden).swapaxes(0, 1)

    def window(self, h: np.ndarray, tokens: np.ndarray, begins: np.ndarray, keep: bool = False):
        """States after each of tokens (time by lane); begins marks where the state is set back.

        With keep, also the states before; the gates; and, for each gate, what its
        gradient is of that of the state.
        """
        k, one = self.hidden, h.dtype.type(1)
        x, u = (np.ascontiguousarray(self._by_gate(p)) for p in (self.x, self.u))
        for p in (x, u):  # the first two gates are sigmoids, 1 / (1 + exp(-x))
            np.negative(p[:2], out=p[:2])
        gx = np.empty((3, *tokens.shape, k), x.dtype)
        for table, given in zip(x, gx, strict=True):
            np.take(table, tokens, axis=0, out=given, mode="clip")
        states = np.empty((*tokens.shape, k), h.dtype)
        gates = np.empty((len(tokens) if keep else 1, 3, tokens.shape[1], k), h.dtype)
        n, kept = np.empty_like(h), None
        if keep:
            by_n, by_z, before = (np.empty_like(states) for _ in range(3))
            rest, kept = np.empty_like(h), (by_n, by_z, before, gates)
        reset = begins.any(axis=1).tolist()
        with np.errstate(over="ignore"):  # a gate of 1 / (1 + inf) is shut
            for t in range(len(tokens)):
                if reset[t]:
                    h = np.where(begins[t][:, None], h.dtype.type(0), h)
                own = gates[t if keep else 0]
                np.matmul(h, u, out=own)
                zr, (z, r, ghn) = own[:2], own
                zr += gx[:2, t]
                np.exp(zr, out=zr)
                zr += one
                np.reciprocal(zr, out=zr)
                np.multiply(r, ghn, out=n)
                n += gx[2, t]
                np.tanh(n, out=n)
                moved, after = by_z[t] if keep else states[t], states[t]
                np.subtract(h, n, out=moved)
                moved *= z
                np.add(moved, n, out=after)
                if keep:
                    before[t] = h
                    np.subtract(one, z, out=rest)
                    moved *= rest
                    np.multiply(n, n, out=by_n[t])
                    np.subtract(one, by_n[t], out=by_n[t])
                    by_n[t] *= rest
                    np.subtract(one, r, out=rest)
                    rest *= r
                    ghn *= rest
                h = after
        return states, h, kept

    def gradients(self, h, tokens, begins, cls, member):
        """Mean log-probability, the last state, and gradients through one window (truncated there)."""
        states, last, (by_n, by_z, before, gates) = self.window(h, tokens, begins, keep=True)
        k = self.hidden
        logp, d, grads = self.output_gradients(states.reshape(-1, k), cls.ravel(), member.ravel())
        d = d.reshape(states.shape)
        back, parts = np.zeros_like(h), np.empty((3, *h.shape), h.dtype)
        # gradients of the last gate's input as the token gives it, of the two sigmoids', and of the last as the state gives it
        g = np.empty((4, *states.shape), d.dtype)
        recurrent = np.ascontiguousarray(self._by_gate(self.u).swapaxes(1, 2))
        reset = begins.any(axis=1).tolist()
        for t in range(len(tokens) - 1, -1, -1):
            dh, (z, r, by_r) = d[t], gates[t]
            dh += back
            dn, dz, dr, dnr = g[:, t]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dh, by_z[t], out=dz)
            np.multiply(dn, by_r, out=dr)
            np.multiply(dn, r, out=dnr)
            np.matmul(g[1:, t], recurrent, out=parts)
            np.multiply(dh, z, out=back)
            for part in parts:
                back += part
            if reset[t]:
                back[begins[t]] = 0
        flat = g.reshape(4, -1, k)
        grads["u"] = np.matmul(before.reshape(-1, k).T, flat[1:]).swapaxes(0, 1).reshape(k, 3 * k)
        # rows of equal tokens are summed
        by = np.argsort(tokens.astype(np.int16), axis=None, kind="stable")
        ordered = tokens.ravel()[by]
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows = np.concatenate([np.take(flat[i], by, axis=0) for i in (1, 2, 0)], axis=1)
        grads["x"] = np.zeros_like(self.x)
        grads["x"][ordered[at]] = segment_sums(rows, at)
        return float(logp.mean()), last, [grads[n] for n in self.NAMES]


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.rate, self.n = rate, 0
        self.first, self.second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]

    def update(self, parameters: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float(g.ravel() @ g.ravel()) for g in grads))
        scale = min(1.0, 1.0 / max(norm, 1e-12))
        fix = self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        for p, g, m, v in zip(parameters, grads, self.first, self.second, strict=True):
            kind = p.dtype.type
            part = g * kind(0.1 * scale)
            m *= kind(0.9)
            m += part
            np.multiply(g, g, out=part)
            part *= kind(0.01 * scale * scale)
            v *= kind(0.99)
            v += part
            np.sqrt(v, out=part)
            part += kind(1e-8)
            np.divide(m, part, out=part)
            part *= kind(fix)
            p -= part


def lanes_of(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first, each to the lane with the fewest tokens; longest lane first."""
    import heapq

    heap = [(0, i) for i in range(max(1, min(lanes, len(sizes))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (n + int(sizes[d]), i))
    return sorted(out, key=lambda docs: -sum(int(sizes[d]) for d in docs))
