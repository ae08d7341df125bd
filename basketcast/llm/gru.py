"""A gated recurrent network with a class-factored output softmax, in numpy.

Inputs and outputs are symbols 0..n_head-1 (frequent words, ``block`` to a class in
order of frequency) and n_head..n_head+n_tail-1 (classes of all other words, which are
their own last factor).  With state h,

    P(symbol) = P(class | h) * P(word | class, h)      (a tail class: P(class | h))

so a word costs one softmax over the classes and one over its class.  Training is
truncated back-propagation through time: gradients stop at a window's start, the state
is carried over it.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def loss_of_softmax(x: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss of the entries ``at``, one of each column, and its gradient; ``x`` is used up."""
    columns = np.arange(len(at))
    x -= x.max(axis=0)
    own = x[at, columns]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    x[at, columns] -= 1
    return float((np.log(total) - own).sum()), x


def log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One entry of each column's ``log_softmax``; ``x`` is used up."""
    x -= x.max(axis=0)
    own = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=0))


def stable_order(numbers: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of numbers under ``bound``; those of 16 bits are dealt by digits, not compared."""
    return np.argsort(numbers.astype(np.uint16) if bound <= 1 << 16 else numbers, kind="stable")


class Gru:
    def __init__(self, n_head: int, n_tail: int, block: int, params: Params):
        self.n_head, self.n_tail, self.block, self.p = n_head, n_tail, block, params
        self.n_head_classes = -(-n_head // block)
        self.classes = self.n_head_classes + n_tail

    @classmethod
    def start(cls, counts: np.ndarray, n_head: int, block: int, hidden: int, seed: int = 7) -> Gru:
        """Small random weights; biases that give the symbols their relative frequencies."""
        rng = np.random.default_rng(seed)
        n = len(counts)
        n_classes = -(-n_head // block)
        weight = np.asarray(counts, dtype=float) + 1.0
        mass = np.concatenate([np.add.reduceat(weight[:n_head], np.arange(0, n_head, block)), weight[n_head:]])
        inner = np.full(n_classes * block, -30.0)
        inner[:n_head] = np.log(weight[:n_head])
        make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        recurrent = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        return cls(n_head, n - n_head, block, {
            "inputs": make(n + 1, 3 * hidden),       # one more: a document's start
            "recurrent": recurrent, "bias": np.zeros(3 * hidden, dtype=np.float32),
            "outer": make(hidden, n_classes + n - n_head) * np.float32(0.1), "outer_bias": np.log(mass / mass.sum()).astype(np.float32),
            "inner": make(n_classes, hidden, block) * np.float32(0.1), "inner_bias": inner.reshape(n_classes, block).astype(np.float32)})

    @property
    def hidden(self) -> int:
        return self.p["recurrent"].shape[0]

    @property
    def first(self) -> int:
        return self.n_head + self.n_tail

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.n_head, symbols // self.block, symbols - self.n_head + self.n_head_classes)

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and the gates for going back; a row per stream."""
        return tuple(a.T for a in self.next_state(h.T, x))

    def next_state(self, h: np.ndarray, x: np.ndarray, room: tuple = (None, None, None), bias: np.ndarray | None = None
                   ) -> tuple[np.ndarray, ...]:
        """``step`` with a column per stream, so every gate is one run of memory; ``room`` for what it gives but the
        state, ``bias`` in columns."""
        k = self.hidden
        a = self.p["inputs"].take(x, axis=0).T
        b = np.matmul(self.p["recurrent"].T, h, out=room[0])
        b += self.p["bias"][:, None] if bias is None else bias
        gates = np.add(a[:2 * k], b[:2 * k], out=room[1])
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        update, reset = gates[:k], gates[k:]
        new = np.multiply(reset, b[2 * k:], out=room[2])
        new += a[2 * k:]
        np.tanh(new, out=new)
        after = h - new
        after *= update
        after += new
        return after, update, reset, new, b[2 * k:]

    def by_class(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of the head, class by class, and where each class begins."""
        order = stable_order(which, self.classes)
        edges = np.r_[0, np.cumsum(np.bincount(which, minlength=self.classes)[:self.n_head_classes])]
        return order[:edges[-1]], edges

    def log_probabilities(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of P(symbol | state), a row each."""
        return self.log_of_columns(np.ascontiguousarray(states.T), symbols)

    def log_of_columns(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """``log_probabilities`` of states in columns."""
        which = self.class_of(symbols)
        outer = self.p["outer"].T @ states
        outer += self.p["outer_bias"][:, None]
        out = log_share(outer, which)
        order, edges = self.by_class(which)
        own, words = states.take(order, axis=1), symbols[order]
        inside = np.empty(len(order), dtype=out.dtype)
        for c in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[c], edges[c + 1]
            inner = self.p["inner"][c].T @ own[:, lo:hi]
            inner += self.p["inner_bias"][c][:, None]
            inside[lo:hi] = log_share(inner, words[lo:hi] - c * self.block)
        out[order] += inside
        return out

    def loss_and_gradients(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[float, Params, np.ndarray]:
        """Summed loss of a window and its gradients; ``x, y, keep`` are (steps, streams), ``keep`` 0 where a
        document begins (the state is dropped there); and the state after the window."""
        p, k = self.p, self.hidden
        steps, streams = x.shape
        h = h.T
        kind = np.result_type(h, p["inputs"])
        before, new = (np.empty((steps, k, streams), dtype=kind) for _ in range(2))
        gates, linear = np.empty((steps, 2 * k, streams), dtype=kind), np.empty((steps, 3 * k, streams), dtype=kind)
        update, reset, lin = gates[:, :k], gates[:, k:], linear[:, 2 * k:]
        states = np.empty((k, steps, streams), dtype=kind)
        bias = np.repeat(p["bias"][:, None], streams, axis=1)
        for t in range(steps):
            np.multiply(h, keep[t], out=before[t])
            h = self.next_state(before[t], x[t], (linear[t], gates[t], new[t]), bias)[0]
            states[:, t] = h
        flat, target = states.reshape(k, -1), y.ravel()
        which = self.class_of(target)
        outer = p["outer"].T @ flat
        outer += p["outer_bias"][:, None]
        loss, d = loss_of_softmax(outer, which)
        g = {"outer": flat @ d.T, "outer_bias": d.sum(axis=1), "inner": np.zeros_like(p["inner"]),
             "inner_bias": np.zeros_like(p["inner_bias"])}
        d_flat = p["outer"] @ d
        order, edges = self.by_class(which)
        own, words = flat.take(order, axis=1), target[order]
        d_own = np.zeros((k, len(order) + 1), dtype=own.dtype)  # the last column for symbols that are no word
        for c in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[c], edges[c + 1]
            inner = p["inner"][c].T @ own[:, lo:hi]
            inner += p["inner_bias"][c][:, None]
            more, d = loss_of_softmax(inner, words[lo:hi] - c * self.block)
            loss += more
            g["inner"][c], g["inner_bias"][c] = own[:, lo:hi] @ d.T, d.sum(axis=1)
            d_own[:, lo:hi] = p["inner"][c] @ d
        place = np.full(len(which), len(order))
        place[order] = np.arange(len(order))
        d_flat += d_own.take(place, axis=1)
        d_states = d_flat.reshape(k, steps, streams)
        # what a step back multiplies by, for all steps at once
        rest = 1 - update
        by_new, by_update, by_reset = new * new, before - new, lin * reset
        np.subtract(1, by_new, out=by_new)
        by_new *= rest
        by_update *= update
        by_update *= rest
        np.subtract(1, reset, out=rest)
        by_reset *= rest
        d_inputs, d_recurrent = np.empty((3 * k, steps, streams), dtype=kind), np.empty((steps, 3 * k, streams), dtype=kind)
        carry = np.zeros((k, streams), dtype=kind)
        for t in reversed(range(steps)):
            dh = d_states[:, t] + carry
            da, db = d_inputs[:, t], d_recurrent[t]
            np.multiply(dh, by_update[t], out=da[:k])
            np.multiply(dh, by_new[t], out=da[2 * k:])
            np.multiply(da[2 * k:], by_reset[t], out=da[k:2 * k])
            db[:2 * k] = da[:2 * k]
            np.multiply(da[2 * k:], reset[t], out=db[2 * k:])
            dh *= update[t]
            dh += p["recurrent"] @ db
            dh *= keep[t]
            carry = dh
        g["recurrent"] = np.matmul(before, d_recurrent.transpose(0, 2, 1)).sum(axis=0)
        g["bias"] = d_recurrent.sum(axis=(0, 2))
        g["inputs"] = np.zeros_like(p["inputs"])
        order = stable_order(x.ravel(), self.first + 1)
        symbols = x.ravel()[order]
        begin = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        g["inputs"][symbols[begin]] = np.add.reduceat(d_inputs.reshape(3 * k, -1).take(order, axis=1), begin, axis=1).T
        return loss, g, h.T

    def train(self, texts: list[np.ndarray], streams: int = 32, window: int = 24, rate: float = 0.01, passes: int = 1,
              seed: int = 0) -> int:
        """Adam over whole texts (arrays of symbols, the end symbol included); tokens seen."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return 0
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v = {n: np.zeros_like(w) for n, w in self.p.items()}
        seen, done = 0, 0
        total = sum(map(len, texts))
        streams = max(1, min(streams, total // (4 * window)))
        for _ in range(passes):
            order = rng.permutation(len(texts))
            y = np.concatenate([texts[k] for k in order])
            starts = np.concatenate([np.r_[True, np.zeros(len(texts[k]) - 1, dtype=bool)] for k in order])
            x = np.where(starts, self.first, np.r_[0, y[:-1]])
            length, over = divmod(len(y), streams)
            cut = lambda a: a[:length * streams].reshape(streams, length).T
            rest = lambda a: a[length * streams:].reshape(over, 1)
            keep = (~starts).astype(np.float32)
            windows = [tuple(cut(a)[t:t + window] for a in (x, y, keep)) for t in range(0, length, window)]
            windows += [tuple(rest(a) for a in (x, y, keep))] if over else []  # the few tokens over: a last stream of their own
            h = np.zeros((streams, self.hidden), dtype=np.float32)
            planned = passes * len(windows)
            for part in windows:
                _, g, h = self.loss_and_gradients(h[-part[0].shape[1]:], *part)
                n = part[0].size
                seen += n
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values())) / n
                scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / n)
                done += 1
                lr = rate * (1 - 0.9 * done / planned)
                for name, a in g.items():
                    a *= scale
                    step = a - m[name]
                    step *= 0.1
                    m[name] += step
                    np.multiply(a, a, out=a)
                    a -= v[name]
                    a *= 0.005
                    v[name] += a
                    np.divide(v[name], np.float32(1 - 0.995**done), out=a)
                    np.sqrt(a, out=a)
                    a += np.float32(1e-6)
                    np.multiply(m[name], np.float32(lr / (1 - 0.9**done)), out=step)
                    step /= a
                    self.p[name] -= step
        return seen

    def score(self, texts: list[np.ndarray], streams: int = 512, window: int = 32) -> np.ndarray:
        """Log probability (natural) of whole texts; the state is carried from window to window."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for lo in range(0, len(order), streams):
            group = order[lo:lo + streams]
            lengths = np.array([len(texts[k]) for k in group])
            flat = np.concatenate([texts[k] for k in group])
            begin, places = np.r_[0, np.cumsum(lengths[:-1])], np.arange(len(group))
            live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()  # longer than t: a leading run
            h = np.zeros((self.hidden, len(group)), dtype=np.float32)
            x = np.full(len(group), self.first)
            for t in range(0, len(live), window):
                states, symbols, rows = [], [], live[t:t + window]
                for s, n in enumerate(rows, start=t):
                    h = self.next_state(h[:, :n], x[:n])[0]
                    x = flat[begin[:n] + s]
                    states.append(h)
                    symbols.append(x)
                logs = self.log_of_columns(np.concatenate(states, axis=1), np.concatenate(symbols))
                who = np.concatenate([places[:n] for n in rows])
                out[group] += np.bincount(who, weights=logs, minlength=len(group))
        return out


def pack_params(params: Params) -> np.ndarray:
    return np.concatenate([params[n].ravel() for n in sorted(params)]).astype(np.float64)


def unpack_params(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for n in sorted(like):
        size = like[n].size
        out[n] = flat[at:at + size].reshape(like[n].shape).astype(np.float32)
        at += size
    return out
