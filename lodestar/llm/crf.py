"""Linear-chain conditional random fields in numpy: fitting, forward-backward marginals and Viterbi paths.

A token's potentials are sums of weights of its own features and of those of its
neighbours. ``Potentials`` keeps them by token, so features are named once for a
token that comes again, and all else is array work over many documents at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from .common import TokenKinds, TokenSlots, byte_codes

_CODES = byte_codes(90)


class Crf:
    """Weights of one model. ``features(token)`` names the features of a token; ``around`` the offsets at which a token sees its neighbours' names."""

    def __init__(self, states: int, features: Callable[[str], Iterable[str]], neighbour: Callable[[str], Iterable[str]], around: tuple[int, ...]):
        self.states, self.features, self.neighbour, self.around = states, features, neighbour, around
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, states))
        self.moves = np.zeros((states, states))

    def names(self, tokens: list[str], extra: Iterable[str] = ()) -> list[list[str]]:
        """The feature names of each token of one chain; ``extra`` holds those of its file."""
        own = [[*self.features(t)] for t in tokens]
        near = [[*self.neighbour(t)] for t in tokens]
        extra = list(extra)
        out = []
        for i in range(len(tokens)):
            have = own[i] + extra
            for d in self.around:
                if 0 <= i + d < len(tokens):
                    have = have + [f"{d:+d}{x}" for x in near[i + d]]
            out.append(have)
        return out

    def fit(self, chains: list[tuple[list[str], list[int], list[str]]], rounds: int = 60, ridge: float = 1e-3, rate: float = 0.2, least: int = 3, warm: bool = False) -> Crf:
        """Maximum likelihood with an L2 penalty by Adam on all chains (tokens, tags, file features) at once; ``least``: how often a feature must come; ``warm``: go on from the weights there are, if the features are the same."""
        chains = [c for c in chains if c[0]]
        if not chains:
            return self
        k = self.states
        named = [self.names(tokens, extra) for tokens, _, extra in chains]
        counts: dict[str, int] = {}
        for chain in named:
            for have in chain:
                for f in have:
                    counts[f] = counts.get(f, 0) + 1
        before, self.index = self.index, {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
        longest = max(len(c) for c in named)
        at, feature, base = [], [], 0
        tags = np.zeros((longest, len(chains)), np.int64)
        real = np.zeros((longest, len(chains)), bool)
        for j, chain in enumerate(named):
            tags[: len(chain), j] = chains[j][1]
            real[: len(chain), j] = True
            for i, have in enumerate(chain):
                for f in have:
                    if (x := self.index.get(f)) is not None:
                        at.append(i * len(chains) + j)
                        feature.append(x)
        at, feature = np.array(at, np.int64), np.array(feature, np.int64)
        places, size = longest * len(chains), len(self.index)
        hot = np.zeros((places, k))
        hot[np.arange(places), tags.reshape(-1)] = real.reshape(-1)
        both = real[1:] & real[:-1]
        seen = np.zeros((k, k))
        np.add.at(seen, (tags[:-1][both], tags[1:][both]), 1)
        total = real.sum()
        w, moves = (self.weights.copy(), self.moves.copy()) if warm and before == self.index else (np.zeros((size, k)), np.zeros((k, k)))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
        for step in range(1, rounds + 1):
            unary = np.stack([np.bincount(at, w[feature, s], places) for s in range(k)], 1).reshape(longest, len(chains), k)
            alpha, beta, trans = np.zeros_like(unary), np.zeros_like(unary), np.exp(moves)
            e = np.exp(unary - unary.max(2, keepdims=True))
            a = e[0] / e[0].sum(1, keepdims=True)
            alpha[0] = a
            for t in range(1, longest):
                nxt = (a @ trans) * e[t]
                nxt /= nxt.sum(1, keepdims=True)
                a = np.where(real[t][:, None], nxt, a)
                alpha[t] = a
            b = np.ones((len(chains), k))
            beta[-1] = b
            expected = np.zeros((k, k))
            for t in range(longest - 1, 0, -1):
                inward = e[t] * b
                joint = alpha[t - 1][:, :, None] * trans * inward[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                expected += joint[real[t]].sum(0)
                back = inward @ trans.T
                back /= back.sum(1, keepdims=True)
                b = np.where(real[t][:, None], back, b)
                beta[t - 1] = b
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            gap = (p.reshape(-1, k) * real.reshape(-1)[:, None] - hot) / total
            grad_w = np.stack([np.bincount(feature, gap[at, s], size) for s in range(k)], 1) + ridge * w / total * 100
            grad_m = (expected - seen) / total + ridge * moves / total
            for x, g, m, v in ((w, grad_w, state[0], state[1]), (moves, grad_m, state[2], state[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = w, moves
        return self


class Potentials:
    """Rows of potentials by token; a token's row holds those of itself, then those it lends to neighbours at each offset of ``around``."""

    LIMIT = 500_000  # tokens kept; beyond, those that did not come back are dropped (the values do not change)

    def __init__(self, model: Crf):
        self.model = model
        self.weights = model.weights
        self.known = [model.index] + [{f[len(p) :]: i for f, i in model.index.items() if f.startswith(p)} for p in (f"{d:+d}" for d in model.around)]
        self.slots = TokenSlots(self.LIMIT)
        self.table = np.zeros((0, len(self.known) * model.states))

    def _rows(self, tokens: list[str]) -> np.ndarray:
        own = [self.model.features(t) for t in tokens]
        near = [self.model.neighbour(t) for t in tokens]
        out = []
        for k, known in enumerate(self.known):
            names = near if k else own
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            at = np.array([known.get(f, -1) for have in names for f in have], np.int64)
            which = np.repeat(np.arange(len(names)), sizes)[at >= 0]
            out.append(np.stack([np.bincount(which, self.weights[at[at >= 0], s], len(names)) for s in range(self.model.states)], 1))
        return np.concatenate(out, 1)

    def rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each token, a range of the bytes ``data``."""
        kinds = TokenKinds(data, start, end, _CODES)
        at = self.slots.find(kinds)
        if len(new := np.flatnonzero(at < 0)):
            raw = data.tobytes()
            fresh = self._rows([raw[a:b].decode() for a, b in zip(kinds.begin[new].tolist(), (kinds.begin + kinds.size)[new].tolist(), strict=True)])
            if (kept := self.slots.trim()) is not None:
                self.table = self.table[kept]
            self.slots.add(kinds, new)
            self.table = np.concatenate([self.table, fresh])
            at = self.slots.find(kinds)
            for i in np.flatnonzero(at < 0).tolist():  # two tokens of one hash
                at[i] = len(self.table)
                self.table = np.concatenate([self.table, self._rows([raw[kinds.begin[i] : kinds.begin[i] + kinds.size[i]].decode()])])
        out = self.table[at[kinds.kind]]
        self.table = self.table[: len(self.slots.key)]
        return out

    def unary(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray, extras: list[list[str]] | None = None) -> np.ndarray:
        """The potentials of all tokens of chains that lie one after the other; ``offsets`` of the chains in them."""
        m, k = self.model, self.model.states
        rows = self.rows(data, start, end)
        out = rows[:, :k].copy()
        chain = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for j, d in enumerate(m.around):
            lent = rows[:, (1 + j) * k : (2 + j) * k]
            if d < 0:
                same = chain[-d:] == chain[:d]
                out[-d:] += lent[:d] * same[:, None]
            else:
                same = chain[:-d] == chain[d:]
                out[:-d] += lent[d:] * same[:, None]
        if extras is not None:
            add = np.zeros((len(offsets) - 1, k))
            for i, names in enumerate(extras):
                for f in names:
                    if (x := m.index.get(f)) is not None:
                        add[i] += m.weights[x]
            out += add[chain]
        return out


def marginals(unary: np.ndarray, offsets: np.ndarray, moves: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """Forward-backward marginals of many chains that lie one after the other.

    The joined chains are cut into equally long lanes that numpy walks side by
    side: once with every state as the start, so that the lanes' products give
    each lane's true entry vector, then once more from that. At the start of a
    chain the step forgets the state before.
    """
    n, k = unary.shape
    if not n:
        return unary.copy()
    lanes = max(1, min(lanes, n // 16))
    length = -(-n // lanes)
    total = lanes * length
    e = np.ones((total, k))
    e[:n] = np.exp(unary - unary.max(1, keepdims=True))
    fresh = np.zeros(total + 1, bool)
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    fresh[n:] = True
    e = e.reshape(lanes, length, k)
    enters = fresh[:total].reshape(lanes, length)
    leaves = fresh[1:].reshape(lanes, length)  # the next token starts a chain
    a = np.exp(moves)

    def walk(inward: np.ndarray, keep: bool, forward: bool):
        """inward: lanes x starts x states. The vectors after the lane, or at all places of it."""
        out = np.empty((length, *inward.shape)) if keep else None
        v = inward
        for t in range(length) if forward else range(length - 1, -1, -1):
            reset = (enters if forward else leaves)[:, t][:, None, None]
            if forward:
                v = np.where(reset, v.sum(2, keepdims=True), v @ a) * e[:, t][:, None, :]
            else:
                v = np.where(reset, v.sum(2, keepdims=True), v @ a.T)
                if keep:
                    out[t] = v
                v = v * e[:, t][:, None, :]
            v = v / v.max(axis=(1, 2), keepdims=True)
            if keep and forward:
                out[t] = v
        return out if keep else v

    def entries(forward: bool) -> np.ndarray:
        product = walk(np.broadcast_to(np.eye(k), (lanes, k, k)).copy(), False, forward)
        v, out = np.ones(k), np.empty((lanes, 1, k))
        if k == 2:  # plain numbers, faster than tiny arrays
            x, y = 1.0, 1.0
            rows = product.reshape(lanes, 4).tolist()
            for p in range(lanes) if forward else range(lanes - 1, -1, -1):
                out[p, 0, 0], out[p, 0, 1] = x, y
                c = rows[p]
                x, y = x * c[0] + y * c[2], x * c[1] + y * c[3]
                top = max(x, y)
                x, y = x / top, y / top
            return out
        for p in range(lanes) if forward else range(lanes - 1, -1, -1):
            out[p, 0] = v
            v = v @ product[p]
            v = v / v.max()
        return out

    alpha = walk(entries(True), True, True)[:, :, 0]
    beta = walk(entries(False), True, False)[:, :, 0]
    p = (alpha * beta).transpose(1, 0, 2).reshape(total, k)[:n]
    return p / p.sum(1, keepdims=True)


def viterbi(unary: np.ndarray, offsets: np.ndarray, moves: np.ndarray, rest: int = 0) -> np.ndarray:
    """The best path of each of many chains that lie one after the other.

    Where state ``rest`` leads by more than two moves can ever make up, every
    best path is in it; only the stretches between such tokens are decoded.
    """
    n, k = unary.shape
    out = np.full(n, rest, np.int64)
    if not n:
        return out
    others = np.delete(unary, rest, 1).max(1)
    open_ = unary[:, rest] - others <= 2 * (moves.max() - moves.min())
    at = np.flatnonzero(open_)
    if not len(at):
        return out
    starts = np.zeros(n + 1, bool)
    starts[offsets] = True
    cut = np.flatnonzero((np.diff(at) > 1) | starts[at[1:]]) + 1
    for run in np.split(at, cut):
        first, last = int(run[0]), int(run[-1])
        score = unary[first] + (0 if starts[first] else moves[rest])
        back = []
        for t in range(first + 1, last + 1):
            step = score[:, None] + moves
            back.append(step.argmax(0))
            score = step.max(0) + unary[t]
        if not starts[last + 1]:
            score = score + moves[:, rest]
        best = int(score.argmax())
        for t in range(last, first, -1):
            out[t] = best
            best = int(back[t - first - 1][best])
        out[first] = best
    return out
