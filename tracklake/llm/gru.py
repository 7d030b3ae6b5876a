"""A gated recurrent language model in numpy with a class-factored output.

A symbol is a word of the vocabulary or a class of other words. The output gives a class from the state,
then a word from state and class; a class of other words ends there, and its words follow by their
counts. Weights start so that the model gives the words' overall shares.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, fields

import numpy as np

HIDDEN = 32


@dataclass
class Shape:
    """Which class and place in it each symbol has; class widths. The last symbol is the text's end."""

    classes: np.ndarray
    places: np.ndarray
    widths: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.widths) - self.widths


@dataclass
class Weights:
    inputs: np.ndarray  # (symbols + 1, 3 h): what a symbol adds to update, reset and candidate; last: start
    recurrent: np.ndarray  # (h, 3 h)
    class_out: np.ndarray  # (h, classes)
    class_bias: np.ndarray
    word_out: np.ndarray  # (h, words), words of a class side by side
    word_bias: np.ndarray

    def each(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.each()])

    def filled(self, flat: np.ndarray) -> Weights:
        parts, at = [], 0
        for a in self.each():
            parts.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Weights(*parts)


def make_shape(counts: np.ndarray, tails: int) -> Shape:
    """Words by falling count, then ``tails`` classes of other words: words are dealt to classes of about
    the square root of their number."""
    words = len(counts) - tails
    size = max(1, round(words**0.5))
    classes = np.concatenate([np.arange(words) // size, (words + size - 1) // size + np.arange(tails)])
    places = np.concatenate([np.arange(words) % size, np.zeros(tails, int)])
    return Shape(classes, places, np.bincount(classes))


def first_weights(counts: np.ndarray, shape: Shape, hidden: int = HIDDEN, seed: int = 0) -> Weights:
    draw = np.random.default_rng(seed)
    share = (counts + 0.5) / (counts + 0.5).sum()
    of_class = np.bincount(shape.classes, share)
    f = np.float32
    return Weights(
        draw.normal(0, 0.3, (len(counts) + 1, 3 * hidden)).astype(f),
        draw.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)).astype(f),
        np.zeros((hidden, len(of_class)), f),
        np.log(of_class).astype(f),
        np.zeros((hidden, len(counts)), f),
        np.log(share / of_class[shape.classes]).astype(f),
    )


def step(w: Weights, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New state, update and reset gates, candidate, and the candidate's share of the old state.

    Rows are lanes, but numpy runs over the transposed arrays: callers keep the lanes of a unit side by side
    in memory and pass views, so that gates are whole runs of memory.
    """
    x, h = x.T, h.T
    n = len(h)
    u = w.recurrent.T @ h
    gates = x[: 2 * n] + u[: 2 * n]
    gates *= np.float32(0.5)
    np.tanh(gates, out=gates)
    gates *= np.float32(0.5)
    gates += np.float32(0.5)
    update, reset, own = gates[:n], gates[n:], u[2 * n :]
    candidate = reset * own
    candidate += x[2 * n :]
    np.tanh(candidate, out=candidate)
    new = h - candidate
    new *= update
    new += candidate
    return new.T, update.T, reset.T, candidate.T, own.T


def sorted_classes(shape: Shape, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice]]]:
    """The symbols' classes, an order that puts those of a class side by side, and for each class of several
    words that occurs the slices of its words and of its places in that order."""
    of = shape.classes[symbols].astype(np.min_scalar_type(len(shape.widths)))  # short numbers are sorted faster
    order = np.argsort(of, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(shape.widths)))])
    several = np.flatnonzero((shape.widths > 1) & (cuts[1:] > cuts[:-1]))
    return of, order, [(slice(shape.starts[c], shape.starts[c] + shape.widths[c]), slice(cuts[c], cuts[c + 1])) for c in several]


def log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log_softmax at one place of each column; scores are small enough to be raised as they are."""
    picked = z[at, np.arange(len(at))]
    np.exp(np.clip(z, -80, 80, out=z), out=z)
    return picked - np.log(z.sum(0))


def with_bias(out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Output weights with their bias as a last row, which meets a state's last unit, always one."""
    return np.concatenate([out, bias[None]])


def with_one(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in this order, units as rows, and a unit that is always one."""
    found = np.ones((states.shape[1] + 1, len(order)), states.dtype)
    np.take(states.T, order, 1, out=found[:-1], mode="clip")
    return found


def log_probability(w: Weights, shape: Shape, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The natural log-probability of each symbol given its state."""
    of, order, classes = sorted_classes(shape, symbols)
    # The states of a class side by side, so that its products take them as they lie.
    states, places = with_one(states, order), shape.places[symbols[order]]
    total = log_share(with_bias(w.class_out, w.class_bias).T @ states, of[order])
    word_out = with_bias(w.word_out, w.word_bias).T
    for part, rows in classes:
        total[rows] += log_share(word_out[part] @ states[:, rows], places[rows])
    found = np.empty_like(total)
    found[order] = total
    return found


def softmax(z: np.ndarray) -> np.ndarray:
    """Over each column, in place."""
    z -= z.max(0)
    np.exp(z, out=z)
    z *= 1 / z.sum(0)
    return z


def output_gradients(w: Weights, shape: Shape, states: np.ndarray, symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the negative sum of log-probabilities for the output's weights and for the states."""
    of, order, classes = sorted_classes(shape, symbols)
    states, places = with_one(states, order), shape.places[symbols[order]]
    each = np.arange(len(of))
    error = softmax(with_bias(w.class_out, w.class_bias).T @ states)
    error[of[order], each] -= 1
    back, of_class = w.class_out @ error, states @ error.T
    words = with_bias(w.word_out, w.word_bias)
    of_word = np.zeros_like(words)
    for part, rows in classes:
        own = states[:, rows]
        error = softmax(words[:, part].T @ own)
        error[places[rows], each[: error.shape[1]]] -= 1
        back[:, rows] += w.word_out[:, part] @ error
        of_word[:, part] = own @ error.T
    given = np.empty_like(order)
    given[order] = each
    return [of_class[:-1], of_class[-1], of_word[:-1], of_word[-1]], np.take(back, given, 1).T


class Trainer:
    """Truncated backpropagation with per-weight steps; the state runs on from window to window."""

    def __init__(self, w: Weights, shape: Shape, rate: float = 0.08, window: int = 16, lanes: int = 32):
        self.w, self.shape, self.rate, self.window, self.lanes = w, shape, rate, window, lanes
        self.squares = [np.full_like(a, 1e-3) for a in w.each()]
        self.symbols = 0

    def run(self, symbols: np.ndarray, fresh: np.ndarray) -> None:
        """Learns from a run of symbols; ``fresh`` marks those with nothing before them."""
        lanes = max(1, min(self.lanes, len(symbols) // self.window))
        each = -(-len(symbols) // lanes)
        spare = lanes * each - len(symbols)
        weight = np.ones(len(symbols) + spare, np.float32)
        weight[len(symbols) :] = 0
        target = np.concatenate([symbols, np.zeros(spare, symbols.dtype)]).reshape(lanes, each)
        fresh = np.concatenate([fresh, np.ones(spare, bool)]).reshape(lanes, each)
        weight = weight.reshape(lanes, each)
        start = len(self.w.inputs) - 1
        given = np.concatenate([np.full((lanes, 1), start), target[:, :-1]], 1)
        given = np.where(fresh, start, given)
        state = np.zeros((self.w.recurrent.shape[0], lanes), self.w.recurrent.dtype)
        for at in range(0, each, self.window):
            part = slice(at, at + self.window)
            state = self._window(given[:, part], target[:, part], fresh[:, part], weight[:, part], state)
        self.symbols += len(symbols)

    def _window(self, given, target, fresh, weight, state) -> np.ndarray:
        w, (n, lanes) = self.w, state.shape
        given, kept = given.T.ravel(), (~fresh.T).astype(state.dtype)
        x = np.take(np.ascontiguousarray(w.inputs.T), given, 1)
        steps = [slice(t * lanes, (t + 1) * lanes) for t in range(len(kept))]
        before, seen, gates = np.empty((n, len(given)), state.dtype), np.empty((n, len(given)), state.dtype), []
        for t, part in enumerate(steps):
            np.multiply(state, kept[t], out=before[:, part])
            state, *found = (a.T for a in step(w, x[:, part].T, before[:, part].T))
            gates.append(found)
            seen[:, part] = state
        (class_out, class_bias, word_out, word_bias), back = output_gradients(w, self.shape, seen.T, target.T.ravel())
        # Rows of padding are few and stand at the end; their error does not run back.
        back = back.T * weight.T.ravel()
        # What reaches the recurrent products; of the candidates also what reaches their inputs.
        inner, entered = np.empty((3 * n, len(given)), state.dtype), np.empty((n, len(given)), state.dtype)
        carried = np.zeros_like(state)
        for t, part in reversed([*enumerate(steps)]):
            update, reset, candidate, own = gates[t]
            d = np.add(back[:, part], carried, out=carried)
            d_candidate = np.multiply(d, 1 - update, out=entered[:, part])
            d_candidate *= 1 - candidate * candidate
            kept_d = d * update
            d_update = np.subtract(before[:, part], candidate, out=inner[:n, part])
            d_update *= kept_d
            d_update *= 1 - update
            kept_candidate = np.multiply(d_candidate, reset, out=inner[2 * n :, part])
            d_reset = np.multiply(kept_candidate, own, out=inner[n : 2 * n, part])
            d_reset *= 1 - reset
            carried = w.recurrent @ inner[:, part]
            carried += kept_d
            carried *= kept[t]
        recurrent = before @ inner.T
        # Summed by symbol, a unit at a time.
        sums = [np.bincount(given, row, len(w.inputs)) for part in (inner[: 2 * n], entered) for row in part]
        inputs = np.ascontiguousarray(np.array(sums, state.dtype).T)
        for k, g in enumerate((inputs, recurrent, class_out, class_bias, word_out, word_bias)):
            self._move(k, g, slice(None))
        return state

    def _move(self, k: int, gradient: np.ndarray, where) -> None:
        gradient = np.clip(gradient, -5, 5, out=gradient)
        squares = self.squares[k]
        squares[where] += gradient * gradient
        gradient *= self.rate
        gradient /= np.sqrt(squares[where])
        self.w.each()[k][where] -= gradient


def score(w: Weights, shape: Shape, texts: list[np.ndarray], lanes: int = 256, window: int = 32) -> np.ndarray:
    """The natural log-probability of each text's symbols, from its first to its last.

    Texts are laid end to end in lanes of about equal length; the state runs on across windows and starts
    anew with each text.
    """
    totals = np.zeros(len(texts))
    lengths = np.array([len(t) for t in texts])
    load = [(0, k) for k in range(min(lanes, len(texts)))]
    own: list[list[int]] = [[] for _ in load]
    for text in np.argsort(-lengths, kind="stable").tolist():
        size, lane = heapq.heappop(load)
        own[lane].append(text)
        heapq.heappush(load, (size + int(lengths[text]), lane))
    own = [np.array(held) for held in sorted(own, key=lambda held: -sum(int(lengths[t]) for t in held))]
    start = len(w.inputs) - 1
    sizes = np.array([lengths[held].sum() for held in own], np.int64)
    # Lanes are sorted by length, so those that reach a place stand first. Symbols lie by place, then by lane.
    running = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)))
    begin = np.concatenate([[0], np.cumsum(running)])
    given, target, text_of = (np.empty(begin[-1], kind) for kind in (np.int32, np.int32, np.int64))
    for lane, held in enumerate(own):
        at = begin[: sizes[lane]] + lane
        symbols, texts_in = np.concatenate([texts[t] for t in held]), np.repeat(held, lengths[held])
        before = np.concatenate([[start], symbols])[:-1]
        before[1:][texts_in[1:] != texts_in[:-1]] = start
        given[at], target[at], text_of[at] = before, symbols, texts_in
    state = np.zeros((w.recurrent.shape[0], len(own)), w.recurrent.dtype)
    inputs = np.ascontiguousarray(w.inputs.T)
    for at in range(0, len(running), window):
        part = slice(begin[at], begin[min(at + window, len(running))])
        g = given[part]
        x = np.take(inputs, g, 1)
        states, end = np.empty((len(state), len(g)), state.dtype), 0
        for now in running[at : at + window].tolist():
            here = slice(end, end := end + now)
            opening, state = g[here] == start, state[:, :now]
            if opening.any():
                state = state * ~opening
            state = step(w, x[:, here].T, state.T)[0].T
            states[:, here] = state
        totals += np.bincount(text_of[part], log_probability(w, shape, states.T, target[part]), len(texts))
    return totals
