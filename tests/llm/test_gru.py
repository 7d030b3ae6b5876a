import time

import numpy as np
import pytest

from tracklake.llm import gru


def small(seed=0, hidden=5):
    counts = np.array([50, 30, 20, 10, 9, 8, 5, 40, 25, 60], float)
    shape = gru.make_shape(counts, 3)
    w = gru.first_weights(counts, shape, hidden, seed)
    draw = np.random.default_rng(seed)
    return counts, shape, gru.Weights(*[(a + draw.normal(0, 0.3, a.shape)).astype(np.float64) for a in w.each()])


def plain_score(w, shape, text):
    """Symbol by symbol, class and word by full sums."""
    h, total, given = np.zeros((1, w.recurrent.shape[0])), 0.0, len(w.inputs) - 1
    for symbol in text:
        h = gru.step(w, w.inputs[[given]], h)[0]
        z = (h @ w.class_out + w.class_bias)[0]
        c = shape.classes[symbol]
        total += z[c] - np.log(np.exp(z).sum())
        members = np.flatnonzero(shape.classes == c)
        inner = (h @ w.word_out[:, members] + w.word_bias[members])[0]
        total += inner[shape.places[symbol]] - np.log(np.exp(inner).sum())
        given = symbol
    return total


def test_first_weights_give_the_shares():
    counts = np.array([50, 30, 20, 10, 9, 8, 5, 40, 25, 60], float)
    shape = gru.make_shape(counts, 3)
    w = gru.first_weights(counts, shape)
    logp = gru.log_probability(w, shape, np.random.default_rng(0).normal(size=(10, gru.HIDDEN)), np.arange(10))
    assert np.exp(logp) == pytest.approx((counts + 0.5) / (counts + 0.5).sum(), rel=1e-5)


def test_whole_texts_are_scored_with_state_across_windows():
    _, shape, w = small()
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 10, n) for n in (0, 1, 5, 40, 7, 130, 3, 1, 66)]
    got = gru.score(w, shape, texts, lanes=3, window=8)
    assert got == pytest.approx([plain_score(w, shape, t) for t in texts], rel=1e-9)
    assert len(gru.score(w, shape, [])) == 0


def test_gradients_against_differences():
    _, shape, w = small(2)
    symbols = np.random.default_rng(3).integers(0, 10, 12)
    fresh = np.zeros(12, bool)
    fresh[[0, 7]] = True
    grads = {}
    trainer = gru.Trainer(w, shape, window=12, lanes=1)
    trainer._move = lambda k, g, where: grads.__setitem__(k, (g, where))
    trainer.run(symbols, fresh)
    loss = lambda x: -sum(plain_score(x, shape, t) for t in (symbols[:7], symbols[7:]))
    for k, a in enumerate(w.each()):
        full = np.zeros_like(a)
        full[grads[k][1]] = grads[k][0]
        for at in np.random.default_rng(k).permutation(a.size)[:25]:
            old = a.flat[at]
            a.flat[at] = old + 1e-5
            up = loss(w)
            a.flat[at] = old - 1e-5
            down = loss(w)
            a.flat[at] = old
            assert full.flat[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_training_learns_an_order():
    counts = np.full(12, 100.0)
    shape = gru.make_shape(counts, 2)
    w = gru.first_weights(counts, shape, 16)
    symbols = np.tile(np.arange(12), 600)
    before = gru.score(w, shape, [symbols[:120]])[0]
    gru.Trainer(w, shape).run(symbols, np.arange(len(symbols)) % 120 == 0)
    after = gru.score(w, shape, [symbols[:120]])[0]
    assert after > before / 2


def rows_window(trainer, given, target, fresh, weight, state):
    """A window with lanes as rows and units in places, as the formulas say."""
    w, n = trainer.w, state.shape[1]
    kept, states = [], []
    for t in range(given.shape[1]):
        before = state * ~fresh[:, t, None]
        x, u = w.inputs[given[:, t]], before @ w.recurrent
        gates = (np.tanh((x[:, : 2 * n] + u[:, : 2 * n]) * 0.5) * 0.5 + 0.5).astype(state.dtype)
        update, reset, own = gates[:, :n], gates[:, n:], u[:, 2 * n :]
        candidate = np.tanh(x[:, 2 * n :] + reset * own)
        state = candidate + update * (before - candidate)
        kept.append((before, update, reset, candidate, own))
        states.append(state)
    symbols, shape = target.T.ravel(), trainer.shape
    order = np.argsort(shape.classes[symbols], kind="stable")
    symbols, seen, grads = symbols[order], np.concatenate(states)[order], [np.zeros_like(a) for a in w.each()]
    of = shape.classes[symbols]

    def shares(z):
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
        return z

    error = shares(seen @ w.class_out + w.class_bias)
    error[np.arange(len(of)), of] -= 1
    back = error @ w.class_out.T
    grads[2], grads[3] = seen.T @ error, error.sum(0)
    cuts = np.searchsorted(of, np.arange(len(shape.widths) + 1))
    for c in np.flatnonzero((shape.widths > 1) & (cuts[1:] > cuts[:-1])):
        rows, part = slice(cuts[c], cuts[c + 1]), slice(shape.starts[c], shape.starts[c] + shape.widths[c])
        error = shares(seen[rows] @ w.word_out[:, part] + w.word_bias[part])
        error[np.arange(len(error)), shape.places[symbols[rows]]] -= 1
        back[rows] += error @ w.word_out[:, part].T
        grads[4][:, part], grads[5][part] = seen[rows].T @ error, error.sum(0)
    given_back = np.empty_like(back)
    given_back[order] = back
    back = given_back
    back = (back * weight.T.reshape(-1, 1)).reshape(len(states), *state.shape)
    carried, entered = np.zeros_like(state), np.zeros((len(states), len(state), 3 * n), state.dtype)
    for t in range(len(states) - 1, -1, -1):
        before, update, reset, candidate, own = kept[t]
        d = back[t] + carried
        d_candidate = d * (1 - update) * (1 - candidate * candidate)
        d_update = d * (before - candidate) * update * (1 - update)
        d_reset = d_candidate * own * reset * (1 - reset)
        entered[t] = np.concatenate([d_update, d_reset, d_candidate], 1)
        inner = np.concatenate([d_update, d_reset, d_candidate * reset], 1)
        grads[1] += before.T @ inner
        carried = (d * update + inner @ w.recurrent.T) * ~fresh[:, t, None]
    order = np.argsort(given.T.ravel(), kind="stable")
    used, first = np.unique(given.T.ravel()[order], return_index=True)
    grads[0][used] = np.add.reduceat(entered.reshape(-1, 3 * n)[order], first, axis=0)
    for k, g in enumerate(grads):
        g = np.clip(g, -5, 5)
        trainer.squares[k] += g * g
        w.each()[k] -= trainer.rate * g / np.sqrt(trainer.squares[k])
    return state


def test_training_takes_less_time_than_row_by_row(monkeypatch):
    """The same weights in double precision, in clearly less time than lanes as rows take."""
    draw = np.random.default_rng(5)
    share = 1 / np.arange(2, 1570.0)
    symbols = draw.choice(1568, 512 * 16 * 10, p=share / share.sum())
    fresh = draw.random(len(symbols)) < 0.01
    counts = np.bincount(symbols, minlength=1568).astype(float)
    shape = gru.make_shape(counts, 32)

    def by_lanes(self, *window):
        state = window[4]
        rows = len(state) == self.lanes
        after = rows_window(self, *window[:4], state if rows else state.T)
        return after if rows else after.T

    def trained(kind, by_rows):
        w = gru.Weights(*[a.astype(kind) for a in gru.first_weights(counts, shape).each()])
        trainer = gru.Trainer(w, shape, lanes=512)
        with monkeypatch.context() as changed:
            if by_rows:
                changed.setattr(gru.Trainer, "_window", by_lanes)
            before = time.thread_time()
            trainer.run(symbols, fresh)
            return time.thread_time() - before, w

    plain, fast = (trained(np.float64, by_rows)[1] for by_rows in (True, False))
    for a, b in zip(plain.each(), fast.each()):
        assert a == pytest.approx(b, abs=1e-5)
    times = [[trained(np.float32, by_rows)[0] for by_rows in (True, False)] for _ in range(5)]
    plain, fast = (min(t) for t in zip(*times))
    print("seconds by rows", plain, "as trained", fast)
    assert fast < 0.87 * plain
