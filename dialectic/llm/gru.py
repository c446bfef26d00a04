"""A gated recurrent language model in numpy with a class-factored softmax."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from types import EllipsisType

import numpy as np

from dialectic.llm.frames import ragged

#: Width of embeddings and state; most ids of a model (with OUTSIDE and END).
WIDTH, VOCAB = 16, 1 << 16
#: The first ids: words outside the vocabulary, and the end of a text.
OUTSIDE, END = 0, 1
#: Bias of places without a word; rows of a softmax that are held at a time.
NO_WORD, SOFTMAX_ROWS = -1e9, 1 << 14
#: Nodes of a softmax with at most so many rows share a product with all others
#: that have as many; one with more has a product of its own.
FEW = 32
#: Words of a training window; windows of the first steps and of the largest;
#: steps after which their number doubles.
WINDOW, BATCH, MOST, GROW = 64, 16, 512, 32
#: Step size, and the squared gradient that a weight starts with.
STEP, FIRST_SEEN, SEED = 0.2, 1.0, 5
#: Steps whose states are kept before their outputs are scored.
CARRY = 256
#: The levels of the softmax: a word is a branch of its class, a class one of
#: its group, and the groups are branches of the root.
LEVELS = ("group", "class", "word")

Params = dict[str, np.ndarray]


def fan(vocab: int) -> int:
    """Words of a class and classes of a group: the cube root of the ids."""
    k = max(1, round(vocab ** (1 / 3)))
    return k if k ** 3 >= vocab else k + 1


def shapes(vocab: int) -> dict[str, tuple[int, ...]]:
    """Weights of a model of ``vocab`` ids: about a cube root of them groups, as
    many classes in each and as many words in a class (the last places may be
    without a word). An id's output costs three small softmaxes; a branch's bias
    stands behind its weights."""
    k = fan(vocab)
    groups = -(-vocab // (k * k))
    out = {"embed": (groups * k * k, WIDTH), "input": (WIDTH, 3 * WIDTH), "state": (WIDTH, 3 * WIDTH), "gate": (3 * WIDTH,)}
    for level, nodes, branches in zip(LEVELS, (1, groups, groups * k), (groups, k, k)):
        out[level] = nodes, branches, WIDTH + 1
    return out


SHAPES = shapes(VOCAB)


def flatten(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflatten(v: np.ndarray, vocab: int) -> Params:
    out, at = {}, 0
    for k, shape in shapes(vocab).items():
        n = int(np.prod(shape))
        out[k] = np.asarray(v[at:at + n], np.float64).reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray) -> Params:
    """Small random weights; output biases at the words' frequencies. A class
    holds consecutive ids; places without a word have no probability."""
    rng = np.random.default_rng(SEED)
    p = {k: np.zeros(s) if k == "gate" else rng.normal(0, 0.1, s) for k, s in shapes(len(counts)).items()}
    seen = np.zeros(len(p["embed"]))
    seen[:len(counts)] = counts + 0.5
    for level in LEVELS[::-1]:
        seen = seen.reshape(p[level].shape[:2])
        total = seen.sum(axis=1)
        p[level][..., -1] = np.where(seen > 0, np.log(np.maximum(seen, 0.5) / np.maximum(total, 0.5)[:, None]), NO_WORD)
        seen = total
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _branches(p: Params, ids: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(level, node, branch taken there) of each id, from the root down."""
    k = p["word"].shape[1]
    classes, groups = ids // k, ids // (k * k)
    return [("group", np.zeros_like(ids), groups), ("class", groups, classes % k), ("word", classes, ids % k)]


def _with_one(states: np.ndarray) -> np.ndarray:
    return np.concatenate((states, np.ones((len(states), 1), states.dtype)), axis=1)


def _by_id(ids: np.ndarray) -> np.ndarray:
    """The order of ``ids`` (stable); ids of two bytes are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")


def _softmax(w: np.ndarray, states: np.ndarray, node: np.ndarray, branch: np.ndarray, slope: bool = False):
    """The log-softmax at ``branch`` of each state (and a one) at its ``node``
    (ascending). With ``slope``: the nodes met, the gradients of their weights
    and of the states, all of the negative logarithms' sum."""
    n, wide, deep = len(node), *w.shape[1:]
    first = np.flatnonzero(np.diff(node, prepend=-1))
    size = np.diff(first, append=n)
    # Nodes of many rows first, then the others by their number of rows.
    rank = np.where(size > FEW, 0, size)
    by, back = np.argsort(rank, kind="stable"), None
    met, size, many = node[first[by]], size[by], int((rank == 0).sum())
    if many < len(met):
        order = ragged(first[by], size)
        states, branch = states.take(order, axis=0), branch.take(order)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
    begin = (np.cumsum(size) - size).tolist()
    alone = list(zip(met[:many].tolist(), begin, [*begin[1:], n]))
    together, at = [], many  # (first and last node, row range, rows of a node, weights, transposed)
    for m, count in enumerate(np.bincount(size[many:]).tolist()):
        if count:
            own = w.take(met[at:at + count], axis=0)
            together.append((at, at + count, begin[at], begin[at] + count * m, m, own,
                             np.ascontiguousarray(own.transpose(0, 2, 1))))
            at += count
    x, one = np.empty((n, wide), states.dtype), np.ones(wide, states.dtype)
    taken = np.arange(0, n * wide, wide) + branch

    def logits() -> None:
        for c, i, j in alone:
            np.dot(states[i:j], w[c].T, out=x[i:j])
        for _, _, i, j, m, _, turned in together:
            np.matmul(states[i:j].reshape(-1, m, deep), turned, out=x[i:j].reshape(-1, m, wide))

    logits()
    own = x.ravel().take(taken)
    with np.errstate(over="ignore"):
        total = np.dot(np.exp(x, out=x), one)
    if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30):  # out of the range of exp: about each row's maximum
        logits()
        top = x.max(axis=1)
        x -= top[:, None]
        own -= top
        total = np.dot(np.exp(x, out=x), one)
    own -= np.log(total)
    out = own if back is None else own.take(back)
    if not slope:
        return out
    x *= np.reciprocal(total)[:, None]
    x.ravel()[taken] -= 1
    dw, ds = np.empty((len(met), wide, deep), states.dtype), np.empty_like(states)
    for k, (c, i, j) in enumerate(alone):
        d = x[i:j]
        np.dot(d.T, states[i:j], out=dw[k])
        np.dot(d, w[c], out=ds[i:j])
    for k, l, i, j, m, own, _ in together:
        d, s = x[i:j].reshape(-1, m, wide), states[i:j].reshape(-1, m, deep)
        (np.multiply if m == 1 else np.matmul)(d.transpose(0, 2, 1), s, out=dw[k:l])
        np.matmul(d, own, out=ds[i:j].reshape(-1, m, deep))
    return out, met, dw, ds if back is None else ds.take(back, axis=0)


def log_probabilities(p: Params, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log P(group) + log P(class | group) + log P(word | class) of each
    id given its state."""
    order = _by_id(ids)
    out = np.empty(len(ids), states.dtype)
    for a in range(0, len(ids), SOFTMAX_ROWS):
        at = order[a:a + SOFTMAX_ROWS]
        own = _with_one(states.take(at, axis=0))
        out[at] = sum(_softmax(p[level], own, node, branch)
                      for level, node, branch in _branches(p, ids[at]))
    return out


def _pass(p: Params, ids: np.ndarray, mask: np.ndarray, h: np.ndarray, last: np.ndarray):
    """Summed negative log-likelihood of windows [n, t] after the states ``h``
    and ids ``last``; gradients of the recurrent weights; (rows, gradients) of the
    embeddings and of the softmax weights met; the states behind the
    windows. Nothing flows back into ``h``."""
    n, steps, w = len(ids), ids.shape[1], WIDTH
    before = np.concatenate((last[:, None], ids[:, :-1]), axis=1).T.ravel()
    x = p["embed"].take(before, axis=0)
    # One column per text, so that every gate of a step is one stretch of memory.
    given = p["input"].T @ x.reshape(steps, n, w).transpose(0, 2, 1)
    given += p["gate"][:, None]
    u_zr, u_c = np.ascontiguousarray(p["state"][:, :2 * w]), np.ascontiguousarray(p["state"][:, 2 * w:])
    kept, states, resets = [], np.empty((steps, w, n), x.dtype), np.empty((steps, w, n), x.dtype)
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        zr = _sigmoid(given[t, :2 * w] + u_zr.T @ h)
        z, r = zr[:w], zr[w:]
        rh = np.multiply(r, h, out=resets[t])
        c = u_c.T @ rh
        c += given[t, 2 * w:]
        np.tanh(c, out=c)
        kept.append((h, z, r, c, rh))
        h = h + z * (c - h)
        states[t] = h
    on = np.flatnonzero(mask.T.ravel())
    on = on[_by_id(ids.T.ravel()[on])]
    flat, want = _with_one(states.transpose(0, 2, 1).reshape(-1, w).take(on, axis=0)), ids.T.ravel().take(on)
    total, out, met_rows = 0.0, np.zeros_like(flat), {}
    for level, node, branch in _branches(p, want):
        ll, met, dw, ds = _softmax(p[level], flat, node, branch, slope=True)
        total -= ll.sum(dtype=np.float64)
        out += ds
        met_rows[level] = met, dw
    dh_out = np.zeros((steps * n, w), x.dtype)
    dh_out[on] = out[:, :w]
    dh_out = np.ascontiguousarray(dh_out.reshape(steps, n, w).transpose(0, 2, 1))
    dh, dg = np.zeros((w, n), x.dtype), np.empty((steps, 3 * w, n), x.dtype)
    for t in range(steps - 1, -1, -1):
        was, z, r, c, rh = kept[t]
        dh += dh_out[t]
        dz, dr, dc = dg[t, :w], dg[t, w:2 * w], dg[t, 2 * w:]
        np.multiply(dh, z, out=dc)
        np.multiply(dc, c - was, out=dz)
        dz *= 1 - z
        dc *= 1 - c * c
        drh = u_c @ dc
        np.multiply(drh, rh, out=dr)
        dr *= 1 - r
        dh *= 1 - z
        drh *= r
        dh += drh
        dh += u_zr @ dg[t, :2 * w]
    was = np.concatenate((kept[0][0][None], states[:-1]))
    d_zr = (was @ dg[:, :2 * w].transpose(0, 2, 1)).sum(axis=0)
    d_c = (resets @ dg[:, 2 * w:].transpose(0, 2, 1)).sum(axis=0)
    grad = {"state": np.concatenate((d_zr, d_c), axis=1), "gate": dg.sum(axis=(0, 2)),
            "input": np.ascontiguousarray((dg @ x.reshape(steps, n, w)).sum(axis=0).T)}
    order = _by_id(before)
    first = np.flatnonzero(np.diff(before[order], prepend=-1))
    dx = (dg.transpose(0, 2, 1) @ p["input"].T).reshape(-1, w)
    met_rows["embed"] = before[order[first]], np.add.reduceat(dx.take(order, axis=0), first)
    return total, grad, met_rows, h.T


def loss_and_gradient(p: Params, ids: np.ndarray, mask: np.ndarray) -> tuple[float, Params]:
    """Summed negative log-likelihood of windows [n, t] (words before the first:
    END, state zero) and its gradient by back-propagation through the window."""
    n, dtype = len(ids), p["embed"].dtype
    total, grad, met_rows, _ = _pass(p, ids, mask, np.zeros((n, WIDTH), dtype), np.full(n, END))
    for k, (at, g) in met_rows.items():
        grad[k] = np.zeros_like(p[k])
        grad[k][at] = g
    return total, grad


def train(p: Params, texts: Iterable[np.ndarray]) -> tuple[Params, int]:
    """One pass over whole texts (ids, the end last), a row's steps scaled by its
    gradients so far; the new weights and the number of ids.

    Texts run side by side: a step takes the next window of each, with the state
    that its last window left (zero at a text's start), and a text that ends
    makes room for the next. Their number doubles every GROW steps up to MOST.
    """
    p = {k: v.astype(np.float32) for k, v in p.items()}
    seen = {k: np.full(v.shape[:-1], FIRST_SEEN, np.float32) for k, v in p.items()}

    def move(k: str, at: np.ndarray | EllipsisType, g: np.ndarray) -> None:
        now = seen[k][at] + np.einsum("...w,...w->...", g, g) / g.shape[-1]
        seen[k][at] = now
        g *= (STEP / np.sqrt(now))[..., None]
        p[k][at] -= g

    feed = iter(texts)
    open_, h, last, step, n_ids = [], np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), 0, 0
    while True:
        room = min(MOST, BATCH << min(step // GROW, 30)) - len(open_)
        new = [(x, 0) for x in itertools.islice(feed, max(0, room)) if len(x)]
        open_ += new
        if not open_:
            return p, n_ids
        h = np.concatenate((h, np.zeros((len(new), WIDTH), np.float32)))
        last = np.concatenate((last, np.full(len(new), END)))
        parts = [x[a:a + WINDOW] for x, a in open_]
        lengths = np.array([len(x) for x in parts])
        mask = np.arange(int(lengths.max())) < lengths[:, None]
        ids = np.full(mask.shape, END)
        ids[mask] = np.concatenate(parts)
        _, grad, met_rows, h = _pass(p, ids, mask, h, last)
        for k, g in grad.items():
            move(k, ..., g)
        for k, (at, g) in met_rows.items():
            move(k, at, g)
        step, n_ids = step + 1, n_ids + int(lengths.sum())
        goes_on = np.array([a + WINDOW < len(x) for x, a in open_])
        h, last = h[goes_on], ids[:, -1][goes_on]
        open_ = [(x, a + WINDOW) for (x, a), g in zip(open_, goes_on) if g]


def score(p: Params, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each whole text; ``ids`` laid end to end. All
    texts run side by side, longest first, and the state is carried from one
    window to the next up to each text's end."""
    q = {k: v.astype(np.float32) for k, v in p.items()}
    w = WIDTH
    table = q["embed"] @ q["input"] + q["gate"]
    u_zr, u_c = np.ascontiguousarray(q["state"][:, :2 * w]), np.ascontiguousarray(q["state"][:, 2 * w:])
    order = np.argsort(-lengths, kind="stable")
    first, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    total = np.zeros(len(lengths))
    n = len(size)
    h, last = np.zeros((n, w), np.float32), np.full(n, END)
    for begin in range(0, int(size[0]) if n else 0, CARRY):
        states, want, whose = [], [], []
        longer = np.searchsorted(-size, -np.arange(begin, begin + CARRY)).tolist()  # number of texts longer than t
        for t, n in enumerate(longer, begin):
            if not n:
                break
            h = h[:n]
            g = table.take(last[:n], axis=0)
            zr = _sigmoid(g[:, :2 * w] + h @ u_zr)
            c = np.tanh(g[:, 2 * w:] + (zr[:, w:] * h) @ u_c)
            h = h + zr[:, :w] * (c - h)
            last = ids[first[:n] + t]
            states.append(h)
            want.append(last)
            whose.append(n)
        ll = log_probabilities(q, np.concatenate(states), np.concatenate(want))
        at = 0
        for n in whose:
            total[:n] += ll[at:at + n]
            at += n
    out = np.empty(len(lengths))
    out[order] = total
    return out
