"""A small causal self-attention model over subword ids, in numpy.

An id's input is an embedding of its slot (frequent ids have their own, others share
some) plus one of its place in the window; one masked attention head adds what came
before.  The result shifts the corpus's own log probabilities of the next class given
the slot before, and a class spreads its probability over its slots, and a slot over
its ids, by smoothed corpus counts (those of a class's slots given the slot before).
So the probabilities of all ids sum to one, and an untrained network is the corpus's
smoothed pair model.

Inputs carry a last column of ones, which gives the projections a bias; the projections'
last column, one of ones, is not computed.

Defined cases: a document without ids has no window; with counts of 0 alone all slots
of a class are equally likely; exponents beyond a float32 are bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: How ids are kept in a table; unsigned 16 bits are enough for vocabularies below 65,536.
ID = np.dtype("<u2")
WINDOW = 32
#: Windows overlap by the difference; each id is scored in one window, after the first by 8 ids of context at least.
STRIDE = 24
WIDTH = 8
CLASSES = 32
#: Most frequent slots that are classes of their own.
SINGLE_CLASSES = 12
SLOTS, OWN_SLOTS = 2048, 1536
START = SLOTS - 1
#: Counts that a smoothed distribution lends from the wider one it falls back to.
LENT = 20.0
_W = WIDTH + 1
#: Numbers of a place's query, key and value.
_QKV = 3 * WIDTH
_KEEP = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
SHAPES = {"emb": (SLOTS, _W), "pos": (WINDOW, _W), "qkv": (_W, 3 * WIDTH + 1), "out": (WIDTH, WIDTH), "cls": (WIDTH, CLASSES)}


@dataclass
class Vocabulary:
    """What corpus counts decide: each id's slot and share of it, each slot's class, and log probabilities given the slot before."""

    slot: np.ndarray
    cls: np.ndarray
    log_share: np.ndarray
    #: (slot before, class)
    log_class: np.ndarray
    #: (slot before, slot): of the slot within its class
    log_slot: np.ndarray


def slots_of(counts: np.ndarray) -> np.ndarray:
    """Slot of each id: the most frequent ids have their own, the others share the rest."""
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return np.where(rank < OWN_SLOTS, rank, OWN_SLOTS + rank % (START - OWN_SLOTS)).astype(np.int32)


def classes_of(pairs: np.ndarray, seed: int = 7) -> np.ndarray:
    """Class of each slot, from (slot before, slot) counts.

    The most frequent slots are classes of their own; the others are grouped by the
    slots that stand before them (k-means on square roots of those shares, projected
    to their main directions), so that what comes before tells the class.
    """
    rng = np.random.default_rng(seed)
    x = np.sqrt(pairs / np.maximum(pairs.sum(axis=0, keepdims=True), 1)).T.astype(np.float32)
    basis = rng.normal(size=(x.shape[1], 40)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    y = x @ basis
    rest = np.arange(SINGLE_CLASSES, SLOTS)
    weight = np.sqrt(pairs.sum(axis=0)[rest] + 1)
    k = CLASSES - SINGLE_CLASSES
    centre = y[rest[:k]].copy()
    for _ in range(25):
        near = ((y[rest] ** 2).sum(axis=1)[:, None] - 2 * y[rest] @ centre.T + (centre**2).sum(axis=1)).argmin(axis=1)
        for c in range(k):
            own = near == c
            if own.any():
                centre[c] = np.average(y[rest][own], axis=0, weights=weight[own])
    out = np.arange(SLOTS)
    out[rest] = SINGLE_CLASSES + near
    return out.astype(np.int32)


def vocabulary(slot: np.ndarray, counts: np.ndarray, pairs: np.ndarray, smooth: float = 0.5) -> Vocabulary:
    """Classes and log probabilities from each id's slot, the corpus counts of ids and those of neighbouring slots."""
    cls = classes_of(pairs)
    weight = counts + smooth
    in_slot = np.bincount(slot, weight, minlength=SLOTS)
    # a slot without ids (the start) keeps a share of nothing
    alone = np.maximum(np.where(np.bincount(slot, minlength=SLOTS) > 0, in_slot, 0), 1e-30)
    mass = np.bincount(cls, alone, minlength=CLASSES)
    member = np.zeros((SLOTS, CLASSES), dtype=np.float32)
    member[np.arange(SLOTS), cls] = 1
    by_class = pairs @ member
    log_class = np.log((by_class + LENT * mass / mass.sum()) / (by_class.sum(axis=1, keepdims=True) + LENT) + 1e-30)
    log_slot = np.log((pairs + (LENT * alone / mass[cls]).astype(np.float32)) / (by_class[:, cls] + np.float32(LENT)) + np.float32(1e-30))
    return Vocabulary(slot, cls, np.log(weight / in_slot[slot]).astype(np.float32), log_class.astype(np.float32), log_slot.astype(np.float32))


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.normal(size=s) * (0.3 if k in ("emb", "pos") else WIDTH**-0.5)).astype(np.float32) for k, s in SHAPES.items()}
    p["qkv"][:, :WIDTH] *= np.float32(WIDTH**-0.5)
    p["cls"][:] = 0
    return _fixed(p)


def _fixed(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sets what isn't learned: the column of ones."""
    p["emb"][:, WIDTH], p["pos"][:, WIDTH] = 1, 0
    p["qkv"][:, -1] = 0
    p["qkv"][WIDTH, -1] = 1
    return p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflatten(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Work(dict):
    """Arrays that are used again from call to call, so that no call asks the system for memory."""

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self or len(self[name]) < size:
            self[name] = np.empty(size, dtype=np.float32)
        return self[name][:size].reshape(shape)


def _attend(q, k, v, keep, work, clamp):
    """Attention shares (window, place, place before) before they are divided, what they are divided by, and the mixtures of values."""
    b, places = q.shape[:2]
    a = np.matmul(q, k.transpose(0, 2, 1), out=work("a", b, places, WINDOW))
    if clamp:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a *= keep
    # once a number of each row, so that quotients run along memory; its reciprocal may be too large for a float32
    over = np.repeat(a.reshape(-1, WINDOW) @ _PLACES, WIDTH).reshape(b, places, WIDTH)
    mixed = np.matmul(a, v, out=work("mixed", b, places, WIDTH))
    mixed /= over
    return a, over, mixed


def _forward(p, slots, work, clamp=False):
    b = len(slots)
    x = np.take(p["emb"], slots, axis=0, out=work("x", b, WINDOW, _W), mode="clip")
    x += p["pos"]
    y = np.matmul(x.reshape(-1, _W), p["qkv"][:, :_QKV], out=work("y", b * WINDOW, _QKV)).reshape(b, WINDOW, _QKV)
    q, k, v = y[:, :, :WIDTH], y[:, :, WIDTH : 2 * WIDTH], y[:, :, 2 * WIDTH :]
    a, over, mixed = _attend(q, k, v, _KEEP, work, clamp)
    h = np.matmul(mixed.reshape(-1, WIDTH), p["out"], out=work("h", b * WINDOW, WIDTH)).reshape(b, WINDOW, WIDTH)
    h += x[:, :, :WIDTH]
    return x, q, k, v, a, over, mixed, h


_ONES, _PLACES, _ROW = (np.ones(n, dtype=np.float32) for n in (CLASSES, WINDOW, WIDTH))


def _logits(h, p, vocab, before, work, clamp=False):
    z = np.matmul(h, p["cls"], out=work("z", len(h), CLASSES))
    z += np.take(vocab.log_class, before, axis=0, out=work("prior", len(h), CLASSES), mode="clip")
    return np.minimum(z, 60, out=z) if clamp else z


@dataclass
class Folded:
    """Parameters that no longer change, multiplied as far as no attention comes between."""

    #: queries, keys and values of each slot, and what a place adds to them
    slot: np.ndarray
    place: np.ndarray
    #: from what attention adds to a place to its classes
    out: np.ndarray
    #: (slot, class): prior and what the slot itself adds; (place, class): what the place adds
    prior: np.ndarray
    cls: np.ndarray


def folded(p: dict[str, np.ndarray], vocab: Vocabulary) -> Folded:
    emb, pos = p["emb"][:, :WIDTH], p["pos"][:, :WIDTH]
    return Folded(p["emb"] @ p["qkv"][:, :_QKV], p["pos"] @ p["qkv"][:, :_QKV], p["out"] @ p["cls"], vocab.log_class + emb @ p["cls"], pos @ p["cls"])


def _class_logits(f: Folded, slots, at, work, clamp, skip):
    b, places = len(slots), WINDOW - skip
    y = np.take(f.slot, slots, axis=0, out=work("y", b, WINDOW, _QKV), mode="clip")
    y += f.place
    mixed = _attend(y[:, skip:, :WIDTH], y[:, :, WIDTH : 2 * WIDTH], y[:, :, 2 * WIDTH :], _KEEP[skip:], work, clamp)[-1].reshape(-1, WIDTH)
    before = slots[:, skip:].ravel()
    if at is not None:
        mixed, before = mixed.take(at, axis=0), before.take(at)
    z = np.matmul(mixed, f.out, out=work("z", len(before), CLASSES))
    z += np.take(f.prior, before, axis=0, out=work("prior", len(before), CLASSES), mode="clip")
    if at is None:
        of_place = z.reshape(b, places, CLASSES)
        of_place += f.cls[skip:]
    else:
        z += f.cls[skip:].take(at % places, axis=0)
    return np.minimum(z, 60, out=z) if clamp else z


def log_class(p: dict[str, np.ndarray] | Folded, vocab: Vocabulary, slots: np.ndarray, at: np.ndarray, target: np.ndarray, work: Work | None = None, skip: int = 0) -> np.ndarray:
    """Log probability of each target class at the given flat places, in order, of (windows, WINDOW - ``skip``) slots, the first ``skip`` of each left out."""
    work = Work() if work is None else work
    f = p if isinstance(p, Folded) else folded(p, vocab)
    some = at if len(at) < len(slots) * (WINDOW - skip) else None
    for clamp in (False, True):
        with np.errstate(over="ignore", invalid="ignore"):
            z = _class_logits(f, slots, some, work, clamp, skip)
            picked = z.ravel().take(np.arange(0, z.size, CLASSES) + target)
            total = np.exp(z, out=z) @ _ONES
        # exponents too large for a float32 are the exception: only then are they bounded
        if np.isfinite(total).all():
            break
    return picked - np.log(total)


def gradients(p: dict[str, np.ndarray], vocab: Vocabulary, slots: np.ndarray, target: np.ndarray, valid: np.ndarray, work: Work | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over valid places and its gradient."""
    work = Work() if work is None else work
    flat, ok = slots.ravel().astype(np.intp), valid.ravel()
    own = np.arange(0, len(flat) * CLASSES, CLASSES) + target.ravel()
    for clamp in (False, True):
        with np.errstate(over="ignore", invalid="ignore"):
            x, q, k, v, a, over, mixed, h = _forward(p, slots, work, clamp)
            h = h.reshape(-1, WIDTH)
            z = _logits(h, p, vocab, flat, work, clamp)
            picked = z.ravel().take(own)
            total = np.exp(z, out=z) @ _ONES
        if np.isfinite(total).all():
            break
    n = max(1, int(ok.sum()))
    loss = float((np.log(total) - picked)[ok].sum()) / n
    share = ok.astype(np.float32) / np.float32(n)
    z *= (share / total)[:, None]
    z.ravel()[own] = z.ravel().take(own) - share
    g = {"cls": (z.T @ h).T}
    # beside what comes back to queries, keys and values lies what comes back to the places themselves
    dy = work("dy", *slots.shape, _QKV + WIDTH)
    flat_dy = dy.reshape(-1, _QKV + WIDTH)
    dh = np.matmul(z, p["cls"].T, out=flat_dy[:, _QKV:])
    g["out"] = mixed.reshape(-1, WIDTH).T @ dh
    dvalue = np.matmul(dh, p["out"].T, out=work("dvalue", len(flat), WIDTH)).reshape(mixed.shape)
    dvalue /= over
    # of what the shares are divided by
    less = np.multiply(dvalue, mixed, out=mixed).reshape(-1, WIDTH) @ _ROW
    ds = np.matmul(dvalue, v.transpose(0, 2, 1), out=work("prior", *a.shape))
    ds -= less.reshape(*slots.shape, 1)
    ds *= a
    np.matmul(ds, k, out=dy[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dy[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dvalue, out=dy[:, :, 2 * WIDTH : _QKV])
    g["qkv"] = np.zeros(SHAPES["qkv"], dtype=np.float32)
    g["qkv"][:, :_QKV] = (flat_dy[:, :_QKV].T @ x.reshape(-1, _W)).T
    back = np.concatenate([p["qkv"][:WIDTH, :_QKV].T, np.eye(WIDTH, dtype=np.float32)])
    dx = np.matmul(flat_dy, back, out=work("dx", len(flat), WIDTH))
    g["pos"], g["emb"] = np.zeros(SHAPES["pos"], dtype=np.float32), np.zeros(SHAPES["emb"], dtype=np.float32)
    g["pos"][:, :WIDTH] = dx.reshape(*slots.shape, WIDTH).sum(axis=0)
    for i in range(WIDTH):
        g["emb"][:, i] = np.bincount(flat, dx[:, i], minlength=SLOTS)
    return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate, spread = np.float32(self.rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.99**self.t))
        for k in p:
            m, v, d = self.m[k], self.v[k], g[k]
            m += np.float32(0.1) * (d - m)
            d *= d
            d -= v
            d *= np.float32(0.01)
            v += d
            np.multiply(v, spread, out=d)
            np.sqrt(d, out=d)
            d += np.float32(1e-6)
            np.divide(m, d, out=d)
            d *= rate
            p[k] -= d


@dataclass
class Windows:
    """Windows over documents whose ids (with an end id) lie in a row."""

    doc: np.ndarray
    #: (windows, WINDOW) slots of what stands before each target
    slots: np.ndarray
    #: (windows, WINDOW) target ids
    target: np.ndarray
    #: places that exist, and of those the ones this window scores
    valid: np.ndarray
    scored: np.ndarray
    #: windows after their document's first
    later: np.ndarray


def windows(ids: np.ndarray, cuts: np.ndarray, vocab: Vocabulary, stride: int = STRIDE) -> Windows:
    size = np.diff(cuts).astype(np.int32)
    n = np.where(size > 0, 1 + -(-np.maximum(size - WINDOW, 0) // stride), 0)
    doc = np.repeat(np.arange(len(size)), n)
    turn = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    column = np.arange(WINDOW, dtype=np.int32)
    valid = column < (size[doc] - turn * stride)[:, None]
    at = np.minimum((cuts[doc].astype(np.int32) + turn * stride)[:, None] + column, max(0, len(ids) - 1))
    target = ids.take(at)
    before = vocab.slot.take(ids).take(np.maximum(at - 1, 0))
    before[turn == 0, 0] = START
    scored = valid & ((turn == 0)[:, None] | (column >= WINDOW - stride))
    return Windows(doc, before, target, valid, scored, turn > 0)
