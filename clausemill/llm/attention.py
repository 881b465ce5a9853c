"""A small causal self-attention model in numpy, forward and backward.

Ids are classes, GROUPS groups of MEMBERS each, and two more: the start and the pad. Of an id there are a query, a key, a
value and a residual vector; a query meets the keys of its own and earlier places in its window, with a bias by distance.
What comes out predicts the next id's group, and within the group the id, by two softmaxes.

For scoring, windows of WIDTH ids overlap and only the last STEP places of each predict, so every id is scored once with
at least WIDTH - STEP ids before it. For training, windows lie end to end and all their places predict.
"""

from __future__ import annotations

import ctypes

import numpy as np

WIDTH, STEP, DIM, GROUPS, MEMBERS = 32, 16, 16, 32, 32
CLASSES = GROUPS * MEMBERS
START, PAD = CLASSES, CLASSES + 1
SCALE = np.float32(DIM**-0.5)

SHAPES = {"Q": (CLASSES + 2, DIM), "K": (CLASSES + 2, DIM), "V": (CLASSES + 2, DIM), "R": (CLASSES + 2, DIM), "B": (WIDTH,), "U1": (DIM + 1, GROUPS), "U2": (GROUPS, DIM + 1, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters by name, as views of one flat array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(mass: np.ndarray, seed: int = 1) -> np.ndarray:
    """Parameters that predict classes by their mass, with small random vectors."""
    draw = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    for name in "QKVR":
        p[name][:] = 0.3 * draw.standard_normal(p[name].shape)
    for name in ("U1", "U2"):
        p[name][..., :DIM, :] = 0.1 * draw.standard_normal(p[name][..., :DIM, :].shape)
    by_group = mass.reshape(GROUPS, MEMBERS)
    p["U1"][DIM] = np.log(by_group.sum(axis=1) / mass.sum())
    p["U2"][:, DIM] = np.log(by_group / by_group.sum(axis=1, keepdims=True))
    return flat


def keep_memory() -> None:
    """Has the C library keep what numpy frees, up to a limit: given back and taken anew, it costs as much as the arithmetic."""
    if tune := getattr(ctypes.CDLL(None), "mallopt", None):
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            tune(option, 16 << 20)


class Windows:
    """The windows of several texts' ids: of each text pads, the start, its ids, and pads up to whole steps."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, step: int):
        before = WIDTH - step
        self.step, count = step, -(-sizes // step)
        room = count * step + before + 1
        begins = np.cumsum(room) - room
        self.flat = np.full(int(room.sum()), PAD, np.intp)
        self.flat[np.arange(len(ids)) + np.repeat(begins + before + 1 - (np.cumsum(sizes) - sizes), sizes)] = ids
        self.flat[begins + before] = START
        self.text = np.repeat(np.arange(len(sizes)), count)
        first = (np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count)) * step
        self.at, self.left = begins[self.text] + first, sizes[self.text] - first

    def __len__(self) -> int:
        return len(self.at)

    def take(self, pick: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (windows, WIDTH), targets and whether they exist (windows, step); an input is the id before its place."""
        whole = self.flat[self.at[pick, None] + np.arange(WIDTH + 1)]
        exists = np.arange(self.step) < self.left[pick, None]
        return whole[:, :WIDTH], np.where(exists, whole[:, WIDTH + 1 - self.step :], 0), exists


def tables(p: dict[str, np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled queries; values with a one behind them; (step, WIDTH) biases by distance, which let nothing later through."""
    distance = np.arange(WIDTH - step, WIDTH)[:, None] - np.arange(WIDTH)[None, :]
    biases = np.where(distance >= 0, p["B"][np.maximum(distance, 0)], np.float32(-1e9))
    return p["Q"] * SCALE, np.concatenate([p["V"], np.ones((CLASSES + 2, 1), p["V"].dtype)], axis=1), biases


def attend(p: dict[str, np.ndarray], x: np.ndarray, step: int, safe: bool, known: tuple | None = None) -> tuple:
    """Queries, keys, values with a one behind them, unnormalised weights, their inverse sums, and what comes out (with a one).

    Exponentials are taken as they are; safe subtracts the maxima before.
    """
    late = x[:, WIDTH - step :]
    queries, values, biases = known or tables(p, step)
    q, k, v = queries.take(late, axis=0), p["K"].take(x, axis=0), values.take(x, axis=0)
    s = q @ k.transpose(0, 2, 1)
    s += biases
    if safe:
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    o = s @ v
    inverse = 1 / o[:, :, DIM:]
    o = o[:, :, :DIM] * inverse
    h = np.ones((late.size, DIM + 1), s.dtype)
    np.add(o.reshape(-1, DIM), p["R"].take(late.ravel(), axis=0), out=h[:, :DIM])
    return q, k, v, s, inverse, o, h


def level(z: np.ndarray, at: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Negative log probabilities of the entries `at` of the flattened rows z, and the sums of the rows' exponentials, which
    take the rows' place."""
    if safe:
        z -= z.max(axis=1, keepdims=True)
    own = z.ravel().take(at)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return np.log(total) - own, total


def within(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> tuple:
    """Of the second softmax, in order of the targets' groups: the order, the groups (group, from, to), the rows of h, their
    logits, and the targets' entries in these."""
    order = np.argsort((y // MEMBERS).astype(np.uint8), kind="stable")
    edges = np.cumsum(np.bincount(y // MEMBERS, minlength=GROUPS)).tolist()
    groups = [(g, a, b) for g, (a, b) in enumerate(zip([0, *edges], edges)) if a < b]
    hs, z = h.take(order, axis=0), np.empty((y.size, MEMBERS), h.dtype)
    for g, a, b in groups:
        np.matmul(hs[a:b], p["U2"][g], out=z[a:b])
    return order, groups, hs, z, np.arange(y.size) * MEMBERS + (y % MEMBERS)[order]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, exists: np.ndarray, grads: np.ndarray, safe: bool = False) -> float:
    """Mean loss in nats over the existing targets; its gradients go to the flat array."""
    n, step = y.shape
    d, flat = views(grads), y.ravel()
    q, k, v, s, inverse, o, h = attend(p, x, step, safe)
    weight = (exists.ravel() / max(1, exists.sum())).astype(s.dtype)
    z, at = h @ p["U1"], np.arange(flat.size) * GROUPS + flat // MEMBERS
    own, total = level(z, at, safe)
    loss = own @ weight
    z *= (weight / total)[:, None]
    z.ravel()[at] -= weight
    np.matmul(h.T, z, out=d["U1"])
    do = z @ p["U1"][:DIM].T
    order, groups, hs, z, at = within(p, h, flat)
    ws = weight[order]
    own, total = level(z, at, safe)
    loss += own @ ws
    if not safe and not np.isfinite(loss):
        return gradients(p, x, y, exists, grads, True)
    z *= (ws / total)[:, None]
    z.ravel()[at] -= ws
    d["U2"][:] = 0
    sorted_do = np.empty_like(do)
    for g, a, b in groups:
        np.matmul(hs[a:b].T, z[a:b], out=d["U2"][g])
        np.matmul(z[a:b], p["U2"][g, :DIM].T, out=sorted_do[a:b])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    do += sorted_do.take(back, axis=0)
    do = do.reshape(n, step, DIM)
    da = do * inverse
    dv = s.transpose(0, 2, 1) @ da
    ds = da @ v[:, :, :DIM].transpose(0, 2, 1)
    ds -= np.einsum("nij,nij->ni", da, o)[:, :, None]
    ds *= s
    dq = ds @ k
    dq *= SCALE
    dk = ds.transpose(0, 2, 1) @ q
    distance = np.arange(WIDTH - step, WIDTH)[:, None] - np.arange(WIDTH)[None, :]
    d["B"][:] = np.bincount(distance.clip(-1).ravel() + 1, weights=ds.sum(axis=0).ravel(), minlength=WIDTH + 1)[1:]
    scatter(x, K=dk, V=dv, into=d)
    scatter(x[:, WIDTH - step :], Q=dq, R=do, into=d)
    return float(loss)


def scatter(ids: np.ndarray, into: dict[str, np.ndarray], **parts: np.ndarray) -> None:
    """Sums the vectors of equal ids."""
    ids = ids.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for name, part in parts.items():
        into[name][:] = 0
        into[name][ids[starts]] = np.add.reduceat(part.reshape(-1, DIM).take(order, axis=0), starts, axis=0)


class Adam:
    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.n = flat, rate, 0
        self.m, self.v, self.spare = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)

    def step(self, grads: np.ndarray, scale: float = 1.0) -> None:
        self.n += 1
        t = self.spare
        self.m += np.multiply(np.subtract(grads, self.m, out=t), 0.1, out=t)
        np.multiply(grads, grads, out=t)
        t -= self.v
        t *= 0.01
        self.v += t
        np.sqrt(self.v, out=t)
        t *= (1 - 0.99**self.n) ** -0.5
        t += 1e-8
        np.divide(self.m, t, out=t)
        t *= scale * self.rate / (1 - 0.9**self.n)
        self.flat -= t


class Trainer:
    """Trains parameters, in place, on texts' ids as they come: every window once, in random order within a block of texts."""

    def __init__(self, flat: np.ndarray, rate: float, seed: int = 2, batch: int = 256, slow: int = 100):
        keep_memory()
        self.adam, self.p, self.grads = Adam(flat, rate), views(flat), np.zeros_like(flat)
        self.draw, self.batch, self.slow, self.ids, self.recent = np.random.default_rng(seed), batch, slow, 0, 0.0

    def see(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """One block; the rate falls with the root of the number of steps."""
        windows = Windows(ids, sizes, WIDTH)
        order = self.draw.permutation(len(windows))
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for at in range(0, len(order), self.batch):
                loss = gradients(self.p, *windows.take(order[at : at + self.batch]), self.grads)
                self.adam.step(self.grads, (1 + self.adam.n / self.slow) ** -0.5)
                self.recent += 0.02 * (loss - self.recent) if self.recent else loss
        self.ids += len(ids)


class Scorer:
    """Scores texts with fixed parameters."""

    def __init__(self, flat: np.ndarray):
        keep_memory()
        self.p = views(flat)
        self.known = tables(self.p, STEP)

    def block(self, x: np.ndarray, y: np.ndarray, safe: bool = False) -> np.ndarray:
        """Natural log probabilities of the targets y (windows, STEP) after the inputs x (windows, WIDTH)."""
        h = attend(self.p, x, STEP, safe, self.known)[-1]
        flat = y.ravel()
        out = -level(h @ self.p["U1"], np.arange(flat.size) * GROUPS + flat // MEMBERS, safe)[0]
        order, _, _, z, at = within(self.p, h, flat)
        out[order] -= level(z, at, safe)[0]
        if not safe and not np.isfinite(out).all():
            return self.block(x, y, True)
        return out.reshape(y.shape)

    def score(self, ids: np.ndarray, sizes: np.ndarray, batch: int = 512) -> np.ndarray:
        """Natural log probability of each text, whose ids lie one behind the other."""
        windows = Windows(ids, sizes, STEP)
        out = np.zeros(len(windows))
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for at in range(0, len(windows), batch):
                x, y, exists = windows.take(slice(at, at + batch))
                got = self.block(x, y)
                got[~exists] = 0
                out[at : at + batch] = got.sum(axis=1, dtype=np.float64)
        return np.bincount(windows.text, weights=out, minlength=len(sizes))
