"""A character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters with a class of their own after letter case is dropped; digits share one, all else another.
OWN = "abcdefghijklmnopqrstuvwxyz@.+-()/:_%#, \n\"'=[]"
PAD, OTHER, DIGIT = 0, 1, 2
CLASSES = 3 + len(OWN)
_CLASS = np.full(0x250, OTHER, np.int64)
for _k, _c in enumerate(OWN):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 3 + _k
_CLASS[48:58] = DIGIT
LINE_END = _CLASS[10]

EMBED, HIDDEN, FORBIDDEN = 12, 20, -1e4


def classes(text: str) -> np.ndarray:
    """The class of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CLASS[np.minimum(codes, len(_CLASS) - 1)]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x, wx, wh, b, keep):
    """Hidden states (time, direction, row, size) of both directions at once, and what the way back needs, if kept.

    x is (time, direction, row, embedding); the second direction has its time reversed.
    """
    t, d, n, _ = x.shape
    size = wh.shape[1]
    gates = x @ wx + b[:, None]
    h, c = np.zeros((d, n, size), x.dtype), np.zeros((d, n, size), x.dtype)
    out = np.empty((t, d, n, size), x.dtype)
    cells, squashed = (np.empty((t, d, n, size), x.dtype), np.empty((t, d, n, size), x.dtype)) if keep else (None, None)
    for k in range(t):
        a = gates[k]
        a += h @ wh
        a[..., : 3 * size] = _sigmoid(a[..., : 3 * size])
        g = np.tanh(a[..., 3 * size :], out=a[..., 3 * size :])
        c = a[..., size : 2 * size] * c + a[..., :size] * g
        th = np.tanh(c)
        h = np.multiply(a[..., 2 * size : 3 * size], th, out=out[k])
        if keep:
            cells[k], squashed[k] = c, th
    return out, (gates, cells, squashed)


def _lstm_back(x, wx, wh, out, kept, d_out):
    """Gradients of x, wx, wh and b from those of the hidden states."""
    gates, cells, squashed = kept
    t, d, n, size = d_out.shape
    a = np.empty_like(gates)
    dh, dc = np.zeros((d, n, size), x.dtype), np.zeros((d, n, size), x.dtype)
    none = np.zeros((d, n, size), x.dtype)
    back = wh.transpose(0, 2, 1)
    for k in reversed(range(t)):
        i, f, o, g = (gates[k][..., q * size : (q + 1) * size] for q in range(4))
        dh = dh + d_out[k]
        dc = dc + dh * o * (1 - squashed[k] ** 2)
        a[k, ..., :size] = dc * g * i * (1 - i)
        a[k, ..., size : 2 * size] = dc * (cells[k - 1] if k else none) * f * (1 - f)
        a[k, ..., 2 * size : 3 * size] = dh * squashed[k] * o * (1 - o)
        a[k, ..., 3 * size :] = dc * i * (1 - g**2)
        dh, dc = a[k] @ back, dc * f
    d_wx = np.stack([x[:, q].reshape(-1, x.shape[-1]).T @ a[:, q].reshape(-1, 4 * size) for q in range(d)])
    d_wh = np.stack([out[:-1, q].reshape(-1, size).T @ a[1:, q].reshape(-1, 4 * size) for q in range(d)])
    return a @ wx.transpose(0, 2, 1), d_wx, d_wh, a.sum((0, 2))


@dataclass
class Tagger:
    """Parameters, tag names ("O", "B-x", "I-x") and window length."""

    tags: list[str]
    window: int
    params: dict[str, np.ndarray]

    def allowed(self) -> np.ndarray:
        """0 where one tag may follow another, else FORBIDDEN: I-x follows B-x and I-x alone."""
        ok = np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in self.tags] for a in self.tags])
        return np.where(ok, 0.0, FORBIDDEN)

    def emissions(self, x: np.ndarray, keep: bool = False):
        p = self.params
        e = np.stack([p["embed"][x.T], p["embed"][x.T[::-1]]], 1)
        hidden, kept = _lstm(e, p["wx"], p["wh"], p["b"], keep)
        both = np.concatenate((hidden[:, 0], hidden[::-1, 1]), 2).transpose(1, 0, 2)
        scores = both @ p["out"] + p["bias"]
        return (scores, (e, both, hidden, kept)) if keep else scores

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and its gradients."""
        p, (n, t) = self.params, x.shape
        s, (e, both, hidden, kept) = self.emissions(x, True)
        trans = p["trans"] + self.allowed()
        first = p["start"] + np.where([tag[0] == "I" for tag in self.tags], FORBIDDEN / 10, 0.0)
        # forward and backward sums as probabilities, scaled at each character
        top = s.max(2, keepdims=True)
        scaled, moves, begin = np.exp(s - top), np.exp(trans).astype(s.dtype), np.exp(first).astype(s.dtype)
        alpha, beta, total = np.empty_like(s), np.ones_like(s), np.empty((n, t), s.dtype)
        for k in range(t):
            now = (alpha[:, k - 1] @ moves if k else begin) * scaled[:, k]
            total[:, k] = now.sum(1)
            np.divide(now, total[:, k, None], out=alpha[:, k])
        ahead = np.empty_like(s)
        for k in reversed(range(1, t)):
            np.multiply(scaled[:, k], beta[:, k] / total[:, k, None], out=ahead[:, k])
            beta[:, k - 1] = ahead[:, k] @ moves.T
        z = np.log(total).sum(1) + top.sum((1, 2))
        rows = np.arange(n)
        gold = first[y[:, 0]] + s[rows[:, None], np.arange(t), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        d_s = alpha * beta
        d_start = d_s[:, 0].sum(0) - np.bincount(y[:, 0], minlength=len(self.tags))
        d_trans = moves * (alpha[:, :-1].reshape(-1, len(self.tags)).T @ ahead[:, 1:].reshape(-1, len(self.tags)))
        np.subtract.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d_s[rows[:, None], np.arange(t), y] -= 1
        d_both = d_s @ p["out"].T
        size = p["wh"].shape[1]
        d_both = d_both.transpose(1, 0, 2)
        d_out = np.stack([d_both[:, :, :size], d_both[::-1, :, size:]], 1)
        de, wx, wh, b = _lstm_back(e, p["wx"], p["wh"], hidden, kept, d_out)
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, x.T, de[:, 0] + de[::-1, 1])
        out = both.reshape(n * t, -1).T @ d_s.reshape(n * t, -1)
        grads = {"embed": d_embed, "wx": wx, "wh": wh, "b": b, "out": out, "bias": d_s.sum((0, 1)), "trans": d_trans, "start": d_start}
        return float((z - gold).mean()), {k: g / n for k, g in grads.items()}

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each run of emissions (length, tags)."""
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
        trans = self.params["trans"] + self.allowed()
        first = self.params["start"] + np.where([tag[0] == "I" for tag in self.tags], FORBIDDEN / 10, 0.0)
        out: list = [None] * len(runs)
        for at in range(0, len(order), 256):
            part = [k for k in order[at : at + 256] if len(runs[k])]
            for k in order[at + len(part) : at + 256]:
                out[k] = np.zeros(0, np.int64)
            if not part:
                continue
            lengths = np.array([len(runs[k]) for k in part])
            t = int(lengths[0])
            s = np.zeros((t, len(part), len(self.tags)), np.float32)
            for row, k in enumerate(part):
                s[: lengths[row], row] = runs[k]
            back = np.zeros((t, len(part), len(self.tags)), np.int8)
            best = first + s[0]
            for step in range(1, t):
                live = int(np.searchsorted(-lengths, -step))  # runs that are longer than `step`
                both = best[:live, :, None] + trans
                back[step, :live] = both.argmax(1)
                best[:live] = both.max(1) + s[step, :live]
            tags = np.zeros((t, len(part)), np.int64)
            now = best.argmax(1)
            rows = np.arange(len(part))
            for step in reversed(range(t)):
                live = int(np.searchsorted(-lengths, -step))
                tags[step, :live] = now[:live]
                now[:live] = back[step, rows[:live], now[:live]]
            for row, k in enumerate(part):
                out[k] = tags[: lengths[row], row]
        return out

    def tag_all(self, texts: list[str], wanted: list[np.ndarray], batch: int = 1024) -> list[np.ndarray]:
        """Tags of whole texts: windows of all texts go through the LSTM together, and each text is decoded as one.

        Half-overlapping windows are read around the wanted characters. A
        character's emissions are averaged over its windows, weighted by its
        distance from their edges; then each run of read characters gets one
        best sequence under the CRF, whatever windows it spans. Characters of
        no window are "O", and no span goes over the end of a line.
        """
        w, half = self.window, self.window // 2
        coded = [classes(t) for t in texts]
        starts = [np.unique(np.maximum(0, np.concatenate((p // half - 1, p // half)) * half)) for p in wanted]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
        begin = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
        sizes = np.array([len(x) for x in coded], np.int64)
        offset = np.cumsum(sizes) - sizes
        flat = np.concatenate([*coded, np.zeros(0, np.int64)])
        # only characters of windows are kept: windows of a text follow each other in steps of half a window or more
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (begin[1:] > begin[:-1] + half))) if len(begin) else np.zeros(0, bool)
        last = np.minimum(begin + w, sizes[owner])
        run = np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        run_size = last[np.append(heads[1:], len(begin)) - 1] - begin[heads] if len(heads) else np.zeros(0, np.int64)
        run_at = np.cumsum(run_size) - run_size
        place = run_at[run] + begin - begin[heads][run] if len(heads) else begin
        scores, weights = np.zeros((int(run_size.sum()), len(self.tags)), np.float32), np.zeros(int(run_size.sum()), np.float32)
        weight = (np.minimum(np.arange(w), np.arange(w)[::-1]) + 1).astype(np.float32)
        for k in range(0, len(begin), batch):
            o, b, to = owner[k : k + batch], begin[k : k + batch], last[k : k + batch]
            at = b[:, None] + np.arange(w)
            valid = at < to[:, None]
            x = np.where(valid, flat[np.minimum(offset[o][:, None] + at, len(flat) - 1)], PAD)
            found = self.emissions(x)
            spot = place[k : k + batch, None] + np.arange(w)
            for even in (0, 1):  # windows that do not overlap are added at once
                rows = np.arange(even, len(b), 2)
                ok = valid[rows]
                scores[spot[rows][ok]] += (found[rows] * weight[:, None])[ok]
                weights[spot[rows][ok]] += np.broadcast_to(weight, ok.shape)[ok]
        scores /= np.maximum(weights, 1)[:, None]
        tags = [np.zeros(n, np.int64) for n in sizes.tolist()]
        runs = []
        for h, n, at in zip(heads.tolist(), run_size.tolist(), run_at.tolist(), strict=True):
            part = scores[at : at + n]
            a = int(offset[owner[h]] + begin[h])
            part[flat[a : a + n] == LINE_END, 1:] = FORBIDDEN
            runs.append(part)
        for h, found in zip(heads.tolist(), self.decode(runs), strict=True):
            tags[owner[h]][begin[h] : begin[h] + len(found)] = found
        return tags

    def tag(self, text: str, wanted: np.ndarray) -> np.ndarray:
        """Tags of one text."""
        return self.tag_all([text], [np.asarray(wanted, np.int64)])[0]


def fit(texts: list[str], spans: list[list[tuple[int, int, str]]], kinds: tuple[str, ...], window: int = 64, epochs: int = 12, batch: int = 96, rate: float = 0.02, seed: int = 5, kind=np.float32) -> Tagger:
    """Train on texts of up to one window with their labelled (start, end, kind) spans, by Adam."""
    tags = ["O", *(f"{b}-{k}" for k in kinds for b in "BI")]
    x, y = np.zeros((len(texts), window), np.int64), np.zeros((len(texts), window), np.int64)
    for n, (t, own) in enumerate(zip(texts, spans, strict=True)):
        c = classes(t[:window])
        x[n, : len(c)] = c
        for a, b, what in own:
            y[n, a : min(b, window)] = tags.index(f"I-{what}")
            if a < window:
                y[n, a] = tags.index(f"B-{what}")
    rng = np.random.default_rng(seed)
    g = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    params = {"embed": rng.normal(0, 0.3, (CLASSES, EMBED)), "out": g(2 * HIDDEN, len(tags)), "bias": np.zeros(len(tags)), "trans": np.zeros((len(tags), len(tags))), "start": np.zeros(len(tags))}
    params |= {"wx": np.stack([g(EMBED, 4 * HIDDEN) for _ in "01"]), "wh": np.stack([g(HIDDEN, 4 * HIDDEN) for _ in "01"]), "b": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN), (2, 1))}
    params = {k: v.astype(kind) for k, v in params.items()}
    model = Tagger(tags, window, params)
    first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            step += 1
            _, grads = model.gradients(x[order[k : k + batch]], y[order[k : k + batch]])
            norm = np.sqrt(sum((v**2).sum() for v in grads.values()))
            for name, v in grads.items():
                v = (v * min(1.0, 5.0 / (norm + 1e-9))).astype(kind)
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v**2
                params[name] -= kind(rate) * (1 - 0.9 * epoch / epochs) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return model
