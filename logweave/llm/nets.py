"""Two small convolutional text classifiers in numpy: over hashed words and over bytes.

Both end in max-pooled filters and a logistic unit. The gradient of a maximum goes to the position that reached it, so a
training step touches one window per text and filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from logweave.llm.words import SPACE_LOWER, binary_bytes, split_words, text_bytes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], used: np.ndarray | None = None) -> None:
        """With ``used`` the gradient of ``e`` has these rows alone, in ascending order; every row moves on by its mean."""
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            if k == "e" and used is not None:
                self.rows(k, g, used, float(scale))
                continue
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)

    def rows(self, k: str, g: np.ndarray, used: np.ndarray, scale: float) -> None:
        """In place and in the parameters' own precision."""
        m, v = self.m[k], self.v[k]
        m *= 0.9
        m[used] += 0.1 * g
        v *= 0.999
        v[used] += 0.001 * (g * g)
        for a in range(0, len(m), BLOCK):
            part = np.sqrt(v[a : a + BLOCK])
            part += 1e-7
            np.divide(m[a : a + BLOCK], part, out=part)
            part *= scale
            self.params[k][a : a + BLOCK] -= part


def epochs(n: int, times: int, size: int, seed: int):
    rng = np.random.default_rng(seed)
    for _ in range(times):
        order = rng.permutation(n)
        for k in range(0, n, size):
            yield np.sort(order[k : k + size])


def balance(labels: np.ndarray, mean: float) -> np.ndarray:
    """Weights by which both classes count alike where label 1 has this share."""
    return np.where(labels == 1, 0.5 / max(mean, 1e-6), 0.5 / max(1 - mean, 1e-6)).astype(np.float32)


# Over words.

BUCKETS, WORD_DIM, WORD_FILTERS, WIDTHS, VIEWS = 1 << 14, 12, 16, (1, 2, 3), 3
PAD = BUCKETS * VIEWS
PIECE, BLOCK = 1 << 10, 1 << 11  # words whose responses are held at a time, and embeddings that move at a time, few enough for the cache


#: What is trimmed off words.
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?|\"'()[]")] = True


def trimmed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word begins without what is trimmed, where it ends, bytes)."""
    offsets, data = binary_bytes(words)
    inner = np.flatnonzero(~_EDGE[data])
    starts = np.minimum(np.append(inner, len(data))[np.searchsorted(inner, offsets[:-1])], offsets[1:])
    ends = np.append(inner, -1)[np.searchsorted(inner, offsets[1:]) - 1] + 1  # of the last place before; none gives 0
    return starts, np.maximum(ends, starts), data


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxh32 of pieces of ``data``; those under 16 bytes, which most words are, all at once."""
    p1, p2, p3, p4, p5 = (np.uint32(p) for p in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))
    size = ends - starts
    long = np.flatnonzero(size >= 16)
    size = np.minimum(size, 15)
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    fours = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    h = p5 + size.astype(np.uint32)
    for k in range(3):
        some = np.flatnonzero(size >= 4 * k + 4)
        x = h[some] + fours[starts[some] + 4 * k] * p3
        h[some] = ((x << np.uint32(17)) | (x >> np.uint32(15))) * p4
    for k in range(3):
        some = np.flatnonzero(size % 4 > k)
        x = h[some] + padded[starts[some] + size[some] // 4 * 4 + k] * p5
        h[some] = ((x << np.uint32(11)) | (x >> np.uint32(21))) * p1
    h = (h ^ (h >> np.uint32(15))) * p2
    h = (h ^ (h >> np.uint32(13))) * p3
    h ^= h >> np.uint32(16)
    h[long] = [xxhash.xxh32_intdigest(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of VIEWS embedding numbers, where each text begins; one more at the end).

    Each word has a bucket for itself, for its first four and for its first six bytes, so unseen forms of a known stem meet it.
    Every text has paddings in front, enough that no filter over the end of the text before reaches its words, and one behind.
    """
    words = split_words(column, SPACE_LOWER)
    starts, ends, data = trimmed(words.dictionary)
    table = np.stack([v * BUCKETS + (hashes(data, starts, np.minimum(ends, starts + most)) % BUCKETS).astype(np.int32) for v, most in enumerate((len(data), 4, 6))], axis=1)
    counts, pad = np.diff(words.first), max(WIDTHS)
    begins = np.concatenate(([0], np.cumsum(counts + pad)))
    rows = np.full((begins[-1], VIEWS), PAD, np.int32)
    if len(words.index):
        rows[np.arange(len(words.index)) + np.repeat(np.arange(len(counts)) * pad + pad - 1, counts)] = table[words.index]
    return rows, begins


class WordNet:
    """Hashed word embeddings, filters of several widths, max over the text, one logistic unit."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.p = params or {
            "e": f(BUCKETS * VIEWS + 1, WORD_DIM, scale=0.1),
            **{f"w{k}": f(k * WORD_DIM, WORD_FILTERS, scale=(k * WORD_DIM) ** -0.5) for k in WIDTHS},
            **{f"b{k}": np.zeros(WORD_FILTERS, np.float32) for k in WIDTHS},
            "o": f(len(WIDTHS) * WORD_FILTERS, scale=0.1), "c": np.full(1, -1.0, np.float32),
        }
        self.pad = PAD
        if params is None:
            self.p["e"][PAD] = 0

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        one, two, three = (np.take(self.p["e"], rows[..., v], axis=0) for v in range(VIEWS))
        one += two
        one += three
        return one

    def pooled(self, rows: np.ndarray, begins: np.ndarray, where: bool = False):
        """Of each text the greatest response of every filter, and where it begins if asked; a piece of the words at a time."""
        n, own, widest = len(begins) - 1, len(WIDTHS) * WORD_FILTERS, max(WIDTHS)
        top = np.full((n, own), -np.inf, self.p["o"].dtype)
        at = np.zeros((n, own), np.int64) if where else None
        every = np.zeros((own, widest * WORD_DIM), self.p["e"].dtype)  # narrower filters are zero where they end
        for i, k in enumerate(WIDTHS):
            every[i * WORD_FILTERS : (i + 1) * WORD_FILTERS, : k * WORD_DIM] = self.p[f"w{k}"].T
        shift, row = np.concatenate([self.p[f"b{k}"] for k in WIDTHS]), np.arange(own)
        for a in range(0, len(rows), PIECE):
            size = min(PIECE, len(rows) - a)
            x = np.zeros((size + widest - 1, WORD_DIM), self.p["e"].dtype)
            found = rows[a : a + len(x)]
            x[: len(found)] = self.embedded(found)
            windows = np.ndarray((size, every.shape[1]), x.dtype, x, strides=x.strides).copy()
            y = every @ windows.T  # of each filter its responses, one after the other
            texts = slice(int(np.searchsorted(begins, a, "right")) - 1, int(np.searchsorted(begins, a + size, "left")))
            cut = np.maximum(begins[texts] - a, 0)
            if where:
                first = np.stack([b + y[:, b:e].argmax(axis=1) for b, e in zip(cut.tolist(), [*cut[1:].tolist(), size], strict=True)])
                m = y[row, first] + shift
                at[texts] = np.where(m > top[texts], a + first, at[texts])
            else:
                m = np.maximum.reduceat(y, cut, axis=1).T + shift  # windows of padding alone give a constant
            top[texts] = np.maximum(top[texts], m)
        return (top, at) if where else top

    def score(self, column: pa.Array) -> np.ndarray:
        return self.of_words(*word_features(column))

    def of_words(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        top = self.pooled(rows, begins)
        return sigmoid(np.maximum(top, 0) @ self.p["o"] + self.p["c"]).astype(np.float64)

    def fit(self, column: pa.Array, labels: np.ndarray, times: int = 8) -> WordNet:
        return self.learn(*word_features(column), labels, balance(labels, labels.mean()), times)

    def learn(self, rows: np.ndarray, begins: np.ndarray, labels: np.ndarray, weight: np.ndarray, times: int, size: int = 64, rate: float = 0.01, seed: int = 5) -> WordNet:
        adam = Adam(self.p, rate)
        for batch in epochs(len(labels), times, size, seed):
            own = np.concatenate([rows[begins[i] : begins[i + 1]] for i in batch])
            b = np.concatenate(([0], np.cumsum(begins[batch + 1] - begins[batch])))
            adam.step(*self.slopes(own, b, labels[batch], weight[batch]))
        return self

    def gradients(self, rows: np.ndarray, begins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss of some texts."""
        grads, used = self.slopes(rows, begins, labels, weight)
        every = np.zeros_like(self.p["e"])
        every[used] = grads["e"]
        return grads | {"e": every}

    def slopes(self, rows: np.ndarray, begins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """As ``gradients``, but of ``e`` only the rows that a filter met, and their numbers in ascending order."""
        top, at = self.pooled(rows, begins, where=True)
        hidden = np.maximum(top, 0)
        d = (sigmoid(hidden @ self.p["o"] + self.p["c"]) - labels) * weight / len(labels)
        grads = {"o": (hidden.T @ d).astype(np.float32), "c": np.array([d.sum()], np.float32)}
        dh, hit, pull = ((d[:, None] * self.p["o"]) * (top > 0)).astype(np.float32), [], []
        for n, k in enumerate(WIDTHS):
            part = slice(n * WORD_FILTERS, (n + 1) * WORD_FILTERS)
            g, w = dh[:, part], self.p[f"w{k}"].reshape(k, WORD_DIM, WORD_FILTERS)
            met = rows[np.minimum(at[:, part] + np.arange(k)[:, None, None], len(rows) - 1)]
            grads[f"w{k}"] = np.einsum("bf,kbfd->kdf", g, self.embedded(met)).reshape(self.p[f"w{k}"].shape).astype(np.float32)
            grads[f"b{k}"] = g.sum(axis=0)
            hit.append(met.reshape(-1, VIEWS))
            pull.append((g[:, None] * w[:, None]).transpose(2, 0, 1, 3).reshape(WORD_DIM, -1))
        hit, pull = np.concatenate(hit), np.concatenate(pull, axis=1)
        some = np.zeros(len(self.p["e"]), bool)
        some[hit] = True
        some[self.pad] = False
        used, place = np.flatnonzero(some), np.cumsum(some) - 1
        place[self.pad] = len(used)
        of, grads["e"] = place[hit.T].ravel(), np.empty((len(used), WORD_DIM), np.float32)
        for i in range(WORD_DIM):
            grads["e"][:, i] = np.bincount(of, np.tile(pull[i], VIEWS), len(used) + 1)[:-1]
        return grads, used

    def narrowed(self, rows: np.ndarray) -> tuple[WordNet, np.ndarray, np.ndarray]:
        """A copy with the embeddings that ``rows`` use alone, the numbers of those, and ``rows`` by their places in it."""
        used = np.zeros(len(self.p["e"]), bool)
        used[rows] = used[self.pad] = True
        place = np.cumsum(used, dtype=np.int32) - 1
        net = WordNet({k: v[used] if k == "e" else v.copy() for k, v in self.p.items()})
        net.pad = place[self.pad]
        return net, np.flatnonzero(used), place[rows]


# Over bytes.

CHUNK, OVERLAP, STRIDE, BYTE_DIM, BYTE_WIDTH, BYTE_FILTERS, HIDDEN = 1024, 64, 1, 8, 16, 32, 16


def byte_chunks(data: np.ndarray) -> np.ndarray:
    """Chunks that cover a whole text, each overlapping the one before; the last is padded with zero bytes."""
    step = CHUNK - OVERLAP
    n = max(1, -(-max(len(data) - OVERLAP, 1) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class ByteNet:
    """Byte embeddings, filters over each chunk, max over the chunk; mean and max over the chunks, a hidden layer, one logistic unit."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 12):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.p = params or {
            "e": f(256, BYTE_DIM, scale=0.5), "w": f(BYTE_WIDTH * BYTE_DIM, BYTE_FILTERS, scale=(BYTE_WIDTH * BYTE_DIM) ** -0.5), "b": np.zeros(BYTE_FILTERS, np.float32),
            "h": f(2 * BYTE_FILTERS, HIDDEN, scale=(2 * BYTE_FILTERS) ** -0.5), "g": np.zeros(HIDDEN, np.float32), "o": f(HIDDEN, scale=0.3), "c": np.zeros(1, np.float32),
        }

    def chunk_tops(self, chunks: np.ndarray, where: bool = False):
        """Per chunk the greatest response of each filter; rows go through in blocks that stay in the cache."""
        out, at = np.empty((len(chunks), BYTE_FILTERS), np.float32), np.empty((len(chunks), BYTE_FILTERS), np.int64)
        for k in range(0, len(chunks), 16):
            x = self.p["e"][chunks[k : k + 16]]
            win = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), BYTE_WIDTH * BYTE_DIM, axis=1)[:, :: STRIDE * BYTE_DIM]
            y = (np.ascontiguousarray(win).reshape(-1, BYTE_WIDTH * BYTE_DIM) @ self.p["w"]).reshape(len(x), -1, BYTE_FILTERS)
            out[k : k + 16] = y.max(axis=1) + self.p["b"]
            if where:
                at[k : k + 16] = y.argmax(axis=1) * STRIDE
        return (out, at) if where else out

    def _combine(self, tops: np.ndarray, begins: np.ndarray):
        a = np.maximum(tops, 0)
        n = np.diff(begins)[:, None]
        mean, most = np.add.reduceat(a, begins[:-1], axis=0) / n, np.maximum.reduceat(a, begins[:-1], axis=0)
        z = np.concatenate((mean, most), axis=1)
        hidden = np.maximum(z @ self.p["h"] + self.p["g"], 0)
        return a, z, hidden, sigmoid(hidden @ self.p["o"] + self.p["c"])

    @staticmethod
    def chunks_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = text_bytes(column)
        each = [byte_chunks(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(each), np.concatenate(([0], np.cumsum([len(c) for c in each])))

    def score(self, column: pa.Array) -> np.ndarray:
        chunks, begins = self.chunks_of(column)
        return self._combine(self.chunk_tops(chunks), begins)[3].astype(np.float64)

    def fit(self, column: pa.Array, labels: np.ndarray, times: int = 6, size: int = 32, rate: float = 0.004, seed: int = 6) -> ByteNet:
        adam = Adam(self.p, rate)
        weight = balance(labels, labels.mean())
        chunks, begins = self.chunks_of(column)
        for batch in epochs(len(labels), times, size, seed):
            own = np.concatenate([chunks[begins[i] : begins[i + 1]] for i in batch])
            n = np.diff(begins)[batch]
            adam.step(self.gradients(own, n, labels[batch], weight[batch]))
        return self

    def gradients(self, chunks: np.ndarray, n: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss of some texts; ``n`` says how many chunks each has."""
        tops, at = self.chunk_tops(chunks, where=True)
        a, z, hidden, p = self._combine(tops, np.concatenate(([0], np.cumsum(n))))
        d = ((p - labels) * weight / len(labels)).astype(np.float32)
        dh = (d[:, None] * self.p["o"]) * (hidden > 0)
        dz = dh @ self.p["h"].T
        grads = {"o": hidden.T @ d, "c": np.array([d.sum()], np.float32), "h": z.T @ dh, "g": dh.sum(axis=0)}
        da = np.repeat(dz[:, :BYTE_FILTERS] / n[:, None], n, axis=0)
        is_most = (a == np.repeat(z[:, BYTE_FILTERS:], n, axis=0)).astype(np.float32)
        is_most /= np.repeat(np.add.reduceat(is_most, np.cumsum(n) - n, axis=0), n, axis=0)  # chunks that tie share
        da = ((da + is_most * np.repeat(dz[:, BYTE_FILTERS:], n, axis=0)) * (tops > 0)).astype(np.float32)
        place = at[:, :, None] + np.arange(BYTE_WIDTH)
        seen = chunks[np.arange(len(chunks))[:, None, None], place]  # bytes under each winning window
        x = self.p["e"][seen].reshape(len(chunks), BYTE_FILTERS, -1)
        grads["w"], grads["b"] = np.einsum("nf,nfd->df", da, x), da.sum(axis=0)
        back = (da[:, :, None] * self.p["w"].T[None]).reshape(-1, BYTE_DIM)
        grads["e"] = np.zeros_like(self.p["e"])
        np.add.at(grads["e"], seen.reshape(-1), back)
        return grads
