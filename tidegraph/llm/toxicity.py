"""Toxicity by a bidirectional gated recurrent network with attention, trained and run in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import byte_groups, map_batches, ship_package

#: Words in a window, and from one window to the next.
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
#: Rows of the hashed tables; the number by which sums of grams are divided.
WORD_ROWS, CHAR_ROWS, GRAMS = 1 << 15, 1 << 16, 9
#: The fit reads at most this many labelled rows of each kind; it trains on those of up to FIT_CHARS
#: characters, and places the score with all of them.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 800, 1800, 3000
EPOCHS, STEPS, BATCH, RATE = 6, 300, 24, 0.14
#: Words kept by a worker, and bytes of words after which it begins anew.
KEPT_WORDS, KEPT_BYTES = 400_000, 16 << 20
GROUP_BYTES, CHUNK = 2 << 20, 1024
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def char_rows(word: str) -> list[int]:
    """Rows of all character grams of a word: its beginnings of 3 to 6 bytes, its end, and each 4 bytes inside."""
    w = word.encode()
    grams = [b"^" + w[:n] for n in (3, 4, 5, 6)]
    grams.append(w[-4:] + b"$")
    grams += [w[i:i + 4] for i in range(len(w) - 3)]
    return [crc32(g) % CHAR_ROWS for g in grams]


def _sum_rows(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.diff(at[order], prepend=-1))
    out[at[order][begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


class Network:
    """Word and character embeddings, a gated recurrent unit in each direction, attention, one logit."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.words = np.zeros((WORD_ROWS, WORD_DIM), np.float32)
        self.chars = np.zeros((CHAR_ROWS, CHAR_DIM), np.float32)
        self.p = {
            "wx": f(WORD_DIM + CHAR_DIM, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32), "u": f(2, HIDDEN, 3 * HIDDEN),
            "wa": f(2 * HIDDEN, ATTEND), "va": f(ATTEND, 1)[:, 0], "wo": f(2 * HIDDEN, 1)[:, 0], "bo": np.full(1, -1.0, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def embed(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' rows, the rows of all their grams, how many grams each has, and the inputs: a word's row
        beside the sum of its grams."""
        rows = np.array([crc32(w.encode()) % WORD_ROWS for w in vocabulary], np.int64)
        each = [char_rows(w) for w in vocabulary]
        n = np.array([len(g) for g in each], np.int64)
        grams = np.fromiter(chain.from_iterable(each), np.int64, n.sum())
        sums = np.add.reduceat(self.chars[grams], np.cumsum(n) - n, axis=0) / np.float32(GRAMS) if len(n) else np.zeros((0, CHAR_DIM), np.float32)
        return rows, grams, n, np.concatenate((self.words[rows], sums), axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["wx"] + self.p["bx"]

    def run(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ``at`` (windows, places) are rows of ``gates``, ``mask`` is 1 where words are."""
        n, t = at.shape
        u, h3 = self.p["u"], 3 * HIDDEN
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((t, 2, n, HIDDEN), np.float32)
        kept = []
        for i in range(t):
            j = t - 1 - i
            g = np.empty((2, n, h3), np.float32)
            g[0], g[1] = gates[at[:, i], :h3], gates[at[:, j], h3:]
            m = np.stack((mask[:, i], mask[:, j]))[:, :, None]
            hu = h @ u
            rz = 1 / (1 + np.exp(-(g[:, :, :2 * HIDDEN] + hu[:, :, :2 * HIDDEN])))
            r, z = rz[:, :, :HIDDEN], rz[:, :, HIDDEN:]
            c = np.tanh(g[:, :, 2 * HIDDEN:] + r * hu[:, :, 2 * HIDDEN:])
            new = h + m * (1 - z) * (c - h)
            if keep:
                kept.append((h, hu, r, z, c, m))
            h = new
            states[i, 0], states[j, 1] = h[0], h[1]
        s = states.transpose(2, 0, 1, 3).reshape(n, t, 2 * HIDDEN)
        a = np.tanh(s @ self.p["wa"])
        e = a @ self.p["va"]
        e = np.where(mask > 0, e, -30).astype(np.float32)
        w = np.exp(e - e.max(1, keepdims=True))
        w *= mask
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = (w[:, None, :] @ s)[:, 0]
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (kept, s, a, w, pooled)) if keep else logit

    def quick(self, ahead: np.ndarray, behind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits of windows without empty places, as ``run`` gives them, from the gate inputs of both directions."""
        n, t = at.shape
        p, two, at = self.p, 2 * HIDDEN, np.ascontiguousarray(at.T)
        h = np.zeros((2, n, HIDDEN), np.float32)
        g, hu = np.empty((2, n, 3 * HIDDEN), np.float32), np.empty((2, n, 3 * HIDDEN), np.float32)
        states = np.empty((t, n, two), np.float32)
        for i in range(t):
            np.take(ahead, at[i], axis=0, out=g[0], mode="clip")
            np.take(behind, at[t - 1 - i], axis=0, out=g[1], mode="clip")
            np.matmul(h, p["u"], out=hu)
            rz = g[:, :, :two]
            rz += hu[:, :, :two]
            np.negative(rz, out=rz)
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            c = hu[:, :, two:]
            c *= rz[:, :, :HIDDEN]
            c += g[:, :, two:]
            np.tanh(c, out=c)
            h -= c
            h *= rz[:, :, HIDDEN:]
            h += c
            states[i, :, :HIDDEN], states[t - 1 - i, :, HIDDEN:] = h[0], h[1]
        a = states.reshape(t * n, two) @ p["wa"]
        np.tanh(a, out=a)
        e = (a @ p["va"]).reshape(t, n)
        e -= e.max(0)
        np.exp(e, out=e)
        e /= e.sum(0)
        each = (states.reshape(t * n, two) @ p["wo"]).reshape(t, n)
        return (e * each).sum(0) + p["bo"][0]

    def back(self, at: np.ndarray, mask: np.ndarray, cache, d: np.ndarray, rows: int) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the gate inputs (by row), given those of the logits."""
        kept, s, a, w, pooled = cache
        n, t = at.shape
        h3, p = 3 * HIDDEN, self.p
        g = {"wo": pooled.T @ d, "bo": d.sum(keepdims=True)}
        dp = d[:, None] * p["wo"]
        dw = (s @ dp[:, :, None])[:, :, 0]
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["va"] = np.einsum("ntk,nt->k", a, de)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = s.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATTEND)
        ds = w[:, :, None] * dp[:, None, :] + da @ p["wa"].T
        steps = np.empty((n, t, 2 * h3), np.float32)
        du = np.zeros_like(p["u"])
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            j = t - 1 - i
            dh[0] += ds[:, i, :HIDDEN]
            dh[1] += ds[:, j, HIDDEN:]
            h, hu, r, z, c, m = kept[i]
            dn = dh * m
            dc = dn * (1 - z) * (1 - c * c)
            dz = -dn * (c - h) * z * (1 - z)
            dr = dc * hu[:, :, 2 * HIDDEN:] * r * (1 - r)
            dg = np.concatenate((dr, dz, dc), axis=2)
            dhu = np.concatenate((dr, dz, dc * r), axis=2)
            du += h.transpose(0, 2, 1) @ dhu
            dh = dh - dn * (1 - z) + dhu @ p["u"].transpose(0, 2, 1)
            steps[:, i, :h3], steps[:, j, h3:] = dg[0], dg[1]
        g["u"] = du
        dgates = _sum_rows(at.ravel(), steps.reshape(n * t, -1), rows)
        return g, dgates


def windows_of(n: int) -> list[tuple[int, int]]:
    """First and end word of all overlapping windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(a, a + WINDOW) for a in starts]


def _batch(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window matrix, mask and text number of each window; row 0 stands for no word."""
    at, mask, text = [], [], []
    for d, x in enumerate(ids):
        spans = windows_of(len(x))
        m = np.zeros((len(spans), WINDOW), np.int64)
        if len(x) <= WINDOW:
            m[0, :len(x)] = x
        else:
            m[:] = x[np.array([a for a, _ in spans])[:, None] + np.arange(WINDOW)]
        at.append(m)
        text.append(np.full(len(spans), d))
    at = np.concatenate(at)
    return at, (at > 0).astype(np.float32), np.concatenate(text)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Train on whole texts: a text's logit is the softened maximum over its windows' logits.

    Adaptive steps (squared gradients summed) for weights and embeddings; toxic texts weigh as much as the
    others together. Afterwards the score is placed between the maxima of both kinds.
    """
    net = Network(seed)
    split = [words_of(x) for x in texts]
    use = [i for i, w in enumerate(split) if w and len(texts[i]) <= FIT_CHARS]
    y = np.array(labels, np.float32)
    if not use or len({labels[i] for i in use}) < 2:
        net.shift = 0.0 if any(labels) else 1e3
        return net
    sums = {k: np.full_like(v, 1e-3) for k, v in net.p.items()}
    word_sums, char_sums = np.full(WORD_ROWS, 1e-3, np.float32), np.full(CHAR_ROWS, 1e-3, np.float32)
    weight = np.where(y > 0, (y[use] == 0).sum() / max(1, (y[use] > 0).sum()), 1.0).astype(np.float32)
    weight = np.minimum(weight, 4)
    rng = np.random.default_rng(seed)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(use)))):
        order = rng.permutation(use)
        for start in range(0, len(order), BATCH):
            own = order[start:start + BATCH]
            vocabulary = sorted({w for i in own for w in split[i]})
            number = {w: k + 1 for k, w in enumerate(vocabulary)}
            rows, grams, many, x = net.embed(vocabulary)
            x = np.concatenate((np.zeros((1, x.shape[1]), np.float32), x))
            at, mask, text = _batch([np.array([number[w] for w in split[i]]) for i in own])
            gates = net.project(x)
            z, cache = net.run(gates, at, mask, keep=True)
            top = np.full(len(own), -np.inf, np.float32)
            np.maximum.at(top, text, z)
            e = np.exp(z - top[text])
            total = np.zeros(len(own), np.float32)
            np.add.at(total, text, e)
            logit = top + np.log(total)
            dl = (1 / (1 + np.exp(-logit)) - y[own]) * weight[own] / len(own)
            g, dgates = net.back(at, mask, cache, (dl[text] * e / total[text]).astype(np.float32), len(x))
            g["wx"], g["bx"] = x.T @ dgates, dgates.sum(0)
            dx = (dgates @ net.p["wx"].T)[1:]
            for k, v in g.items():
                sums[k] += v * v
                net.p[k] -= (RATE * v / np.sqrt(sums[k])).astype(np.float32)
            for table, own_sums, r, grad in ((net.words, word_sums, rows, dx[:, :WORD_DIM]), (net.chars, char_sums, grams, np.repeat(dx[:, WORD_DIM:] / GRAMS, many, axis=0))):
                ids, back = np.unique(r, return_inverse=True)
                grad_rows = _sum_rows(back.ravel(), grad, len(ids))
                own_sums[ids] += (grad_rows * grad_rows).sum(1)
                table[ids] -= 4 * RATE * grad_rows / np.sqrt(own_sums[ids])[:, None]
    scorer = Scorer(net)
    best = np.concatenate([scorer.logits(texts[i:i + 200]) for i in range(0, len(texts), 200)])
    toxic, clean = np.sort(best[y > 0]), np.sort(best[y == 0])
    # the cut with the fewest errors on these rows, in the middle of its gap
    cuts = np.unique(np.concatenate((toxic, clean)))
    wrong = np.searchsorted(toxic, cuts) + len(clean) - np.searchsorted(clean, cuts)
    k = int(np.flatnonzero(wrong == wrong.min())[-1])
    net.shift = float((cuts[k] + (cuts[k - 1] if k else cuts[k])) / 2)
    return net


class Scorer:
    """Scores texts with a trained network; projected words are kept between batches up to a bound."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.begin()

    def begin(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        # room for all at once, never copied: pages not written yet take no memory
        self.gates = np.empty((KEPT_WORDS + 1, 6 * HIDDEN), np.float32)
        self.gates[0] = self.net.p["bx"]

    def learn(self, fresh: list[str]) -> None:
        at = len(self.known) + 1
        need = at + len(fresh)
        if need > len(self.gates):
            grown = np.empty((max(need, 2 * len(self.gates)), 6 * HIDDEN), np.float32)
            grown[:at] = self.gates[:at]
            self.gates = grown
        for i in range(0, len(fresh), 20_000):
            part = fresh[i:i + 20_000]
            self.gates[at + i:at + i + len(part)] = self.net.project(self.net.embed(part)[3])
        self.known.update(zip(fresh, range(at, need)))
        self.held += sum(map(len, fresh))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit over all windows of each text."""
        split = [words_of(x) for x in texts]
        wanted = set().union(*split) if split else set()
        fresh = wanted.difference(self.known)
        if len(self.known) + len(fresh) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.begin()
            fresh = wanted
        self.learn(list(fresh))
        get = self.known.__getitem__
        out = np.full(len(texts), -np.inf, np.float32)
        at, mask, text = _batch([np.fromiter(map(get, x), np.int64, len(x)) for x in split]) if split else (np.zeros((0, WINDOW), np.int64),) * 3
        whole = mask.all(axis=1) if len(at) else np.zeros(0, bool)
        half = 3 * HIDDEN
        used, at_used = np.unique(at, return_inverse=True)
        at_used = at_used.reshape(at.shape)
        ahead, behind = (np.ascontiguousarray(self.gates[used, x:x + half]) for x in (0, half))
        for own, full in ((np.flatnonzero(whole), True), (np.flatnonzero(~whole), False)):
            for i in range(0, len(own), CHUNK):
                part = own[i:i + CHUNK]
                z = self.net.quick(ahead, behind, at_used[part]) if full else self.net.run(self.gates, at[part], mask[part])
                np.maximum.at(out, text[part], z)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.net.scale * (self.logits(texts).astype(np.float64) - self.net.shift)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit may read: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Network:
    """Fit on a bounded sample of labelled rows outside the held-out fold, chosen by a hash of the id.

    At most FIT_TOXIC and FIT_CLEAN labelled ids and twice as many rows (the smallest ids, where ids repeat)
    are read, of any length; the weights are trained on those of up to FIT_CHARS characters. Null ids, null
    labels and null or empty texts are no examples; without labels of both kinds every text is scored alike,
    as clean where none is toxic.
    """
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    picked = [chosen.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    ids = picked[0].union(picked[1])  # FIT_TOXIC + FIT_CLEAN rows at most
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0).join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(2 * (FIT_TOXIC + FIT_CLEAN)).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


_SCORERS: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text by the largest logit over all its overlapping windows.

    Null and blank texts are scored as a window without words; very long ones take more windows, in chunks
    of CHUNK. Null and repeated ids pass through; an empty
    table gives an empty one; other columns are ignored. Returns doc_id, held_out, score, predicted.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    name = f"{shared.__reduce__()[1][0]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        own = _SCORERS[name]
        for batch in batches:
            for a, b in byte_groups(batch, "text", GROUP_BYTES):
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(own.scores(batch.column("text").slice(a, b - a).to_pylist()))], ["doc_id", "score"])

    scored = map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows whose text is predicted clean, all columns kept; nothing is shuffled.

    Null and blank texts are scored as a window without words; null and repeated ids, and columns of any
    name, pass through; an empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in batches:
            for a, b in byte_groups(batch, text, GROUP_BYTES):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(own.scores(part.column(text).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
