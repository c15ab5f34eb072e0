"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import HASH_BASE, SLICE_ROWS, Powers, crc_fold, extend, hash_share
from earwitness.session import cut_lineage


@dataclass(frozen=True)
class ToxicityParams:
    """Sizes of the network and bounds of the fit; only the fit takes a sample, of labelled documents."""

    sample_rows: int = 6_000
    sample_parts: int = 24
    folds: int = 5
    held_out: int = 0
    window: int = 24
    stride: int = 12
    vocabulary: int = 8_192
    least_documents: int = 3
    char_rows: int = 1 << 15
    word_size: int = 8
    char_size: int = 12
    hidden: int = 10
    attention: int = 8
    windows_each: int = 3
    rounds: int = 3
    steps: int = 160
    batch: int = 384
    rate: float = 0.02
    decay: float = 1e-4
    dropout: float = 0.2
    calibration_share: float = 0.2
    accept: float = 0.5
    seed: int = 5


PARAMS = ToxicityParams()
#: Character features of a word: beginnings of these lengths (and whether more follows), and ends.
BEGINNINGS, ENDINGS = range(2, 9), (3, 4)
FEATURES = len(BEGINNINGS) + len(ENDINGS) + 1
#: Words a task keeps its projections of, and windows it runs through the network at once.
MEMO_WORDS, WINDOWS_AT_ONCE = 50_000, 512
#: Words whose projections are made at once.
WORDS_AT_ONCE = 4_096
#: Rows of one matrix product.
SMALL_ROWS = 256


def plain(chunk: str) -> str:
    """A word as the network reads it: lower case, without signs at its ends."""
    word = chunk.lower()
    if word.isalnum():
        return word
    at, to = 0, len(word)
    while at < to and not word[at].isalnum():
        at += 1
    while to > at and not word[to - 1].isalnum():
        to -= 1
    return word[at:to]


def char_features(words: list[str], rows: int, powers: Powers) -> np.ndarray:
    """Rows of the words' character features, the last row (all zero) where a word has fewer."""
    sizes = np.array([len(x) for x in words], np.int64)
    sums = powers.sums(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32))
    end = np.cumsum(sizes)
    start, kinds = end - sizes, [np.minimum(sizes, 16).astype(np.uint64)]
    none = np.uint64(0)
    for n in BEGINNINGS:
        at = np.minimum(start + n, end)
        kinds.append(np.where(sizes >= n, powers.hashes(sums, start, at) ^ np.where(sizes > n, np.uint64(n), np.uint64(n + 64)), none))
    for n in ENDINGS:
        at = np.maximum(end - n, start)
        kinds.append(np.where(sizes > n, powers.hashes(sums, at, end) ^ np.uint64(n + 128), none))
    hashed = np.stack(kinds, 1)
    mixed = (hashed ^ (hashed >> np.uint64(31))) * HASH_BASE
    return np.where(hashed == none, rows, ((mixed >> np.uint64(20)) % np.uint64(rows)).astype(np.int64))


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` in products so small that the linear algebra library keeps to the task's own core."""
    if len(x) <= SMALL_ROWS:
        return x @ w
    whole = len(x) // SMALL_ROWS * SMALL_ROWS
    first = x[:whole].reshape(-1, SMALL_ROWS, x.shape[1]) @ w
    return np.concatenate([first.reshape(whole, -1), x[whole:] @ w])


def _outer(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """``x.T @ g``, likewise."""
    whole = len(x) // SMALL_ROWS * SMALL_ROWS
    cut = lambda a: a[:whole].reshape(-1, SMALL_ROWS, a.shape[1])
    return (cut(x).transpose(0, 2, 1) @ cut(g)).sum(0) + x[whole:].T @ g[whole:]


def spans(n: int, p: ToxicityParams) -> np.ndarray:
    """Where the windows of a text of ``n`` words begin: every ``stride`` words until one reaches the end; one if it is short."""
    return np.arange(0, max(1, n - p.window + p.stride), p.stride)


@dataclass(frozen=True)
class Network:
    """Weights by name; directions stand side by side in the gate weights (forward, backward)."""

    words: dict[str, int]
    w: dict[str, np.ndarray]
    bias: float = 0.0
    scale: float = 1.0

    def inputs(self, words: list[str], powers: Powers) -> np.ndarray:
        """Word vector and mean of the character vectors of each word."""
        rows = len(self.w["chars"]) - 1
        known = np.array([self.words.get(x, 0) for x in words], np.int64)
        chars = char_features(words, rows, powers)
        return np.concatenate([self.w["words"][known], self.w["chars"][chars].mean(1)], 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(words: dict[str, int], p: ToxicityParams) -> Network:
    """Vectors begin at zero, so that what the fit has not seen says nothing."""
    rng = np.random.default_rng(p.seed)
    x, h = p.word_size + p.char_size, p.hidden
    deal = lambda *size: (rng.normal(0, 1, size) / np.sqrt(size[-2])).astype(np.float32)
    w = {"words": np.zeros((len(words) + 1, p.word_size), np.float32), "chars": np.zeros((p.char_rows + 1, p.char_size), np.float32),
         "wx": 2 * deal(2, x, 3 * h), "bx": np.zeros((2, 3 * h), np.float32), "wz": deal(2, h, 2 * h), "wn": deal(2, h, h),
         "wa": deal(2 * h, p.attention), "ba": np.zeros(p.attention, np.float32), "va": deal(p.attention, 1), "wo": deal(2 * h, 1), "bo": np.full(1, -1.0, np.float32)}
    return Network(words, w)


def forward(w: dict[str, np.ndarray], gates: np.ndarray, mask: np.ndarray, trace: bool = False):
    """Logits of windows from their input gates ``(2, time, window, 3 hidden)``; masked places leave the state as it is.

    z (how much stays) and r (what of the past is read) are the gates of each
    direction, n the new state; attention weighs the states of all places.
    """
    _, steps, size, wide = gates.shape
    h = wide // 3
    states = np.zeros((2, steps, size, h), np.float32)
    kept = []
    for side in (0, 1):
        state = np.zeros((size, h), np.float32)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            g, here = gates[side, t], mask[t][:, None]
            zr = _sigmoid(g[:, : 2 * h] + state @ w["wz"][side])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h :] + (r * state) @ w["wn"][side])
            after = np.where(here, z * state + (1 - z) * n, state)
            if trace:
                kept.append((side, t, state, z, r, n))
            states[side, t] = state = after
    both = np.concatenate([states[0], states[1]], 2)
    u = np.tanh(both @ w["wa"] + w["ba"])
    score = np.where(mask, (u @ w["va"])[..., 0], -1e9)
    a = np.exp(score - score.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, both)
    logit = (pooled @ w["wo"])[:, 0] + w["bo"][0]
    return (logit, (kept, both, u, a, pooled)) if trace else logit


def backward(w: dict[str, np.ndarray], mask: np.ndarray, traced, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights and of the input gates, for ``error`` = d loss / d logit."""
    kept, both, u, a, pooled = traced
    h = both.shape[2] // 2
    grads = {"wo": pooled.T @ error[:, None], "bo": error.sum(keepdims=True)}
    d_pooled = error[:, None] * w["wo"][:, 0]
    d_a = np.einsum("bh,tbh->tb", d_pooled, both)
    d_score = np.where(mask, a * (d_a - (a * d_a).sum(0)), 0)
    d_u = d_score[..., None] * w["va"][:, 0] * (1 - u * u)
    grads["va"] = np.einsum("tbk,tb->k", u, d_score)[:, None]
    grads["wa"], grads["ba"] = np.einsum("tbh,tbk->hk", both, d_u), d_u.sum((0, 1))
    d_both = a[..., None] * d_pooled + d_u @ w["wa"].T
    d_gates = np.zeros((2, *mask.shape, 3 * h), np.float32)
    grads["wz"], grads["wn"] = np.zeros_like(w["wz"]), np.zeros_like(w["wn"])
    carry = [np.zeros_like(both[0, :, :h]) for _ in (0, 1)]
    for side, t, state, z, r, n in reversed(kept):
        out = d_both[t, :, side * h : (side + 1) * h] + carry[side]
        here = mask[t][:, None]
        live = np.where(here, out, 0)
        d_n = live * (1 - z) * (1 - n * n)
        d_z = live * (state - n) * z * (1 - z)
        back = d_n @ w["wn"][side].T
        d_r = back * state * r * (1 - r)
        zr = np.concatenate([d_z, d_r], 1)
        d_gates[side, t] = np.concatenate([zr, d_n], 1)
        grads["wz"][side] += state.T @ zr
        grads["wn"][side] += (r * state).T @ d_n
        carry[side] = live * z + back * r + zr @ w["wz"][side].T + np.where(here, 0, out)
    return grads, d_gates


def _gates(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Input gates of both directions for rows of inputs."""
    return np.stack([_times(x, w["wx"][s]) + w["bx"][s] for s in (0, 1)])


def train(net: Network, texts: list[list[str]], y: np.ndarray, p: ToxicityParams) -> Network:
    """Adam on windows (lists of words) and their labels; half of each batch has label 1."""
    rng = np.random.default_rng(p.seed)
    names = sorted({x for t in texts for x in t})
    at = {x: i for i, x in enumerate(names)}
    rows = p.char_rows
    known = np.array([net.words.get(x, 0) for x in names], np.int64)
    chars = char_features(names, rows, Powers())
    ids = np.zeros((len(texts), p.window), np.int64)
    mask = np.zeros((len(texts), p.window), bool)
    for i, t in enumerate(texts):
        ids[i, : len(t)], mask[i, : len(t)] = [at[x] for x in t], True
    w = {k: v.copy() for k, v in net.w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in (0, 1))
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, p.steps + 1):
        pick = np.concatenate([rng.choice(c, p.batch // 2) for c in classes])
        used, place = np.unique(ids[pick], return_inverse=True)
        place, here = place.reshape(len(pick), -1).T, mask[pick].T
        lives = (rng.random((len(used), 2)) >= p.dropout).astype(np.float32) / (1 - p.dropout)
        x = np.concatenate([w["words"][known[used]] * lives[:, :1], w["chars"][chars[used]].mean(1) * lives[:, 1:]], 1)
        logit, traced = forward(w, _gates(w, x)[:, place], here, trace=True)
        error = ((_sigmoid(logit) - y[pick]) / len(pick)).astype(np.float32)
        grads, d_gates = backward(w, here, traced, error)
        flat = place.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        summed = [np.add.reduceat(d_gates[s].reshape(len(flat), -1)[order], starts) for s in (0, 1)]
        grads["wx"] = np.stack([_outer(x, g) for g in summed])
        grads["bx"] = np.stack([g.sum(0) for g in summed])
        d_x = sum(_times(g, w["wx"][s].T) for s, g in enumerate(summed))
        grads["words"], grads["chars"] = np.zeros_like(w["words"]), np.zeros_like(w["chars"])
        np.add.at(grads["words"], known[used], d_x[:, : p.word_size] * lives[:, :1])
        np.add.at(grads["chars"], chars[used].ravel(), np.repeat(d_x[:, p.word_size :] * lives[:, 1:] / FEATURES, FEATURES, 0))
        grads["words"][0], grads["chars"][rows] = 0, 0
        rate = p.rate * (1 - 0.9 * step / p.steps)
        for k, g in grads.items():
            g = g + p.decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(net.words, w)


class Reader:
    """Runs texts through a network: projections of words are kept, windows go in blocks of bounded size."""

    def __init__(self, net: Network, p: ToxicityParams) -> None:
        self.net, self.p = net, p
        self.at: dict[str, int] = {}
        self.powers = Powers()
        self.gates = np.zeros((2, MEMO_WORDS, 3 * p.hidden), np.float32)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        new = list(set(chunks).difference(self.at))
        if len(self.at) + len(new) > self.gates.shape[1]:
            self.at, new = {}, list(set(chunks))
            if len(new) > self.gates.shape[1]:
                self.gates = np.zeros((2, len(new), self.gates.shape[2]), np.float32)
        if new:
            old = len(self.at)
            self.at.update(zip(new, range(old, old + len(new)), strict=True))
            for k in range(0, len(new), WORDS_AT_ONCE):
                part = new[k : k + WORDS_AT_ONCE]
                self.gates[:, old + k : old + k + len(part)] = _gates(self.net.w, self.net.inputs([plain(x) for x in part], self.powers))
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))

    def windows(self, chunks: list[str]) -> np.ndarray:
        """The logit of every window of a text, in order."""
        ids, begins, p = self._numbers(chunks), spans(len(chunks), self.p), self.p
        out = []
        for k in range(0, len(begins), WINDOWS_AT_ONCE):
            places = begins[k : k + WINDOWS_AT_ONCE] + np.arange(p.window)[:, None]
            mask = places < len(ids)
            out.append(forward(self.net.w, self.gates[:, ids[np.minimum(places, len(ids) - 1)]], mask))
        return np.concatenate(out)

    def texts(self, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
        """Words and window logits of each text; texts go through the network together until a block is full."""
        chunks = [t.split() if t else [] for t in texts]
        logits: list[np.ndarray] = [np.zeros(0, np.float32)] * len(chunks)
        group, size = [], 0
        for i, words in enumerate(chunks):
            count = len(spans(len(words), self.p)) if words else 0
            if group and size + count > WINDOWS_AT_ONCE:
                self._together(chunks, group, logits)
                group, size = [], 0
            if count > WINDOWS_AT_ONCE:
                logits[i] = self.windows(words)
            elif count:
                group.append(i)
                size += count
        if group:
            self._together(chunks, group, logits)
        return chunks, logits

    def _together(self, chunks: list[list[str]], group: list[int], logits: list[np.ndarray]) -> None:
        ids = self._numbers([x for i in group for x in chunks[i]])
        sizes = np.array([len(chunks[i]) for i in group])
        begins = [spans(n, self.p) for n in sizes]
        counts = [len(b) for b in begins]
        ends = np.repeat(np.cumsum(sizes), counts)
        places = np.concatenate([b + s for b, s in zip(begins, np.cumsum(sizes) - sizes, strict=True)]) + np.arange(self.p.window)[:, None]
        found = forward(self.net.w, self.gates[:, ids[np.minimum(places, ends - 1)]], places < ends)
        for i, part in zip(group, np.split(found, np.cumsum(counts)[:-1]), strict=True):
            logits[i] = part

    def score(self, logits: np.ndarray) -> float:
        """A text is as toxic as its worst window; one without words has the score of no evidence."""
        worst = float(logits.max()) if len(logits) else float(self.net.w["bo"][0]) - 4
        return float(_sigmoid((worst - self.net.bias) * self.net.scale))


def _features(batches, p: ToxicityParams):
    """``y, feature`` for each distinct feature of a document; what it is told apart by stays in the task."""
    for batch in (whole.slice(k, SLICE_ROWS // 4) for whole in batches for k in range(0, whole.num_rows, SLICE_ROWS // 4)):
        ys, fs = [], []
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = set()
            for word in {plain(x) for x in text.split()} - {""} if text else ():
                found.add(f"w{word[:64]}")
                found.update(f"p{word[:n]}" for n in BEGINNINGS if len(word) > n > 3)
            fs.extend(found)
            ys.extend([y] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(fs, pa.string())], names=["y", "feature"])


def _first_windows(weights, p: ToxicityParams):
    """Windows that hold the words most typical of label 1, before there is a network."""

    def make(batch):
        chosen = []
        for text in batch.column("text").to_pylist():
            words = [plain(x) for x in text.split()] if text else []
            value = np.array([max([weights.value.get(f"w{w[:64]}", 0.0), *(weights.value.get(f"p{w[:n]}", 0.0) for n in BEGINNINGS if len(w) > n > 3)]) for w in words])
            begins = spans(len(words), p) if words else np.zeros(0, int)
            worth = np.array([value[b : b + p.window].max() for b in begins])
            chosen.append(_chosen(words, begins, worth, p))
        return {"windows": chosen, "top": [0.0] * len(chosen)}

    return make


def _chosen(words: list[str], begins: np.ndarray, worth: np.ndarray, p: ToxicityParams) -> list[list[str]]:
    """The windows of most worth and, spread over the text, as many others."""
    if not len(begins):
        return []
    best = np.argsort(-worth, kind="stable")[: p.windows_each].tolist()
    spread = np.linspace(0, len(begins) - 1, p.windows_each).astype(int).tolist()
    return [words[begins[k] : begins[k] + p.window] for k in dict.fromkeys(best + spread)]


def _network_windows(net, p: ToxicityParams):
    reader = Reader(net.value, p)

    def make(batch):
        chunks, logits = reader.texts(batch.column("text").to_pylist())
        return {"windows": [_chosen([plain(x) for x in c], spans(len(c), p) if c else np.zeros(0, int), x, p) for c, x in zip(chunks, logits, strict=True)], "top": [float(x.max()) if len(x) else -9.0 for x in logits]}

    return make


def _calibrated(net: Network, top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Bias and slope of the worst window's logit with the smallest log loss, by Newton steps held back by a weak prior."""
    if len(set(y.tolist())) < 2:
        return net
    mean, spread = top.mean(), top.std() + 1e-6
    x = np.stack([(top - mean) / spread, np.ones(len(top))], 1)
    weight, theta = weight / weight.mean(), np.array([1.0, 0.0])
    for _ in range(60):
        q = _sigmoid(x @ theta)
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (weight * (q - y)) + 0.5 * (theta - [1.0, 0.0]))
        theta = theta - step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
    slope = max(theta[0], 1e-3) / spread
    return replace(net, scale=float(slope), bias=float(mean - theta[1] / slope))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", params: ToxicityParams = PARAMS) -> Network | None:
    """A network from labelled documents outside the held-out fold; None without both labels.

    About ``sample_rows`` documents, half of each label where there are as many, are
    picked by the hash of their id; the rest of the fit sees their whole texts. A label
    stands on a document and not on a window, so windows are chosen: first those
    with words typical of label 1, then, round by round, those that the network
    finds worst, in documents of both labels, and some others. Documents set
    aside by hash calibrate the score. Null ids and labels are ignored; an id with
    several labels has the largest.
    """
    p = params
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (crc_fold("id", p.folds) != p.held_out))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = {c: min(1.0, p.sample_rows / 2 / sizes[c]) for c in (0, 1)}
    picked = usable.where(hash_share(F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])), "id"))
    rows = docs.select(F.col(id_col).alias("id"), "text").where(hash_share(F.lit(max(share.values())), "id") & (crc_fold("id", p.folds) != p.held_out))
    aside = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(1000)) < int(1000 * p.calibration_share)
    sample = cut_lineage(rows.join(picked, "id").select("id", "y", "text", aside.alias("aside")).repartition(p.sample_parts, F.xxhash64("id", "text")))

    counted = sample.where("not aside").mapInArrow(partial(_features, p=p), "y int, feature string").groupBy("feature").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    counted = cut_lineage(counted.where((F.col("n") >= p.least_documents) & (F.col("bad") > 0)))
    by_label = {r.y: r["count"] for r in sample.where("not aside").groupBy("y").count().collect()}
    odds = F.sqrt("bad") * (F.log((F.col("bad") + 0.5) / by_label.get(1, 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / by_label.get(0, 1)))
    typical = counted.select("feature", "n", odds.alias("odds")).orderBy(F.desc("odds"), "feature").limit(p.vocabulary).collect()
    words = {f[1:]: i for i, f in enumerate((r.feature for r in typical if r.feature.startswith("w")), 1)}
    net = initial(words, p)

    send = sample.sparkSession.sparkContext.broadcast
    shape = "windows array<array<string>>, top double"
    chosen = extend(sample, partial(_first_windows, send({r.feature: max(0.0, r.odds) for r in typical}), p), shape, ["id", "y", "aside"])
    for k in range(p.rounds):
        seen = sorted(chosen.where("not aside").select("id", "y", "__out.windows").collect(), key=lambda r: (str(r.id), r.y, str(r.windows[:1])))
        y = np.array([r.y for r in seen for _ in range(_count(r))], np.float32)
        texts = [w for r in seen for w in r.windows[: _count(r)]]
        if len(set(y.tolist())) < 2:
            return None
        net = train(net, texts, y, replace(p, seed=p.seed + k))
        chosen = cut_lineage(extend(sample, partial(_network_windows, send(net), p), shape, ["id", "y", "aside"]))
    tops = chosen.select("y", "aside", "__out.top").collect()
    held = [r for r in tops if r.aside] if len({r.y for r in tops if r.aside}) == 2 else tops
    y = np.array([r.y for r in held])
    return _calibrated(net, np.array([r.top for r in held]), y, np.where(y == 1, 1 / share[1], 1 / share[0]))


def _count(row) -> int:
    """Of a toxic document only the worst window is taken to be so; of another document all windows are clean."""
    return min(1, len(row.windows)) if row.y else len(row.windows)


def _scorer(net, p: ToxicityParams):
    reader = Reader(net.value, p) if net is not None else None

    def make(batch):
        if reader is None:
            return {"score": [0.0] * batch.num_rows, "windows": [0] * batch.num_rows}
        _, logits = reader.texts(batch.column("text").to_pylist())
        return {"score": [reader.score(x) for x in logits], "windows": [len(x) for x in logits]}

    return make


def scored(docs: DataFrame, net: Network | None, keep: list[str], params: ToxicityParams = PARAMS) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``__out.score`` (the calibrated probability of label 1) and ``__out.windows`` (how many were read), of every whole text.

    Every window of every text is read. A null or empty text has no window and the
    score of no evidence; without a network every score is 0. Rows stay rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net) if net is not None else None
    return extend(docs, partial(_scorer, sent, params), "score double, windows int", keep)
