"""Language-model scoring with a gated recurrent network.

A GRU reads a text word by word and gives every next token a probability, the
end of the text included. The output is class-factored: first a softmax over
classes, then over the words of the class. The most frequent words have neural
classes; all other words are in classes by their spelling (first two and last
byte), inside which a word has its smoothed unigram share. So every word, also
an unseen one, gets a probability, and the model starts out as the unigram base.

Counts, vocabulary and class masses come from all training texts, as Spark
aggregations. Training is truncated back-propagation in numpy over all training
texts, in rounds of local updates: a round takes a hashed slice of the texts
(all of them once over the rounds) and deals it by hash into units of about
``UNIT`` tokens. One task trains on one unit, in an order by hash, from the
common weights, and the weights are averaged by tokens. Units follow from the
texts alone, so the input's partitions do not change the model. Scoring carries
the state across windows from a text's first token to its end.

Counts are keyed by 64-bit word hashes. The words above a count threshold that
leaves at most ``KNOWN`` of them are broadcast; the counts of all others come
by a join.

Defined results: null texts are empty (one token, the end); repeated rows are
scored each; without training rows every count is 0 and the model is flat.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptscreen.llm.common import RATIO, Words, batch, column, mix, store, text_chunks, total_vectors

KNOWN = 1 << 20             # words broadcast with their counts: 16 MB
SLOTS, NEURAL = 64, 16      # words of a neural class; neural classes
SPELLED = 48                # classes by spelling
HIDDEN = 24
WINDOW = 16                 # steps of truncated back-propagation
#: Rounds: (slices of 32 from, to), lanes, learning rate.
ROUNDS = ((0, 1, 32, 0.02), (1, 4, 64, 0.01), (4, 32, 192, 0.005))
UNIT = 1_000_000            # training tokens of a unit of work, about
SCORE_TOKENS = 3_000_000    # tokens scored together in a Python worker
SCORE_WINDOW = 32
SIDE = 2048                 # texts scored side by side: their states fit the cache
SLICE = 1 << 14             # tokens scored together
BLOCK = 1 << 11             # tokens whose class scores fit the cache
END = 0x5E4DE4D5E4DE4D51    # the hash of the end token
LN10 = float(np.log(10))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Tokens(Words):
    """The words of some texts, found and hashed without a Python object each:
    this operator reads all texts several times."""

    def __init__(self, texts):
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        self.raw = b" ".join(parts) + b" "
        self.buf = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate([[False], ~IS_SPACE[self.buf]]).view(np.int8)
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
        self.doc = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.counts = np.diff(self.doc)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, from eight bytes at a time."""
        left = self.end - self.start
        eight = np.ndarray(len(self.raw), "<u8", self.raw + bytes(8), strides=(1,))
        with np.errstate(over="ignore"):
            h = left.astype(np.uint64) * RATIO
            h = mix(h ^ (eight[self.start] & LOW_BYTES[np.minimum(left, 8)]))
            rows = np.flatnonzero(left > 8)
            at, left = self.start[rows] + 8, left[rows] - 8
            while len(rows):
                h[rows] = mix(h[rows] ^ (eight[at] & LOW_BYTES[np.minimum(left, 8)]))
                more = left > 8
                rows, at, left = rows[more], at[more] + 8, left[more] - 8
        return h


def spelled(w: Words, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Spelling class of each word, or of those ``at`` some places."""
    start, end = w.start[at], w.end[at]
    first, last = w.buf[start].astype(np.uint32), w.buf[end - 1].astype(np.uint32)
    second = np.where(end - start > 1, w.buf[np.minimum(start + 1, max(0, len(w.buf) - 1))], 32).astype(np.uint32)
    mixed = first * np.uint32(0x9E3779B1) ^ second * np.uint32(0x85EBCA6B) ^ last * np.uint32(0xC2B2AE35)
    return ((mixed >> np.uint32(12)) % np.uint32(SPELLED)).astype(np.int64)


# ------------------------------------------------------------------- counts ----
def _count(batches):
    """(h, cls, c) of the task's texts, the end counted once per text."""
    keys, cls, counts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    held: list = []
    size = 0

    def merged():
        k = np.concatenate([keys, *(x[0] for x in held)])
        order = np.argsort(k, kind="stable")
        k, s = k[order], np.concatenate([cls, *(x[1] for x in held)])[order]
        n = np.concatenate([counts, *(x[2] for x in held)])[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        return k[new], s[new], np.add.reduceat(n, new) if len(new) else n

    def rows(k, s, n):
        return batch(h=pa.array(k.view(np.int64)), cls=pa.array(s.astype(np.int32)), c=pa.array(n))

    for rb in text_chunks(batches, "t"):
        w = Tokens(column(rb, "t").to_pylist())
        ends += rb.num_rows
        if len(w):
            k, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
            held.append((k, spelled(w, first), n))
            size += len(k)
        if size > 1 << 20:
            keys, cls, counts = merged()
            held, size = [], 0
            if len(keys) > 1 << 21:                 # bounded memory: the rest is summed after the shuffle
                yield rows(keys, cls, counts)
                keys, cls, counts = keys[:0], cls[:0], counts[:0]
    keys, cls, counts = merged()
    if len(keys):
        yield rows(keys, cls, counts)
    yield batch(h=pa.array([END], pa.int64()), cls=pa.array([-1], pa.int32()), c=pa.array([ends], pa.int64()))


@dataclass
class Vocabulary:
    tokens: int                 # N
    types: int                  # V
    known: np.ndarray           # sorted hashes of the broadcast words
    log_c: np.ndarray           # log10(c + 0.5) of each
    head: np.ndarray            # sorted hashes of the neural words
    place: np.ndarray           # number of each: class * SLOTS + slot
    head_c: np.ndarray          # counts by number
    log_mass: np.ndarray        # log10 of the mass of each spelling class
    share: np.ndarray           # probability of each class under the unigram base

    @property
    def classes(self):
        return -(-len(self.head) // SLOTS)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``(h, cls, c)``, one row per word."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    steps = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).limit(KNOWN).collect()), reverse=True)
    least, room = 0, KNOWN
    for c, n in steps:                              # the lowest count that leaves at most KNOWN words
        if n > room:
            break
        least, room = c, room - n
    pack = np.dtype([("h", "<u8"), ("c", "<i8"), ("s", "<i4")])

    def packed(batches):
        for rb in batches:
            out = np.zeros(rb.num_rows, pack)
            out["h"], out["c"], out["s"] = column(rb, "h").to_numpy().view(np.uint64), column(rb, "c").to_numpy(), column(rb, "cls").to_numpy()
            yield batch(b=pa.array([out.tobytes()], pa.binary()))

    top = counts.filter((F.col("c") >= least) | (F.col("h") == END)) if least else counts.filter(F.col("h") == END)
    blobs = [r[0] for r in top.select("h", "cls", "c").mapInArrow(packed, "b binary").toLocalIterator()]
    known = np.sort(np.frombuffer(b"".join(blobs), pack), order="h")
    mass = np.full(SPELLED, 0.5)
    for r in counts.filter("cls >= 0").groupBy("cls").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        mass[r["cls"]] += r["m"]
    words = known[known["h"] != np.uint64(END)]
    order = np.lexsort((words["h"], -words["c"]))[:NEURAL * SLOTS - 1]
    end_c = int(known["c"][known["h"] == np.uint64(END)].sum())
    head_h, head_c = np.concatenate([[np.uint64(END)], words["h"][order]]), np.concatenate([[end_c], words["c"][order]]).astype(np.int64)
    np.subtract.at(mass, words["s"][order], words["c"][order] + 0.5)
    mass = np.maximum(mass, 0.5)
    place = np.argsort(np.lexsort((head_h, -head_c)))       # classes of like frequency
    by_place = np.zeros(len(place), np.int64)
    by_place[place] = head_c
    sort = np.argsort(head_h)
    n_class = -(-len(head_h) // SLOTS)
    share = np.concatenate([np.add.reduceat(by_place + 0.5, np.arange(0, len(by_place), SLOTS))[:n_class], mass])
    return Vocabulary(int(total), int(types), known["h"].copy(), np.log10(known["c"] + 0.5), head_h[sort], place[sort], by_place,
                      np.log10(mass), share / share.sum())


def found(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where each of ``h`` stands in the sorted hashes ``head``, -1: nowhere. The
    first 16 bits of a hash tell where to look."""
    cut = np.searchsorted(head, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
    at = np.take(cut, h >> np.uint64(48))
    out = np.full(len(h), -1, np.int64)
    for _ in range(int(np.diff(cut, append=len(head)).max())):
        near = np.minimum(at, len(head) - 1)
        np.copyto(out, near, where=np.take(head, near) == h)
        at += 1
    return out


def numbers(w: Words, h: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Model input number of each word: a neural word's own, else its class's."""
    at = found(h, v.head)
    out = np.take(v.place, at).astype(np.int32)         # -1: any
    rest = np.flatnonzero(at < 0)
    out[rest] = v.classes * SLOTS + spelled(w, rest)
    return out


# -------------------------------------------------------------------- model ----
def shapes(v: Vocabulary) -> dict[str, tuple]:
    n, k = v.classes, HIDDEN
    return {"a": (n * SLOTS + SPELLED, 3 * k), "u": (k, 3 * k), "wc": (k, n + SPELLED), "bc": (n + SPELLED,), "wo": (n, k, SLOTS), "bo": (n, SLOTS)}


def start_weights(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(v).items()}
    p["u"] = (rng.standard_normal(p["u"].shape) / np.sqrt(HIDDEN)).astype(np.float32)
    p["wc"] *= 0.1
    p["wo"] *= 0.1
    p["bc"] = np.log(v.share).astype(np.float32)
    bo = np.full(v.classes * SLOTS, -30.0)
    bo[:len(v.head_c)] = np.log(v.head_c + 0.5)
    p["bo"] = bo.reshape(v.classes, SLOTS).astype(np.float32)
    return p


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)


def unflat(x: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in sorted(shapes(v).items()):
        n = int(np.prod(s))
        out[k] = x[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


def step(a, ut, h):
    """One GRU step of texts side by side, a column each (so every operation runs over
    contiguous rows): the new state and what back-propagation needs. ``a`` are the
    inputs, ``ut`` the recurrent weights, by output."""
    k = HIDDEN
    hu = ut @ h
    zr = hu[:2 * k]
    zr += a[:2 * k]
    np.exp(np.negative(zr, out=zr), out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r, hun = hu[:k], hu[k:2 * k], hu[2 * k:]
    n = r * hun
    n += a[2 * k:]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (z, r, n, hun)


def cell(p, number, h):
    """:func:`step` of tokens ``number`` with a state per row."""
    new, saved = step(np.take(p["a"], number, 0).T, p["u"].T, h.T)
    return new.T, tuple(x.T for x in saved)


def _softmax(w, b, h, at, want_grad):
    """Log softmax of ``w.T h + b`` at ``at``, one per row of ``h``, and its slope
    (a column per row of ``h``) if wanted."""
    x = w.T @ h.T
    x += b[:, None]
    x -= x.max(0)
    rows = np.arange(len(at))
    out = x[at, rows]
    np.exp(x, out=x)
    total = x.sum(0)
    out -= np.log(total)
    if not want_grad:
        return out, None
    x *= -1 / total
    x[at, rows] += 1
    return out, x


def log_probs(p, h, y, n_class, want_grad=False):
    """Natural log probability of tokens ``y`` in states ``h`` (up to the
    in-class share of spelled classes), and gradients if wanted."""
    neural = y < n_class * SLOTS
    cls = np.where(neural, y // SLOTS, y - n_class * SLOTS + n_class).astype(np.int16)
    order = np.argsort(cls, kind="stable")              # a class's tokens lie together
    h, y, cls = np.take(h, order, 0), y[order], cls[order]
    out = np.empty(len(y), h.dtype)
    if want_grad:
        g, dh = {name: np.zeros_like(p[name]) for name in ("wc", "bc", "wo", "bo")}, np.empty_like(h)
    for i in range(0, len(y), BLOCK):
        s = slice(i, i + BLOCK)
        out[s], d = _softmax(p["wc"], p["bc"], h[s], cls[s], want_grad)
        if want_grad:
            g["wc"] += h[s].T @ d.T
            g["bc"] += d.sum(1)
            dh[s] = d.T @ p["wc"].T
    edge = np.searchsorted(cls, np.arange(n_class + 1))
    for k in range(n_class):
        s = slice(edge[k], edge[k + 1])
        if s.start == s.stop:
            continue
        more, d = _softmax(p["wo"][k], p["bo"][k], h[s], y[s] % SLOTS, want_grad)
        out[s] += more
        if want_grad:
            g["wo"][k], g["bo"][k] = h[s].T @ d.T, d.sum(1)
            dh[s] += d.T @ p["wo"][k].T
    back = np.empty_like(out)
    back[order] = out
    if not want_grad:
        return back
    dh_back = np.empty_like(h)
    dh_back[order] = dh
    return back, g, dh_back


def sums_by(keys, rows):
    """The distinct keys and the sum of the rows of each."""
    order = np.argsort(keys.astype(np.uint16) if keys.max() < 1 << 16 else keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.add.reduceat(np.take(rows, order, 0), first)


class Trainer:
    """Truncated back-propagation with Adam steps over one stream of tokens."""

    def __init__(self, p: dict, n_class: int, end: int, rate: float, lanes: int):
        self.p, self.n_class, self.end, self.rate, self.lanes = p, n_class, end, rate, lanes
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}
        self.steps, self.tokens = 0, 0

    def feed(self, stream: np.ndarray):
        """Cut the stream (texts one after another, each with its end) into
        lanes side by side and train on their windows; states restart at ends."""
        lanes = max(1, min(self.lanes, len(stream) // WINDOW))
        length = -(-len(stream) // lanes)
        y = np.full(lanes * length, -1, np.int64)
        y[:len(stream)] = stream
        y = y.reshape(lanes, length)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            h = self._window(y[:, t:t + WINDOW], h)
        self.tokens += len(stream)

    def _window(self, y, h):
        p, steps, k = self.p, y.shape[1], HIDDEN
        lanes = len(h)
        ys = y.T.ravel()
        number = np.maximum(ys, 0)
        a, ut = np.take(p["a"], number, 0), np.ascontiguousarray(p["u"].T)
        keeps = ((ys != self.end) & (ys >= 0)).astype(np.float32).reshape(steps, lanes)
        states, saved, h = [], [], np.ascontiguousarray(h.T)
        for t in range(steps):
            states.append(h)
            new, save = step(a[t * lanes:(t + 1) * lanes].T, ut, h)
            saved.append(save)
            h = new * keeps[t]
        before = np.concatenate([x.T for x in states])  # a row per token, window step after step
        live = ys >= 0
        n = max(1, int(live.sum()))
        if n == len(ys):
            _, g, d_out = log_probs(p, before, ys, self.n_class, True)
        else:
            _, g, d_live = log_probs(p, before[live], ys[live], self.n_class, True)
            d_out = np.zeros((len(ys), k), before.dtype)
            d_out[live] = d_live
        da, dhu = np.empty((len(ys), 3 * k), before.dtype), np.empty((3 * k, lanes), before.dtype)
        dh, du = np.zeros_like(h), np.zeros_like(p["u"])
        for t in range(steps - 1, -1, -1):
            z, r, nn, hun = saved[t]
            at = slice(t * lanes, (t + 1) * lanes)
            dh *= keeps[t]
            rest = 1 - z
            dz = np.subtract(states[t], nn, out=dhu[:k])
            dz *= z
            dz *= rest
            dz *= dh
            dn = nn * nn
            np.subtract(1, dn, out=dn)
            dn *= rest
            dn *= dh
            dr = np.subtract(1, r, out=dhu[k:2 * k])
            dr *= r
            dr *= hun
            dr *= dn
            da[at, :2 * k], da[at, 2 * k:] = dhu[:2 * k].T, dn.T
            np.multiply(dn, r, out=dhu[2 * k:])
            du += states[t] @ dhu.T
            dh *= z
            dh += p["u"] @ dhu
            dh += d_out[at].T
        g["u"] = du
        self.steps += 1
        rows, sums = sums_by(number, da)
        self._adam("a", sums / n, rows)
        for name in ("u", "wc", "bc", "wo", "bo"):
            self._adam(name, g[name] / n, slice(None))
        return h.T

    def _adam(self, name, grad, rows):
        m, s = 0.9 * self.m[name][rows], 0.99 * self.s[name][rows]
        m += 0.1 * grad
        grad *= grad
        grad *= 0.01
        s += grad
        self.m[name][rows], self.s[name][rows] = m, s
        m *= float(self.rate * np.sqrt(1 - 0.99 ** self.steps) / (1 - 0.9 ** self.steps))
        np.sqrt(s, out=s)
        s += 1e-7
        m /= s
        self.p[name][rows] += m


def stream_of(w: Words, v: Vocabulary, end: int) -> np.ndarray:
    """Numbers of all texts' tokens, one text after another, each with its end."""
    out = np.full(len(w) + len(w.counts), end, np.int64)
    if len(w):
        out[np.arange(len(w)) + w.doc_of()] = numbers(w, w.hashes(), v)
    return out


def _train(shared, lanes, rate, batches):
    v, weights = shared.value
    p = unflat(weights, v)
    end = int(v.place[v.head == np.uint64(END)][0])
    trainer = Trainer(p, v.classes, end, rate, lanes)
    for rb in text_chunks(batches, "t"):
        trainer.feed(stream_of(Tokens(column(rb, "t").to_pylist()), v, end))
    n = trainer.tokens
    vec = np.concatenate([flat(trainer.p) * n, [n]])
    yield batch(v=pa.array([vec.tobytes()], pa.binary()))


def units(texts: DataFrame, n: int) -> DataFrame:
    """``texts`` (``i``, ``t``) as ``n`` partitions that depend on the rows only,
    each in the same order however they were cut before."""
    key = [F.xxhash64(F.lit("unit"), F.col(c)) for c in ("i", "t")]
    dealt = texts.select("t", key[0].alias("k"), key[1].alias("l")).withColumn("u", F.pmod("k", F.lit(n)).cast("int"))
    return dealt.repartitionById(n, "u").sortWithinPartitions("k", "l").select("t")


def train(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """Flat weights learned from all ``texts`` (ids ``i``, columns ``t`` and a
    slice number ``s`` of 0-31)."""
    weights = flat(start_weights(v))
    for lo, hi, lanes, rate in ROUNDS:
        shared = texts.sparkSession.sparkContext.broadcast((v, weights))
        n = max(1, round(v.tokens * (hi - lo) / 32 / UNIT))
        dealt = units(texts.filter((F.col("s") >= lo) & (F.col("s") < hi)), n)
        parts = dealt.mapInArrow(partial(_train, shared, lanes, rate), "v binary")
        total = total_vectors(parts, "v", np.float64, len(weights) + 1)
        if total[-1] > 0:
            weights = total[:-1] / total[-1]
        shared.unpersist()
    return weights


def _score_side(p: dict, ut, y, begin, length, n_class: int, out) -> None:
    """Fill in ``out`` for the texts of these places and lengths, longest first."""
    longest = int(length[0])
    alive = np.searchsorted(-length, -np.arange(longest), "left")
    h = np.zeros((HIDDEN, len(length)), np.float32)
    for t0 in range(0, longest, SCORE_WINDOW):
        states, places = [], []
        for t in range(t0, min(longest, t0 + SCORE_WINDOW)):
            n = int(alive[t])
            h = h[:, :n]
            at = begin[:n] + t
            states.append(h.T), places.append(at)
            h = step(np.take(p["a"], y[at], 0).T, ut, h)[0]
        hs, at = np.concatenate(states), np.concatenate(places)
        for i in range(0, len(at), SLICE):
            out[at[i:i + SLICE]] = log_probs(p, hs[i:i + SLICE], y[at[i:i + SLICE]], n_class)


def score_tokens(p: dict, y: np.ndarray, counts: np.ndarray, n_class: int) -> np.ndarray:
    """Natural log probability of every token of texts laid one after another.
    Texts run side by side, longest first; the state goes on from window to
    window until the text ends."""
    out = np.zeros(len(y))
    order = np.argsort(-counts, kind="stable")
    begin, length, ut = (np.cumsum(counts) - counts)[order], counts[order], np.ascontiguousarray(p["u"].T)
    for i in range(0, len(counts), SIDE):
        _score_side(p, ut, y, begin[i:i + SIDE], length[i:i + SIDE], n_class, out)
    return out


def _score(shared, batches):
    """Per text: what the broadcast words tell, and the hashes of the others."""
    from pyspark import TaskContext
    v, weights = shared.value
    p = unflat(weights, v)
    end = int(v.place[v.head == np.uint64(END)][0])
    end_known = np.searchsorted(v.known, np.uint64(END))
    has_end = end_known < len(v.known) and v.known[end_known] == np.uint64(END)
    end_log = float(v.log_c[end_known]) if has_end else float(np.log10(0.5))
    head_log = np.log10(v.head_c + 0.5)
    serial = TaskContext.get().partitionId() << 33
    held, size = [], 0

    def flush(serial):
        y = np.concatenate([x["y"] for x in held])
        counts = np.concatenate([x["n"] for x in held])
        lp = score_tokens(p, y, counts, v.classes) / LN10
        start = np.cumsum(counts) - counts
        neural = np.add.reduceat(lp, start)
        at = 0
        for x in held:
            n = len(x["n"])
            yield batch(rid=pa.array(np.arange(serial, serial + n)), doc_id=x["id"], n_tokens=pa.array(x["n"]), known=pa.array(x["known"]),
                        base=pa.array(x["base"]), score=pa.array(neural[at:at + n] + x["score"]),
                        rare=pa.ListArray.from_arrays(pa.array(x["rare_at"].astype(np.int32)), pa.array(x["rare"].view(np.int64))))
            at, serial = at + n, serial + n

    for rb in text_chunks(batches, "t"):
        w = Tokens(column(rb, "t").to_pylist())
        h, n_docs, doc = w.hashes(), rb.num_rows, w.doc_of()
        y = stream_of(w, v, end)
        own = y[np.arange(len(w)) + doc] if len(w) else np.zeros(0, np.int64)
        tail = own >= v.classes * SLOTS
        found, log_c = ~tail, np.zeros(len(w))
        log_c[found] = head_log[own[found]]
        at = np.flatnonzero(tail)
        if len(v.known) and len(at):                # sorted look-ups stay in the cache
            at = at[np.argsort(h[at])]
            near = np.minimum(np.searchsorted(v.known, h[at]), len(v.known) - 1)
            found[at] = v.known[near] == h[at]
            log_c[at] = np.where(found[at], v.log_c[near], 0.0)
        inside = np.where(tail, np.where(found, log_c, 0.0) - v.log_mass[np.maximum(own - v.classes * SLOTS, 0)], 0.0)
        held.append({"y": y, "n": w.counts + 1, "id": column(rb, "i"), "base": np.bincount(doc, log_c, n_docs) + end_log,
                     "known": np.bincount(doc[found], minlength=n_docs) + int(v.tokens > 0), "score": np.bincount(doc, inside, n_docs),
                     "rare": h[~found], "rare_at": np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=n_docs))])})
        size += len(y)
        if size >= SCORE_TOKENS:
            yield from flush(serial)
            serial += sum(len(x["n"]) for x in held)
            held, size = [], 0
    if held:
        yield from flush(serial)


def score_documents(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every
    row of ``docs``, learning from the rows where ``learn`` holds."""
    src = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), learn.alias("learn"),
                      F.pmod(F.xxhash64(F.lit("slice"), F.col(doc_id)), F.lit(32)).alias("s"))
    counts = (src.filter("learn").select("t").mapInArrow(_count, "h long, cls int, c long").filter("c > 0")
              .groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c")))
    counts = store(counts, "word-counts")
    v = vocabulary(counts)
    weights = train(src.filter("learn"), v)
    shared = docs.sparkSession.sparkContext.broadcast((v, weights))
    kind = src.schema["i"].dataType.simpleString()
    part = store(src.select("i", "t").mapInArrow(partial(_score, shared), f"rid long, doc_id {kind}, n_tokens long, known long, base double, "
                                                 "score double, rare array<long>"), "scored")
    rare = (part.select("rid", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
            .groupBy("rid").agg(F.count("c").alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log")))
    out = part.drop("rare").join(rare, "rid", "left")
    extra, whole = F.coalesce("rare_log", F.lit(0.0)), F.lit(float(np.log10(v.tokens + 0.5 * (v.types + 1))))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(v.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + extra - F.col("n_tokens") * whole).alias("base_score"),
                      (F.col("score") + extra).alias("score"))
