"""Language identification by a linear-chain conditional random field.

Each word of a text gets a label (a language). Features of a word: hashed
character 2- and 3-grams, hashed prefixes and suffixes, and its entry in a
lexicon of words seen in training; label-to-label transitions are learned too.
Training sequences splice chunks of different languages, so the model expects
code-switching. Whole texts are decoded by forward-backward; a document's
language is the one with the largest expected share of words, its score that
share.

The fit uses at most ``CHUNKS`` chunks of ``CHUNK_WORDS`` words per language
(the first by the md5 of document and position: a documented bound of the
fit). Language, source and id are never inputs of a prediction.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the first language by name; repeated rows count each; rows with
a null language teach nothing; without any training rows all texts are ``und``.

The score is a share among the learned labels, and no label stands for other
languages: a text in a language not learned gets the nearest learned label. With
few labels ``MIN_SCORE`` hardly rejects anything but texts without letters; with
many, it also rejects texts that mix several learned languages.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.llm.common import Words, apart, column, text_chunks, without

CHUNKS, CHUNK_WORDS = 900, 48
GRAM_BITS, AFFIX_BITS = 15, 14
DECODE_WORDS = 1_200_000            # words decoded together in a Python worker
MIN_SCORE = 0.3                     # the pipeline rejects below this, and `und`; up to three labels, no score is below
UND = "und"
_LETTER = bytearray(b" " * 256)
for _b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LETTER[_b] = _b
_LETTER = bytes(_LETTER)


def letter_words(text) -> list[bytes]:
    """Lower-cased runs of letters (and of other non-ASCII characters)."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTER).split() if text else []


def has_letter(text) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram number of each character position (two per position), and
    affix numbers of each word (four per word)."""
    b = w.buf.astype(np.uint32)
    before = np.concatenate([[32], b[:-1]]).astype(np.uint32)
    after = np.concatenate([b[1:], [32]]).astype(np.uint32)
    after2 = np.concatenate([b[2:], [32, 32]]).astype(np.uint32)[:len(b)]
    size = 1 << (GRAM_BITS - 1)
    two = ((b * np.uint32(0x9E3779B1) ^ after * np.uint32(0x85EBCA6B)) >> np.uint32(9)) % size
    three = size + ((before * np.uint32(0x9E3779B1) ^ b * np.uint32(0xC2B2AE35) ^ after * np.uint32(0x27D4EB2F)) >> np.uint32(9)) % size
    s, last = w.start, w.end - 1
    one = last == s
    prev = np.maximum(last - 1, s)
    a = 1 << AFFIX_BITS
    affix = [(b[s] * np.uint32(0x9E3779B1) >> np.uint32(11)) % a,
             ((b[s] * np.uint32(0x9E3779B1) ^ after[s] * np.uint32(0x85EBCA6B) ^ np.where(one, 0, after2[s]) * np.uint32(0xC2B2AE35)) >> np.uint32(7)) % a,
             ((b[last] * np.uint32(0x27D4EB2F) + np.uint32(77)) >> np.uint32(11)) % a,
             ((b[last] * np.uint32(0x27D4EB2F) ^ b[prev] * np.uint32(0x165667B1) ^ before[prev] * np.uint32(0x85EBCA6B)) >> np.uint32(7)) % a]
    return np.stack([two, three], 1).astype(np.int32), np.stack(affix, 1).astype(np.int32)


@dataclass
class Crf:
    labels: list[str]
    gram: np.ndarray            # (2**GRAM_BITS, K)
    affix: np.ndarray           # (2**AFFIX_BITS, K)
    lexicon: np.ndarray         # sorted word hashes
    entry: np.ndarray           # (len(lexicon) + 1, K); the last row is of unknown words
    jump: np.ndarray            # (K, K) transition scores

    def lookup(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at, len(self.lexicon))

    def emissions(self, w: Words) -> np.ndarray:
        """(words, K) scores."""
        if not len(w):
            return np.zeros((0, len(self.labels)), np.float32)
        grams, affixes = _slots(w)
        per_char = self.gram[grams[:, 0]] + self.gram[grams[:, 1]]
        per_char[w.end] = 0
        out = np.add.reduceat(per_char, w.start)
        for k in range(affixes.shape[1]):
            out += self.affix[affixes[:, k]]
        return out + self.entry[self.lookup(w.hashes())]


def forward_backward(score: np.ndarray, counts: np.ndarray, jump: np.ndarray):
    """Posterior (words, K) of every word of texts laid one after another, and
    the forward and backward messages. Texts run side by side, longest first."""
    k = score.shape[1]
    e = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
    a, b = np.empty_like(e), np.empty_like(e)
    move = np.exp(jump - jump.max()).astype(e.dtype)
    order = np.argsort(-counts, kind="stable")
    begin = (np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64))[order]
    length = counts[order]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")       # texts longer than t
    msg = None
    for t in range(longest):
        n = int(alive[t])
        rows = begin[:n] + t
        msg = e[rows] if t == 0 else (msg[:n] @ move) * e[rows]
        msg /= msg.sum(1, keepdims=True)
        a[rows] = msg
    msg = np.empty((0, k), e.dtype)
    for t in range(longest - 1, -1, -1):
        n = int(alive[t])
        rows = begin[:n] + t
        if len(msg):
            m = (msg * e[rows[:len(msg)] + 1]) @ move.T
            m /= m.sum(1, keepdims=True)
            msg = m
        if n > len(msg):
            msg = np.concatenate([msg, np.full((n - len(msg), k), 1 / k, e.dtype)])
        b[rows] = msg
    post = a * b
    post /= np.maximum(post.sum(1, keepdims=True), 1e-30)
    return post, a, b, e, move


def fit_chunks(chunks: list[tuple[str, str]], seed: int = 7, epochs: int = 8, rate: float = 0.15) -> Crf:
    """``chunks``: (text, language). Trains by adaptive gradient steps on the
    exact likelihood gradient (observed minus expected features)."""
    labels = sorted({lang for _, lang in chunks})
    k, rng = len(labels), np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(labels)}
    all_words = Words([t for t, _ in chunks], letter_words)
    h = all_words.hashes()
    values, seen = np.unique(h, return_counts=True)
    lexicon = values[seen >= 3]
    crf = Crf(labels, np.zeros((1 << GRAM_BITS, k), np.float32), np.zeros((1 << AFFIX_BITS, k), np.float32), lexicon,
              np.zeros((len(lexicon) + 1, k), np.float32), np.zeros((k, k), np.float32))
    if k < 2 or not len(all_words):
        return crf
    parts = (crf.gram, crf.affix, crf.entry, crf.jump)
    memory = [np.full(p.shape, 1e-3, np.float32) for p in parts]
    for _ in range(epochs):
        order, at = rng.permutation(len(chunks)), 0
        while at < len(order):
            seqs, used = [], 0
            while at < len(order) and used < 15_000:            # one step: sequences of 1 to 3 pieces
                n = int(rng.integers(1, 4))
                seq = []
                for c in order[at:at + n]:
                    words = letter_words(chunks[c][0])
                    if n > 1 and len(words) > 4:                # code-switched sequences have short pieces
                        words = words[:int(rng.integers(3, len(words) + 1))]
                    seq += [(x, number[chunks[c][1]]) for x in words]
                at += n
                if seq:
                    seqs.append(seq)
                    used += len(seq)
            if not seqs:
                continue
            w = Words([b" ".join(x for x, _ in s).decode("utf-8", "surrogatepass") for s in seqs], letter_words)
            y = np.array([i for s in seqs for _, i in s])
            if len(w) != len(y):
                continue                                        # a lower-case form that splits differently
            post, a, b, e, move = forward_backward(crf.emissions(w), w.counts, crf.jump)
            diff = -post
            diff[np.arange(len(y)), y] += 1
            same = np.ones(len(y), bool)
            same[w.doc[:-1][w.counts > 0]] = False              # first words have no predecessor
            to = np.flatnonzero(same)
            pair = a[to - 1][:, :, None] * move[None] * (e[to] * b[to])[:, None, :]
            pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-30)
            g_jump = -pair.sum(0)
            np.add.at(g_jump, (y[to - 1], y[to]), 1)
            grams, affixes = _slots(w)
            inside = np.ones(len(w.buf), bool)
            inside[w.end] = False
            owner = np.repeat(np.arange(len(w)), w.end - w.start + 1)[inside]
            grams = grams[inside]
            entry = crf.lookup(w.hashes())

            def spread(ids, g, size):
                return np.stack([np.bincount(ids, g[:, j], minlength=size) for j in range(k)], 1)

            grads = (spread(grams[:, 0], diff[owner], len(crf.gram)) + spread(grams[:, 1], diff[owner], len(crf.gram)),
                     sum(spread(affixes[:, j], diff, len(crf.affix)) for j in range(affixes.shape[1])),
                     spread(entry, diff, len(crf.entry)), g_jump)
            for p, m, g in zip(parts, memory, grads, strict=True):
                g = (g - 0.01 * p).astype(np.float32)
                m += g * g
                p += rate * g / np.sqrt(m)
    return crf


def training_chunks(docs: DataFrame, text: str, lang: str, doc_id: str, per_label: int = CHUNKS) -> DataFrame:
    """``(y, k, t)``: language, order and text of up to ``per_label`` chunks per language, by seeded order. Every task
    first keeps its own best per language, so little is shuffled."""
    import hashlib
    import heapq

    def cut(batches):
        best: dict[str, list] = {}
        for rb in text_chunks(batches, "t"):
            for i, t, y in zip(*(column(rb, c).to_pylist() for c in ("i", "t", "y")), strict=True):
                w = letter_words(t)
                heap = best.setdefault(y, [])
                for n in range(0, len(w), CHUNK_WORDS):
                    key = int.from_bytes(hashlib.md5(f"{i}|{n}".encode()).digest()[:7], "big")
                    item = (-key, b" ".join(w[n:n + CHUNK_WORDS]).decode("utf-8", "replace"))
                    if len(heap) < per_label:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        rows = [(y, -k, t) for y, heap in best.items() for k, t in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.string()))],
                                         ["y", "k", "t"])

    src = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("y")).dropna(subset=["t", "y"])
    best = src.mapInArrow(cut, "y string, k long, t string")
    rank = F.row_number().over(Window.partitionBy("y").orderBy("k", "t"))
    return best.withColumn("_r", rank).filter(F.col("_r") <= per_label).drop("_r")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Crf:
    """Trains in one task, over the bounded sample; only the model comes back."""
    def train(batches):
        rows = [r for rb in batches for r in zip(column(rb, "t").to_pylist(), column(rb, "y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_chunks(rows))], pa.binary())], ["model"])

    rows = training_chunks(docs, text, lang, doc_id).repartition(1).sortWithinPartitions("y", "k", "t")
    return pickle.loads(rows.mapInArrow(train, "model binary").collect()[0][0])


def decode(texts: list, crf: Crf) -> list[tuple[str, float, list]]:
    """(language, score, expected words of each label) of each text."""
    k = len(crf.labels)
    counts, scores, size = [], [], 0
    group: list = []
    for t in texts:                 # emissions of a few MB of text at a time
        group.append(t)
        size += len(t or "")
        if size >= 1 << 20:
            w = Words(group, letter_words)
            counts.append(w.counts), scores.append(crf.emissions(w))
            group, size = [], 0
    w = Words(group, letter_words)
    counts.append(w.counts), scores.append(crf.emissions(w))
    n = np.concatenate(counts)
    if not k:
        return [(UND, 0.0, [])] * len(texts)
    post = forward_backward(np.concatenate(scores), n, crf.jump)[0]
    some = np.flatnonzero(n)
    share = np.zeros((len(n), k))
    if len(some):
        share[some] = np.add.reduceat(post.astype(np.float64), np.concatenate([[0], np.cumsum(n)[:-1]])[some])
    out = []
    for t, c, s in zip(texts, n, share, strict=True):
        best = int(np.argmax(s))
        if not c or not has_letter(t):
            out.append((UND, 0.0, [0.0] * k))
        else:
            out.append((crf.labels[best], float(min(1.0, s[best] / c)), s.tolist()))
    return out


def identify(docs: DataFrame, crf: Crf, text: str = "text", pred: str = "lang_pred", score: str = "lang_score",
             shares: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its
    score, and with ``shares`` the expected number of words per label
    (``map<string,double>``). Columns of these names, in any case, are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    new = [pred, score, *([shares] if shares else [])]
    keep = without(docs, *new).columns

    def look(batches):
        held, size = [], 0

        def flush():
            found = decode([t for rb in held for t in column(rb, text).to_pylist()], shared.value)
            at = 0
            for rb in held:
                part = found[at:at + rb.num_rows]
                at += rb.num_rows
                cols = [pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.float64())]
                if shares:
                    cols.append(pa.array([list(zip(shared.value.labels, x[2], strict=False)) for x in part], pa.map_(pa.string(), pa.float64())))
                yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), *cols], [*keep, *new])

        for rb in text_chunks(batches, text):
            held.append(rb)
            size += rb.nbytes
            if size >= 6 * DECODE_WORDS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    src = without(docs, *new)
    added = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    if shares:
        added.append(T.StructField(shares, T.MapType(T.StringType(), T.DoubleType())))
    return src.mapInArrow(look, T.StructType([*src.schema.fields, *added]))


def accepted(docs: DataFrame, crf: Crf, text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those whose language is ``und`` or unsure. All columns
    stay, whatever they are called."""
    def sure(d):
        found = identify(d, crf, "text", "pred", "score")
        return found.filter((F.col("pred") != UND) & (F.col("score") >= least)).drop("pred", "score")

    return apart(docs, {"text": text}, sure)
