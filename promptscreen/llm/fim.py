"""Fill-in-middle transformation over seekable compressed frames.

A text is held as independent zstandard frames of ``FRAME_CHARS`` code points
with their cumulative counts (:func:`framed`). A cut point finds its frame in
the counts; only the frames that a cut goes through are decompressed, all
others are moved as they are into the output (:func:`infill`). Digests and the
way back (:func:`restored`) stream the frames in order, so a worker never holds
more than one decompressed frame of a text.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is
``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` the text itself. Cuts,
form and seed depend on the document's id alone.

Defined results: null and empty texts have no frames, no code points and are
plain; a text that holds a marker is plain; a null id counts as the empty id;
repeated rows are transformed alike; empty tables give empty tables. The given
columns stay, but for the text and any column named like the one added (in any
case).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.llm.common import column, text_chunks, without

FRAME_CHARS = 16_384
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20      # percent: plain texts, and spm among the others

FRAMED = T.StructType([T.StructField("frames", T.ArrayType(T.BinaryType())), T.StructField("ends", T.ArrayType(T.LongType())),
                       T.StructField("marked", T.BooleanType())])
_FRAMED = pa.struct([("frames", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("marked", pa.bool_())])
FILLED = T.StructType([T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                       T.StructField("middle_chars", T.LongType()), T.StructField("frames", T.ArrayType(T.BinaryType()))])
_FILLED = pa.struct([("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])


# ------------------------------------------------------------------- frames ----
def pack(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(text.encode())


def unpack(frame: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(frame).decode()


def frames_of(text: str, frame_chars: int) -> tuple[list[bytes], list[int]]:
    """The frames of a text and the code points up to the end of each."""
    starts = range(0, len(text), frame_chars)
    return [pack(text[s:s + frame_chars]) for s in starts], [min(s + frame_chars, len(text)) for s in starts]


def section(frames: list[bytes], ends: list[int], a: int, b: int) -> list[bytes]:
    """Frames of the code points ``a`` to ``b``. Whole frames are passed on;
    at most the first and the last are decompressed and cut."""
    out = []
    k = bisect_left(ends, a + 1)
    while a < b:
        start, end = ends[k - 1] if k else 0, ends[k]
        stop = min(b, end)
        out.append(frames[k] if (a, stop) == (start, end) else pack(unpack(frames[k])[a - start:stop - start]))
        a, k = stop, k + 1
    return out


def digest(frames: Iterable[bytes]) -> str:
    """sha256 of the text in the frames, one frame at a time."""
    h = hashlib.sha256()
    for f in frames:
        h.update(zstandard.ZstdDecompressor().decompress(f))
    return h.hexdigest()


def sections(frames: Iterable[bytes], markers: list[str]) -> Iterator[list[bytes]]:
    """Stream an output and yield, as frames, what follows each marker in turn.
    A marker may go across frames; the first one starts the output."""
    out: list[bytes] = []
    rest, left = "", list(markers)
    for f in frames:
        rest += unpack(f)
        while left:
            at = rest.find(left[0])
            if at < 0:
                break
            if len(left) < len(markers):
                yield [*out, pack(rest[:at])] if at else out
            elif at:
                raise ValueError("the output does not start with its marker")
            out, rest = [], rest[at + len(left.pop(0)):]
        safe = len(rest) - (len(left[0]) - 1 if left else 0)
        if safe > 0 and len(left) < len(markers):
            out.append(pack(rest[:safe]))
            rest = rest[safe:]
    if left:
        raise ValueError(f"the output lacks {left[0]}")
    yield [*out, pack(rest)] if rest else out


def restored(form: str, frames: list[bytes]) -> list[bytes]:
    """Frames of the text that an output was made of."""
    if form == "plain":
        return frames
    if form == "psm":
        prefix, suffix, middle = sections(frames, [PREFIX, SUFFIX, MIDDLE])
    else:
        suffix, prefix, middle = sections(frames, [SUFFIX, PREFIX, MIDDLE])
    return prefix + middle + suffix


# ---------------------------------------------------------------- operators ----
def framed(docs: DataFrame, text: str = "text", into: str = "framed", frame_chars: int = FRAME_CHARS) -> DataFrame:
    """``docs`` with the text replaced by its frames, their ends in code points,
    and whether it holds a marker."""
    keep = [c for c in without(docs, into).columns if c != text]

    def cut(batches):
        for rb in text_chunks(batches, text):
            rows = []
            for t in column(rb, text).to_pylist():
                t = t or ""
                frames, ends = frames_of(t, frame_chars)
                rows.append({"frames": frames, "ends": ends, "marked": any(m in t for m in (PREFIX, SUFFIX, MIDDLE))})
            yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), pa.array(rows, _FRAMED)], [*keep, into])

    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`"))
    return src.mapInArrow(cut, T.StructType([*(src.schema[c] for c in keep), T.StructField(into, FRAMED)]))


def draws(doc_id, seed: int) -> list[F.Column]:
    """Four 32-bit numbers of the id: two cuts, the share of plain texts, the form."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def infill(frames: DataFrame, doc_id: str = "doc_id", framed: str = "framed", into: str = "fim", seed: int = 1) -> DataFrame:
    """``frames`` (of :func:`framed`) with the column ``into``: the form, the code
    points of prefix and middle (null if plain) and the output as frames."""
    keep = without(frames, into).columns
    h = draws(F.col(f"`{doc_id}`"), seed)
    ends = F.col(f"`{framed}`.ends")
    n = F.when(F.size(ends) > 0, F.element_at(ends, -1)).otherwise(F.lit(0))
    plain = (n == 0) | F.col(f"`{framed}`.marked") | (h[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    cuts = F.struct(form.alias("form"), F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("a"), F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("b"))
    plan = "plan"
    while plan in {c.lower() for c in keep}:
        plan += "_"
    src = frames.select(*(F.col(f"`{c}`") for c in keep), cuts.alias(plan))

    def fill(batches):
        marks = {m: pack(m) for m in (PREFIX, SUFFIX, MIDDLE)}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rb, rows = whole.slice(at, 256), []
                for f, p in zip(column(rb, framed).to_pylist(), column(rb, plan).to_pylist(), strict=True):
                    out, form = f["frames"], p["form"]
                    if form != "plain":
                        a, b, n = p["a"], p["b"], f["ends"][-1]
                        pre, mid, suf = (section(f["frames"], f["ends"], x, y) for x, y in ((0, a), (a, b), (b, n)))
                        pre, suf = [marks[PREFIX], *pre], [marks[SUFFIX], *suf]
                        out = [*(pre + suf if form == "psm" else suf + pre), marks[MIDDLE], *mid]
                    rows.append({"form": form, "frames": out} | ({"prefix_chars": a, "middle_chars": b - a} if form != "plain" else {}))
                yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), pa.array(rows, _FILLED)], [*keep, into])

    return src.mapInArrow(fill, T.StructType([*(src.schema[c] for c in keep), T.StructField(into, FILLED)]))


def _per_row(fill: str, into: str, kind: pa.DataType, make, keep: list[str], batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            rb = whole.slice(at, 256)
            rows = [make(f["form"], f["frames"]) for f in column(rb, fill).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), pa.array(rows, kind)], [*keep, into])


def _digests(form, frames):
    return {"output_sha256": digest(frames), "restored_sha256": digest(restored(form, frames))}


def _output(form, frames):
    return "".join(map(unpack, frames))


def _original(form, frames):
    return "".join(map(unpack, restored(form, frames)))


def _with(filled: DataFrame, fill: str, into: str, kind: pa.DataType, spark_kind: T.DataType, make) -> DataFrame:
    keep = without(filled, into).columns
    src = filled.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, fill])))
    return src.mapInArrow(partial(_per_row, fill, into, kind, make, keep), T.StructType([*(src.schema[c] for c in keep), T.StructField(into, spark_kind)]))


def digests(filled: DataFrame, fill: str = "fim", into: str = "digests") -> DataFrame:
    """``filled`` with the sha256 of each output, and of the text rebuilt from
    nothing but output and form."""
    names = ("output_sha256", "restored_sha256")
    return _with(filled, fill, into, pa.struct([(c, pa.string()) for c in names]),
                 T.StructType([T.StructField(c, T.StringType()) for c in names]), _digests)


def outputs(filled: DataFrame, fill: str = "fim", into: str = "text") -> DataFrame:
    """``filled`` with each output as plain text."""
    return _with(filled, fill, into, pa.string(), T.StringType(), _output)


def originals(filled: DataFrame, fill: str = "fim", into: str = "text") -> DataFrame:
    """``filled`` with the text rebuilt from each output."""
    return _with(filled, fill, into, pa.string(), T.StringType(), _original)
