"""Quoted multi-line TSV and CSV read by many tasks.

Spark's CSV reader splits a file only if no record holds a line break. Here the
file is read as lines, which split anywhere, and quotes decide which line breaks
end a record. Two passes:

1. Each split (a byte range of a file) is read once to tell whether it ends
   inside quotes, for both ways it may begin. These two answers per split are
   composed in order of the splits (a prefix over the file), which tells how
   each one begins. One row per split comes to the driver.
2. Each split puts its records together. What runs over its ends is passed on
   as fragments, at most two a split, and joined in order.

Records are then parsed by Spark's own CSV expression, with the same options as
its reader: a quote opens a value only at its start, ``""`` is a quote inside.

Defined results: as Spark's reader with ``multiLine``. Empty lines are skipped, a
line break is ``\\n`` or ``\\r\\n``; an open quote at the end of a file takes the
rest of it. All columns are text. A header that differs from the stated
columns, or between files, is an error, and so is a header over several lines.
"""

from __future__ import annotations

import csv
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPLETE, HEAD, WHOLE, TAIL = 0, 1, 2, 3       # a record; what is left of one, from, or over a split


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether the text after ``line`` is inside quotes, if before it it was or not."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:
            if at >= n or line[at] != '"':
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        while True:                                 # the closing quote
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            break
        inside = False
        at = line.find(sep, at)                     # whatever follows it belongs to the value
        if at < 0:
            return False
        at += len(sep)


def _splits(batches):
    """The lines of each split, batch by batch: (file, start, first batch?, lines)."""
    last = None
    for rb in batches:
        files, starts, lines = rb.column(0), rb.column(1), rb.column(2)
        changes = [0]
        if rb.num_rows > 1:
            same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(starts[1:], starts[:-1]))
            changes += [i + 1 for i, s in enumerate(same.to_pylist()) if not s]
        for a, b in zip(changes, [*changes[1:], rb.num_rows], strict=True):
            if b > a:
                where = (files[a].as_py(), starts[a].as_py())
                yield *where, where != last, lines.slice(a, b - a)
                last = where


def _outcomes(sep, batches):
    """Per split: inside quotes at its end, if it begins outside or inside; and
    the first line of a file."""
    now = None
    for file, start, first, lines in _splits(batches):
        if first:
            if now:
                yield _outcome(now)
            now = [file, start, False, True, lines[0].as_py() if start == 0 else None]
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            now[2], now[3] = ends_inside(line, now[2], sep), ends_inside(line, now[3], sep)
    if now:
        yield _outcome(now)


def _outcome(row):
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (
        pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()), strict=True)], ["file", "start", "out", "in", "header"])


def _records(sep, states, batches):
    """Records of each split (without the header), and its fragments."""
    held: list[str] = []            # lines of the record that is open
    inside, kind, now = False, COMPLETE, None

    def row(kind, lines):
        return kind, "\n".join(lines)

    for file, start, first, lines in _splits(batches):
        out = []
        if first:
            if now is not None and held:
                yield _rows(now, [row(WHOLE if kind == HEAD else TAIL, held)])
            now, held, inside = (file, start), [], states[file, start]
            kind = HEAD if inside else COMPLETE
        texts = lines.to_pylist()
        if first and start == 0:
            texts = texts[1:]
        for line in texts:
            held.append(line)
            if '"' in line:
                inside = ends_inside(line, inside, sep)
            if not inside:
                out.append(row(kind, held))
                held, kind = [], COMPLETE
        if out:
            yield _rows(now, out)
    if now is not None and held:
        yield _rows(now, [row(WHOLE if kind == HEAD else TAIL, held)])


def _rows(where, rows):
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([where[0]] * n, pa.string()), pa.array([where[1]] * n, pa.int64()),
                                       pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())],
                                      ["file", "start", "kind", "record"])


def records(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, list[str]]:
    """``(record)`` rows of all files, and the columns named by their header."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    ends = lines.mapInArrow(partial(_outcomes, sep), "file string, start long, out boolean, in boolean, header string").collect()
    states, headers, file = {}, set(), None
    for e in sorted(ends, key=lambda e: (e["file"], e["start"])):
        inside = e["file"] == file and after        # noqa: F821  the split before has set it
        states[e["file"], e["start"]] = inside
        file, after = e["file"], e["in"] if inside else e["out"]
        if e["header"] is not None:
            headers.add(e["header"].rstrip("\r").removeprefix("﻿"))
    if len(headers) > 1:
        raise ValueError(f"the files under {path} have different headers")
    header = headers.pop() if headers else ""
    if ends_inside(header, False, sep):
        raise ValueError(f"the header of {path} goes over several lines")
    made = lines.mapInArrow(partial(_records, sep, states), "file string, start long, kind int, record string")
    tails = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("start", "kind"))
    pieces = made.filter(F.col("kind") != COMPLETE).withColumn("of", tails)
    joined = pieces.groupBy("file", "of").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("start", "kind", "record"))), lambda p: p["record"]), "\n").alias("record"))
    whole = made.filter(F.col("kind") == COMPLETE).select("record").unionByName(joined.select("record"))
    whole = whole.select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")
    return whole, next(csv.reader([header], delimiter=sep)) if header else []


def read(spark: SparkSession, path: str, options: dict, sep: str, columns: tuple | None = None) -> DataFrame:
    """The table under ``path`` (a file or a folder), all columns as text."""
    rows, names = records(spark, path, sep)
    if columns is not None and names and list(columns) != names:
        raise ValueError(f"the header of {path} is {names}, not {list(columns)}")
    schema = ", ".join(f"`{c}` string" for c in (columns or names))
    parsed = rows.select(F.from_csv("record", F.lit(schema), {**options, "sep": sep, "header": "false"}).alias("r"))
    return parsed.select("r.*")
