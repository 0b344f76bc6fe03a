"""Removal of repeated passages by content-defined line chunks and runs of lines.

Three kinds of spans of whole lines are compared over the whole table:

- runs of LONG words or more: from each line with words, forward and backward, the shortest run that
  has LONG words. These lie inside any longer passage whatever stands around it and cover it to its
  ends, so each repeated run of LONG words or more is found whole;
- content-defined chunks, for shorter passages: a rolling hash over the hashes of neighbouring lines
  ends a chunk where it is 0 modulo SPACING, so boundaries move with the text; those of two lines or
  more count, and a line of LONG words or more is a chunk of its own;
- whole texts of two lines or more, so that nothing is left of a later exact copy.

Spans that occur more than once are removed everywhere but at their first occurrence, by doc_id and
place; rows of one doc_id, or of none, come by a hash of their text and then as they are read; a
later span that overlaps its own first occurrence loses only the lines after it.

Equal digests (128 bits, BLAKE2b) only make candidates: nothing is removed before its bytes were
compared with those of the first occurrence. Candidates of one text that lie in each other's
continuation in one earlier text are compared as one range, so bytes of lines in many spans are
moved once. Spans of one digest and other bytes than the first's are grouped by their bytes.

Defined results: a null text stays null with 0 lines; an empty text has one line and loses
nothing; rows with null doc_id come before all others; each row is decided by itself, so of equal
rows the first stays whole; further columns pass through, whatever their names, but columns named
like the added ones are replaced; an empty table gives no rows. A text is held whole, at about 60
bytes a byte, and may be a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import _BYTE, Block, Hasher, U64, blocks, cut, drop_cut, mix64, starts_of, table, tidy

SPACING = 2
LONG = 50


def lines_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte and words of each line, and where each text's lines begin (n + 1 entries)."""
    brk = np.flatnonzero(block.data == 10)
    # a break at the end of a text opens a last, empty line of that text, which sorts before the next text's first
    docs = np.concatenate([np.arange(block.n), np.searchsorted(block.offs, brk, side="right") - 1])
    starts = np.concatenate([block.offs[:-1], brk + 1])
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    first = starts_of(docs, block.n)
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = block.offs[1:]
    w, _, _ = block.words()
    return starts, ends, np.searchsorted(w, ends) - np.searchsorted(w, starts), first


def spans_of(block: Block) -> tuple[np.ndarray, ...]:
    """First byte, last byte, doc, first line and last line (in the doc) of each span that may be removed."""
    starts, ends, words, first = lines_of(block)
    total = len(starts)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    head, tail = first[:-1][doc], first[1:][doc] - 1
    full = np.concatenate([[0], words.cumsum()])
    # runs of LONG words, from each line with words
    line = np.flatnonzero(words)
    down = np.searchsorted(full, full[line] + LONG) - 1
    up = np.searchsorted(full, full[line + 1] - LONG, side="right") - 1
    runs = [(line[ok], down[ok]) for ok in [down <= tail[line]]] + [(up[ok], line[ok]) for ok in [(full[line + 1] >= LONG) & (up >= head[line])]]
    # content-defined chunks
    h = Hasher(_BYTE[block.data]).spans(starts, ends)
    prev = np.zeros_like(h)
    prev[1:] = h[:-1]
    prev[first[:-1]] = U64(0)
    roll = mix64(prev * U64(0x9E3779B97F4A7C15) + h)
    long_ = words >= LONG
    last = (roll % U64(SPACING) == 0) | long_
    last[:-1] |= long_[1:]
    last[first[1:] - 1] = True
    stop = np.flatnonzero(last)
    chunks = (np.concatenate([[0], stop[:-1] + 1]), stop)
    every = [*runs, chunks, (first[:-1], first[1:] - 1)]
    lo, hi = np.concatenate([x for x, _ in every]), np.concatenate([y for _, y in every])
    may = ((hi > lo) | long_[lo]) & (full[hi + 1] > full[lo])
    key = np.unique(lo[may] * total + hi[may])
    lo, hi = key // total, key % total
    return starts[lo], ends[hi], doc[lo], lo - head[lo], hi - head[lo]


def _list_spans(size: int):
    """The spans of each text and their digests of `size` bytes, in 16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                a, b, doc, lo, hi = spans_of(block)
                raw = memoryview(block.data.tobytes())
                digest = np.frombuffer(b"".join([hashlib.blake2b(raw[i:j], digest_size=size).digest().ljust(16, b"\0") for i, j in zip(a.tolist(), b.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                keys = [batch.column(c).slice(block.first, block.n).take(pa.array(doc)) for c in ("doc_id", "th", "row")]
                cols = [*keys, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "row", "lo", "hi", "h", "g"])
            tidy()

    return run


#: Bytes of ranges that a task gives on at once.
HELD = 1 << 23


def _list_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, lo, hi, own, raw): the bytes of the lines from lo to hi, as far as there are any, of each range asked for."""

    def packed(held: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], ["row", "lo", "hi", "own", "raw"])

    for batch in batches:
        wants, rows, held, n = batch.column("_wants"), batch.column("_row"), [], 0
        for block in blocks(batch.column("_text")):
            if not wants.slice(block.first, block.n).is_valid().true_count:
                continue
            starts, ends, _, first = lines_of(block)
            for i in range(block.n):
                asked = wants[block.first + i]
                if not asked.is_valid:
                    continue
                s, e, row = first[i], first[i + 1], rows[block.first + i].as_py()
                for lo, hi, own in zip(*(x.to_pylist() for x in asked.values.flatten()), strict=True):
                    raw = block.data[starts[s + lo] : ends[min(s + hi, e - 1)]].tobytes()
                    held.append((row, lo, hi, own, raw))
                    n += len(raw)
                    if n >= HELD:
                        yield packed(held)
                        held, n = [], 0
        if held:
            yield packed(held)
        tidy()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.names.index("_text")
        marks = batch.column("_marks")
        texts = batch.column("_text")
        out, lines, gone = [], [], []
        for block in blocks(texts):
            starts, ends, _, first = lines_of(block)
            for i in range(block.n):
                row = block.first + i
                s, e = first[i], first[i + 1]
                if not texts[row].is_valid:
                    out.append(None)
                    lines.append(0)
                    gone.append(0)
                    continue
                lines.append(int(e - s))
                if not marks[row].is_valid:
                    out.append(block.text(i))
                    gone.append(0)
                    continue
                off = np.zeros(e - s + 1, np.int64)
                span = marks[row].values.flatten()
                np.add.at(off, span[0].to_numpy(), 1)
                np.add.at(off, span[1].to_numpy() + 1, -1)
                off = off.cumsum()[:-1] > 0
                gone.append(int(off.sum()))
                out.append(b"\n".join(block.data[x:y].tobytes() for x, y in zip(starts[s:e][~off], ends[s:e][~off], strict=True)))
        cols = [pa.array(out, pa.binary()).cast(pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names, "n_lines", "removed_lines"])


def candidates(rows: DataFrame, size: int = 16) -> DataFrame:
    """Ranges of lines of rows (row, doc_id, text) whose spans have digests that occur earlier in the table: (row, doc_id, th, row0, d, even, lo, hi, spans).

    The lines from lo to hi of text `row` should be those from lo + d of text row0. Spans that touch in both texts are in one range.
    `even` is false for spans of another number of lines than the first occurrence of their digest, which can't be equal to it.
    """
    keyed = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    spans = cut(keyed.mapInArrow(_list_spans(size), "doc_id long, th long, row long, lo int, hi int, h long, g long"))
    same = spans.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "row", "lo", "hi")).alias("first"))
    found = spans.join(cut(same.where("n > 1").select("h", "g", "first.row", "first.lo", "first.hi").toDF("h", "g", "row0", "lo0", "hi0")), ["h", "g"])
    later = found.where("row <> row0 or lo <> lo0 or hi <> hi0").withColumn("d", F.expr("lo0 - lo")).withColumn("even", F.expr("hi - lo = hi0 - lo0"))
    w = Window.partitionBy("row", "row0", "d", "even").orderBy("lo", "hi")
    apart = F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(False)).cast("int")
    parts = later.withColumn("apart", apart).withColumn("part", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = parts.groupBy("row", "row0", "d", "even", "part").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.min("lo").alias("a"), F.max("hi").alias("b"), F.collect_list(F.struct("lo", "hi", "h", "g")).alias("spans"))
    out = cut(ranges.select("row", "doc_id", "th", "row0", "d", "even", F.col("a").alias("lo"), F.col("b").alias("hi"), "spans"))
    drop_cut(spans)
    return out


def _piece(raw: str) -> str:
    """The bytes of one span of a range."""
    return f"array_join(slice(split(cast({raw} as string), '\\n', -1), span.lo - lo + 1, span.hi - span.lo + 1), '\\n')"


def repeated_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(_row, _marks) of rows (_row, _text, _own) and their candidates: the lines of each text, from lo to hi, whose span's bytes occur earlier."""
    own = found.select("row", "lo", "hi", F.lit(True).alias("own"))
    first = found.selectExpr("row0 as row", "lo + d as lo", "hi + d as hi", "false as own")
    wants = own.unionByName(first).groupBy("row").agg(F.collect_set(F.struct("lo", "hi", "own")).alias("_wants")).withColumnRenamed("row", "_row")
    # a left join with all columns, as the texts are joined with their marks: the plan moves the texts once for both
    raws = rows.join(wants, "_row", "left").mapInArrow(_list_ranges, "row long, lo int, hi int, own boolean, raw binary")
    mine = raws.where("own").drop("own")
    theirs = raws.where("not own").selectExpr("row as row0", "lo as lo0", "hi as hi0", "raw as raw0")
    both = found.join(mine, ["row", "lo", "hi"]).withColumn("lo0", F.expr("lo + d")).withColumn("hi0", F.expr("hi + d")).join(theirs, ["row0", "lo0", "hi0"])
    # equal ranges give their spans as they are, others each span with its bytes if these are not the first's
    equal = F.expr("even and raw = raw0")
    each = both.select("row", "row0", "d", "doc_id", "th", "lo", "even", F.when(~equal, F.col("raw")).alias("raw"), F.when(~equal, F.col("raw0")).alias("raw0"), equal.alias("equal"), F.explode("spans").alias("span"))
    each = each.withColumn("equal", F.expr(f"equal or even and {_piece('raw')} = {_piece('raw0')}"))
    later = each.where("equal").selectExpr("row", "if(row = row0, greatest(span.lo, span.hi + d + 1), span.lo) as lo", "span.hi as hi")
    rest = each.where("not equal").selectExpr("span.h as h", "span.g as g", f"{_piece('raw')} as piece", "struct(doc_id, th, row, span.lo as lo, span.hi as hi) as at")
    rest = rest.groupBy("h", "g", "piece").agg(F.min("at").alias("first"), F.collect_list("at").alias("ats")).where("size(ats) > 1").select("first", F.explode("ats").alias("at"))
    rest = rest.where("at <> first").selectExpr("at.row as row", "if(at.row = first.row, greatest(at.lo, first.hi + 1), at.lo) as lo", "at.hi as hi")
    marks = later.unionByName(rest).where("lo <= hi").groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    return marks.toDF("_row", "_marks")


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: int = 16) -> DataFrame:
    """docs with repeated spans taken out of text, and n_lines and removed_lines added; digest: bytes of the digests, on which no result depends."""
    docs = docs.drop("n_lines", "removed_lines")
    # the other columns as one struct, so that no name can clash; written once, so that the numbers of the rows hold
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_none"))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), own.alias("_own")))
    found = candidates(rows.select(F.col("_row").alias("row"), F.col("_id").alias("doc_id"), F.col("_text").alias("text")), digest)
    rows = rows.select("_row", "_text", "_own")
    joined = rows.join(repeated_spans(rows, found), "_row", "left").select("_text", "_own", "_marks")
    schema = T.StructType([*joined.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("removed_lines", T.LongType())])
    out = joined.mapInArrow(_remove, schema)
    kept = [F.col("_text").alias(c) if c == text else F.col(f"_own.`{c}`") for c in docs.columns]
    return out.select(*kept, "n_lines", "removed_lines")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "removed_lines", F.length("text").cast("long").alias("chars_left"), F.xxhash64("text").alias("text_hash"))
