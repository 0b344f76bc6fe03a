"""Regular expressions answered from stored trigrams: what every match must hold decides which texts are read.

The syntax tree of a pattern gives a condition on trigrams that each line with a match meets: strings a
match must contain, alternatives as a disjunction. Documents that meet it are found from postings alone;
only their texts are read, and the pattern itself decides there. Case plays no part in the postings
(A-Z are lower-cased), so one index serves patterns of either kind.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre  # the names of the tree's nodes
from re import _parser as tree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import search as se
from lumenfold.sources.store import Tables, cut, drop_cut, spread

#: Strings that one place of a pattern may stand for before it is taken as unknown; their length; copies of a repeated part.
STRINGS, LONGEST, COPIES = 24, 32, 4
#: Parts of the stored postings.
BUCKETS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Spellings that the two pattern languages read differently, or one of them not at all.
_DOUBTFUL = re.compile(r"\\[vVhHRXGQEpPkKNZzecxuU0]|&&|\(\?(?![:=!>]|<[=!]|[ims]+[:)])|\[[^\]]*\[")


@dataclass(frozen=True)
class Need:
    """A condition on the trigrams of a text: one gram, all of some conditions, or any of them. All of none always holds."""

    kind: str
    parts: tuple = ()

    def grams(self) -> set[str]:
        return {self.parts[0]} if self.kind == "gram" else set().union(*(p.grams() for p in self.parts)) if self.parts else set()

    def holds(self, grams: set[str]) -> bool:
        if self.kind == "gram":
            return self.parts[0] in grams
        return (all if self.kind == "all" else any)(p.holds(grams) for p in self.parts)

    def column(self, held: Column) -> Column:
        """The condition on an array of grams."""
        if self.kind == "gram":
            return F.array_contains(held, self.parts[0])
        join, start = ((lambda a, b: a & b), F.lit(True)) if self.kind == "all" else ((lambda a, b: a | b), F.lit(False))
        return reduce(join, [p.column(held) for p in self.parts], start)


ALWAYS = Need("all")


def _all(parts) -> Need:
    kept = dict.fromkeys(q for p in parts for q in (p.parts if p.kind == "all" else (p,)))
    return next(iter(kept)) if len(kept) == 1 else Need("all", tuple(kept))


def _any(parts) -> Need:
    kept = tuple(dict.fromkeys(parts))
    return ALWAYS if ALWAYS in kept else kept[0] if len(kept) == 1 else Need("any", kept)


def _of_strings(strings: set[str]) -> Need:
    """That one of the strings is there."""
    return _any(_all(Need("gram", (s[i : i + 3],)) for i in range(len(s) - 2)) for s in sorted(strings))


def _characters(members) -> set[str] | None:
    out: set[str] = set()
    for kind, value in members:
        if kind is sre.LITERAL:
            out.add(chr(value).translate(_FOLD))
        elif kind is sre.RANGE and value[1] - value[0] < STRINGS:
            out |= {chr(x).translate(_FOLD) for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= STRINGS else None


def _place(node) -> tuple[set[str] | None, Need, bool]:
    """What one node stands for: its strings where they are few, else what its matches need; whether it takes no characters."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).translate(_FOLD)}, ALWAYS, False
    if kind is sre.IN:
        return _characters(value), ALWAYS, False
    if kind is sre.AT:
        return {""}, ALWAYS, True
    if kind is sre.SUBPATTERN:
        return (*_sequence(value[3]), False)
    if kind is sre.ATOMIC_GROUP:
        return (*_sequence(value), False)
    if kind is sre.BRANCH:
        arms = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in arms):
            strings = set().union(*(s for s, _ in arms))
            if len(strings) <= STRINGS:
                return strings, ALWAYS, False
        return None, _any(n if s is None else _of_strings(s) for s, n in arms), False
    if kind is sre.ASSERT:
        strings, need = _sequence(value[1])
        return {""}, need if strings is None else _of_strings(strings), True
    if kind is sre.ASSERT_NOT:
        return {""}, ALWAYS, True
    return None, ALWAYS, False


def _repeated(value) -> list:
    """A repeated part as the copies that must be there, and one place of unknown strings if there may be more."""
    low, high, part = value
    if low == 0 and high == 1:
        return [(sre.BRANCH, (None, [list(part), []]))]
    more = [] if high == low <= COPIES else [(sre.ANY, None)]
    return [x for _ in range(min(low, COPIES)) for x in part] + more


def _sequence(nodes) -> tuple[set[str] | None, Need]:
    """(strings, need) of nodes in a row: the strings they stand for where these are few, else what is needed."""
    todo, needs, run, whole = list(nodes), [], {""}, True
    while todo:
        node = todo.pop(0)
        if node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            todo[:0] = _repeated(node[1])
            continue
        strings, need, _ = _place(node)
        if need != ALWAYS:
            needs.append(need)
            whole = False
        if strings is None:
            needs.append(_of_strings(run))
            run, whole = {""}, False
            continue
        if len(run) * len(strings) > STRINGS or max(map(len, run)) > LONGEST:
            # what came before is needed as it stands; its last two characters meet what follows
            needs.append(_of_strings(run))
            run, whole = {s[-2:] for s in run}, False
            if len(run) * len(strings) > STRINGS:
                run = {""}
        run = {a + b for a, b in product(run, strings)}
    return (run, ALWAYS) if whole else (None, _all([*needs, _of_strings(run)]))


def needed(pattern: str) -> Need:
    """What the trigrams of a line with a match meet; ALWAYS for patterns of which nothing is certain."""
    if _DOUBTFUL.search(pattern):
        return ALWAYS
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            nodes = tree.parse(pattern)
        except (re.error, RecursionError, OverflowError, Warning):
            return ALWAYS
    strings, need = _sequence(nodes)
    return need if strings is None else _of_strings(strings)


def folded(text) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Characters whose trigrams a task holds at once, and the bits of one code point.
HELD, BITS = 1 << 19, 21


def _gram_batches(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    def packed(batch: pa.RecordBatch, rows: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        own = np.repeat(rows, [len(x) for x in codes])
        named, at = np.unique(np.concatenate(codes), return_inverse=True)
        points = np.stack([named >> (2 * BITS), named >> BITS & (1 << BITS) - 1, named & (1 << BITS) - 1], 1).astype("<u4")
        whole = points.tobytes().decode("utf-32-le", "surrogatepass")
        grams = pa.array([whole[i : i + 3] for i in range(0, len(whole), 3)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(own)), grams.take(pa.array(at))], ["row", "gram"])

    for batch in batches:
        rows, codes, n = [], [], 0
        for i, text in enumerate(batch.column("text")):
            x = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            if len(x) < 3:
                continue
            x = np.where((x >= 65) & (x <= 90), x + 32, x)
            rows.append(i)
            codes.append(np.unique(x[:-2] << (2 * BITS) | x[1:-1] << BITS | x[2:]))
            n += len(x)
            if n >= most:
                yield packed(batch, rows, codes)
                rows, codes, n = [], [], 0
        if rows:
            yield packed(batch, rows, codes)


def grams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, gram): the distinct trigrams of each text; none of a null text or of one shorter than three characters.

    Three code points are one number, so a text's trigrams are told apart by sorting numbers, and no string is made for each place.
    """
    rows = spread(docs.select(F.col(key).alias("row"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(_gram_batches, f"row {docs.schema[key].dataType.simpleString()}, gram string").withColumnRenamed("row", key)


class TrigramIndex:
    """Stored trigrams of texts by bucket, and how many texts hold each; a search reads the buckets of a pattern's trigrams alone."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id"):
        self.tables, self.key, self.spark = Tables(spark, root), key, spark

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("b", F.pmod(F.crc32("gram"), F.lit(BUCKETS)).cast("int")).repartition("b").sortWithinPartitions("gram")

    def build(self, docs: DataFrame, text: str = "text") -> TrigramIndex:
        self.tables.save("grams", self._laid_out(grams(docs, self.key, text)), "b")
        return self

    def add(self, docs: DataFrame, text: str = "text") -> TrigramIndex:
        """Documents replace those of their keys; where all keys are new nothing is rewritten."""
        held = self.tables.load("grams")
        if held is None:
            return self.build(docs, text)
        fresh = docs.select(self.key).distinct()
        if not held.join(fresh, self.key, "left_semi").isEmpty():
            self.remove(fresh)
        rows = cut(grams(docs, self.key, text))
        self.tables.append("grams", self._laid_out(rows), "b")
        drop_cut(rows)
        return self

    def remove(self, gone: DataFrame) -> None:
        self.tables.save("grams", self.tables.load("grams").join(gone.select(self.key).distinct(), self.key, "left_anti"), "b")

    def candidates(self, pattern: str) -> DataFrame | None:
        """(key) of the documents whose trigrams meet what the pattern needs; None if it needs nothing, so that all texts are read."""
        need = needed(pattern)
        wanted = sorted(need.grams())
        if need == ALWAYS or self.tables.load("grams") is None:
            return None
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in wanted})
        rows = self.tables.load("grams").where(F.col("b").isin(buckets) & F.col("gram").isin(wanted))
        # a document has at most one row for each trigram asked for
        return rows.groupBy(self.key).agg(F.collect_set("gram").alias("held")).where(need.column(F.col("held"))).select(self.key)

    def texts(self, docs: DataFrame, pattern: str) -> DataFrame:
        """The documents whose texts must be read for a pattern."""
        found = self.candidates(pattern)
        return docs if found is None else docs.join(found, self.key, "left_semi")

    def search(self, docs: DataFrame, pattern: str, k: int, insensitive: bool = True, text: str = "text", first: str | None = None) -> DataFrame:
        """What search.regex_search finds in docs, the texts the index was built on."""
        return se.regex_search(self.texts(docs, pattern), pattern, k, insensitive, self.key, text, first)

    def grep(self, docs: DataFrame, pattern: str, text: str = "text", **how) -> DataFrame:
        """What search.grep finds in docs; lines without a match (invert) can stand in any text."""
        rows = docs if how.get("invert") else self.texts(docs, pattern)
        return se.grep(rows, pattern, key=self.key, text=text, **how)
