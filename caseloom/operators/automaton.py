"""Many strings looked for in texts at once: an Aho-Corasick automaton in every task.

The strings travel to the tasks only up to a checked size. The automaton knows their first KEY characters, which
bounds what it takes; what follows is compared where those are found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a string that the automaton knows.
KEY = 32
#: Strings and their bytes (16 MB) up to which they travel; an automaton of as many takes some 150 MB of a worker.
MOST, MOST_BYTES = 65_536, 16 << 20


class Automaton:
    """Places of strings in a text. ``whole``: only where no letter, digit or underscore stands before or after."""

    def __init__(self, strings: Iterable[str], whole: bool = False):
        import ahocorasick

        self.strings, self.whole = sorted(set(strings)), whole
        own = defaultdict(list)
        for k, s in enumerate(self.strings):
            if s:
                own[s[:KEY]].append(k)
        self.machine = ahocorasick.Automaton()
        for key, numbers in own.items():
            self.machine.add_word(key, (len(key), numbers))
        self.empty = not own
        if own:
            self.machine.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, number of the string) of each occurrence, overlapping ones too."""
        if self.empty:
            return
        for last, (size, numbers) in self.machine.iter(text):
            start = last - size + 1
            if self.whole and start and _word(text[start - 1]):
                continue
            for k in numbers:
                s = self.strings[k]
                end = start + len(s)
                if (len(s) <= KEY or text.startswith(s, start)) and not (self.whole and end < len(text) and _word(text[end])):
                    yield start, k

    def held(self, text: str) -> list[str]:
        """The strings that a text contains."""
        return [self.strings[k] for k in {k for _, k in self.places(text)}]


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


_kept: dict[tuple, object] = {}


def once(kind: str, value, make):
    """What ``make`` builds of a broadcast value, once a worker."""
    key = (kind, value.id if hasattr(value, "id") else id(value), getattr(value, "_path", None))
    if key not in _kept:
        _kept.clear()
        _kept[key] = make(value.value)
    return _kept[key]


def sendable(strings: DataFrame, column: str) -> bool:
    """Whether the strings of a column are few and short enough to travel to every task."""
    size = strings.agg(F.count(column).alias("n"), F.sum(F.octet_length(column)).alias("bytes")).first()
    return size["n"] <= MOST and (size["bytes"] or 0) <= MOST_BYTES


def containing(texts: DataFrame, doc: str, text: str, strings: DataFrame, column: str, whole: bool = False) -> DataFrame:
    """(doc, string) for each string of ``strings`` (sendable) that a text contains; a null text contains none."""
    held = [r[0] for r in strings.select(column).where(F.col(column) != "").distinct().collect()]  # MOST rows at most
    sent = texts.sparkSession.sparkContext.broadcast((held, whole))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = once("containing", sent, lambda v: Automaton(*v))
        for batch in batches:
            at, strings = [], []
            for k, t in enumerate(batch.column("text")):  # one text at a time is a Python string
                held = machine.held(t.as_py())
                at += [k] * len(held)
                strings += held
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), pa.array(strings, pa.string())], ["doc", "string"])

    kind = texts.schema[doc].dataType.simpleString()
    few = texts.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return few.mapInArrow(rows, f"doc {kind}, string string").select(F.col("doc").alias(doc), F.col("string").alias(column))


def _same_length_lower(text: str) -> str:
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Redactor:
    """Replaces values by a mark: whole words, any case, the longest value first; counted by kind.

    Where values overlap the longer one is replaced, and of one value the leftmost places; nothing is looked for inside a mark."""

    def __init__(self, values: Iterable[tuple[str, str]], mark: str):
        self.mark = mark
        self.kinds: dict[str, str] = {}
        for value, kind in sorted(set(values), key=lambda v: (v[0].lower(), v[1])):
            self.kinds.setdefault(_same_length_lower(value), kind)  # of equal values the least kind counts
        self.machine = Automaton(self.kinds)

    def __call__(self, text: str) -> tuple[str, Counter]:
        strings, lower = self.machine.strings, _same_length_lower(text)
        hits = sorted((-len(strings[k]), strings[k], start) for start, k in self.machine.places(lower))
        taken: list[tuple[int, int, str]] = []  # places in order, with their values
        counts: Counter = Counter()
        for size, value, start in hits:
            end = start - size
            at = bisect_left(taken, (start,))
            before, after = taken[at - 1] if at else None, taken[at] if at < len(taken) else None
            if (before and before[1] > start) or (after and after[0] < end):
                continue
            # What stands beside a place is the text, or the mark where another value was replaced.
            left = self.mark[-1:] if before and before[1] == start and before[2] != value else lower[max(0, start - 1) : start]
            right = self.mark[:1] if after and after[0] == end and after[2] != value else lower[end : end + 1]
            if (left and _word(left)) or (right and _word(right)):
                continue
            taken.insert(at, (start, end, value))
            counts[self.kinds[value]] += 1
        parts, last = [], 0
        for lo, hi, _ in taken:
            parts += [text[last:lo], self.mark]
            last = hi
        return "".join([*parts, text[last:]]), counts


def usable(values: DataFrame, value: str, least: int = 5) -> DataFrame:
    """Values that may be replaced: trimmed, of ``least`` characters, not only digits."""
    bare = F.trim(F.col(value))
    return values.withColumn(value, bare).where((F.length(bare) >= least) & ~bare.rlike("^[0-9]+$"))


def redact(texts: DataFrame, text: str, values: DataFrame, value: str, kind: str, mark: str) -> DataFrame:
    """``texts`` with ``redacted`` and ``counts`` (a map of kind to replacements). A null text stays null and counts nothing.

    Too many values to travel are an error: they are then joined to their own texts by key (``redact_own``)."""
    if not sendable(values, value):
        raise ValueError("too many values to send to every task: redact each text by its own values")
    held = [(r[0], r[1]) for r in values.select(value, kind).where(F.col(value).isNotNull()).distinct().collect()]
    sent = texts.sparkSession.sparkContext.broadcast((held, mark))
    return _redacted(texts, text, F.lit(None).cast("array<struct<v:string,k:string>>"), sent, mark)


def redact_own(texts: DataFrame, text: str, values: DataFrame, key: str, value: str, kind: str, mark: str) -> DataFrame:
    """redact, but each text by the values of its own key only: any number of values in all."""
    own = values.where(F.col(value).isNotNull()).groupBy(key).agg(F.collect_set(F.struct(F.col(value).alias("v"), F.col(kind).alias("k"))).alias("__values"))
    joined = texts.join(own, key, "left")
    return _redacted(joined, text, F.col("__values"), None, mark).drop("__values")


def _redacted(texts: DataFrame, text: str, own, sent, mark: str) -> DataFrame:
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        shared = once("redact", sent, lambda v: Redactor(*v)) if sent is not None else None
        for column, values in batches:
            done = []
            for t, vs in zip(column, values):
                if t is None:
                    done.append((None, None))
                    continue
                redactor = shared or Redactor([(v["v"], v["k"]) for v in (vs if vs is not None else [])], mark)
                out, counts = redactor(t)
                done.append((out, list(counts.items())))
            yield pd.DataFrame({"text": [d[0] for d in done], "counts": [dict(d[1]) if d[1] is not None else None for d in done]})

    made = F.pandas_udf(each, "text string, counts map<string,bigint>")(F.col(text), own)
    return texts.withColumn("__made", made).withColumn("redacted", F.col("__made.text")).withColumn("counts", F.coalesce(F.col("__made.counts"), F.create_map().cast("map<string,bigint>"))).drop("__made")
