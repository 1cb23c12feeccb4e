"""Collocations by growth of contiguous patterns from frequent prefixes (after PrefixSpan).

Texts are cut into pieces and words. A phrase is frequent only if its words and its neighbouring pairs
are, so that two passes over the texts first count words, then pairs of frequent words, by a 64-bit
key. A third pass projects the corpus onto frequent prefixes: every place where a frequent pair begins leaves a
window, the words from there on as far as pairs stay frequent, at most LONGEST; equal windows are one row with a count.
Windows go to tasks by their prefix. A task holds the sorted windows of its prefixes, in which each pattern is one run of
rows, and grows patterns depth first: a run's sum is the pattern's count, and only frequent runs are entered.

A prefix with very many different windows is dealt by its first two or three words; counts of the
shorter patterns are then partial and are added up afterwards. What travels to every task is a bitmap of bounded
size: a key's bit says that the word or pair may be frequent, and a wrong yes costs a row but no result, as
the counts of results are always those of the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_shuffles, lean, materialize, table
from .text_arrays import Words, finish, text_slices

#: Words of a phrase at most, occurrences at least, share of a longer phrase (hundredths) that makes a shorter one go, phrases of a language.
LONGEST, LEAST, COVERED, FIRST = 4, 30, 80, 2000
#: Score of a phrase whose parts occur nowhere else, times two.
SCALE = 2_000_000
#: Bytes of text handled at once; a longer text is cut between words.
SLICE = 4 << 20
#: Bits of a bitmap for each key, and at most.
BITS_A_KEY, MOST_BITS = 64, 1 << 28
#: Buckets in which windows are counted by prefix, and the windows of one beyond which they are dealt by more words.
BUCKETS, CROWDED = 8192, 5000
#: Shares of a language's phrases that are ranked apart before they are ranked together.
SHARES = 128
#: Windows that a task takes up before it grows their patterns.
TAKEN = 50_000

#: Bytes as they are read: A-Z lower-cased, marks that end a piece as line ends.
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 32]] = True


class Chunk:
    """Words of some texts: ``names`` (different ones), ``code`` (the name of each word), ``lang`` (its row's number), ``own`` (it
    belongs to this chunk, not only to a window that begins in it) and ``next`` (the following word stands in the same piece)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, langs: np.ndarray, own: int):
        buf = _READ[raw]
        words = Words(buf, offs)
        size = words.end - words.start
        ink = buf[~_GAP[buf]]
        where = np.concatenate([[0], np.cumsum(size)])
        each = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(where), pa.py_buffer(ink)).dictionary_encode()
        self.names = each.dictionary
        self.code = np.asarray(each.indices).astype(np.int64)
        row = words.row()
        self.lang = langs[row]
        self.own = words.start < own
        piece = np.cumsum(buf == 10)[words.start]
        self.next = np.zeros(len(row), bool)
        self.next[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])


def _seek(raw: np.ndarray, at: int, gap: bool) -> int:
    """The first place from ``at`` on that is (or isn't) a gap between words."""
    while at < len(raw):
        found = np.flatnonzero(_GAP[_READ[raw[at : at + 4096]]] == gap)
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(raw)


def chunks(texts: pa.Array, langs: np.ndarray) -> Iterator[Chunk]:
    """The texts of a column in chunks of SLICE bytes; a longer one is cut between words, and each part reads on for as
    many words as a window may need."""
    for lo, hi, raw, offs in text_slices(texts, SLICE):
        if hi - lo > 1 or len(raw) <= SLICE:
            yield Chunk(raw, offs, langs[lo:hi], len(raw))
            continue
        at = 0
        while at < len(raw):
            end = stop = _seek(raw, at + SLICE, True)
            for _ in range(LONGEST - 1):
                stop = _seek(raw, _seek(raw, stop, False), True)
            yield Chunk(raw[at:stop], np.array([0, stop - at]), langs[lo:hi], end - at)
            at = end


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word of a column."""
    column = words.cast(pa.large_string())
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if len(column) else np.zeros(0, np.uint8)
    return Words(raw, offs - offs[0]).hashes()


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return _hashes(pa.array([x.encode().hex() + "." for x in langs])) if langs else np.zeros(0, np.uint64)


def _keys(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return finish(lang * np.uint64(0x9E3779B97F4A7C15) + word)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The key of two words from the key (with language) of the first and the hash of the second."""
    return finish(first * np.uint64(0xC2B2AE3D27D4EB4F) ^ ((second >> np.uint64(31)) | (second << np.uint64(33))))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[str]]]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        for chunk in chunks(batch.column("text"), np.asarray(langs.indices).astype(np.int64)):
            if len(chunk.code):
                yield chunk, names


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each chunk, and the sum of n as the row of a null word."""
    for chunk, langs in _read(batches):
        found, n = np.unique(chunk.lang[chunk.own] * len(chunk.names) + chunk.code[chunk.own], return_counts=True)
        lang, code = found // len(chunk.names), found % len(chunk.names)
        whole = np.bincount(lang, n, len(langs)).astype(np.int64)
        words = pa.concat_arrays([chunk.names.take(pa.array(code)), pa.nulls(len(langs), pa.large_string())]).cast(pa.string())
        of = pa.array(langs, pa.string()).take(pa.array(np.concatenate([lang, np.arange(len(langs))])))
        yield pa.record_batch([of, words, pa.array(np.concatenate([n, whole]))], ["lang", "word", "n"])


def _key_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each (lang, word)."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        own = _lang_hashes(langs.dictionary.to_pylist())
        keys = _keys(own[np.asarray(langs.indices)], _hashes(batch.column("word"))) if len(batch) else np.zeros(0, np.uint64)
        yield pa.record_batch([pa.array(keys.view(np.int64))], ["key"])


class Bitmap:
    """Which keys may be in a set; a set bit can stand for another key with the same last bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """The bitmap of a column ``key`` of ``count`` numbers: BITS_A_KEY bits a key, at most MOST_BITS (32 MB)."""
    size = 1 << 15
    while size < min(count * BITS_A_KEY, MOST_BITS):
        size *= 2
    at = F.col("key").bitwiseAND(F.lit(size - 1)) + 1
    parts = keys.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.collect():  # 4 KB for each of size / 2^15 buckets
        bits[(r["bucket"] - 1) << 12 : r["bucket"] << 12] = np.frombuffer(r["bits"], np.uint8)
    return bits


class _Links:
    """Of a chunk's words, keys and which may be frequent."""

    def __init__(self, chunk: Chunk, langs: list[str], words: Bitmap):
        self.hashes, self.chunk, n = _hashes(chunk.names), chunk, len(chunk.names)
        # Keys of the different (lang, word) that occur, and which of them each word is.
        both, self.word = np.unique(chunk.lang * n + chunk.code, return_inverse=True)
        self.keys = _keys(_lang_hashes(langs)[both // n], self.hashes[both % n])
        may = words.holds(self.keys)[self.word]
        self.link = chunk.next.copy()
        self.link[:-1] &= may[:-1] & may[1:]

    def pairs(self, only: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and counts of the different pairs among the links in ``only``, and the pair of each link."""
        n, at = len(self.chunk.names), np.flatnonzero(only)
        found, pair, count = np.unique(self.word[at] * n + self.chunk.code[at + 1], return_inverse=True, return_counts=True)
        return _pair_keys(self.keys[found // n], self.hashes[found % n]), count, pair


def _count_pairs(words):
    """(key, n) of each chunk's pairs of words that may both be frequent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bitmap(words.value)
        for chunk, langs in _read(batches):
            links = _Links(chunk, langs, held)
            keys, n, _ = links.pairs(links.link & chunk.own)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    return rows


def _project(words, pairs):
    """(lang, phrase, n) of each chunk's windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = Bitmap(words.value), Bitmap(pairs.value)
        for chunk, langs in _read(batches):
            links = _Links(chunk, langs, held)
            keys, _, pair = links.pairs(links.link)
            link = links.link
            link[link] = joined.holds(keys)[pair]
            begin = np.flatnonzero(link & chunk.own)
            if not len(begin):
                continue
            n = len(chunk.names)
            # Places of a window's later words, 0 where it has ended.
            code, on = [chunk.code[begin] + 1, chunk.code[begin + 1] + 1], np.ones(len(begin), bool)
            for k in range(1, LONGEST - 1):
                at = np.minimum(begin + k, len(link) - 2)
                on = on & link[begin + k - 1] & link[at] & (begin + k < len(link) - 1)
                code.append(np.where(on, chunk.code[at + 1] + 1, 0))
            _, first = np.unique(links.word[begin] * n + chunk.code[begin + 1], return_inverse=True)
            rest = np.zeros(len(begin), np.int64)
            for c in code[2:]:
                rest = rest * (n + 1) + c
            _, at, count = np.unique(first * (n + 1) ** (LONGEST - 2) + rest, return_index=True, return_counts=True)
            names = chunk.names.cast(pa.string())
            parts = [names.take(pa.array(c[at] - 1, mask=c[at] == 0)) for c in code]
            phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
            yield pa.record_batch([pa.array(langs, pa.string()).take(pa.array(chunk.lang[begin][at])), phrase, pa.array(count)], ["lang", "phrase", "n"])

    return rows


def grown(words: np.ndarray, lang: np.ndarray, n: np.ndarray, unit: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, words, count) of the patterns in sorted windows: the first ``words`` words of a row.

    ``words`` has a window's words as numbers (-1 past its end), ``unit`` the words by which it was dealt: shorter patterns
    are partial and are given whatever their count."""
    rows, longest = words.shape
    change = np.ones(rows, bool)
    change[1:] = lang[1:] != lang[:-1]
    begins = []
    for k in range(longest):
        change[1:] |= words[1:, k] != words[:-1, k]
        begins.append(np.flatnonzero(change))
    total = np.concatenate([[0], np.cumsum(n)])
    found: list[tuple[int, int, int]] = []

    def extend(lo: int, hi: int, depth: int) -> None:
        own = begins[depth - 1]
        heads = own[np.searchsorted(own, lo) : np.searchsorted(own, hi)]
        ends = np.append(heads[1:], hi)
        count = total[ends] - total[heads]
        kept = (words[heads, depth - 1] >= 0) & ((count >= least) | (unit[heads] > depth))
        for a, b, c in zip(heads[kept].tolist(), ends[kept].tolist(), count[kept].tolist()):
            if depth > 1:
                found.append((a, depth, c))
            if depth < longest:
                extend(a, b, depth + 1)

    extend(0, rows, 1)
    return found


def _grow(least: int):
    """(lang, phrase, n) of the patterns among a task's windows, which come sorted by (lang, phrase)."""

    def grow(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        phrase = part["phrase"].combine_chunks()
        lists = pc.split_pattern(phrase, " ")
        size = np.asarray(lists.value_lengths())
        flat = lists.flatten().dictionary_encode()
        words = np.full((len(phrase), LONGEST), -1, np.int64)
        words[np.arange(LONGEST) < size[:, None]] = np.asarray(flat.indices)
        langs = part["lang"].combine_chunks().dictionary_encode()
        found = np.array(grown(words, np.asarray(langs.indices), np.asarray(part["n"]), np.asarray(part["unit"]), least), np.int64).reshape(-1, 3)
        codes = words[found[:, 0]]
        names = flat.dictionary
        parts = [names.take(pa.array(np.maximum(codes[:, k], 0), mask=found[:, 1] <= k)) for k in range(LONGEST)]
        joined = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
        return pa.record_batch([part["lang"].combine_chunks().take(pa.array(found[:, 0])), joined.cast(pa.string()), pa.array(found[:, 2])], ["lang", "phrase", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < TAKEN:
                continue
            # The last unit may go on in the next batch: what is before it can be grown.
            part = pa.Table.from_batches(held)
            name = pc.binary_join_element_wise(part["lang"], part["name"], "\n").combine_chunks()
            last = int(pc.index(name, name[-1]).as_py())
            if last:
                yield grow(part.slice(0, last))
                held = part.slice(last).combine_chunks().to_batches()
                size = len(part) - last
        if held:
            yield grow(pa.Table.from_batches(held))

    return rows


def _head(k: int):
    return F.substring_index("phrase", " ", k)


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of words, where the row of a null word counts all of its language's, and (lang, phrase, n) of phrases
    of 2 to LONGEST words, all that occur ``least`` times or more in their language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(lean(_count_words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "phrase-words")
    own = words.where(F.col("word").isNotNull())
    held = spark.sparkContext.broadcast(bitmap(own.select("lang", "word").mapInArrow(_key_words, "key bigint"), own.count()))
    drop_shuffles(spark)
    pairs = rows.mapInArrow(lean(_count_pairs(held)), "key bigint, n int").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs.where(F.col("n") >= least).select("key"), "phrase-pairs")
    joined = spark.sparkContext.broadcast(bitmap(pairs, pairs.count()))
    drop_shuffles(spark)
    windows = materialize(rows.mapInArrow(lean(_project(held, joined)), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrase-windows")
    drop_shuffles(spark)
    dealt = _dealt(windows).repartition("lang", "name").sortWithinPartitions("lang", "phrase")
    partial = dealt.mapInArrow(lean(_grow(least)), "lang string, phrase string, n bigint")
    phrases = partial.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, materialize(phrases, "phrase-counts")


def _dealt(windows: DataFrame) -> DataFrame:
    """``windows`` with ``unit``, by how many of their first words they are dealt to tasks, and ``name``, these words.

    Prefixes are counted in BUCKETS; those of a crowded bucket are dealt by one more word."""
    bucket = lambda k: F.pmod(F.xxhash64("lang", _head(k)), F.lit(BUCKETS))
    unit = F.lit(1)
    for k in (1, 2):
        own = windows.where(unit == k).groupBy(bucket(k).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWDED)
        crowded = [r["bucket"] for r in own.collect()]  # BUCKETS rows at most
        unit = F.when((unit == k) & bucket(k).isin(crowded), k + 1).otherwise(unit) if crowded else unit
    return windows.withColumn("unit", unit).withColumn("name", F.when(F.col("unit") == 1, _head(1)).when(F.col("unit") == 2, _head(2)).otherwise(_head(3)))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut with the lowest score, ``n`` all words of the language. Phrases
    of which a longer one has ``covered`` hundredths of the occurrences go. Null and empty texts have no words; a null language is
    ``und``; repeated rows count as often as they are there; an empty table, or one without a frequent phrase, gives no rows.
    Other columns are ignored. Texts of any length are read whole, in parts.
    """
    words, phrases = frequent(docs, text, lang, least)
    counts = phrases.unionByName(words.where(F.col("word").isNotNull()).withColumnRenamed("word", "phrase"))
    split = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    of = lambda name, n: counts.select(F.col("lang"), F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The parts of longer phrases, and the count of the most frequent phrase that holds each.
    inner = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))
    held = split.where(F.size("w") > 2).select("lang", "a", F.explode(F.flatten(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.col("more").isNull() | (100 * F.col("more") < covered * F.col("a")))
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # The first of each share of a language's phrases, then of those: no task sorts a whole language.
    best_first = [F.desc("score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*best_first)
    few = flat.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)).cast("bigint")).where(F.col("rank") <= first)
    totals = words.where(F.col("word").isNull()).select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP11_SQL = f"""WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest(range(1, {LONGEST} + 1)) AS m FROM pieces)) GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS first, array_to_string(list_slice(w, k + 1, m), ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST(({SCALE}::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON c.lang = l.lang AND c.first = l.phrase JOIN counts r ON c.lang = r.lang AND c.rest = r.phrase),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
held AS (SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS more
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.phrase WHERE h.more IS NULL OR 100 * h.more < {COVERED} * b.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, CAST(encode(phrase) AS BLOB)) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)) WHERE rank <= {FIRST}"""
