"""Token ids as range-coded binary output.

Texts become token ids; the ids of all documents, in ascending doc_id order, are
written as blocks of a static range asymmetric numeral system (Duda 2013, the
"rANS" form). One frequency table, counted over the whole corpus, serves all
blocks. A block holds whole documents and is independent of every other: its
tokens go round ``LANES`` interleaved coder states that share one stream of 32-bit
words, checkpoints hold the states at fixed steps so that a decoder may begin
inside a block, and a CRC-32 covers what a decoder reads.

File format: a folder with two Parquet tables that any Spark store can hold.
``frequencies`` has (token, freq), summing to 2^bits; ``blocks`` has one row a block
(see ``BLOCKS``), each with its documents' ids and lengths. Parquet's commit
protocol makes a lost executor's blocks appear once or not at all.
"""

from __future__ import annotations

import json
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialize, shared_dir, table, worker_caches

#: Interleaved coder states of a block.
LANES = 2048
#: Steps (of LANES tokens) between checkpoints.
CHECKPOINT = 128
#: Tokens after which a block ends with its document.
BLOCK = 1 << 19
#: Tokens of a range partition on average, and the most partitions.
PART, MOST_PARTS = 4_000_000, 100_000
#: Least coder state: states stay in [2^31, 2^63).
_LOW, _ONE = np.uint64(1 << 31), np.uint64(1)
#: Words that a worker keeps with their ids; then it begins anew, with those that it meets again.
CACHE = 500_000
#: Bytes of text encoded at once; a single longer text makes a longer slice.
SLICE = 2 << 20

_INSIDE_GAP = re.compile(r"\s \s|\s \Z")
#: White space before a space, without which no run of it is cut; of the rarer kinds any place counts.
_GAPS = ["  ", "\n ", *(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n")]
_ASCII_GAPS = [g for g in _GAPS if g.isascii()]


#: What may stand at a word's end and is then one piece of the pattern of its own.
_TAIL = ".,!?;:%$*&#|"
_SIGN = np.full(256, -1, np.int64)
_SIGN[np.frombuffer(_TAIL.encode(), np.uint8)] = np.arange(len(_TAIL))
_PLAIN = np.zeros(256, bool)
_PLAIN[np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8)] = True
#: Stands for a single line break while a text is cut; a text that holds it is encoded whole.
LINE = "\x1d"


def _byte_letters() -> list[str]:
    """The letter that a byte-level tokenizer writes for each byte: printable bytes
    stand for themselves, the others in turn for U+0100 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer, from the ids of their words.

    Its pattern never joins what stands before a space with what follows, so
    a text is cut before its spaces; each different piece (with its space) of a slice of texts is
    looked up or encoded once, and the texts' ids are gathered from those of the pieces. That holds
    unless a cut falls inside a run of white space, or a special token's own string is
    in the text; such texts are encoded whole, and so is every text of a tokenizer of
    another kind. A single line break between two other characters is a piece of the
    pattern by itself, so that a text is also cut before those. A piece of Latin letters
    with a tail of punctuation is two pieces of the pattern; the BPE model encodes those directly.
    """

    def __init__(self, spec: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype({2: "<u2", 4: "<u4"}[width])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(spec)
        cut = kind.get("pre_tokenizer") or {}
        self.by_piece = kind.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and kind["model"].get("type") == "BPE"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.spelling = dict(enumerate(self.letters))
        self.words: dict[str, bytes] = {}  # what follows a space
        self.bare: dict[str, bytes] = {}  # what doesn't
        self.older: dict[str, bytes] = {}  # words of the generation before

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word(self, word: str, spaced: bool) -> bytes | None:
        """Ids of Latin letters, or of a tail of punctuation; None if it is anything else."""
        cache = self.words if spaced else self.bare
        found = cache.get(word)
        if found is None and spaced and (found := self.older.get(word)) is not None:
            cache[word] = found
        if found is None:
            if word.isascii():
                if not word.isalpha() and word.strip(_TAIL):
                    return None
                spelt = word
            elif word.isalpha() and max(word) < "\u0250":
                spelt = word.encode().decode("latin-1").translate(self.spelling)
            else:
                return None
            found = cache[word] = self._pack([t.id for t in self.model.tokenize(self.letters[32] + spelt if spaced else spelt)])
        return found

    def _pieces(self, pieces: list[str], spaced: bool) -> list[bytes]:
        """Ids of pieces; one that begins with LINE stands after a line break, not after a space."""
        out: list[bytes] = []
        rest: list[str] = []
        at: list[int] = []
        cache, word_of = self.words if spaced else self.bare, self._word
        for piece in pieces:
            ids = cache.get(piece)
            if ids is None:
                own, lead, body = spaced, b"", piece
                if piece[:1] == LINE:
                    own, lead, body = False, self.line_break, piece[1:]
                word = body.rstrip(_TAIL)
                ids = word_of(word, own) if word else b"" if lead and not body else None
                if ids is None:
                    at.append(len(out))
                    rest.append("\n" + body if lead else " " + body if own else body)
                    ids = b""
                else:
                    ids = lead + ids + (word_of(body[len(word) :], False) if len(word) < len(body) else b"")
            out.append(ids)
        for k, ids in zip(at, self._encode(rest)):
            out[k] = ids
        return out

    @cached_property
    def line_break(self) -> bytes:
        return self._encode(["\n"])[0]

    def _cut_safely(self, text: str) -> bool:
        gaps = _ASCII_GAPS if text.isascii() else _GAPS
        if any(g in text for g in gaps) and _INSIDE_GAP.search(text):
            return False
        return self.by_piece and LINE not in text and not any(s in text for s in self.special)

    @staticmethod
    def _breaks_safely(text: str) -> bool:
        """Whether each line break stands alone between other characters."""
        return not any(g in text for g in ("\n\n", " \n")) and not any(g in text for g in (_ASCII_GAPS if text.isascii() else _GAPS))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and where each text's begin (one more entry than texts)."""
        if len(self.words) > CACHE:
            self.words, self.older = {}, self.words
        if len(self.bare) > CACHE:
            self.bare.clear()
        cut, whole = [], []
        for k, text in enumerate(texts):
            if not self._cut_safely(text):
                whole.append(k)
                cut.append("")
            else:
                cut.append(text.replace("\n", " " + LINE) if "\n" in text and self._breaks_safely(text) else text)
        parts = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        heads, n = np.asarray(parts.offsets)[:-1], np.asarray(parts.value_lengths())
        flat, tail, n = self._split_tails(parts.flatten(), heads, n)
        heads = np.cumsum(n) - n
        # A text's first piece has no space before it: it is a value of its own, as is a text encoded whole.
        first = [cut[k].partition(" ")[0] for k in range(len(texts))]
        own = dict(zip(whole, self._encode([texts[k] for k in whole])))
        bare = iter(self._pieces([x for k, x in enumerate(first) if x and k not in own], False))
        rows = [own[k] if k in own else next(bare) if x else b"" for k, x in enumerate(first)]
        known = flat.dictionary_encode()
        signs = [self._word(c, False) for c in _TAIL]
        values = [*rows, np.array([end], self.dtype).tobytes(), *signs, *self._pieces(known.dictionary.to_pylist(), True)]
        code = np.asarray(known.indices).astype(np.int64) + (len(texts) + 1 + len(signs))
        code[tail >= 0] = len(texts) + 1 + tail[tail >= 0]
        code[heads] = np.arange(len(texts))
        stops = np.cumsum(n)
        code = np.insert(code, stops, len(texts))
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        stock = np.frombuffer(b"".join(values), self.dtype)
        length = size[code]
        stop = np.cumsum(length)
        ids = stock[np.repeat(begin[code] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.concatenate([[0], stop[stops + np.arange(len(texts))]])

    @staticmethod
    def _split_tails(flat: pa.LargeStringArray, heads: np.ndarray, n: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
        """Pieces of which a single mark after a Latin letter or digit is a piece of its own: the pieces, the mark's
        number in _TAIL (or -1), and the pieces of each text. First pieces stay as they are."""
        if not len(flat):
            return flat, np.zeros(0, np.int64), n
        _, where, data = flat.buffers()
        offs = np.frombuffer(where, np.int64)[flat.offset : flat.offset + len(flat) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        ends, size = offs[1:], np.diff(offs)
        cut = (size > 1) & (_SIGN[raw[np.maximum(ends, 1) - 1]] >= 0) & _PLAIN[raw[np.maximum(ends, 2) - 2]]
        cut[heads] = False
        at = np.flatnonzero(cut)
        offs = np.insert(offs, at + 1, ends[at] - 1)
        tail = np.full(len(offs) - 1, -1, np.int64)
        tail[at + np.arange(1, len(at) + 1)] = _SIGN[raw[ends[at] - 1]]
        each = np.add.reduceat(cut.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), data]), tail, n + each


_encoders: dict[tuple, WordEncoder] = {}
worker_caches["token_output"] = _encoders


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


TOKENS = "doc_id bigint, tie bigint, n int, ids binary"


def _tokenize(spec, width: int, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (len(spec.value), hash(spec.value), width)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = WordEncoder(spec.value, width)
        encoder = _encoders[key]
        for batch in _gathered(batches, SLICE):
            column = batch.column("text").fill_null("").cast(pa.large_string())
            offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1)
                ids, first = encoder.encode(column.slice(lo, hi - lo).to_pylist(), end)
                raw, bounds = ids.tobytes(), first * width
                view = memoryview(raw)
                ties = [zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ties, pa.int64()), pa.array(np.diff(first).astype(np.int32)), packed.cast(pa.binary())], names=["doc_id", "tie", "n", "ids"])
                lo = hi

    return rows


def _counts(width: int, vocabulary: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}")
            total += np.bincount(ids, minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["token", "n"])

    return rows


def quantize(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies in proportion to counts that sum to 2^bits, 1 at least where a count is."""
    size = 1 << bits
    seen = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(seen):
        return freq
    if len(seen) > size:
        raise ValueError(f"{len(seen)} symbols do not fit {bits} bits")
    spare = size - len(seen)
    share = counts[seen].astype(np.float64) / counts[seen].sum() * spare
    freq[seen] = 1 + np.floor(share).astype(np.int64)
    short = size - int(freq.sum())
    most = seen[np.argsort(np.floor(share) - share, kind="stable")[:short]]  # largest remainders
    freq[most] += 1
    return freq


class Model:
    """A frequency table with what the coder looks up in it."""

    def __init__(self, freq: np.ndarray):
        total = int(freq.sum())
        self.bits = max(1, total.bit_length() - 1)
        if total and total != 1 << self.bits:
            raise ValueError("frequencies don't sum to a power of two")
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, model: Model, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the stream, the states from which decoding begins at step 0, every,
    2 * every, ... (one row each), and the word at which it begins there."""
    bits, shift = np.uint64(model.bits), np.uint64(63 - model.bits)
    state = np.full(lanes, _LOW, np.uint64)
    steps = -(-len(ids) // lanes)
    out, marks, written, points = [], [], [], 0
    half = np.uint64(32)
    for t in range(steps - 1, -1, -1):
        own = ids[t * lanes : (t + 1) * lanes]
        f = model.freq[own]  # looked up step by step: what a step reads stays in the cache
        x = state[: len(f)]
        full = np.flatnonzero(x >= f << shift)
        spilled = x[full]
        out.append(spilled.astype("<u4"))
        points += len(spilled)
        x[full] = spilled >> half
        q = x // f
        x += q * ((_ONE << bits) - f) + model.start[own]  # (q << bits) + x % f + start
        if t % every == 0:
            marks.append(state.copy())
            written.append(points)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    states = np.array(marks[::-1], np.uint64).reshape(-1, lanes)
    return words, states, len(words) - np.array(written[::-1], np.int64)


def decode_steps(words: np.ndarray, state: np.ndarray, at: int, n: int, model: Model) -> np.ndarray:
    """``n`` tokens from a checkpoint on: its states, and the word at which it begins."""
    lanes, bits = len(state), np.uint64(model.bits)
    low, half = np.uint64((1 << model.bits) - 1), np.uint64(32)
    slots, freq, start = model.slots, model.freq, model.start
    state, wide = state.copy(), words.astype(np.uint64)
    ids = np.empty(n, np.int32)
    for lo in range(0, n, lanes):
        x = state[: min(lanes, n - lo)]
        slot = x & low
        s = slots[slot]
        ids[lo : lo + len(x)] = s
        x[:] = freq[s] * (x >> bits) + slot - start[s]
        thin = np.flatnonzero(x < _LOW)
        x[thin] = (x[thin] << half) | wide[at : at + len(thin)]
        at += len(thin)
    return ids


def checksum(words: bytes, states: bytes) -> int:
    return zlib.crc32(states, zlib.crc32(words))


BLOCKS = (
    "part int, block int, n_tokens bigint, lanes int, every int, words binary, states binary, points array<bigint>, "
    "crc bigint, doc_ids array<bigint>, lengths array<int>"
)


def _encode(width: int, model_freq: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, part, block = Model(model_freq), TaskContext.get().partitionId(), 0
        docs, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), f"<u{width}")
            words, states, points = encode_block(ids, model)
            w, s = words.tobytes(), states.astype("<u8").tobytes()
            row = {"part": part, "block": block, "n_tokens": len(ids), "lanes": LANES, "every": CHECKPOINT, "words": w, "states": s, "points": points.tolist(), "crc": checksum(w, s), "doc_ids": docs, "lengths": lengths}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("lanes", pa.int32()), ("every", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("points", pa.list_(pa.int64())), ("crc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
        )
        for batch in batches:
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                lengths.append(n)
                parts.append(ids)
                held += n
                if held >= BLOCK:
                    yield close()
                    block, docs, lengths, parts, held = block + 1, [], [], [], 0
        if docs:
            yield close()

    return rows


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end: int = 0) -> None:
    """Encode every text of ``docs`` into ``folder`` (see the module's format).

    Null texts are empty; every document ends with token ``end``. Documents go in
    ascending doc_id order, null ids first; rows with one doc_id by a checksum of
    their ids. An empty table makes an empty output. The text is tokenized once:
    its ids are kept in the shared folder, counted there, and range-partitioned.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    vocabulary = max(Tokenizer.from_str(spec).get_vocab_size(), end + 1)
    if vocabulary > 1 << 22 or len(spec) > 64 << 20:
        raise ValueError("the tokenizer is too large to be sent to every executor")
    width = 2 if vocabulary <= 1 << 16 else 4
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialize(keyed.mapInArrow(lean(_tokenize(spark.sparkContext.broadcast(spec), width, end)), TOKENS), "token-ids")
    found = tokens.select("ids").mapInArrow(lean(_counts(width, vocabulary)), "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # one row a symbol at most
    counts = np.zeros(vocabulary, np.int64)
    counts[found["token"]] = found["n"]
    freq = quantize(counts, vocabulary.bit_length() + 3)
    seen = np.flatnonzero(freq)
    table = spark.createDataFrame([(int(t), int(freq[t])) for t in seen], "token int, freq bigint").coalesce(1)
    table.write.parquet(f"{folder}/frequencies")
    n = int(min(max(1, -(-int(counts.sum()) // PART)), MOST_PARTS))
    ordered = tokens.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(lean(_encode(width, freq)), BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


DOCS = "part int, block int, place int, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


def _decode(freq: np.ndarray, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(freq)
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if checksum(row["words"], row["states"]) != row["crc"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                states = np.frombuffer(row["states"], "<u8").reshape(-1, row["lanes"])
                words, span = np.frombuffer(row["words"], "<u4"), row["lanes"] * row["every"]
                pieces = [decode_steps(words, s, p, min(span, row["n_tokens"] - j * span), model) for j, (s, p) in enumerate(zip(states, row["points"]))]
                ids = np.concatenate(pieces).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(row["lengths"])])
                texts = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                n = len(texts)
                out = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                names = ["part", "block", "place", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([np.frombuffer(t, "<u4").astype(np.int32) for t in texts], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document (and ids), decoded from the files.

    Blocks decode in parallel, each checked against its checksum. ``start`` is a
    prefix sum in two levels: over the parts (one row a part), then over a part's
    blocks and documents, of which only the lengths are shuffled.
    """
    table = spark.read.schema("token int, freq bigint").parquet(f"{folder}/frequencies").toPandas()  # one row a symbol
    freq = np.zeros(int(table["token"].max()) + 1 if len(table) else 0, np.int64)
    freq[table["token"]] = table["freq"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    docs = blocks.mapInArrow(lean(_decode(freq, with_ids)), DOCS + (", ids array<int>" if with_ids else ""))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    inside = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0)).alias("block_start"))
    starts = inside.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    placed = docs.join(starts, ["part", "block"])
    offset = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part", "block").orderBy("place"))), F.lit(0))
    return placed.select("doc_id", (F.col("block_start") + offset).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def encoded(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token ids and read the documents back from the files."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, folder)
    return read_tokens(spark, folder)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_token_output(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), tokenizer_path())
