"""BPE encoding and decoding by a trie of words with shared prefixes.

A BPE encoding of a word holds the encoding of each of its prefixes: the state of a prefix is its
last token, and the tokens before that are the encoding of the shorter prefix on which it stands.
The distinct words of a slice of texts, in order, are a trie read depth first: a word
shares with its predecessor all nodes up to their common prefix, and only the states
of new nodes are computed. A node's last token is the one token that ends there and
can follow the last token of the prefix before it; whether one token can follow another is a property of the
two, kept once known. A word's last letter carries the end-of-word mark and is a node of its own.

Normalizing, cutting texts into words and the special tokens follow the tokenizer's
file; each different run of characters between ASCII spaces is cut once a worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, table
from .token_output import _byte_letters

#: Bytes of text encoded at once; a single longer text makes a longer slice.
SLICE = 4 << 20
#: Chunks (runs of characters between spaces) and words that a worker keeps with their ids; then it begins anew.
CACHE = 400_000
#: Letters at a prefix's end by which the longest token that may end there is looked up.
TAIL = 3
#: Pairs of tokens whose answer a worker keeps.
PAIRS = 1_000_000



def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Fixed value: how this kind of tokenizer cuts words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of which neither form nor case depends on more than a character: printable ASCII and Latin letters up to U+024F.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: SPLIT for lower-cased chunks of those.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+")


class WordTrie:
    """Ids of words by a BPE vocabulary: ``merges`` in order of rank, ``ids`` of all tokens.

    A word is a string of letters; its last one bears ``suffix``."""

    def __init__(self, ids: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.ids, self.suffix = ids, suffix
        self.rank: dict[tuple[str, str], int] = {}
        self.halves: dict[str, tuple[int, str, str]] = {}  # of a merged token: when it came to be, and out of what
        for k, (a, b) in enumerate(merges):
            self.rank[a, b] = k
            self.halves.setdefault(a + b, (k, a, b))
        self.known: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}
        reached = [t for t in ids if self.whole(t)]
        self.final = {t for t in reached if t.endswith(suffix)}
        self.inner = set(reached) - self.final
        self.inner_reach, self.final_reach = self._reach(self.inner, 0), self._reach(self.final, len(suffix))

    @staticmethod
    def _reach(tokens: set[str], suffix: int) -> dict[str, int]:
        """The most letters of a token that ends in some TAIL letters (or is shorter and is them)."""
        reach: dict[str, int] = {}
        for t in tokens:
            size = len(t) - suffix
            tail = t[max(0, size - TAIL) : size]
            reach[tail] = max(reach.get(tail, 0), size)
        return reach

    def follows(self, a: str, b: str) -> bool:
        """Whether a text that ends in token ``a`` and goes on with token ``b`` keeps both.

        Both are undone step by step, the younger first. What stood at the seam must never have
        been a pair that merges before one of the two went into something larger: a merge with the neighbour at the left goes
        first if it is of a lower or the same rank, as equal merges go from left to right; one at the right only if it is of a lower rank.
        """
        found = self.known.get((a, b))
        if found is not None:
            return found
        x, y, until, left = a, b, len(self.rank), True
        while True:
            r = self.rank.get((x, y))
            if r is not None and (r < until or (r == until and not left)):
                out = False
                break
            p, q = self.halves.get(x), self.halves.get(y)
            if p is None and q is None:
                out = True
                break
            if q is None or (p is not None and p[0] > q[0]):
                until, left, x = p[0], True, p[2]
            else:
                until, left, y = q[0], False, q[1]
        if len(self.known) > PAIRS:
            self.known.clear()
        self.known[a, b] = out
        return out

    def whole(self, token: str) -> bool:
        """Whether the letters of a token encode as that token."""
        found = self.sound.get(token)
        if found is None:
            parts = self.halves.get(token)
            found = parts is None or (self.whole(parts[1]) and self.whole(parts[2]) and self._joins(token, *parts))
            self.sound[token] = found
        return found

    def _joins(self, token: str, rank: int, a: str, b: str) -> bool:
        """Whether nothing but the merge of ``a`` and ``b`` itself happens at their seam."""
        x, y, until, left = a, b, rank, True
        while True:
            r = self.rank.get((x, y))
            if r is not None and (x, y) != (a, b) and (r < until or (r == until and not left)):
                return False
            p, q = self.halves.get(x), self.halves.get(y)
            if p is None and q is None:
                return True
            if q is None or (p is not None and p[0] > q[0]):
                until, left, x = p[0], True, p[2]
            else:
                until, left, y = q[0], False, q[1]

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each different word, as 32-bit numbers."""
        out: dict[str, bytes] = {}
        ids, inner, suffix, known, follows = self.ids, self.inner, self.suffix, self.known, self.follows
        inner_reach, final_reach = self.inner_reach, self.final_reach
        before, tokens = "", [""]  # tokens: the last token of each prefix of ``before``
        for word in sorted(set(words)):
            size = len(word)
            shared = len(os.path.commonprefix((before, word[:-1])))
            del tokens[shared + 1 :]
            for at in range(shared + 1, size + 1):
                end, vocabulary, reach = ("", inner, inner_reach) if at < size else (suffix, self.final, final_reach)
                far = at - reach.get(word[at - TAIL : at] if at > TAIL else word[:at], TAIL - 1)
                for lo in range(far if far > 0 else 0, at):  # the longest first: one of them fits
                    token = word[lo:at] + end
                    if token in vocabulary and (lo == 0 or (known.get((tokens[lo], token)) or follows(tokens[lo], token))):
                        break
                else:
                    raise ValueError(f"no token ends at {word[max(0, at - 20):at]!r}")
                if at < size:
                    tokens.append(token)
            before, found, at = word[:-1], [ids[token]], lo
            while at:
                token = tokens[at]
                found.append(ids[token])
                at -= len(token)
            found.reverse()
            out[word] = array("i", found).tobytes()
        return out


class ChunkEncoder:
    """Ids of whole texts, and texts of ids, as the tokenizers library gives them."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        kind = json.loads(spec)
        model = kind["model"]
        suffix = model.get("end_of_word_suffix")
        unlike = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or not suffix or unlike or kind.get("decoder") or any(t[k] for t in kind["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("not a BPE tokenizer with a mark at the end of words and without a decoder")
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.trie = WordTrie(model["vocab"], pairs, suffix)
        tokenizer = Tokenizer.from_str(spec)
        self.normalizer, self.cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in kind["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        named = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        self.size = max(named) + 1
        self.names = pa.array([named.get(i) for i in range(self.size)], pa.string())
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # Chunks of Latin letters, digits and marks are cut here, where the file's rules are those of _WORDS.
        own = (kind.get("normalizer") or {}).get("normalizers", []), (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = [n.get("type") for n in own[0]] == ["NFC", "Replace", "Lowercase"] and [n.get("type") for n in own[1]] == ["Split", "ByteLevel"] and own[1][0].get("pattern") == {"Regex": SPLIT} and not own[1][1].get("use_regex")
        self.letters = dict(enumerate(_byte_letters()))

    def _cut(self, chunk: str) -> list[str | bytes]:
        """The words of a chunk and, packed, the ids of the special tokens in it, in order."""
        if self.plain and _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            chunk = chunk.lower()
            words = [chunk] if chunk.isalpha() else _WORDS.findall(chunk)
            return words if chunk.isascii() else [w.encode().decode("latin-1").translate(self.letters) for w in words]
        out: list[str | bytes] = []
        for part in self._special.split(chunk) if self._special else [chunk]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                out += [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Chunks are kept for two generations."""
        if len(self.chunks) > CACHE:
            self.chunks, self.older = {}, self.chunks
        if len(self.words) > CACHE:
            self.words = {}
        known, older, words = self.chunks, self.older, self.words
        new: dict[str, list[str | bytes]] = {}
        for c in chunks:
            if c not in known:
                if (found := older.get(c)) is not None:
                    known[c] = found
                else:
                    new[c] = self._cut(c)
        fresh = {w for cut in new.values() for w in cut if isinstance(w, str)}
        fresh.difference_update(words)
        words.update(self.trie.encode(fresh))
        for chunk, cut in new.items():
            known[chunk] = words[cut[0]] if len(cut) == 1 and isinstance(cut[0], str) else b"".join([words[w] if isinstance(w, str) else w for w in cut])
        return [known[c] for c in chunks]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text of a column without nulls."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = parts.flatten().dictionary_encode()
        code = np.asarray(flat.indices).astype(np.int64)
        values = self._encode_chunks(flat.dictionary.to_pylist())
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin = np.cumsum(size) - size
        stock = np.frombuffer(b"".join(values), np.int32)
        length = size[code]
        stop = np.concatenate([[0], np.cumsum(length)])
        ids = stock[np.repeat(begin[code] - stop[:-1], length) + np.arange(stop[-1])]
        ends = np.concatenate([[0], np.cumsum(np.asarray(parts.value_lengths()))])
        return pa.LargeListArray.from_arrays(pa.array(stop[ends], pa.int64()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list of ids, one space between them; an id that no token has is left out."""
        ids = ids.cast(pa.large_list(pa.int32()))
        flat = np.asarray(ids.flatten())
        fine = (flat >= 0) & (flat < self.size)
        names = self.names.take(pa.array(np.where(fine, flat, 0)))
        ends = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))])
        if self.names.null_count or not fine.all():
            keep = fine & np.asarray(names.is_valid())
            ends, names = np.concatenate([[0], np.cumsum(keep)])[ends], names.filter(pa.array(keep))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names), " ")


_encoders: dict[tuple, ChunkEncoder] = {}


def _encoder(spec) -> ChunkEncoder:
    key = (len(spec.value), hash(spec.value))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(spec.value)
    return _encoders[key]


def _slices(batch: pa.RecordBatch, column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have SLICE bytes, or of one row."""
    size = np.asarray(pc.binary_length(column)).astype(np.int64)
    stop = np.cumsum(size)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, hi
        lo = hi


def _code(spec, text: str, ids: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            column = batch.column(text).fill_null("").cast(pa.large_string())
            for lo, hi in _slices(batch, column):
                found = encoder.encode(column.slice(lo, hi - lo))
                own = batch.slice(lo, hi - lo)
                kept = [k for k, name in enumerate(own.schema.names) if name != text]
                yield pa.record_batch([*(own.column(k) for k in kept), found.cast(pa.list_(pa.int32())), encoder.decode(found).cast(pa.string())], [*(own.schema.names[k] for k in kept), ids, "__decoded"])

    return rows


def _decode(spec, ids: str, text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            yield batch.append_column(text, encoder.decode(batch.column(ids)).cast(pa.string()))

    return rows


def _spec(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``key``, ``ids`` (what the tokenizer encodes the whole text to, without special tokens added) and ``decoded``
    (what it decodes those ids to, special tokens kept).

    Null and empty texts have no ids and decode to an empty text; repeated rows stay rows of their own; an empty table stays
    empty; other columns are ignored. A special token's own string in a text is that token, as it is in the library.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = rows.select("__key", F.lit(None).cast("array<int>").alias("__ids"), F.lit(None).cast("string").alias("__decoded")).schema
    return rows.mapInArrow(lean(_code(_spec(docs, path), "__text", "__ids")), schema).select(F.col("__key").alias(key), F.col("__ids").alias("ids"), F.col("__decoded").alias("decoded"))


def decoded(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``decoded``, the text of any lists of ids; a null list gives an empty text, ids that no token has are left out."""
    own = rows.select(F.col(key).alias("__key"), F.filter(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")), lambda i: i.isNotNull()).alias("__ids"))
    schema = own.select("*", F.lit(None).cast("string").alias("__decoded")).schema
    return own.mapInArrow(lean(_decode(_spec(rows, path), "__ids", "__decoded")), schema).select(F.col("__key").alias(key), F.col("__ids").alias("ids"), F.col("__decoded").alias("decoded"))


def op12_word_trie_bpe(spark, sf_dir):
    rows = encoded(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
