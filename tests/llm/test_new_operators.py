"""Phrases, vector codes and word-trie BPE against brute force and the library they follow."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseloom.llm import phrases, vector_codes, word_trie


@pytest.mark.parametrize(("width", "scale"), [(1, 5), (3, 4), (4, 300), (7, 10**5), (16, 1000)])
def test_bounds_lose_no_entry(width, scale):
    r = np.random.default_rng(width)
    entries, parts = r.integers(-scale, scale, (64, width)), r.integers(-scale, scale, (2000, width))
    parts[:300] = entries[r.integers(0, 64, 300)]
    entries[5] = entries[9]
    code, far, taken = vector_codes.Codebook(entries).nearest(parts)
    every = ((parts[:, None] - entries) ** 2).sum(-1)
    assert (code == every.argmin(1)).all() and (far == every.min(1)).all()
    assert taken < every.size + len(parts)
    if (width, scale) == (16, 1000):
        near = entries[r.integers(0, 64, 2000)] + r.integers(-40, 40, (2000, width))
        assert vector_codes.Codebook(entries).nearest(near)[2] < 0.2 * every.size  # clustered parts: the bounds leave few


def _brute(vectors, rounds=2, entries=64):
    """Codes, errors and codebooks of whole-number vectors in key order."""
    x = np.floor(np.array(vectors, float) * 256).astype(object).reshape(len(vectors), 16, -1)
    books = [[list(v) for v in x[:entries, p]] for p in range(16)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(16):
            own = {}
            for v in x[:, p]:
                own.setdefault(nearest(p, v)[1], []).append(v)
            for k, vs in own.items():
                books[p][k] = [int(sum(c)) // len(vs) for c in zip(*vs)]
    found = [[nearest(p, v[p]) for p in range(16)] for v in x]
    text = ",".join(str(int(c)) for p in books for e in p for c in e)
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(int(d) for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    r = random.Random(4)
    vectors = [[r.choice([-1, 1]) * r.random() for _ in range(48)] for _ in range(150)]
    rows = [(k, v, 0.5, "c") for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, error double, row string").repartition(5)
    books = vector_codes.learn(df)
    got = {x["vec_id"]: x for x in vector_codes.compress(df, books).collect()}
    codes, errors, digest = _brute(vectors)
    assert [got[k]["code"] for k in range(150)] == codes and [got[k]["error"] for k in range(150)] == errors
    assert vector_codes.digest(books) == digest and got[3]["row"] == "c"


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    one = [0.25] * 16
    rows = [(1, one, 1), (1, one, 1), (None, [0.5] * 16, None), (4, None, 2), (5, [*one[:15], None], 2), (6, [*one[:15], nan], 2), (7, [*one[:15], inf], 2), (8, one[:15], 2), (9, [], None), (10, [1e30] * 16, 2), (11, one * 2, 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = sorted(map(tuple, vector_codes.op13_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error").collect()), key=str)
    # Entries: 0.25, its repetition, 0.5. Vectors that can't be compared keep null codes.
    assert out == sorted([(1, "00" * 16, 0, 0)] * 2 + [(None, "02" * 16, 0, 0), (8, None, None, None), (9, None, None, 0), (10, None, None, None), (11, None, None, None)], key=str)
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert vector_codes.op13_vector_codes(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, [nan], 1), (2, [1.0, 2.0], 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "odd" / "embeddings.parquet"))
    assert vector_codes.op13_vector_codes(spark, str(tmp_path / "odd")).select("vec_id", "code", "label_error").collect() == [(2, None, None)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_trie.tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    with open(word_trie.tokenizer_path(), encoding="utf-8") as f:
        return word_trie.ChunkEncoder(f.read())


def _same(library, encoder, texts):
    import pyarrow as pa

    ids = encoder.encode(pa.array(texts, pa.large_string()))
    for text, got, back in zip(texts, ids.to_pylist(), encoder.decode(ids).to_pylist()):
        want = library.encode(text, add_special_tokens=False).ids
        assert got == want, text[:100]
        assert back == library.decode(want, skip_special_tokens=False)


def test_encodings_equal_the_library(library, encoder):
    r = random.Random(2)
    marks = ["a", "b", "s", "t", "'", "'s", "'LL", " ", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "É", "é", "Σ", "ΑΣ", "İ", "ß", "1", "²", "中", "😀", "\u0300", "\0", "<|endoftext|>", "<|", "</w>", "!", "...", "\ufffd", "가", "ﬁ", "Ａ", "º", "×", "ŉ", "Ǆ"]
    _same(library, encoder, ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(5000)])
    pieces = [t.replace("</w>", "") for t in encoder.trie.ids]
    _same(library, encoder, ["".join(r.choice(pieces) for _ in range(r.randint(1, 5))) for _ in range(10000)])
    _same(library, encoder, ["".join(r.choice("aehlnost") for _ in range(r.randint(1, 25))) for _ in range(5000)])
    _same(library, encoder, ["a" * k for k in range(200)] + ["ha" * 500 + "é" * 40, "", "x" * 100_000, "word " * 50_000])


def test_trie_equals_merging_step_by_step():
    """A vocabulary with merges that overlap, against the plain algorithm."""
    letters, r = "abc", random.Random(7)
    for _ in range(40):
        ids = {c + e: k for k, (c, e) in enumerate((c, e) for c in letters for e in ("", "$"))}
        merges, tokens = [], list(ids)
        while len(merges) < 25:
            a, b = r.choice(tokens), r.choice(tokens)
            if a.endswith("$") or a + b in ids:
                continue
            ids[a + b] = len(ids)
            merges.append((a, b))
            tokens.append(a + b)
        trie, rank = word_trie.WordTrie(ids, merges, "$"), {m: k for k, m in enumerate(merges)}
        words = {"".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(300)}
        got = trie.encode(words)
        for word in words:
            parts = [*word[:-1], word[-1] + "$"]
            while True:
                best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            assert np.frombuffer(got[word], np.int32).tolist() == [ids[p] for p in parts], (word, merges)


def test_rows_of_op12(spark, odd, none, library, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, word_trie.op12_word_trie_bpe(spark, str(tmp_path)).collect()), key=str)

    def digest(row):
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return row["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    assert got == sorted(map(digest, odd.collect()), key=str)
    assert word_trie.encoded(none, word_trie.tokenizer_path()).count() == 0
    lists = spark.createDataFrame([(1, [320, None, 99_999_999, -1]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert [r["decoded"] for r in word_trie.decoded(lists, word_trie.tokenizer_path()).orderBy("doc_id").collect()] == ["a</w>", "", ""]


def _phrases(rows, least, first=2000):
    """The rows of collocations by plain counting. ``rows``: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans(phrases._UPPER, phrases._UPPER.lower())
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            for m in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        cand = {w: a for w, a in own.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in cand.items():
            if any(len(c) > len(w) and 100 * b >= 80 * a and any(c[k : k + len(w)] == w for k in range(len(c))) for c, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (own[w[:k]] + own[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), own[w[:k]], own[w[k:]]))
        out += [(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def _words(r, n):
    """Text of few words, some of them not ASCII, with marks, line ends and other white space."""
    return "".join(r.choice(["a", "B", "b", "cc", "é", "É", "\x01", "\u00a0x"]) + r.choice([" "] * 8 + ["\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("crowded", [20_000, 3, 0])
def test_phrases_equal_plain_counts(spark, monkeypatch, crowded):
    monkeypatch.setattr(phrases, "CROWDED", crowded)  # 3, 0: prefixes are dealt by two and three words
    r = random.Random(8)
    rows = [(_words(r, r.randint(0, 60)), r.choice(["en", "fr", None, "und", "a\tb", ""])) for _ in range(120)] + [(None, "en"), ("", None), ("a b a b a b", "en"), ("a b a b a b", "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least, first in ((3, 2000), (12, 4)):
        got = sorted(map(tuple, phrases.collocations(df, least=least, first=first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
        assert got == _phrases(rows, least, first)


def test_long_texts_are_cut_without_loss():
    import pyarrow as pa

    r = random.Random(3)
    texts = [_words(r, 4000), "x" * 5000 + " " + _words(r, 50), "", None, _words(r, 10)]
    langs = np.zeros(len(texts), np.int64)

    def windows(size):
        phrases.SLICE, kept = size, phrases.SLICE
        try:
            found = Counter()
            for c in phrases.chunks(pa.array(texts), langs):
                names = c.names.to_pylist()
                for k in np.flatnonzero(c.own):
                    own = [names[c.code[k]]]
                    while len(own) < 4 and c.next[k + len(own) - 1]:
                        own.append(names[c.code[k + len(own)]])
                    found[tuple(own)] += 1
            return found
        finally:
            phrases.SLICE = kept

    whole = windows(1 << 20)
    assert whole == windows(100) == windows(1)


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(phrases, "bitmap", lambda keys, count: np.full(4096, 255, np.uint8))  # every key may be frequent
    r = random.Random(6)
    rows = [(_words(r, 40), "en") for _ in range(60)]
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == _phrases(rows, 5)


def test_phrases_of_odd_rows(spark, odd, none):
    got = sorted(map(tuple, phrases.collocations(odd, least=2).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == _phrases([(x["text"], x["lang"]) for x in odd.collect()], 2)
    assert phrases.collocations(none).count() == 0
