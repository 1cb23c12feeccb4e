"""Operators without SQL against brute force, and the odd cases of each."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import decontamination, jaccard_join, language_id, mixing, quality_classifier, quality_rules, secret_scan, substring_dedup, token_output, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


# 1: quality rules


def test_ablations_are_counts_over_the_ledger(spark, odd):
    rows = quality_rules.ledger(odd)
    bits = [r["fail_bits"] for r in rows.collect()]
    names = [r.name for r in quality_rules.RULES]
    wanted = quality_rules.mask(quality_rules.POLICIES["v2"])
    for r in quality_rules.ablations(rows, "v2").collect():
        bit = 1 << names.index(r["rule"])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_only"] == sum((b & wanted) == bit for b in bits)
        assert r["n_kept_without"] == sum((b & wanted & ~bit) == 0 for b in bits)


def test_rules_on_nothing(none):
    assert quality_rules.ledger(none).count() == 0 and quality_rules.ablations(quality_rules.ledger(none), "v1").count() == 0


# 2: URL filters


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net", "https://b.net/zz", "ftp://example.com/de/1", "http://x.example.com/de", "http://foo.org/fr/", None, "no scheme", "http://notexample.com/de/", "http:///x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, none, url_filters.QUERY_RULES).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "", None, "allow"), 2: ("b.net", "/zz", "net/", "block"), 3: ("example.com", "/de/1", "example.com/de/", "block"),
        4: ("x.example.com", "/de", None, "allow"), 5: ("foo.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.com", "/de/", None, "allow"), 9: ("", "/x", None, "allow"),
    }


def test_posterior_leans_on_the_domain(spark):
    rows = [("bad.spam.org", 0)] * 60 + [("new.spam.org", 0)] + [("fine.good.org", 1)] * 60 + [("new.good.org", 0)] + [("ok.com", 1)] * 30 + [(None, 1), ("ok.com", None)]
    got = {r["host"]: r for r in url_filters.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["bad.spam.org"]["high"] < 0.5 < got["fine.good.org"]["low"]
    assert got["new.spam.org"]["mean"] < got["new.good.org"]["mean"] and got["ok.com"]["n"] == 30


def test_hosts_without_a_label_take_the_prior_above(spark):
    rows = [(f"h{k % 6}.spam.org", 0) for k in range(90)] + [(f"h{k % 6}.good.org", 1) for k in range(90)] + [(f"h{k % 6}.ill.bad", 0) for k in range(90)]
    urls = [f"http://{h}/x" for h in ("new.spam.org", "new.good.org", "new.new.bad", "new.new.new", "h0.good.org")] + ["/x", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, spark.createDataFrame(rows, "host string, good int")).collect()}
    assert [got[k]["verdict"] for k in range(7)] == ["block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[0]["high"] < 0.5 < got[1]["low"] and got[2]["high"] < 0.5 and 0 < got[3]["mean"] < 1 and got[5]["mean"] is None
    labelled = {r["host"]: r for r in url_filters.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got[4]["mean"] == labelled["h0.good.org"]["mean"]


def test_sparse_and_dense_hosts_get_both_verdicts(spark):
    """Known answers by the posterior, at the default wanted share, against a plain computation of it."""
    rows = [("dense.bad.com", 0)] * 80 + [("dense.fine.com", 1)] * 80 + [("thin.fine.com", 0)] + [(f"h{k % 5}.poor.co.uk", int(k % 9 == 0)) for k in range(90)] + [(f"h{k % 5}.good.co.uk", 1) for k in range(90)]
    urls = {k: f"https://{h}/a" for k, h in enumerate(["dense.bad.com", "dense.fine.com", "thin.fine.com", "h1.poor.co.uk", "new.poor.co.uk", "h1.good.co.uk", "new.good.co.uk", "unseen.co.uk"])}
    pages = spark.createDataFrame([*urls.items(), (0, urls[0])], "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("good", F.lit(7))
    outcomes = spark.createDataFrame(rows, "host string, good int")
    got = url_filters.filter_urls(pages, outcomes).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"} and len(got) == 9

    def strength(units):
        n, good, k = sum(u[0] for u in units), sum(u[1] for u in units), len(units)
        m = good / n
        v = (sum(g * g / u for u, g in units) - n * m * m - (k - 1) * m * (1 - m)) / n
        return n, good, min(max(m * (1 - m) / v - 1, 1), 1000) if k > 1 and v > 0 else 1000

    counts = Counter(h for h, _ in rows)
    good = Counter(h for h, g in rows if g)
    suffix = lambda h: "co.uk" if h.endswith(".co.uk") else "com"
    domain = lambda h: h.split(".", 1)[1]
    domains = {d: strength([(counts[h], good[h]) for h in counts if domain(h) == d]) for d in map(domain, counts)}
    suffixes = {x: strength([v[:2] for d, v in domains.items() if suffix("a." + d) == x]) for x in map(suffix, counts)}
    n, g, s_all = strength([v[:2] for v in suffixes.values()])
    m_all = (g + 1) / (n + 2)
    for r in url_filters.host_reputation(outcomes).collect():
        x, d = suffixes[suffix(r["host"])], domains[domain(r["host"])]
        m = (d[1] + (x[1] + m_all * s_all) / (x[0] + s_all) * x[2]) / (d[0] + x[2])
        assert r["mean"] == pytest.approx((good[r["host"]] + m * d[2]) / (counts[r["host"]] + d[2])) and r["overall"] == pytest.approx(m_all)
    none = pages.limit(0)
    assert url_filters.filter_urls(none, outcomes).count() == 0
    assert {r["verdict"] for r in url_filters.filter_urls(pages, outcomes.limit(0)).collect()} == {"allow"}


def test_many_rules(spark):
    rules = [(f"site{k}.org/a/{k}", ("block", "allow")[k % 2]) for k in range(1200)]
    pages = spark.createDataFrame([(k, f"http://x.site{k}.org/a/{k}{'x' * (k % 3)}") for k in (0, 1, 599, 1198, 1199)], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, spark.createDataFrame([], "host string, good int"), rules).collect()}
    assert got == {0: "block", 1: "allow", 599: "allow", 1198: "block", 1199: "allow"}


# 3: language identification


def test_languages_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs)
    rows = language_id.identify(docs.withColumn("held", language_id.held_out("doc_id")), model, ["doc_id", "lang", "held"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held"]]
    assert {r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows} == {True}
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, odd, none):
    model = language_id.learn(odd)
    got = language_id.identify(odd, model, ["doc_id", "text", "part", "__text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    with pytest.raises(ValueError):
        language_id.identify(odd, model, ["score"])
    empty = language_id.learn(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, empty, ["doc_id"]).collect()} == {"und"}
    assert language_id.accepted(odd, model, 0.0).columns == odd.columns


def test_kernel_is_the_presence_kernel():
    """The folded weights score as the kernel with the landmarks does."""
    texts = ["abc abd", "abc xyz", "xyz xyw", "äöü äöx"]
    column = np.full(1 << language_id.BITS, -1, np.int32)
    grams = np.unique(np.concatenate([g for _, _, g, _ in language_id.gram_batches(texts)]))
    column[grams] = np.arange(len(grams))
    (_, present, letters), = language_id.Features(column, len(grams)).presence(texts)

    def own(t):
        found = set()
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            w += " "
            found |= {w[i : i + n] for n in range(1, language_id.MAX_N + 1) for i in range(len(w) - n + 1)} - {" "}
        # An n-gram may run over a word's end into the next word.
        joined = " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
        return {joined[i : i + n] for n in range(1, language_id.MAX_N + 1) for i in range(len(joined) - n + 1) if joined[i] != " "}

    want = np.array([[len(own(a) & own(b)) for b in texts] for a in texts])
    assert (present @ present.T == want).all() and letters.all()


# 4: mixing


def test_mix_meets_targets(spark, odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] >= 0
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while True:  # water filling, one round for each source that is full
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > 3 * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    again = {(r["doc_id"], r["row_key"], r["taken"]) for r in mixing.mix_sources(odd.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["row_key"], r["taken"]) for r in got}


def test_applied_mix_has_the_words_taken(spark, once, none):
    docs = once
    mixed = mixing.mix_sources(docs)
    want = {r["doc_id"]: r["taken"] for r in mixed.where("taken > 0").collect()}
    got = Counter()
    applied = mixing.mix_documents(docs)
    assert applied.columns == docs.columns
    for r in applied.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert dict(got) == want
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_equal_rows_are_taken_alike(spark):
    """Two sources, all rows of one equal: as many words come out as the mix takes."""
    rows = [(1, "a b c d e f g h i j", "x")] * 7 + [(k, f"w{k} " * 20, "y") for k in range(20)] + [(99, None, "y"), (98, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    for weights in ((5, 2, 1), (1, 5, 1), (3, 4, 2)):
        taken, got = Counter(), Counter()
        target = {}
        for r in mixing.mix_sources(docs, weights).collect():
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        for r in mixing.mix_documents(docs, weights).collect():
            got[r["source"]] += len(words(r["text"]))
        assert dict(got) == {k: v for k, v in taken.items() if v}
        assert all(0 <= int(target[k] + 1e-9) - taken[k] < (7 if k == "x" else 1) for k in target), weights


# 5: quality classifier


def test_held_out_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(docs, labels).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    held = [(r["quality"], scores[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_without_labels_and_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.score_documents(odd, labels).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.5}
    assert quality_classifier.score_documents(none, labels).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (3, 0, None), (3, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.score_documents(odd, some).where("score between 0 and 1").count() == odd.count()


def test_isotonic_is_monotone_and_pools():
    x, v = quality_classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 3, 1, 4]), np.array([4, 4, 4, 4]))
    assert (np.diff(v) >= 0).all() and len(x) == 3


# 6: n-gram Jaccard join


def brute_links(rows, n, num, den):
    sets = []
    for doc, text in rows:
        w = words((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets.append((doc, grams))
    near = lambda a, b: a and b and den * len(a & b) >= num * len(a | b)
    return sets, {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if near(sets[i][1], sets[j][1])}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_components_against_brute_force(spark, n, num):
    r = random.Random(n * num)
    rows = []
    for k in range(30):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(r.randint(1, 150))]
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(["zq", "Xq"])
            rows.append((len(rows), " ".join(w)))
    boiler = " ".join(f"boiler{i}" for i in range(12))
    rows += [(len(rows) + i, f"{boiler} " + " ".join(f"w{i}x{j}" for j in range(r.randint(5, 60)))) for i in range(25)]
    rows += [(1000, None), (1001, ""), (1002, "  ")]
    sets, pairs = brute_links(rows, n, num, 100)
    root = {d: d for d, _ in rows}
    find = lambda d: d if root[d] == d else find(root[d])
    links = Counter()
    for i, j in pairs:
        a, b = find(sets[i][0]), find(sets[j][0])
        root[max(a, b)] = min(a, b)
        links[sets[i][0]] += 1
        links[sets[j][0]] += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in jaccard_join.jaccard_components(df, n, num, 100, count=True).collect()}
    assert got == {d: (len(s), find(d), links[d]) for d, s in sets}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(df, n, num, 100).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets}


def test_large_cluster_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(80):
        w = [x if r.random() > 0.01 else f"v{k}" for x in base] + [f"e{j}" for j in range(k % 9)]
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    sets, pairs = brute_links(rows, 3, 80, 100)
    links = Counter(x for p in pairs for x in p)
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 80, 100, count=True).collect()}
    assert got == {k: links[k] for k in range(80)}
    label = list(range(80))
    for i, j in pairs:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 80, 100).collect()}
    assert got == dict(enumerate(label))
    firsts = {d for d, s in sets if not any(t == s for e, t in sets if e < d)}  # copies of one set aren't expanded
    got = {(x["doc_id"], x["other"]) for x in jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 80, 100).collect()}
    assert got == {p for p in pairs if set(p) <= firsts}


def test_a_large_group_that_shares_passages_falls_apart(spark, monkeypatch):
    """Texts of a large group that only share a passage leave it; sent once for each block, they grow with the square of the group."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3_000)
    r = random.Random(21)
    text = lambda k, n: " ".join(f"w{k}x{r.randrange(10**6)}" for _ in range(n))
    shared = text("s", 120)
    rows = [(k, f"{text(k, 60)} {shared} {text(k, 60)}") for k in range(120)]
    rows += [(200 + k, f"{t} tail") for k, t in rows[:10]]
    rows += [(300, rows[0][1]), (301, f"{shared} {text('a', 3)}"), (302, f"{shared} {text('b', 3)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    _, classes = jaccard_join._classes(docs, 3)
    sent = jaccard_join._grouped(docs, classes.localCheckpoint(), 3, 80, 100).localCheckpoint()
    times = Counter(x["doc_id"] for x in sent.select("doc_id").collect())
    assert set(times) == {*range(10), *range(200, 210), 301, 302}
    assert max(times.values()) <= 6
    _, pairs = brute_links(rows, 3, 80, 100)
    found = sent.groupBy(*jaccard_join.GROUP).applyInArrow(jaccard_join._join_group(3, 80, 100, "pairs"), jaccard_join.LINKS).collect()
    assert {tuple(sorted((x["doc_id"], x["other"]))) for x in found} == {(rows[i][0], rows[j][0]) for i, j in pairs if 300 not in (rows[i][0], rows[j][0])}


def test_one_of_each_group_stays(spark, odd, none):
    got = jaccard_join.keep_one(odd)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and None in ids and {0, 2, 3, 46, 49} <= set(ids)
    assert not {40, 41, 42} & set(ids)
    assert jaccard_join.keep_one(none).count() == 0


# 7: token output


def test_tokens_round_trip(spark, odd, once, none):
    from tokenizers import Tokenizer

    path = token_output.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    docs = once
    got = token_output.encoded(docs, path).orderBy("doc_id").collect()
    start = 0
    for r, want in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*tokenizer.encode(want["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_output.encoded(odd, path).count() == odd.count()
    assert token_output.encoded(none, path).count() == 0


def test_pieces_equal_the_whole_text():
    from tokenizers import Tokenizer

    spec = open(token_output.tokenizer_path(), encoding="utf-8").read()
    encoder, tokenizer = token_output.WordEncoder(spec, 2), Tokenizer.from_str(spec)
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\x1c", " ", "　", "a", "bc", "'s", "é", "1", "23", ".", "!?", "日本", "<|endoftext|>", "word", "Ünder"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    texts += ["".join(r.choice(["\n", "\n", " ", "\n\n", "a", "bé", ".", "9"]) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    ids, first = encoder.encode(texts, 0)
    for k, (text, want) in enumerate(zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))):
        assert ids[first[k] : first[k + 1]].tolist() == [*want.ids, 0], repr(text)
    assert encoder.encode([], 0)[0].tolist() == []


@pytest.mark.parametrize("n", [1, 5, 64, 1000, 4097])
def test_blocks_decode_from_every_checkpoint(n):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % 300).astype(np.uint16)
    model = token_output.Model(token_output.quantize(np.bincount(ids, minlength=300), 12))
    words_, states, points = token_output.encode_block(ids, model, lanes=16, every=4)
    for k, (state, at) in enumerate(zip(states, points)):
        lo = k * 64
        assert (token_output.decode_steps(words_, state, int(at), min(64, n - lo), model) == ids[lo : lo + 64]).all()


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    token_output.write_tokens(docs, token_output.tokenizer_path(), str(tmp_path))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    blocks.withColumn("crc", F.col("crc") + 1).write.parquet(str(tmp_path / "bad/blocks"))
    spark.read.parquet(str(tmp_path / "frequencies")).write.parquet(str(tmp_path / "bad/frequencies"))
    assert token_output.read_tokens(spark, str(tmp_path), True).first()["ids"] == [11246, 2420, 0]
    with pytest.raises(Exception, match="damaged"):
        token_output.read_tokens(spark, str(tmp_path / "bad")).collect()


# 8: substring dedup


def test_spans_name_their_source(spark):
    r = random.Random(5)
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = w(80)
    a, b = w(30) + shared + w(30), w(10) + shared + w(5)
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, None)], "doc_id bigint, text string")
    got = [tuple(x) for x in substring_dedup.repeated_spans(df).select("doc_id", "start", "n_words", "source_doc", "source_start").collect()]
    assert got == [(2, 10, 80, 1, 30)]
    kept = {x["doc_id"]: x["kept_text"] for x in substring_dedup.remove_repeats(df, with_text=True).collect()}
    assert kept == {1: " ".join(a), 2: " ".join(b[:10] + b[90:]), 3: ""}


def test_runs_are_known_by_their_words(monkeypatch):
    """Where all hashes collide, digests of the words still tell runs and windows apart."""
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup.Words, "hashes", lambda self, lane=0, lower=False: np.full(len(self), 7, np.uint64))
    r = random.Random(6)
    one, two = (" ".join(f"w{r.randrange(10**6)}" for _ in range(70)) for _ in range(2))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "row_key": [1, 2, 3], "text": [one, two, one.replace(" ", "\n\t")]})
    runs = pa.Table.from_batches(substring_dedup._runs(50)([batch])).to_pylist()
    own = {d: [(x["run1"].to_bytes(8, "little", signed=True) + x["run2"].to_bytes(8, "little", signed=True), x["s"], x["e"]) for x in runs if x["doc_id"] == d] for d in (1, 2, 3)}
    assert own[1] == own[3] and not {x[0] for x in own[1]} & {x[0] for x in own[2]}
    w = words(one)
    assert all(x[0] == hashlib.blake2b((" ".join(w[x[1] : x[2] + 50]) + " ").encode(), digest_size=16).digest() for x in own[1])


def thue_morse(n, a, b):
    return [(a, b)[k.bit_count() % 2] for k in range(n)]


def test_words_and_runs_of_one_structure_differ(spark):
    """Words, and texts, that powers of any odd base modulo 2^64 can't tell apart."""
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    r = random.Random(7)
    shared = [f"w{r.randrange(10**6)}" for _ in range(49)]
    rows = [(1, " ".join([*shared, one])), (2, " ".join([*shared, two])), (3, " ".join(thue_morse(2048, "a", "b"))), (4, " ".join(thue_morse(2048, "b", "a"))), (5, one), (6, two)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets, pairs = brute_links(rows, 3, 90, 100)
    got = {(x["doc_id"], x["other"]) for x in jaccard_join.jaccard_links(df).collect()}
    assert got == {(sets[i][0], sets[j][0]) for i, j in pairs if sets[i][1] != sets[j][1]} and (5, 6) not in got
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.remove_repeats(df).collect()}
    own = {d: words(t) for d, t in rows}
    windows = lambda w: {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
    for d, w in own.items():
        before = set().union(*(windows(v) for e, v in own.items() if e < d))
        gone = {k for i in range(len(w) - 49) if tuple(w[i : i + 50]) in before for k in range(i, i + 50)}
        assert got[d] == len(gone), d
    bench = spark.createDataFrame([(9, " ".join(["item", "of", two, "and", "more", "words"]))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"item of {one} and more words"), (2, f"item of {two} and more words")], "doc_id bigint, text string")
    assert [x["doc_id"] for x in decontamination.leaks(docs, bench).collect()] == [2]


def test_hub_edges_stay_apart(spark, monkeypatch):
    from caseloom.llm import graph

    monkeypatch.setattr(graph, "LEAST_HUB", 5)
    r = random.Random(4)
    pairs = [(0, k) for k in range(1, 60)] + [(r.randrange(60, 200), r.randrange(60, 200)) for _ in range(90)] + [(k, 500) for k in range(300, 340)] + [(k, k + 1) for k in range(400, 440)]
    label = {k: k for p in pairs for k in p}
    for a, b in pairs * 2:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_a_round_of_components_plans_one_join_at_a_time(spark, monkeypatch):
    from caseloom.llm import graph

    joins, held, write = [], [], graph.materialize

    def noted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        held.append(write(df, name))
        return held[-1]

    monkeypatch.setattr(graph, "materialize", noted)
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 101)]
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert len(joins) > 8 and max(joins) == 1


def test_names_that_the_operators_use(spark, odd):
    clash = odd.select("doc_id", "text", "lang", "source", *[F.lit("x").alias(c) for c in ("__id", "__gone", "__place", "doc", "_doc", "goes", "place", "key", "row", "words", "gone")])
    assert jaccard_join.keep_one(clash).columns == clash.columns
    benchmark = spark.createDataFrame([(1, "nothing that occurs there at all")], "item_id bigint, text string")
    assert decontamination.decontaminate(clash, benchmark).count() == clash.count()
    applied = mixing.mix_documents(clash)
    assert applied.columns == clash.columns and applied.count() > 0


def test_dedup_of_odd_rows(spark, odd, none):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["n_removed"] <= r["n_words"] for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


# 9: decontamination


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 3, 5, 8, 15, 30, 30, 57])]
    items += [(20, ""), (21, None), (22, "...")]
    docs = []
    for k in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if k % 2:
            own = words(items[r.randrange(8)][1])
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] += r.choice([",", "!", "x"])
            w = [*w, *own, *w[:5]]
        docs.append((k, " ".join(w).title() if k % 3 else " ".join(w)))
    docs += [(100, None), (101, "")]
    bare = str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)
    split = lambda t: words((t or "").translate(bare))
    grams = lambda w, g: Counter(tuple(w[i : i + g]) for i in range(len(w) - g + 1))
    want = {}
    for d, t in docs:
        w = split(t)
        for k, text in items:
            own = split(text)
            g = min(5, len(own))
            for s in range(len(w) - len(own) + 1) if own else ():
                a, b = grams(w[s : s + len(own)], g), grams(own, g)
                x = sum((a & b).values()) / sum((a | b).values())
                if x >= 0.8:
                    want[d, k] = max(x, want.get((d, k), 0))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontamination.leaks(df, bench).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    clean = decontamination.decontaminate(df, bench)
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_ITEMS", 2)
    items = [(k, " ".join(f"t{k}x{i}" for i in range(12))) for k in range(5)]
    docs = spark.createDataFrame([(k, f"start {t} end") for k, t in items], "doc_id bigint, text string")
    got = decontamination.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(k, k) for k in range(5)]
    assert decontamination.leaks(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_every_near_fingerprint_is_found():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 63, 50, dtype=np.uint64)
    queries = prints.copy()
    for k in range(50):
        for b in r.choice(64, r.integers(0, 20), replace=False):
            queries[k] ^= np.uint64(1 << int(b))
    q, i = decontamination.MultiIndex(prints).near(queries)
    want = {(a, b) for a in range(50) for b in range(50) if int(queries[a] ^ prints[b]).bit_count() <= decontamination.RADIUS}
    assert set(zip(q.tolist(), i.tolist())) == want


# 10: secret scan


def test_base_spans_against_the_patterns():
    plain = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    r = random.Random(6)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "=", ": ", '"', "'", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJ1234", "deadbeef", " ", "\n", "é", "x=", "Secret = "]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        want = [(m.start(), m.end(), 0) for m in plain.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert secret_scan.base_spans(t) == sorted(want, key=lambda s: (s[0], s[2])), repr(t)


def test_network_on_findings_it_did_not_see(spark, odd, none):
    network = secret_scan.train(odd)
    fresh = secret_scan.written_findings(1000, 77)
    y = np.array([f[3] for f in fresh])
    hit = network.probability(secret_scan.encode([f[:3] for f in fresh])) >= network.threshold
    assert hit[y == 1].mean() > 0.93 and hit[y == 0].mean() < 0.07
    rows = secret_scan.find_secrets(odd, network).collect()
    assert len(rows) == odd.count()
    assert secret_scan.find_secrets(none, network).count() == 0
    text = "the token = abcdefghij0123456789 and key Zx81kQpL0vNn47TtRe93WmAa then é"
    got = secret_scan.find_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), network).first()
    assert got["n_assign"] == 1 and got["spans"].startswith("assign:4:32") and got["base_sha256"] == hashlib.sha256(b"assign:4:32").hexdigest()


def test_a_hidden_kind_is_found_and_addresses_are_left(spark, sf_dir):
    """The network trained without one pattern's findings still scores those as keys, and leaves plain shapes."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    r = random.Random(12)
    upper, lower = string.ascii_uppercase + string.digits, string.digits + "abcdef"
    fresh = {"access": [f"then we saw AKIA{''.join(r.choice(upper) for _ in range(r.randint(14, 20)))} in the file" for _ in range(300)], "hex": [f"then we saw {''.join(r.choice(lower) for _ in range(r.randint(24, 48)))}a0 in the file" for _ in range(300)]}
    for kind, least in (("access", 0.9), ("hex", 0.9)):
        network = secret_scan.train(docs, hidden=kind)
        found, plain = [], []
        texts = [x["text"] or "" for x in docs.select("text").collect()] + fresh[kind]
        for text, scan in zip(texts, secret_scan.scan_texts(texts, network)):
            for s, e, p in scan.scores:
                if any(secret_scan.KINDS[k] == kind and a < e and b > s for a, b, k in scan.base) and not text[s:e].isdigit():
                    found.append(p >= network.threshold)
                elif secret_scan.PLAIN.fullmatch(text, s, e):
                    plain.append(p >= network.threshold)
        print(kind, np.mean(found), np.mean(plain), network.threshold, network.recall, network.precision)
        assert len(found) >= 290 and np.mean(found) >= least
        assert len(plain) > 10 and np.mean(plain) <= 0.05


def test_scans_of_long_and_repeated_rows(spark, odd):
    network = secret_scan.train(odd)
    long = "word " * 400_000 + 'api_key = "abcdef0123456789abcd" ' + "x/" * 50_000 + "9"
    rows = [(1, long), (1, long), (2, ""), (3, None)]
    got = secret_scan.find_secrets(spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, spans string"), network).collect()
    one = [tuple(r) for r in got if r["doc_id"] == 1]
    assert len(got) == 4 and one[0] == one[1] and one[0][1] == 1 and one[0][3] == 1 and {r["spans"] for r in got if r["doc_id"] > 1} == {""}


def test_every_place_of_a_candidate_is_read():
    for n in (16, 40, 41, 60, 61, 333):
        got = secret_scan.windows("/" * 5 + "a" * n + " ", 5, 5 + n)
        assert {k for s, e in got for k in range(s, e)} == set(range(5, 5 + n)) and all(e - s <= secret_scan.INSIDE for s, e in got)
    text = "see " + "path/to/" * 9 + "Zx81kQpL0vNn47TtRe93WmAa" + "/and/on" * 9 + " end"
    other = text.replace("Zx81kQpL0vNn47TtRe93WmAa", "some-plain-words-of-2021")
    (span,) = secret_scan.candidates(text)
    assert (secret_scan.encode([(text, *span)]).x != 0).any()
    assert not np.array_equal(secret_scan.encode([(text, *span)]).x, secret_scan.encode([(other, *span)]).x)
    after = secret_scan.encode([("a Zx81kQpL0vNn47TtRe93WmAa one", 2, 26)]).x
    assert not np.array_equal(after, secret_scan.encode([("a Zx81kQpL0vNn47TtRe93WmAa two", 2, 26)]).x)


def test_keys_inside_long_runs(odd):
    network = secret_scan.train(odd)
    fresh = secret_scan.embedded_findings(600, 78)
    y = np.array([f[3] for f in fresh])
    hit = network.probability(secret_scan.encode([f[:3] for f in fresh])) >= network.threshold
    assert hit[y == 1].mean() > 0.93 and hit[y == 0].mean() < 0.3


def test_recall_holds_and_unlabelled_keys_are_no_negatives(spark):
    network = secret_scan.Network()
    found = secret_scan.written_findings(400, 3)
    y = np.array([f[3] for f in found])
    network.calibrate(secret_scan.encode([f[:3] for f in found]), y)  # not fitted: recall costs precision
    assert network.recall >= secret_scan.RECALL and 0 < network.precision < 1
    r = random.Random(5)
    key = lambda: "".join(r.choice("ABCDEFGHJKLMnopqrstuvwxyz0123456789") for _ in range(31)) + "7"
    docs = spark.createDataFrame([(k, f"the blob {key()} stands here") for k in range(1500)], "doc_id bigint, text string")
    trained = secret_scan.train(docs)
    rows = secret_scan.find_secrets(docs, trained).collect()
    assert sum("network" in x["spans"] for x in rows) > 0.93 * len(rows)
