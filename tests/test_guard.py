"""Leakage: folding, needles, the two ways of looking for them, case by case; and redaction."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import automaton, guard

CAUSE = "The pilot's failure to maintain airspeed, which led to a stall."
TWO = "No anomalies were found with the airframe. The engine was examined thoroughly."


def test_folding_of_forms(spark):
    texts = ["  The   Pilot\n\tSaid ", "the “pilot’s” ‚x‛", "eﬃcient ＦＵＬＬ  width ½ ²", "ÀÉ İ ΑΣ", "a\x1cb\x85c", "", None, "ASCII Only; Yes"]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.fold_forms(F.col("t"))).orderBy("k").collect()]
    assert got == [None if t is None else T.folded_text(t) for t in texts]
    assert got[0] == "the pilot said" and got[1] == "the \"pilot's\" 'x'" and got[2] == "efficient full width 1⁄2 2"


# (role, evidence, source, withheld, codes, what is found)
CASES = [
    ("weather_metar", "KABC 011200Z", "probable_cause", CAUSE, [], []),
    ("prelim_narrative", f"Summary: {CAUSE.upper()} End", "probable_cause", CAUSE, [], ["text"]),
    ("prelim_narrative", "no anomalies were found with the airframe.", "analysis_narrative", TWO, [], ["sentence"]),
    ("prelim_narrative", "none.", "analysis_narrative", "None. " + TWO, [], []),
    ("prelim_narrative", "occurrence 300230.", "probable_cause", CAUSE, ["300230"], ["code"]),
    ("prelim_narrative", "serial 13002301", "probable_cause", CAUSE, ["300230"], []),
    ("weather_metar", "KICT 250200Z 18005KT", "probable_cause", CAUSE, ["250200"], []),
    ("prelim_narrative", "part A300230B é300230", "probable_cause", CAUSE, ["300230"], []),
    ("prelim_narrative", "anything at all here", "probable_cause", CAUSE, ["", "   "], []),
    ("prelim_narrative", "a.b axb", "probable_cause", CAUSE, ["a.b", "a.c"], ["code"]),
    ("prelim_narrative", "**this report was modified on 4/21/2016.", "factual_narrative", f"{TWO} **This report was modified on April 21, 2016.**", [], []),
    ("prelim_narrative", "the pilot stalled. this report was modified on 4/21/2016.", "factual_narrative", "The pilot stalled. This report was modified on 4/21/2016.", [], ["text"]),
    ("prelim_narrative", f"Summary: {CAUSE[:-1]}", "probable_cause", CAUSE, [], ["text"]),
    ("prelim_narrative", f"Summary: {CAUSE.replace(chr(39), '’')}", "probable_cause", CAUSE, [], ["text"]),
    ("prelim_narrative", "the engine was examined thoroughly", "analysis_narrative", TWO.replace(". ", "."), [], ["sentence"]),
    ("prelim_narrative", "the right wing was undamaged.", "analysis_narrative", "The left wing was bent outward; the right wing was undamaged.", [], ["sentence"]),
    ("prelim_narrative", "it read: the engine was examined thoroughly and then put away", "factual_narrative", "(The engine was examined thoroughly.)", [], ["text"]),
    ("prelim_narrative", "the eﬃcient ｅｎｇｉｎｅ was examined thoroughly", "factual_narrative", "The efficient engine was examined thoroughly,", [], ["text"]),
    ("weather_metar", "no anomalies were found with the airframe", "factual_narrative", TWO, [], []),
    ("docket_documents", "no anomalies were found with the airframe", "factual_narrative", TWO, [], []),
    ("docket_listing", "no anomalies were found with the airframe", "factual_narrative", TWO, [], ["sentence"]),
    ("docket_documents", "no anomalies were found with the airframe", "analysis_narrative", TWO, [], ["sentence"]),
    ("docket_documents", TWO, "factual_narrative", TWO, [], ["text"]),
    ("prelim_narrative", None, "factual_narrative", TWO, ["1"], []),
    ("prelim_narrative", "", "factual_narrative", None, [], []),
]


def test_case_by_case(spark):
    rows = list(enumerate(CASES))
    evidence = spark.createDataFrame([(k, c[0], c[1]) for k, c in rows], "case_id int, role string, text string")
    withheld = spark.createDataFrame([(k, c[2], c[3]) for k, c in rows], "case_id int, source string, text string")
    codes = spark.createDataFrame([(k, x) for k, c in rows for x in c[4]], "case_id int, code string")
    found = guard.screened(guard.case_leaks(evidence, withheld, codes, "case_id")).collect()
    for k, c in rows:
        assert sorted(r.kind for r in found if r.case_id == k) == c[5], c
    assert {(r.role, r.source) for r in found if r.route == "mark"} == {("docket_documents", "analysis_narrative")}


def _plain(docs, withheld, without=None):
    """Found needles by comparing every text with every needle."""
    trim = lambda s: re.sub(r"""^[\s"'(\[{]+|[\s.!?;:,'")\]}]+$""", "", s)
    out = set()
    for key, text in withheld:
        whole = T.folded_text(text or "")
        bare = trim(whole)
        own = {(bare, True)} if len(bare) >= 20 else set()
        own |= {(s, False) for s in map(trim, re.split(r"(?<=[.!?;])\s+|(?<=[.!?])(?=[A-Za-z])", whole)) if len(s) >= 20 and s != bare}
        out |= {(d, key, n, w) for d, t in docs for n, w in own if n in T.folded_text(t or "")}
    return out


@pytest.mark.parametrize("way", ["automaton", "join"])
def test_both_ways_find_all(spark, monkeypatch, way):
    if way == "join":
        monkeypatch.setattr(automaton, "MOST", -1)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abéﬁＡ") for _ in range(r.randint(1, 9)))
    text = lambda n: "".join(word() + r.choice([" "] * 6 + [". ", "; ", ".", "  "]) for _ in range(n))
    withheld = [(k, text(r.randint(1, 14))) for k in range(40)] + [(40, None), (41, ""), (42, "x" * 45 + "."), (43, "y" * 30 + " zz")]
    docs = [(k, text(10) + r.choice(withheld[:40])[1].upper() + text(10)) for k in range(60)] + [(60, None), (61, ""), (62, "a" + "x" * 50), (63, withheld[3][1]), (63, withheld[3][1])]
    docs += [(70 + k, (lambda s: s[5 : len(s) - 3])(withheld[k][1])) for k in range(10)]
    d, w = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(withheld, "k int, text string")
    found = guard.leaks(d, "doc", "text", guard.needles(w, "k", "text", fold=T.fold_forms), "k", T.fold_forms)
    rows = [tuple(x) for x in found.select("doc", "k", "needle", "whole").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _plain(docs, withheld) and rows


def test_automaton_equals_plain_search():
    r = random.Random(2)
    for whole in (False, True):
        for _ in range(100):
            strings = ["".join(r.choice("ab_ .") for _ in range(r.choice([1, 2, 3, 40]))) for _ in range(6)]
            text = "".join(r.choice("ab_ .") for _ in range(60)) + r.choice(strings) + "".join(r.choice("ab ") for _ in range(9))
            want = set()
            for s in strings:
                for k in range(len(text)):
                    if text.startswith(s, k) and not (whole and (text[k - 1 : k].replace("_", "a").isalnum() or text[k + len(s) : k + len(s) + 1].replace("_", "a").isalnum())):
                        want.add((k, s))
            m = automaton.Automaton(strings, whole)
            assert {(k, m.strings[n]) for k, n in m.places(text)} == want


def _replaced(text, values, mark):
    """Value after value, the longest first, by patterns."""
    counts = Counter()
    for v, kind in sorted(set(values), key=lambda x: (-len(x[0]), x[0].lower())):
        text, n = re.subn(rf"(?<!\w){re.escape(v)}(?!\w)", lambda _: mark, text, flags=re.IGNORECASE)
        counts[kind] += n
    return text, {k: n for k, n in counts.items() if n}


def test_redaction(spark):
    values = [("Acme Flying Club", "name"), ("Acme Flying", "name"), ("Long", "make"), ("O'Neil & Sons.", "name"), ("Müller", "name"), ("12345-6789", "zip")]
    texts = ["ACME flying club and Acme Flying; longitudinal Long, LONG_x", "by O'Neil & Sons. of MÜLLER Müllers 12345-6789", "", None, "nothing"]
    v = spark.createDataFrame(values, "value string, kind string")
    out = automaton.redact(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", v, "value", "kind", "[#]").orderBy("k").collect()
    for row, text in zip(out, texts):
        assert (row["redacted"], row["counts"]) == ((None, {}) if text is None else _replaced(text, values, "[#]"))
    r = random.Random(3)
    for _ in range(300):
        vs = list({"".join(r.choice("aB é-") for _ in range(r.randint(1, 5))): None for _ in range(4)})
        vs = [(x, "n") for x in vs if x.strip()]
        vs = list({x.lower(): (x, k) for x, k in vs}.values())
        text = " ".join(r.choice([x for x, _ in vs] or ["a"]) + r.choice(["", "z", "-", " "]) for _ in range(8))
        made, counts = automaton.Redactor(vs, "[#]")(text)
        assert (made, dict(counts)) == _replaced(text, vs, "[#]"), (text, vs)
    own = spark.createDataFrame([(1, "nothing", "x"), (4, "nothing", "y")], "k int, value string, kind string")
    rows = automaton.redact_own(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", own, "k", "value", "kind", "[#]").orderBy("k").collect()
    assert [x["redacted"] for x in rows] == [*texts[:4], "[#]"] and rows[4]["counts"] == {"y": 1}
    kept = automaton.usable(spark.createDataFrame([(" Acme ",), ("12345",), ("Acme1",), (None,)], "v string"), "v", 5)
    assert [x[0] for x in kept.collect()] == ["Acme1"]
