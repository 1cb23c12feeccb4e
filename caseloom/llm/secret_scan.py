"""Secret scans: fixed patterns, and a character network over every candidate.

Candidates are runs of key-like characters: keys, but also addresses, numbers, paths and names with
digits. A convolutional network in numpy reads every one with the text around it. What a pattern
matches stays a finding whatever the network says; of the others it decides. It is trained on labelled findings: what the patterns found in a
bounded sample of the corpus and findings written by rule are positive,
plain candidates that look like names, numbers, paths and identifiers are negative. Other
candidates of the corpus have no label and aren't learnt from. Its
threshold is set on findings that it didn't learn from, after Platt scaling: at most the
largest that keeps the recall asked for, whatever precision that leaves, and lower as far as the precision asked for allows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table

# The patterns, their least lengths, and their order among equal starts.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more in all
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")
_ASSIGN_LEAST = 12
_WORDS = ("password", "passwd", "secret", "token", "api")

#: A candidate: a run of these characters with a digit in it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@-]{12,}")
_DIGIT = re.compile(r"[0-9]")
#: A piece of a candidate: paths, addresses and assignments join several into one run.
PIECE = re.compile(r"[A-Za-z0-9+_-]{12,}")
#: Characters that the network reads at once of a candidate, and of the text before and after. Longer ones
#: are read in windows that overlap, so that any STEP characters in a row stand whole in one of them.
INSIDE, BEFORE, AFTER, STEP = 40, 24, 16, 20
#: Bounds of the fit: findings from the corpus of either label, and written ones.
SAMPLE, WRITTEN = 2000, 3000
RECALL, PRECISION = 0.98, 0.99
_SEED = 11

_CLASSES = np.full(0x10000, 1, np.uint8)  # 0: beyond the end, 1: any other character
for _k, _c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n"):
    _CLASSES[ord(_c)] = 2 + _k
_N_CLASSES = int(_CLASSES.max()) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number in KINDS) of the patterns' matches, in order; ends are exclusive."""
    found = []
    if any(w in (low := text.lower()) for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    del low
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if _DIGIT.search(text, m.start(), m.end())]


def apart(own: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Which candidates no base span overlaps."""
    if not own or not base:
        return np.ones(len(own), bool)
    starts, ends = np.array([s for s, _, _ in base]), np.maximum.accumulate(np.array([e for _, e, _ in base]))
    s, e = np.array(own).T
    before = np.searchsorted(starts, e) - 1  # the last base span that begins before the candidate's end
    return (before < 0) | (ends[np.maximum(before, 0)] <= s)


def windows(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """What the network reads of a candidate: all of the run, and each of its pieces by itself."""
    out = []
    for lo, hi in dict.fromkeys([(s, e), *(m.span() for m in PIECE.finditer(text, s, e) if _DIGIT.search(text, *m.span()))]):
        out += [(k, k + INSIDE) for k in range(lo, hi - INSIDE, STEP)] + [(max(lo, hi - INSIDE), hi)]
    return list(dict.fromkeys(out))


@dataclass
class Encoded:
    """Character classes of windows (``x``), and where each candidate's windows begin (``first``)."""

    x: np.ndarray
    first: np.ndarray


def encode_windows(spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Character classes of (text, start, end): what stands before, then the window, then what follows."""
    out = np.zeros((len(spans), BEFORE + INSIDE + AFTER), np.uint8)
    for k, (text, s, e) in enumerate(spans):
        lo = max(0, s - BEFORE)
        classes = _CLASSES[np.minimum(np.frombuffer(text[lo : e + AFTER].encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
        out[k, BEFORE - (s - lo) : BEFORE + e - s] = classes[: e - lo]
        out[k, BEFORE + INSIDE : BEFORE + INSIDE + len(classes) - (e - lo)] = classes[e - lo :]
    return out


def encode(items: list[tuple[str, int, int]]) -> Encoded:
    """All windows of the candidates (text, start, end)."""
    each = [windows(*i) for i in items]
    first = np.cumsum([0, *map(len, each)])[:-1]
    return Encoded(encode_windows([(i[0], *w) for i, ws in zip(items, each) for w in ws]), first.astype(np.int64))


class Network:
    """Embedding, one convolution, maximum and mean over the places, one logit.

    The maximum and mean are taken over the places of the candidate and of the text before and
    after apart, so that a word like ``key`` before and a texture inside both count. A
    candidate's logit is the largest of its windows.
    """

    WIDTH, FILTERS, EMBED = 5, 24, 12

    def __init__(self, seed: int = _SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (_N_CLASSES, self.EMBED)),
            "conv": r.normal(0, (2 / (self.WIDTH * self.EMBED)) ** 0.5, (self.WIDTH * self.EMBED, self.FILTERS)),
            "bias": np.zeros(self.FILTERS),
            "out": r.normal(0, 0.1, 6 * self.FILTERS),
            "last": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = float("nan")  # at the threshold, on the findings that set it

    def _forward(self, x: np.ndarray):
        e = self.p["embed"][x]
        places = x.shape[1] - self.WIDTH + 1
        windows = np.concatenate([e[:, k : k + places] for k in range(self.WIDTH)], axis=2)
        z = windows @ self.p["conv"] + self.p["bias"]
        a = np.maximum(z, 0)
        cut = BEFORE - self.WIDTH + 1
        parts = (slice(0, cut), slice(cut, BEFORE + INSIDE), slice(BEFORE + INSIDE, places))
        h = np.concatenate([f(a[:, s]) for s in parts for f in (lambda v: v.max(1), lambda v: v.mean(1))], axis=1)
        return windows, a, parts, h, h @ self.p["out"] + self.p["last"]

    def logits(self, items: Encoded) -> np.ndarray:
        x = items.x
        if not len(x):
            return np.zeros(0, np.float32)
        return np.maximum.reduceat(np.concatenate([self._forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)]), items.first)

    def probability(self, items: Encoded) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(items) + self.shift, -30, 30)))

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict:
        windows, a, parts, h, logit = self._forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        g = {"out": h.T @ d, "last": np.array([d.sum()], np.float32)}
        dh = d[:, None] * self.p["out"]
        da = np.zeros_like(a)
        f = self.FILTERS
        rows, cols = np.arange(len(x))[:, None], np.arange(f)[None]
        for k, s in enumerate(parts):
            top = a[:, s].argmax(1) + s.start
            da[rows, top, cols] += dh[:, 2 * k * f : (2 * k + 1) * f]
            da[:, s] += dh[:, None, (2 * k + 1) * f : (2 * k + 2) * f] / (s.stop - s.start)
        da *= a > 0
        g["conv"] = np.tensordot(windows, da, ([0, 1], [0, 1]))
        g["bias"] = da.sum((0, 1))
        dw = da @ self.p["conv"].T
        de = np.zeros((len(x), x.shape[1], self.EMBED), np.float32)
        places = a.shape[1]
        for k in range(self.WIDTH):
            de[:, k : k + places] += dw[:, :, k * self.EMBED : (k + 1) * self.EMBED]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x.ravel(), de.reshape(-1, self.EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 3e-3, seed: int = _SEED) -> None:
        """Adam over shuffled batches; the same data and seed give the same network."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                t += 1
                for k, g in self._step(x[at], y[at].astype(np.float32)).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)

    def calibrate(self, items: Encoded, y: np.ndarray, recall: float = RECALL, precision: float = PRECISION) -> None:
        """Platt scaling, then the largest threshold that keeps ``recall`` of the positives, or the least one above
        which ``precision`` of the findings are positives if that lies lower: keys unlike those learnt score lower."""
        s = self.logits(items).astype(np.float64)
        a, b = 1.0, 0.0
        n1, n0 = int(y.sum()), int(len(y) - y.sum())
        goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w, e = np.maximum(p * (1 - p), 1e-9), p - goal
            hess = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, [(e * s).sum(), e.sum()])
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.scale, self.shift = float(a), float(b)
        chance = self.probability(items)
        positive = np.sort(chance[y > 0])
        if len(positive):
            cut = float(positive[int(np.floor((1 - recall) * len(positive)))])
            order = np.argsort(-chance, kind="stable")
            share = np.cumsum(y[order] > 0) / np.arange(1, len(order) + 1)
            clean = chance[order][share >= precision]
            self.threshold = min(cut, float(clean[-1])) if len(clean) else cut
            hit = chance >= self.threshold
            self.recall, self.precision = float(hit[y > 0].mean()), float((y[hit] > 0).mean())


def written_findings(n: int, seed: int = _SEED, hidden: str | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): half random keys in places where keys stand, half
    candidates that aren't keys (compound names, dates, numbers, paths, versions, addresses).
    Keys of the kind ``hidden`` aren't written."""
    r = random.Random(seed)
    letters = string.ascii_letters + string.digits
    word = lambda lo=3, hi=9: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(lo, hi)))
    keys = ("key", "secret", "token", "auth", "bearer", "credential", "private_key", "client_secret", "pwd", "access", "sig")
    lower = string.digits + "abcdef"
    alphabets = [letters, letters + "+/", letters + "-_", string.hexdigits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, *[lower] * (hidden != "hex")]
    out = []
    for k in range(n):
        if k % 2:
            # Some keys use digits and a few letters only, whichever those are.
            alphabet = r.choice(alphabets) if r.random() < 0.5 else string.digits + "".join(r.sample(string.ascii_lowercase, r.randint(4, 12)))
            body = "".join(r.choice(alphabet) for _ in range(r.randint(16, 64)))
            if not any(c.isdigit() for c in body):
                body = body[:-1] + r.choice(string.digits)
            body = r.choice(("", "", "", "sk-", "ghp_", "xox-", "pk_live_")) + body
            lead = f"{word()} {r.choice(keys)}{r.choice((' = ', ': ', '=', ' ', ' is '))}" if r.random() < 0.7 else f"{word()} {word()} "
        else:
            join = r.choice(("_", "-", "/"))
            style = r.randrange(9)
            if style == 0:
                body = join.join([*(word() for _ in range(r.randint(3, 6))), str(r.randint(0, 2050))])
            elif style == 1:
                body = "".join(r.choice(string.digits) for _ in range(r.randint(16, 24)))
            elif style == 2:
                body = f"{r.randint(1990, 2050)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{word(5, 8)}"
            elif style == 3:
                body = "".join(word().capitalize() for _ in range(r.randint(3, 5))) + str(r.randint(0, 99))
            elif style == 4:
                body = word(4, 8) + "=" * r.randint(8, 20) + str(r.randint(1, 9))
            elif style == 5:
                body = "/".join(word() for _ in range(r.randint(3, 6))) + f"/v{r.randint(1, 9)}"
            elif style == 6:
                body = f"{word(3, 14)}{r.choice(('.', '_', ''))}{r.randint(0, 99)}@{word()}{r.choice(('', str(r.randint(1, 9))))}.{word()}.{word(2, 3)}"
            elif style == 7:
                body = ".".join(str(r.randint(100, 255)) for _ in range(4))
            else:
                body = ".".join([word(), word() + str(r.randint(0, 99)), word(), word(2, 3)])
            body += "0" * (16 - len(body)) if len(body) < 16 else ""
            lead = f"{word()} {r.choice(('the', 'in', 'file', 'page', 'no', 'see', 'id', *keys[:3]))} " if r.random() < 0.7 else f"{word()} {word()}, "
        text = f"{lead}{body} {word()}"
        out.append((text, len(lead), len(lead) + len(body), k % 2))
    return out


def embedded_findings(n: int, seed: int = _SEED) -> list[tuple[str, int, int, int, int, int]]:
    """(text, start, end, label, key's start, key's end): long path-like runs, half of them with a key inside."""
    r = random.Random(seed)
    letters = string.ascii_letters + string.digits
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(3, 9)))
    part = lambda: r.choice((word(), word(), f"{word()}-{word()}", f"{word()}_{word()}", f"v{r.randint(1, 9)}", str(r.randint(1990, 2050)), f"{word()}={word()}"))
    out = []
    for k in range(n):
        join = r.choice(("/", "/", "/", "=", "_", "-"))
        head, tail = (join.join(part() for _ in range(r.randint(2, 10))) for _ in range(2))
        key = "".join(r.choice(r.choice((letters, letters + "+"))) for _ in range(r.randint(20, 48))) if k % 2 else f"{word()}-{word()}-{r.randint(0, 2050)}"
        key = key if any(c.isdigit() for c in key) else key[:-1] + r.choice(string.digits)
        lead = f"{word()} {word()} "
        body = f"{head}{join}{key}{join}{tail}"
        at = len(lead) + len(head) + 1
        out.append((f"{lead}{body} {word()}", len(lead), len(lead) + len(body), k % 2, at, at + len(key)))
    return out


#: Shapes of the written findings that aren't keys. A candidate of the corpus that no pattern knows and that
#: hasn't one of them may be a key: nobody has labelled it, so it is no negative.
PLAIN = re.compile(r"[0-9]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[^\W_]+(?:[._][0-9]*)?@[^\W_]+(?:\.[^\W_]+)+|[^\W\d_]{2,}[0-9]{0,2}(?:\.[^\W\d_]{2,}[0-9]{0,2})+|[a-z]{2,}(?:[_/-][a-z]{2,})+(?:[_/-]v?[0-9]{1,4})?0*|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:-[a-z]+)?0*|(?:[A-Z][a-z]{2,}){2,}[0-9]{0,2}0*|[a-z]{2,}=+[0-9]0*")
FINDINGS = "snippet string, start int, stop int, label int, unit long"


def _labelled(hidden: str | None):
    """What the patterns found (label 1) and other candidates, as snippets: those of plain shapes (0), and the rest (-1),
    whose surroundings serve only. A ``hidden`` kind counts among the rest."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(m.start(2), m.end(2), 0) for m in ASSIGN.finditer(text)] if any(k == 0 for _, _, k in base) else []
                spans = [s for s in spans if s[1] - s[0] >= _ASSIGN_LEAST] + [s for s in base if s[2]]
                own = candidates(text)
                rest = [c for c, free in zip(own, apart(own, base)) if free]
                # A long run of nothing but digits is a number, not a key: the network must learn to leave it.
                known = [(s, e, 0 if text[s:e].isdigit() else -1 if KINDS[k] == hidden else 1) for s, e, k in spans]
                for s, e, label in known + [(s, e, 0 if PLAIN.fullmatch(text, s, e) else -1) for s, e in rest]:
                    lo, hi = max(0, s - BEFORE), min(e, s + 512)
                    snippet = text[lo : hi + AFTER]
                    unit = int.from_bytes(hashlib.blake2b(snippet.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
                    rows.append((snippet, s - lo, hi - lo, label, unit))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["snippet", "start", "stop", "label", "unit"])

    return rows_of


def train(docs: DataFrame, rows: int = 4000, sample: int = SAMPLE, recall: float = RECALL, hidden: str | None = None) -> Network:
    """Fit on findings from about ``rows`` documents (drawn by a hash of the doc_id)
    and on WRITTEN ones; at most ``sample`` findings of either label are used.
    What the pattern ``hidden`` finds isn't learnt from: a measure of keys that no pattern knows."""
    n = docs.count()
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = docs.where(unit < min(1.0, rows / max(1, n))).select("text").mapInArrow(_labelled(hidden), FINDINGS)
    drawn = materialize(drawn.distinct(), "secret-findings")
    found = [r for k in (0, 1, -1) for r in drawn.where(F.col("label") == k).orderBy("unit", "snippet", "start").limit(sample).collect()]
    items = [(r["snippet"], r["start"], r["stop"], r["label"], r["start"], r["stop"]) for r in found if r["label"] >= 0]
    written = [(*f, *f[1:3]) for f in written_findings(WRITTEN, hidden=hidden)] + embedded_findings(WRITTEN // 3)
    # Half of the written ones of either label stand in surroundings of the corpus, which then tell nothing by themselves.
    places, r = [(f["snippet"][: f["start"]], f["snippet"][f["stop"] :]) for f in found], random.Random(_SEED)
    for k, (text, s, e, label, lo, hi) in enumerate(written):
        if places and r.random() < 0.5:
            before, after = r.choice(places)
            d = len(before) - s
            written[k] = (before + text[s:e] + after, s + d, e + d, label, lo + d, hi + d)
    items += written
    order = np.random.default_rng(_SEED).permutation(len(items))
    cut = len(items) * 4 // 5
    network = Network()
    network.fit(*_window_labels([items[k] for k in order[:cut]]))
    held = [items[k] for k in order[cut:]]
    network.calibrate(encode([i[:3] for i in held]), np.array([i[3] for i in held]), recall)
    return network


def _window_labels(items: list[tuple[str, int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels: 1 where one holds 16 characters of a key or all of it, 0 where it holds none; others are left out."""
    spans, labels = [], []
    for text, s, e, label, lo, hi in items:
        for a, b in windows(text, s, e):
            shared = min(b, hi) - max(a, lo)
            if not label or shared <= 0 or shared >= min(16, hi - lo):
                spans.append((text, a, b))
                labels.append(int(label and shared > 0))
    return encode_windows(spans), np.array(labels)


@dataclass
class Scan:
    """Base spans, all spans with the network's, and the probability of every candidate (start, end)."""

    base: list[tuple[int, int, int]]
    spans: list[tuple[int, int, int]]
    scores: list[tuple[int, int, float]]


def scan_texts(texts: list[str], network: Network) -> list[Scan]:
    """Every candidate is scored; those that overlap a base span add none, whatever their score."""
    out, items, owner, free = [], [], [], []
    for k, text in enumerate(texts):
        base, own = base_spans(text), candidates(text)
        out.append(Scan(base, list(base), []))
        items += [(text, s, e) for s, e in own]
        owner += [k] * len(own)
        free += apart(own, base).tolist()
    chance = network.probability(encode(items)) if items else []
    for (_, s, e), k, own, p in zip(items, owner, free, chance):
        out[k].scores.append((s, e, float(p)))
        if own and p >= network.threshold:
            out[k].spans.append((s, e, 3))
    for scan in out:
        scan.spans.sort(key=lambda s: (s[0], s[2]))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, e, k in spans])


SCANNED = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_network bigint, n_candidates bigint, top_score double"


def find_secrets(docs: DataFrame, network: Network) -> DataFrame:
    """One row for every row of docs: counts of the patterns, a digest of their spans
    and all spans (``kind:start:end`` in code points, ends exclusive, by start and
    then kind), how many of them the network added, the candidates it scored and the highest score
    (null without one). Null and empty texts have none; repeated rows are alike; an empty table gives
    an empty result; other columns are ignored. Whole texts, of any length, are read in one pass without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                found = scan_texts([t or "" for t in part.column("text").to_pylist()], shared.value)
                counts = [[sum(k == kind for _, _, k in f.base) for f in found] for kind in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(spell(f.base).encode()).hexdigest() for f in found]), pa.array([spell(f.spans) for f in found])]
                    + [pa.array([len(f.spans) - len(f.base) for f in found], pa.int64()), pa.array([len(f.scores) for f in found], pa.int64()), pa.array([max((p for _, _, p in f.scores), default=None) for f in found], pa.float64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network", "n_candidates", "top_score"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(rows, SCANNED)


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, train(docs))
