"""N-gram Jaccard join with prefix trees.

A document is its set of distinct n-word shingles. Equal sets are one class.
Classes meet in a group when they agree on one of the parts that a set falls
into: at similarity t two sets of at most X and X/t shingles differ in at most
H = X(1-t)/t of them, so of more than H parts (ranges of the shingles' hashes) at
least one that isn't empty is equal in both. No link is lost, and no statistics of the corpus are
needed. Groups that grow large because their sets share passages fall apart by their
rarest shingles first, of which similar sets share one. In a group the sets, their shingles in one global order (commonest in
the group first), are stored in a prefix tree; each set walks down the tree with
its overlap so far, shared by all sets below a node, and leaves a subtree as
soon as what remains of either side can no longer reach the overlap needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import BROADCAST_BYTES, discard, drop_shuffles, lean, materialize, small_side, table, unused
from .text_arrays import Runs, Words, finish, text_slices

#: Shingles in one block of a large group; a group of more is cut into blocks and
#: every pair of blocks is one task.
BLOCK = 1_000_000
#: Shingles that a task gathers before it combines equal parts.
COMBINE = 1_500_000
#: Shingles that this share of a task's documents hold are common; a set may leave out parts
#: of common shingles for about DROP of its size.
COMMON, DROP = 0.0006, 0.03


def shingle_sets(words: Words, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes; a row of fewer words has one."""
    runs = Runs(hashes)
    grams = runs.all(n)
    for first, count in zip(words.first, words.count):
        if count >= n:
            yield np.unique(grams[first : first + count - n + 1])
        elif count:
            yield runs.between(np.array([first]), np.array([first + count]))
        else:
            yield grams[:0]


def _buckets(num: int, den: int) -> np.ndarray:
    """Least set size of each size bucket: sets that can be similar lie in one or in neighbours."""
    if num >= den:  # only equal sets are similar
        return np.array([1, 1 << 40])
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * den // num + 1)
    return np.array(least)


@lru_cache(maxsize=None)
def _n_parts(bucket: int, num: int, den: int) -> tuple[int, int]:
    """(parts, differences at most) for pairs whose smaller set is of ``bucket``.

    With K parts and at most H differences K - H parts are equal, of which those that
    are empty say nothing. K is the least number of which a set of the bucket fills
    more than H by three standard deviations and by some parts that it may drop.
    """
    least = _buckets(num, den)
    size, most = int(least[bucket]), int((least[bucket + 1] - 1) * (den - num) // num)
    k, spare = most + 1, 2 * ceil(DROP * size)
    while k < 3 * most + 8:
        empty = exp(-size / k)
        if k * (1 - empty) - 3 * sqrt(k * empty * max(0.0, 1 - (1 + size / k) * empty)) > most + spare:
            break
        k += 1
    return k, most


def _parts(tokens: np.ndarray, common: np.ndarray, bucket: int, num: int, den: int) -> np.ndarray:
    """Digests of the set's parts, for pairs whose smaller set is of ``bucket``.

    Two similar sets agree on all but H parts. If a set fills n of them, it may leave
    out its empty ones and (n - H - 1) / 2 others: were both sets of a pair to do so,
    the one with the larger n would still keep a filled part in which they agree.
    Left out are parts that hold nothing but ``common`` shingles. A set that fills
    no more than H parts sends all, the empty ones too.
    """
    k, most = _n_parts(bucket, num, den)
    if most < 1:  # such pairs can't differ, and equal sets are one class
        return tokens[:0]
    edges = (np.arange(1, k, dtype=np.float64) * (2.0**64 / k)).astype(np.uint64)
    cut = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(finish(tokens + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
    parts = finish(total[cut[1:]] - total[cut[:-1]] + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((bucket + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    filled = cut[1:] > cut[:-1]
    n = int(filled.sum())
    if n <= most:
        return parts
    if common.any():
        rare = np.concatenate([[0], np.cumsum(~common)])
        plain = np.flatnonzero(filled & (rare[cut[1:]] == rare[cut[:-1]]))
        filled[plain[: (n - most - 1) // 2]] = False
    return parts[filled]


SETS = "doc_id bigint, n_shingles bigint, set_hash binary"


def _digest(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of each text of a column."""
    for lo, _, buf, offs in text_slices(column):
        words = Words(buf, offs)
        yield from enumerate(shingle_sets(words, words.hashes(0, lower=True), n), lo)


def _sketch(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column("text")):
                words = Words(buf, offs)
                found = [(len(x), _digest(x)) for x in shingle_sets(words, words.hashes(0, lower=True), n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "n_shingles", "set_hash"])

    return rows


#: A digest and a document that has it.
PARTS = "part bigint, doc_id bigint"


def _combine(part: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """One row for each part, with its least document; each other document that has
    it is tied to that one by a digest of the two, once however many parts they share."""
    order = np.lexsort((doc, part))
    part, doc = part[order], doc[order]
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    hub = doc[new][np.cumsum(new) - 1]
    rest = ~new & (doc != hub)
    ties = np.unique(np.stack([doc[rest], hub[rest]], axis=1), axis=0) if rest.any() else np.zeros((0, 2), np.int64)
    digest = finish(ties[:, 0].astype(np.uint64) + finish(ties[:, 1].astype(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([part[new], digest, digest]).view(np.int64)), pa.array(np.concatenate([doc[new], ties[:, 0], ties[:, 1]]))], names=["part", "doc_id"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles, sorted, that COMMON of these sets hold (and 3 at least).

    What is common here only chooses which parts are left out, never which pairs are found."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    return values[counts >= max(3, COMMON * len(sets))]


def _part_rows(n: int, num: int, den: int):
    least = _buckets(num, den)

    def rows_of(docs: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        held, owner, common = [], [], _common(sets)
        for doc, tokens in zip(docs, sets):
            b = int(np.searchsorted(least, len(tokens), "right")) - 1
            plain = np.zeros(len(tokens), bool)
            if len(common):
                plain = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
            for x in (b - 1, b) if b else (b,):
                held.append(_parts(tokens, plain, x, num, den))
                owner.append(np.full(len(held[-1]), doc))
        return _combine(np.concatenate(held), np.concatenate(owner))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, size = [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for lo, _, buf, offs in text_slices(batch.column("text")):
                words = Words(buf, offs)
                for doc, tokens in zip(ids[lo:], shingle_sets(words, words.hashes(0, lower=True), n)):
                    if len(tokens):
                        docs.append(doc)
                        sets.append(tokens)
                        size += len(tokens)
                if size >= COMBINE:
                    yield rows_of(docs, sets)
                    docs, sets, size = [], [], 0
        if docs:
            yield rows_of(docs, sets)

    return rows


class PrefixTree:
    """Sets of ranks, each ascending, with the runs of ranks that sets share stored once."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        parent, depth, rep, low, high, ends, begin, stop = [-1], [0], [order[0]], [1 << 60], [0], [[]], [0], [len(sets)]
        stack = [0]

        def add(up: int, d: int, r: int, at: int) -> int:
            parent.append(up)
            depth.append(d)
            rep.append(r)
            low.append(1 << 60)
            high.append(0)
            ends.append([])
            begin.append(at)
            stop.append(len(sets))
            return len(parent) - 1

        before = None
        for at, i in enumerate(order):
            s = sets[i]
            same = 0
            if before is not None:
                m = min(len(before), len(s))
                differ = np.flatnonzero(before[:m] != s[:m])
                same = int(differ[0]) if len(differ) else m
            while depth[stack[-1]] > same:
                last = stack.pop()
                stop[last] = at
                if depth[stack[-1]] < same:  # split the run above ``last``
                    mid = add(stack[-1], same, rep[last], begin[last])
                    parent[last] = mid
                    stack.append(mid)
            if depth[stack[-1]] < len(s):
                stack.append(add(stack[-1], len(s), i, at))
            ends[stack[-1]].append(i)
            before = s
        n = len(parent)
        self.parent, self.depth = np.array(parent), np.array(depth)
        rank = np.argsort(self.depth, kind="stable")  # parents before children
        low, high = np.array(low), np.array(high)
        for node in rank[::-1]:
            if ends[node]:
                low[node], high[node] = min(low[node], depth[node]), max(high[node], depth[node])
            up = parent[node]
            if up >= 0:
                low[up], high[up] = min(low[up], low[node]), max(high[up], high[node])
        self.low, self.high = low, high
        up = np.maximum(self.parent, 0)
        self.length = self.depth - self.depth[up]
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.concatenate([sets[rep[k]][depth[max(parent[k], 0)] : depth[k]] for k in range(n)]) if n > 1 else np.zeros(0, np.int64)
        below = np.argsort(self.parent, kind="stable")
        self.below = below[np.searchsorted(self.parent[below], 0) :]
        self.child = np.searchsorted(self.parent[self.below], np.arange(n + 1))
        self.ends = ends
        self.has_end = np.array([bool(e) for e in ends])
        # The sets below a node, as places in the sorted order.
        self.order, self.begin, self.stop = np.array(order), np.array(begin), np.array(stop)

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """For each node the label that all sets below it have, or -1."""
        own = label[self.order]
        change = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        return np.where(change[self.stop - 1] == change[self.begin], own[self.begin], -1)

    def similar(self, probe: np.ndarray, marks: np.ndarray, num: int, den: int, passed: np.ndarray | None = None) -> list[int]:
        """Sets with den * intersection >= num * union. ``marks``: zeros, one for each rank;
        what lies below the nodes in ``passed`` isn't asked for."""
        marks[probe] = 1
        size, found = len(probe), []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            counts = self.child[nodes + 1] - self.child[nodes]
            if not counts.sum():
                break
            kids = self.below[_spread(self.child[nodes], counts)]
            overlap = np.repeat(overlap, counts)
            if passed is not None:
                asked = ~passed[kids]
                kids, overlap = kids[asked], overlap[asked]
                if not len(kids):
                    break
            length = self.length[kids]
            at = _spread(self.offset[kids], length)
            inside = np.concatenate([[0], np.cumsum(marks[self.flat[at]])])
            stop = np.cumsum(length)
            overlap = overlap + inside[stop] - inside[stop - length]
            # What can still be added: the probe's ranks after the node's last, or the longest set below.
            left = size - np.searchsorted(probe, self.flat[self.offset[kids] + length - 1], "right")
            most = overlap + np.minimum(left, self.high[kids] - self.depth[kids])
            keep = (den + num) * most >= num * (size + self.low[kids])
            kids, overlap = kids[keep], overlap[keep]
            hit = self.has_end[kids] & ((den + num) * overlap >= num * (size + self.depth[kids]))
            for node in kids[hit]:
                found += self.ends[node]
            nodes = kids
        marks[probe] = 0
        return found


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), then those of start[1], and so on."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))


def _kin(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A label for each set, equal for all that may be linked through others, and the sets as
    ranks, ascending from the commonest shingle.

    Similar sets share one of their rarest |x| - t|x| + 1 shingles, whatever the order among
    equally rare ones; what only shares common shingles (a passage, a boilerplate line)
    falls apart here and isn't compared.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ranks = rank[inverse]
    order = np.lexsort((ranks, owner))
    ranks = ranks[order]
    ends = np.cumsum(sizes)
    kept = sizes - -(-sizes * num // den) + 1  # of each set, from its end on
    rare = np.arange(len(ranks)) >= np.repeat(ends - kept, sizes)
    token, who = ranks[rare], owner[rare]
    by = np.argsort(token, kind="stable")
    token, who = token[by], who[by]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    label = np.arange(len(sets))
    while len(token):
        least = np.repeat(np.minimum.reduceat(label[who], first), np.diff(np.append(first, len(token))))
        new = label.copy()
        np.minimum.at(new, who, least)
        np.minimum.at(new, label[who], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label, np.split(ranks, ends[:-1])


def join_sets(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int, every: bool = True):
    """(i, [j, ...]) for each set i of ``left`` with links to ``right`` (to later and
    earlier sets of ``left`` itself if None), through one prefix tree for each kin.

    Unless ``every`` link is asked for, sets that earlier links connect aren't compared
    again: the links given connect the same sets, and near copies cost about one comparison each.
    """
    split = len(left)
    label, ranked = _kin([*left, *(right or [])], num, den)
    marks = np.zeros(1 + max((int(r[-1]) for r in ranked if len(r)), default=0), np.int64)
    order = np.argsort(label, kind="stable")
    joined = np.arange(len(ranked))
    for members in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        probes = members if right is None else members[members < split]
        stored = members if right is None else members[members >= split]
        if not len(probes) or not len(stored) or len(members) < 2:
            continue
        tree = PrefixTree([ranked[k] for k in stored])
        same = tree.uniform(joined[stored])
        for i in probes:
            found = stored[tree.similar(ranked[i], marks, num, den, None if every else same == joined[i])]
            found = found[found != i]
            if not len(found):
                continue
            yield int(i), (found - (0 if right is None else split)).tolist()
            if not every:
                seen = np.unique(np.append(joined[found], joined[i]))
                if len(seen) > 1:
                    joined[members[np.isin(joined[members], seen)]] = seen[0]
                    same = tree.uniform(joined[stored])


LINKS = "doc_id bigint, set_hash binary, other bigint, links bigint"


def _join_group(n: int, num: int, den: int, give: str):
    """``give``: "pairs" of classes, every class with its number of "links" and a class linked to it, or only "classes"."""

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        # Rows that share a doc_id but not the text of its class are passed over, repeated ones too.
        held: dict[bytes, tuple[int, np.ndarray]] = {}
        for k, x in _sets_of(rows.column("text"), n):
            digest = _digest(x)
            if digest == rows.column("set_hash")[k].as_py():
                held.setdefault(digest, (k, x))
        hashes = np.array(list(held), object)
        once = np.array([k for k, _ in held.values()], np.int64)
        sets = [x for _, x in held.values()]
        ids, copies, block, upper = (np.asarray(rows.column(c))[once] for c in ("doc_id", "copies", "block", "upper"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        label, links, out = np.arange(len(ids)), np.zeros(len(ids), np.int64), []
        a = np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        found = join_sets([sets[k] for k in a], None if i == j else [sets[k] for k in b], num, den, give != "classes") if len(a) and len(b) else ()
        for k, others in found:
            k, others = a[k], b[np.array(others)]
            if give != "classes":
                others = others[~(upper[k] & upper[others])]  # two of the level above meet there
            links[k] += copies[others].sum()
            if i != j:
                links[others] += copies[k]
            if give == "pairs":
                keep = others if i != j else others[others > k]
                out += [(int(ids[k]), hashes[k], int(x)) for x in ids[keep]]
            seen = np.unique(np.append(label[others], label[k]))
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
        if give == "pairs":
            own, keys, other = (list(c) for c in zip(*out)) if out else ([], [], [])
            links = [1] * len(own)
        else:
            told = np.flatnonzero(links > 0) if give == "links" else np.flatnonzero(label != np.arange(len(ids)))
            own, keys, other, links = ids[told], list(hashes[told]), ids[label[told]], links[told]
        return pa.table({"doc_id": pa.array(own, pa.int64()), "set_hash": pa.array(keys, pa.binary()), "other": pa.array(other, pa.int64()), "links": pa.array(links, pa.int64())})

    return group


def _classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """All documents with their set's hash, and one row a class (rep, copies)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(keyed.mapInArrow(lean(_sketch(n)), SETS), "jaccard-sets")
    classes = base.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"))
    return base, classes


TOKENS, SHARED = "bucket int, tokens binary, owners binary", "token bigint, no bigint, held int"


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all highest ones together and so on: those that repeat are compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _token_rows(n: int, buckets: int):
    """The shingles of each class's text with the class's number, in ascending order, a row for each range of hashes."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)

    def rows_of(numbers: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, owners = np.concatenate(sets), np.repeat(np.array(numbers, np.int64), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        cut = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
        full = np.flatnonzero(np.diff(cut))
        packed = lambda x: pa.array([_planes(x[cut[b] : cut[b + 1]]) for b in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), packed(tokens), packed(owners)], names=["bucket", "tokens", "owners"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sets, size = [], [], 0
        for batch in batches:
            for k, x in _sets_of(batch.column("text"), n):
                if _digest(x) == batch.column("set_hash")[k].as_py():  # else another text under the class's doc_id
                    numbers.append(batch.column("no")[k].as_py())
                    sets.append(x)
                    size += len(x)
                if size >= COMBINE:
                    yield rows_of(numbers, sets)
                    numbers, sets, size = [], [], 0
        if sets:
            yield rows_of(numbers, sets)

    return rows


def _shared_tokens(rows: pa.Table) -> pa.Table:
    """The shingles of one range that two classes or more have, with the number of classes."""
    tokens, owners = (np.concatenate([_from_planes(x) for x in rows.column(c).to_pylist()]) for c in ("tokens", "owners"))
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])  # repeated rows count once
    tokens, owners = tokens[new], owners[new]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    held = np.repeat(np.diff(np.append(first, len(tokens))), np.diff(np.append(first, len(tokens))))
    some = np.flatnonzero(held > 1)
    some = some[np.argsort(owners[some], kind="stable")]
    return pa.table({"token": pa.array(tokens[some]), "no": pa.array(owners[some]), "held": pa.array(held[some].astype(np.int32))})


def _kindred(texts: DataFrame, large: DataFrame, num: int, den: int, n: int) -> DataFrame:
    """doc_id and component: the parts into which large clusters (``large``: doc_id, set_hash, no, n_shingles, cluster) fall.

    Two similar sets share one of their rarest |x| - t|x| + 1 shingles, in one order for all: that of the number of classes
    which have a shingle. A set with fewer than t|x| shingles that another has as well has no link. What only shares
    passages falls apart here. Each shingle of a large cluster's classes is shuffled once.
    """
    spark = texts.sparkSession
    size = large.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")).first()
    own = texts.join(small_side(large.select("doc_id", "set_hash", "no"), size["n"], 80), "doc_id")
    if size["n"] * 80 > BROADCAST_BYTES:  # texts were shuffled: those files go before shingles are
        own = materialize(own, "jaccard-texts")
        drop_shuffles(spark)
    rows = own.mapInArrow(lean(_token_rows(n, max(1, -(-size["total"] // BLOCK)))), TOKENS)
    shared = materialize(rows.groupBy("bucket").applyInArrow(_shared_tokens, SHARED), "jaccard-shared")
    if size["n"] * 80 > BROADCAST_BYTES:
        discard(own)
    drop_shuffles(spark)
    need = F.expr(f"({num} * n_shingles + {den - 1}) div {den}")
    counts = shared.groupBy("no").agg(F.count(F.lit(1)).alias("m"))
    left = materialize(large.select("no", "doc_id", "cluster", need.alias("need")).join(counts, "no").where("m >= need").drop("m"), "jaccard-left")
    line = Window.partitionBy("no").orderBy(F.desc("held"), F.desc("token"))
    rare = shared.join(small_side(left, left.count(), 60), "no").withColumn("place", F.row_number().over(line)).where("place >= need")
    hub = F.first("doc_id").over(Window.partitionBy("cluster", "token").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    found = components(rare.select("doc_id", hub.alias("hub")).where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    discard(shared, left)
    return found.withColumnRenamed("node", "doc_id")


def _grouped(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The classes' sets, with block pairs (i, j), keyed by the cluster in which all their links lie.

    Each task sends a part once, with its least document, and links the part's
    other documents to that one itself, so that a part which a third of all
    documents share is as many rows as there are tasks.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = texts.where("doc_id is not null").mapInArrow(lean(_part_rows(n, num, den)), PARTS)
    # In order of doc_id the first document of a part is its hub: nothing is held in memory.
    hub = F.first("doc_id").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edges = parts.select("doc_id", hub.alias("hub")).where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("n"))
    clusters = components(edges.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    members = classes.select("set_hash", F.col("rep").alias("doc_id"), "copies", "n_shingles").join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
    members = materialize(members.withColumn("no", F.monotonically_increasing_id()), "jaccard-clusters")
    shingles = lambda rows: rows.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count(F.lit(1)).alias("n_classes")).where("n_classes > 1").drop("n_classes")
    large = materialize(shingles(members).where(F.col("total") > BLOCK).select("component"), "jaccard-large")  # one for each BLOCK of shingles at most
    if not large.isEmpty():
        split = members.join(F.broadcast(large), "component").withColumnRenamed("component", "cluster")
        split = split.drop("cluster", "no").join(_kindred(texts, split, num, den, n), "doc_id")
        members = members.join(F.broadcast(large), "component", "left_anti").drop("no").unionByName(split)
        members = materialize(members, "jaccard-clusters")
    totals = shingles(members)
    # Similar sets lie on one level of size or on neighbours: a large cluster is joined level by level.
    own = F.floor(F.log("n_shingles") / (1.001 * log(den / num))).cast("int") if num < den else F.col("n_shingles").cast("int")
    place = lambda level, upper: F.struct(level.alias("level"), F.lit(upper).alias("upper"))
    places = F.when(F.col("total") > BLOCK, F.array(place(own, False), place(own - 1, True))).otherwise(F.array(place(F.lit(0), False)))
    members = members.join(totals, "component").select("doc_id", "set_hash", "copies", "n_shingles", F.col("component").alias("cluster"), F.explode(places).alias("at")).select("*", "at.*").drop("at")
    sizes = members.groupBy("cluster", "level").agg(F.sum("n_shingles").alias("total"), F.count(F.lit(1)).alias("n_classes")).where("n_classes > 1")
    members = members.join(sizes.select("cluster", "level", F.ceil(F.col("total") / F.lit(BLOCK)).cast("int").alias("blocks")), ["cluster", "level"])
    members = members.select("doc_id", "set_hash", "copies", "cluster", "level", "upper", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    members = materialize(members.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "jaccard-members")
    placed = members.select("doc_id", "set_hash", "cluster", "level", "upper", "block", "copies", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    return texts.join(small_side(placed, members.count(), 120), "doc_id")


#: What one task joins: two blocks of a cluster's level.
GROUP = ("cluster", "level", "i", "j")


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, count: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (and n_links, if ``count``): one row for each row of docs.

    Two rows link when den * intersection >= num * union of their distinct n-word
    shingle sets (A-Z lower-cased; fewer than n words: all of them as one).
    component_id is the least doc_id reachable by links, class_id the least with
    an equal set, n_links the number of other rows linked. Null and empty texts
    have no shingles and link with nothing; null doc_ids get null component and
    class; repeated rows are copies of each other; other columns are ignored.
    """
    base, classes = _classes(docs, n)
    classes = materialize(classes, "jaccard-classes")
    links = _grouped(docs, classes, n, num, den).groupBy(*GROUP).applyInArrow(_join_group(n, num, den, "links" if count else "classes"), LINKS)
    links = materialize(links, "jaccard-links")
    joined = components(links.select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    known = classes.select("set_hash", "rep", "copies").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    if count:
        known = known.join(links.groupBy("set_hash").agg(F.sum("links").alias("links")), "set_hash", "left")
    n_links = (F.coalesce("links", F.lit(0)) if count else F.lit(0)) + F.col("copies") - 1
    known = known.select("set_hash", "rep", F.coalesce("component", "rep").alias("component"), n_links.alias("n_links"))
    rows = base.select("doc_id", "n_shingles", "set_hash").join(known, "set_hash", "left")
    own = lambda c: F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce(c, "doc_id"))
    rows = rows.select("doc_id", "n_shingles", own("component").alias("component_id"), own("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows if count else rows.drop("n_links")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, less near duplicates: of each component the row
    of its least doc_id. Of several rows with that doc_id the one whose text hashes
    lowest stays; rows with a null doc_id stay as they are.

    Only doc_ids are shuffled, unless the lists of those that go, or repeat, are too
    long to be broadcast; texts that share a doc_id are compared apart.
    """
    doc, goes, place = unused(docs, "doc"), unused(docs, "goes"), unused(docs, "place")
    found = materialize(jaccard_components(docs, n, num, den).select("doc_id", "component_id"), "jaccard-found").where("doc_id is not null")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    listed = gone.withColumn(goes, F.lit(True)).unionByName(twice.withColumn(goes, F.lit(False))).withColumnRenamed("doc_id", doc)
    listed = materialize(listed, "jaccard-gone")
    size, repeats = listed.count(), listed.where(~F.col(goes)).count()
    same = docs["doc_id"].cast("long") == listed[doc]
    kept = docs.join(small_side(listed, size, 40), same, "left_anti")
    if not repeats:
        return kept
    again = docs.join(small_side(listed.where(~F.col(goes)), repeats, 40), same)
    first = Window.partitionBy(doc).orderBy(F.xxhash64("text"))
    return kept.unionByName(again.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns))


def jaccard_links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Pairs (doc_id < other) of linked class representatives; copies aren't expanded."""
    _, classes = _classes(docs, n)
    groups = _grouped(docs, materialize(classes, "jaccard-classes"), n, num, den)
    found = groups.groupBy(*GROUP).applyInArrow(_join_group(n, num, den, "pairs"), LINKS)
    return found.select(F.least("doc_id", "other").alias("doc_id"), F.greatest("doc_id", "other").alias("other"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (SELECT DISTINCT rid, doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS s
      FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT na.doc_id AS x, nb.doc_id AS y FROM c JOIN n na ON c.x = na.rid JOIN n nb ON c.y = nb.rid
      WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT doc_id, doc_id FROM d),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid)
"""
