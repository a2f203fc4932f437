"""Operator 10: n-gram Jaccard join by adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles, hashed to 64 bits; with
fewer words, its whole sequence is one shingle.  Two documents link when
``100 * |A & B| >= 75 * |A | B|``.  The answer is the connected components of
the links.

*Sets, not documents, are joined.*  Documents with equal sets share a 128-bit
fingerprint and are one node from the first shuffle on, so that copies are never
expanded.  A node is named by 64 bits of it; sets that share those and differ in
the others are found, and all but one renamed, before anything is joined.

*Prefixes.*  Two sets that link share at least ``need = ceil(0.75 * size)``
shingles of either, so in any fixed order of shingles (their hashes) they share
at least ``l`` of the first ``size - need + l``.  Every node sends the longest
prefix that it may choose, packed into binary chunks by shingle bucket; buckets
return how many nodes have each shingle.  A node then chooses its own ``l``: the
longer the prefix, the more of its most frequent shingles may be left out of the
probe (a partner shares ``l`` of them, so at least one outside any ``l - 1``),
and the more shared shingles a partner needs.  The ``l`` with the least estimated
candidates wins.  A node whose prefix holds fewer than ``l`` shared shingles has
no partner and is done; in most corpora that is nearly every node.

*Candidates.*  In a list of nodes that share a probed shingle, those of like size
join the group of the list's hub, so that a pair that shares a probed shingle
meets in a group and groups are few.  No pairs are formed in the shuffle.  In groups
beyond ``BLOCK`` nodes or ``ELEMENTS`` shingles, members are first compared with the hub; those that link
with it need not meet one another, the others meet all, block by block.  In a task, pairs with too few shared prefix shingles are dropped, the others are
verified on whole sets, and a spanning forest of the links leaves it.

*Hot shingles.*  A shingle that very many sets have (``HOT``, found in a sample of one
text in ``SAMPLE``, which steers the work and not the result) is split by node over
several buckets.  How many nodes have it is then the sample's estimate, and its hub, which
all its buckets must agree on, is chosen in a step of its own.

*Components* by alternating large-star and small-star steps, each written to
the shared folder.

Defined results: null and empty texts have no shingles and are their own
component; a null id gets the component null and links with nothing; repeated
rows and ids get one row each, with the component of their text; extra columns
are ignored; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, tasks, tidy, written

WORDS = 5
PERCENT = 75
#: Entries that a bucket's task sorts at once, about; nodes in a block of a large group, and shingles in it.
ENTRIES, BLOCK, ELEMENTS = 1_500_000, 512, 1 << 23
#: Nodes with a shingle from which on it is split, and the share of texts that are looked at to find such shingles; they are at most MOST_HOT or so.
HOT, SAMPLE, MOST_HOT = 400_000, 64, 100_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPREAD = np.uint64(0xE7037ED1A0B428DB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return _mix((h * _MULTIPLIERS[:n]).sum(keepdims=True) + np.uint64(n))
    m = n - WORDS + 1
    total = h[:m] * _MULTIPLIERS[0]
    for j in range(1, WORDS):
        total += h[j : j + m] * _MULTIPLIERS[j]
    return np.unique(_mix(total))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two halves of 64 bits."""
    digest = xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s))
    return (digest & (1 << 64) - 1) - (1 << 63), (digest >> 64) - (1 << 63)


def renamed(fp: int, rest: int) -> int:
    """Another name for a set whose name a different set has."""
    return xxhash.xxh3_64_intdigest(f"{fp}|{rest}".encode()) - (1 << 63)


def need(n):
    """Shingles that a set of ``n`` shares with every partner, at least."""
    return -(-n * PERCENT // 100)


def longest(n):
    """The largest ``l`` whose prefix a node sends.

    A quarter of a small set and an eighth of a large one: a passage that many documents
    share is then fewer than ``l`` shingles of the prefix and may be left out of the probe.
    """
    return 1 + np.minimum(np.maximum(np.minimum(n // 4, 32), n // 8), 250)


def allowed(n):
    """The largest ``l`` that a node may choose: its smallest partner has sent that much."""
    return longest(need(n))


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket; each column's values as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    arrays = [pa.array(bucket[starts].astype(np.int32))]
    for c in columns:
        body = np.ascontiguousarray(c[order])
        ends = np.r_[starts, len(body)].astype(np.int64) * body.itemsize
        raw = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(body)])
        arrays.append(raw.cast(pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *(f"c{k}" for k in range(len(columns)))])


def _unpacked(batches: Iterator[pa.RecordBatch], types: list) -> list[np.ndarray]:
    """The packed columns of all rows of a task."""
    parts: list[list[bytes]] = [[] for _ in types]
    for batch in batches:
        for part, column in zip(parts, batch.columns[1:], strict=True):
            part.extend(x for x in column.to_pylist())
    return [np.frombuffer(b"".join(p), t) for p, t in zip(parts, types, strict=True)]


def _packed_schema(columns: int) -> str:
    return "bucket int, " + ", ".join(f"c{k} binary" for k in range(columns))


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (((values.view(np.uint64) * _SPREAD) >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


class Hot:
    """Shingles that many nodes have, with the estimated number of those."""

    def __init__(self, tok: np.ndarray, df: np.ndarray):
        order = np.argsort(tok)
        self.tok, self.df = tok[order], df[order]
        self.slots = np.maximum(1, -(-self.df // max(1, HOT // 4))).astype(np.int64)

    def find(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles are hot, and the places of those."""
        if not len(self.tok):
            return np.zeros(len(tok), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.tok, tok), len(self.tok) - 1)
        hot = self.tok[at] == tok
        return hot, at[hot]

    def bucket(self, tok: np.ndarray, fp: np.ndarray, buckets: int) -> np.ndarray:
        """A shingle's bucket; a hot one has several, of which the node picks one."""
        hot, at = self.find(tok)
        key = tok
        if hot.any():
            slot = _mix(fp[hot].view(np.uint64).copy()) % self.slots[at].astype(np.uint64)
            key = tok.copy()
            key[hot] = _mix(tok[hot] + slot * _MULTIPLIERS[0])
        return _bucket(key, buckets)


def _hot(docs: DataFrame, total: int) -> Hot:
    """From one text in ``SAMPLE``: shingles that far more nodes have than a task should sort."""
    cut = max(HOT, total // MOST_HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, fps = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text in batch.column(0).to_pylist():
                s = prefix(shingles(text))
                toks.append(s)
                fps.append(np.full(len(s), fingerprint(s)[0], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(fps))], ["tok", "fp"])

    some = docs.where(F.pmod(F.xxhash64("text", F.lit(10)), F.lit(SAMPLE)) == 0).where("doc_id is not null").select("text")
    counts = some.mapInArrow(tidy(run), "tok bigint, fp bigint").groupBy("tok").agg((F.approx_count_distinct("fp") * SAMPLE).alias("df"))
    rows = counts.where(F.col("df") >= cut).collect()  # about MOST_HOT at most, as all entries are shared out among them
    return Hot(np.array([r.tok for r in rows], np.int64).view(np.uint64), np.array([r.df for r in rows], np.int64))


def prefix(s: np.ndarray) -> np.ndarray:
    """The longest prefix of a set that its node sends."""
    n = len(s)
    return s[: min(n, n - need(n) + int(longest(n)))] if n else s


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp and rest (the fingerprint's halves), key of every document; the key is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, rest = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                a, b = fingerprint(s)
                n.append(len(s))
                fp.append(a)
                rest.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(rest, pa.int64()), batch.column(2)], ["doc_id", "n", "fp", "rest", "key"])

    return docs.withColumn("key", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id bigint, n bigint, fp bigint, rest bigint, key bigint")


def _names(sets: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """``sets`` with one name, fp, for each different set, and the sets that got another name than theirs.

    Those are rare: among 10^10 sets some three pairs share 64 bits.
    """
    twice = sets.where("n > 0").groupBy("fp").agg(F.min("rest").alias("least"), F.max("rest").alias("most")).where("least <> most").select("fp", "least")
    others = sets.where("n > 0").join(twice, "fp").where("rest <> least").select("fp", "rest").distinct().collect()
    if not others:
        return sets, {}
    names = {(r.fp, r.rest): renamed(r.fp, r.rest) for r in others}
    fresh = sets.sparkSession.createDataFrame([(*k, v) for k, v in names.items()], "fp bigint, rest bigint, other bigint")
    joined = sets.join(F.broadcast(fresh), ["fp", "rest"], "left").withColumn("fp", F.coalesce("other", "fp")).select(sets.columns)
    return joined, names


def _members(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """fp, n, s of the nodes: whole sets, hashed, and their sizes, from one of their rows each; what repeats an id and a text goes as early as may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for fp in batch.column(0).to_pylist():
                fresh.append(fp not in seen)
                if len(seen) < ENTRIES:
                    seen.add(fp)
            left = batch.filter(pa.array(fresh, pa.bool_()))
            sets = [shingles(t).tobytes() for t in left.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([left.column(0), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["fp", "n", "s"])

    keyed = docs.withColumn("key", F.xxhash64("text"))
    return keyed.join(nodes.select("fp", F.col("row.doc_id").alias("doc_id"), F.col("row.key").alias("key")), ["doc_id", "key"]).select("fp", "text").mapInArrow(tidy(run), "fp bigint, n bigint, s binary")


def _prefix_entries(docs: DataFrame, buckets: int, hot: Hot, names: dict[tuple[int, int], int]) -> DataFrame:
    """Packed (shingle, node, level) of the longest prefixes; level: the least ``l`` whose prefix holds the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            tok, fp, lvl = (np.concatenate(c) for c in zip(*held, strict=True))
            return _packed(hot.bucket(tok, fp, buckets), [tok, fp, lvl])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text)
                n = len(s)
                if not n or doc_id is None:
                    continue
                both = fingerprint(s)
                fp = names.get(both, both[0])
                if fp in seen:
                    continue
                if len(seen) < ENTRIES:
                    seen.add(fp)
                first = prefix(s)
                m = len(first)
                held.append((first, np.full(m, fp, np.int64), np.maximum(1, np.arange(1, m + 1) - (n - need(n))).astype(np.uint8)))
                size += m
                if size >= ENTRIES // 4:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(tidy(run), _packed_schema(3))


def _shared(entries: DataFrame, buckets: int, partitions: int, hot: Hot) -> DataFrame:
    """Packed by node: (node, shingle, level, nodes that have the shingle) where two or more have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, fp, lvl = _unpacked(batches, [np.uint64, np.int64, np.uint8])
        order = np.lexsort((fp, tok))
        tok, fp, lvl = tok[order], fp[order], lvl[order]
        if len(tok):
            first = np.r_[True, (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1])]
            tok, fp, lvl = tok[first], fp[first], lvl[first]
            new = np.r_[True, tok[1:] != tok[:-1]]
            at = np.cumsum(new) - 1
            df = np.bincount(at)[at]
            everywhere, places = hot.find(tok)
            df[everywhere] = hot.df[places]  # this task has a part of them
            keep = df > 1
            tok, fp, lvl, df = tok[keep], fp[keep], lvl[keep], df[keep].astype(np.uint32)
            for i in range(0, len(tok), ENTRIES):
                j = i + ENTRIES
                yield _packed(_bucket(fp[i:j], buckets), [fp[i:j], tok[i:j], lvl[i:j], df[i:j]])

    return entries.repartition(partitions, "bucket").mapInArrow(tidy(run), _packed_schema(4))


def _sizes_packed(nodes: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n = (c.to_numpy() for c in batch.columns)
            empty = np.zeros(len(fp), np.uint8)
            # level 0 marks a node's size
            yield _packed(_bucket(fp, buckets), [fp, n.astype(np.uint64), empty, empty.astype(np.uint32)])

    return nodes.select("fp", "n").mapInArrow(tidy(run), _packed_schema(4))


def choose(levels: np.ndarray, df: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """A node's ``l`` and which of its shared prefix shingles it probes with.

    The estimate is the number of list entries that the probe would read.
    """
    best, most = None, int(allowed(n))
    options = sorted({1, *(1 << k for k in range(most.bit_length()) if 1 << k <= most), most})
    for l in options:  # noqa: E741
        inside = np.flatnonzero(levels <= l)
        if len(inside) < l:
            return l, np.empty(0, np.int64)
        probe = inside[np.argsort(df[inside], kind="stable")[: len(inside) - (l - 1)]]
        cost = int((df[probe].astype(np.int64) - 1).sum())
        if best is None or cost < best[0]:
            best = (cost, l, probe)
    return best[1], best[2]


def _probes(shared: DataFrame, buckets: int, partitions: int, hot: Hot) -> DataFrame:
    """Packed by shingle: (shingle, node, size, l, level or 0 if it is probed, rank as a hub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, tok, lvl, df = _unpacked(batches, [np.int64, np.uint64, np.uint8, np.uint32])
        order = np.lexsort((tok, lvl, fp))  # a node's size comes first
        fp, tok, lvl, df = fp[order], tok[order], lvl[order], df[order]
        starts = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else []
        held, size = [], 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return _packed(hot.bucket(columns[0], columns[1], buckets), columns)

        for a, b in zip(starts, [*starts[1:], len(fp)], strict=False):  # a task may have no rows
            n, a = int(tok[a]), a + int(np.searchsorted(lvl[a:b], 1))  # behind the size, which several tasks may send
            if a == b:
                continue
            l, probe = choose(lvl[a:b], df[a:b], n)  # noqa: E741
            if not len(probe):
                continue
            m = b - a
            role = lvl[a:b].copy()
            role[probe] = 0
            sent = min(n, n - need(n) + int(longest(n)))
            rank = np.uint32(sent - m) * np.uint32(1 << 12) // np.uint32(sent)  # those that share all come first
            held.append((tok[a:b], fp[a:b], np.full(m, n, np.uint32), np.full(m, l, np.uint8), role, np.full(m, rank, np.uint32)))
            size += m
            if size >= ENTRIES // 4:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return shared.repartition(partitions, "bucket").mapInArrow(tidy(run), _packed_schema(6))


PROBE = [np.uint64, np.int64, np.uint32, np.uint8, np.uint8, np.uint32]


def _parts(n: np.ndarray) -> np.ndarray:
    """Two parts of a list for each node: sizes in a part differ by less than two factors of 4/3, and partners share the part of the smaller one."""
    size_class = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)
    return np.concatenate([size_class, size_class - 1])


def _hot_hubs(probes: DataFrame, hot: Hot) -> dict[tuple[int, int], tuple[int, int]]:
    """(shingle, part) of hot shingles: the largest l that probes there, and the hub, the first node that does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tok, fp, n, l, role, rank = _unpacked(iter([batch.slice(at, 1)]), PROBE)  # noqa: E741
                some = hot.find(tok)[0] & (role == 0)
                if not some.any():
                    continue
                both = lambda x: np.concatenate([x[some], x[some]])  # noqa: B023, E731
                tok, fp, l, rank, part = both(tok), both(fp), both(l), both(rank), _parts(n[some])  # noqa: E741
                order = np.lexsort((fp, rank, part, tok))
                tok, fp, l, rank, part = tok[order], fp[order], l[order], rank[order], part[order]  # noqa: E741
                starts = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (part[1:] != part[:-1])])
                columns = [tok[starts].view(np.int64), part[starts], np.maximum.reduceat(l, starts).astype(np.int32), rank[starts].astype(np.int64), fp[starts]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tok", "part", "reach", "rank", "fp"])

    found = probes.mapInArrow(tidy(run), "tok bigint, part bigint, reach int, rank bigint, fp bigint")
    rows = found.groupBy("tok", "part").agg(F.max("reach").alias("reach"), F.min(F.struct("rank", "fp")).alias("hub")).collect()  # some size classes of each hot shingle
    return {(r.tok, r.part): (r.reach, r.hub.fp) for r in rows}


def _memberships(probes: DataFrame, buckets: int, partitions: int, hot: Hot, hubs: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """Packed by node: (hub, node, l) of each list that holds a probed shingle; a hub is in its own group."""
    keys = sorted(hubs)
    known = np.rec.fromarrays([np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)], names="tok,part") if keys else None
    reach_of, hub_of = (np.array([hubs[k][j] for k in keys], np.int64) for j in (0, 1))

    def agreed(tok, fp, l, role, part):  # noqa: E741
        """Hub, node and l of the entries of hot shingles, whose other entries are in other tasks."""
        if known is None or not len(tok):
            return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)]
        mine = np.rec.fromarrays([tok.view(np.int64), part], names="tok,part")
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        stay = (known[at] == mine) & (role <= reach_of[at])
        return [hub_of[at[stay]], fp[stay], l[stay]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, fp, n, l, role, rank = _unpacked(batches, PROBE)  # noqa: E741
        both = lambda x: np.concatenate([x, x])
        part = _parts(n)
        tok, fp, l, role, rank = both(tok), both(fp), both(l), both(role), both(rank)  # noqa: E741
        everywhere = hot.find(tok)[0]
        shared_out = agreed(tok[everywhere], fp[everywhere], l[everywhere], role[everywhere], part[everywhere])
        rows = [np.concatenate(x) for x in zip(shared_out, own(*(x[~everywhere] for x in (tok, fp, l, role, rank, part))), strict=True)]
        rows = np.unique(np.rec.fromarrays(rows, names="hub,fp,l"))
        hub, fp, l = (np.ascontiguousarray(rows[f]) for f in rows.dtype.names)  # noqa: E741
        for i in range(0, len(rows), ENTRIES):
            j = i + ENTRIES
            yield _packed(_bucket(fp[i:j], buckets), [hub[i:j], fp[i:j], l[i:j]])

    def own(tok, fp, l, role, rank, part):  # noqa: E741
        """The same of lists that this task has whole."""
        none = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)]
        order = np.lexsort((fp, rank, part, tok))
        tok, fp, l, role, part = tok[order], fp[order], l[order], role[order], part[order]  # noqa: E741
        if not len(tok):
            return none
        new = np.r_[True, (tok[1:] != tok[:-1]) | (part[1:] != part[:-1])]
        at = np.cumsum(new) - 1
        reach = np.zeros(at[-1] + 1, np.int64)  # the largest l that probes here
        np.maximum.at(reach, at, np.where(role == 0, l, 0).astype(np.int64))
        stay = role <= reach[at]
        fp, l, at = fp[stay], l[stay], at[stay]  # noqa: E741
        probed = reach[at] > 0
        fp, l, at = fp[probed], l[probed], at[probed]  # noqa: E741
        if not len(fp):
            return none
        count = np.bincount(at)
        several = count[at] > 1
        fp, l, at = fp[several], l[several], at[several]  # noqa: E741
        if not len(fp):
            return none
        first = np.r_[True, at[1:] != at[:-1]]
        return [fp[first][np.cumsum(first) - 1], fp, l]

    return probes.repartition(partitions, "bucket").mapInArrow(tidy(run), _packed_schema(3))


def _groups(memberships: DataFrame, partitions: int) -> DataFrame:
    """hub, fp, l: the nodes that are to be compared with one another.

    Nodes that are alike share many lists, most of one hub, so their rows are made
    distinct here, before there is a row for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, fp, l = _unpacked(batches, [np.int64, np.int64, np.uint8])  # noqa: E741
        rows = np.unique(np.rec.fromarrays([hub, fp, l.astype(np.int32)]))
        for i in range(0, len(rows), 50_000):
            r = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[f])) for f in r.dtype.names], ["hub", "fp", "l"])

    return memberships.repartition(partitions, "bucket").mapInArrow(tidy(run), "hub bigint, fp bigint, l int")


def overlaps(sets: list[np.ndarray], at_once: int = 1 << 20) -> np.ndarray:
    """Shared elements of every two of the sets, which are sorted; about ``at_once`` elements are held beside them."""
    m, total = len(sets), sum(map(len, sets))
    out = np.zeros((m, m), np.int32)
    passes = max(1, -(-total // at_once))
    starts = np.zeros(m, np.int64)
    if passes > 1:
        some = np.sort(np.concatenate([x[::passes] for x in sets]))
        edges = some[np.arange(1, passes) * len(some) // passes]
    for k in range(passes):
        ends = np.array([len(x) if k == passes - 1 else np.searchsorted(x, edges[k]) for x in sets], np.int64)
        _count([x[a:b] for x, a, b in zip(sets, starts, ends, strict=True)], out)
        starts = ends
    return out


def _count(sets: list[np.ndarray], out: np.ndarray, wide: int = 24) -> None:
    """Add the shared elements of every two of the sets to the upper half of ``out``."""
    m = len(sets)
    own = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
    df = np.diff(np.r_[starts, len(flat)])
    for d in np.unique(df[(df > 1) & (df < wide)]):
        members = own[starts[df == d][:, None] + np.arange(d)]
        a, b = np.triu_indices(d, 1)
        each = max(1, 1_000_000 // len(a))
        for i in range(0, len(members), each):
            part = members[i : i + each].astype(np.int64)
            pairs, n = np.unique(part[:, a] * m + part[:, b], return_counts=True)
            out.ravel()[pairs] += n.astype(np.int32)
    heavy = np.flatnonzero(df >= wide)
    for i in range(0, len(heavy), 1024):
        some = heavy[i : i + 1024]
        x = np.zeros((m, len(some)), np.float32)
        for k, s in enumerate(some):
            x[own[starts[s] : starts[s] + df[s]], k] = 1
        for r in range(0, m, 128):
            out[r : r + 128, r:] += np.triu(x[r : r + 128] @ x[r:].T, 1).astype(np.int32)


def links(sets: list[np.ndarray], ls: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: (root, member).

    Pairs that share fewer prefix shingles than both their ``l`` ask for are not verified.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    cut = sizes - need(sizes) + ls
    in_prefix = overlaps([s[:c] for s, c in zip(sets, cut, strict=True)])
    a, b = np.nonzero(in_prefix)
    alike = np.minimum(sizes[a], sizes[b]) * 100 >= PERCENT * np.maximum(sizes[a], sizes[b])
    a, b = a[alike], b[alike]
    enough = in_prefix[a, b] >= np.minimum(ls[a], ls[b])
    a, b = a[enough], b[enough]
    if len(a) > 4 * m:
        shared = overlaps(sets)[a, b]
    else:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    linked = 100 * shared >= PERCENT * (sizes[a] + sizes[b] - shared)
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [(r, i) for i in range(m) if (r := root(i)) != i]


def _verified(members: DataFrame) -> DataFrame:
    """Links as edges a, b from (hub, i, j, fp, l, s) rows, group by group."""

    def edges(group: dict[int, tuple[np.ndarray, int]]) -> pa.RecordBatch | None:
        fps = sorted(group)
        found = links([group[f][0] for f in fps], np.array([group[f][1] for f in fps], np.int64))
        if not found:
            return None
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([fps[x] for x in c], pa.int64()) for c in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}
        for batch in batches:
            for hub, i, j, fp, l, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: E741
                if (hub, i, j) != now:
                    if len(group) > 1 and (out := edges(group)):
                        yield out
                    now, group = (hub, i, j), {}
                if fp not in group:
                    group[fp] = (np.frombuffer(s, np.uint64), l)
        if len(group) > 1 and (out := edges(group)):
            yield out

    return members.mapInArrow(tidy(run), "a bigint, b bigint")


def _stars(members: DataFrame, whole: DataFrame) -> DataFrame:
    """hub, fp, l, n, linked: which members of large groups link with their hub."""
    hubs = members.select("hub").distinct().join(whole, F.col("hub") == F.col("fp")).select("hub", F.col("s").alias("hub_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            linked = []
            for hub, fp, s, hub_s in zip(*(batch.column(c).to_pylist() for c in ("hub", "fp", "s", "hub_s")), strict=True):
                if hub != now:
                    now, own = hub, np.frombuffer(hub_s, np.uint64)
                s = np.frombuffer(s, np.uint64)
                shared = len(np.intersect1d(own, s, assume_unique=True))
                linked.append(100 * shared >= PERCENT * (len(own) + len(s) - shared))
            same = ["hub", "fp", "l", "n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(linked, pa.bool_())], [*same, "linked"])

    return members.join(whole, "fp").join(hubs, "hub").mapInArrow(tidy(run), "hub bigint, fp bigint, l int, n bigint, linked boolean")


def _blocks(stars: DataFrame) -> DataFrame:
    """hub, i, j, fp, l: large groups as pairs of blocks.

    Members that link with the hub are in one component and need not meet one
    another; those that do not link with it meet all blocks.  Task (i, j) holds block
    i of the former and j of the latter; with i below 0, blocks -1 - i and j of the
    latter.
    """
    total = lambda which, of: F.sum(F.when(which, of).otherwise(0))
    count = lambda which: F.ceil(F.greatest(total(which, 1) / BLOCK, total(which, F.col("n")) / ELEMENTS)).cast("int")
    sizes = stars.groupBy("hub").agg(count(F.col("linked")).alias("near"), count(~F.col("linked")).alias("far"))
    each = stars.join(sizes.where("far > 0"), "hub")
    place = lambda blocks: F.pmod(F.xxhash64("fp"), F.col(blocks)).cast("int")
    range_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    names = ["hub", "i", "j", "fp", "l"]
    near = each.where("linked").withColumn("i", place("near")).withColumn("j", range_of("far"))
    far = each.where("not linked").withColumn("c", place("far"))
    with_near = far.where("near > 0").withColumn("i", range_of("near")).withColumn("j", F.col("c"))
    with_far = far.withColumn("k", range_of("far")).withColumn("i", -1 - F.least("c", "k")).withColumn("j", F.greatest("c", "k"))
    return near.select(names).unionByName(with_near.select(names)).unionByName(with_far.select(names))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: the least node of each component, by alternating large-star and small-star steps."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        either = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = either.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = either.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(now.join(least, "u").select("u", F.col("low").alias("v")))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        after = written(small.where("u <> v").distinct(), name)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if seen == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._vectrail_path = now._vectrail_path
            return out
        mark = seen


def jaccard_components(docs: DataFrame, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    As one id may stand for several texts, ids alone do not name rows, and components may
    share their least id. ``keys`` adds text_key, the xxhash64 of the text's bytes, and first:
    whether the row has the least (doc_id, text_key) of its component; a row without an id
    or a shingle is the first of its own.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bound_batches(spark)
    sets, names = _names(written(_sets(docs), "jaccard-sets"))
    some = sets.where("n > 0 and doc_id is not null")
    nodes = some.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("row"), F.max("n").alias("n")).withColumn("least", F.col("row.doc_id"))
    total = some.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 + F.floor(F.col("n") / 4))).first()[0] or 0
    partitions = max(tasks(spark), -(-int(total) // ENTRIES))
    buckets = 4 * partitions

    hot = _hot(docs, int(total)) if total > HOT else Hot(np.empty(0, np.uint64), np.empty(0, np.int64))
    shared = _shared(_prefix_entries(docs, buckets, hot, names), buckets, partitions, hot)
    shared = shared.unionByName(_sizes_packed(nodes, buckets))
    probes, hubs = _probes(shared, buckets, partitions, hot), {}
    if len(hot.tok):
        probes = written(probes, "jaccard-probes")
        hubs = _hot_hubs(probes, hot)
    groups = written(_groups(_memberships(probes, buckets, partitions, hot, hubs), partitions), "jaccard-groups")

    whole = written(_members(docs, nodes.join(groups.select("fp").distinct(), "fp")), "jaccard-members")
    each = groups.join(whole.select("fp", "n").dropDuplicates(["fp"]), "fp").groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("elements"))
    large = (F.col("m") > BLOCK) | (F.col("elements") > ELEMENTS)
    sized = groups.join(each, "hub")
    small = sized.where(~large).select("hub", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "l")
    crowds = written(sized.where(large).select("hub", "fp", "l"), "jaccard-crowds")  # few as a rule: a table whose size is known need not make the sets move
    stars = written(_stars(crowds, whole), "jaccard-stars")
    members = small.unionByName(_blocks(stars)).join(whole, "fp").select("hub", "i", "j", "fp", "l", "s")
    dealt = members.repartition(partitions, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    near_hub = stars.where("linked and hub <> fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    roots = components(_verified(dealt).unionByName(near_hub))

    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "row" if keys else "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("row").alias("low") if keys else F.min("least").alias("component"))
    by_fp = rooted.join(lowest, "root").select("fp", *(["low", F.col("low.doc_id").alias("component")] if keys else ["component"]))
    out = sets.where("doc_id is not null").join(by_fp, "fp", "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    more = [F.col("key").alias("text_key")] if keys else []
    first = [((F.col("n") == 0) | (F.struct("doc_id", "key") == F.col("low"))).alias("first")] if keys else []
    rows = out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), *more, *first)
    first = [F.lit(True).alias("first")] if keys else []
    none = sets.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), *more, *first)
    found = written(rows.unionByName(none), "jaccard-components")
    discard(sets, probes, groups, whole, crowds, stars, roots)
    return found
