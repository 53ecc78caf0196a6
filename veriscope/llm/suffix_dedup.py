"""Repeated passages by enhanced suffix arrays, cut out of later documents.

A passage of ``passage`` bytes (a window) belongs to the bucket of the least hash among its
short grams: equal windows are in the same bucket, wherever they stand.  Neighbouring windows
of one bucket form a fragment.  Buckets are counted first; only those that two documents have
are looked at, as a table of bits of bounded size says (it may let others pass, which costs a
shuffled fragment and changes nothing).  Buckets are dealt to groups of bounded size.  A task
sends a fragment that it meets again once only, with the smallest doc_id; the others are known
to be repeats at once.  A bucket of very many fragments sends each window on its own, to the
group of the window's content.

In a group, suffixes begin at every window.  Those whose window occurs in one document only
are left out by their hash; the others are ordered byte by byte, with the lengths of common
prefixes between neighbours.  A scan with a stack finds the intervals of the array in which
all suffixes share a prefix; an interval whose suffixes are preceded by different bytes (or
begin a fragment) is a maximal repeat, and all its occurrences are reported with the smallest
doc_id among them.  A class of windows that are all preceded by the same byte holds no such
interval: it lies inside the repeats that begin a byte earlier.

Exact copies are settled first, by the digests of whole texts.

Cases: a null or empty text has no passages; a null doc_id counts as larger than any other;
rows with the same doc_id are one document: repeats inside it stay, its rows are cut alike;
texts of any length are looked at whole, in overlapping slices; further columns stay, those
named like the results are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.row_keys import keyed, marked
from veriscope.llm.texts import has_columns
from veriscope.shared import settle

PASSAGE = 50
GRAM = 16  # bytes of a gram
SLICE_BYTES = 1 << 20  # looked at in one go
HELD_BYTES = 6 << 20  # fragments that a task compares with each other
GROUP_BYTES = 2 << 20  # fragments that a group is made for
FRAGMENT_BYTES = 70  # of a fragment, on average
CROWDED = 6_000  # a bucket of more fragments is sent by windows
MOST_CROWDED = 1 << 20  # buckets that the driver may hold by number
COUNTED = 1 << 18  # buckets that a task counts before it passes them on
PART_BYTES = 64 << 20  # bytes of text for every part that merges counts
MOST_TABLE_BITS = 28  # of the table of shared buckets, as a power of two
LONGEST_RUN = 1024  # windows of a fragment
UNNAMED = np.iinfo(np.int64).max  # stands for a null doc_id
RESULTS = ("n_bytes", "spans", "kept")
FACTOR = 0x9E3779B97F4A7C15
BYTE_HASHES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from every place on, by doubling."""
    n = len(data)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    piece, size, found, done = BYTE_HASHES[data], 1, None, 0
    while True:
        power = np.uint64(pow(FACTOR, size, 1 << 64))
        if width & size:
            if found is None:
                found, done = piece, size
            else:
                m = n - done - size + 1
                found = found[:m] * power + piece[done:done + m]
                done += size
        if done == width:
            return found
        m = n - 2 * size + 1
        piece = piece[:m] * power + piece[size:size + m]
        size *= 2


def hashes_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``window_hashes`` of some places only."""
    powers = np.array([pow(FACTOR, width - 1 - i, 1 << 64) for i in range(width)], dtype=np.uint64)
    found = np.zeros(len(at), dtype=np.uint64)
    for i in range(width):
        found += BYTE_HASHES[data[at + i]] * powers[i]
    return found


def gram_values(data: np.ndarray, gram: int) -> np.ndarray:
    mixed = window_hashes(data, gram)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(FACTOR)
    return mixed ^ (mixed >> np.uint64(29))


def spread(values: np.ndarray) -> np.ndarray:
    """Least values are small ones: the same values, another number each."""
    mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(30))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def cut_fragments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: first window, end of the windows and bucket of each fragment."""
    gram = min(GRAM, passage)
    if len(data) < passage:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    least = sliding_minimum(gram_values(data, gram), passage - gram + 1)
    long = ends - starts >= passage
    first, beyond = starts[long], ends[long] - passage + 1
    steps = np.zeros(len(least) + 1, dtype=np.int8)
    steps[first] += 1
    steps[beyond] -= 1
    inside = np.cumsum(steps, dtype=np.int8)[:-1].astype(bool)
    new = np.zeros(len(least) + 1, dtype=bool)
    new[1:-1] = least[1:] != least[:-1]
    new[first] = True
    closes = new[1:].copy()
    closes[beyond - 1] = True
    at, until = np.flatnonzero(new[:-1] & inside), np.flatnonzero(closes & inside) + 1
    value, length = least[at], until - at
    if len(at) and length.max() > LONGEST_RUN:
        parts = -(-length // LONGEST_RUN)
        no = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(at, parts) + no * LONGEST_RUN
        until, value = np.minimum(at + LONGEST_RUN, np.repeat(until, parts)), np.repeat(value, parts)
    return at, until, spread(value)


def slices(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[tuple[bytes, np.ndarray, list]]:
    """Texts (row, doc_id, text) laid end to end, some megabytes at a time: the bytes, where
    each piece begins (and the end), and (row, doc_id, place in its text) of each piece."""
    parts, places, names, size = [], [0], [], 0
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            whole = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            at = 0
            while len(whole) - at >= passage:
                part = whole[at:at + SLICE_BYTES]
                parts.append(bytes(part))
                names.append((row, UNNAMED if doc is None else doc, at))
                size += len(part)
                places.append(size)
                # windows that begin in the next slice
                at += len(part) - passage + 1
                if size >= SLICE_BYTES:
                    yield b"".join(parts), np.array(places, dtype=np.int64), names
                    parts, places, names, size = [], [0], [], 0
    if parts:
        yield b"".join(parts), np.array(places, dtype=np.int64), names


class Buckets:
    """Which buckets two documents may have, how they are dealt to groups, and which are sent by windows."""

    def __init__(self, table: np.ndarray, table_bits: int, groups: int, crowded: np.ndarray):
        self.table, self.shift = table, np.uint64(64 - table_bits)
        self.groups, self.crowded = groups, np.sort(crowded)

    def shared(self, bucket: np.ndarray) -> np.ndarray:
        slot = bucket >> self.shift
        return (self.table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def group(self, number: np.ndarray) -> np.ndarray:
        return ((number * np.uint64(FACTOR) >> np.uint64(32)) * np.uint64(self.groups) >> np.uint64(32)).astype(np.int64)

    def is_crowded(self, bucket: np.ndarray) -> np.ndarray:
        if not len(self.crowded):
            return np.zeros(len(bucket), dtype=bool)
        near = np.minimum(np.searchsorted(self.crowded, bucket), len(self.crowded) - 1)
        return self.crowded[near] == bucket


class Held:
    """Different fragments, each with its smallest doc_id and where it stands there; and the
    places of those that a smaller doc_id repeats."""

    def __init__(self):
        self.found: dict[bytes, list] = {}  # content: [doc_id, group, row, place, row, place, ...]
        self.repeats: list[tuple[int, int, int]] = []  # row, begin, end
        self.size = 0

    def add(self, content: bytes, doc: int, group: int, places: list[int]) -> None:
        known = self.found.get(content)
        if known is None:
            self.found[content] = [doc, group, *places]
            self.size += len(content)
        elif doc == known[0]:
            known += places
        else:
            later = places
            if doc < known[0]:
                later, self.found[content] = known[2:], [doc, group, *places]
            size = len(content)
            self.repeats += [(later[i], later[i + 1], later[i + 1] + size) for i in range(0, len(later), 2)]


def _packed(columns: list[np.ndarray], tail: bytes) -> bytes:
    head = np.array([len(c) for c in columns], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(c.tobytes() for c in columns) + tail)


def _unpacked(blob: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, columns = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        columns.append(np.frombuffer(data, kind, size, at))
        at += columns[-1].nbytes
    return columns, data[at:]


FRAGMENT_KINDS = ["<u4", "<i8", "<u4", "<i8", "<i8"]  # length, doc_id, holders; row, place of each holder
SPAN_KINDS = ["<i8", "<i8", "<i8"]


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Rows (row, begin, end) with touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 3)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    row, begin, end = spans.T
    # ends grow within a row: rows are told apart by their number in front
    no = np.cumsum(np.r_[0, row[1:] != row[:-1]])
    reach = np.maximum.accumulate(end + no * (int(end.max()) + 1)) - no * (int(end.max()) + 1)
    new = np.r_[True, (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return np.stack([row[at], begin[at], reach[np.r_[at[1:] - 1, len(row) - 1]]], axis=1)


def _flushed(held: Held) -> Iterator[tuple[int, bytes, bytes | None]]:
    """A row per group: its fragments, and on the first row the repeats that are known already."""
    by_group: dict[int, list] = {}
    for content, known in held.found.items():
        by_group.setdefault(known[1], []).append((content, known))
    repeats = merged_spans(np.array(held.repeats, dtype=np.int64).reshape(-1, 3))
    removed = _packed([np.ascontiguousarray(c, dtype="<i8") for c in repeats.T], b"") if len(repeats) else None
    for group, members in by_group.items():
        holders = [known[2:] for _, known in members]
        columns = [
            np.array([len(content) for content, _ in members], dtype="<u4"), np.array([known[0] for _, known in members], dtype="<i8"),
            np.array([len(h) // 2 for h in holders], dtype="<u4"),
            np.array([x for h in holders for x in h[::2]], dtype="<i8"), np.array([x for h in holders for x in h[1::2]], dtype="<i8"),
        ]
        yield group, _packed(columns, b"".join(content for content, _ in members)), removed
        removed = None


BUCKET_KINDS = ["<u8", "<i8", "<u1"]  # distance from the bucket before, fragments, documents (2: or more)


def _merged_buckets(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bucket, n, docs = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=np.int64)
    if not len(heads):
        return bucket, n, docs
    return bucket[heads], np.add.reduceat(n[order], heads), np.minimum(np.add.reduceat(docs[order].astype(np.int64), heads), 2).astype(np.uint8)


def shared_buckets(texts: DataFrame, parts: int, passage: int) -> DataFrame:
    """``bucket`` (as a signed number) and its number ``n`` of fragments, of all buckets that two documents have.

    Tasks send their buckets in order, as distances; each part merges its own.
    """
    def counted_slice(data, places, names):
        at, _, bucket = cut_fragments(np.frombuffer(data, np.uint8), places[:-1], places[1:], passage)
        if not len(at):
            return bucket, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        doc = np.array([name[1] for name in names], dtype=np.int64)[np.searchsorted(places, at, side="right") - 1]
        order = np.argsort(bucket, kind="stable")
        bucket, doc = bucket[order], doc[order]
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
        return bucket[heads], np.diff(np.r_[heads, len(bucket)]), 1 + several.astype(np.uint8)

    def part_of(bucket):
        return ((bucket >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def batch_of(bucket, n, docs):
        part = part_of(bucket)
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, dtype=np.int64)
        blobs = []
        for a, b in zip(heads, np.r_[heads[1:], len(part)]):
            steps = np.diff(bucket[a:b], prepend=np.uint64(0))
            # byte by byte in columns: the high bytes of small distances are all zero
            blobs.append(_packed([steps.view(np.uint8).reshape(-1, 8).T.ravel().view("<u8"), n[a:b], docs[a:b]], b""))
        return pa.RecordBatch.from_arrays([pa.array(part[heads], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "buckets"])

    def counted(batches):
        held = []
        for found in slices(batches, passage):
            held.append(counted_slice(*found))
            if sum(len(h[0]) for h in held) > COUNTED:
                yield batch_of(*_merged_buckets(held))
                held = []
        if held:
            yield batch_of(*_merged_buckets(held))

    def merged(group: pa.Table) -> pa.Table:
        found = []
        for blob in group.column("buckets"):
            (steps, n, docs), _ = _unpacked(blob.as_py(), BUCKET_KINDS)
            steps = np.ascontiguousarray(steps.view(np.uint8).reshape(8, -1).T).view("<u8").ravel()
            found.append((np.cumsum(steps, dtype=np.uint64), n, docs))
        bucket, n, docs = _merged_buckets(found)
        shared = docs > 1
        return pa.table({"bucket": pa.array(bucket[shared].view(np.int64)), "n": pa.array(n[shared])})

    return texts.mapInArrow(counted, "part long, buckets binary").groupBy("part").applyInArrow(merged, "bucket long, n long")


def bit_table(shared: DataFrame, bits: int) -> np.ndarray:
    """Of settled buckets, by their first ``bits`` bits; at most a number for every 64 bits comes to the driver."""
    slot = F.shiftrightunsigned("bucket", 64 - bits)
    found = shared.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def sent_fragments(texts: DataFrame, buckets: Buckets, passage: int) -> DataFrame:
    """``part`` (the group), ``fragments`` and ``removed`` (blobs) of all texts."""
    known = texts.sparkSession.sparkContext.broadcast(buckets)

    def batch_of(rows):
        part, fragments, removed = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(fragments, pa.binary()), pa.array(removed, pa.binary())], names=["part", "fragments", "removed"])

    def sent(batches):
        held, buckets = Held(), known.value
        for data, places, names in slices(batches, passage):
            array = np.frombuffer(data, np.uint8)
            at, until, bucket = cut_fragments(array, places[:-1], places[1:], passage)
            some = buckets.shared(bucket)
            at, until, bucket = at[some], until[some], bucket[some]
            apart, group = buckets.is_crowded(bucket), buckets.group(bucket)
            if apart.any():
                length = np.where(apart, until - at, 1)
                no = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                alone = np.repeat(apart, length)
                at = np.repeat(at, length) + no
                until = np.where(alone, at + 1, np.repeat(until, length))
                group = np.repeat(group, length)
                group[alone] = buckets.group(spread(hashes_at(array, at[alone], passage)))
            piece = np.searchsorted(places, at, side="right") - 1
            offset = (at - places[piece]).tolist()
            for a, b, g, p, o in zip(at.tolist(), (until + passage - 1).tolist(), group.tolist(), piece.tolist(), offset):
                row, doc, place = names[p]
                held.add(data[a:b], doc, g, [row, place + o])
            if held.size >= HELD_BYTES or len(held.repeats) > HELD_BYTES // 32:
                yield from (batch_of([r]) for r in _flushed(held))
                held = Held()
        yield from (batch_of([r]) for r in _flushed(held))

    return texts.mapInArrow(sent, "part long, fragments binary, removed binary")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


DIVERSE = 256  # stands for a fragment's beginning, and for different bytes


class Shared:
    """What the suffixes of an interval have in common: the byte before them, their least and
    largest doc_id; and those of them that no inner interval has taken."""

    __slots__ = ("before", "least", "most", "open")

    def __init__(self, before: int, doc: int, no: int):
        self.before, self.least, self.most, self.open = before, doc, doc, [no]

    def add(self, other: Shared) -> None:
        if self.before != other.before:
            self.before = DIVERSE
        if other.least < self.least:
            self.least = other.least
        if other.most > self.most:
            self.most = other.most
        if len(other.open) > len(self.open):
            self.open, other.open = other.open, self.open
        self.open += other.open


def prefix_intervals(suffixes: list[bytes], least: int, leaves: list[Shared]) -> Iterator[tuple[int, int, int, Shared]]:
    """Of ordered suffixes: length of the common prefix, first and last of every interval that
    shares ``least`` bytes or more, and what it has in common; inner ones first.

    ``leaves`` are of the single suffixes; they are added up along the stack.
    """
    stack, n = [], len(suffixes)
    for i in range(1, n + 1):
        begin, whole, common = i - 1, leaves[i - 1], common_prefix(suffixes[i - 1], suffixes[i]) if i < n else 0
        while stack and stack[-1][0] > common:
            length, begin, node = stack.pop()
            node.add(whole)
            yield length, begin, i - 1, node
            whole = node
        if common >= least:
            if stack and stack[-1][0] == common:
                stack[-1][2].add(whole)
            else:
                stack.append((common, begin, whole))


class SuffixArray:
    """The suffixes of different fragments that begin with a window two documents have, in
    order by class (windows with equal bytes).

    Classes that are all preceded by the same byte are left out: they hold no maximal repeat.
    """

    def __init__(self, contents: list[bytes], docs: np.ndarray, passage: int):
        self.data, self.passage = b"".join(contents), passage
        array = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
        self.ends = np.cumsum(lengths)
        windows = lengths - passage + 1
        owner = np.repeat(np.arange(len(contents), dtype=np.int32), windows)
        begins = self.ends - lengths
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows - begins, windows)
        hashed = window_hashes(array, passage)[at]
        order = np.argsort(hashed)
        hashed = hashed[order]
        equal = np.r_[False, hashed[1:] == hashed[:-1]]
        some = equal | np.r_[equal[1:], False]
        order, equal = order[some], equal[some]
        self.at, self.owner = at[order], owner[order]
        self.place = self.at - begins[self.owner]
        self.heads = np.flatnonzero(~equal)
        self.tails = np.r_[self.heads[1:], len(order)]
        if len(order):
            self.doc = docs[self.owner]
            self.before = np.where(self.place == 0, DIVERSE, array[self.at - 1].astype(np.int64))
            low, high = np.minimum.reduceat(self.before, self.heads), np.maximum.reduceat(self.before, self.heads)
            chosen = np.minimum.reduceat(self.doc, self.heads) < np.maximum.reduceat(self.doc, self.heads)
            chosen &= (high == DIVERSE) | (low < high)
            self.heads, self.tails = self.heads[chosen], self.tails[chosen]

    def repeats(self) -> Iterator[tuple[int, Shared, list[tuple[int, int]], range]]:
        """Every maximal repeat in two documents or more: its length, what it has in common, the
        suffixes of its class in order, as (fragment, place), and which of them are its occurrences."""
        for head, tail in zip(self.heads.tolist(), self.tails.tolist()):
            owner, ends = self.owner[head:tail].tolist(), self.ends[self.owner[head:tail]].tolist()
            members = sorted(zip(
                [self.data[a:e] for a, e in zip(self.at[head:tail].tolist(), ends)], owner, self.place[head:tail].tolist(),
                self.before[head:tail].tolist(), self.doc[head:tail].tolist()))
            leaves = [Shared(m[3], m[4], no) for no, m in enumerate(members)]
            places = [(m[1], m[2]) for m in members]
            for length, first, last, shared in prefix_intervals([m[0] for m in members], self.passage, leaves):
                if shared.before == DIVERSE and shared.least < shared.most:
                    yield length, shared, places, range(first, last + 1)


def maximal_repeats(contents: list[bytes], docs: np.ndarray, passage: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Length, smallest doc_id and all occurrences (fragment, place) of every maximal repeat."""
    for length, shared, places, inside in SuffixArray(contents, docs, passage).repeats():
        yield length, shared.least, [places[i] for i in inside]


def later_occurrences(contents: list[bytes], docs: np.ndarray, passage: int) -> Iterator[tuple[int, int, int]]:
    """Fragment, place and length of what a smaller doc_id has too: of a suffix in nested maximal
    repeats, the longest one that does."""
    known = docs.tolist()
    for length, shared, places, _ in SuffixArray(contents, docs, passage).repeats():
        left = []
        for i in shared.open:
            fragment, place = places[i]
            if known[fragment] > shared.least:
                yield fragment, place, length
            else:
                left.append(i)
        shared.open = left


def _group_repeats(table: pa.Table, passage: int) -> Iterator[tuple[int, int, int]]:
    """Row, begin and end of every occurrence outside the smallest document that one group finds."""
    held = Held()
    for blob in table.column("fragments"):
        (lengths, docs, holders, rows, places), data = _unpacked(blob.as_py(), FRAGMENT_KINDS)
        begin, holder = 0, 0
        pairs = np.stack([rows, places], axis=1)
        for length, doc, n in zip(lengths.tolist(), docs.tolist(), holders.tolist()):
            held.add(data[begin:begin + length], doc, 0, pairs[holder:holder + n].ravel().tolist())
            begin, holder = begin + length, holder + n
    yield from held.repeats
    contents = list(held.found)
    known = list(held.found.values())
    docs = np.array([k[0] for k in known], dtype=np.int64)
    for fragment, place, length in later_occurrences(contents, docs, passage):
        holders = known[fragment]
        for i in range(2, len(holders), 2):
            yield holders[i], holders[i + 1] + place, holders[i + 1] + place + length


def repeats(texts: DataFrame, total_bytes: int, passage: int = PASSAGE, group_bytes: int = GROUP_BYTES,
            crowded: int = CROWDED) -> DataFrame:
    """``_row``, ``begin`` and ``end`` of passages of texts (_row, doc_id, text) that a smaller
    doc_id has too; a passage may be reported in parts."""
    shared = settle(shared_buckets(texts, total_bytes // PART_BYTES + 1, passage), compact=True)
    n, fragments = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(MOST_TABLE_BITS, max(10, (16 * n).bit_length()))
    while shared.where(F.col("n") > crowded).count() > MOST_CROWDED:
        crowded *= 2
    many = shared.where(F.col("n") > crowded).select("bucket").toArrow().column(0).to_numpy().view(np.uint64)
    buckets = Buckets(bit_table(shared, bits), bits, fragments * FRAGMENT_BYTES // group_bytes + 1, many)
    sent = sent_fragments(texts, buckets, passage)

    def found(table: pa.Table) -> pa.Table:
        spans = [np.array(list(_group_repeats(table, passage)), dtype=np.int64).reshape(-1, 3)]
        for blob in table.column("removed"):
            if blob.is_valid:
                spans.append(np.stack(_unpacked(blob.as_py(), SPAN_KINDS)[0], axis=1))
        joined = merged_spans(np.concatenate(spans))
        return pa.table({name: pa.array(joined[:, i]) for i, name in enumerate(("_row", "begin", "end"))})

    return sent.groupBy("part").applyInArrow(found, "_row long, begin long, end long")


def _without_spans(rows: DataFrame) -> DataFrame:
    """``spans`` joined and cut out of ``_text``, as ``kept``."""
    schema = "_given " + rows.schema["_given"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts, spans, kept = batch.column(1).cast(pa.binary()), [], []
            for text, found in zip(texts, batch.column(2).to_pylist()):
                whole, joined, parts, upto = text.as_py(), [], [], 0
                for span in sorted(found, key=lambda s: s["begin"]):
                    if joined and span["begin"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], span["end"])
                    else:
                        joined.append(dict(span))
                for span in joined:
                    parts.append(whole[upto:span["begin"]])
                    upto = span["end"]
                spans.append(joined)
                kept.append(b"".join([*parts, whole[upto:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["_given", "spans", "kept"])

    return rows.select("_given", "_text", "spans").mapInArrow(cut, f"{schema}, {SPANS}, kept binary")


SPANS = "spans array<struct<begin:bigint,end:bigint>>"


def without_repeats(df: DataFrame, passage: int = PASSAGE, group_bytes: int = GROUP_BYTES, crowded: int = CROWDED) -> DataFrame:
    """Add ``n_bytes``, ``spans`` (the removed runs of bytes) and ``kept`` (the rest, as bytes: a
    cut may lie inside a character).

    Texts move only where a part of them is cut out.
    """
    has_columns(df, "doc_id", "text")
    rows = keyed(df)
    text = F.coalesce(F.col("_given.text"), F.lit(""))
    known = settle(rows.select(
        "_row", F.coalesce(F.col("_given.doc_id").cast("long"), F.lit(int(UNNAMED))).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest")), compact=True)
    firsts = settle(known.where(F.col("n_bytes") >= passage).groupBy("digest").agg(
        F.min(F.struct("doc_id", "_row")).alias("first"), F.max("n_bytes").alias("bytes")), compact=True)
    texts = marked(rows, firsts.select("first._row"), "_first").where("_first").select("_row", "_given.doc_id", "_given.text")
    total = firsts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = settle(repeats(texts, total, passage, group_bytes, crowded), compact=True)
    cuts = parts.groupBy("_row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    copies = known.join(firsts.select("digest", "first"), "digest").select(
        "_row", F.col("first._row").alias("_first_row"), (F.col("doc_id") > F.col("first.doc_id")).alias("_copy"))
    copies = settle(copies, compact=True)
    partly = settle(copies.where("NOT _copy").select("_row", "_first_row").join(
        cuts.withColumnRenamed("_row", "_first_row"), "_first_row").select("_row", "spans"), compact=True)

    given = [c for c in df.columns if c not in RESULTS]
    columns = [F.col("_given").getField(c).alias(c) for c in given]
    n_bytes = F.octet_length(F.coalesce(F.col("_given.text"), F.lit(""))).cast("long").alias("n_bytes")
    whole = marked(rows, copies.where("_copy"), "_copy")
    some = marked(whole, partly, "_partly")
    copied = some.where("_copy").select(*columns, n_bytes, F.array(F.struct(
        F.lit(0).cast("long").alias("begin"), F.octet_length("_given.text").cast("long").alias("end"))).alias("spans"),
        F.lit(b"").alias("kept"))
    untouched = some.where("NOT _copy AND NOT _partly").select(
        *columns, n_bytes, F.expr(f"CAST(array() AS {SPANS.split(' ', 1)[1]})").alias("spans"), text.cast("binary").alias("kept"))
    cut = _without_spans(some.where("_partly").join(partly, "_row").select("_given", F.col("_given.text").alias("_text"), "spans"))
    return untouched.unionByName(copied).unionByName(cut.select(*columns, n_bytes, "spans", "kept"))


ORACLE = """
WITH hexed AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), windows AS (
  SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 100)) AS w
  FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS p FROM hexed)
), firsts AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before
  FROM windows JOIN firsts USING (w) WHERE doc_id > first_id
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT *, count(*) FILTER (before IS NULL OR p - before > 50) OVER (PARTITION BY doc_id ORDER BY p) AS no FROM hits)
  GROUP BY doc_id, no
), gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs
  UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id
), rests AS (
  SELECT g.doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS rest
  FROM gaps g JOIN hexed USING (doc_id) GROUP BY g.doc_id
), sums AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM hexed d LEFT JOIN sums s ON d.doc_id = s.doc_id LEFT JOIN rests r ON d.doc_id = r.doc_id
"""


def op13_suffix_dedup(spark, sf_dir):
    """Every document and what is left of it."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return without_repeats(documents).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
