"""Removal of repeated byte strings by sorted suffixes (operator 7).

A byte goes if a string of LENGTH bytes that covers it also starts in a document of smaller doc_id.

1. Documents are packed, as they are scanned, into units of a few MB.  A unit is one row of a table
   bucketed by unit, so later joins by unit move no text.
   Later copies of a whole text go as a whole, and take no part in the rest: what they hold, the first has.
2. Every window of LENGTH bytes has an anchor: the leftmost smallest hash of the GRAM-byte strings in
   it.  Equal windows have equal anchors, so a window can only occur in two documents if its anchor's
   gram does.  Each unit sends its distinct anchor grams (4 bytes of their hash each) and learns
   which of them other units have.
3. For anchors that occur in two documents a unit sends the stretch of text that their windows cover,
   each distinct stretch once with the smallest doc_id that has it.  The suffixes that start at its
   windows are sorted, by LENGTH bytes: multikey quicksort on 8-byte characters to a shallow depth,
   then blind tries for the groups that still agree.  A window that a smaller doc_id has too is a hit.
   A gram with over HOT_WINDOWS windows is hot: there each window is a stretch of its own, and goes to a task by
   a hash of its bytes, so that equal windows still meet and no task takes a whole gram.
4. Units learn their hits, and cut the covered bytes out.

Copies inside a unit are combined before anything is shuffled, so what a group of copies sends grows
with the units it is in, not with its documents.  All comparisons of windows are of their bytes; their
hashes only choose candidates.  Whole texts are compared by SHA-256.

Where this departs from a textbook deep-shallow sort of all suffixes, and why the removed bytes are the
same.  Only LENGTH-byte prefixes are ordered, as nothing longer decides; only suffixes whose anchor two
documents have, as no other has a copy elsewhere.  Equal stretches inside a unit are found by a table
of their bytes, not by the sort: the first has the smallest doc_id of the unit, so later ones of another
doc_id are hits whatever other units hold, and the sort decides about the first.  Characters of the
quicksort are 8 bytes; groups of at most SMALL_GROUP rows are ordered by numpy's sort, as others end their
quicksorts with an insertion sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 50
GRAM = 24
UNIT_BYTES = 3 << 20
#: Text of a bucket of units, which one task reads.
BUCKET_BYTES = 16 << 20
#: Text whose anchors, or whose windows, one task of the sorting rounds takes; at most a fifth of the windows are usual.
ROUND_BYTES = 8 << 20
#: Hash ranges of grams up to which a range is ROUND_BYTES of text (128 GB in all).  Beyond, ranges grow with the square root of the
#: text, and their number with it too, up to MOST_ROUND_BYTES, from where on only their number grows.  So a task has its bound (some 20
#: bytes for each byte of a range), and what grows in turn is how many small rows a unit of text sends.
RANGES, MOST_ROUND_BYTES = 1 << 14, 64 << 20
#: Windows for which hashes are computed, or suffixes sorted, at a time.
SLAB = 1 << 19
#: Windows of one anchor gram, of all units together, over which its windows are sent one by one.
HOT_WINDOWS = SLAB
#: 8-byte characters that the multikey quicksort looks at.
SHALLOW = 2
#: Rows of a group that the quicksort doesn't partition further.
SMALL_GROUP = 1 << 12
_SPAN = LENGTH - GRAM + 1
_POSITION = np.uint64((1 << 20) - 1)


# units

UNIT = pa.schema([("unit", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("bytes", pa.binary()), ("rest", pa.binary())])


def _units(unit_bytes: int):
    """Batches of (doc_id, text, row) -> rows of UNIT, documents by doc_id (null last), then text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0

        def pack() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            texts = [x or b"" for x in t.column(1).cast(pa.large_binary()).to_pylist()]
            ids = t.column(0).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
            out = pa.BufferOutputStream()
            rest = t.select([2]).take(order)
            with pa.ipc.new_stream(out, rest.schema) as w:
                w.write_table(rest)
            ends = np.cumsum([len(texts[i]) for i in order])
            return pa.record_batch([[part << 24 | no], [[ids[i] for i in order]], [ends], [b"".join([texts[i] for i in order])], [out.getvalue().to_pybytes()]], schema=UNIT)

        for batch in batches:
            sizes = np.cumsum(np.fromiter((len(x.as_buffer() or b"") for x in batch.column(1).cast(pa.large_binary())), np.int64, batch.num_rows)) if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                end = min(batch.num_rows, int(np.searchsorted(sizes, done + unit_bytes - size)) + 1)
                held.append(batch.slice(at, end - at))
                size += int(sizes[end - 1] - done)
                at = end
                if size >= unit_bytes:
                    yield pack()
                    no, held, size = no + 1, [], 0
        if held:
            yield pack()

    return run


# anchors


def _grams(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    n = len(raw) - GRAM + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for offset in range(8, GRAM, 8):
        h ^= words[offset : offset + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(raw: np.ndarray, ends: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, first window, number of windows) of each run of windows with one anchor; only documents marked live have any."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    starts = np.concatenate([[0], ends[:-1]])
    long = live & (ends - LENGTH + 1 > starts)
    limit = int(ends[long].max()) if long.any() else 0
    valid = np.zeros(len(raw) + 1, np.int32)
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid) > 0
    for at in range(0, max(0, limit - LENGTH + 1), SLAB):
        n = min(SLAB, limit - LENGTH + 1 - at)
        gram = _grams(raw[at : at + n + LENGTH - 1])
        key = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= _SPAN:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: n], key[_SPAN - width : _SPAN - width + n])
        where = np.flatnonzero(valid[at : at + n])
        if not len(where):
            continue
        spot = (key[where] & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (where[1:] != where[:-1] + 1)]))
        found.append((gram[spot[first]], where[first] + at, np.diff(np.append(first, len(where)))))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, doc_ids, which documents take part) of a unit: not those without a doc_id, nor later copies of a whole text."""
    raw = np.frombuffer(batch.column("bytes")[row].as_buffer(), np.uint8)
    ids = batch.column("doc_ids")[row].values
    live = ids.is_valid().to_numpy(zero_copy_only=False)
    if "copies" in batch.schema.names:
        live = live.copy()
        live[batch.column("copies")[row].as_py() or []] = False
    return raw, batch.column("ends")[row].values.to_numpy(), ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), live


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each different text of a unit that windows fit in: its SHA-256, and the places and doc_ids that have it."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw, ends, ids, live = _opened(batch, row)
            text, begins = memoryview(raw), np.concatenate([[0], ends[:-1]])
            found: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(live & (ends - begins >= LENGTH)).tolist():
                found.setdefault(hashlib.sha256(text[begins[i] : ends[i]]).digest(), []).append(i)
            at = list(found.values())
            yield pa.record_batch([pa.array([batch.column("unit")[row].as_py()] * len(at), pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array([ids[i] for i in at], pa.list_(pa.int64())), pa.array(list(found), pa.binary())], names=["unit", "places", "doc_ids", "digest"])


def _shared_inside(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Grams that two documents of the unit have, sorted."""
    order = np.argsort(gram, kind="stable")
    g, d = gram[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)) if len(g) else (d, d)
    return g[first][low != high]


def _bucket(grams: np.ndarray, n: int) -> np.ndarray:
    return ((grams >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _keys(grams: np.ndarray, n: int) -> np.ndarray:
    """Bucket and 32 bits of the hash: what units tell each other about a gram.  In a bucket, which has as
    many grams whatever the corpus, another gram has the same 32 bits once in some thousands."""
    return (_bucket(grams, n).astype(np.uint64) << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF))


def _packed(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) of what goes to each bucket that gets anything."""
    order = np.argsort(buckets, kind="stable")
    names, cut = np.unique(buckets[order], return_index=True)
    for k, rows in zip(names.tolist(), np.split(order, cut[1:]) if len(order) else [], strict=True):
        yield k, rows


def _sent_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, ends, _, live = _opened(batch, row)
                gram, _, windows = anchors(raw, ends, live)
                keys, which = np.unique(_keys(gram, n), return_inverse=True)
                count = np.bincount(which, windows, len(keys)).astype(np.uint32)
                parts = list(_packed((keys >> np.uint64(32)).astype(np.int64)))
                if parts:
                    yield pa.record_batch([pa.array([k for k, _ in parts], pa.int32()), pa.array([batch.column("unit")[row].as_py()] * len(parts), pa.int64()), pa.array([keys[i].astype("<u4").tobytes() for _, i in parts], pa.binary()), pa.array([count[i].astype("<u4").tobytes() for _, i in parts], pa.binary())], names=["bucket", "unit", "grams", "counts"])

    return run


def _shared_grams(hot_windows: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of a bucket: the grams of each unit that another unit has too, and which of them are hot."""
        units = table["unit"].to_numpy()
        sent = [np.frombuffer(x, "<u4") for x in table["grams"].to_pylist()]
        grams, who = np.concatenate(sent), np.repeat(np.arange(len(sent)), [len(x) for x in sent])
        count = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4")
        order = np.argsort(grams)
        g = grams[order]
        same = np.concatenate([[False], g[1:] == g[:-1], [False]])
        many = same[:-1] | same[1:]
        g, w, c = g[many], who[order][many], count[order][many]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        total = np.add.reduceat(c.astype(np.int64), first) if len(g) else first
        hot = np.repeat(total > hot_windows, np.diff(np.append(first, len(g))))
        by = np.argsort(w, kind="stable")
        cut = np.searchsorted(w[by], np.arange(len(sent) + 1))
        rows = [k for k in range(len(sent)) if cut[k] < cut[k + 1]]
        mine = [by[cut[k] : cut[k + 1]] for k in rows]
        bucket = pa.array([key[0].as_py()] * len(rows), pa.int32())
        return pa.table([pa.array(units[rows], pa.int64()), bucket, pa.array([g[i].tobytes() for i in mine], pa.binary()), pa.array([g[i[hot[i]]].tobytes() for i in mine], pa.binary())], names=["unit", "bucket", "grams", "hot"])

    return run


# stretches

SENT = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("owners", pa.binary()), ("grams", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])


def _stretches(raw: np.ndarray, ends: np.ndarray, ids: np.ndarray, live: np.ndarray, shared: list[dict], n_buckets: int):
    """(first window, windows, number of the stretch, whether its owner is another document) of each kept anchor,
    and of each stretch: its gram (of a hot window: a hash of it), owner, windows, text."""
    gram, first, n = anchors(raw, ends, live)
    doc = np.searchsorted(ends, first, "right")
    key = _keys(gram, n_buckets)
    told = [np.frombuffer(x["grams"], "<u4").astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in shared]
    kept = np.unique(np.concatenate([_shared_inside(key, ids[doc]), *told]))
    some = np.flatnonzero(np.isin(key, kept, kind="sort")) if len(kept) else np.zeros(0, np.int64)
    gram, first, n, doc = gram[some], first[some], n[some], doc[some]
    text = raw.tobytes()
    hot = np.isin(key[some], np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x["hot"], "<u4").astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in shared)]))
    if hot.any():
        # each window by itself, under a hash of its bytes: equal windows have equal anchors, so all or none are hot
        times = np.where(hot, n, 1)
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        gram, first, n, doc, hot = np.repeat(gram, times), np.repeat(first, times) + step, np.repeat(np.where(hot, 1, n), times), np.repeat(doc, times), np.repeat(hot, times)
        gram[hot] = [xxhash.xxh64_intdigest(text[a : a + LENGTH]) for a in first[hot].tolist()]
    numbers: dict[bytes, int] = {}
    number = np.fromiter((numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)), np.int64, len(first))
    # the first of a stretch has its smallest doc_id: documents stand by doc_id
    lead = np.zeros(len(numbers), np.int64)
    lead[number[::-1]] = np.arange(len(number))[::-1]
    owner = ids[doc[lead]]
    return first, n, number, ids[doc] != owner[number], gram[lead], owner, n[lead], list(numbers)


def _sent_stretches(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, ends, ids, live = _opened(batch, row)
                *_, gram, owner, n, texts = _stretches(raw, ends, ids, live, batch.column("shared")[row].as_py() or [], n_buckets)
                unit = batch.column("unit")[row].as_py()
                for k, i in _packed(_bucket(gram, n_buckets)):
                    text = pa.compress(b"".join([texts[j] for j in i.tolist()]), "zstd", asbytes=True)  # short stretches: only entropy coding makes them smaller
                    yield pa.record_batch([[unit], [k], [i.astype("<u4").tobytes()], [owner[i].tobytes()], [(gram[i] >> np.uint64(16)).astype("<u2").tobytes()], [n[i].astype("<u2").tobytes()], [text]], schema=SENT)

    return run


# sorting


def equal_windows(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): suffixes from positions `at` in the order of their LENGTH bytes, and where groups of equal ones begin."""
    chars = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    offsets = [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]

    def char(rows: np.ndarray, offset: int | np.ndarray) -> np.ndarray:
        return chars[at[rows] + offset].byteswap()

    # shallow: multikey quicksort, one character deeper at a time among those that agree so far
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)  # of the row at each place; rising
    for offset in offsets[:SHALLOW]:
        tied = _tied(group)
        c = char(order[tied], offset)
        order[tied], group[tied] = _part(order[tied], group[tied], c)
        group = _renumber(group, tied, order, at, char, offset)
    # deep: a blind trie for each group that agrees; a node branches at the first character in which its members differ
    offsets_left = np.array(offsets[SHALLOW:], np.int64)
    open_places = _tied(group)
    while len(open_places):
        g = group[open_places]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        lead = open_places[np.flatnonzero(head)[np.cumsum(head) - 1]]
        branch = np.full(int(head.sum()), len(offsets_left))
        member = np.cumsum(head) - 1
        for k in range(len(offsets_left) - 1, -1, -1):
            differ = char(order[open_places], offsets_left[k]) != char(order[lead], offsets_left[k])
            branch[np.unique(member[differ])] = k
        splits = branch[member] < len(offsets_left)  # others are equal throughout: leaves
        open_places, member = open_places[splits], member[splits]
        if not len(open_places):
            break
        offset = offsets_left[branch[member]]
        c = char(order[open_places], offset)
        by = np.lexsort((c, member))
        order[open_places] = order[open_places][by]
        member, c = member[by], c[by]
        fresh = np.concatenate([[True], (member[1:] != member[:-1]) | (c[1:] != c[:-1])])
        group[open_places] = open_places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        count = np.bincount(np.cumsum(fresh) - 1)
        open_places = open_places[count[np.cumsum(fresh) - 1] > 1]
    return order, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.zeros(0, np.int64)


def _tied(group: np.ndarray) -> np.ndarray:
    same = np.concatenate([[False], group[1:] == group[:-1], [False]])
    return np.flatnonzero(same[:-1] | same[1:])


def _part(rows: np.ndarray, group: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows and group by the character c inside groups."""
    by = quicksorted(c, np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else group)
    return rows[by], group[by]


def quicksorted(c: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of characters c inside groups (numbers that rise along c): all large groups are partitioned at once about a pivot of
    their own, into smaller, equal and larger characters, until none is large; the equal ones are in their places by then."""
    at, done = np.arange(len(c)), np.zeros(len(c), bool)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(c) else np.zeros(0, np.int64)
    while True:
        size = np.diff(np.append(first, len(c)))
        large = (size > SMALL_GROUP) & ~done[first]
        if not large.any():
            break
        begin, n = first[large], size[large]
        own = np.repeat(np.arange(len(n)), n)
        places = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows = at[places]
        pivot = np.sort(c[at[begin[:, None] + (n[:, None] - 1) * np.arange(9) // 8]], axis=1)[:, 4]
        x = c[rows]
        side = np.where(x < pivot[own], 0, np.where(x == pivot[own], 1, 2))
        count = np.bincount(own * 3 + side, minlength=3 * len(n)).reshape(-1, 3)
        offset = begin[:, None] + np.cumsum(count, axis=1) - count
        for k in range(3):
            some = np.flatnonzero(side == k)
            mine = own[some]
            to = offset[mine, k] + np.arange(len(some)) - np.searchsorted(mine, np.arange(len(n)))[mine]
            at[to], done[to] = rows[some], k == 1
        first = np.union1d(first, offset[count > 0])
    group_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c)))) if len(c) else group
    rest = np.flatnonzero(~done)
    at[rest] = at[rest][np.lexsort((c[at[rest]], group_of[rest]))]
    return at


def _renumber(group: np.ndarray, tied: np.ndarray, order: np.ndarray, at: np.ndarray, char, offset: int) -> np.ndarray:
    """Groups named by the place of their first member; those that now differ in the character at offset are parted."""
    c = char(order[tied], offset)
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    if len(tied):
        differs = np.concatenate([[True], (c[1:] != c[:-1]) | (group[tied][1:] != group[tied][:-1])])
        new[tied] = differs
    starts = np.flatnonzero(new)
    return starts[np.cumsum(new) - 1]


def _hits(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket of stretches: which windows a smaller doc_id has too, as bits in the order they were sent."""
    columns = {c: table[c].to_pylist() for c in ("unit", "numbers", "owners", "grams", "sizes", "text")}
    sizes = [np.frombuffer(x, "<u2").astype(np.int64) for x in columns["sizes"]]
    size, owner, gram = np.concatenate(sizes), np.frombuffer(b"".join(columns["owners"]), np.int64), np.frombuffer(b"".join(columns["grams"]), "<u2")
    text = np.frombuffer(b"".join([pa.decompress(x, int((s + LENGTH - 1).sum()), "zstd", asbytes=True) for x, s in zip(columns["text"], sizes, strict=True)]), np.uint8)
    begin = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    bit = np.cumsum(size) - size
    hit = np.zeros(int(size.sum()), bool)
    # equal windows have equal grams, so the stretches can be taken by classes of their grams
    classes = max(1, int(size.sum()) // SLAB)
    kind = gram.astype(np.int64) % classes
    for k in range(classes):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        n = size[rows]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at, who, which = np.repeat(begin[rows], n) + step, np.repeat(owner[rows], n), np.repeat(bit[rows], n) + step
        order, first = equal_windows(text, at)
        least = np.minimum.reduceat(who[order], first)
        hit[which[order]] = who[order] > np.repeat(least, np.diff(np.append(first, len(order))))
    out, at = [], 0
    for unit, numbers, s in zip(columns["unit"], columns["numbers"], sizes, strict=True):
        total = int(s.sum())
        if hit[at : at + total].any():
            out.append((unit, numbers, np.packbits(hit[at : at + total]).tobytes()))
        at += total
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["unit", "numbers", "bits"])


# cutting


def cut(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes are covered by the windows from `starts` on."""
    edge = np.bincount(starts, minlength=len(raw) + 1) - np.bincount(starts + LENGTH, minlength=len(raw) + 1)
    return np.cumsum(edge)[: len(raw)] > 0


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, without the characters that are only covered in part."""
    lead = (raw & 0xC0) != 0x80
    if lead.all():
        return gone
    first = np.flatnonzero(lead)
    all_gone = np.minimum.reduceat(gone, first)
    return np.repeat(all_gone, np.diff(np.append(first, len(raw))))


def _results(with_text: bool, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, ends, ids, live = _opened(batch, row)
                first, n, number, other, _, _, windows, _ = _stretches(raw, ends, ids, live, batch.column("shared")[row].as_py() or [], n_buckets)
                offset = np.cumsum(windows) - windows
                hit = np.zeros(int(windows.sum()), bool)
                for x in batch.column("hits")[row].as_py() or []:
                    i = np.frombuffer(x["numbers"], "<u4").astype(np.int64)
                    total = int(windows[i].sum())
                    step = np.arange(total) - np.repeat(np.cumsum(windows[i]) - windows[i], windows[i])
                    hit[np.repeat(offset[i], windows[i]) + step] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=total).astype(bool)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                bad = np.repeat(other, n) | hit[np.repeat(offset[number], n) + step]
                gone = cut(raw, (np.repeat(first, n) + step)[bad])
                for i in batch.column("copies")[row].as_py() or []:
                    gone[ends[i - 1] if i else 0 : ends[i]] = True
                rest = pa.ipc.open_stream(batch.column("rest")[row].as_buffer()).read_all().combine_chunks()
                out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                begin = 0
                for end in ends.tolist():
                    g, r = gone[begin:end], raw[begin:end]
                    out["n_bytes"].append(end - begin)
                    out["n_removed"].append(int(g.sum()))
                    out["n_spans"].append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()))
                    if with_text:
                        out["kept"].append(r[~whole_characters(r, g)].tobytes().decode("utf-8", "replace"))
                    else:
                        out["kept"].append(hashlib.sha256(r[~g].tobytes()).hexdigest())
                    begin = end
                table = pa.table([*rest.columns, *(pa.array(v, pa.string() if k == "kept" else pa.int64()) for k, v in out.items())], names=["row", *out])
                yield from table.to_batches()

    return run


def ranges(total: int) -> int:
    """Hash ranges for so many bytes of text."""
    times = max(1.0, (total / (RANGES * ROUND_BYTES)) ** 0.5)
    return max(1, -(-total // min(MOST_ROUND_BYTES, int(ROUND_BYTES * times))))


def remove_repeats(docs: DataFrame, with_text: bool = False, unit_bytes: int = UNIT_BYTES, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns but text, of any names), n_bytes, n_removed, n_spans, kept.

    kept is the SHA-256 of the remaining bytes or, with_text, the remaining text; there a character stays
    whole unless all its bytes go.  Null and empty texts are 0 bytes; texts under LENGTH bytes never
    match.  Rows of one doc_id don't count against each other, so of repeated rows all or none lose a
    byte.  Rows of null doc_id neither lose bytes nor count.  An empty table gives no rows."""
    spark = docs.sparkSession
    common.ship(spark)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))
    total = common.text_bytes(docs)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    rounds = ranges(total)
    units, _ = common.bucketed(rows.mapInArrow(_units(unit_bytes), "unit long, doc_ids array<long>, ends array<long>, bytes binary, rest binary"), "unit", buckets=buckets)

    narrow = units.drop("rest")
    texts = common.write_table(narrow.mapInArrow(_digests, "unit long, places array<int>, doc_ids array<long>, digest binary"), "digests")
    firsts = texts.groupBy("digest").agg(F.min(F.array_min("doc_ids")).alias("first"), F.max(F.array_max("doc_ids")).alias("last")).where("first < last").select("digest", "first")
    later = texts.join(firsts, "digest").select("unit", F.transform(F.filter(F.arrays_zip("places", "doc_ids"), lambda x: x["doc_ids"] > F.col("first")), lambda x: x["places"]).alias("later"))
    copies = common.write_table(later.groupBy("unit").agg(F.flatten(F.collect_list("later")).alias("copies")), "copies")  # of one unit: bounded by its documents
    live = narrow.hint("shuffle_merge").join(copies, "unit", "left")

    grams = live.mapInArrow(_sent_grams(rounds), "bucket int, unit long, grams binary, counts binary")
    shared = common.write_table(grams.groupBy("bucket").applyInArrow(_shared_grams(hot_windows), "unit long, bucket int, grams binary, hot binary"), "shared-grams")
    by_unit = shared.groupBy("unit").agg(F.collect_list(F.struct("bucket", "grams", "hot")).alias("shared"))  # of one unit: bounded by its bytes
    known = live.hint("shuffle_merge").join(by_unit, "unit", "left")
    sent = known.mapInArrow(_sent_stretches(rounds), "unit long, bucket int, numbers binary, owners binary, grams binary, sizes binary, text binary")
    hits = common.write_table(sent.groupBy("bucket").applyInArrow(_hits, "unit long, numbers binary, bits binary"), "window-hits")

    hits_of = hits.groupBy("unit").agg(F.collect_list(F.struct("numbers", "bits")).alias("hits"))
    full = units.hint("shuffle_merge").join(copies, "unit", "left").join(by_unit.hint("shuffle_merge"), "unit", "left").join(hits_of.hint("shuffle_merge"), "unit", "left")
    numbers = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *numbers, T.StructField("kept", T.StringType())])
    return full.mapInArrow(_results(with_text, rounds), schema)


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs, in its own columns, with the repeats cut out of the texts (and n_chars, where docs has it, counted anew)."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return remove_repeats(docs, with_text=True).select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
