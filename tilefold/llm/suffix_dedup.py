"""Suffix-array dedup: bytes of strings that also start in a document with a smaller id go.

A string is ``length`` bytes (50). Suffixes are taken at anchors only: in each string, the
leftmost k-gram of the least hash. Equal strings have equal anchors at equal places, so nothing
is missed, and there is one anchor for about (length - k) / 2 bytes. The stretch of text whose
strings share an anchor is its *reach*.

1. Documents are packed into blocks, and these into units of bounded size (a unit is part of a task's
   rows, however many these are). Blocks are written to a table that is bucketed by their unit, so
   lists for a unit meet its blocks without moving the texts again.
2. Each unit sends the distinct hashes of its anchors' k-grams; those that occur in two
   documents or more come back to it. No other suffix is looked at again.
3. The suffixes at the anchors left, each with its reach, are range-partitioned by their leading
   bytes at sampled splitters, into buckets whose number grows with the bytes of all texts. A unit
   keeps only the smallest document of equal reaches: the others lose theirs at once, so the
   suffixes of a hot passage are at most one for each unit.
4. Buckets are sorted locally by multikey quicksort over 8-byte words. Splitters compare fewer
   bytes than a k-gram has, so no group of suffixes crosses a boundary. Equal reaches are
   resolved as a whole; where suffixes share a k-gram and differ in reach, their strings are
   compared one by one (by a hash first, then by their bytes).
5. What is to go comes back to the blocks as intervals.

Defined results: null and empty texts and texts shorter than ``length`` lose nothing; a null id
counts as larger than all others; rows of equal ids do not remove each other's bytes; repeated
rows are repeated; an empty table gives an empty table; columns that are not asked for are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, as_text, bucketed, mix, raw_bytes, scratch, slices, written

LENGTH, K = 50, 20
LEFT = LENGTH - K
#: Bytes that anchors are computed for at once (fits a cache; a longer document is taken alone).
CHUNK = 1 << 19
#: Leading bytes that splitters compare.
LEAD = 7
NO_ID = np.iinfo(np.int64).max
#: Sampled suffixes of a block.
SAMPLED = 64
#: Bytes of text after which a unit ends (it ends with a block).
UNIT_BYTES = 8 << 20
#: Bytes of text for each bucket of hashes and of suffixes.
BUCKET_BYTES = 8 << 20
#: Units of a task at most: the lower bits of a unit's number.
UNIT_BITS = 14

RECORD = np.dtype([("right", "V56"), ("left", "V32"), ("nr", "u1"), ("nl", "u1"), ("block", "<u2"), ("pid", "<u4"), ("at", "<u4"), ("doc", "<i8")])
SPAN = np.dtype([("block", "<u2"), ("start", "<u4"), ("end", "<u4")])

_BYTE_HASH = mix(np.arange(256, dtype=np.uint64) * MIX_B + MIX_A)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated documents: each anchor's place, k-gram hash, and first and last string start."""
    out = []
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        out.append(_anchors(raw, offsets[first : last + 1]))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))


def _anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    base = int(offsets[0])
    data = raw[base : offsets[-1]]
    n = len(data)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < LENGTH:
        return none
    h1 = _BYTE_HASH[data]
    h2 = h1[:-1] * MIX_A + h1[1:]
    h4 = h2[:-2] * MIX_B + h2[2:]
    h8 = h4[:-4] * MIX_A + h4[4:]
    h16 = h8[:-8] * MIX_B + h8[8:]
    gram = mix(h16[: n - K + 1] * MIX_A + h4[16 : 16 + n - K + 1])
    places = np.arange(len(gram), dtype=np.uint64)
    bits = np.uint64(max(20, int(n).bit_length()))
    key = (gram >> bits << bits) | places
    # least key of the LEFT + 1 (31) k-grams of each string
    m = np.minimum(key[:-1], key[1:])
    m = np.minimum(m[:-2], m[2:])
    m = np.minimum(m[:-4], m[4:])
    m = np.minimum(m[:-8], m[8:])
    m = np.minimum(m[: n - LENGTH + 1], m[LEFT + 1 - 16 : LEFT + 1 - 16 + n - LENGTH + 1])
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = offsets[1:] - base
    valid = np.zeros(len(at) + 1, np.int32)  # starts of strings that stay inside a document
    sizes = np.diff(offsets)
    long = sizes >= LENGTH
    np.add.at(valid, (ends - sizes)[long], 1)
    np.add.at(valid, (ends - LENGTH + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(starts):
        return none
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    f = np.flatnonzero(new)
    place = at[f]
    return place + base, gram[place], starts[f] + base, starts[np.append(f[1:], len(at)) - 1] + base


def records(raw: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Suffix (right) and what precedes it (left, backwards) of each anchor, as far as it reaches."""
    out = np.zeros(len(place), RECORD)
    out["nr"], out["nl"], out["at"] = hi + LENGTH - place, place - lo, lo
    for a in range(0, len(place), 8192):
        part = slice(a, a + 8192)
        for name, count, width, step, shift in (("right", "nr", 56, 1, 0), ("left", "nl", 32, -1, -1)):
            cells = place[part, None] + shift + step * np.arange(width)
            inside = np.arange(width) < out[count][part, None]
            found = np.where(inside, raw[np.clip(cells, 0, len(raw) - 1)], np.uint8(0))
            out[name][part] = np.ascontiguousarray(found).view(f"V{width}")[:, 0]
    return out


def packed(r: np.ndarray) -> bytes:
    """Records field by field, compressed: half of what they take row by row."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(r[n]).tobytes() for n in RECORD.names))


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = np.zeros(len(raw) // RECORD.itemsize, RECORD), 0
    for n in RECORD.names:
        kind = RECORD[n]
        out[n] = np.frombuffer(raw, kind, len(out), at)
        at += kind.itemsize * len(out)
    return out


def words(field: np.ndarray) -> np.ndarray:
    """The bytes of a field as big-endian 8-byte words, a column each."""
    width = field.dtype.itemsize
    return np.ascontiguousarray(field).view(np.uint8).reshape(len(field), width).view(">u8").astype(np.uint64)


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their words, and the number of the group of equal rows of each in that order.

    Sorted by the first word; only rows that tie are sorted on by the next.
    """
    order = np.argsort(keys[:, 0], kind="stable")
    col = keys[order, 0]
    new = np.ones(len(order), bool)
    new[1:] = col[1:] != col[:-1]
    for j in range(1, keys.shape[1]):
        group = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        sub = np.lexsort((keys[order[tied], j], group[tied]))
        order[tied] = order[tied[sub]]
        col = keys[order, j]
        new[1:] |= col[1:] != col[:-1]
    return order, np.cumsum(new) - 1


def lead_of(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The leading bytes of the suffixes as integers."""
    out = np.zeros(len(place), np.int64)
    for j in range(LEAD):
        out = out << 8 | raw[place + j]
    return out


def least_of_groups(doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Each row's least value of its group; groups are numbered from 0 and stand together."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.minimum.reduceat(doc, starts)[group - group[0]] if len(doc) else doc


def spans_of(r: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), SPAN)
    out["block"], out["start"], out["end"] = r["block"], first, last
    return out


def local_dedup(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of the smallest document of equal reaches, and the reaches of the others as spans."""
    if not len(r):
        return r, np.zeros(0, SPAN)
    keys = np.concatenate([words(r["right"]), words(r["left"]), (r["nr"].astype(np.uint64) << np.uint64(8) | r["nl"])[:, None]], axis=1)
    order, group = multikey_order(keys)
    r = r[order]
    gone = r["doc"] > least_of_groups(r["doc"], group)
    return r[~gone], spans_of(r[gone], r["at"][gone], r["at"][gone].astype(np.int64) + r["nr"][gone] + r["nl"][gone])


def resolve(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All spans to remove among the records of a bucket, with the task of each."""
    if not len(r):
        return np.zeros(0, np.uint32), np.zeros(0, SPAN)
    keys = np.concatenate([words(r["right"]), words(r["left"]), (r["nr"].astype(np.uint64) << np.uint64(8) | r["nl"])[:, None]], axis=1)
    order, group = multikey_order(keys)
    r, keys = r[order], keys[order]
    gone = r["doc"] > least_of_groups(r["doc"], group)
    pids, spans = [r["pid"][gone]], [spans_of(r[gone], r["at"][gone], r["at"][gone].astype(np.int64) + r["nr"][gone] + r["nl"][gone])]
    r, group = r[~gone], group[~gone]
    # Groups of one k-gram (20 bytes: two words and a half) that hold more than one reach.
    gram = keys[~gone][:, :3].copy()
    gram[:, 2] >>= np.uint64(32)
    new = np.ones(len(r), bool)
    new[1:] = (gram[1:] != gram[:-1]).any(axis=1)
    start = np.flatnonzero(new)
    mixed = group[start] != group[np.append(start[1:], len(r)) - 1]
    many = mixed[np.cumsum(new) - 1]
    r, number = r[many], (np.cumsum(new) - 1)[many]
    if len(r):
        right = np.ascontiguousarray(r["right"]).view(np.uint8).reshape(len(r), 56)
        left = np.ascontiguousarray(r["left"]).view(np.uint8).reshape(len(r), 32)
        rows, flagged = [], []
        for o in range(LEFT + 1):  # strings with o bytes before the anchor
            has = np.flatnonzero((o <= r["nl"]) & (LENGTH - o <= r["nr"]))
            if not len(has):
                continue
            text = np.zeros((len(has), 56), np.uint8)
            text[:, :o] = left[has, :o]
            text[:, o:LENGTH] = right[has, : LENGTH - o]
            w = text.view(">u8").astype(np.uint64)
            code = number[has].astype(np.uint64)
            for j in range(w.shape[1]):
                code = mix(code * MIX_A + w[:, j])
            by = np.lexsort((r["doc"][has], code))
            code_, same = code[by], np.ones(len(by), bool)
            same[1:] = code_[1:] != code_[:-1]
            head = by[np.flatnonzero(same)][np.cumsum(same) - 1]
            if (text[head] != text[by]).any():  # two strings with one hash: by the bytes alone
                exact, g = multikey_order(w)
                least = np.empty(len(has), np.int64)
                least[exact] = least_of_groups(r["doc"][has][exact], g)
            else:
                least = np.empty(len(has), np.int64)
                least[by] = r["doc"][has][head]
            hit = has[r["doc"][has] > least]
            rows.append(hit)
            flagged.append(r["at"][hit].astype(np.int64) + r["nl"][hit] - o)
        row, at = np.concatenate(rows), np.concatenate(flagged)
        by = np.lexsort((at, row))
        row, at = row[by], at[by]
        if len(row):
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            f = np.flatnonzero(new)
            e = np.append(f[1:], len(row)) - 1
            pids.append(r["pid"][row[f]])
            spans.append(spans_of(r[row[f]], at[f], at[e] + LENGTH))
    return np.concatenate(pids), np.concatenate(spans)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n bytes an interval covers."""
    steps = np.bincount(start, minlength=n + 1).astype(np.int64) - np.bincount(end, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _block(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(data)) as reader:
        return reader.read_next_batch()


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def whole(away: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """``away`` without the bytes of characters that keep a byte."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(starts):
        return away
    return np.repeat(np.minimum.reduceat(away, starts), np.diff(np.append(starts, len(raw))))


def dedup(docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """The ``keep`` columns of every row, ``n_bytes``, the removed ``spans`` (start, end in bytes) and the ``kept`` bytes.

    With ``whole_characters``, a character of which a byte stays is kept whole, so what is kept is text.
    """
    spark = docs.sparkSession
    picked = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"), F.struct(*[docs[c] for c in keep]).alias("_kept"))
    kept_type = picked.schema["_kept"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << UNIT_BITS
        last = unit | (1 << UNIT_BITS) - 1
        number = held = 0
        for batch in slices(batches, "_text"):
            raw, offsets = raw_bytes(as_text(batch.column("_text")))
            if held and held + len(raw) > UNIT_BYTES and unit < last:
                unit, number, held = unit + 1, 0, 0
            place, gram, _, _ = anchors(raw, offsets)
            some = place[np.argsort(gram, kind="stable")[:SAMPLED]]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([number]), pa.array([len(raw)]), pa.array([lead_of(raw, some).tolist()], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pid", "block", "size", "sample", "data"])
            number, held = number + 1, held + len(raw)

    # 1. Blocks, bucketed by their unit (``pid``).
    with scratch(spark):
        table = bucketed(picked.mapInArrow(write, "pid long, block long, size long, sample array<long>, data binary"), "suffix_blocks", "pid")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(table.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    cuts = table.select(F.explode("sample").alias("x")).agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)] or [0.5], max(1000, 10 * buckets))).first()[0] or []
    splitters = np.unique(np.array(cuts, np.int64))

    # 2. Hashes of k-grams that two documents hold.
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        unit = None

        def out() -> Iterator[pa.RecordBatch]:
            gram, low, high = _distinct(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
            parts.clear()
            part = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            gram, several = gram[order], (low != high)[order]
            runs = _runs(part[order])
            if runs:
                columns = [pa.array([b for b, _, _ in runs]), pa.array([unit] * len(runs)), pa.array([gram[a:z].tobytes() for _, a, z in runs], pa.binary()), pa.array([np.packbits(several[a:z]).tobytes() for _, a, z in runs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "pid", "grams", "several"])

        for batch in batches:
            for n in range(batch.num_rows):
                pid, block = batch.column("pid")[n].as_py(), _block(batch.column("data")[n].as_py())
                if parts and pid != unit:
                    yield from out()
                unit = pid
                raw, offsets = raw_bytes(as_text(block.column("_text")))
                place, gram, _, _ = anchors(raw, offsets)
                doc = _ids(block)[np.searchsorted(offsets, place, side="right") - 1]
                parts.append(_distinct(gram, doc, doc))
        if parts:
            yield from out()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _of_buckets(batches, ("pid", "grams", "several")):
            yield from _shared(rows)

    def _shared(rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        grams, owners, flags = [], [], []
        for pid, g, s in rows:
            grams.append(np.frombuffer(g, np.uint64))
            owners.append(np.full(len(grams[-1]), pid, np.int64))
            flags.append(np.unpackbits(np.frombuffer(s, np.uint8))[: len(grams[-1])].astype(bool))
        gram, owner, several = np.concatenate(grams), np.concatenate(owners), np.concatenate(flags)
        order = np.argsort(gram, kind="stable")
        gram, owner, several = gram[order], owner[order], several[order]
        same = gram[1:] == gram[:-1]
        good = several | np.append(same, False) | np.append(False, same)
        gram, owner = gram[good], owner[good]
        order = np.lexsort((gram, owner))
        gram, owner = gram[order], owner[order]
        for pid, a, z in _runs(owner):
            yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([gram[a:z].tobytes()], pa.binary())], ["pid", "payload"])

    sent = table.select("pid", "data").mapInArrow(send, "bucket long, pid long, grams binary, several binary")
    shared = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(find, "pid long, payload binary")

    # 3. Suffixes at shared anchors, range-partitioned.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        lists: dict[int, np.ndarray] = {}

        def out(pid: int) -> Iterator[pa.RecordBatch]:
            r, spans = local_dedup(np.concatenate(held.pop(pid)))
            lists.pop(pid)
            if len(spans):
                yield pa.RecordBatch.from_arrays([pa.array([pid % buckets]), pa.array([pid]), pa.array([spans.tobytes()], pa.binary())], ["bucket", "pid", "data"])
            lead = (words(r["right"])[:, 0] >> np.uint64(8 * (8 - LEAD))).astype(np.int64)
            part = np.searchsorted(splitters, lead, side="right")
            order = np.argsort(part, kind="stable")
            r = r[order]
            for b, a, z in _runs(part[order]):
                for i in range(a, z, 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.nulls(1, pa.int64()), pa.array([packed(r[i : min(z, i + 50_000)])], pa.binary())], ["bucket", "pid", "data"])

        for batch in batches:
            for n in range(batch.num_rows):
                pid, number = batch.column("pid")[n].as_py(), batch.column("block")[n].as_py()
                if pid not in lists:
                    for done in list(held):
                        yield from out(done)
                    lists[pid] = np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in batch.column("payloads")[n].as_py()]))
                    held[pid] = []
                block = _block(batch.column("data")[n].as_py())
                raw, offsets = raw_bytes(as_text(block.column("_text")))
                place, gram, lo, hi = anchors(raw, offsets)
                known = lists[pid]
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                good = known[at] == gram
                r = records(raw, place[good], lo[good], hi[good])
                r["doc"] = _ids(block)[np.searchsorted(offsets, place[good], side="right") - 1]
                r["pid"], r["block"] = pid, number
                held[pid].append(r)
        for done in list(held):
            yield from out(done)

    # 4. Sorted buckets; what goes, for each task.
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _of_buckets(batches, ("pid", "data")):
            parts: list[np.ndarray] = []
            for pid, data in rows:
                if pid is None:
                    parts.append(unpacked(data))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([data], pa.binary())], ["pid", "payload"])
            if not parts:
                continue
            owner, spans = resolve(np.concatenate(parts))
            order = np.argsort(owner, kind="stable")
            owner, spans = owner[order], spans[order]
            for pid, a, z in _runs(owner):
                yield pa.RecordBatch.from_arrays([pa.array([int(pid)], pa.int64()), pa.array([spans[a:z].tobytes()], pa.binary())], ["pid", "payload"])

    with scratch(spark):
        lists = written(shared.groupBy("pid").agg(F.collect_list("payload").alias("payloads")), "lists")
        suffixes = table.select("pid", "block", "data").join(lists, "pid").mapInArrow(cut, "bucket long, pid long, data binary")
        gone = suffixes.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, "pid long, payload binary").groupBy("pid").agg(F.collect_list("payload").alias("payloads"))
        gone = written(gone, "gone", lasting=True)

    # 5. Back to the blocks.
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                number, block = batch.column("block")[n].as_py(), _block(batch.column("data")[n].as_py())
                spans = np.concatenate([np.zeros(0, SPAN), *(np.frombuffer(p, SPAN) for p in batch.column("payloads")[n].as_py() or [])])
                spans = spans[spans["block"] == number]
                raw, offsets = raw_bytes(as_text(block.column("_text")))
                away = covered(len(raw), spans["start"].astype(np.int64), spans["end"].astype(np.int64))
                if whole_characters:
                    away = whole(away, raw)
                edge = np.zeros(len(raw) + 1, bool)
                edge[1:-1] = away[1:] != away[:-1]
                edge[offsets] = True  # spans end with their document
                limits = np.flatnonzero(edge)
                inside = limits[:-1][away[limits[:-1]]] if len(raw) else limits[:0]
                upto = limits[1:][away[limits[:-1]]] if len(raw) else limits[:0]
                owner = np.searchsorted(offsets, inside, side="right") - 1
                first = np.searchsorted(owner, np.arange(len(offsets))).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(inside - offsets[owner]), pa.array(upto - offsets[owner])], ["start", "end"])
                left = raw[~away]
                kept_at = np.concatenate([[0], np.cumsum(~away)])[offsets].astype(np.int32)
                kept = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(kept_at), pa.py_buffer(np.ascontiguousarray(left))])
                yield pa.RecordBatch.from_arrays([block.column("_kept"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(first), pairs), kept], ["_kept", "_n", "_spans", "_bytes"])

    joined = table.select("pid", "block", "data").join(gone, "pid", "left").select("block", "data", "payloads")
    out = joined.mapInArrow(finish, f"_kept {kept_type}, _n long, _spans array<struct<start: bigint, end: bigint>>, _bytes binary")
    return out.select("_kept.*", F.col("_n").alias("n_bytes"), F.col("_spans").alias("spans"), F.col("_bytes").alias("kept"))


def _of_buckets(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[list[tuple]]:
    """The rows of each bucket; they come sorted by bucket, so one is held at a time."""
    held, now = [], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *columns)), strict=True):
            if held and bucket != now:
                yield held
                held = []
            now = bucket
            held.append(tuple(row))
    if held:
        yield held


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    if not len(values):
        return []
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return [(int(values[a]), int(a), int(z)) for a, z in zip(starts, np.append(starts[1:], len(values)), strict=True)]


def _distinct(gram: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the least and the greatest document of each."""
    if not len(gram):
        return gram, low, high
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    return gram[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


#: DuckDB SQL of the query, for tables whose ids are neither null nor repeated.
ORACLE = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, length(h) // 2 as n from t),
p as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from n where n >= 50)),
m as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as run_ from (
        select distinct doc_id, unnest(range(i, i + 50)) as i from (select doc_id, i, min(doc_id) over (partition by s) as low from p) where low < doc_id)),
runs as (select doc_id, min(i) as a, max(i) + 1 as z from m group by doc_id, run_),
o as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as was from runs),
k as (select doc_id, count(*) as n_spans, sum(z - a)::bigint as n_removed, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) as kept
      from o join n using (doc_id) group by doc_id)
select n.doc_id, n.n as n_bytes, coalesce(k.n_removed, 0) as n_removed, coalesce(k.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.kept, n.h))) as kept_sha256 from n left join k using (doc_id)
"""
