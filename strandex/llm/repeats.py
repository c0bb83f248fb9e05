"""Removal of repeated byte strings by a column-wise multi-string suffix sort.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
goes.  A column-wise construction inserts, round by round from the right, one
symbol of every string of a collection in front of its suffix, and keeps the
order of the suffixes (and with it the Burrows-Wheeler column: the symbols in
that order) and the common prefixes of neighbours up to date.  Its rounds are as
many as the longest string is long and each passes over the collection, so whole
documents can't be its strings; what has to be compared is cut out first:

1.  Each window of ``LENGTH`` bytes has an anchor: its 32-byte string of least
    hash, the leftmost of equals.  Equal windows have equal anchors at equal
    offsets.  Consecutive windows with one anchor make a segment.
2.  Segments meet under their anchor's hash.  An anchor that occurs once is
    done; segments whose bytes are equal (by two 64-bit hashes) are covered as a
    whole, and one of them stays to stand for them.
3.  Segments that share an anchor but differ are strings of a collection,
    aligned at the anchor; only suffixes that start in one column can share a
    window, so the collection's columns are sorted one after the other.  They
    are kept in an external file that is written and read in sequence, a column
    a round.
    Neighbours whose common prefix reaches ``LENGTH`` share a window there.
4.  An anchor with more than ``HOT`` differing segments isn't sorted in one
    task: its windows go by their own hashes, each task passing on one of each.

Passages are found in the same way over words instead of bytes: a text becomes
a symbol of four bytes for each word (a run of bytes outside ASCII white space),
and strings of more than 50 words that occur elsewhere are reported, whatever
their length in bytes.  They are marked, not removed.

Null texts count as empty; texts shorter than ``LENGTH`` bytes lose nothing;
equal rows are copies of each other; very long texts go in overlapping pieces.
Judged on the input: what is removed still counts.  No documents: no rows.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common

#: Bytes of a repeated string; bytes of an anchor; differing segments of one anchor that one task sorts.
LENGTH, GRAM, HOT = 400, 32, 20_000
#: Words of a repeated passage; bytes that stand for a word.
PASSAGE, SYMBOL = 51, 4
#: Segments sorted together; bytes of text in which anchors are sought at once; bytes of one text handled as a whole; columns written together.
COLLECTION, CHUNK, PIECE, COLUMNS = 16_384, 2 << 20, 8 << 20, 64
_SPACE = re.compile(rb"[\x20\t-\r]")
_PLACE = np.uint64(24)


def text_key(raw: bytes) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a text."""
    x = xxhash.xxh3_128_intdigest(raw)
    return tuple(y - (1 << 64) if y >> 63 else y for y in (x >> 64, x & (1 << 64) - 1))


def plain(raw: list[bytes]) -> list[bytes]:
    return raw


def word_symbols(raw: list[bytes]) -> list[bytes]:
    """Four bytes of each word's hash for each text."""
    out = []
    for x in raw:
        found, at = [], 0
        while at < len(x):  # a very long text by pieces that end at white space
            end = _SPACE.search(x, at + PIECE)
            stop = end.start() if end else len(x)
            found.append((common.word_hashes(np.frombuffer(x[at:stop], np.uint8))[2] >> np.uint64(32)).astype("<u4").tobytes())
            at = stop
        out.append(b"".join(found))
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: running minima of blocks from both ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of the texts: text, begin and end (bytes), anchor (offset from begin), h (anchor's hash), digest (of the bytes)."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    first = np.cumsum(size) - size
    names = ("text", "begin", "end", "anchor", "h", "digest")
    if len(data) < length or not (size >= length).any():
        return {k: np.zeros(0, np.uint64 if k in ("h", "digest") else np.int64) for k in names}
    sums = common.running_hash(data)
    place = np.arange(len(data) - gram + 1)
    h = common.span_hash(sums, place, place + gram)
    # the upper 40 bits of the hash, then the place: the least is the leftmost of the least hash
    least = sliding_least((h >> _PLACE << _PLACE) | place.astype(np.uint64), length - gram + 1)
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), size)[: len(at)]
    fits = np.arange(len(at)) + length <= (first + size)[owner]
    starts = np.flatnonzero(fits)
    at, owner = at[starts], owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    begin, end = starts[run], starts[np.append(run[1:], len(starts)) - 1] + length
    text, anchor = owner[run], at[run] - begin
    digest = common.mix(common.span_hash(sums, begin, end) + anchor.astype(np.uint64))
    return {"text": text, "begin": begin - first[text], "end": end - first[text], "anchor": anchor, "h": h[at[run]], "digest": digest}


def column_sort(strings: list[bytes], anchors: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each string the spans covered by windows that another string of its group has at the same offset from the anchor.

    ``groups`` must be ascending.  Rounds go from the rightmost column to the
    leftmost; ``order`` holds the strings by group and suffix, ``common_`` the
    common prefix of each suffix with the one before it.
    """
    m = len(strings)
    size = np.array([len(x) for x in strings], np.int64)
    left = int(anchors.max())
    wide = int((size - anchors).max()) + left
    shift = left - anchors
    with tempfile.TemporaryFile() as file:  # the collection's columns from the last to the first; -1: none
        for hi in range(wide, 0, -COLUMNS):
            lo = max(0, hi - COLUMNS)
            part = np.full((m, hi - lo), -1, np.int16)
            for k, (x, at) in enumerate(zip(strings, shift.tolist(), strict=True)):
                if (some := x[max(0, lo - at) : max(0, hi - at)]):
                    begin = max(at, lo) - lo
                    part[k, begin : begin + len(some)] = np.frombuffer(some, np.uint8)
            file.write(np.ascontiguousarray(part.T[::-1]).tobytes())
        file.seek(0)
        order, common_ = np.arange(m), np.zeros(m, np.int32)
        group_key = groups.astype(np.int64) << 9
        met = np.zeros((max(0, wide - length + 1), m), bool)
        for j in range(wide - 1, -1, -1):
            symbol = np.frombuffer(file.read(2 * m), np.int16)
            key = (group_key + symbol)[order]
            by = np.argsort(key, kind="stable")  # places in the old order
            key = key[by]
            same = np.zeros(m, bool)
            same[1:] = (key[1:] == key[:-1]) & (key[1:] & 511 != 511)
            value = np.zeros(m, np.int32)
            pair = np.flatnonzero(same)
            a, b = by[pair - 1] + 1, by[pair] + 1
            near = b - a == 1
            value[pair[near]] = common_[a[near]] + 1
            if not near.all():
                bounds = np.column_stack((a[~near], b[~near])).reshape(-1)
                value[pair[~near]] = np.minimum.reduceat(np.append(common_, np.int32(0)), bounds)[::2] + 1
            order, common_ = order[by], value
            if j < len(met):
                long = np.flatnonzero(common_ >= length)
                met[j, order[long]] = True
                met[j, order[long - 1]] = True
    edge = np.zeros((1, m), np.int8)
    turn = np.diff(np.concatenate((edge, met.astype(np.int8), edge)), axis=0).T
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    who, start = np.nonzero(turn == 1)
    _, stop = np.nonzero(turn == -1)
    for k, s, e in zip(who.tolist(), (start - shift[who]).tolist(), (stop - shift[who] - 1 + length).tolist(), strict=True):
        out[k].append((s, e))
    return out


_SEGMENT = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("digest", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("anchor", pa.int64())])
_SEGMENT_SQL = "kind int, h long, digest long, t1 long, t2 long, begin long, end long, anchor long"
#: Kinds of segment rows: covered as a whole; to be compared; to be compared by windows.
COVERED, DIFFERS, CROWDED = 0, 1, 2


def _rows(kind, h, digest, t1, t2, begin, end, anchor):
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(kind), len(h)) if np.isscalar(kind) else kind.astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (h, digest, t1, t2, begin, end, anchor))], schema=_SEGMENT)


def _once(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Each span of each text once."""
    _, _, t1, t2, begin, end, _ = columns
    order = np.lexsort((end, begin, t2, t1))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (t1, t2, begin, end):
        new[1:] |= np.diff(x[order]) != 0
    return [x[order[new]] for x in columns]


def _find_segments(length: int, view):
    def run(batches):
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for lo, hi in common.chunked(raw, CHUNK):
                for x in _in_pieces(raw[lo:hi], length, view):
                    yield from x

    return run


def _in_pieces(raw: list[bytes], length: int, view=plain, step: int = PIECE):
    """Segment rows of some texts; a text too long for one pass goes in overlapping pieces."""
    times = Counter(raw)
    raw = list(times)
    keys = np.array([text_key(x) for x in raw], np.int64).reshape(-1, 2)
    pieces, owner, offset = [], [], []
    viewed = view(raw)
    copied = np.array([k for k, (x, y) in enumerate(zip(raw, viewed, strict=True)) if times[x] > 1 and len(y) >= length], np.int64)
    if len(copied):  # copies cover each other; one of them goes on
        none, size = np.zeros(len(copied), np.int64), np.array([len(viewed[k]) for k in copied])
        yield [_rows(COVERED, none, none, keys[copied, 0], keys[copied, 1], none, size, none)]
    for k, x in enumerate(viewed):
        for at in range(0, max(1, len(x) - length + 1), step):
            pieces.append(x[at : at + step + length - 1])
            owner.append(k)
            offset.append(at)
    for lo, hi in common.chunked(pieces, step + length):
        s = segments(pieces[lo:hi], length)
        if not len(s["h"]):
            continue
        of, off = np.array(owner[lo:hi])[s["text"]], np.array(offset[lo:hi])[s["text"]]
        begin, end = s["begin"] + off, s["end"] + off
        order = np.lexsort((s["digest"], s["h"]))
        same = np.zeros(len(order), bool)
        h, d = s["h"][order], s["digest"][order]
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        twice = same.copy()
        twice[:-1] |= same[1:]
        one, full = order[~same], order[twice]  # one of each goes on; what occurs twice is covered
        columns = (s["h"], s["digest"], keys[of, 0], keys[of, 1], begin, end, s["anchor"])
        yield [_rows(DIFFERS, *(x[one] for x in columns)), _rows(COVERED, *_once([x[full] for x in columns]))]


def _meet(hot: int):
    """Rows sorted by h and digest: which segments are covered, and which have to be compared."""

    def run(batches):
        held: list[np.ndarray] | None = None
        crowded: int | None = None  # the anchor whose first rows have already gone out as crowded

        def out(c):
            nonlocal crowded
            h, digest = c[0], c[1]
            start = common.run_starts(h)
            size = np.diff(np.append(start, len(h)))
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (digest[1:] == digest[:-1])
            twice = same.copy()
            twice[:-1] |= same[1:]
            kinds = np.add.reduceat((~same).astype(np.int64), start)
            many = np.repeat((kinds > hot) | (h[start] == (crowded if crowded is not None else h[start] + 1)), size)
            differ = (np.repeat(kinds > 1, size) | many) & ~same
            yield _rows(COVERED, *_once([x[twice] for x in c]))
            yield _rows(np.where(many[differ], CROWDED, DIFFERS), *(x[differ] for x in c))

        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 8)]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            start = common.run_starts(c[0])
            last = int(start[-1]) if len(start) else 0
            if last:
                yield from out([x[:last] for x in c])
            held = [x[last:] for x in c]
            if len(held[0]) > 4 * (hot + 1) and len(np.unique(held[1])) > hot:
                # a crowded anchor goes out in parts; the last digest stays so that its copies meet
                cut = int(np.searchsorted(held[1], held[1][-1], "left"))
                if cut:
                    part = [x[:cut] for x in held]
                    held = [x[cut:] for x in held]
                    crowded = int(part[0][0])
                    yield from out(part)
        if held is not None and len(held[0]):
            yield from out(held)

    return run


_CUT = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("piece", pa.binary()), ("t1", pa.int64()), ("t2", pa.int64()), ("begin", pa.int64()), ("anchor", pa.int64())])
_CUT_SQL = "key long, check long, piece binary, t1 long, t2 long, begin long, anchor long"


def _cut_out(length: int, view):
    """Bytes of the segments to compare; of crowded ones the hashes of the windows (piece is null), one of each in a task's batch."""

    def run(batches):
        for batch in batches:
            keys, checks, pieces, one, two, begins, anchors = ([] for _ in range(7))
            wide: list[np.ndarray] = []
            for text, t1, t2, needs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                (raw,) = view([text])
                for need in needs:
                    s, e = need["begin"], need["end"]
                    if need["kind"] == DIFFERS:
                        keys.append(need["h"])
                        checks.append(0)
                        pieces.append(raw[s:e])
                        one.append(t1)
                        two.append(t2)
                        begins.append(s)
                        anchors.append(need["anchor"])
                    else:
                        data = np.frombuffer(raw[s:e], np.uint8)
                        at = np.arange(len(data) - length + 1)
                        h = common.hash_spans(data, at, at + length)
                        g = common.hash_spans(255 - data, at, at + length)
                        n = len(at)
                        wide.append(np.column_stack((h.view(np.int64), g.view(np.int64), np.full(n, t1), np.full(n, t2), at + s)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(pieces, pa.binary()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(begins, pa.int64()), pa.array(anchors, pa.int64())], schema=_CUT)
            if wide:
                w = np.concatenate(wide)
                w = w[np.lexsort((w[:, 1], w[:, 0]))]
                start = np.ones(len(w), bool)
                start[1:] = (w[1:, :2] != w[:-1, :2]).any(axis=1)
                again = ~start
                met = again.copy()
                met[:-1] |= again[1:]
                # anchor -2: this window has met its equal already; one of each goes on
                keep = start | met
                w, mark = w[keep], np.where(met[keep], np.where(start[keep], -2, -3), -1)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.nulls(len(w), pa.binary()), *(pa.array(w[:, i].copy()) for i in (2, 3, 4)), pa.array(mark)], schema=_CUT)

    return run


_HIT = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _hits(t1, t2, begin, end):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (t1, t2, begin, end)], schema=_HIT)


def _compare(length: int):
    """Rows sorted by key: collections of segments are sorted by columns, windows are matched by their hashes."""

    def collection(rows):
        keys = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
        spans = column_sort([r[2] for r in rows], np.array([r[6] for r in rows], np.int64), group, length)
        found = [(r[3], r[4], r[5] + s, r[5] + e) for r, x in zip(rows, spans, strict=True) for s, e in x]
        if found:
            yield _hits(*zip(*found, strict=True))

    def run(batches):
        rows: list[tuple] = []
        last = None  # the last window and whether it has been reported
        for batch in batches:
            windows: list[tuple] = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if r[2] is None:
                    windows.append(r)
                    continue
                if len(rows) >= COLLECTION and r[0] != rows[-1][0]:
                    yield from collection(rows)
                    rows = []
                rows.append(r)
            found = []
            for r in windows:
                if last is not None and last[0][:2] == r[:2]:
                    if not last[1]:
                        found.append(last[0])
                    found.append(r)
                    last = (r, True)
                else:
                    if r[6] <= -2:
                        found.append(r)
                    last = (r, r[6] <= -2)
            if found:
                yield _hits([r[3] for r in found], [r[4] for r in found], [r[5] for r in found], [r[5] + length for r in found])
        if rows:
            yield from collection(rows)

    return run


def _keyed(once: bool):
    """Raw texts with their keys; ``once``: each text once a task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = [text_key(x) for x in batch.column(1).to_pylist()]
            k = np.array(keys, np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=["doc_id", "raw", "t1", "t2"])
            if once:
                new = [x not in seen and not seen.add(x) for x in keys]
                out = out.filter(pa.array(new, pa.bool_()))
            yield out

    return run


_RUNS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("kind", pa.int32()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _merge_runs(kind: int):
    """Spans sorted by text and begin, merged: a row for each text."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4  # the spans of the last text so far

        def out(c):
            t1, t2, begin, end = c
            new = np.ones(len(t1), bool)
            new[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
            group = np.cumsum(new) - 1
            reach = np.maximum.accumulate((group << 40) + end) - (group << 40)  # the furthest end so far of the text
            fresh = new.copy()
            fresh[1:] |= begin[1:] > reach[:-1]
            at = np.flatnonzero(fresh)
            stop = reach[np.append(at[1:], len(t1)) - 1]
            texts = np.flatnonzero(new[at])
            spans = pa.StructArray.from_arrays([pa.array(begin[at]), pa.array(stop)], ["begin", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(texts, len(at)).astype(np.int32)), spans)
            return [x[at] for x in (t1, t2)] + [begin[at], stop], pa.RecordBatch.from_arrays([pa.array(t1[at][texts]), pa.array(t2[at][texts]), pa.array(np.full(len(texts), kind, np.int32)), lists], schema=_RUNS)

        for batch in batches:
            c = [np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(held)]
            if not len(c[0]):
                continue
            last = int(np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]))[-1]) + 1 if ((c[0] != c[0][-1]) | (c[1] != c[1][-1])).any() else 0
            if last:
                yield out([x[:last] for x in c])[1]
            held = out([x[last:] for x in c])[0]
        if len(held[0]):
            yield out(held)[1]

    return run


def _repeated(texts: DataFrame, length: int, hot: int, view, kind: int) -> DataFrame:
    """t1, t2, kind, spans: the merged spans of each text's view that are covered by repeated strings; written to a shared folder."""
    spark = texts.sparkSession
    n = common.parts(spark)
    found, one = common.stored(texts.select("raw").mapInArrow(_find_segments(length, view), _SEGMENT_SQL), "repeats-segments")
    met = found.where(f"kind = {DIFFERS}").repartition(n, "h").sortWithinPartitions("h", "digest").mapInArrow(_meet(hot), _SEGMENT_SQL)
    met, two = common.stored(met, "repeats-met")
    common.release(spark)
    by_text = texts.mapInArrow(_keyed(True), "doc_id long, raw binary, t1 long, t2 long")
    needs = met.where(f"kind <> {COVERED}").groupBy("t1", "t2").agg(F.collect_list(F.struct("kind", "h", "begin", "end", "anchor")).alias("needs"))
    pieces = by_text.join(needs.hint("shuffle_hash"), ["t1", "t2"]).select("raw", "t1", "t2", "needs").mapInArrow(_cut_out(length, view), _CUT_SQL)
    compared = pieces.repartition(n, "key").sortWithinPartitions("key", "check").mapInArrow(_compare(length), "t1 long, t2 long, begin long, end long")
    whole = found.union(met).where(f"kind = {COVERED}").select("t1", "t2", "begin", "end")
    runs = whole.union(compared).repartition(n, "t1", "t2").sortWithinPartitions("t1", "t2", "begin").mapInArrow(_merge_runs(kind), "t1 long, t2 long, kind int, spans array<struct<begin:long,end:long>>")
    runs, _ = common.stored(runs, "repeats-runs")
    for folder in (one, two):
        common.drop(spark, folder)
    del found, met, by_text, needs, pieces, compared, whole
    common.release(spark)
    return runs


def covered(docs: DataFrame, length: int = LENGTH, hot: int = HOT, passage: int = PASSAGE) -> DataFrame:
    """doc_id, raw (the text's bytes) and ``runs``: for kind 0 the spans of bytes, for kind 1 those of word symbols' bytes (null if none)."""
    texts = common.texts(docs).select("doc_id", F.col("text").cast("binary").alias("raw"))
    runs = _repeated(texts, length, hot, plain, 0).union(_repeated(texts, SYMBOL * passage, hot, word_symbols, 1))
    of_text = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("kind", "spans")).alias("runs"))  # two at most
    return texts.mapInArrow(_keyed(False), "doc_id long, raw binary, t1 long, t2 long").join(of_text.hint("shuffle_hash"), ["t1", "t2"], "left").select("doc_id", "raw", "runs")


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs), kept (the remaining bytes), passages (runs of words in repeated passages)."""

    def words(spans):
        runs = ((-(-s["begin"] // SYMBOL), s["end"] // SYMBOL) for s in spans)
        return [{"begin": a, "end": b} for a, b in runs if b - a >= passage]

    def run(batches):
        for batch in batches:
            values, runs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in common.chunked(values):
                out = []
                for raw, found in zip(values[lo:hi], runs[lo:hi], strict=True):
                    of = {x["kind"]: x["spans"] for x in found or ()}
                    spans = of.get(0, [])
                    edges = [0, *(y for s in spans for y in (s["begin"], s["end"])), len(raw)]
                    out.append((len(raw), spans, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), words(of.get(1, ()))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), _SPANS, pa.binary(), _SPANS)))], names=["doc_id", "n_bytes", "spans", "kept", "passages"])

    return covered(docs, length, hot, passage).mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary, passages array<struct<begin:long,end:long>>")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        total("passages").alias("n_passage_words"), F.size("passages").cast("long").alias("n_passages"),
    )
