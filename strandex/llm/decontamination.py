"""Benchmark decontamination by a generalised suffix automaton over words.

The test items, normalised to words, go into one generalised suffix automaton
for each block of items.  A block has at most ``BLOCK_WORDS`` words (or one
item); each is written to a file of the shared folder, and a worker holds one at
a time: documents pass the blocks one after the other.  A document's words are
streamed through the automaton; where the longest match is at least a window
long, the window ending there is hit.  Only stretches whose word pairs all occur
in items are streamed: elsewhere no match can reach a window's length, so
skipping them changes nothing.

A null text, of an item or a document, has no words.  An item without words
has no window; one without an id hits, but has no id to report.  Repeated items
or rows each count, and very long texts are streamed as a whole.  No items:
nothing is hit.  No documents: no rows.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common

#: Words in a window.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
COVERAGE = 20
#: Words of the items that one automaton holds.
BLOCK_WORDS = 250_000
#: A-Z to a-z; bytes that are no part of a word to a space; bytes from 0x80 on belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """next, link and length of each state; for each state that of its window, whose items are listed, and the short items that end in it."""

    ids: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    names: list[str | None] = field(default_factory=list)
    pairs: np.ndarray | None = None
    window: dict[int, int] = field(default_factory=dict)
    items: dict[int, list[int]] = field(default_factory=dict)
    short: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    least: int = WINDOW

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, c: int) -> int:
        """Add c after the state ``last``; works for the first item and for later ones."""
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return state

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(c)
        return (to, size + 1) if to is not None else (0, 0)


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> Automaton:
    """The automaton of the items' words."""
    a, kept = Automaton(), []
    for name, text in items:
        if w := words(text):
            kept.append((name, [a.ids.setdefault(x, len(a.ids)) for x in w]))
    for _, w in kept:
        last = 0
        for c in w:
            last = a.extend(last, c)
    a.names = [name for name, _ in kept]
    order = sorted(range(1, len(a.next)), key=a.length.__getitem__)
    for s in order:  # from short to long: the state of a window stands for the longer ones that end with it
        if a.length[s] >= window:
            a.window[s] = a.window.get(a.link[s], s)
    for k, (_, w) in enumerate(kept):
        state = size = 0
        for c in w:
            state, size = a.step(state, size, c)
            if size >= window and k not in (found := a.items.setdefault(a.window[state], []))[-1:]:
                found.append(k)
        if len(w) < window:
            a.short.setdefault(state, []).append((len(w), k))
    for s in order:
        if up := a.short.get(a.link[s]):
            a.short[s] = [*a.short.get(s, []), *up]
    n = max(1, len(a.ids))
    a.pairs = np.unique(np.array([x * n + y for _, w in kept for x, y in zip(w, w[1:], strict=False)], np.int64))
    a.least = min([window, *(len(w) for _, w in kept)])
    return a


def stream(a: Automaton, ids: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans of hit words (from, to exclusive; may overlap) and the items, by place."""
    spans, items, state, size = [], set(), 0, 0
    for i, c in enumerate(ids.tolist()):
        state, size = a.step(state, size, c) if c >= 0 else (0, 0)
        if size >= window:
            items.update(a.items[a.window[state]])
            spans.append((i + 1 - window, i + 1))
        for n, item in a.short.get(state, ()) if size else ():
            if n <= size:
                items.add(item)
                spans.append((i + 1 - n, i + 1))
    return spans, items


def _stretches(a: Automaton, ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words in which a match could be as long as the shortest window."""
    if a.least <= 1:
        good = np.concatenate(([False], ids >= 0, [False]))
        extra = 0
    else:
        x, y = ids[:-1], ids[1:]
        key = np.where((x >= 0) & (y >= 0), x * len(a.ids) + y, -1)
        at = np.minimum(np.searchsorted(a.pairs, key), max(0, len(a.pairs) - 1))
        good = np.concatenate(([False], (a.pairs[at] == key) if len(a.pairs) else np.zeros(len(key), bool), [False]))
        extra = 1
    turn = np.diff(good.astype(np.int8))
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + extra
    long = end - start >= a.least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def scan(automata: list[Automaton], values: list[str | None], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, merged hit spans (in words), the item ids found."""
    raw = [(x or "").encode("utf-8", "surrogatepass").translate(_TABLE) for x in values]
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = []
    for lo, hi in common.chunked(raw):
        flat = b" \x01 ".join(raw[lo:hi]).split()  # \x01 is in no word
        known = [a.ids.get for a in automata] or [{}.get]
        per_block = [np.fromiter((get(w, -1) for w in flat), np.int64, len(flat)) for get in known]
        ends = np.append([i for i, w in enumerate(flat) if w == b"\x01"] if hi - lo > 1 else [], len(flat)).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1] + 1))
        found: dict[int, tuple[list, set]] = {}
        for a, ids in zip(automata, per_block, strict=False):
            for s, e in _stretches(a, ids) if len(flat) else ():
                spans, items = stream(a, ids[s:e], window)
                if spans:
                    d = int(np.searchsorted(starts, s, "right")) - 1
                    mine = found.setdefault(d, ([], set()))
                    mine[0].extend((s + x - int(starts[d]), s + y - int(starts[d])) for x, y in spans)
                    mine[1].update(a.names[k] for k in items)
        for d, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            spans, items = found.get(d, ([], ()))
            out.append((e - s, merge(spans), sorted(x for x in items if x is not None)))
    return out


def write_automata(items: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> tuple[str, int]:
    """Write one automaton for each block of the stated test items (columns item_id, text); the driver holds one block at a time."""
    folder, blocks = common.shared_dir(items.sparkSession, "automata"), 0
    block: list[tuple[str | None, str | None]] = []

    def write():
        common.put_file(folder, f"block-{blocks}", {"pickle": np.frombuffer(pickle.dumps(build(block, window)), np.uint8)})

    size = 0
    for name, text in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(words(text))
        if size and size + n > block_words:
            write()
            block, size, blocks = [], 0, blocks + 1
        block.append((name, text))
        size += n
    write()
    return folder, blocks + 1


def automaton(folder: str, block: int) -> Automaton:
    """One for each worker; another block takes its place."""
    if ("automaton", folder, block) not in common.kept("decontamination"):
        common.kept("decontamination").clear()
    return common.held("decontamination", ("automaton", folder, block), lambda: pickle.loads(common.map_file(folder, f"block-{block}")["pickle"].tobytes()))


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and COVERAGE * n_hit >= n_words


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
#: What the blocks so far have found.
_FOUND = "strandex_n_words long, strandex_items array<string>, strandex_spans array<struct<start:long,stop:long>>"


def scanned(docs: DataFrame, items: DataFrame, finish, schema: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``finish`` of the documents and what was found in them: of a batch's columns, its texts, and number of words, merged hit spans (in words) and item ids of each."""
    folder, blocks = write_automata(items, block_words, window)
    at, columns = docs.columns.index("text"), len(docs.columns)
    between = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, {_FOUND}"

    def scan_block(block: int):
        def run(batches):
            for batch, values in common.slices(batches, at):
                got = scan([automaton(folder, block)], values, window)
                spans, names = [g[1] for g in got], [g[2] for g in got]
                if block:
                    spans = [merge([*((x["start"], x["stop"]) for x in old), *new]) for old, new in zip(batch.column(columns + 2).to_pylist(), spans, strict=True)]
                    names = [sorted({*old, *new}) for old, new in zip(batch.column(columns + 1).to_pylist(), names, strict=True)]
                if block + 1 == blocks:
                    yield finish(batch.columns[:columns], batch.schema, values, [n for n, _, _ in got], spans, names)
                    continue
                new = [pa.array([n for n, _, _ in got], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([[{"start": s, "stop": e} for s, e in x] for x in spans], _SPANS)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *new], names=[*batch.schema.names[:columns], "strandex_n_words", "strandex_items", "strandex_spans"])

        return run

    last = None
    for block in range(blocks):
        docs = docs.mapInArrow(scan_block(block), between if block + 1 < blocks else schema)
        if block + 1 < blocks:
            docs, written = common.stored(docs, "decontamination")
            if last:
                common.drop(docs.sparkSession, last)
            last = written
    return docs


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted), spans (merged hit spans in words), contaminated."""

    def finish(columns, _, __, n_words, spans, names):
        hit = [sum(e - s for s, e in x) for x in spans]
        out = [pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([[{"start": s, "stop": e} for s, e in x] for x in spans], _SPANS), pa.array([contaminated(n, h) for n, h in zip(n_words, hit, strict=True)], pa.bool_())]
        return pa.RecordBatch.from_arrays([columns[0], *out], names=["doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated"])

    return scanned(common.texts(docs), items, finish, "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,stop:long>>, contaminated boolean", window, block_words)


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, nor what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return "".join([*out, text[done:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without the contaminated ones; shorter hit spans are cut from the texts of the others.

    Columns are those of ``docs``; a document without a hit is returned as it is.
    """
    at = docs.columns.index("text")

    def finish(columns, schema, values, n_words, spans, _):
        keep = [not contaminated(n, sum(e - s for s, e in x)) for n, x in zip(n_words, spans, strict=True)]
        new = [remove(x, found) if found else x for x, found in zip(values, spans, strict=True)]
        return pa.RecordBatch.from_arrays([*columns[:at], pa.array(new, schema.field(at).type), *columns[at + 1 :]], names=schema.names[: len(columns)]).filter(pa.array(keep, pa.bool_()))

    return scanned(docs, items, finish, docs.schema, window, block_words)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


#: The same by windows of words as rows, for DuckDB.
ORACLE_SQL = r"""
with low as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
), doc_words as (
  select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from low
), item_words as (
  select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), windows as (
  select distinct item_id, least(len(w), 13) n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from item_words where len(w) > 0)
), lengths as (select distinct n from windows
), doc_windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from doc_words, lengths where len(w) >= n)
), found as (
  select d.doc_id, d.n, d.i, x.item_id from doc_windows d join windows x on d.n = x.n and d.s = x.s
), hit as (
  select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from found) group by doc_id
), items as (
  select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct item_id)), ',') ids from found group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(h.n_hit, 0) as bigint) n_hit, cast(coalesce(i.n_items, 0) as bigint) n_items,
  sha256(coalesce(i.ids, '')) items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) contaminated
from doc_words d left join hit h using (doc_id) left join items i using (doc_id)
"""
