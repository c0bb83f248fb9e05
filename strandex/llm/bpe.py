"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are counted in Spark, encoded once, and compiled
into a minimal acyclic automaton: words that end alike share their states, and
the number of words that pass below each state gives every word its rank,
under which its ids are stored.  The arrays are written to one file of the
shared folder, which workers memory-map.  Words outside the lexicon are merged
exactly, pair by pair in rank order.  Words are the vocabulary's pre-tokens,
across which it never merges; a bounded memo in front keeps what was looked up
last.

Null and empty texts encode to nothing; very long ones are handled as a whole.
Repeated rows are encoded alike, each in its own row.  An empty corpus gives an
empty lexicon; every word is then merged.  Words that tie in frequency are all
in the lexicon or all out of it.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common

#: Words in the lexicon; words of the memo in front of it; bytes of a word in the lexicon at most.
LEXICON_WORDS, MEMO_WORDS, WORD_BYTES = 131_072, 100_000, 64
#: Symbols of a piece that is merged with a plain list; longer ones use a heap.
SHORT_PIECE, NO_RANK = 64, 1 << 30
#: Pieces merged at once.
MERGE_ROWS = 8192
#: Distinct words a task counts before it passes the counts on; characters of text encoded at once.
COUNT_WORDS, BLOCK_BYTES = 100_000, 1 << 20
#: Fixed value: Unicode's White_Space, as the vocabulary's \\s has it.
_SPACES = "\t\n\v\f\r \x85\xa0  -     　"
#: Letters beside a-z that texts of ASCII and these can be cut with a plain pattern; the pattern, and what rules it out.
_LETTERS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^\t-\r a-z0-9{_LETTERS}]+").findall
_BEYOND = re.compile(rf"[^\x00-\x7F{_LETTERS}]").search


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks, special tokens and the pre-token pattern of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ranks = {tuple(x if isinstance(x, list) else x.split(" ")): i for i, x in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.names = {i: x for x, i in [*self.ids.items(), *self.special.items()]}
        self.id_texts = {i: str(i) for i in self.names}
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(pattern.replace(r"\s", _SPACES)).findall
        self.letters = byte_letters()
        self._tables()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]

    def merge(self, piece: str) -> list[int]:
        """The merges of one pre-token: always the pair of least rank, the leftmost first."""
        part = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        part[-1] += self.suffix
        ranks, n = self.ranks, len(part)
        if n <= SHORT_PIECE:
            rank = [ranks.get(x, NO_RANK) for x in zip(part, part[1:], strict=False)]
            while rank and (least := min(rank)) < NO_RANK:
                i = rank.index(least)
                part[i] += part.pop(i + 1)
                rank.pop(i)
                if i < len(rank):
                    rank[i] = ranks.get((part[i], part[i + 1]), NO_RANK)
                if i:
                    rank[i - 1] = ranks.get((part[i - 1], part[i]), NO_RANK)
            return [self.ids[x] for x in part]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # an older pair at this place
            part[i], part[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [self.ids[x] for x in part if x]

    def _tables(self) -> None:
        ids, start = self.ids, np.full((2, 256), -1, np.int64)
        for b, x in enumerate(self.letters):
            start[0, b], start[1, b] = ids[x], ids[x + self.suffix]
        pairs = sorted((ids[a] << 20 | ids[b], rank, ids[a + b]) for (a, b), rank in self.ranks.items())
        self.start, self.pair = start, np.array([x[0] for x in pairs], np.int64)
        self.pair_rank, self.pair_id = np.array([x[1] for x in pairs], np.int32), np.array([x[2] for x in pairs], np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where(b < 0, -1, a.astype(np.int64) << 20 | b)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NO_RANK), self.pair_id[at]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` of many short pieces at once: one row of symbols each, the leftmost least pair of every row a step."""
        size = np.array([len(x) for x in pieces])
        wide = int(size.max())
        raw = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in pieces), np.uint8).reshape(len(pieces), wide)
        column = np.arange(wide)
        symbols = np.where(column < size[:, None] - 1, self.start[0][raw], np.where(column == size[:, None] - 1, self.start[1][raw], -1)).astype(np.int32)
        ranks = np.full((len(pieces), wide), NO_RANK, np.int32)
        if wide > 1:
            ranks[:, :-1] = self._rank(symbols[:, :-1], symbols[:, 1:])[0]
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            i = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            done = ranks[here, i] >= NO_RANK
            for r, x in zip(rows[done].tolist(), symbols[done].tolist(), strict=True):
                out[r] = x[: x.index(-1)] if x[-1] < 0 else x
            go = ~done
            rows, i, symbols, ranks = rows[go], i[go], symbols[go], ranks[go]
            if not len(rows):
                break
            here = np.arange(len(rows))
            new = self._rank(symbols[here, i], symbols[here, i + 1])[1]
            later = column[None, :] > i[:, None]
            source = np.minimum(column + later, wide - 1)
            tail = symbols[:, -1].copy()
            symbols, ranks = np.take_along_axis(symbols, source, 1), np.take_along_axis(ranks, source, 1)
            symbols[:, -1] = np.where(i == wide - 1, tail, -1)
            ranks[:, -1] = NO_RANK
            symbols[here, i] = new
            right = np.where(i + 1 < wide, symbols[here, np.minimum(i + 1, wide - 1)], -1)
            ranks[here, i] = self._rank(new, right)[0]
            left = i > 0
            ranks[here[left], i[left] - 1] = self._rank(symbols[here[left], i[left] - 1], new[left])[0]
            if (most := int((symbols >= 0).sum(axis=1).max())) < wide // 2:
                wide = most + 1
                column, symbols, ranks = column[:wide], symbols[:, :wide], ranks[:, :wide]
        return out

    def normal(self, text: str) -> str:
        """NFC, then each character's own lower case: sigma has no special form at a word's end."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        text = self.normal(text)
        return self._pieces(text) if _BEYOND(text) else _PLAIN(text)

    def words(self, text: str) -> list:
        """The pre-tokens of a text in order; special tokens as their ids."""
        if "<|" not in text:
            return self.cut(text)
        return [x for part in self.split_special(text) for x in ((self.special[part],) if part in self.special else self.cut(part))]

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` of many pre-tokens: short ones together, by length, long ones each."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        short = [i for i in order if len(pieces[i]) <= SHORT_PIECE]
        for at in range(0, len(short), MERGE_ROWS):
            some = short[at : at + MERGE_ROWS]
            for i, ids in zip(some, self.merge_many([pieces[i] for i in some]), strict=True):
                out[i] = ids
        for i in order[len(short) :]:
            out[i] = self.merge(pieces[i].decode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder the tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


def vocabulary(path: str) -> Vocabulary:
    return common.held("bpe", ("vocabulary", path), lambda: Vocabulary(path))


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """The minimal automaton of the (distinct) words as arrays; incremental over the sorted words.

    ``key`` has the transitions, state and label in one number, ascending; ``skip``
    of a transition is the number of words before those that take it, so the
    skips along a path, plus one for each final state passed, rank the word.
    """
    entries = sorted(entries)
    children: list[dict[int, int]] = [{}]
    final, known = [False], {}
    path: list[tuple[int, int, int]] = []  # parent, label, child

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            key = (final[child], tuple(children[child].items()))
            if (same := known.get(key)) is None:
                known[key] = child
            else:
                children[parent][label] = same
                if child == len(children) - 1:
                    children.pop()
                    final.pop()

    last = b""
    for word, _ in entries:
        shared = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        settle(shared)
        state = path[-1][2] if path else 0
        for label in word[shared:]:
            children.append({})
            final.append(False)
            children[state][label] = new = len(children) - 1
            path.append((state, label, new))
            state = new
        final[state] = True
        last = word
    settle(0)
    order, seen, todo = [], {0}, [0]
    while todo:
        order.append(s := todo.pop())
        for t in children[s].values():
            if t not in seen:
                seen.add(t)
                todo.append(t)
    number = {s: i for i, s in enumerate(order)}
    below: dict[int, int] = {}

    def count(root: int) -> int:
        stack = [root]
        while stack:
            s = stack[-1]
            missing = [t for t in children[s].values() if t not in below]
            if missing:
                stack.extend(missing)
            else:
                below[s] = final[s] + sum(below[t] for t in children[s].values())
                stack.pop()
        return below[root]

    count(0)
    first, label, to, skip = [0], [], [], []
    for s in order:
        passed = int(final[s])
        for x, t in children[s].items():
            label.append(x)
            to.append(number[t])
            skip.append(passed)
            passed += below[t]
        first.append(len(label))
    ids = [x for _, x in entries]
    return {
        "key": np.array([s << 8 | x for s, (lo, hi) in enumerate(zip(first, first[1:], strict=False)) for x in label[lo:hi]], np.int64), "to": np.array(to, np.uint32), "skip": np.array(skip, np.uint32),
        "final": np.array([final[s] for s in order], np.uint8), "offset": np.cumsum([0, *map(len, ids)]).astype(np.uint32), "ids": np.array([i for x in ids for i in x], np.uint32),
    }


class Lexicon:
    """Look-ups in the memory-mapped automaton, many words at once."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.ids, self.offset, self.to, self.skip, self.final = (arrays[k] for k in ("ids", "offset", "to", "skip", "final"))
        self.key = arrays["key"]

    def rank(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those outside."""
        size = np.array([len(x) for x in words], np.int64)
        if not len(self.key) or not len(words):
            return np.full(len(words), -1)
        size[size > WORD_BYTES] = 0  # none is that long
        wide = max(1, int(size.max()))
        raw = np.frombuffer(b"".join(x[:wide].ljust(wide, b"\0") for x in words), np.uint8).reshape(-1, wide)
        rank, state, rows = np.full(len(words), -1), np.zeros(len(words), np.int64), np.flatnonzero(size)
        passed = np.zeros(len(words), np.int64)
        for i in range(wide):
            want = state[rows] << 8 | raw[rows, i]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            rows, at = rows[ok], at[ok]
            passed[rows] += self.skip[at]
            state[rows] = self.to[at]
            ends = size[rows] == i + 1
            last = rows[ends]
            last = last[self.final[state[last]] > 0]
            rank[last] = passed[last]
            rows = rows[~ends]
        return rank

    def get(self, rank: int) -> list[int]:
        return self.ids[self.offset[rank] : self.offset[rank + 1]].tolist()


class Encoder:
    """The lexicon in front of exact merging.

    What is known of a word is (number of ids, ids joined, tokens joined).
    Words of the lexicon stay once looked up; when the memo is full, of the
    others those stay that were met again.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, memo_words: int = MEMO_WORDS):
        self.vocabulary, self.lexicon, self.most = vocabulary, lexicon, memo_words
        self.memo: dict = {}
        self.frequent: dict = {}
        self.again: set = set()

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.vocabulary.id_texts[i] for i in ids]), self.vocabulary.decode(ids)

    def _learn(self, words: list) -> None:
        """Put words or special ids into the memo."""
        self.memo.update((w, self._entry([w])) for w in words if not isinstance(w, str))
        texts = [w for w in words if isinstance(w, str)]
        raw = [w.encode("utf-8", "surrogatepass") for w in texts]
        ranks = self.lexicon.rank(raw).tolist() if self.lexicon else [-1] * len(raw)
        found = {w: self._entry(self.lexicon.get(r)) for w, r in zip(texts, ranks, strict=True) if r >= 0}
        self.frequent.update(found)
        self.memo.update(found)
        rest = [i for i, r in enumerate(ranks) if r < 0]
        for i, ids in zip(rest, self.vocabulary.merge_all([raw[i] for i in rest]), strict=True):
            self.memo[texts[i]] = self._entry(ids)

    def encode_many(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: the number of ids, the ids joined by spaces, and the decoded text."""
        cut = [self.vocabulary.words(x) for x in texts]
        needed = set().union(*cut)
        met = self.memo.keys() & needed
        self.again |= met - self.frequent.keys()
        if len(self.memo) + len(needed) > self.most + len(self.frequent):
            stay = self.again if len(self.again) + len(needed) <= self.most else met
            self.memo = self.frequent | {w: self.memo[w] for w in stay}
            self.again = set()
        self._learn(list(needed - met))
        get, out = self.memo.__getitem__, []
        for words in cut:
            found = list(map(get, words))
            out.append((sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        return self.encode_many([text])[0]


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most ``most``, counted in each task first.

    The least count that is still in is read off the histogram of counts, whose
    bars are single counts up to 1,024 and then the leading ten bits, so a bounded
    number of rows reaches the driver; of a bar that doesn't fit as a whole none
    is taken.
    """

    def count(batches):
        known, seen = vocabulary(path), Counter()
        for _, texts in common.slices(batches, 0):
            for text in texts:
                seen.update(known.cut(text) if "<|" not in text else [w for w in known.words(text) if isinstance(w, str)])
                if len(seen) > COUNT_WORDS:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    def rows(seen):
        found = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        return found.filter(pc.less_equal(pc.binary_length(found.column(0)), WORD_BYTES))

    counted = common.texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted, folder = common.stored(counted, "word-counts")
    bar = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 10, 0)), greatest(length(bin(n)) - 10, 0))")
    least, size = None, 0
    for n, k in sorted(((r.n, r.k) for r in counted.groupBy(bar.alias("n")).agg(F.count("*").alias("k")).collect()), reverse=True):
        if (size := size + k) > most:
            break
        least = n
    found = [r[0] for r in counted.where(F.lit(False) if least is None else F.col("n") >= least).select("word").collect()]
    common.drop(docs.sparkSession, folder)
    return found


def write_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Compile the frequent words, at most ``most``, and write the file; returns its folder."""
    known = vocabulary(path)
    words = [w.encode("utf-8", "surrogatepass") for w in frequent_words(docs, path, most)]
    folder = common.shared_dir(docs.sparkSession, "lexicon")
    common.put_file(folder, "lexicon", compile_lexicon([(w, ids) for w, ids in zip(words, known.merge_all(words), strict=True)]))
    return folder


def encoder(path: str, folder: str) -> Encoder:
    """One for each worker and lexicon."""
    return common.held("bpe", ("encoder", path, folder), lambda: Encoder(vocabulary(path), Lexicon(common.map_file(folder, "lexicon"))))


def encode_documents(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (joined by spaces), decoded; or the SHA-256 of both where ``with_ids`` is false."""
    path = path or default_vocabulary()
    folder = write_lexicon(docs, path, lexicon_words)
    names = ["doc_id", "n_tokens", "ids", "decoded"] if with_ids else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        e = encoder(path, folder)
        for part, values in common.slices(batches, 1, BLOCK_BYTES):
            gc.disable()  # many small tuples and no cycles
            got = e.encode_many(values)
            gc.enable()
            a, b = ([g[1] for g in got], [g[2] for g in got]) if with_ids else ([common.sha_hex(g[1].encode()) for g in got], [common.sha_hex(g[2].encode()) for g in got])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=names)

    return common.texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} string, {names[3]} string")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded from the column ids (joined by spaces)."""
    path = path or default_vocabulary()

    def run(batches):
        names = vocabulary(path).names
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(names[int(i)] for i in (x or "").split()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"), with_ids=False)
