"""Scores of texts under a trigram model held in an Elias-Fano trie.

All pairs and triples of the training texts are kept. Three passes over the texts:

1. Words are counted and numbered, frequent ones first by the power of two in their
   count, which keeps the numbers of most tokens short: sorted hashes (Elias-Fano) in
   shards by hash.
2. Pairs (b, w) are counted and dealt to slots by b; each task builds the pair level
   of its slots.
3. Every token is dealt with its two words of context (a, b) to the slot of b, for
   training and for scoring in one shuffle. The slot's task counts the triples, builds
   the triple level, and answers the slot's tokens from the trie: from its own triples
   and from the pair file of the same slot. What leaves it is a sum for each text.

A slot holds about SLOT_TOKENS tokens and is all that a task opens of a level. A word
with more tokens than that is split by a (pairs: by w), so frequent words burden no
single task. Blocks of tokens travel as packed columns, distinct triples once a block.

Of each level a file holds the sorted words b (Elias-Fano); for triples the words a
of each b; and the words w of each context. Such children are kept as monotone
pointers to the range of each parent (Elias-Fano) and the children of all ranges,
each range's numbers offset by the last value of the range before so that all is
monotone (Elias-Fano). Beside them lie discounted probabilities in one byte each and
back-off weights in one (pairs: four). An n-gram is found by its parent's position,
the parent's range, and a successor search relative to the range. Files lie in the shared folder and are
mapped into memory where that is mounted, else read.

Probabilities interpolate with absolute discounting:

    p(w|h) = (c(hw) - D) / c(h) [if seen] + g(h) p(w|shorter h),  g(h) = D * successors(h) / c(h)

down to the base (c + 0.1) / (N + 0.1 (V + 1)). Codes round down, so that
probabilities never sum to more than 1. A text is read from the mark that ends the
text before.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, encode
from .shared import Words, blocks, bounded_batches, keep, mix64, shared_folder

#: Tokens of a slot and words of a vocabulary shard, about.
SLOT_TOKENS, SHARD_WORDS = 1_500_000, 1_000_000
#: Slots that the successors of one frequent word are dealt to at most; they are no
#: more than there are words.
MOST_SPLITS = 64
DISCOUNT = 0.75
SMOOTH = 0.1
_END = np.uint64(0xE5D1F3A7C9B8264D)
#: Bytes of text that are handled together, and counts that wait in a task.
BLOCK, WAITING = 6 << 20, 1 << 20
#: Scores are summed as whole numbers of this size, so that no order of tasks shows.
UNIT = 1e9


# --- token sequences -----------------------------------------------------------


class Sequence:
    """Hashes of the tokens of a batch: per text its words and the end mark."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        n, docs = len(words.doc), len(texts)
        place = np.arange(n) + words.doc
        self.hashes = np.full(n + docs, _END, np.uint64)
        self.hashes[place] = words.hashes()
        self.doc = np.repeat(np.arange(docs), np.diff(words.first) + 1)
        self.within = np.arange(n + docs) - (words.first[:-1] + np.arange(docs))[self.doc]

    def contexts(self, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids one and two places back (the end mark in front of a text; -1 beyond)."""
        one = np.where(self.within > 0, np.roll(ids, 1), end_id)
        two = np.where(self.within > 1, np.roll(ids, 2), np.where(self.within == 1, end_id, -1))
        return one, two


# --- packed columns ---------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns by byte planes, compressed."""
    head, body = [len(columns)], []
    for column in columns:
        head += [len(column), column.dtype.itemsize]
        body.append(np.ascontiguousarray(column.view(np.uint8).reshape(len(column), column.dtype.itemsize).T).tobytes())
    plain = b"".join(body)
    return np.array([*head, len(plain)], np.int64).tobytes() + pa.compress(plain, "zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    head = np.frombuffer(packed, np.int64, 2 * n + 2)[1:]
    plain = pa.decompress(packed[16 * n + 16 :], int(head[-1]), "zstd", asbytes=True)
    out, at = [], 0
    for size, width in head[:-1].reshape(n, 2):
        planes = np.frombuffer(plain, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"i{width}").ravel())
        at += size * width
    return out


def _gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.int64(0))


# --- files of the model ----------------------------------------------------------


def _store(folder: str):
    """Filesystem and path of a folder given by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if urlparse(folder).scheme else f"file://{folder}")


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of 64-byte aligned arrays; it appears whole or not at all, so a task
    that runs twice does no harm."""
    head, body = [], io.BytesIO()
    for key, array in arrays.items():
        body.write(b"\0" * (-body.tell() % 64))
        head.append(f"{key}:{array.dtype.str}:{body.tell()}:{len(array)}")
        body.write(array.tobytes())
    line = ";".join(head).encode()
    line += b" " * (-(len(line) + 8) % 64)
    system, path = _store(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(len(line).to_bytes(8, "little") + line + body.getvalue())
    system.move(part, f"{path}/{name}")


def _read(folder: str, name: str) -> dict[str, np.ndarray]:
    """Mapped into memory where the folder is mounted, else read."""
    from pyarrow import fs

    system, path = _store(folder)
    if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return {}
    if isinstance(system, fs.LocalFileSystem):
        data = np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r")).view(np.ndarray)
    else:
        with system.open_input_file(f"{path}/{name}") as file:
            data = np.frombuffer(file.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for entry in data[8 : 8 + size].tobytes().decode().strip().split(";"):
        key, kind, at, n = entry.split(":")
        start = 8 + size + int(at)
        out[key] = data[start : start + int(n) * np.dtype(kind).itemsize].view(kind)
    return out


def _sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in ("head", "low", "high", "rank")})


def _named(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in parts.items()}


#: Values of the one-byte codes: steps of 0.03 in log10 down to 1e-4, then steps that
#: reach 1e-19, below the share of any 64-bit count.
_VALUE = 10.0 ** -np.concatenate([np.arange(134) * 0.03, 3.99 + np.arange(1, 123) * 0.125])
_FALLING = -np.log10(_VALUE)


def _code(p: np.ndarray) -> np.ndarray:
    """The code of the largest value that is not above p."""
    return np.minimum(np.searchsorted(_FALLING, -np.log10(p) - 1e-12, "left"), 255).astype(np.uint8)


def _children(first: np.ndarray, child: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Children of parents whose ranges begin at first, ascending in each range."""
    sizes = np.diff(np.append(first, len(child)))
    tops = np.cumsum(child[first + sizes - 1] + 1)  # each range starts above the one before
    relative = child + np.repeat(np.concatenate([[0], tops[:-1]]), sizes)
    return {**_named(f"{name}.pointer", encode(np.append(first, len(child)), len(child) + 1)), **_named(f"{name}.child", encode(relative, int(tops[-1]) + 1))}


class Children:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.pointer, self.child = _sequence(arrays, f"{name}.pointer"), _sequence(arrays, f"{name}.child")

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Position of each child of a parent's position; -1 if either is absent."""
        out = np.full(len(parent), -1, np.int64)
        asked = np.flatnonzero((parent >= 0) & (child >= 0))
        own, index = np.unique(parent[asked], return_inverse=True)
        begin, end = self.pointer.get(own).astype(np.int64), self.pointer.get(own + 1).astype(np.int64)
        base = np.where(begin > 0, self.child.get(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
        target = base[index] + child[asked].astype(np.uint64)
        found = self.child.successor(target)
        inside = found < end[index]
        inside[inside] = self.child.get(found[inside]) == target[inside]
        out[asked[inside]] = found[inside]
        return out


class Level:
    """Words with their successors, or pairs with theirs, in one file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        if arrays:
            self.words, self.successors = _sequence(arrays, "word"), Children(arrays, "next")
            self.before = Children(arrays, "before") if "before.child.head" in arrays else None

    @staticmethod
    def build(b: np.ndarray, a: np.ndarray | None, w: np.ndarray, count: np.ndarray, total: np.ndarray, bound: int) -> dict[str, np.ndarray]:
        """Distinct rows in order of (b, a, w), words below bound; total: occurrences of
        the row's context, in this file or not. The weights of pairs take a byte."""
        new = np.append(True, b[1:] != b[:-1])
        own = np.flatnonzero(new)  # of each b
        first = own if a is None else np.flatnonzero(new | np.append(True, a[1:] != a[:-1]))  # of each context
        rest = DISCOUNT * np.diff(np.append(first, len(b))) / total[first]
        return {
            **_named("word", encode(b[own], bound)),
            **({} if a is None else _children(np.searchsorted(first, own), a[first], "before")),
            **_children(first, w, "next"),
            "p": _code((count - DISCOUNT) / total),
            "backoff": rest.astype(np.float32) if a is None else _code(rest),
        }

    def find(self, b: np.ndarray, a: np.ndarray | None, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability (0 if absent) of each n-gram and back-off weight of its
        context (0 if absent here). Negative words are absent."""
        p, backoff = np.zeros(len(b)), np.zeros(len(b))
        if not self.arrays or not len(b):
            return p, backoff
        own, index = np.unique(np.maximum(b, 0), return_inverse=True)
        at = self.words.successor(own.astype(np.uint64))
        there = at < self.words.n
        there[there] = self.words.get(at[there]) == own[there].astype(np.uint64)
        at = np.where((b >= 0) & there[index], at[index], -1)
        if a is not None:
            at = self.before.find(at, a)
        hit = np.flatnonzero(at >= 0)
        codes = self.arrays["backoff"][at[hit]]
        backoff[hit] = _VALUE[codes] if codes.dtype == np.uint8 else codes
        found = self.successors.find(at, w)
        hit = np.flatnonzero(found >= 0)
        p[hit] = _VALUE[self.arrays["p"][found[hit]]]
        return p, backoff


# --- words -------------------------------------------------------------------------


def _starts(shards: int) -> np.ndarray:
    """First hash of each shard of the words."""
    return np.array([i * (2**64 // shards) for i in range(shards)], np.uint64)


class Vocabulary:
    """Number and count of each word. Within a shard words stand by class (the power of
    two in the count, falling), then hash; sizes[class][shard] counts them, and numbers
    run over classes, then shards."""

    def __init__(self, model: dict):
        self.folder, self.sizes, self.open = model["folder"], np.array(model["sizes"], np.int64), {}
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes.ravel())[:-1]]).reshape(self.sizes.shape)
        self.starts = np.cumsum(self.sizes, axis=0) - self.sizes

    def _shard(self, s: int):
        if s not in self.open:
            arrays = _read(self.folder, f"words-{s}")
            self.open[s] = arrays and (_sequence(arrays, "hash"), arrays["place"], arrays["count"])
        return self.open[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each hash."""
        own, index = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
        ends = np.searchsorted(own, _starts(self.sizes.shape[1]))
        for s, (a, b) in enumerate(zip(ends, [*ends[1:], len(own)], strict=True)):
            if a == b or not self._shard(s):
                continue
            sequence, place, count = self._shard(s)
            at = sequence.successor(own[a:b])
            there = np.flatnonzero(at < sequence.n)
            there = there[sequence.get(at[there]) == own[a:b][there]]
            local = place[at[there]].astype(np.int64)
            of = np.searchsorted(self.starts[:, s], local, "right") - 1
            ids[a + there] = self.offsets[of, s] + local - self.starts[of, s]
            counts[a + there] = count[local]
        return ids[index], counts[index]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word numbers; 0 for negative ones."""
        own, index = np.unique(ids, return_inverse=True)
        out = np.zeros(len(own), np.int64)
        cell = np.searchsorted(self.offsets.ravel(), own, "right") - 1
        of, shard = np.divmod(cell, self.sizes.shape[1])
        for s in np.unique(shard[own >= 0]):
            rows = np.flatnonzero((shard == s) & (own >= 0))
            out[rows] = self._shard(s)[2][own[rows] - self.offsets[of[rows], s] + self.starts[of[rows], s]]
        return out[index]

    def end(self) -> int:
        return int(self.find(np.array([_END]))[0][0])


def _per_task(texts: DataFrame, count, schema: str) -> DataFrame:
    """Rows that count(tokens, waiting) has gathered in a task; waiting is settled
    whenever it holds WAITING rows, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather, settle = count()
        for batch in blocks(batches, "text", BLOCK):
            if gather(Sequence(batch.column("text"))) > WAITING:
                yield from settle()
        yield from settle()

    return texts.mapInArrow(run, schema)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    own, index = np.unique(keys, return_inverse=True)
    return own, np.bincount(index, counts, len(own)).astype(np.int64)


def _number_words(source: DataFrame, folder: str, shards: int) -> tuple[list[list[int]], int]:
    """Writes the word files; their sizes by class and shard, and the number of tokens."""
    bits = shards.bit_length() - 1

    def count():
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def gather(tokens: Sequence) -> int:
            parts.append(np.unique(tokens.hashes, return_counts=True))
            if len(parts) > 4:
                parts[:] = [_summed(parts)]
            return sum(len(k) for k, _ in parts)

        def settle() -> Iterator[pa.RecordBatch]:
            if parts:
                keys, counts = _summed(parts)
                parts.clear()
                of = (keys >> np.uint64(64 - bits)).astype(np.int64)
                yield _blobs([(s, pack(_gaps(keys[rows].astype(np.int64)), counts[rows])) for s, rows in _by_slot(of)])

        return gather, settle

    def write(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        # hashes of a shard have one sign, so the signed order is theirs
        keys, n = _merged((np.cumsum(gaps), n) for gaps, n in map(unpack, blobs))
        of = 63 - np.log2(n.astype(float)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        _write(folder, f"words-{shard}", {**_named("hash", encode(keys.astype(np.uint64), 2**64 - 1)), "place": place, "count": n[order].astype(np.int32 if n.max() < 2**31 else np.int64)})
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.bincount(of, minlength=64).tolist()], pa.list_(pa.int64())), pa.array([int(n.sum())])], names=["shard", "sizes", "tokens"])

    found = _each_slot(_per_task(source, count, "slot int, blob binary"), shards, write, "shard int, sizes array<long>, tokens long").collect()
    sizes = np.zeros((64, shards), np.int64)
    for r in found:
        sizes[:, r.shard] = r.sizes
    if sizes.sum() >= 2**31:
        raise ValueError("word numbers need 31 bits")
    return sizes.tolist(), sum(r.tokens for r in found)


def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
    """_summed of parts that come one by one, summed again and again as they gather."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if len(held) > 1 and sum(len(k) for k, _ in held[1:]) > max(WAITING, len(held[0][0])):
            held = [_summed(held)]
    return _summed(held)


# --- slots ---------------------------------------------------------------------------


def _place(b: np.ndarray, part: np.ndarray, slots: int) -> np.ndarray:
    return (mix64(b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(slots)).astype(np.int64)


def _slot(b: np.ndarray, salt: np.ndarray, count: np.ndarray, slots: int, most: int | None = None) -> np.ndarray:
    """Slot of each word b, which occurs count times; a word with more tokens than a
    slot's is dealt by the salt."""
    splits = -(-count // SLOT_TOKENS)
    splits = np.maximum(splits if most is None else np.minimum(splits, most), 1).astype(np.uint64)
    part = np.where(splits > 1, mix64(salt.astype(np.uint64) + np.uint64(0x5A17)) % splits, np.uint64(0))
    return _place(b, part, slots)


def _by_slot(slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each slot, in their order."""
    order = np.argsort(slot, kind="stable")
    own, first = np.unique(slot[order], return_index=True)
    for s, begin, end in zip(own.tolist(), first, np.append(first, len(order))[1:], strict=True):
        yield s, order[begin:end]


def _each_slot(packed: DataFrame, slots: int, work, schema: str) -> DataFrame:
    """work(slot, its blobs) for each slot, one at a time in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, []
        for batch in batches:
            for own, blob in zip(batch.column("slot").to_pylist(), batch.column("blob"), strict=True):
                if own != slot and held:
                    yield from work(slot, held)
                    held = []
                slot = own
                held.append(blob.as_py())
        if held:
            yield from work(slot, held)

    return packed.repartition(slots, "slot").sortWithinPartitions("slot").mapInArrow(run, schema)


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["slot", "blob"])


def _build_pairs(source: DataFrame, model: dict) -> None:
    """Writes the pair level."""
    slots = model["slots"]

    def count():
        vocabulary = Vocabulary(model)
        end = vocabulary.end()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def gather(tokens: Sequence) -> int:
            ids, _ = vocabulary.find(tokens.hashes)
            one, _ = tokens.contexts(ids, end)
            parts.append(np.unique(one << 31 | ids, return_counts=True))
            return sum(len(k) for k, _ in parts)

        def settle() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            keys, counts = _summed(parts)
            parts.clear()
            b, w = keys >> 31, keys & (2**31 - 1)
            slot = _slot(b, w, vocabulary.counts(b), slots, MOST_SPLITS)
            yield _blobs([(s, pack(_gaps(b[rows]).astype(np.int32), w[rows].astype(np.int32), counts[rows].astype(np.int64))) for s, rows in _by_slot(slot)])

        return gather, settle

    def build(slot: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, n = _merged((np.cumsum(b.astype(np.int64)) << 31 | w, n) for b, w, n in map(unpack, blobs))
        b, w = keys >> 31, keys & (2**31 - 1)
        # each occurrence of a word, and each text's start, is followed by a token
        _write(model["folder"], f"pairs-{slot}", Level.build(b, None, w, n, Vocabulary(model).counts(b), model["words"] + 1))
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)])], names=["n"])

    packed = _per_task(source, count, "slot int, blob binary")
    _each_slot(packed, slots, build, "n long").agg(F.sum("n")).collect()


class Answers:
    """What a slot's task needs besides its own triples."""

    def __init__(self, model: dict):
        self.model, self.vocabulary = model, Vocabulary(model)
        self.pairs: dict[int, Level] = {}
        self.total: dict[int, float] = {}

    def _pairs(self, slot: int) -> Level:
        if slot not in self.pairs:
            if len(self.pairs) >= MOST_SPLITS + 1:
                self.pairs.pop(next(iter(self.pairs)))
            self.pairs[slot] = Level(_read(self.model["folder"], f"pairs-{slot}"))
        return self.pairs[slot]

    def _backoff(self, b: int, count: int) -> float:
        """Of a word whose successors are dealt to several slots."""
        if b not in self.total:
            splits = min(-(-count // SLOT_TOKENS), MOST_SPLITS)
            parts = _place(np.full(splits, b), np.arange(splits, dtype=np.uint64), self.model["slots"])
            self.total[b] = sum(float(self._pairs(int(s)).find(np.array([b]), None, np.array([-1]))[1][0]) for s in np.unique(parts))
        return self.total[b]

    def base(self, w: np.ndarray) -> np.ndarray:
        return self.base_of(self.vocabulary.counts(w))

    def base_of(self, counts: np.ndarray) -> np.ndarray:
        return (counts + SMOOTH) / (self.model["tokens"] + SMOOTH * (self.model["words"] + 1))

    def shorter(self, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w|b) of words b that are known."""
        key, index = np.unique(b << 31 | (w + 1), return_inverse=True)
        b, w = key >> 31, (key & (2**31 - 1)) - 1
        count = self.vocabulary.counts(b)
        p, g = np.zeros(len(b)), np.zeros(len(b))
        for slot, rows in _by_slot(_slot(b, w, count, self.model["slots"], MOST_SPLITS)):
            p[rows], g[rows] = self._pairs(slot).find(b[rows], None, w[rows])
        for x in np.unique(b[count > SLOT_TOKENS]):
            rows = b == x
            g[rows] = self._backoff(int(x), int(count[np.argmax(rows)]))
        return (p + np.where(g > 0, g, 1.0) * self.base(w))[index]


# --- dealing and answering -----------------------------------------------------------


_OUT = "id long, n_tokens long, n_known long, base_score double, score double"


def _deal(documents: DataFrame, model: dict) -> DataFrame:
    """documents(id, text, learn) -> packed tokens by slot; slot -1-s carries what is
    known of a text at once, and is answered by the task of slot s."""
    slots = model["slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(model)
        vocabulary = answers.vocabulary
        end = vocabulary.end()
        row = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, "text", BLOCK):
            tokens, n = Sequence(batch.column("text")), batch.num_rows
            ids, counts = vocabulary.find(tokens.hashes)
            one, two = tokens.contexts(ids, end)
            base = np.log10(answers.base_of(counts))
            known = one >= 0
            alone = np.bincount(tokens.doc[~known], np.rint(base[~known] * UNIT), n).astype(np.int64)
            learn = batch.column("learn").to_numpy(zero_copy_only=False)[tokens.doc]
            # of known contexts: order by context, word; then cut by slot
            a, b, w, doc, learn = two[known], one[known], ids[known], tokens.doc[known], learn[known]
            context = b << 31 | (a + 1)
            order = np.lexsort((w, context))
            a, b, w, doc, learn, context = (x[order] for x in (a, b, w, doc, learn, context))
            slot = _slot(b, np.where(a >= 0, a, w), vocabulary.counts(b), slots)
            out = []
            for s, rows in _by_slot(slot.astype(np.uint16 if slots < 65536 else np.int64)):
                c, x = context[rows], w[rows]
                first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])))
                size = np.diff(np.append(first, len(rows)))
                aside = size - np.add.reduceat(learn[rows].astype(np.int64), first)
                out.append((s, pack(np.array([row], np.int64), _gaps(c[first]), x[first].astype(np.int32), size.astype(np.int32), aside.astype(np.int32), doc[rows].astype(np.int16 if n < 32768 else np.int32))))
            of = np.bincount(tokens.doc, minlength=n)
            own = batch.column("id")
            none, own = own.is_null().to_numpy(zero_copy_only=False).astype(np.int8), own.fill_null(0).to_numpy()
            told = pack(np.array([row], np.int64), own, none, of, np.bincount(tokens.doc, counts > 0, n).astype(np.int64), np.bincount(tokens.doc, base, n).view(np.int64), alone)
            out.append((-1 - int(mix64(np.array([row], np.uint64))[0] % np.uint64(slots)), told))
            yield _blobs(out)
            row += n

    return documents.mapInArrow(run, "slot int, blob binary")


def _answer(packed: DataFrame, model: dict, build: bool, tell: bool = True) -> DataFrame:
    """Builds the triple level from the packed tokens or opens it, and answers them:
    rows of a block's first row and packed sums of its texts."""

    def sums(blocks_: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array(blobs, pa.binary())], names=["slot", "blob"])

    def work(slot: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if slot < 0:  # known at once
            yield sums([int(unpack(blob)[0][0]) for blob in blobs], blobs)
            return
        answers, held = Answers(model), [unpack(blob) for blob in blobs]
        blobs.clear()
        context = np.concatenate([np.cumsum(x[1]) for x in held])
        word = np.concatenate([x[2] for x in held])
        seen = np.concatenate([x[3] - x[4] for x in held])
        held = [(int(x[0][0]), x[3], x[5]) for x in held]
        order = np.lexsort((word, context))
        context, word = context[order], word[order].astype(np.int64)
        new = np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))
        index = np.empty(len(order), np.int32)
        index[order] = np.cumsum(new, dtype=np.int32) - 1
        n = np.add.reduceat(seen[order].astype(np.int64), np.flatnonzero(new))
        context, word = context[new], word[new]
        del order, seen, new
        b, a = context >> 31, (context & (2**31 - 1)) - 1  # -1 where there is no second word
        del context
        if build:
            rows = np.flatnonzero((n > 0) & (a >= 0))
            if len(rows):
                x, y = b[rows], a[rows]
                start = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                total = np.repeat(np.add.reduceat(n[rows], start), np.diff(np.append(start, len(x))))
                _write(model["folder"], f"triples-{slot}", Level.build(x, y, word[rows], n[rows], total, model["words"] + 1))
        del n
        if not tell:
            return
        full = answers.shorter(b, word)
        p, g = Level(_read(model["folder"], f"triples-{slot}")).find(b, a, word)
        value = np.rint(np.log10(p + np.where(g > 0, g, 1.0) * full) * UNIT)
        out, at = [], 0
        for _, size, doc in held:
            texts, local = np.unique(doc, return_inverse=True)
            score = np.bincount(local, np.repeat(value[index[at : at + len(size)]], size), len(texts)).astype(np.int64)
            at += len(size)
            out.append(pack(np.diff(texts, prepend=texts.dtype.type(0)), score))
        yield sums([first for first, _, _ in held], out)

    return _each_slot(packed, model["slots"], work, "slot long, blob binary")


def _texts(documents: DataFrame, id_column: str, text_column: str, learn: Column) -> DataFrame:
    return documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))


def _prepare(source: DataFrame) -> dict:
    """Words and pairs of the texts to learn from: the model without its triples."""
    spark = source.sparkSession
    folder = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    chars = source.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    shards = 2 << (chars // 120 // SHARD_WORDS).bit_length()  # a new word in twenty
    learned = source.where("learn").select("text")
    sizes, tokens = _number_words(learned, folder, shards)
    model = {"folder": folder, "sizes": sizes, "words": sum(map(sum, sizes)), "tokens": tokens, "slots": max(8, -(-(chars // 6) // SLOT_TOKENS))}
    _build_pairs(learned, model)
    return model


def _totals(answered: DataFrame, model: dict, id_column: str) -> DataFrame:
    """One row for each text, from the sums of its block."""

    def work(block: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(blob) for blob in blobs]
        _, ids, none, n, known, base, alone = next(x for x in parts if len(x) == 7)
        score = alone.copy()
        for x in parts:
            if len(x) == 2:
                score[np.cumsum(x[0], dtype=np.int64)] += x[1]
        names = [f.split()[0] for f in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none.astype(bool)), pa.array(n), pa.array(known), pa.array(base.view(np.float64)), pa.array(score / UNIT)], names=names)

    told = _each_slot(answered, model["slots"], work, _OUT)
    return told.select(F.col("id").alias(id_column), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def train(texts: DataFrame, text_column: str = "text") -> dict:
    """A small description of the model: its folder, totals and the numbers of slots."""
    bounded_batches(texts.sparkSession)
    source = _texts(texts.withColumn("_none", F.lit(None)), "_none", text_column, F.lit(True))
    model = _prepare(source)
    _answer(_deal(source, model), model, build=True, tell=False).agg(F.count("*")).collect()
    return model


def scores(documents: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have the end mark as their only token. Repeated rows and
    null ids each keep a row; other columns are not read. With no training text
    every token has probability 1 under the base.
    """
    bounded_batches(documents.sparkSession)
    source = _texts(documents, id_column, text_column, F.lit(False))
    return _totals(_answer(_deal(source, model), model, build=False), model, id_column)


def train_and_score(documents: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, dict]:
    """scores() of all documents by a model of those for which learn is true (null is
    false), and the model, with one shuffle of the tokens for both."""
    bounded_batches(documents.sparkSession)
    source = _texts(documents, id_column, text_column, learn)
    model = _prepare(source)
    return keep(_totals(_answer(_deal(source, model), model, build=True), model, id_column), "scores"), model


def drop_model(spark, model: dict) -> None:
    """Delete a model's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(model["folder"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out tenth."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aside = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 10 = 0"), F.lit(False))
    scored, model = train_and_score(documents, ~aside)
    drop_model(spark, model)
    return scored.select("doc_id", aside.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
