"""Packing token sequences by bounded-space online best-fit."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import durable, text_of

CAPACITY, END_ID, OPEN_BINS = 2048, 0, 4096
#: Tokens that one task packs; a task leaves one sequence part empty or so.
TASK_TOKENS = 1 << 24
#: Bytes of text that are cut together; parts of words whose ids a Python worker remembers, in each
#: of two generations, and the letters of the longest of them.
WINDOW, REMEMBERED, LONGEST = 4 << 20, 300_000, 64
#: The first letter that isn't Latin.
_BEYOND_LATIN = "\u0250"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in small letters with spaces for white space, the kind of each byte, and whether texts are cut between two kinds (8 * left + right)."""
    high, letter, digit, mark, quote, space = range(6)
    lowered, kinds = np.arange(256, dtype=np.uint8), np.full(256, mark, np.uint8)
    kinds[0x80:] = high
    for some, kind in (("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", letter), ("0123456789", digit), ("'", quote), (" \n\t\r", space)):
        kinds[list(some.encode())] = kind
    lowered[ord("A") : ord("Z") + 1] += 32
    lowered[kinds == space] = ord(" ")
    cuts = np.zeros((8, 8), bool)
    cuts[:, space] = True
    cuts[[high, letter, digit, mark, quote], digit] = True
    cuts[digit, [letter, mark, quote]] = True
    cuts[letter, [mark, quote]] = True
    cuts[mark, letter] = True
    return lowered, kinds, cuts.ravel()


_LOWERED, _KINDS, _CUTS = _tables()
_MARKS, _SPACES = np.isin(_KINDS, (3, 4)), _KINDS == 5


def _parts(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The places at which data (UTF-8 of whole texts that end at stops) is cut, with both ends, and what is between them.

    No token reaches over these: before white space, around digits, between letters and marks of
    ASCII (but for a letter after an apostrophe, as in 's), and between a Latin-1 letter and a mark.
    ASCII letters are lowered, save in parts with letters past Latin-1, which a mark might follow
    that joins small letters only.
    """
    kinds = _KINDS[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = _CUTS[kinds[:-1] * np.uint8(8) + kinds[1:]]
    after = np.flatnonzero(_MARKS[data[2:]] & (data[:-2] == 0xC3)) + 2
    cut[after[(data[after - 1] != 0x97) & (data[after - 1] != 0xB7)]] = True
    cut[stops] = True
    bounds = np.flatnonzero(cut)
    lowered, beyond = _LOWERED[data], np.flatnonzero(data >= 0xC4)
    if len(beyond):
        as_is = np.zeros(len(bounds) - 1, bool)
        as_is[np.searchsorted(bounds, beyond, "right") - 1] = True
        as_is = np.repeat(as_is, np.diff(bounds))
        lowered[as_is] = data[as_is]
    return bounds, pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(lowered))


class WordIds:
    """Ids of texts, by parts of words, with a bounded memory of parts.

    The tokenizer never joins over the cuts of _parts, and lowers letters one by one; so ids of a
    text are those of its parts in turn. New parts of letters alone, which are one word to the
    tokenizer, are given to its model in one text and told apart by the ids that end a word. Texts
    with special tokens are encoded whole, because these may stand in the midst of a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.without_special, self.letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.without_special.normalizer, self.without_special.pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.without_special.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words):
            return self._encode(words)
        joined = ids.tobytes()
        return [joined[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, parts: list[str]) -> None:
        letters, words, others = [], [], []
        for part in parts:
            word = part.removeprefix(" ")
            if word.isalpha() and (word.isascii() or max(word := word.lower()) < _BEYOND_LATIN):
                letters.append(part)
                words.append(word)
            else:
                others.append(part)
        if words:
            self.known.update(zip(letters, self._encode_letters(words), strict=True))
        if others:
            self.known.update(zip(others, self._encode(others), strict=True))

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [x for x in parts if x not in known]
        known.update((x, older[x]) for x in missing if x in older)
        new = [x for x in missing if x not in older]
        self._learn(new)
        found = [known[x] for x in parts]
        for part in new:
            if len(part) > LONGEST:
                del known[part]
        return found

    def _of_window(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data, and how many of them are before each of stops."""
        bounds, parts = _parts(data, stops)
        coded = parts.dictionary_encode()
        found, which = self._of_parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, n = np.cumsum(sizes) - sizes, sizes[which]
        before = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(starts[which] - before[:-1], n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(found), "<u4")[at], before[np.searchsorted(bounds, stops)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each text's followed by the end id, and where each text's end."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        text_ends, ends, found, so_far = offsets[1:] - offsets[0], np.zeros(len(texts), np.int64), [], 0
        for lo, hi in _windows(data):
            inside = slice(*np.searchsorted(text_ends, (lo, hi), "right"))
            ids, before = self._of_window(data[lo:hi], text_ends[inside] - lo)
            ends[inside] = so_far + before
            so_far += len(ids)
            found.append(ids)
        ids = np.insert(np.concatenate([np.zeros(0, "<u4"), *found]), ends, END_ID)
        ends += np.arange(1, len(ends) + 1)
        special = np.logical_or.reduce([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in self.special])
        if not special.any():
            return ids, ends
        found = np.split(ids, ends[:-1])
        for row in np.flatnonzero(special):
            found[row] = np.array([*self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids, END_ID], "<u4")
        return np.concatenate(found), np.cumsum([len(x) for x in found])


def _windows(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that end before white space."""
    lo = hi = 0
    while lo < len(data):
        hi += WINDOW
        space = np.flatnonzero(_SPACES[data[hi : hi + WINDOW]]) if hi < len(data) else None
        if space is None or len(space):
            hi = len(data) if space is None else hi + int(space[0])
            yield lo, hi
            lo = hi


_words: dict[str, WordIds] = {}


def ids_of(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each text's followed by the end id, and where each text's end."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path](texts)


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text and the end id, as bytes."""
    ids, ends = ids_of(pa.array(texts, pa.string()), path)
    return [x.tobytes() for x in np.split(ids, ends[:-1])][: len(texts)]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of batch, as many together as hold about WINDOW bytes of text."""
    window = np.cumsum(pc.binary_length(batch["text"]).to_numpy(), dtype=np.int64) // WINDOW
    edges = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the tokens of each document in cuts of capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (rows for whole in batches for rows in _slices(whole)):
            ids, ends = ids_of(batch["text"], tokenizer)
            lengths = np.diff(ends, prepend=0)
            n = -(-lengths // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(lengths[row] - start, capacity)
            stops = [0, *np.cumsum(length).tolist()]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(stops, stops[1:], strict=False)]
            columns = [batch["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class BestFit:
    """Open bins in a bitset keyed by free space: bit s is set while a bin with s places free is open."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free, self.bins, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it, of the fullest bin with room or else a new one."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.open == self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, bin_id = self.capacity, self.made
            self.made += 1
        if space > length:
            self.bins[space - length].append(bin_id)
            self.free |= 1 << (space - length)
            self.open += 1
        return bin_id, self.capacity - space

    def _take(self, space: int) -> int:
        bin_id = self.bins[space].pop()
        self.open -= 1
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return bin_id


def fit(lengths: Iterable[int], capacity: int = CAPACITY, most_open: int = OPEN_BINS) -> list[tuple[int, int]]:
    packer = BestFit(capacity, most_open)
    return [packer.put(n) for n in lengths]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, most_open: int = OPEN_BINS, task_tokens: int = TASK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Documents end with id 0, also empty and null ones, and are cut only if longer than capacity.
    Pieces are dealt evenly over tasks by a hash, as many as their tokens need. The packer is online:
    it sees one piece at a time and holds most_open bins; each task offers its pieces longest first,
    which fills sequences better than the order of arrival. sequence_id is unique over tasks and the same in each
    run over the same rows and settings. Null ids stay, and ids of any size (they go around pandas,
    which would make them doubles beside a null). Rows that repeat are packed each; an empty table
    gives no rows; other columns are ignored. tokenizer is the path of a tokenizers file, read on executors.
    """
    cuts = durable(pieces(docs, tokenizer, capacity, with_ids))
    tokens = cuts.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // task_tokens))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(capacity, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            where = np.array([packer.put(n) for n in batch["length"].to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + where[:, 0]), pa.array(where[:, 1])], [*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema)
    dealt = cuts.repartition(tasks, "doc_id", "piece", "ids_crc32").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(packed, f"{kinds}, sequence_id long, offset long")
