"""Token-id output: documents are encoded, their ids coded in independent blocks by an adaptive context-mixing range coder, and read back.

Coder. The ids of a segment are dealt to lanes (contiguous runs) that are coded in step; all lanes share one model, which is
updated after each step, so numpy works on all of them at once. Three predictors, of order 0 to 2, take part: the hashed
order-2 context and the order-1 context each predict one id with a confidence, and order 0 holds adaptive frequencies of all
ids. Adaptive counts by the two confidences and by agreement mix them into the chances of "order 2 is right", "order 1 is
right" and "neither"; in the last case the id is coded by its order-0 frequency. Intervals narrow a 48-bit range coder with
16-bit output and carry propagation. Every segment starts with a fresh model and bears a crc32.

File format. Parquet rows written by Spark (any store, committed atomically), one a block: part, block, doc_ids, lengths,
segments (binary). A segment is the header MAGIC, ids, alphabet, lanes, steps (unsigned 32-bit, little endian), crc32 of the rest;
then each lane's number of 16-bit words, then the words lane by lane. A block holds whole documents.

Defined results: a null text is empty and yields the end id alone; null ids come first; rows of one id are ordered by text; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_chunks

MAGIC, HEADER = b"TIDB", struct.Struct("<4s4II")
SEGMENT, LANES, LANE_IDS, SLOTS = 1 << 21, 8192, 256, 1 << 18
LEVELS, MIX_TOTAL, MIX_BITS = 4, 1 << 12, np.uint64(12)
COUNT_STEP, COUNT_LIMIT, REFRESH = 32, 1 << 22, 8
#: Bytes of text that are split into words at once.
CHUNK = 1 << 22
#: White space but the space and line break, and places where these do not begin a word.
OTHER_SPACE = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
OTHER_PLACES = ("  ", " \n", "\n ", "\n\n", r"\A[ \n]", r"[ \n]\z")
#: Words of letters with or without marks behind them: to GPT-2's rule of pieces, the letters with the space before them are one piece and the marks another.
MARKS, LETTERS = string.punctuation, r"\A\n?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+\z"
NEW_LINE, NOTHING = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
HASH2, HASH1, SLOT_SHIFT = np.uint32(0x2545F491), np.uint32(0x9E3779B1), np.uint32(32 - 18)
U = np.uint64
LEAST, HALF, LOW32 = U(1 << 32), U(16), U((1 << 32) - 1)


class Model:
    """Predictions of order 0 to 2 and their mix; the encoder and the decoder call the same methods in the same order. The tables of order 1
    and 2 hold an id and, in the lowest bits, its confidence."""

    def __init__(self, alphabet: int, lanes: int) -> None:
        self.counts = np.ones(alphabet, np.int32)
        self.cum = np.arange(alphabet + 1, dtype=np.int32)
        self.one, self.two = np.full(alphabet, alphabet * LEVELS, np.int32), np.full(SLOTS, alphabet * LEVELS, np.int32)
        self.seen: list[np.ndarray] = []
        self.mix = np.ones((2 * LEVELS * LEVELS, 3), np.int64)
        self.prev1, self.prev2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.step = 0

    def predict(self):
        """Order-2 and order-1 ids, and where the intervals of "order 2", "order 1" and "neither" stand in ``begin`` and ``width``."""
        self.slot = (self.prev2.view(np.uint32) * HASH2 + self.prev1.view(np.uint32) * HASH1) >> SLOT_SHIFT
        self.h2, self.h1 = self.two.take(self.slot), self.one.take(self.prev1)
        self.c2, self.c1, self.s2, self.s1 = self.h2 // LEVELS, self.h1 // LEVELS, self.h2 % LEVELS, self.h1 % LEVELS
        self.context = (((self.c2 == self.c1) * np.int32(LEVELS) + self.s2) * LEVELS + self.s1) * 3
        table = self.mix * (MIX_TOTAL - 3) // self.mix.sum(axis=1, keepdims=True) + 1
        begin = np.zeros_like(table)
        np.cumsum(table[:, :2], axis=1, out=begin[:, 1:])
        table[:, 2] = MIX_TOTAL - begin[:, 2]
        self.begin, self.width = begin.astype(U).reshape(-1), table.astype(U).reshape(-1)
        return self.c2, self.c1, self.context

    def update(self, ids: np.ndarray, at: np.ndarray) -> None:
        self.mix += np.bincount(at, minlength=self.mix.size).reshape(self.mix.shape)
        if self.mix.max() > 1 << 20:
            self.mix = (self.mix >> 1) + 1
        fresh = ids * np.int32(LEVELS)
        for held, place, was, guess, level in ((self.two, self.slot, self.h2, self.c2, self.s2), (self.one, self.prev1, self.h1, self.c1, self.s1)):
            held[place] = np.where(guess == ids, was + (level < LEVELS - 1), np.where(level == 0, fresh, was - 1))
        self.seen.append(ids)
        self.step += 1
        if self.step % REFRESH == 0 or self.step < 8:
            self.counts += (COUNT_STEP * np.bincount(np.concatenate(self.seen), minlength=len(self.counts))).astype(np.int32)
            self.seen = []
            if self.counts.sum() > COUNT_LIMIT:
                self.counts = (self.counts >> 1) + 1
            np.cumsum(self.counts, out=self.cum[1:])
        self.prev2, self.prev1 = self.prev1, ids

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold the given places; searched in ascending order, which keeps to the cache."""
        keyed = np.sort(at.astype(np.int64) * len(at) + np.arange(len(at)))
        y = np.empty(len(at), np.int32)
        y[keyed % len(at)] = np.searchsorted(self.cum, (keyed // len(at)).astype(np.int32), "right") - 1
        return y


def encode_segment(ids: np.ndarray) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    alphabet = int(ids.max(initial=0)) + 1
    if alphabet >= COUNT_LIMIT:
        raise ValueError(f"ids must be below {COUNT_LIMIT}")
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, low, size = Model(alphabet, lanes), np.zeros(lanes, U), np.full(lanes, (1 << 48) - 1, U)
    out_lane, out_word = [], []

    def put(at: np.ndarray) -> None:
        while len(at):
            lo, r = low.take(at), size.take(at)
            out_lane.append(at.astype(np.uint16))
            out_word.append((lo >> U(32)).astype(np.int32))
            low[at] = (lo & LOW32) << HALF
            size[at] = r = r << HALF
            at = at[r < LEAST]

    for t in range(steps):
        x = grid[t]
        c2, c1, at = model.predict()
        other = x != c2
        neither = other & (x != c1)
        at = at + other + neither
        r = size >> MIX_BITS
        low += r * model.begin.take(at)
        size = r * model.width.take(at)
        put(np.flatnonzero(size < LEAST))
        rest = np.flatnonzero(neither)
        if len(rest):
            y = x.take(rest)
            start = model.cum.take(y)
            r = size.take(rest) // U(model.cum[-1])
            low[rest] += r * start.astype(U)
            size[rest] = r = r * (model.cum.take(y + 1) - start).astype(U)
            put(rest[r < LEAST])
        model.update(x, at)
    for shift in (32, 16, 0):
        out_lane.append(np.arange(lanes, dtype=np.uint16))
        out_word.append((low >> U(32)).astype(np.int64) if shift == 32 else ((low >> U(shift)) & U(0xFFFF)).astype(np.int64))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word).astype(np.int64)
    word = word[np.argsort(lane, kind="stable")]
    while len(over := np.flatnonzero(word >> 16)):
        carry = word[over] >> 16
        word[over] &= 0xFFFF
        np.add.at(word, over - 1, carry)
    body = np.bincount(lane, minlength=lanes).astype("<u2").tobytes() + word.astype("<u2").tobytes()
    return HEADER.pack(MAGIC, n, alphabet, lanes, steps, zlib.crc32(body)) + body


def decode_segment(data: bytes) -> np.ndarray:
    magic, n, alphabet, lanes, steps, crc = HEADER.unpack_from(data)
    body = memoryview(data)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("a damaged segment of token ids")
    counts = np.frombuffer(body, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", offset=2 * lanes), np.zeros(8, "<u2")]).astype(U)
    next_word = np.cumsum(counts) - counts
    code = (words[next_word] << U(32)) | (words[next_word + 1] << HALF) | words[next_word + 2]
    next_word += 3
    model, size, grid = Model(alphabet, lanes), np.full(lanes, (1 << 48) - 1, U), np.zeros((steps, lanes), np.int32)

    def take(at: np.ndarray) -> None:
        while len(at):
            place, r = next_word.take(at), size.take(at)
            code[at] = (code.take(at) << HALF) | words.take(place)
            next_word[at] = place + 1
            size[at] = r = r << HALF
            at = at[r < LEAST]

    for t in range(steps):
        c2, c1, at = model.predict()
        r = size >> MIX_BITS
        other, neither = code >= r * model.begin.take(at + 1), code >= r * model.begin.take(at + 2)
        at = at + other + neither
        code -= r * model.begin.take(at)
        size = r * model.width.take(at)
        take(np.flatnonzero(size < LEAST))
        x = np.where(other, c1, c2)
        rest = np.flatnonzero(neither)
        if len(rest):
            total = U(model.cum[-1])
            r, c = size.take(rest) // total, code.take(rest)
            y = model.find(np.minimum(c // r, total - U(1)).astype(model.cum.dtype))
            start = model.cum.take(y)
            code[rest] = c - r * start.astype(U)
            size[rest] = r = r * (model.cum.take(y + 1) - start).astype(U)
            take(rest[r < LEAST])
            x[rest] = y
        grid[t] = x
        model.update(x, at)
    return grid.T.reshape(-1)[:n]


class Encoder:
    """Whole texts to ids, word by word from a cache of bounded size; Arrow splits texts and numbers their distinct words, Python sees each of
    these once a chunk. A space or line break between two other characters always begins a new piece of the tokenizer, so words can be
    encoded apart, each with what stands before it; texts with any other white space, or with a token that was added to
    the vocabulary (such as one for a text's end), are encoded whole. New words of plain letters are one piece (and their marks another), which
    the tokenizer's model takes as it is; all others go through the whole tokenizer."""

    MOST = 1_000_000

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.of_words.encode_special_tokens = True  # words are joined for encoding; what arises where they meet is no special token
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level vocabulary writes each byte as one character
            self.bytes_of[i] = len(token)
        bytes_as_written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.written = {c: bytes_as_written(chr(c))[0][0] for c in (0x0A, 0x20, *range(0xC0, 0x100))}
        self.other = "|".join([OTHER_SPACE, *OTHER_PLACES, *map(re.escape, self.added)])
        cut, self.model = self.tokenizer.pre_tokenizer, self.of_words.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words come once
        self.in_pieces = self.tokenizer.normalizer is None and isinstance(self.model, models.BPE) and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex
        self.clear()

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Whether white space stands at an end, next to other white space, or is not a space or line break, or an added token occurs."""
        if any(" " in t or "\n" in t for t in self.added):
            return np.ones(len(texts), bool)
        return pc.match_substring_regex(texts, self.other).to_numpy(zero_copy_only=False)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def shrink(self) -> None:
        """Forget words that were used once, and of the others the rarer ones beyond half the size."""
        keep = np.flatnonzero(self.uses >= 2)
        keep = keep[np.argsort(-self.uses[keep], kind="stable")[: self.MOST // 2]]
        place = np.full(len(self.uses), -1)
        place[keep] = np.arange(len(keep))
        self.known = {word: k for word, i in self.known.items() if (k := int(place[i])) >= 0}
        self.sizes, first = self.sizes[keep], self.starts[keep]
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.ids = self.ids[np.repeat(first - self.starts, self.sizes) + np.arange(int(self.sizes.sum()))]
        self.uses = np.zeros(len(keep), np.int32)

    def joined(self, words: pa.Array, separator: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, each with the separator before it, and how many each has. Words are encoded many at a time; the
        bytes that each id stands for tell where words end."""
        runs = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 2000), len(words)), pa.int32()), words)
        texts = [separator + t for t in pc.binary_join(runs, pa.scalar(separator, pa.large_string())).to_pylist()]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.of_words.encode_batch_fast(texts, add_special_tokens=False)), np.int64)
        size = pc.binary_length(words).to_numpy() + len(separator)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size)) + 1
        return ids, np.diff(ends, prepend=0)

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``joined`` for words of letters, each after a space or with the line break it begins with: by the model alone."""
        of = self.model.tokenize
        space, line = self.written[0x20], [t.id for t in of(self.written[0x0A])]
        ids: list[int] = []
        ends: list[int] = []
        for word in words.to_numpy(zero_copy_only=False):
            w = word if word.isascii() else word.translate(self.written)
            ids += [t.id for t in of(space + w)] if word[0] != "\n" else line + [t.id for t in of(w[1:])]
            ends.append(len(ids))
        return np.array(ids, np.int64), np.diff(np.array(ends, np.int64), prepend=0)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep words with their ids; their places."""
        places = len(self.sizes) + np.arange(len(words))
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int32)])
        self.known.update(zip(words.to_numpy(zero_copy_only=False), places.tolist()))
        return places

    def find(self, words: pa.Array) -> np.ndarray:
        """Places of words, -1 where not known."""
        return np.fromiter(map(self.known.get, words.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(words))

    def with_marks(self, words: pa.Array, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep words whose letters (at the given places, so many) are known and marks follow."""
        marks = pa.array([w[n:] for w, n in zip(words.to_numpy(zero_copy_only=False), sizes.tolist())]).dictionary_encode()
        each = [[t.id for t in self.model.tokenize(m)] for m in marks.dictionary.to_pylist()]
        held, n_held = np.array(list(chain.from_iterable(each)), np.int64), np.array(list(map(len, each)), np.int64)
        kind, n = marks.indices.to_numpy(), self.sizes[letters].astype(np.int64)
        total = n + n_held[kind]
        at = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        inside = at < np.repeat(n, total)
        ids = np.empty(len(at), np.int64)
        ids[inside] = self.ids[(np.repeat(self.starts[letters], total) + at)[inside]]
        ids[~inside] = held[(np.repeat((np.cumsum(n_held) - n_held)[kind] - n, total) + at)[~inside]]
        return self.add(words, ids, total)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Encode words that are not known yet, after a space or with the line break they begin with; their places."""
        places = np.zeros(len(words), np.int64)
        lines = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        letters = pc.ascii_rtrim(words, MARKS)
        plain = pc.match_substring_regex(letters, LETTERS).to_numpy(zero_copy_only=False) & self.in_pieces
        for line in (False, True):
            if len(at := np.flatnonzero(~plain & (lines == line))):
                part = words.take(pa.array(at))
                places[at] = self.add(part, *self.joined(part, "" if line else " "))
        if len(at := np.flatnonzero(plain)):
            held = letters.take(pa.array(at)).dictionary_encode()
            place = self.find(held.dictionary)
            if len(new := np.flatnonzero(place < 0)):
                part = held.dictionary.take(pa.array(new))
                place[new] = self.add(part, *self.pieces(part))
            places[at] = place[held.indices.to_numpy()]
            size = pc.utf8_length(letters).to_numpy()
            marked = at[size[at] < pc.utf8_length(words).to_numpy()[at]]
            if len(marked):
                places[marked] = self.with_marks(words.take(pa.array(marked)), places[marked], size[marked])
        return places

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = self.odd(texts)
        whole = np.flatnonzero(full & odd)
        if len(whole):
            for i, ids in zip(whole, self.plain(texts.take(pa.array(whole)).to_pylist())):
                out[i] = np.array(ids, np.int64)
        at = np.flatnonzero(full & ~odd)
        if len(at):
            if len(self.known) > self.MOST:
                self.shrink()
            lines = pc.replace_substring(texts.take(pa.array(at)), "\n", " \n")
            split = pc.split_pattern(pc.binary_join_element_wise(NEW_LINE, lines, NOTHING), " ")  # words after a space, and line breaks with their words
            words = split.flatten().dictionary_encode()
            place = self.find(words.dictionary)
            if len(new := np.flatnonzero(place < 0)):
                place[new] = self.learn(words.dictionary.take(pa.array(new)))
            index = place[words.indices.to_numpy()]
            self.uses += np.bincount(index, minlength=len(self.known)).astype(np.int32)
            sizes, first = self.sizes[index], self.starts[index]
            ends = np.cumsum(sizes, dtype=np.int64)
            ids = self.ids[np.repeat((first - ends + sizes).astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)]
            upto = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]
            for k, i in enumerate(at):
                out[i] = ids[upto[k] + 1 : upto[k + 1]]  # without the line break that was put before the first word
        return out


ENCODERS: dict[str, Encoder] = {}


def encode_blocks(path: str, end_id: int, block_ids: int):
    """Rows of the file format from (doc_id, text) in order."""

    def run(batches):
        coder = ENCODERS.setdefault(path, None) or ENCODERS.__setitem__(path, Encoder(path)) or ENCODERS[path]
        part, block, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            all_ids = np.concatenate(held)
            segments = [encode_segment(all_ids[i : i + SEGMENT]) for i in range(0, len(all_ids), SEGMENT)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([segments], pa.list_(pa.binary()))], names=["part", "block", "doc_ids", "lengths", "segments"])

        for batch in batches:
            doc_ids = batch.column(0)
            for i, offsets, _ in text_chunks(batch.column(1), CHUNK):
                texts = pc.fill_null(batch.column(1).slice(i, len(offsets) - 1).cast(pa.large_string()), "")
                for doc_id, x in zip(doc_ids.slice(i, len(offsets) - 1).to_pylist(), coder.encode(texts)):
                    ids.append(doc_id)
                    held.append(np.append(x, end_id))
                    size += len(held[-1])
                    if size >= block_ids:
                        yield row()
                        block, ids, held, size = block + 1, [], [], 0
        if held:
            yield row()

    return run


FILE_SCHEMA = "part int, block int, doc_ids array<long>, lengths array<long>, segments array<binary>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = SEGMENT, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids to ``path`` in ascending id order: parts are ranges of ids, blocks are numbered within."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode_blocks(tokenizer, end_id, block_ids), FILE_SCHEMA).write.option("compression", "none").parquet(path)


def decode_blocks(batches):
    """(part, block, place, doc_id, before, n_tokens, ids_crc32) of each document in a block; before counts ids from the block's start."""
    for batch in batches:
        for r in range(batch.num_rows):
            part, block, doc_ids, lengths, segments = (batch.column(k)[r].as_py() for k in range(5))
            ids = np.concatenate([decode_segment(s) for s in segments]).astype("<u4") if segments else np.zeros(0, "<u4")
            ends = np.cumsum(lengths)
            if ends[-1] != len(ids):
                raise ValueError("a block's lengths do not fit its ids")
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
            k = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "block", "place", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    docs = files.mapInArrow(decode_blocks, "part int, block int, place int, doc_id long, before long, n_tokens long, ids_crc32 long")
    blocks = files.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).withColumn("first", earlier(Window.partitionBy(F.lit(1)).orderBy("part"))).drop("n")
    starts = blocks.withColumn("inside", earlier(Window.partitionBy("part").orderBy("block"))).join(parts, "part").select("part", "block", (F.col("first") + F.col("inside")).alias("start"))
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files below the shared folder, then read them back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
