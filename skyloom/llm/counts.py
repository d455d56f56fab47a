"""Token counts of whole texts by the whole-token shortcut.

Offline proof, once per vocabulary (``prove``): every string of the vocabulary is encoded alone by the library; those that give exactly one
token are proven. A text is cut where every tokenizer of its kind must cut, so its count is the sum over its pieces: a piece that is proven
counts one and needs no merging, any other piece is taken apart into pre-tokens, of which proven ones count one each, and only what is then
left goes through the merges. Arrow numbers the distinct pieces of a chunk, so each is looked up once a chunk.

Where pieces end. Byte-level vocabularies (.json with the ByteLevel pre-tokenizer and its pattern, no normalizer): no pre-token goes on from a
character that is not white space to a space or line break, so a piece is white space and what follows up to the next. Sentence pieces (.model):
a piece begins at a space after another character, provided that no vocabulary string holds a space sign behind another character and that the
normalizer keeps the vocabulary's strings as they are (both are checked). Any other tokenizer, and any text with
an added token that could reach over a cut, is counted by the library on whole texts.

Defined results: a null text is empty and has no tokens; special strings in a text count as the library takes them by default; ids are passed
on, null and repeated ones too; an empty table gives an empty result. A text must fit a task's memory.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_chunks

#: Bytes of text whose pieces are numbered at once.
CHUNK = 1 << 22
#: Pieces that are one pre-token by any version of Unicode: Latin letters (U+00C0 to U+024F but the two signs) after one space at most.
ONE_WORD = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
SPACE_SIGN = "▁"
#: Leading two bytes of three-byte white space in UTF-8 (U+1680, U+2000 to U+205F, U+3000): 0xE1 0x9A, 0xE2 0x80, 0xE2 0x81, 0xE3 0x80.
WIDE_SPACE = np.array([0xE19A, 0xE280, 0xE281, 0xE380])


@dataclass
class Proof:
    """What is proven of a vocabulary: where texts may be cut ("spaces", "pieces" or "whole"), strings of one token, added tokens."""

    path: str
    cuts: str
    alone: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    letters: dict[str, int] = field(default_factory=dict)


class Json:
    """Counts of a tokenizers file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def taken_apart(self, text: str) -> list[tuple[int, int]]:
        """Where pre-tokens stand in a text."""
        return [place for _, place in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Model:
    """Counts of a sentencepiece file, which has no pre-tokens. A text that does not begin with a space is given one by the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def of_pieces(self, pieces: list[str]) -> list[int]:
        """Counts of pieces that stand behind others: the space that the library puts before a text is the piece's own."""
        alone = self.counts(["a ", "a"])
        return [n if p != " " else alone[0] - alone[1] for p, n in zip(pieces, self.counts([p.removeprefix(" ") for p in pieces]))]


def library(path: str) -> Json | Model:
    return Model(path) if path.endswith(".model") else Json(path)


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def prove_json(path: str) -> Proof:
    import json

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    lib, pre = Json(path), made.get("pre_tokenizer") or {}
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    added = made.get("added_tokens") or []
    simple = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    if not simple or any(t.get(k) for t in added for k in flags) or any(not t["content"] or any(c.isspace() for c in t["content"]) for t in added):
        return Proof(path, "whole")
    letters, strings, vocabulary = byte_letters(), [], made["model"]["vocab"]
    for token in vocabulary:
        try:
            strings.append(bytes(letters[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # part of a character: no text is this string
            continue
    names = [t["content"] for t in added]
    strings = [s for s in strings if s and not any(a in s for a in names)]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
    merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
    plain_merges = not any(made["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and all(c in vocabulary for c in letters)
    return Proof(path, "spaces", [s for s, n in zip(strings, lib.counts(strings)) if n == 1], names, merges if plain_merges else [], {c: vocabulary[c] for c in letters} if plain_merges else {})


def prove_model(path: str) -> Proof:
    lib = Model(path)
    m = lib.model
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    crossing = any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
    kept_apart = m.encode("a  b", out_type=str) == [SPACE_SIGN + "a", SPACE_SIGN, SPACE_SIGN + "b"] and m.encode(" a", out_type=str) != m.encode("a", out_type=str)
    if crossing or not kept_apart or any(m.normalize(p.replace(SPACE_SIGN, " ")) != SPACE_SIGN + p for p in pieces):
        return Proof(path, "whole")
    words = [p[1:] for p in pieces if p.startswith(SPACE_SIGN) and len(p) > 1 and SPACE_SIGN not in p[1:]]
    return Proof(path, "pieces", [" " + w for w, n in zip(words, lib.counts(words)) if n == 1])


def prove(path: str) -> Proof:
    """The offline proof; its size is that of the vocabulary, whatever is counted with it."""
    return prove_model(path) if path.endswith(".model") else prove_json(path)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, rows' borders included: at a space or line break after a character that is not white space."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    before = data[at - 1]
    ok = (before > 0x20) & (before < 0x7F)
    wide = np.flatnonzero(before >= 0x80)
    lead = data[np.maximum(at[wide] - 2, 0)].astype(np.int64)
    pair = data[np.maximum(at[wide] - 3, 0)].astype(np.int64) << 8 | lead
    ok[wide] = (lead >= 0xC3) | ((lead < 0xC0) & ~np.isin(pair, WIDE_SPACE))
    return borders(len(data), at[ok], offsets)


def borders(n: int, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    begins = np.zeros(n + 1, bool)
    begins[at] = begins[offsets] = True
    return np.flatnonzero(begins)


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at a space after a character that is no space nor the space sign (0xE2 0x96 0x81), and at rows' borders."""
    at = np.flatnonzero((data[1:] == 0x20) & (data[:-1] != 0x20)) + 1
    sign = (at >= 3) & (data[at - 1] == 0x81) & (data[np.maximum(at - 2, 0)] == 0x96) & (data[np.maximum(at - 3, 0)] == 0xE2)
    return borders(len(data), at[~sign], offsets)


class Merger:
    """Merges of many pre-tokens at once. In a round, every pre-token merges all places of its first pair in the order of the merges; a pair
    that a merge brings about comes later in that order than the merge, so this is the same as place by place."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, proof: Proof) -> None:
        merges = np.array(proof.merges, np.int64).reshape(-1, 3)
        keys = merges[:, 0] << 32 | merges[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), merges[:, 2]
        self.first = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.first[byte] = proof.letters[letter]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def counts(self, tokens: pa.Array) -> np.ndarray:
        """Tokens of each pre-token (large strings, none empty)."""
        if not len(tokens):
            return np.zeros(0, np.int64)
        offsets = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, tokens.offset * 8)
        size = np.diff(offsets)
        out, owner = size.copy(), np.repeat(np.arange(len(tokens)), size)
        ids = self.first[np.frombuffer(tokens.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        rank = np.full(len(ids), self.NONE, np.int32)  # of an id and the next one of the same pre-token
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.rank(ids[inside], ids[inside + 1])
        while len(ids):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.append(begin, len(ids)))
            least = np.minimum.reduceat(rank, begin)
            going = np.repeat(least < self.NONE, size)
            if not going.all():  # pre-tokens without a pair to merge are done
                ids, rank, owner = ids[going], rank[going], owner[going]
                least, size = least[least < self.NONE], size[least < self.NONE]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            run = np.cumsum(np.diff(at, prepend=-2) != 1)  # the same id many times over: every second place
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            ids[at] = self.made[rank[at]]
            out -= np.bincount(owner[at], minlength=len(out))
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            ids, rank, owner, at = ids[keep], rank[keep], owner[keep], place[at]
            for new in (at, at[at > 0] - 1):
                last = new + 1 >= len(ids)
                joined = new[~last]
                joined = joined[owner[joined] == owner[joined + 1]]
                rank[new] = self.NONE
                rank[joined] = self.rank(ids[joined], ids[joined + 1])
        return out


class Counter:
    """Counts of texts in a task, by a proof. ``tally`` says how many distinct pieces or pre-tokens were counted by the proof, and how many by merging."""

    def __init__(self, proof: Proof) -> None:
        self.proof, self.library = proof, library(proof.path)
        self.alone = pa.array(proof.alone, pa.large_string())
        self.merger = Merger(proof) if proof.merges else None
        self.tally = {"proven": 0, "merged": 0}

    def proven(self, pieces: pa.Array) -> np.ndarray:
        found = pc.is_in(pieces, value_set=self.alone).to_numpy(zero_copy_only=False)
        self.tally["proven"] += int(found.sum())
        self.tally["merged"] += int((~found).sum())
        return found

    def pre_tokens(self, pieces: pa.Array) -> np.ndarray:
        """Counts of distinct pre-tokens: proven ones count one, the rest is merged."""
        found = self.proven(pieces)
        counts = np.ones(len(pieces), np.int64)
        counts[~found] = self.merger.counts(pieces.filter(pa.array(~found)))
        return counts

    def apart(self, pieces: list[str]) -> np.ndarray:
        """Counts of pieces of several pre-tokens. Those that begin with a space or line break and end without white space are joined to be taken
        apart, since joined text is cut where they meet; others stay alone."""
        joins = np.array([p[0] in " \n" and not p[-1].isspace() for p in pieces])
        tokens, owner = [], []
        runs = [np.flatnonzero(joins)[i : i + 2000] for i in range(0, int(joins.sum()), 2000)] + [[i] for i in np.flatnonzero(~joins)]
        for run in runs:
            parts = [pieces[i] for i in run]
            text = "".join(parts)
            found = self.library.taken_apart(text)
            tokens += [text[a:b] for a, b in found]
            owner.append(np.asarray(run)[np.searchsorted(np.cumsum([len(p) for p in parts]), [a for a, _ in found], "right")])
        numbered = pa.array(tokens, pa.large_string()).dictionary_encode()
        n = self.pre_tokens(numbered.dictionary)[numbered.indices.to_numpy()]
        return np.bincount(np.concatenate(owner), n, len(pieces)).astype(np.int64)

    def merged(self, pieces: pa.Array) -> np.ndarray:
        """Counts of distinct pieces that are not proven as a whole."""
        counts = np.zeros(len(pieces), np.int64)
        if self.proof.cuts == "pieces":
            return np.array(self.library.of_pieces(pieces.to_pylist()), np.int64)
        word = pc.match_substring_regex(pieces, ONE_WORD) if self.merger else pa.array(np.zeros(len(pieces), bool))
        special = pa.array(np.full(len(pieces), self.merger is None))
        for a in self.proof.added:
            special = pc.or_(special, pc.match_substring(pieces, a))
        word = pc.and_(word, pc.invert(special))
        other = pc.invert(pc.or_(word, special))
        as_mask = lambda m: m.to_numpy(zero_copy_only=False)
        if pc.any(word).as_py():
            counts[as_mask(word)] = self.merger.counts(pieces.filter(word))
        if pc.any(special).as_py():
            counts[as_mask(special)] = self.library.counts(pieces.filter(special).to_pylist())
        if pc.any(other).as_py():
            counts[as_mask(other)] = self.apart(pieces.filter(other).to_pylist())
        return counts

    def of_pieces(self, pieces: pa.Array) -> np.ndarray:
        """Counts of distinct pieces, none of them empty."""
        counts = np.ones(len(pieces), np.int64)
        rest = ~self.proven(pieces)
        if rest.any():
            counts[rest] = self.merged(pieces.filter(pa.array(rest)))
        return counts

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.proof.cuts == "whole" or not len(data):
            texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).to_pylist()
            return np.array(self.library.counts(texts), np.int64)
        if self.proof.cuts == "pieces":  # the library puts a space before a text
            starts, full = offsets[:-1], np.diff(offsets) > 0
            data, offsets = np.insert(data, starts[full], 0x20), offsets + np.append(0, np.cumsum(full))
        at = cuts(data, offsets) if self.proof.cuts == "spaces" else word_cuts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        numbered = pieces.dictionary_encode()
        n = self.of_pieces(numbered.dictionary)[numbered.indices.to_numpy()]
        return np.diff(np.append(0, np.cumsum(n))[np.searchsorted(at, offsets)])


def counted(proof: Proof):
    def run(batches):
        counter = Counter(proof)
        for batch in batches:
            for i, offsets, data in text_chunks(batch.column(1), CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(offsets) - 1), pa.array(np.diff(offsets)), pa.array(counter.of_texts(data, offsets))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; nothing is shuffled."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(counted(prove(tokenizer)), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
