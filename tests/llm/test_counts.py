"""Token counts against the plain library call."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import counts
from skyloom.llm.common import text_chunks
from skyloom.llm.queries import tokenizer_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
PARTS = ["a", "B", "é", "ñ", " ", " ", "  ", "\n", "\t", "\r", "'s", "'", "1", "٣", "　", "\xa0", " ", "<|endoftext|>", "日本", "語", "🙂", "́", "\x1c", "\x85", "​", " ", "the", " of", "▁", "<s>", "\x00", ".", "ß", "ﬁ", "①", "aaaa", "ÿ", "Ā", "ɏ", "×"]


def plain(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_librarys(name):
    r = random.Random(name)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(6000)] + [None, "", " ", "\n", "x" * 30000, "word " * 9000, "aaa" * 999 + " " * 500]
    counter = counts.Counter(counts.prove(tokenizer_path(name)))
    got = np.concatenate([counter.of_texts(data, offsets) for _, offsets, data in text_chunks(pa.array(texts), counts.CHUNK)])
    bad = [(t, g, w) for t, g, w in zip(texts, got, plain(tokenizer_path(name), texts)) if g != w]
    assert not bad, bad[:3]


def test_proven_strings_are_one_token_and_most_of_the_vocabulary():
    proof = counts.prove(tokenizer_path(FILES[0]))
    assert proof.cuts == "spaces" and len(proof.alone) > 45_000 and set(plain(proof.path, proof.alone)) == {1}
    assert not any("<|endoftext|>" in s for s in proof.alone)


def test_every_letter_is_taken_apart_as_the_library_does():
    """Each character of the first planes: after a letter, before one, after a space, alone."""
    texts = [s for c in map(chr, [*range(0x3000), *range(0xA000, 0xA100), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F400)]) for s in (f"a{c}", f"{c}b", f"x {c}", f"{c} y", f"a {c}{c} b")]
    counter = counts.Counter(counts.prove(tokenizer_path(FILES[0])))
    got = np.concatenate([counter.of_texts(data, offsets) for _, offsets, data in text_chunks(pa.array(texts), 1 << 16)])
    assert got.tolist() == plain(counter.proof.path, texts)


def test_common_words_need_no_merges():
    counter = counts.Counter(counts.prove(tokenizer_path(FILES[0])))
    text = np.frombuffer(b"the house of the people and the world " * 50, np.uint8)
    assert counter.of_texts(text, np.array([0, len(text)]))[0] == plain(counter.proof.path, [text.tobytes().decode()])[0]
    assert counter.tally == {"proven": 8, "merged": 0}  # "the" with and without a space before it, five other words, and the space at the end


@pytest.mark.parametrize("name", FILES[::2])
def test_count_tokens(spark, name):
    rows = [(1, "some words of text"), (1, "some words of text"), (None, None), (2, ""), (3, "<|endoftext|> <|endoftext|>"), (4, "é" * 2000), (5, "a b " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_bytes", "n_tokens", "over_limit")})
    want = sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, plain(tokenizer_path(name), [t for _, t in rows])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(docs, tokenizer_path(name)).collect()) == want
    assert counts.count_tokens(docs.limit(0), tokenizer_path(name)).count() == 0
