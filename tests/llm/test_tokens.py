"""Exact round trips of the coder, whole-text encoding, damage, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelfold.llm import tokens
from panelfold.llm.rangecoder import decode, encode

rng = np.random.default_rng(3)
SERIES = [np.zeros(0), np.zeros(1), np.arange(5000) % 7, rng.integers(0, 50257, 5000), rng.integers(0, 3, 3000),
          np.r_[np.zeros(5000), rng.integers(0, 50257, 100)], np.full(1500, 50256), rng.zipf(1.3, 9000) % 50257]


@pytest.mark.parametrize("k", range(len(SERIES)))
@pytest.mark.parametrize("block", [64, 1024])
def test_round_trip(k, block):
    ids = SERIES[k].astype(np.uint32)
    assert (decode(encode(ids, block)) == ids).all()


def test_contexts_pay():
    loop = np.tile(rng.integers(0, 50257, 50), 400).astype(np.uint32)
    assert len(encode(loop)) < len(loop) * 2 * 0.3
    assert len(encode(rng.zipf(1.3, 50000).astype(np.uint32) % 50257)) < 50000 * 2 * 0.7


def test_damage_is_found():
    frame = bytearray(encode(SERIES[3].astype(np.uint32)))
    frame[-100] ^= 1
    with pytest.raises(ValueError):
        decode(bytes(frame))
    with pytest.raises(ValueError):
        decode(b"no segment of ids")


TEXTS = ["", " ", "a", "  two  blanks ", "tail ", " lead", "x\n\ny  z", "don't we'll", "end<|endoftext|>x", "nul\0l",
         "tab\t\there", "line\n next", "a \nb", "a\n b", "a  b", "naïve 漢字 🙂🙂 mixed 123,456.78", "A" * 500, "é" * 90,
         "one two, three. four!", "\n", "\n ", " \n", "　wide　 blank"]


def test_cached_units_equal_whole_texts():
    path = tokens.byte_bpe()
    whole = Tokenizer.from_file(path)
    coder = tokens.CachedTokenizer(path)
    for _ in range(2):  # the second time from the cache
        ids, counts = coder.encode(TEXTS)
        ends = np.cumsum(counts)
        for text, e, n in zip(TEXTS, ends, counts):
            assert ids[e - n:e].tolist() == whole.encode(text, add_special_tokens=False).ids + [2], repr(text)
    ids, counts = coder.encode([])
    assert len(ids) == 0 and len(counts) == 0


def test_a_small_cache_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    whole = Tokenizer.from_file(tokens.byte_bpe())
    coder = tokens.CachedTokenizer(tokens.byte_bpe())
    for k in range(30):
        texts = [" ".join(f"w{(k * i * 7) % 97} common the," for i in range(20)), "x" * k]
        ids, counts = coder.encode(texts)
        wanted = [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == sum(wanted, []) and counts.tolist() == [len(w) for w in wanted]
        assert len(coder.known) <= 200
    assert "common" in coder.known
    monkeypatch.setattr(tokens, "CACHE_CHARS", 10)
    assert coder.encode(["plain text"])[0].tolist() == whole.encode("plain text").ids + [2]


MARKED = ["end of file", "end", "all of it", "allow x", "all", "whole w", "first f", "e", "w w", "f", "end  x", "all "]
LOOSE = ["a \u00a0 \u00a0 b", "a \u00a0 \u00a0\u2003x", "x\u00a0 \u00a0y", "\u00a0 \u00a0 \u00a0", "p\n \n\nq \n r", "q\n \n"]


def test_no_text_is_taken_for_a_mark():
    whole, coder = Tokenizer.from_file(tokens.byte_bpe()), tokens.CachedTokenizer(tokens.byte_bpe())
    for texts in (MARKED, LOOSE, LOOSE[::-1] + MARKED):
        for text in texts:
            assert coder.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_units_with_white_space_at_their_edges_are_learned_apart():
    whole, coder = Tokenizer.from_file(tokens.byte_bpe()), tokens.CachedTokenizer(tokens.byte_bpe())
    texts = ["a \u00a0", "b \u00a0\u2003x", "c \u00a0\u00a0", "d \n", "e \nx"]  # their new units stand in a row
    ids, _ = coder.encode(texts)
    assert ids.tolist() == sum([whole.encode(t, add_special_tokens=False).ids + [2] for t in texts], [])


def brute(rows):
    whole, start, out = Tokenizer.from_file(tokens.byte_bpe()), 0, []
    for doc_id, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_whole_encoding(spark):
    from panelfold.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, QUERIES["op5_tokens"](spark, sf).collect())) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(3, "c c"), (1, None), (2, ""), (None, "none"), (4, "word " * 30000), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(1))
    tokens.write_tokens(docs, str(tmp_path / "ids"), tokens.byte_bpe())
    found = tokens.read_tokens(spark, str(tmp_path / "ids"), ids=True)
    plain = sorted((r[:4] for r in map(tuple, found.collect())), key=lambda r: r[1])
    assert plain == brute([(None, "none"), (1, None), (1, None), (2, ""), (3, "c c"), (4, "word " * 30000)])
    assert {r["doc_id"]: len(r["ids"]) == r["n_tokens"] for r in found.collect()} == dict.fromkeys(
        [None, 1, 2, 3, 4], True)
    assert tokens.round_trip(docs.limit(0), tokens.byte_bpe()).count() == 0


class Seen:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, inner, texts):
        self.inner, self.texts = inner, texts

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.inner.encode_batch_fast(texts, **options)


def test_a_known_word_is_not_encoded_again_with_signs_after_it():
    coder, texts = tokens.CachedTokenizer(tokens.byte_bpe()), []
    coder.encode(["a Thndeston b"])
    for name in {"tokenizer", "words"} & set(vars(coder)):
        setattr(coder, name, Seen(getattr(coder, name), texts))
    text = "a Thndeston, Thndeston.%% Thndeston b"
    ids, counts = coder.encode([text])
    assert ids.tolist() == Tokenizer.from_file(tokens.byte_bpe()).encode(text, add_special_tokens=False).ids + [2]
    assert counts.tolist() == [len(ids)] and texts and not any("Thndeston" in t for t in texts)


def test_letters_are_cut_from_signs_only():
    words = ["ab", "ab,", "ab.c", "ab's", "ab'", "abж", "ab×", "÷ab", "ab́", "éÀɏ-", "abɐ", "ab1", "ab_%", "ab\ncd", "ª", "ab\t,"]
    texts = [" ".join(["x", *(words[(i * k) % len(words)] for i in range(9)), "y"]) for k in range(1, 30)]
    library, coder = Tokenizer.from_file(tokens.byte_bpe()), tokens.CachedTokenizer(tokens.byte_bpe())
    for k in range(0, len(texts), 5):
        ids, _ = coder.encode(texts[k:k + 5])
        assert ids.tolist() == [i for t in texts[k:k + 5] for i in library.encode(t, add_special_tokens=False).ids + [2]]
