"""Token ids of documents in compressed, checksummed segments, written and read by Spark."""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelfold.llm.rangecoder import BLOCK, LANES, decode, encode
from panelfold.llm.textscan import pieces
from panelfold.session import shared_folder

END = 2
SEGMENT = ("part int, segment int, documents array<bigint>, n_tokens array<bigint>, "
           "tokens bigint, data binary")
READ = "part int, segment int, place int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
# Marks of units, which never hold "\0" elsewhere: the end id, a whole text, a text's first unit.
STOP, WHOLE, FIRST = "\0e", "\0w", "\0f"
# A blank inside a run of white space, where the pre-tokenizer may not cut.
INSIDE_RUN = re.compile(r" (?<=\s )\s")
# Latin letters and ASCII signs after them: the pre-tokenizer cuts between the two, and nowhere else before the signs.
LETTERS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)")
# How byte-level BPE writes each byte.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
# Beyond these bounds the cache of word ids keeps the units used most, half as many.
CACHE_WORDS, CACHE_CHARS = 1 << 19, 1 << 25


class _Known(dict):
    """Number of each unit; new ones wait in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending, self.size = [], 0

    def __missing__(self, unit):
        number = self.size
        self[unit] = number
        self.size += 1
        self.pending.append(unit)
        return number


class CachedTokenizer:
    """Ids of whole texts; every distinct unit is encoded once.

    The pre-tokenizer of byte-level BPE always cuts before a single blank between
    other characters, so a text splits into units of a blank and what follows up
    to the next one, and its ids are those of its units. Texts with a blank between white
    space, a blank at the end or a special token's string are encoded whole.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # The same model without the pattern, for words already cut and written in signs.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = end
        self.blank = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.blank[number] = token.startswith("\u0120")  # how byte-level BPE writes a blank
        self._clear()

    def _clear(self):
        self.known, self.chars = _Known(), 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1 << 12, np.int64)
        self.filled = 0
        self.uses = np.zeros(1 << 12, np.int64)
        self.known[STOP] = 0
        self.known.size = 1
        self._add(np.array([self.end], np.uint32), np.array([1]), 0)

    def _shrink(self):
        """Keep the units used most; none if their texts are too long in total."""
        names, uses = list(self.known), self.uses[:self.known.size]
        if self.chars > CACHE_CHARS:
            self._clear()
            return
        edge = np.partition(uses, -CACHE_WORDS // 2)[-CACHE_WORDS // 2]
        kept = np.flatnonzero(uses > edge)
        kept = kept[kept > 0]
        begin, size = self.offset[kept], self.offset[kept + 1] - self.offset[kept]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids, used = self.flat[np.repeat(begin, size) + step], uses[kept] // 2
        self._clear()
        for i in kept.tolist():
            self.known[names[i]]  # numbers the unit
        self.chars = sum(map(len, self.known.pending))
        self.known.pending = []
        self._add(ids, size, 1)
        self.uses = np.zeros(len(self.offset), np.int64)
        self.uses[1:len(kept) + 1] = used

    def _add(self, ids, size, first):
        total = self.filled + len(ids)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(size) + 1 > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
        self.flat[self.filled:total] = ids
        self.offset[first + 1:first + len(size) + 1] = self.filled + np.cumsum(size)
        self.filled = total

    def _cut(self, ids, count):
        """Where each of ``count`` words after a blank begins among their ids, and the end."""
        starts = np.r_[np.flatnonzero(self.blank[ids]), len(ids)]
        if len(starts) != count + 1:
            raise ValueError("the tokenizer doesn't cut before blanks")
        return starts

    def _letters(self, heads, tails, first):
        """Ids of words of letters, each after a blank, and of runs of signs, joined, and their sizes.

        A word that is a known unit isn't encoded again.
        """
        number = np.array([self.known.get(head, first) for head in heads], np.int64)
        old = number < first
        begin, size = self.offset[number[old]], self.offset[number[old] + 1] - self.offset[number[old]]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        new = [head for head, seen in zip(heads, old.tolist()) if not seen]
        text = " " + "\n ".join(new) if new else ""
        signs = text.encode().decode("latin-1").translate(BYTE_SIGNS).replace(BYTE_SIGNS[10], "\n")
        ids = np.array(self.words.encode_batch_fast([signs], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.zeros(len(heads), np.int64)
        sizes[old], sizes[~old] = size, np.diff(self._cut(ids, len(new)))
        joined, place = np.empty(int(sizes.sum()), np.uint32), np.repeat(old, sizes)
        joined[place], joined[~place] = self.flat[np.repeat(begin, size) + step], ids
        ends = [e.ids for e in self.tokenizer.encode_batch_fast(list(tails), add_special_tokens=False)]
        return (np.concatenate([joined, np.array([i for e in ends for i in e], np.uint32)]),
                np.concatenate([sizes, np.array([len(e) for e in ends], np.int64)]))

    def _learn(self, units, first):
        """Encode new units. Letters and signs after them are encoded apart, each once; other units
        after a blank all in one text, cut at the tokens that start with a blank; the rest, and
        those with white space at an edge, one by one."""
        self.chars += sum(map(len, units))
        heads, tails, plain, parts, single, rest = {}, {"": 0}, [], [], [], []
        for k, u in enumerate(units):
            found = LETTERS.fullmatch(u)
            if found:
                plain.append(k)
                parts.append((heads.setdefault(found[1], len(heads)), tails.setdefault(found[2], len(tails))))
            elif u[:1] == "\0" or u[:1].isspace() or u[-1:].isspace():
                single.append(k)
            else:
                rest.append(k)
        alone = self.tokenizer.encode_batch_fast(
            [units[k][2:] if units[k][:1] == "\0" else " " + units[k] for k in single],
            add_special_tokens=False)
        text = " " + " ".join([units[k] for k in rest]) if rest else ""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        size = np.zeros(len(units), np.int64)
        size[rest] = np.diff(self._cut(ids, len(rest)))
        size[single] = [len(e.ids) for e in alone]
        pool, sizes = self._letters(list(heads), list(tails), first)
        parts = np.array(parts, np.int64).reshape(-1, 2) + [0, len(heads)]
        size[plain] = sizes[parts].sum(axis=1)
        begin, many = (np.cumsum(sizes) - sizes)[parts].ravel(), sizes[parts].ravel()
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        joined = np.empty(int(size.sum()), np.uint32)
        kind = np.zeros(len(units), np.int8)
        kind[rest], kind[single] = 1, 2
        kind = np.repeat(kind, size)
        joined[kind == 0] = pool[np.repeat(begin, many) + step]
        joined[kind == 1] = ids
        joined[kind == 2] = [i for e in alone for i in e.ids]
        self._add(joined, size, first)

    def encode(self, texts: list[str]):
        """Joined ids of the texts, each with the end id, and how many each has."""
        if self.known.size > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._shrink()
        known, parts, counts = self.known, [], []
        first = known.size
        for text in texts:
            whole = "  " in text or text.endswith(" ") or "\0" in text \
                or any(s in text for s in self.special) or INSIDE_RUN.search(text)
            if whole:
                parts += [WHOLE + text, STOP]
                counts.append(2)
            else:
                units = text.split(" ")
                units[0] = FIRST + units[0]  # no blank before it
                units.append(STOP)
                parts += units
                counts.append(len(units))
        index = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        if known.pending:
            self._learn(known.pending, first)
            known.pending = []
        if len(self.uses) < known.size:
            self.uses = np.concatenate([self.uses, np.zeros(len(self.offset) - len(self.uses), np.int64)])
        self.uses[:known.size] += np.bincount(index, minlength=known.size)
        begin = self.offset[index]
        size = self.offset[index + 1] - begin
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.cumsum(counts) - 1
        upto = ends[stops] if len(counts) else np.zeros(0, np.int64)
        return ids, np.diff(upto, prepend=0)


_TOKENIZERS: dict = {}


def _tokenizer(path: str, end: int) -> CachedTokenizer:
    if (path, end) not in _TOKENIZERS:
        _TOKENIZERS[path, end] = CachedTokenizer(path, end)
    return _TOKENIZERS[path, end]


def segments(docs: DataFrame, path: str, end: int = END, ids_per_segment: int = BLOCK * LANES) -> DataFrame:
    """Documents in ascending doc_id order as segments of about ``ids_per_segment`` ids.

    One sort by range over all documents; each range is a ``part``, numbered in
    order. A segment holds whole documents; a longer document is one by itself.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, names, sizes, total = [], [], [], 0

        def flush():
            frame = encode(np.concatenate(held) if held else np.zeros(0, np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([total], pa.int64()), pa.array([frame], pa.binary())],
                names=["part", "segment", "documents", "n_tokens", "tokens", "data"])

        coder = _tokenizer(path, end)
        for batch in pieces(batches, limit=1 << 20):
            ids, counts = coder.encode(batch.column(1).fill_null("").to_pylist())
            held.append(ids)
            names += batch.column(0).to_pylist()
            sizes += counts.tolist()
            total += len(ids)
            if total >= ids_per_segment:
                yield flush()
                held, names, sizes, total, number = [], [], [], 0, number + 1
        if names:
            yield flush()

    return ordered.mapInArrow(run, SEGMENT)


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """Token ids of all documents as files in ``folder``.

    Spark's writer commits them, so that a lost executor leaves no half-written
    segment behind. Null texts count as empty (the end id alone), null ids come first.
    """
    segments(docs, path, end).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` counts the ids of all documents before. Every block's checksum is
    verified. No documents, no rows.
    """
    stored = spark.read.schema(SEGMENT).parquet(folder)

    def run(batches):
        _TOKENIZERS.clear()  # this worker may have written before
        for batch in batches:
            for row in batch.to_pylist():
                found = decode(row["data"])
                sizes = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                if len(found) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a segment's ids and documents differ in number")
                words = found.astype("<u4")
                crc = [zlib.crc32(words[e - n:e].tobytes()) for e, n in zip(ends, sizes)]
                n = len(sizes)
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                           pa.array(range(n), pa.int32()), pa.array(row["documents"], pa.int64()),
                           pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                           pa.array(crc, pa.int64())]
                names = ["part", "segment", "place", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([words[e - n:e].astype(np.int64) for e, n in zip(ends, sizes)],
                                            pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = stored.select("part", "segment", "documents", "n_tokens", "data") \
        .mapInArrow(run, READ + (", ids array<bigint>" if ids else ""))
    sizes = stored.select("part", "segment", "tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = (sizes.groupBy("part").agg(F.sum("tokens").alias("t"))  # one row per range
             .select("part", F.coalesce(F.sum("t").over(before.orderBy("part")), F.lit(0)).alias("base")))
    starts = (sizes.join(parts, "part")
              .select("part", "segment", (F.col("base") + F.coalesce(F.sum("tokens").over(
                  Window.partitionBy("part").orderBy("segment")
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base")))
    out = rows.join(starts, ["part", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens",
                      "ids_crc32", *(["ids"] if ids else []))


def round_trip(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, end)
    return read_tokens(docs.sparkSession, folder)


def byte_bpe() -> str:
    """Place of the public byte-level tokenizer's file, which is never copied here."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
