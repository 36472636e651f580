"""Phrases that occur together more often than their parts, counted with double-array tries."""

import pickle
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelfold.llm.textscan import as_bytes, mix, pieces
from panelfold.llm.wordscan import Words, byte_table
from panelfold.session import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
TABLE = byte_table(b"\x20\x09", b".,;:!?\x0A\x0B\x0C\x0D")
# Entries a task holds before it sends them on; keys of one broadcast; candidates of one trie;
# tries that a task holds at once; word pairs, and phrases, that it counts before it sends them.
HELD, KEYS, CANDIDATES, AT_ONCE, PAIRS, PHRASES = 1 << 17, 1 << 20, 1 << 16, 16, 1 << 21, 1 << 18
# Counts of a trie's phrases that a task sends in one row.
COUNTS = 1 << 12
# A slice of the pair buckets, and words of the corpus per bucket.
SLICE_BITS, WORDS_PER_BUCKET = 16, 8


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _lang_code(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _read(batches):
    """``Words`` of each piece, each word's key (word and language) and languages by row."""
    for batch in pieces(batches):
        langs = batch.column(0).to_pylist()
        words = Words(as_bytes(batch.column(1)), TABLE)
        codes = {lang: _lang_code(lang) for lang in set(langs)}
        tail = np.array([codes[lang] for lang in langs], np.uint64)
        yield words, mix(words.hash ^ tail[words.row]) if len(words.row) else words.hash, langs


# ---- words ------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word (UTF-8 bytes), n``: occurrences of every word."""
    flat = bytes(0x20 if b == 0x0A else b for b in TABLE)

    def sent(held):
        for lang, counts in held.items():
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    def run(batches):
        held = defaultdict(Counter)
        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                held[lang].update(text.translate(flat).split())
            if sum(map(len, held.values())) > HELD:
                yield from sent(held)
                held.clear()
        yield from sent(held)

    return (_named(docs).mapInArrow(run, "lang string, word binary, n bigint")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _keyed(words: DataFrame) -> DataFrame:
    """``key`` of each (lang, word), as ``_read`` has it."""
    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = Words(texts, TABLE)
            tail = np.array([_lang_code(lang) for lang in langs], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(found.hash ^ tail).view(np.int64))], names=["key"])

    return words.select("lang", "word").mapInArrow(run, "key bigint")


# ---- sets of keys, broadcast in parts of bounded size -------------------------

def _parts(keys: DataFrame, size: int):
    """The rows of ``keys`` (key and others) in parts of about ``size``, sorted by key."""
    keys = materialize(keys, "keys")
    parts = max(1, -(-keys.count() // size))
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    for k in range(parts):
        chosen = keys.where(part == k) if parts > 1 else keys
        rows = chosen.toPandas()
        values = [rows[c].to_numpy(np.int64).view(np.uint64) for c in keys.columns]
        order = np.argsort(values[0])
        yield [v[order] for v in values]


def _within(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are among the sorted ``chosen``."""
    if not len(chosen):
        return np.zeros(len(keys), bool)
    return chosen[np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)] == keys


class KeySet:
    """Keys of any number: broadcasts of at most ``KEYS`` entries each, asked one after another."""

    def __init__(self, spark, keys: DataFrame):
        self.parts = [spark.sparkContext.broadcast(part) for part, in _parts(keys, KEYS)]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for part in self.parts:
            found |= _within(keys, part.value)
        return found


class KeyPairs:
    """As ``KeySet``, of rows (key, other): whether a key has that other value."""

    def __init__(self, spark, rows: DataFrame):
        self.parts = [spark.sparkContext.broadcast(part) for part in _parts(rows, KEYS)]

    def __call__(self, keys: np.ndarray, others: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for part in self.parts:
            own, other = part.value
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                found |= (own[at] == keys) & (other[at] == others)
        return found


# ---- word pairs: an upper bound of their counts ---------------------------------

def _pairs(words: Words, keys: np.ndarray):
    """Where a word joins the next one, and the hash of such a pair."""
    at = np.flatnonzero(words.joins)
    return at, mix(keys[at] * np.uint64(3) + keys[at + 1]) if len(at) else keys[:0]


def _bucket(pairs: np.ndarray, bits: int) -> np.ndarray:
    return pairs >> np.uint64(64 - bits)


def _likely(words: Words, keys: np.ndarray, frequent: KeySet, buckets: KeySet, bits: int, inside=None):
    """Places and hashes of the pairs of frequent words that lie in a frequent bucket."""
    at, pairs = _pairs(words, keys)
    if inside is not None:
        at, pairs = at[inside[at]], pairs[inside[at]]
    likely = buckets(_bucket(pairs, bits))
    at, pairs = at[likely], pairs[likely]
    often = frequent(np.r_[keys[at], keys[at + 1]]) if len(at) else np.zeros(0, bool)
    often = often[:len(at)] & often[len(at):]
    return at[often], pairs[often]


def _triples(keys: np.ndarray, at: np.ndarray, pairs: np.ndarray):
    """Where one likely pair follows another, and the hash of the three words."""
    good = np.zeros(len(keys) + 2, bool)
    good[at] = True
    on = good[at + 1]
    at, pairs = at[on], pairs[on]
    return at, mix(pairs * np.uint64(5) + keys[at + 2]) if len(at) else pairs


def frequent_buckets(docs: DataFrame, hashes, bits: int, least: int) -> DataFrame:
    """``key``: buckets into which at least ``least`` of the hashes fall.

    ``hashes`` gives the hashes of a piece's word groups (words, keys). A group occurs at most as
    often as its bucket (Park, Chen and Yu 1995). Tasks count buckets themselves and
    send compact slices; their number grows with the corpus, so that a slice stays
    bounded. Counts stop at 255, which is beyond any ``least`` allowed.
    """
    if least > 255:
        raise ValueError("local counts stop at 255")

    def sent(held):
        buckets, counts = np.unique(np.concatenate(held), return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        part = (buckets >> np.uint64(SLICE_BITS)).astype(np.int64)
        inner = (buckets & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint16)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        last = np.r_[first[1:], len(part)]
        for start in range(0, len(first), 4096):
            span = list(zip(first[start:start + 4096], last[start:start + 4096]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first[start:start + 4096]]),
                 pa.array([np.diff(inner[i:j], prepend=np.uint16(0)).tobytes() for i, j in span], pa.binary()),
                 pa.array([counts[i:j].tobytes() for i, j in span], pa.binary())],
                names=["part", "places", "counts"])

    def run(batches):
        held, size = [], 0
        for words, keys, _ in _read(batches):
            bucket = _bucket(hashes(words, keys), bits)
            if len(bucket):
                held.append(bucket)
                size += len(bucket)
            if size > PAIRS:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for places, counts in zip(rows["places"], rows["counts"]):
            total[np.cumsum(np.frombuffer(places, np.uint16), dtype=np.int64)] += np.frombuffer(counts, np.uint8)
        full = np.flatnonzero(total >= least)
        return pd.DataFrame({"key": (int(rows["part"].iloc[0]) << SLICE_BITS) + full})

    return (_named(docs).mapInArrow(run, "part bigint, places binary, counts binary")
            .groupBy("part").applyInPandas(add, "key bigint"))


# ---- candidates -----------------------------------------------------------------

def _row_digests(words: Words, keys: np.ndarray) -> np.ndarray:
    """For every word a digest of its row's words."""
    if not len(keys):
        return keys
    first = np.flatnonzero(np.r_[True, words.row[1:] != words.row[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    place = np.arange(len(keys)) - np.repeat(first, size)
    return np.repeat(np.add.reduceat(mix(keys + place.astype(np.uint64)), first), size)


def candidates(docs: DataFrame, frequent: KeySet, pairs_in: KeySet, triples_in: KeySet, bits: int,
               longest: int, least: int) -> DataFrame:
    """Distinct ``lang, phrase (UTF-8 bytes), pair`` of two and more words that may be frequent:
    all words are, every pair and triple within lies in a frequent bucket, and the phrase's hash
    occurs ``least`` times. ``pair`` is the hash of the first two words.
    """
    return sent_phrases(docs, frequent, pairs_in, triples_in, bits, longest, least).distinct()


def sent_phrases(docs: DataFrame, frequent: KeySet, pairs_in: KeySet, triples_in: KeySet, bits: int,
                 longest: int, least: int) -> DataFrame:
    """``lang, phrase, pair`` as tasks send them.

    Tasks first send the phrases' hashes with their counts, packed, and one row that each
    is in. The texts of those that are frequent then come from the chosen row only (and
    rows of the same words, once a task), not from every task that has them.
    """
    spark, part_bits = docs.sparkSession, max(1, bits - SLICE_BITS)  # more parts of a larger corpus

    def found(words, keys, inside=None):
        at, pairs = _likely(words, keys, frequent, pairs_in, bits, inside)
        first, triples = _triples(keys, at, pairs)
        good = np.zeros(len(keys) + longest, bool)
        good[first[triples_in(_bucket(triples, bits))]] = True
        for width in range(2, longest + 1):
            if width > 2:
                at, pairs = at[good[at + width - 3]], pairs[good[at + width - 3]]
            if not len(at):
                return
            code = keys[at]
            for k in range(1, width):
                code = mix(code * np.uint64(5) + keys[at + k])
            yield width, at, pairs, mix(code + np.uint64(width))

    def counts(batches):
        held, size = [], 0
        for words, keys, _ in _read(batches):
            digest = _row_digests(words, keys)
            for _, at, _, code in found(words, keys):
                code, new, times = np.unique(code, return_index=True, return_counts=True)
                held.append((code, times, digest[at[new]]))
                size += len(code)
            if size > PHRASES:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def summed(held):
        code, times, digest = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(code)
        code, times, digest = code[order], times[order], digest[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return code[first], np.add.reduceat(times, first), np.minimum.reduceat(digest, first)

    def packed(held):
        code, times, digest = summed(held)
        part = (code >> np.uint64(64 - part_bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        span = list(zip(first.tolist(), np.r_[first[1:], len(part)].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[first]), *(pa.array([x[i:j].tobytes() for i, j in span], pa.binary())
                                      for x in (code, times.astype(np.uint32), digest))],
            names=["part", "codes", "times", "digests"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        code, times, digest = summed([
            (np.frombuffer(c, np.uint64), np.frombuffer(t, np.uint32).astype(np.int64), np.frombuffer(d, np.uint64))
            for c, t, d in zip(rows["codes"], rows["times"], rows["digests"])])
        often = times >= least
        return pd.DataFrame({"key": code[often].view(np.int64), "row": digest[often].view(np.int64)})

    def sent(held):
        for lang, phrases in held.items():
            if phrases:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(phrases), pa.string()), pa.array(list(phrases), pa.binary()),
                     pa.array(np.array(list(phrases.values()), np.uint64).view(np.int64))],
                    names=["lang", "phrase", "pair"])

    rows = _named(docs)
    often = materialize(rows.mapInArrow(counts, "part bigint, codes binary, times binary, digests binary")
                        .groupBy("part").applyInPandas(add, "key bigint, row bigint"), "frequent_hashes")
    chosen = KeyPairs(spark, often)
    wanted = KeySet(spark, often.select(F.col("row").alias("key")).distinct())

    def run(batches):
        held = defaultdict(dict)
        for words, keys, langs in _read(batches):
            digest = _row_digests(words, keys)
            inside = wanted(digest)
            for width, at, pairs, code in found(words, keys, inside):
                mine = chosen(code, digest[at])
                at, pairs = at[mine], pairs[mine]
                _, new = np.unique(code[mine], return_index=True)
                for i, pair in zip(at[new].tolist(), pairs[new].tolist()):
                    held[langs[words.row[i]]][words.text(i, i + width - 1)] = pair
            if sum(map(len, held.values())) > PHRASES:
                yield from sent(held)
                held.clear()
        yield from sent(held)

    return rows.mapInArrow(run, "lang string, phrase binary, pair bigint")


class Trie:
    """Double-array trie of phrases: ``base[state] + word`` leads on where ``check`` agrees.

    ``vocabulary`` holds the sorted word keys; a word's id is its place there, from 1.
    ``place`` of a state is the phrase's number, -1 where no phrase ends.
    """

    PARTS = ("vocabulary", "base", "check", "place")

    def __init__(self, phrases: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.uint64)
        self.phrases = len(phrases)
        longest = max(map(len, phrases), default=0)
        ids = np.zeros((len(phrases), longest), np.int64)
        for k, phrase in enumerate(phrases):
            ids[k, :len(phrase)] = np.searchsorted(self.vocabulary, phrase) + 1
        width = len(self.vocabulary) + 1
        # Nodes level by level: the distinct (node above, word).
        node, ends, parents, words, total = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64), [], [], 1
        for level in range(longest):
            on = np.flatnonzero(ids[:, level])
            pairs, inverse = np.unique(node[on] * width + ids[on, level], return_inverse=True)
            parents.append(pairs // width)
            words.append(pairs % width)
            node[on] = ends[on] = total + inverse
            total += len(pairs)
        parents, words = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, words))
        self._lay(parents, words, total, width)
        self.place = np.full(len(self.check), -1, np.int32)
        self.place[self.slot[ends]] = np.arange(len(phrases))
        del self.slot

    def dump(self) -> bytes:
        return pickle.dumps((self.phrases, [getattr(self, part) for part in self.PARTS]))

    @classmethod
    def load(cls, data: bytes) -> "Trie":
        trie = cls.__new__(cls)
        trie.phrases, parts = pickle.loads(data)
        for name, part in zip(cls.PARTS, parts):
            setattr(trie, name, part)
        return trie

    def _lay(self, parents, words, total, width):
        """Give every node a slot: large families first, only children into what is free."""
        order = np.argsort(parents, kind="stable")
        parents, words, child = parents[order], words[order], order + 1
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(parents)])
        # Probes are random and the table is sparse, so a family needs few of them.
        used = np.zeros(3 * (width + total), bool)
        probe = np.random.default_rng(1)
        self.slot, base = np.zeros(total, np.int64), np.zeros(total, np.int64)
        used[0] = True
        for k in np.argsort(-size, kind="stable"):
            if size[k] == 1:
                break
            own = words[first[k]:first[k] + size[k]]
            start = 0
            while used[start + own].any():
                start = int(probe.integers(len(used) - width))
            used[start + own] = True
            base[parents[first[k]]] = start
            self.slot[child[first[k]:first[k] + size[k]]] = start + own
        single = first[size == 1]
        free = np.flatnonzero(~used)
        if len(free) < len(single):
            free = np.r_[free, len(used) + np.arange(len(single))]
        free = free[:len(single)]
        base[parents[single]] = free - words[single]
        self.slot[child[single]] = free
        top = int(max(self.slot.max(initial=0), base.max(initial=0)) + width + 1)
        check = np.full(top, -1, np.int32)
        owner = np.zeros(total, np.int64)
        owner[child] = parents
        check[self.slot[1:]] = self.slot[owner[1:]]
        self.base = np.zeros(top, np.int32)
        self.base[self.slot] = base
        self.base[0] = base[0]
        self.check = check

    def count(self, keys: np.ndarray, joins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of every phrase that begin at places ``at`` of a run of words: all
        places advance together, one word at a time."""
        counts = np.zeros(self.phrases, np.int64)
        if not self.phrases:
            return counts
        state = np.zeros(len(at), np.int64)
        while len(at):
            word = np.searchsorted(self.vocabulary, keys[at])
            known = self.vocabulary[np.minimum(word, len(self.vocabulary) - 1)] == keys[at]
            at, state, word = at[known], state[known], word[known] + 1
            following = self.base[state] + word
            fits = (following >= 0) & (following < len(self.check))
            fits[fits] = self.check[following[fits]] == state[fits]
            at, state = at[fits], following[fits]
            ended = self.place[state]
            counts += np.bincount(ended[ended >= 0], minlength=self.phrases)
            on = joins[at]
            at, state = at[on] + 1, state[on]
        return counts


def _phrase_keys(langs, phrases) -> list[np.ndarray]:
    found = Words(list(phrases), TABLE)
    tail = np.array([_lang_code(lang) for lang in langs], np.uint64)
    keys = mix(found.hash ^ tail[found.row]) if len(found.row) else found.hash
    return np.split(keys, np.cumsum(np.bincount(found.row, minlength=len(langs)))[:-1])


def _tries(chosen: DataFrame) -> DataFrame:
    """``chunk, part, trie``: the tries of the chosen phrases, built where the phrases are."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        trie = Trie(_phrase_keys(rows["lang"], map(bytes, rows["phrase"])))
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1], "trie": [trie.dump()]})

    return chosen.groupBy("chunk", "part").applyInPandas(build, "chunk int, part int, trie binary")


def phrase_counts(docs: DataFrame, chosen: DataFrame, buckets: KeySet, bits: int, least: int) -> DataFrame:
    """``lang, phrase, a`` of the candidates that occur at least ``least`` times.

    Candidates are cut into tries of about ``CANDIDATES`` phrases by their first two words,
    so a broadcast is bounded and a place in a text meets one trie (more, where over
    twice that many phrases begin alike). A pass over the texts takes ``AT_ONCE`` tries; passes
    grow with the candidates.
    """
    spark = docs.sparkSession
    chosen = materialize(chosen, "candidates")
    chunks = max(1, -(-chosen.count() // CANDIDATES))
    chosen = materialize(chosen.withColumn(
        "chunk", F.pmod(F.shiftrightunsigned("pair", 33), F.lit(chunks)).cast("int")), "chunks")
    sizes = chosen.groupBy("chunk").agg(F.ceil(F.count("*") / (2 * CANDIDATES)).alias("parts"))
    chosen = (chosen.join(sizes, "chunk")
              .withColumn("part", F.pmod(F.xxhash64("lang", "phrase"), F.col("parts")).cast("int"))
              .withColumn("place", F.row_number().over(
                  Window.partitionBy("chunk", "part").orderBy("lang", "phrase")) - 1))
    chosen = materialize(chosen.select("chunk", "part", "place", "lang", "phrase"), "numbered")
    built = materialize(_tries(chosen), "tries")
    names = sorted((r["chunk"], r["part"]) for r in built.select("chunk", "part").collect())
    size, sums = COUNTS, []

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(counts, np.int64) for counts in rows["counts"])
        found = np.flatnonzero(total >= least)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "part": rows["part"].iloc[0],
                             "place": rows["slice"].iloc[0] * size + found, "a": total[found]})

    for start in range(0, len(names), AT_ONCE):
        tries = []
        for chunk, part in names[start:start + AT_ONCE]:
            row = built.where((F.col("chunk") == chunk) & (F.col("part") == part)).select("trie").first()
            tries.append((chunk, part, spark.sparkContext.broadcast(bytes(row["trie"]))))

        def run(batches, tries=tries):
            held = [(chunk, part, Trie.load(data.value)) for chunk, part, data in tries]
            totals = [np.zeros(trie.phrases, np.int64) for _, _, trie in held]
            for words, keys, _ in _read(batches):
                at, pairs = _pairs(words, keys)
                likely = buckets(_bucket(pairs, bits))
                at, chunk_of = at[likely], (pairs[likely] >> np.uint64(33)) % np.uint64(chunks)
                for total, (chunk, _, trie) in zip(totals, held):
                    total += trie.count(keys, words.joins, at[chunk_of == chunk])
            for total, (chunk, part, _) in zip(totals, held):
                slices = [k for k in range(-(-len(total) // size)) if total[k * size:(k + 1) * size].any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slices), chunk, np.int32)), pa.array(np.full(len(slices), part, np.int32)),
                     pa.array(np.array(slices, np.int32)),
                     pa.array([total[k * size:(k + 1) * size].tobytes() for k in slices], pa.binary())],
                    names=["chunk", "part", "slice", "counts"])

        counted = (_named(docs).mapInArrow(run, "chunk int, part int, slice int, counts binary")
                   .groupBy("chunk", "part", "slice").applyInPandas(add, "chunk int, part int, place int, a bigint"))
        sums.append(materialize(counted, "phrase_counts"))
        for _, _, data in tries:
            data.unpersist()
    if not sums:
        return chosen.select("lang", "phrase", F.lit(0).cast("bigint").alias("a"))
    return chosen.join(reduce(DataFrame.unionAll, sums), ["chunk", "part", "place"]).select("lang", "phrase", "a")


# ---- scores -----------------------------------------------------------------------

def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score``, subsumed phrases left out.

    The score is that of the lowest cut: floor(1000 a n / (l r)) in decimals.
    """
    parts = materialize(
        phrases.select("lang", F.col("phrase").cast("string").alias("phrase"), "a")
        .unionAll(words.select("lang", F.col("word").cast("string"), F.col("n").alias("a"))), "parts")
    split = F.split("phrase", " ")
    rows = (parts.withColumn("w", split).where(F.size("w") > 1)
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
            .withColumns({"head": F.array_join(F.slice("w", 1, F.col("k")), " "),
                          "rest": F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ")}))
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = "cast({} as decimal(19,0))"
    score = F.expr(f"cast(1000 * a as decimal(19,0)) * {wide.format('n')} div ({wide.format('l')} * {wide.format('r')})")
    best = (rows.drop("w").join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
            .withColumn("score", score).groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    # A phrase goes where a longer one that holds it occurs as often (never more often).
    longer = (parts.withColumn("w", split).where(F.size("w") > 2)
              .withColumn("width", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)))
              .select("lang", F.array_join(F.slice("w", F.col("at"), F.col("width")), " ").alias("phrase"),
                      F.col("a").alias("as_often"))
              .groupBy("lang", "phrase").agg(F.max("as_often").alias("as_often")))
    return (best.join(longer, ["lang", "phrase"], "left")
            .where(F.col("as_often").isNull() | (F.col("as_often") < F.col("a"))).drop("as_often"))


def bounds(docs: DataFrame, often: DataFrame, total: int, least: int):
    """Frequent words, frequent buckets of pairs and of triples, and the bits of a bucket."""
    spark = docs.sparkSession
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / WORDS_PER_BUCKET)), SLICE_BITS, 48))
    frequent = KeySet(spark, _keyed(often))

    def pairs(words, keys):
        at, found = _pairs(words, keys)
        known = frequent(keys)
        return found[known[at] & known[at + 1]] if len(at) else found

    pairs_in = KeySet(spark, frequent_buckets(docs, pairs, bits, least))

    def triples(words, keys):
        return _triples(keys, *_likely(words, keys, frequent, pairs_in, bits))[1]

    return frequent, pairs_in, KeySet(spark, frequent_buckets(docs, triples, bits, least)), bits


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Words are folded for A-Z only; phrases don't cross punctuation or lines. Null
    text counts as empty, null lang as ``und``; repeated rows count each; ties go by
    count, then phrase. A language without frequent phrases, or an empty table, gives
    no rows. Other columns aren't read.
    """
    words = materialize(word_counts(docs), "words")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    often = materialize(words.where(F.col("n") >= least), "frequent_words")
    total = totals.agg(F.sum("n")).first()[0] or 0
    frequent, pairs_in, triples_in, bits = bounds(docs, often, total, least)
    chosen = candidates(docs, frequent, pairs_in, triples_in, bits, longest, least)
    found = materialize(phrase_counts(docs, chosen, pairs_in, bits, least), "phrases")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (scored(found, often, totals).withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, 1000 * c.a * t.n // (x.a * y.a) AS score, s.cut
  FROM c JOIN t USING (lang), range(1, 5) AS s(cut)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:s.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[s.cut + 1:], ' ')
  WHERE s.cut < c.k QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, s.cut) = 1),
b AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) AS s(m) WHERE m < k) GROUP BY ALL)
SELECT u.lang, row_number() OVER (PARTITION BY u.lang ORDER BY score DESC, u.a DESC, u.phrase) AS rank,
       u.phrase, u.a::BIGINT AS a, u.l::BIGINT AS l, u.r::BIGINT AS r, u.n::BIGINT AS n, u.score::BIGINT AS score
FROM u LEFT JOIN b USING (lang, phrase) WHERE b.longer IS NULL OR 100 * b.longer < 100 * u.a
QUALIFY rank <= 2000
"""
