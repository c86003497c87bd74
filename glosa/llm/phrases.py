"""Phrase collocation mining (operator 11): Rabin-Karp fingerprints of word n-grams.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at
spaces and tabs into words.  A task sees its rows as one byte buffer: prefix
polynomials over the bytes hash every word, prefix polynomials over the word
hashes every n-gram, both with numpy and without a loop over words.

1. Fingerprints are counted by a shuffle, shortest first: words, then pairs of
   words, then phrases of three to ``LONGEST``.  A longer phrase is only emitted where
   all its words, then all its pairs, are frequent; the frequent fingerprints go to
   the tasks as a bitmap of bounded size (``MAX_BITS``).  Equal bits only let more through.
2. Phrases whose fingerprint is frequent are looked up in the texts: the words' bytes are compared, pairs of
   equal words are numbered, and the phrase of a fingerprint is held against the text to which a pointer to an
   occurrence leads.  So each phrase is counted by its text, colliding fingerprints are told apart, and no text is made for the rest.
3. Each cut of a candidate finds the counts of its parts by joins; the score is exact
   (decimals of 38 digits).

Defined results: null text is empty text, null lang is ``und`` (as the lang ``und``);
repeated rows count each; ties go by phrase (UTF-8 bytes); an empty table gives an
empty result; ``first_doc`` is null if no row with the phrase has an id; other columns
are left alone.  A task holds a block of rows of ``BLOCK_BYTES``, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosa.llm.common import blank, broadcast_if_small, written
from glosa.llm.shingles import mix64

LEAST = 100
LONGEST = 5
TOP = 2000
BLOCK_BYTES = 4 << 20
WINDOW = 1 << 18  # words whose n-grams are sorted at once
HELD = 1 << 20  # fingerprints or phrases that a task gathers before it hands them on
SALTS = 64
MAX_BITS = 30  # of the bitmap: 128 MB at most
FINGERPRINTS = "fp long, n long"
PHRASES = "lang string, words int, phrase string, a long, first_doc long"
NO_DOC = np.iinfo(np.int64).max

#: What ends a piece, what ends a word.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(BREAKS + SPACES)] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_POWER_STEP = 1 << 19


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, i below ``_POWER_STEP``."""
    if base not in _POWERS:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(_POWER_STEP, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], from prefix sums of values * base^i; the prefix
    sums exist for one step of ``_POWER_STEP`` values at a time.  ``start`` and ``end`` ascend."""
    up, down = _powers(base)
    at_start, at_end = np.zeros(len(start), np.uint64), np.zeros(len(end), np.uint64)
    shift = np.ones(len(start), np.uint64)
    inverse, so_far = pow(base, -1, 1 << 64), 0
    for lo in range(0, len(values), _POWER_STEP):
        part = values[lo: lo + _POWER_STEP].astype(np.uint64) * up[: min(_POWER_STEP, len(values) - lo)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        factor = np.uint64(pow(base, lo, 1 << 64))
        back = np.uint64(pow(inverse, lo, 1 << 64))
        s = slice(*np.searchsorted(start, [lo, lo + len(part)]))
        at_start[s] = sums[start[s] - lo] * factor + np.uint64(so_far)
        shift[s] = down[start[s] - lo] * back
        e = slice(*np.searchsorted(end, [lo + 1, lo + len(part) + 1]))
        at_end[e] = sums[end[e] - lo] * factor + np.uint64(so_far)
        so_far = (so_far + int(sums[-1]) * int(factor)) & ((1 << 64) - 1)
    return (at_end - at_start) * shift


class Block:
    """The words of some rows: ``raw`` lower-cased bytes, ``start`` and ``end`` of each word in them,
    its ``piece``, its ``row`` and its 64-bit ``word`` hash, which depends on the row's language."""

    def __init__(self, langs: list[str], texts: pa.Array):
        offsets = np.asarray(pa.Array.from_buffers(pa.int32(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset)).astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.padded = np.zeros(len(raw) + 8, np.uint8)
        self.padded[: len(raw)] = _LOWER[raw]
        self.raw = self.padded[: len(raw)]
        bounds = offsets - offsets[0]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        word = _IN_WORD[self.raw]
        opens, closes = word.copy(), word.copy()  # first and last byte of a word
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        stops = np.sort(np.concatenate([np.flatnonzero(_BREAK[self.raw]), inner]))
        self.piece = np.searchsorted(stops, self.start, "right")
        self.row = np.searchsorted(bounds, self.start, "right") - 1
        self.langs = langs
        keys = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        own = np.array([keys[x] for x in langs] or [0], np.uint64)
        hashes = span_hashes(self.raw, self.start, self.end, _BASES[0])
        self.word = mix64(hashes + (self.end - self.start).astype(np.uint64)) ^ own[self.row]

    def numbers(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the words at these places, equal where the words' bytes are: by their hashes, then every word's
        bytes are held against the first one's, eight at a time."""
        _, first, inverse = np.unique(self.word[at], return_index=True, return_inverse=True)
        start, same = self.start[at], self.start[at[first]][inverse]
        left = self.end[at] - start
        eights = np.lib.stride_tricks.as_strided(self.padded, (len(self.raw) + 1, 8), (1, 1), writeable=False)
        clash = bool((left != left[first][inverse]).any())
        while len(left) and not clash:
            mask = ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)))
            clash = bool((((eights[start].view(np.uint64)[:, 0]) ^ (eights[same].view(np.uint64)[:, 0])) & mask).any())
            more = left > 8
            start, same, left = start[more] + 8, same[more] + 8, left[more] - 8
        if clash:
            raw, ids = self.raw.tobytes(), {}
            return np.array([ids.setdefault(raw[x:y], len(ids)) for x, y in zip(self.start[at].tolist(), self.end[at].tolist())], np.int64)
        return inverse

    def windows(self, longest: int) -> Iterator[tuple[slice, int]]:
        """(words, those that start an n-gram here), with the words that such n-grams run into."""
        for lo in range(0, len(self.word), WINDOW):
            hi = min(lo + WINDOW, len(self.word))
            yield slice(lo, min(hi + longest - 1, len(self.word))), hi - lo


def fingerprints(word: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Of each n-gram of word hashes, by its first word."""
    if n == 1:
        fp = mix64(word)
    else:
        first = np.arange(max(0, len(word) - n + 1))
        fp = mix64(span_hashes(word, first, first + n, _BASES[1]) + np.uint64(n))
    return fp & np.uint64((1 << bits) - 1) if bits < 64 else fp


def row_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``BLOCK_BYTES`` of text, or of one row."""
    texts = batch.column("text")
    sizes = np.diff(np.asarray(pa.Array.from_buffers(pa.int32(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset)))
    lo, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and held + s > BLOCK_BYTES:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += s
    if len(sizes) > lo:
        yield batch.slice(lo)


class Frequent:
    """A bitmap of fingerprints: ``has`` is never false for one that was put in."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.bits = data, bits

    def has(self, fp: np.ndarray) -> np.ndarray:
        at = fp & np.uint64((1 << self.bits) - 1)
        byte = np.frombuffer(self.data, np.uint8)[(at >> np.uint64(3)).astype(np.int64)]
        return (byte >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _bitmap(fps: DataFrame) -> Frequent:
    """The fingerprints' bitmap, 16 bits or more for each up to ``MAX_BITS``: built by a shuffle, and
    of bounded size whatever their number."""
    bits = min(MAX_BITS, max(20, (16 * fps.count()).bit_length()))
    key = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    parts = fps.select(F.shiftright(key, 15).alias("at"), key.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("part"))
    data = bytearray(1 << (bits - 3))
    for r in parts.collect():  # at most 2^(bits - 15) rows of 4 KB
        data[r["at"] * 4096: r["at"] * 4096 + len(r["part"])] = r["part"]
    return Frequent(bytes(data), bits)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    fps, counts = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(fps, kind="stable")
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]]))
    return fps[first], np.add.reduceat(counts, first)


def counter(lengths: tuple[int, ...], known, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the n-grams of these lengths whose parts, one word shorter than the least length,
    are all in ``known`` (a broadcast bitmap; None: all are counted)."""

    def out(fps: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(counts)], ["fp", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in row_blocks(batch):
                block = Block(rows.column("lang").to_pylist(), rows.column("text"))
                for part, starts in block.windows(lengths[-1]):
                    word, piece = block.word[part], block.piece[part]
                    whole = None
                    if known is not None:
                        good = known.value.has(fingerprints(word, lengths[0] - 1, bits))
                    for n in lengths:
                        here = min(starts, len(word) - n + 1)
                        if here <= 0:
                            break
                        whole = piece[:here] == piece[n - 1: n - 1 + here]
                        if known is not None:
                            for k in range(n - lengths[0] + 2):
                                whole &= good[k: k + here]
                        fps, counts = np.unique(fingerprints(word, n, bits)[:here][whole], return_counts=True)
                        if len(fps):
                            held.append((fps, counts.astype(np.int64)))
                            size += len(fps)
                    if size > HELD:
                        held = [_merged(held)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield out(*held[0])
                            held, size = [], 0
        if held:
            yield out(*_merged(held))

    return count


def speller(longest: int, known, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, words, phrase, a, first_doc) of the phrases whose fingerprints are in ``known``, exact;
    and per language a row without words that counts all word occurrences."""

    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("a", pa.int64()), ("first_doc", pa.int64())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}  # by words and fingerprint, or by language, words and text where fingerprints clash

        def entry(lang: str, n: int, fp: int, raw: bytes, s: list[int], e: list[int]) -> list:
            """The entry [lang, words, phrase, a, first_doc, bytes in the text] of a phrase that stands at s[0]."""
            said = raw[s[0]: e[n - 1]]
            own = found.get((n, fp))
            if own is not None and own[0] == lang and own[5] == said:
                return own
            phrase = b" ".join(raw[x:y] for x, y in zip(s, e)).decode()
            if own is None:
                own = found[n, fp] = [lang, n, phrase, 0, NO_DOC, said]
            elif (own[0], own[2]) != (lang, phrase):
                own = found.setdefault((lang, n, phrase), [lang, n, phrase, 0, NO_DOC, said])
            return own

        def out() -> pa.RecordBatch:
            cols = list(zip(*found.values()))
            cols[4] = [None if d == NO_DOC else d for d in cols[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for rows in row_blocks(batch):
                langs = rows.column("lang").to_pylist()
                block = Block(langs, rows.column("text"))
                docs = np.array([NO_DOC if x is None else x for x in rows.column("id").to_pylist()], np.int64)
                names = list(dict.fromkeys(langs))
                places = {x: i for i, x in enumerate(names)}
                lang = np.array([places[x] for x in langs], np.int64)
                for i, n in enumerate(np.bincount(lang[block.row], minlength=len(names)).tolist()):
                    found.setdefault((0, names[i]), [names[i], 0, None, 0, NO_DOC, b""])[3] += n
                raw = block.raw.tobytes()
                for part, starts in block.windows(longest):
                    word, piece, row = block.word[part], block.piece[part], block.row[part]
                    good = known.value.has(fingerprints(word, 1, bits))
                    at = np.flatnonzero(good)
                    number = np.zeros(len(word), np.int64)
                    number[at] = block.numbers(at + part.start)
                    number = number * len(names) + lang[row]
                    for n in range(1, longest + 1):
                        fps = fingerprints(word, n, bits)
                        if n > 1:  # a phrase is the pair of its first and its last n - 1 words
                            good = good[:-1] & good[1:] & (piece[: len(word) - n + 1] == piece[n - 1:]) & known.value.has(fps)
                            number = number[:-1] * (int(number.max(initial=0)) + 1) + number[1:]
                        at = np.flatnonzero(good)
                        uniq, first, inverse = np.unique(number[at], return_index=True, return_inverse=True)
                        number = np.zeros(len(number), np.int64)
                        number[at] = inverse
                        own = at < starts  # the words behind the window have their turn
                        counts = np.bincount(inverse[own], minlength=len(uniq))
                        least = np.full(len(uniq), NO_DOC)
                        np.minimum.at(least, inverse[own], docs[row[at[own]]])
                        first = at[first]
                        places_of = first[:, None] + np.arange(n) + part.start
                        for i, fp, s, e, c, d in zip(row[first].tolist(), fps[first].tolist(), block.start[places_of].tolist(), block.end[places_of].tolist(), counts.tolist(), least.tolist()):
                            if c:
                                x = entry(langs[i], n, fp, raw, s, e)
                                x[3] += c
                                x[4] = min(x[4], d)
                        if len(word) <= n:
                            break
                if len(found) > HELD:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return spell


def phrase_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST,
                  longest: int = LONGEST, fingerprint_bits: int = 64) -> DataFrame:
    """(lang, words, phrase, a, first_doc): all phrases of 1 to ``longest`` words that occur
    ``least`` times or more in their language, with the least id of a row that has it; and
    per language a row with 0 words and a null phrase: all word occurrences."""
    spark: SparkSession = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(lang, F.lit("und")).cast("string").alias("lang"), blank(text).alias("text"))
    parts = [(n,) for n in range(1, min(longest, 2) + 1)] + [tuple(range(3, longest + 1))] * (longest > 2)
    frequent, last = None, None
    for lengths in parts:
        counts = rows.select("lang", "text").mapInArrow(counter(lengths, last, fingerprint_bits), FINGERPRINTS)
        own = written(counts.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp"), "fingerprints")
        frequent = own if frequent is None else frequent.unionByName(own)
        if lengths is not parts[-1]:
            last = sc.broadcast(_bitmap(own))
    known = sc.broadcast(_bitmap(frequent))
    spelled = rows.mapInArrow(speller(longest, known, fingerprint_bits), PHRASES)
    return written(spelled.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"), F.min("first_doc").alias("first_doc"))
                   .where((F.col("a") >= least) | (F.col("words") == 0)), "phrases")


def collocations(counts: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, first_doc) from ``phrase_counts``."""
    total = broadcast_if_small(counts.where("words = 0").select(F.col("lang").alias("t_lang"), F.col("a").alias("n")))  # a row per language
    part = counts.where("words > 0").select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p"), F.col("a").alias("p_a"))
    candidates = counts.where("words > 1")
    w = F.split("phrase", " ")

    def piece(at, size):
        return F.array_join(F.slice(w, at, size), " ")

    # each phrase inside a longer candidate, once per phrase with the longer one's largest count
    inner = candidates.where("words > 2").select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy(F.col("lang").alias("i_lang"), piece(F.col("at"), F.col("size")).alias("i")).agg(F.max("a").alias("longer"))
    kept = candidates.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i")), "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "first_doc", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "first_doc", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(part.withColumnsRenamed({"p_a": "l"}), (F.col("lang") == F.col("p_lang")) & (F.col("left") == F.col("p"))).drop("p_lang", "p")
    cuts = cuts.join(part.withColumnsRenamed({"p_a": "r"}), (F.col("lang") == F.col("p_lang")) & (F.col("right") == F.col("p"))).drop("p_lang", "p")
    cuts = cuts.join(total, F.col("lang") == F.col("t_lang"))
    score = F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)")
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("first_doc").alias("first_doc"))
    order = [F.col("c.score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # the first of each part, then of all parts
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score", "first_doc")


def mine_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, top: int = TOP, fingerprint_bits: int = 64) -> DataFrame:
    """Each language's ``top`` collocations."""
    return collocations(phrase_counts(docs, doc_id, text, lang, least, longest, fingerprint_bits), top)
