"""SentencePiece encoding and decoding (operator 8) with exact N-best segmentation.

The lattice of a text has a node between any two characters and an edge for each
vocabulary piece that fits; a character that is no piece has an edge of its
UTF-8 byte pieces.  Forward Viterbi scores are the exact distance of each node to
the start, so a backward A-star search with them as heuristic pops whole paths
in the order of their scores, and the first N are the N best.

No piece holds a space after another character, nor a line end inside, nor one of
certain marks after a letter (checked when the vocabulary is read; without this
the text is one chunk), so the lattice falls apart into chunks: the spaces before
a word and the word, and the marks after it.  Scores add up
over chunks: the best paths join to the text's best path, and the text's N best
deviate only in the N - 1 chunk occurrences that lose least by their own second
path.  Chunks recur, so each worker keeps a bounded table of solved ones.

Scores: the files at hand are merge-rank vocabularies; a piece of rank r counts
-ln(r + 2), in millionths as integers, so that sums are exact (``scores="file"``
takes a unigram model's own).  Equal scores: the longer last piece wins in the
best path; among the N best they keep the order of the search.

Encoding puts one space before the text, as the vocabulary expects; decoding
takes it off.  A literal U+2581, control characters and unknown characters go
through byte pieces, so decoding gives back every text exactly.

Defined results: null is encoded as the empty text, which has no pieces; fewer
than N paths: all; repeated rows are each encoded; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import blank

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
KEPT_CHUNKS = 250_000  # solved chunks in each of the two tables a worker keeps
MILLION = 1_000_000
ALONE = 1 << 61
BYTE_LOSS = 30 * MILLION  # of a byte piece
_IDS, _SCORE, _LOSS = itemgetter(0), itemgetter(1), itemgetter(2)
ENCODED = ("struct<ids: array<int>, score: long, exact: boolean, nbest: array<struct<loss: long, "
           "changes: array<struct<at: int, length: int, ids: array<int>>>>>>")


@dataclass(frozen=True)
class Vocabulary:
    """Plain data, small enough to go to every task: pieces with spaces as spaces."""

    pieces: tuple[tuple[str, int, int], ...]  # piece, id, score
    bytes_from: tuple[int, ...]  # id of each of the 256 byte pieces
    size: int
    cut: bool  # whether chunks are independent
    marks: str = ""  # characters that no piece holds after an ASCII letter or digit


def read_vocabulary(path: str = MODEL, scores: str = "rank") -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    if len(by_byte) < 256:
        raise ValueError("the vocabulary needs the 256 byte pieces")
    value = {i: round(MILLION * (sp.get_score(i) if scores == "file" else -math.log(r + 2))) for r, i in enumerate(plain)}
    pieces = tuple((sp.id_to_piece(i).replace("▁", " "), i, value[i]) for i in plain)
    cut = not any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p, _, _ in pieces)
    after_letter = {b for p, _, _ in pieces for a, b in zip(p, p[1:]) if a.isascii() and a.isalnum()}
    marks = "".join(c for c in ",.;:!?" if c not in after_letter)
    return Vocabulary(pieces, tuple(by_byte[b] for b in range(256)), len(ids), cut, marks)


def least_places(losses: list[int], n: int) -> list[int]:
    """Places of the n least losses (the first of equal ones), those without a second path left out."""
    a = np.array(losses, np.int64)
    if len(a) > n > 0:
        border = np.partition(a, n - 1)[n - 1]
        at = np.concatenate((np.flatnonzero(a < border), np.flatnonzero(a == border)))[:n]
    else:
        at = np.arange(len(a))[:n]
    return [k for k in at.tolist() if losses[k] < ALONE]


def chunk_pattern(vocabulary: Vocabulary) -> str:
    """Chunks: spaces with the word after them, cut before a mark that follows a letter."""
    if not vocabulary.cut:
        return r"(?s).+"
    if not vocabulary.marks:
        return r" *[^ \n]+|\n| +"
    m = re.escape(vocabulary.marks)
    inner = rf"(?:[^ \n{m}]+|(?<![A-Za-z0-9])[{m}])"
    return rf" *{inner}+|[{m}]{inner}*|\n| +"


class Segmenter:
    def __init__(self, vocabulary: Vocabulary, n_best: int = N_BEST):
        self.n_best = n_best
        self.root: tuple[dict, int, int] = ({}, -1, 0)  # trie of pieces: (children, id or -1, score)
        for piece, i, score in vocabulary.pieces:
            node = self.root
            for k, c in enumerate(piece):
                child = node[0].get(c)
                if k + 1 == len(piece):
                    child = (child[0] if child else {}, i, score)
                    node[0][c] = child
                elif child is None:
                    child = node[0][c] = ({}, -1, 0)
                node = child
        self.byte_ids = vocabulary.bytes_from
        self.text_of: list[bytes] = [b""] * vocabulary.size
        for piece, i, _ in vocabulary.pieces:
            self.text_of[i] = piece.encode()
        for b, i in enumerate(vocabulary.bytes_from):
            self.text_of[i] = bytes([b])
        self.chunks = re.compile(chunk_pattern(vocabulary))
        self.solved: dict[str, tuple[bytes, int, int]] = {}
        self.older: dict[str, tuple[bytes, int, int]] = {}
        self.listed: dict[str, list[tuple[int, tuple[int, ...]]]] = {}

    def lattice(self, chunk: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """Edges (start, ids, score) into each node, longest first."""
        n = len(chunk)
        into: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            node, j = self.root, i
            while j < n and (node := node[0].get(chunk[j])) is not None:
                j += 1
                if node[1] >= 0:
                    into[j].append((i, (node[1],), node[2]))
            if self.is_no_piece(chunk[i]):
                raw = chunk[i].encode()
                into[i + 1].append((i, tuple(self.byte_ids[b] for b in raw), -BYTE_LOSS * len(raw)))
        return into

    def is_no_piece(self, char: str) -> bool:
        node = self.root[0].get(char)
        return node is None or node[1] < 0

    def forward(self, into: list[list[tuple[int, tuple[int, ...], int]]]) -> list[int]:
        """The score of the best path from the start to each node."""
        best = [0] * len(into)
        for j in range(1, len(into)):
            best[j] = max(best[i] + s for i, _, s in into[j])
        return best

    def solve(self, chunk: str) -> tuple[bytes, int, int]:
        """(ids as 32-bit numbers, score, loss of the second best path; ``ALONE`` without one): forward Viterbi, keeping
        at each node what the second best edge loses.  A path that leaves the best one at
        some node goes on best from there, so the least of these along it is the loss."""
        n = len(chunk)
        low = -(1 << 62)
        best, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        best[0] = 0
        top = self.root[0]
        for i in range(n):
            here = best[i]
            node = top.get(chunk[i])
            if node is None or node[1] < 0:
                raw = chunk[i].encode()
                v = here - BYTE_LOSS * len(raw)
                if v > best[i + 1]:
                    second[i + 1], best[i + 1], back[i + 1] = best[i + 1], v, (i, raw)
                elif v > second[i + 1]:
                    second[i + 1] = v
            j = i
            while node is not None:
                j += 1
                children, e, score = node
                if e >= 0:
                    v = here + score
                    if v > best[j]:
                        second[j], best[j], back[j] = best[j], v, (i, e)
                    elif v > second[j]:
                        second[j] = v
                if j == n:
                    break
                node = children.get(chunk[j])
        ids: list[int] = []
        loss, j = ALONE, n
        while j:
            if second[j] > low:
                loss = min(loss, best[j] - second[j])
            i, e = back[j]
            ids.extend([e] if type(e) is int else [self.byte_ids[b] for b in reversed(e)])
            j = i
        ids.reverse()
        return array("i", ids).tobytes(), best[n], loss

    def paths(self, chunk: str) -> list[tuple[int, tuple[int, ...]]]:
        """(loss, ids) of the N best paths, best first: backward A-star over the lattice."""
        into = self.lattice(chunk)
        best = self.forward(into)
        turn = count()
        agenda: list = []
        heappush(agenda, (-best[-1], len(chunk), next(turn), 0, None))  # equal bounds: the nearest to the start goes on
        out: list[tuple[int, tuple[int, ...]]] = []
        while agenda and len(out) < self.n_best:
            bound, node, _, tail, path = heappop(agenda)
            if node == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((best[-1] + bound, tuple(ids)))
                continue
            for i, ids_, s in into[node]:
                heappush(agenda, (-(best[i] + s + tail), i, next(turn), tail + s, (ids_, path)))
        return out

    def encode(self, text: str) -> tuple[array, int, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
        """(ids, score, N best as (loss, changes)); a change replaces ``length`` ids at ``at``."""
        found = self.chunks.findall(" " + text) if text else []
        got = list(map(self.solved.get, found))
        if None in got:
            got = [self.look_up(c) if g is None else g for c, g in zip(found, got)]
        ids = array("i", b"".join(map(_IDS, got)))
        return ids, sum(map(_SCORE, got)), self.n_best_of(found, got, least_places(list(map(_LOSS, got)), self.n_best - 1))

    def look_up(self, chunk: str) -> tuple[bytes, int, int]:
        """The solved chunk; when the table is full, the one before it is forgotten."""
        out = self.solved.get(chunk)
        if out is None:
            out = self.older.get(chunk) or self.solve(chunk)
            if len(self.solved) >= KEPT_CHUNKS:
                self.older, self.solved = self.solved, {}
            self.solved[chunk] = out
        return out

    def n_best_of(self, found: list[str], got: list, near: list[int]) -> list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]:
        """The N best combinations of the paths of the chunks at ``near``, best first."""
        near = sorted(near)
        options = []
        for k in near:
            if found[k] not in self.listed:
                if len(self.listed) >= KEPT_CHUNKS // 20:
                    self.listed.clear()
                best = tuple(array("i", got[k][0]))
                own = [p for p in self.paths(found[k]) if p[1] != best][: self.n_best - 1]
                self.listed[found[k]] = [(0, best), *own]
            options.append(self.listed[found[k]])
        lengths = list(map(len, map(_IDS, got)))
        place = [(sum(lengths[:k]) // 4, lengths[k] // 4) for k in near]
        agenda, out = [(0, (0,) * len(options), 0)], []
        while agenda and len(out) < self.n_best:
            loss, pick, first = heappop(agenda)
            out.append((loss, [(*place[c], options[c][p][1]) for c, p in enumerate(pick) if p]))
            for c in range(first, len(options)):  # each combination is reached once
                if pick[c] + 1 < len(options[c]):
                    more = options[c][pick[c] + 1][0] - options[c][pick[c]][0]
                    heappush(agenda, (loss + more, pick[:c] + (pick[c] + 1,) + pick[c + 1:], c))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode()[1:]


_segmenters: dict[tuple[int, int], Segmenter] = {}


def segmenter(vocabulary: Vocabulary, n_best: int) -> Segmenter:
    """One per worker process and vocabulary, with its table of solved chunks."""
    key = (hash(vocabulary), n_best)
    if key not in _segmenters:
        _segmenters.clear()
        _segmenters[key] = Segmenter(vocabulary, n_best)
    return _segmenters[key]


_CHANGE = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
_NBEST = pa.list_(pa.struct([("loss", pa.int64()), ("changes", pa.list_(_CHANGE))]))


def encode_udf(vocabulary: Vocabulary, n_best: int):
    @F.arrow_udf(ENCODED)
    def _encode(texts: pa.Array) -> pa.Array:
        seg = segmenter(vocabulary, n_best)
        flat, offsets, scores, exact, nbest = array("i"), [0], [], [], []
        for text in texts.to_pylist():
            ids, score, best = seg.encode(text)
            flat.extend(ids)
            offsets.append(len(flat))
            scores.append(score)
            exact.append(seg.decode(ids) == text)
            nbest.append([{"loss": loss, "changes": [{"at": a, "length": n, "ids": new} for a, n, new in changes]} for loss, changes in best])
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array(scores, pa.int64()), pa.array(exact, pa.bool_()), pa.array(nbest, _NBEST)],
                                          ["ids", "score", "exact", "nbest"])

    return _encode.asNondeterministic()


def decode_udf(vocabulary: Vocabulary):
    @F.arrow_udf("string")
    def _decode(rows: pa.Array) -> pa.Array:
        seg = segmenter(vocabulary, N_BEST)
        return pa.array([seg.decode(r or ()) for r in rows.to_pylist()], pa.string())

    return _decode


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, scores: str = "rank",
            n_best: int = N_BEST) -> DataFrame:
    """(doc_id, n_pieces, ids, score, exact, nbest), one row per input row.  ``score`` in
    millionths; ``exact``: decoding the ids gave the text back; ``nbest``: the N best
    segmentations of the whole text as changes to ``ids`` (the first has none)."""
    e = encode_udf(read_vocabulary(model, scores), n_best)(blank(text))
    return docs.select(F.col(doc_id).alias("doc_id"), e.alias("e")).select(
        "doc_id", F.size("e.ids").cast("long").alias("n_pieces"), "e.ids", "e.score", "e.exact", "e.nbest")


def decoded(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` plus ``decoded``, the text of the ids (null: empty)."""
    return rows.withColumn("decoded", decode_udf(read_vocabulary(model))(F.col(ids)))
