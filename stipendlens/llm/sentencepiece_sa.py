"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut at white-space marks (no piece has a mark after
another character), and the batch's different segments are concatenated and
indexed by a suffix array. Every vocabulary piece is binary-searched in it, which
gives the range of its occurrences; these are the edges (position, length,
piece), kept by position. The edges are then relaxed: in each round every
segment joins all neighbouring symbols whose union is an edge of the best
score, leftmost first and without overlap, until no edge joins two symbols, so
rounds follow the vocabulary and not the text (a segment joins one pair where
its union would join a neighbour at no later rank). That is the order of
the model at hand (byte-pair pieces, scored by merge order), so the ids equal
the library's; a relaxation by summed path score would be that of a unigram
model. Characters without a piece become byte pieces.

The vocabulary (a few ten thousand pieces) is read on the driver from the
model file whose path is a parameter and travels with the task. Work is
numpy on Arrow batches where the documents lie: no shuffle. Segments already
cut are remembered per task up to ``_REMEMBERED``, indexed in chunks of ``_CHUNK``
characters; a longer segment is indexed in windows of ``_CHUNK``, and only its
edge table grows with it (4 bytes a position and length).

Defined results: NULL or empty text: no tokens, decoded as an empty text; the
mark character U+2581 in a text decodes as a blank (as in the library), any
other text decodes to itself; repeated rows: one result each; no rows: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_REMEMBERED, _CHUNK = 1_000_000, 300_000
_NONE = np.int32(2 ** 31 - 1)
_WIDE = 5  # characters of 12 bits to a key


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]  # by id; byte pieces as "<0xNN>"
    scores: tuple[float, ...]
    normal: tuple[bool, ...]  # may match text
    first_byte: int  # id of <0x00>

    @staticmethod
    def load(path: str = MODEL_PATH) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        return Vocabulary(tuple(p.id_to_piece(i) for i in ids), tuple(p.get_score(i) for i in ids),
                          tuple(not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in ids),
                          p.piece_to_id("<0x00>"))


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.v = vocabulary
        ids = [i for i, ok in enumerate(v.normal) if ok]
        self.codes = {c: n + 1 for n, c in enumerate(sorted({c for i in ids for c in v.pieces[i]}))}
        if len(self.codes) >= 4094:
            raise ValueError("more than 4,094 different characters in the vocabulary")
        self.longest = max(len(v.pieces[i]) for i in ids)
        # merge order: best score first; equal scores share a rank, so the leftmost wins
        levels = {s: n for n, s in enumerate(sorted({v.scores[i] for i in ids}, reverse=True))}
        self.rank = np.array([levels[v.scores[i]] for i in ids], np.int32)
        self.ids = np.array(ids, np.int32)
        self.length = np.array([len(v.pieces[i]) for i in ids])
        self.columns = -(-self.longest // _WIDE)
        self.low = self._keys([v.pieces[i] for i in ids], 0)
        self.high = self._keys([v.pieces[i] for i in ids], 0xFFF)
        self.known: dict[str, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _keys(self, pieces: Sequence[str], fill: int) -> list[np.ndarray]:
        grid = np.full((len(pieces), self.columns * _WIDE), fill, np.int64)
        for i, p in enumerate(pieces):
            grid[i, :len(p)] = [self.codes[c] for c in p]
        return [_pack(grid[:, c * _WIDE:(c + 1) * _WIDE]) for c in range(self.columns)]

    # -- one chunk of segments ------------------------------------------------
    def _edges(self, code: np.ndarray) -> np.ndarray:
        """(position, length) -> index of the piece that occurs there, or -1."""
        edge = np.empty((len(code), self.longest + 1), np.int32)
        for a in range(0, len(code), 2 * _CHUNK):
            b = min(a + 2 * _CHUNK, len(code))
            edge[a:b] = self._window_edges(code[a:b + self.longest])[:b - a]
        return edge

    def _window_edges(self, code: np.ndarray) -> np.ndarray:
        n, pad = len(code), self.columns * _WIDE
        padded = np.concatenate([code, np.zeros(pad, np.int64)])
        key = _pack(np.lib.stride_tricks.sliding_window_view(padded, _WIDE)[:n])
        keys = [np.concatenate([key[c * _WIDE:], np.zeros(min(n, c * _WIDE), np.int64)])[:n] for c in range(self.columns)]
        # suffixes in order of their first columns * _WIDE characters: ranks by doubling
        rank, have = np.unique(key, return_inverse=True)[1].astype(np.int64), _WIDE
        while have < pad:
            later = np.concatenate([rank[have:] + 1, np.zeros(min(n, have), np.int64)])[:n]
            rank, have = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64), 2 * have
        suffixes = np.argsort(rank, kind="stable")
        ordered = [k[suffixes] for k in keys]
        lo, hi = _bisect(ordered, self.low, False), _bisect(ordered, self.high, True)
        count = hi - lo
        piece = np.repeat(np.arange(len(lo)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        edge = np.full((n, self.longest + 1), -1, np.int32)  # by position
        edge[suffixes[at], self.length[piece]] = piece
        return edge

    def _encode_chunk(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each segment."""
        text = "\0".join(segments) + "\0"  # code 0 belongs to no piece
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars, back = np.unique(raw, return_inverse=True)
        code = np.array([self.codes.get(chr(c), 4095 if c else 0) for c in chars], np.int64)[back]
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        seg_of = np.repeat(np.arange(len(segments)), sizes)
        start = np.arange(len(seg_of)) + seg_of  # one separator after each earlier segment
        edge = self._edges(code)
        end = start + 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(start):
            same = np.zeros(len(start), bool)
            same[:-1] = seg_of[1:] == seg_of[:-1]
            reach = np.where(same, np.append(end[1:], 0) - start, 0)
            fits = same & (reach <= self.longest)
            piece = np.where(fits, edge[start, np.where(fits, reach, 0)], -1)
            best = np.where(piece >= 0, self.rank[piece], _NONE)
            heads = np.flatnonzero(np.append(True, seg_of[1:] != seg_of[:-1]))
            sizes = np.diff(np.append(heads, len(start)))
            lowest = np.repeat(np.minimum.reduceat(best, heads), sizes)
            still = lowest < _NONE
            done.append((seg_of[~still], start[~still], end[~still]))
            hit = np.flatnonzero(still & (best == lowest))
            runs = np.flatnonzero(np.append(True, np.diff(hit) != 1)[:len(hit)])  # of overlapping pairs every other one
            chosen = hit[(np.arange(len(hit)) - np.repeat(runs, np.diff(np.append(runs, len(hit))))) % 2 == 0]
            # a union that joins a neighbour at no later rank comes before the next pair: such a segment joins one pair
            right, left = np.minimum(chosen + 2, len(start) - 1), np.maximum(chosen - 1, 0)
            taken = np.zeros(len(start), bool)
            taken[chosen] = True
            left = np.where((left > 0) & taken[np.maximum(left - 1, 0)], left - 1, left)
            early = np.zeros(len(chosen), bool)
            for x, y, near in ((chosen, right, chosen + 2 < len(start)), (left, chosen + 1, chosen > 0)):
                wide = end[y] - start[x]
                fits = near & (seg_of[x] == seg_of[y]) & (wide <= self.longest)
                union = np.where(fits, edge[start[x], np.where(fits, wide, 0)], -1)
                early |= (union >= 0) & (self.rank[union] <= lowest[chosen])
            alone = np.zeros(len(segments), bool)
            alone[seg_of[chosen[early]]] = True
            first = np.append(True, seg_of[chosen[1:]] != seg_of[chosen[:-1]])[:len(chosen)]
            chosen = chosen[first | ~alone[seg_of[chosen]]]
            end[chosen] = end[chosen + 1]
            keep = still.copy()
            keep[chosen + 1] = False
            seg_of, start, end = seg_of[keep], start[keep], end[keep]
        seg_of, start, end = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(start, kind="stable")
        seg_of, start, end = seg_of[order], start[order], end[order]
        piece = edge[start, end - start]
        ids = np.where(piece >= 0, self.ids[piece], -1)
        unknown = np.flatnonzero(piece < 0)  # single characters without a piece: bytes
        width = np.ones(len(ids), np.int64)
        encoded = [chr(raw[start[i]]).encode("utf-8") for i in unknown]
        width[unknown] = [len(b) for b in encoded]
        flat = np.repeat(ids, width)
        if encoded:
            first = (np.cumsum(width) - width)[unknown]
            for f, b in zip(first, encoded):
                flat[f:f + len(b)] = np.frombuffer(b, np.uint8).astype(np.int64) + self.v.first_byte
        counts = np.bincount(seg_of, weights=width, minlength=len(segments)).astype(np.int64)
        return flat.astype(np.int32), counts

    def _learn(self, segments: list[str]) -> None:
        parts, counts, chunk, size = [self.tokens], [np.diff(self.start)], [], 0
        for i, s in enumerate(segments):
            self.known[s] = len(self.known)
            chunk.append(s)
            size += len(s) + 1
            if size > _CHUNK or i == len(segments) - 1:
                ids, n = self._encode_chunk(chunk)
                parts.append(ids)
                counts.append(n)
                chunk, size = [], 0
        self.tokens = np.concatenate(parts)
        self.start = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    # -- batches ----------------------------------------------------------------
    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        if len(self.known) > _REMEMBERED:
            self.known, self.tokens, self.start = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        cut = [_SEGMENT.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        new = {s: None for segments in cut for s in segments if s not in self.known}
        if new:
            self._learn(list(new))
        known = self.known
        flat = np.fromiter((known[s] for segments in cut for s in segments), np.int64)
        per = np.fromiter(map(len, cut), np.int64, len(cut))
        first, n = self.start[flat], np.diff(self.start)[flat]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(per))]
        return self.tokens[at], np.diff(ends)


class Decoder:
    def __init__(self, v: Vocabulary) -> None:
        self.bytes = [p.replace(MARK, " ").encode("utf-8") for p in v.pieces]
        for b in range(256):
            self.bytes[v.first_byte + b] = bytes([b])
        for i, p in enumerate(v.pieces):
            if not v.normal[i] and not v.first_byte <= i < v.first_byte + 256:
                self.bytes[i] = b""

    def decode(self, ids: Sequence[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _pack(grid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grid), np.int64)
    for c in range(_WIDE):
        out = (out << 12) | grid[:, c]
    return out


def _bisect(ordered: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """First suffix >= wanted (after: > wanted), keys compared column by column."""
    n = len(ordered[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, n - 1)
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for have, want in zip(ordered, wanted):
            x = have[at]
            less |= equal & (x < want)
            equal &= x == want
        go = (less | equal if after else less) & (lo < hi)
        stay = ~go & (lo < hi)
        lo, hi = np.where(go, mid + 1, lo), np.where(stay, mid, hi)
    return lo


def _rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most about 8 million characters."""
    sizes = np.asarray(batch.column("size").to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(sizes) // 8_000_000
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(sizes)) if len(sizes) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def encode(docs: DataFrame, model_path: str = MODEL_PATH, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs(text, ...)``, tokens array<int>, n_tokens
    and round_trip (decoding the tokens gives the text back)."""
    v = Vocabulary.load(model_path)
    src = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.coalesce("text", F.lit("")).alias("text"),
                      F.coalesce(F.length("text"), F.lit(0)).alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(v), Decoder(v)
        for whole in batches:
            for b in _rows(whole):
                texts = b.column("text").to_pylist()
                ids, counts = encoder.encode(texts)
                ends = np.append(0, np.cumsum(counts))
                flat = ids.tolist()
                same = [decoder.decode(flat[s:e]) == t.replace(MARK, " ") for s, e, t in zip(ends[:-1], ends[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(f"keep_{c}") for c in keep]
                    + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                       pa.array(counts, pa.int64()), pa.array(same, pa.bool_())],
                    names=[*keep, "tokens", "n_tokens", "round_trip"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, tokens array<int>, n_tokens bigint, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL_PATH, key: str = "doc_id") -> DataFrame:
    """``tokens(key, tokens)`` -> key, text."""
    v = Vocabulary.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v)
        for b in batches:
            texts = [decoder.decode(x or ()) for x in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return tokens.select(key, "tokens").mapInArrow(run, f"`{key}` {tokens.schema[key].dataType.simpleString()}, text string")
