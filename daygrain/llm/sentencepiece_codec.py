"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into units (a word with the space mark before it, a run of marks, a line feed), long ones
also between neighbours that no piece contains side by side:
no piece crosses a unit's border, so equal units have equal pieces. The batch's distinct
new units are concatenated and indexed by a suffix array (prefix doubling up to the longest
piece), every piece of the vocabulary is binary-searched for the range of its occurrences,
the occurrences become edges sorted by position, and a pass over them relaxes the
positions reached.

The model is a BPE model. The relaxation uses that each prefix of a text has one last piece in its
BPE encoding: an edge (p, q, piece) sets the last piece of q exactly if the pair (last piece of
p, piece) stays apart under the merges. Whether a pair stays apart follows from the merge trees
along its border, in rank order. The result is the library's, piece by piece.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import Shared, fresh

MARK = "▁"  # stands for a space in the model's pieces; units keep the space
#: Where the public tokenizers' model lies; callers may name another.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 120_000
#: The cache of units is let go beyond so many of them, or characters in them.
CACHED_UNITS, CACHED_CHARS = 200_000, 3_000_000
LONG_UNIT = 48  # longer units are cut where no piece can cross
FEW = 12  # so many edges or units at a step are worked on one by one
PAIR_CACHE_BITS = 21


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores, merge trees and special ids; plain arrays, made once on the driver."""
    pieces: list[str]
    score: np.ndarray
    normal: np.ndarray
    byte_ids: list[int] | None
    unknown: int
    control: frozenset
    dummy_prefix: bool
    left: np.ndarray
    right: np.ndarray
    valid: np.ndarray


def merge(parts: list[str], score: dict[str, float]) -> list[tuple]:
    """BPE by a heap: (piece, tree) of what is left; a tree is (left, right) or None for a character."""
    n = len(parts)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    text, tree = list(parts), [None] * n
    heap: list = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (s := score.get(text[i] + text[j])) is not None:
            heapq.heappush(heap, (-s, i, j, text[i] + text[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if text[i] is None or text[j] is None or nxt[i] != j or text[i] + text[j] != joined:
            continue
        tree[i] = ((text[i], tree[i]), (text[j], tree[j]))
        text[i], text[j] = joined, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [(t, tree[i]) for i, t in enumerate(text) if t is not None]


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a SentencePiece BPE model with the identity normalizer (no other is supported)."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("a BPE model with the identity normalizer is needed")
    kind = [p.type for p in proto.pieces]
    pieces = [p.piece for p in proto.pieces]
    score = np.array([p.score for p in proto.pieces])
    normal = np.array([k == 1 for k in kind])
    by_piece = {p: float(s) for p, s, ok in zip(pieces, score, normal) if ok}
    ids = {p: i for i, p in enumerate(pieces) if normal[i]}
    left, right = (np.full(len(pieces), -1, np.int32) for _ in range(2))
    valid = np.zeros(len(pieces), bool)
    for i, p in enumerate(pieces):
        if not normal[i] or len(p) > 1 and not p.strip(MARK):
            continue  # runs of the mark are merged apart
        (whole, tree), *more = merge(list(p), by_piece)
        if not more:
            valid[i] = True
            if tree is not None:
                left[i], right[i] = ids[tree[0][0]], ids[tree[1][0]]
                if any(left[k] >= 0 and score[k] < score[i] for k in (left[i], right[i])):
                    raise ValueError(f"piece {i} is merged before its parts")
    tied = [p for p in by_piece if p.strip(MARK) and MARK in p[1:]]
    if tied or len({by_piece[p] for p in by_piece if p.strip(MARK)}) < sum(1 for p in by_piece if p.strip(MARK)):
        raise ValueError("pieces with an inner space mark or with equal scores are not supported")
    bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kind)) if k == 6}
    return Vocabulary(pieces, score, normal, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None,
                      kind.index(2), frozenset(i for i, k in enumerate(kind) if k == 3), spec.add_dummy_prefix,
                      left, right, valid)


class Units(dict):
    """Numbers units as they are first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Codec:
    """Encodes and decodes batches; keeps the encodings of recent units and the answers for recent pairs."""

    def __init__(self, v: Vocabulary):
        self.v, self.size = v, len(v.pieces)
        self.scores = {p: float(s) for p, s, ok in zip(v.pieces, v.score, v.normal) if ok}
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
        self.chars = sorted({c for p in self.scores for c in p})
        self.code_points = np.array([ord(c) for c in self.chars])
        lf = "" if any("\n" in p for p in self.scores) else "\n"
        self.units = re.compile(f" *[^ {lf}]+| +" + f"|{lf}" * bool(lf)).findall
        usable = np.flatnonzero(v.valid)
        self.piece_ids = usable.astype(np.int64)
        self.piece_len = np.array([len(v.pieces[i]) for i in usable])
        self.piece_chars = np.zeros((len(usable), int(self.piece_len.max(initial=1))), np.int64)
        for row, i in enumerate(usable):
            self.piece_chars[row, :len(v.pieces[i])] = [ord(c) for c in v.pieces[i]]
        self.length = np.ones(self.size + 1, np.int64)
        self.length[self.piece_ids] = self.piece_len
        pairs = {(self.ids[p[:k]], self.ids[p[k:]]): i for i, p in enumerate(v.pieces) if v.normal[i]
                 for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        codes = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self.pair_codes = np.append(codes[order], np.iinfo(np.int64).max)
        self.pair_score = np.append(v.score[np.array(list(pairs.values()), np.int64)][order], 0.0)
        self.known_pairs = np.full(1 << PAIR_CACHE_BITS, -1, np.int64)
        self.memo: dict[int, bool] = {}
        #: neighbours that some piece contains, as units spell them
        side_by_side = {ord(x) << 21 | ord(y) for p in self.scores for x, y in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:])}
        self.side_by_side = np.array(sorted(side_by_side), np.int64)
        self.bytes = [b"" if i in v.control else " ⁇ ".encode() if i == v.unknown else p.replace(MARK, " ").encode()
                      for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids or []):
            self.bytes[i] = bytes([b])
        self.clear()

    def clear(self) -> None:
        self.unit_of, self.flat = Units(), np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cached_chars = 0

    def _cut(self, unit: str) -> list[str]:
        """The unit in parts that no piece crosses."""
        c = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = c[:-1] << 21 | c[1:]
        at = np.minimum(np.searchsorted(self.side_by_side, pair), max(0, len(self.side_by_side) - 1))
        apart = np.flatnonzero(self.side_by_side[at] != pair) + 1 if len(self.side_by_side) else np.arange(1, len(c))
        ends = [0, *apart.tolist(), len(c)]
        return [unit[x:y] for x, y in zip(ends, ends[1:])]

    # -- pairs ---------------------------------------------------------------
    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b stay apart when their characters are merged together."""
        v = self.v
        spine_a, spine_b, depth_a, depth_b = [a], [b], np.zeros(len(a), int), np.zeros(len(a), int)
        for spine, child, depth in ((spine_a, v.right, depth_a), (spine_b, v.left, depth_b)):
            while (more := child[spine[-1]] >= 0).any():
                spine.append(np.where(more, child[spine[-1]], spine[-1]))
                depth += more
        sa, sb, rows = np.stack(spine_a), np.stack(spine_b), np.arange(len(a))
        out, live = np.ones(len(a), bool), rows
        while len(live):
            i, j = depth_a[live], depth_b[live]
            x, y = sa[i, live], sb[j, live]
            code = x.astype(np.int64) * self.size + y
            at = np.searchsorted(self.pair_codes, code)
            cross = np.where(self.pair_codes[at] == code, self.pair_score[at], -np.inf)
            up_a = np.where(i > 0, v.score[sa[np.maximum(i - 1, 0), live]], -np.inf)
            up_b = np.where(j > 0, v.score[sb[np.maximum(j - 1, 0), live]], -np.inf)
            joined = (cross > up_a) & (cross >= up_b) & (cross > -np.inf)
            out[live[joined]] = False
            left_first = up_a >= up_b
            depth_a[live] -= left_first & (i > 0)
            depth_b[live] -= ~left_first & (j > 0)
            live = live[~joined & ((i > 0) | (j > 0))]
        return out

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart`` through a cache; a text's start and foreign characters stay apart from anything."""
        code = a.astype(np.int64) * self.size + b
        slot = (code * -7046029254386353131).view(np.uint64) >> np.uint64(64 - PAIR_CACHE_BITS)
        known = self.known_pairs[slot]
        out = (known & 1).astype(bool)
        plain = (a < self.size) & (b < self.size)
        missing = np.flatnonzero(plain & (known >> 1 != code))
        if len(missing):
            fresh, back = np.unique(code[missing], return_inverse=True)
            apart = self._apart((fresh // self.size).astype(np.int32), (fresh % self.size).astype(np.int32))
            out[missing] = apart[back]
            self.known_pairs[slot[missing]] = code[missing] << 1 | out[missing]
        return out | ~plain

    def _one_stays_apart(self, a: int, b: int) -> bool:
        """``_stay_apart`` of one pair."""
        if a >= self.size or b >= self.size:
            return True
        code = a * self.size + b
        if code not in self.memo:
            if len(self.memo) >= 1 << PAIR_CACHE_BITS - 2:
                self.memo.clear()
            self.memo[code] = bool(self._stay_apart(np.array([a]), np.array([b]))[0])
        return self.memo[code]

    # -- matching ------------------------------------------------------------
    def _occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece id) of every occurrence of every piece; ``text`` holds code points, 0 between units."""
        present = np.intersect1d(np.unique(text), self.code_points)
        code_of = np.zeros(int(max(present.max(initial=0), text.max())) + 1, np.int64)
        code_of[present] = np.arange(2, len(present) + 2)
        code = code_of[text]
        bits = int(len(present) + 2).bit_length()
        per_key = 62 // bits
        inside = np.zeros(0x110000, bool)
        inside[present] = inside[0] = True
        usable = np.flatnonzero(inside[self.piece_chars].all(axis=1))
        if not len(usable):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        longest = int(self.piece_len[usable].max())
        n, levels = len(code), -(-longest // per_key)
        padded = np.append(code, np.zeros(per_key, np.int64))
        key = np.zeros(n, np.int64)
        for j in range(per_key):
            key = key << bits | padded[j:j + n]
        order, reach = np.argsort(key), per_key
        while reach < longest:  # prefix doubling
            ranked = key[order] if reach == per_key else combined[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.append(0, np.cumsum(ranked[1:] != ranked[:-1])) + 1
            combined = rank * (n + 1) + np.append(rank[reach:], np.zeros(min(reach, n), np.int64))[:n]
            order, reach = np.argsort(combined), 2 * reach
        keys = [np.append(key[lv * per_key:], np.zeros(min(lv * per_key, n), np.int64))[:n][order] for lv in range(levels)]
        low, high = np.zeros((levels, len(usable)), np.int64), np.zeros((levels, len(usable)), np.int64)
        top = (1 << bits) - 1
        chars = np.zeros((len(usable), levels * per_key), np.int64)
        code_of[0] = 0
        chars[:, :longest] = code_of[self.piece_chars[usable, :longest]]
        for j in range(levels * per_key):
            low[j // per_key] = low[j // per_key] << bits | chars[:, j]
            high[j // per_key] = high[j // per_key] << bits | np.where(chars[:, j] > 0, chars[:, j], top)
        first, last = np.zeros(len(usable), np.int64), np.full(len(usable), n)
        for lv in range(levels):
            first, last = _bisect(keys[lv], low[lv], first, last, False), _bisect(keys[lv], high[lv], first, last, True)
        count = last - first
        at = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        return order[at], np.repeat(self.piece_ids[usable], count)

    def _relax(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the units, one after the other, and how many each has; a foreign character c is size + 1 + c."""
        text = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        text[text == ord(" ")] = ord(MARK)
        text[ends] = 0
        pos, piece = self._occurrences(text)
        foreign = np.flatnonzero(~np.isin(text, self.code_points))
        foreign = foreign[~np.isin(foreign, ends, assume_unique=True)]
        pos, piece = np.append(pos, foreign), np.append(piece, self.size + 1 + text[foreign])
        offset = pos - np.repeat(begins, sizes + 1)[pos]
        offset = offset.astype(np.uint16 if sizes.max() < 1 << 16 else np.int64)
        order = np.argsort(offset, kind="stable")
        pos, piece, offset = pos[order], piece[order], offset[order]
        to = pos + self.length[np.minimum(piece, self.size)]
        last = np.full(len(text) + 1, -1, np.int64)
        last[begins] = self.size  # marks a start
        cuts = np.append(np.flatnonzero(np.append(True, offset[1:] != offset[:-1])), len(offset))
        # offsets that only a few long units reach are relaxed edge by edge
        many = np.flatnonzero(np.diff(cuts) > FEW)
        tail = int(many[-1]) + 1 if len(many) else 0
        for x, y in zip(cuts[:tail].tolist(), cuts[1:tail + 1].tolist()):
            before = last[pos[x:y]]
            reached = np.flatnonzero(before >= 0)
            t = piece[x:y][reached]
            good = self._stay_apart(before[reached], t)
            last[to[x:y][reached[good]]] = t[good]
        rest = int(cuts[tail])
        if rest < len(pos):
            said, apart = last.tolist(), self._one_stays_apart
            for p, t, q in zip(pos[rest:].tolist(), piece[rest:].tolist(), to[rest:].tolist()):
                if said[p] >= 0 and apart(said[p], t):
                    said[q] = t
            last = np.array(said, np.int64)
        steps, live, at = [], np.arange(len(units)), ends.copy()
        count = np.zeros(len(units), np.int64)
        alone: dict[int, list[int]] = {}  # the pieces of the last few units, from the end
        while len(live):
            if len(live) <= FEW:
                said = last.tolist()
                for k, stop in zip(live.tolist(), at[live].tolist()):
                    alone[k] = []
                    while stop > begins[k]:
                        alone[k].append(said[stop])
                        stop -= self.length[min(said[stop], self.size)]
                    count[k] += len(alone[k])
                break
            t = last[at[live]]
            steps.append((live, t))
            count[live] += 1
            at[live] -= self.length[np.minimum(t, self.size)]
            live = live[at[live] > begins[live]]
        flat, stop = np.empty(count.sum(), np.int64), np.cumsum(count)
        for k, (rows, t) in enumerate(steps):
            flat[stop[rows] - 1 - k] = t
        for k, pieces in alone.items():
            first = stop[k] - count[k]
            flat[first:first + len(pieces)] = pieces[::-1]
        return flat, count

    def _learn(self, new: list[str]) -> None:
        """Encodes the units numbered last."""
        doubled = {u: " " + u.lstrip(" ") for u in new if u[:2] == "  "}
        for tail in doubled.values():  # the rest of a unit after a run of spaces is a unit too
            self.unit_of[tail]
        new = list(self.unit_of)[len(self.start):] if doubled else new
        self.cached_chars += sum(map(len, new))
        base = len(self.start)
        self.start, self.count = (np.append(x, np.zeros(len(new), np.int64)) for x in (self.start, self.count))
        plain = [(i, u) for i, u in enumerate(new, base) if u not in doubled] if doubled else list(enumerate(new, base))
        if any(len(u) > 256 for _, u in plain):
            plain.sort(key=lambda x: len(x[1]))  # long units apart from the rest: a pass takes as many steps as its longest
        i = 0
        while i < len(plain):
            j, chars = i, 0
            while j < len(plain) and (j == i or chars + len(plain[j][1]) < BATCH_CHARS):
                chars += len(plain[j][1]) + 1
                j += 1
            flat, count = self._relax([u for _, u in plain[i:j]])
            if (flat > self.size).any():
                flat, count = self._with_bytes(flat, count)
            self._put(np.array([k for k, _ in plain[i:j]]), flat, count)
            i = j
        space = self.ids.get(MARK)
        for u, r in doubled.items():
            k = self.unit_of[r]
            tail = self.flat[self.start[k]:self.start[k] + self.count[k]]
            run = len(u) - len(u.lstrip(" ")) - 1
            if len(tail) and tail[0] == space:
                run, tail = run + 1, tail[1:]
            head = [self.ids[p] for p, _ in merge([MARK] * run, self.scores)]
            self._put(np.array([self.unit_of[u]]), np.append(np.array(head, np.int64), tail), np.array([len(head) + len(tail)]))

    def _put(self, numbers: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        self.start[numbers] = len(self.flat) + np.cumsum(count) - count
        self.count[numbers] = count
        self.flat = np.append(self.flat, flat.astype(np.int32))

    def _with_bytes(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Foreign characters as their bytes' pieces (or the unknown piece)."""
        pieces = [[int(t)] if t < self.size else [self.v.unknown] if self.v.byte_ids is None else
                  [self.v.byte_ids[b] for b in chr(int(t) - self.size - 1).encode("utf-8", "surrogatepass")] for t in flat]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.append(0, np.cumsum(sizes))
        stops = np.cumsum(count)
        return np.array([x for p in pieces for x in p], np.int64), ends[stops] - ends[stops - count]

    # -- batches -------------------------------------------------------------
    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.unit_of) > CACHED_UNITS or self.cached_chars > CACHED_CHARS:
            self.clear()
        prefix, number = " " if self.v.dummy_prefix else "", self.unit_of.__getitem__
        cut = []
        for t in texts:
            units = self.units(prefix + t.replace(MARK, " ")) if t else []
            if units and len(max(units, key=len)) > LONG_UNIT:
                units = [x for u in units for x in (self._cut(u) if len(u) > LONG_UNIT else (u,))]
            cut.append(np.fromiter(map(number, units), np.int32, len(units)))
        if len(self.unit_of) > len(self.start):
            self._learn(list(self.unit_of)[len(self.start):])
        out = []
        for units in cut:
            count = self.count[units]
            stop = np.cumsum(count)
            at = np.repeat(self.start[units] - stop + count, count)
            at += np.arange(len(at))
            out.append(self.flat[at])
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes[i] for i in ids])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text[:1] == " " else text


def _bisect(keys: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted of each wanted value within its own range [low, high)."""
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        mid = (low + high) >> 1
        value = keys[np.minimum(mid, len(keys) - 1)]
        go = live & ((value <= wanted) if right else (value < wanted))
        low, high = np.where(go, mid + 1, low), np.where(live & ~go, mid, high)
    return low


_codecs: dict[str, Codec] = {}


def _codec(shared: Shared) -> Codec:
    if shared.key not in _codecs:  # one a worker
        _codecs.clear()
        _codecs[shared.key] = Codec(shared.value)
    return _codecs[shared.key]


#: A batch's texts are worked on in slices, so that no more than a slice is held as Python objects.
SLICE_ROWS = 500


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    return (column.slice(i, SLICE_ROWS) for i in range(0, len(column), SLICE_ROWS))


def _id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode_column(text: Column, vocabulary: Shared) -> Column:
    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        return _joined([_id_lists(codec.encode([t or "" for t in x.to_pylist()])) for x in _slices(texts)], pa.list_(pa.int32()))
    return run(text)


def decode_column(ids: Column, vocabulary: Shared) -> Column:
    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        return pa.array([codec.decode(x.values.to_pylist()) for x in rows], pa.string())
    # a Python function right on another one's result would make Spark run that one again inside it
    return run(F.coalesce(ids, F.array().cast("array<int>")))


def both_column(text: Column, vocabulary: Shared) -> Column:
    """Struct of the ids and of the text that they decode to, in one pass of one worker."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def run(texts: pa.Array) -> pa.Array:
        codec, out = _codec(vocabulary), []
        for x in _slices(texts):
            ids = codec.encode([t or "" for t in x.to_pylist()])
            decoded = pa.array([codec.decode(i.tolist()) for i in ids], pa.string())
            out.append(pa.StructArray.from_arrays([_id_lists(ids), decoded], fields=list(kind)))
        return _joined(out, kind)
    return run(text)


def share_vocabulary(spark, model_path: str = MODEL_PATH) -> Shared:
    """The model's vocabulary, broadcast (its size is the model's, whatever the corpus)."""
    return Shared(spark, load_vocabulary(model_path))


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH, out: str = "ids", vocabulary=None) -> DataFrame:
    """``docs`` with ``out``: the piece ids of the whole text. Null and empty texts have none.

    ``out`` replaces a column of that name. Memory grows with a batch and with the longest word.
    """
    return docs.withColumn(out, encode_column(F.col(text_col), vocabulary or share_vocabulary(docs.sparkSession, model_path)))


def decode(rows: DataFrame, ids_col: str = "ids", model_path: str = MODEL_PATH, out: str = "decoded", vocabulary=None) -> DataFrame:
    """``rows`` with ``out``: the text of ``ids_col``; null and empty lists give the empty text.

    Decoding an encoded text gives it back, but for the mark U+2581 itself, which decodes as a space.
    """
    return rows.withColumn(out, decode_column(F.col(ids_col), vocabulary or share_vocabulary(rows.sparkSession, model_path)))


def round_trip(docs: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``: ``encode`` and ``decode`` in one pass. These names replace columns of ``docs``."""
    both = fresh(docs, "_both")
    out = docs.withColumn(both, both_column(F.col(text_col), share_vocabulary(docs.sparkSession, model_path)))
    return out.withColumns({"ids": F.col(f"{both}.ids"), "decoded": F.col(f"{both}.decoded")}).drop(both)
