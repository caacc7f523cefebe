"""Encoding to and decoding from the pieces of a SentencePiece BPE model, in vectorised merge rounds.

A text is "▁" + text with spaces turned into "▁". No piece crosses from another character to "▁" (checked when
the model is read), so a text falls apart into units `▁*[^▁]*` that are encoded alone, each distinct one once.
All new units of a run of texts are merged together: symbols lie in one flat array, each round takes every unit's
lowest pair rank by a segmented minimum, merges its leftmost occurrence, drops what was merged away and the units
that have no pair left. Where no better piece can start or end with the merged piece, all its occurrences in
the unit are merged in the same round, which gives the same result and keeps long runs to few rounds.

Units of more than LONG_UNIT characters have a segmented minimum of their own for every place: the lowest rank within `reach`, the length of the
longest piece. What would take a pair's symbols before its turn is a piece that covers one of them, so all merges that lead to it lie within
that reach, and the first of them would be of a lower rank there. Pairs that are lowest within their reach are therefore merged
simultaneously; of equal ones within reach, those to the right of one whose merge makes a pair that is no worse wait for
the next round. So the number of rounds does not grow with the unit, and stretches without pairs leave the arrays.

Nulls are encoded as the empty text; an empty text has no piece but the end id.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.common import map_texts

SPACE = "▁"
NONE = np.int64(2**62)
#: Distinct units whose pieces a worker remembers; beyond it the memory starts anew, results don't change.
REMEMBERED = 75_000
LONG_UNIT = 48


def read_model(path: str) -> dict:
    """Pieces, scores and kinds of a BPE model file, as a plain dict that can be broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = ["b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i) else "n" for i in range(n)]
    if any(model.is_unused(i) for i in range(n)):
        raise ValueError("models with unused pieces are not supported")
    if model.normalize("a  ﬁ ") != f"{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
        raise ValueError("only models with a dummy prefix and no other normalisation are supported")
    return {"pieces": [model.id_to_piece(i) for i in range(n)], "scores": [model.get_score(i) for i in range(n)], "kinds": "".join(kinds), "end": model.eos_id(), "unknown": model.unk_id()}


def _per_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("millrace-per-byte", _per_byte)


class PieceCodec:
    """encode and decode of one model."""

    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.end, self.unknown = model["end"], model["unknown"]
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "n"}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece holds a space after another character")
        self.newline_apart = not any("\n" in p for p in normal)
        self.units = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.newline_apart else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # Symbols: the model's own ids, then characters that occur only inside pieces.
        self.symbols = dict(normal)
        for p in normal:
            for c in p:
                self.symbols.setdefault(c, len(pieces) + len(self.symbols))
        self.width = max(self.symbols.values(), default=0) + 2
        self.other = self.width - 1  # any other character
        order = {s: r for r, s in enumerate(sorted({model["scores"][i] for i in normal.values()}, reverse=True))}
        rank = {p: order[model["scores"][i]] for p, i in normal.items()}
        safe = dict.fromkeys(normal, True)
        keys, merged = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in self.symbols and b in self.symbols:
                    keys.append(self.symbols[a] * self.width + self.symbols[b])
                    merged.append(i)
                    for part in (a, b):
                        if part in rank and rank[part] >= rank[p]:
                            safe[part] = False
        self.rank = np.zeros(len(pieces), dtype=np.int64)
        self.safe = np.zeros(len(pieces), dtype=bool)
        for p, i in normal.items():
            self.rank[i], self.safe[i] = rank[p], safe[p]
        self._hash(np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64))
        chars = {ord(p): s for p, s in self.symbols.items() if len(p) == 1}
        self.char_symbol = np.full(0x110000, self.other, dtype=np.int32)
        self.char_symbol[list(chars)] = list(chars.values())
        self.byte_id = {}
        self.bytes_of: list[bytes] = []
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "b":
                self.byte_id[int(p[3:5], 16)] = i
            self.bytes_of.append(bytes([int(p[3:5], 16)]) if k == "b" else b"" if k == "c" else " ⁇ ".encode() if k == "u" else p.replace(SPACE, " ").encode())
        self.spaced = {i for p, i in normal.items() if p[0] == SPACE}
        self.text_of = [str(i) for i in range(len(pieces))]
        self.reach = max(map(len, normal), default=1)
        self.id_text: dict[str, str] = {}
        self.id_bytes: dict[str, bytes] = {}

    def _hash(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressed table from pair to merged piece."""
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 6 + 2))))
        self.table_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.table_piece = np.full(1 << self.bits, -1, dtype=np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.table_key[at[todo]] == -1]
            slot, first = np.unique(at[free], return_index=True)
            self.table_key[slot], self.table_piece[slot] = keys[free[first]], merged[free[first]]
            todo = np.setdiff1d(todo, free[first])
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges to, or -1."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        held = self.table_key[at]
        out = np.where(held == keys, self.table_piece[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.table_key[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.table_piece[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def merge_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all units, flat, with each unit's count; a symbol of an other character is width + its code."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbol = self.char_symbol[codes].astype(np.int64)
        final = np.where(symbol == self.other, self.width + codes.astype(np.int64), symbol)
        alive = np.ones(len(codes), dtype=bool)
        place = np.arange(len(codes))  # where in `final` each symbol at work stands
        unit = np.repeat(np.arange(len(units)), lengths)
        while len(place) > 1:
            piece = np.full(len(place), -1, dtype=np.int64)
            inner = unit[:-1] == unit[1:]
            piece[:-1][inner] = self.pair(symbol[:-1][inner], symbol[1:][inner])
            key = np.where(piece >= 0, self.rank[piece], NONE)
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            least = np.minimum.reduceat(key, starts)
            sizes = np.diff(np.r_[starts, len(place)])
            best = (key == np.repeat(least, sizes)) & (key != NONE)
            at = np.flatnonzero(best)
            if not len(at):
                break
            first = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
            # Overlapping occurrences: every other one of a run, from its left end.
            opens = np.r_[True, at[1:] != at[:-1] + 1] | first
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            take = at[first | (((np.arange(len(at)) - run) % 2 == 0) & self.safe[piece[at]])]
            symbol[take] = piece[take]
            final[place[take]] = piece[take]
            alive[place[take + 1]] = False
            keep = np.ones(len(place), dtype=bool)
            keep[take + 1] = False
            keep &= np.repeat(least != NONE, sizes)
            place, unit, symbol = place[keep], unit[keep], symbol[keep]
        counts = np.bincount(np.repeat(np.arange(len(units)), lengths)[alive], minlength=len(units))
        return final[alive], counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece or -1, rank or NONE) of pairs of symbols."""
        piece = self.pair(left, right)
        return piece, np.where(piece >= 0, self.rank[piece], NONE)

    @staticmethod
    def _lowest(values: np.ndarray, before: int, after: int) -> np.ndarray:
        """The least of values from `before` places to the left to `after` places to the right of each."""
        size, held, span = before + after + 1, np.concatenate([np.full(before, NONE), values, np.full(after, NONE)]), 1
        while span < size:
            more = min(span, size - span)
            held = np.minimum(held[: len(held) - more], held[more:])
            span += more
        return held

    def merge_long(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merge_units for long units, merging everywhere at once."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbol = self.char_symbol[codes].astype(np.int64)
        final = np.where(symbol == self.other, self.width + codes.astype(np.int64), symbol)
        alive = np.ones(len(codes), dtype=bool)
        place = np.arange(len(codes))
        tied = np.ones(len(codes), dtype=bool)  # whether the next symbol at work is the next of the unit
        tied[np.cumsum(lengths) - 1] = False
        reach = self.reach
        while len(place) > 1:
            piece = np.full(len(place), -1, dtype=np.int64)
            key = np.full(len(place), NONE)
            inner = np.flatnonzero(tied[:-1])
            piece[inner], key[inner] = self._ranks(symbol[inner], symbol[inner + 1])
            least = self._lowest(key, reach, reach)
            is_least = (key == least) & (key != NONE)
            at = np.flatnonzero(is_least)
            if not len(at):
                break
            # Overlapping occurrences: every other one of a run, from its left end.
            opens = np.r_[True, at[1:] != at[:-1] + 1]
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            made, own = piece[at], key[at]
            # What a merge makes with its neighbours, as they are and merged alike; it is fine if all of it is of a higher rank.
            worse = np.ones(len(at), dtype=bool)
            left, right = np.flatnonzero((at > 0) & tied[at - 1]), np.flatnonzero((at + 2 < len(place)) & tied[at + 1])
            worse[left] &= self._ranks(symbol[at[left] - 1], made[left])[1] > own[left]
            worse[right] &= self._ranks(made[right], symbol[np.minimum(at[right] + 2, len(place) - 1)])[1] > own[right]
            worse &= self._ranks(made, made)[1] > own
            fine = self.safe[made] | worse
            # An equal pair to the left that waits for a lower one makes these wait as well.
            held_up = self._lowest(np.where(is_least, NONE, key), reach, 0)[at] <= own
            near = np.r_[False, (at[1:] - at[:-1] <= reach) & (own[1:] == own[:-1])]
            group = np.cumsum(~near) - 1
            stops = np.cumsum(~fine | held_up)
            before = np.r_[0, stops[:-1]]
            start = np.flatnonzero(~near)
            take = at[~held_up & (before == before[start][group])]
            symbol[take] = final[place[take]] = piece[take]
            alive[place[take + 1]] = False
            tied[take] = tied[take + 1]
            keep = np.ones(len(place), dtype=bool)
            keep[take + 1] = False
            # Where no pair is within reach nothing changes any more.
            quiet = (least == NONE) & np.r_[True, least[:-1] == NONE]
            tied[:-1] &= ~(quiet[:-1] | quiet[1:])
            keep &= ~quiet
            place, symbol, tied = place[keep], symbol[keep], tied[keep]
        counts = np.bincount(np.repeat(np.arange(len(units)), lengths)[alive], minlength=len(units))
        return final[alive], counts

    def fallback(self, symbol: int) -> list[int]:
        """Byte pieces of a character that is no piece (or the unknown id where the model has none)."""
        char = chr(symbol - self.width) if symbol >= self.width else next(c for c, s in self.symbols.items() if s == symbol)
        return [self.byte_id.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")]

    def split(self, text: str) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        """Remember of each new unit of all texts its ids as decimals and the bytes that these ids decode to."""
        if len(self.id_text) > REMEMBERED:
            self.id_text.clear()
            self.id_bytes.clear()
        new = set().union(*texts) - self.id_text.keys()
        for long in (False, True):
            units = [u for u in new if (len(u) > LONG_UNIT) == long]
            if units:
                self._learn(units, *(self.merge_long if long else self.merge_units)(units))

    def _learn(self, units: list[str], final: np.ndarray, counts: np.ndarray) -> None:
        others = np.flatnonzero(final >= len(self.text_of))
        odd = [(k, self.fallback(i)) for k, i in zip(others.tolist(), final[others].tolist(), strict=True)]
        final[others] = self.end
        flat = final.tolist()
        ids, raw = list(map(self.text_of.__getitem__, flat)), list(map(self.bytes_of.__getitem__, flat))
        for k, by_byte in odd:
            ids[k], raw[k] = " ".join([self.text_of[i] for i in by_byte]), b"".join([self.bytes_of[i] for i in by_byte])
        ends = np.cumsum(counts)
        for u, a, b in zip(units, (ends - counts).tolist(), ends.tolist(), strict=True):
            self.id_text[u] = " ".join(ids[a:b])
            self.id_bytes[u] = b"".join(raw[a:b])

    def encode(self, texts: list[str], end: bool = True) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        self.learn(split)
        return [[int(i) for u in units for i in self.id_text[u].split(" ")] + [self.end] * end for units in split]

    def decode(self, ids: list[int]) -> str:
        """Control ids are left out, bytes that form no character become U+FFFD one by one."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        first = next((i for i in ids if self.bytes_of[i]), None)
        dummy = first is not None and first in self.spaced
        return raw[dummy:].decode("utf-8", "millrace-per-byte")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(ids, SHA-256 of the ids' decimals, SHA-256 of what the ids decode to) of each text, the end id included."""
        out = []
        split = [self.split(t) for t in texts]
        self.learn(split)
        id_text, id_bytes, end = self.id_text.__getitem__, self.id_bytes.__getitem__, self.text_of[self.end]
        for units in split:
            ids = " ".join([*map(id_text, units), end])
            raw = b"".join(map(id_bytes, units))
            if units and int(id_text(units[0]).split(" ", 1)[0]) in self.spaced:
                raw = raw[1:]  # the dummy prefix
            decoded = raw.decode("utf-8", "millrace-per-byte").encode()
            out.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


def _shared(holder, cache: dict = {}) -> PieceCodec:  # noqa: B006  one codec a worker and broadcast
    if holder.id not in cache:
        cache.clear()
        cache[holder.id] = PieceCodec(holder.value)
    return cache[holder.id]


class _Held:
    """A broadcast model with an id that the workers can keep its codec by."""

    def __init__(self, spark, path: str):
        self.broadcast = spark.sparkContext.broadcast(read_model(path))
        self.id = f"{path}:{id(self.broadcast)}"

    @property
    def value(self) -> dict:
        return self.broadcast.value


def encode_documents(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with ids array<int> and decoded string of every row; null texts count as empty, repeated rows stay repeated."""
    held = _Held(docs.sparkSession, model_path)

    def make():
        codec = _shared(held)

        def work(texts):
            ids = codec.encode(texts)
            return ids, [codec.decode(x) for x in ids]

        return work

    return map_texts(docs, text_col, keep, {"ids": "array<int>", "decoded": "string"}, make)


def digest_documents(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with n_tokens, ids_sha256 and decoded_sha256 of every row, without moving ids or texts through Spark."""
    held = _Held(docs.sparkSession, model_path)

    def make():
        codec = _shared(held)

        def work(texts):
            found = codec.digests(texts)
            return [[x[j] for x in found] for j in range(3)]

        return work

    return map_texts(docs, text_col, keep, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, make)
