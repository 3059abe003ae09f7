"""Unigram encoding and decoding with the pieces and scores of a SentencePiece vocabulary file.

Method: pieces lie in a double-array trie over UTF-8 bytes; among all segmentations of a text Viterbi takes that
with the highest sum of piece scores (the first one found among equals, starts ascending, then lengths). A
character that no piece covers costs the lowest score less 10 and becomes byte pieces. White space is
marked: a text gets one leading marker, every space is one. Decoding turns markers into spaces and drops the
leading one. No piece has a marker behind another character, so segmentation falls apart before each marker
run; equal parts are segmented once per worker, many at a time.

Defined results: null and empty texts have no pieces; control pieces are never produced, and decode to
nothing. Extra columns are ignored; repeated rows are encoded each. Texts may have any length: long parts
without white space are segmented one by one in the same way.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import over_batches, record_batch, slices

MARK = "▁"
UNKNOWN_COST = 10.0
CACHE_PARTS = 400_000
#: Parts of more bytes are segmented alone.
WIDE = 96
_WINDOW = 4096
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, as in the file; ``kinds``: 1 ordinary, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]

    @staticmethod
    def read(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        tests = ((2, model.is_unknown), (3, model.is_control), (6, model.is_byte), (5, model.is_unused))
        kinds = tuple(next((k for k, test in tests if test(i)), 1) for i in ids)
        return Vocabulary(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), kinds)


class Trie:
    """Double-array trie: the child of node s by byte c is base[s] + c if check of that cell is s."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for word, value in words.items():
            node = tree
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = value
        self.base, self.check, self.value = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._room(2 * _WINDOW)
        self.check[0] = 0
        todo, free, dense = [(0, tree)], 257, 257
        while todo:
            s, node = todo.pop()
            self.value[s] = node.get(-1, -1)
            own = [c for c in node if c >= 0]
            if not own:
                continue
            if len(own) == 1:
                while self.check[free] >= 0:
                    free += 1
                    self._room(free + 256)
                at = max(1, free - own[0])
                while self.check[at + own[0]] >= 0:
                    at += 1
            else:
                while True:
                    self._room(dense + _WINDOW + 256)
                    fits = np.ones(_WINDOW, bool)
                    for c in own:
                        fits &= self.check[dense + c : dense + c + _WINDOW] < 0
                    if fits.any():
                        at = dense + int(fits.argmax())
                        break
                    dense += _WINDOW // 2
            self._room(at + 256)
            self.base[s] = at
            self.check[[at + c for c in own]] = s
            todo.extend((at + c, node[c]) for c in own)
        last = int(np.flatnonzero(self.check >= 0).max()) + 257
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    def _room(self, cells: int) -> None:
        if (more := cells - len(self.check)) > 0:
            more = max(more, len(self.check))
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check, self.value = (np.append(x, np.full(more, -1, np.int32)) for x in (self.check, self.value))


class Unigram:
    """Encodes and decodes; built once on the driver and broadcast (its size is that of the vocabulary)."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        ordinary = [i for i, k in enumerate(v.kinds) if k in (1, 4)]
        for i in ordinary:
            if MARK in v.pieces[i].lstrip(MARK):
                raise ValueError(f"piece {i} has a white space marker behind another character")
        self.trie = Trie({v.pieces[i].encode(): i for i in reversed(ordinary)})
        self.scores = np.array(v.scores, np.float64)
        self.unknown = min(self.scores[i] for i in ordinary) - UNKNOWN_COST
        self.longest = max(len(v.pieces[i].encode()) for i in ordinary)
        self.byte_ids = np.full(256, -1, np.int64)
        blobs = []
        for i, k in enumerate(v.kinds):
            if k == 6:
                self.byte_ids[int(v.pieces[i][3:-1], 16)] = i
                blobs.append(bytes([int(v.pieces[i][3:-1], 16)]))
            else:
                blobs.append(b"" if k == 3 else " ⁇ ".encode() if k == 2 else v.pieces[i].replace(MARK, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.is_byte = np.array([k == 6 for k in v.kinds])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.sizes = np.array([len(b) for b in blobs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}

    def segmented(self, part: bytes) -> np.ndarray:
        """Ids of one part, position by position."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(part)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if part[i] & 0xC0 == 0x80:
                continue
            here, s, alone = best[i], 0, False
            width = _width(part[i])
            for j in range(i, min(n, i + self.longest)):
                t = int(base[s]) + part[j]
                if check[t] != s:
                    break
                s = t
                if value[s] >= 0:
                    alone |= j + 1 - i == width
                    if here + scores[value[s]] > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = here + scores[value[s]], i, int(value[s])
            if not alone and here + self.unknown > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = here + self.unknown, i, -1
        ids, at = [], n
        while at:
            i = back[at]
            ids.extend([piece[at]] if piece[at] >= 0 else self.byte_ids[list(part[i:at])][::-1])
            at = i
        return np.array(ids[::-1], np.uint32)

    def together(self, parts: list[bytes]) -> list[bytes]:
        """Ids of many short parts as little-endian 32-bit numbers, all parts in step."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        rows, lengths = len(parts), np.array([len(p) for p in parts])
        n = int(lengths.max())
        text = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in parts), np.uint8).reshape(rows, n).T.astype(np.int32)
        lead = (text & 0xC0) != 0x80
        width = _WIDTHS[text]
        best = np.full((n + 1, rows), -np.inf)
        back, piece = np.zeros((n + 1, rows), np.int16), np.full((n + 1, rows), -1, np.int32)
        best[0] = 0.0
        for i in range(n):
            at = np.flatnonzero(lead[i] & (lengths > i))
            begun, s, here = at, np.zeros(len(at), np.int32), best[i, at]
            alone = np.zeros(rows, bool)
            for j in range(i, min(n, i + self.longest)):
                t = base[s] + text[j, at]
                on = (check[t] == s) & (lengths[at] > j)
                at, s, here = at[on], t[on], here[on]
                if not at.size:
                    break
                ends = value[s] >= 0
                rows_, ids = at[ends], value[s[ends]]
                alone[rows_[width[i, rows_] == j + 1 - i]] = True
                total = here[ends] + self.scores[ids]
                better = total > best[j + 1, rows_]
                rows_ = rows_[better]
                best[j + 1, rows_], back[j + 1, rows_], piece[j + 1, rows_] = total[better], i, ids[better]
            rest = begun[~alone[begun]]
            to, total = i + width[i, rest], best[i, rest] + self.unknown
            better = total > best[to, rest]
            rest, to = rest[better], to[better]
            best[to, rest], back[to, rest], piece[to, rest] = total[better], i, -1
        out = []
        back, piece = back.T.tolist(), piece.T.tolist()
        for r, part in enumerate(parts):
            ids, at = [], len(part)
            ends, ids_at = back[r], piece[r]
            while at:
                i = ends[at]
                ids.extend([ids_at[at]] if ids_at[at] >= 0 else self.byte_ids[list(part[i:at])][::-1].tolist())
                at = i
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def learn(self, parts: set[str]) -> None:
        if len(self.known) + len(parts) > CACHE_PARTS:
            self.known = {}
        new = sorted(((p.encode(), p) for p in parts), key=lambda x: len(x[0]))
        short = [x for x in new if len(x[0]) <= WIDE]
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            self.known.update(zip((p for _, p in some), self.together([b for b, _ in some]), strict=True))
        for b, p in new[len(short) :]:
            self.known[p] = self.segmented(b).astype("<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_PART.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if new := (every := set().union(*split)) - self.known.keys():
            self.learn(new)
            if left := every - self.known.keys():
                self.learn(left | new if len(self.known) == 0 else left)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), "<u4") for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        text = self.blob[take].tobytes()
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_WIDTHS = np.array([_width(c) for c in range(256)], np.int64)
_OUT = pa.schema([("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])


def encode_and_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``key`` with digests of the ids and of the text decoded from them; with ``ids``, the ids and the decoded text too."""
    model = df.sparkSession.sparkContext.broadcast(Unigram(Vocabulary.read(path)))
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    schema = pa.schema([*_OUT, *([("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if ids else [])])

    def make():
        own = model.value

        def work(batch):
            texts, rows = batch.column(1).to_pylist(), []
            for part in slices(texts):
                for i, found in zip(part, own.encode_all([texts[i] for i in part]), strict=True):
                    decoded = own.decode(found)
                    row = (len(found), int(own.is_byte[found].sum()), zlib.crc32(found.tobytes()), zlib.crc32(decoded.encode()), decoded == (texts[i] or ""))
                    rows.append((*row, found.tolist(), decoded) if ids else row)
            columns = record_batch(schema, list(zip(*rows, strict=True)))
            return pa.RecordBatch.from_arrays([batch.column(0), *columns.columns], ["key", *schema.names])

        return work

    fields = "key " + narrow.schema["key"].dataType.simpleString() + ", n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    out = narrow.mapInArrow(over_batches(make), fields + (", ids array<long>, decoded string" if ids else ""))
    return out.withColumnRenamed("key", key)
