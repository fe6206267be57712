"""SentencePiece encoding with source offsets, and decoding.

The model file is read once on the driver (a vocabulary, bounded) and travels with the
tasks.  A text is normalised by the longest match in the model's compiled character map;
each normalised byte keeps the source byte it came from.  The library's segmenter, told to
normalise nothing, cuts the normalised text, and every piece is projected through the
alignment to a byte span of the original text.  Plain Arrow tasks over the corpus: no
shuffle, and a task holds a few hundred texts at a time.
"""

from __future__ import annotations

import re
import struct
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from packaudit.llm.common import CACHE_WORDS, key_type, slices, texts

SPACE = "▁"  # how a space is written inside pieces
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # piece types of the model format
RESULT = ("ids", "starts", "ends")
SHORT = 8  # characters of words that stay remembered


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, through Spark so that any of its stores will do."""
    return bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()[0])


class CharMap:
    """The compiled character map: a double-array trie and the replacement texts behind it."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.store = blob[4 + size:] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched from ``at`` and their replacement, for the longest key that matches."""
        units, found = self.units, None
        if not units:
            return None

        def child(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node = child(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= child(unit)
            if unit & 0x100:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.store[found[1]:self.store.index(b"\0", found[1])]


class Pieces:
    """One model: character map, spacing rules, segmenter and decoder."""

    def __init__(self, blob: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.decoder = SentencePieceProcessor(model_proto=blob)
        model = proto.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.user = sorted((p.piece.encode() for p in model.pieces if p.type == USER), key=len, reverse=True)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.width = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        # Merges never cross "other character, then space" unless some piece does.  Else texts are
        # cut there, and a part that occurs often is segmented once in a task.
        crossed = self.user or any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        self.part = re.compile(r"(?s).+" if crossed else f"(?s){SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.known: dict[str, bytes] = {}  # part -> ids as packed numbers
        # Texts of words and single spaces need no normalised copy where the model changes nothing else.
        self.words: dict[str, bytes] = {}  # word after a space -> ids as packed numbers
        self.odd: set[str] = set()  # of these, words that do not decode to themselves
        self.simple = self.prefix and self.escape and not (self.map.units or self.squeeze or self.suffix or crossed)
        normal = [p.piece if p.type == NORMAL else "" for p in model.pieces]
        self.anchor = next((i for i, p in enumerate(normal) if p.isascii() and p.isalpha()), None)
        self.anchor_text = "" if self.anchor is None else normal[self.anchor]
        self.source_width = np.array([1 if p.type == BYTE else len(p.piece.replace(SPACE, " ").encode()) for p in model.pieces], np.int64)
        self.special = np.array([p.type != NORMAL for p in model.pieces])
        self.partial = np.array([p.type == UNKNOWN or (p.type == BYTE and int(p.piece[1:-1], 16) > 127) for p in model.pieces])
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = SentencePieceProcessor(model_proto=model.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the source byte it came from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not (self.map.units or self.user or self.squeeze or self.suffix) and self.escape:
            return self._plain(text, data)
        gap = SPACE.encode() if self.escape else b" "
        out, align, at, size = bytearray(), [], 0, len(data)

        def step(i: int) -> tuple[int, bytes]:
            own = next((u for u in self.user if data.startswith(u, i)), None)
            hit = (len(own), own) if own else self.map.longest(data, i)
            if hit is None:
                n = 1
                while i + n < size and data[i + n] & 0xC0 == 0x80:
                    n += 1
                hit = n, data[i:i + n]
            return hit

        if self.squeeze:
            while at < size:
                n, new = step(at)
                if new != b" ":
                    break
                at += n
            if at == size:
                return "", np.zeros(1, np.int64)

        def blank(source: int) -> None:
            out.extend(gap)
            align.extend([source] * len(gap))

        if self.prefix and not self.suffix:
            blank(at)
        after_space = self.squeeze
        while at < size:
            n, new = step(at)
            while after_space and new.startswith(b" "):
                new = new[1:]
            for b in new:
                if b == 32:
                    blank(at)
                else:
                    out.append(b)
                    align.append(at)
            if new:
                after_space = new.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(gap):
                at = align[len(out) - len(gap)]
                del out[len(out) - len(gap):], align[len(align) - len(gap):]
        if self.prefix and self.suffix:
            blank(at)
        return out.decode(), np.array([*align, at], np.int64)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """The same for a model with an empty map that keeps all spaces."""
        b = np.frombuffer(data, np.uint8)
        place = np.arange(len(b))
        first = np.maximum.accumulate(np.where(b & 0xC0 != 0x80, place, 0))
        align = np.repeat(first, np.where(b == 32, 3, 1))
        lead = [0, 0, 0] if self.prefix else []
        return SPACE * self.prefix + text.replace(" ", SPACE), np.concatenate([lead, align, [len(b)]]).astype(np.int64)

    def read(self, contents: list[str]) -> list[tuple[np.ndarray, np.ndarray, str]]:
        """Per text its ids, the source byte at which each piece starts with the end of the last,
        and what the ids decode to.

        A word that follows a space is segmented and decoded once, however often a task meets
        it; a text of words that all decode to themselves does so as well.
        """
        usable = self.simple and self.anchor is not None
        split = [t.split(" ") if usable and t and SPACE not in t and "  " not in t and t[0] != " " else None for t in contents]
        packed = self._packed([w for words in split if words is not None for w in words])
        out, at = [], 0
        for text, words in zip(contents, split):
            ids = None
            if words is not None:
                ids = np.frombuffer(b"".join(packed[at:at + len(words)]), np.int32)
                at += len(words)
            if ids is None or self.partial[ids].any():  # a character of several pieces: its alignment is needed
                out.append((*self._general(text), None))
                continue
            edges = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.source_width[ids], out=edges[1:])
            edges[1:] -= 1  # the space in front is no source byte
            out.append((ids, edges, text if not self.odd or self.odd.isdisjoint(words) else None))
        again = [i for i, (_, _, back) in enumerate(out) if back is None]
        for i, back in zip(again, self.decoder.decode([out[i][0].tolist() for i in again], num_threads=1)):
            out[i] = *out[i][:2], back
        return out

    def _packed(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word as it stands after a space."""
        if len(self.words) > CACHE_WORDS:  # frequent words are short: those are kept if they are not too many
            kept = {w: i for w, i in self.words.items() if len(w) <= SHORT}
            self.words = kept if len(kept) < CACHE_WORDS // 2 else {}
            self.odd.intersection_update(self.words)
        found = list(map(self.words.get, words))
        new = list({w for w, ids in zip(words, found) if ids is None})
        if not new:
            return found
        ids = self.segmenter.encode([SPACE + w for w in new], num_threads=1)
        sizes = list(map(len, ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes))
        ends = np.cumsum(sizes)
        raw, cuts = flat.tobytes(), (4 * ends).tolist()
        self.words.update(zip(new, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
        # Plain pieces decode to their own text; words with any other piece are decoded once.
        other = np.unique(np.searchsorted(ends, np.flatnonzero(self.special[flat]), "right")).tolist()
        backs = self.decoder.decode([[self.anchor, *ids[i]] for i in other], num_threads=1)
        self.odd.update(new[i] for i, back in zip(other, backs) if back != f"{self.anchor_text} {new[i]}")
        known = self.words
        return [known[w] if ids is None else ids for w, ids in zip(words, found)]

    def _general(self, content: str) -> tuple[np.ndarray, np.ndarray]:
        text, align = self.normalise(content)
        own = self.part.findall(text)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set(own).difference(self.known))
        self.known.update(zip(new, (array("i", i).tobytes() for i in self.segmenter.encode(new, num_threads=1))))
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32)
        return ids, align[self._edges(text, ids)]

    def encode(self, contents: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids per text, and the source byte at which each piece starts, with the end of the last."""
        return [(ids, edges) for ids, edges, _ in self.read(contents)]

    def _edges(self, text: str, ids: np.ndarray) -> np.ndarray:
        if (ids == self.unknown).any():  # one unknown piece stands for a run of any characters
            return self._edges_by_piece(text)
        edges = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.width[ids], out=edges[1:])
        return edges

    def _edges_by_piece(self, text: str) -> np.ndarray:
        sizes = [len(p.encode()) for p in self.segmenter.encode(text, out_type=str)]
        return np.cumsum([0, *sizes])


def encode(files: DataFrame, model: bytes) -> DataFrame:
    """(path, ids, starts, ends) per file: piece ids of its whole content, and the UTF-8 byte
    span of the original content behind each piece.

    No begin or end ids.  Null and empty content give empty lists.  One row per input row, so
    repeated and null paths stay; other columns are not read.  A character outside the
    vocabulary becomes byte pieces; the last of them holds the character's span.
    """

    def run(batches):
        m = Pieces(model)
        for batch in slices(batches):
            found = m.encode(texts(batch))
            sizes = np.cumsum([0, *(len(i) for i, _ in found)]).astype(np.int32)
            values = [np.concatenate([i for i, _ in found]),
                      np.concatenate([e[:-1] for _, e in found]).astype(np.int32), np.concatenate([e[1:] for _, e in found]).astype(np.int32)]
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(v)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *lists], ["path", *RESULT])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, ids array<int>, starts array<int>, ends array<int>")


def round_trip(files: DataFrame, model: bytes) -> DataFrame:
    """(path, ids, edges, content) per file: ``encode`` and ``decode`` of its whole content in one
    task.  Piece k stands for the source bytes from edges[k] to edges[k + 1]; ``content`` is what
    the ids decode to.  An empty content has the one edge 0.  Rows as in ``encode``.
    """

    def run(batches):
        m = Pieces(model)
        for batch in slices(batches):
            found = m.read(texts(batch))
            lists = []
            for values in ([ids for ids, _, _ in found], [edges.astype(np.int32) for _, edges, _ in found]):
                lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32)), pa.array(np.concatenate(values))))
            yield pa.RecordBatch.from_arrays([batch.column("path"), *lists, pa.array([back for _, _, back in found], pa.string())], ["path", "ids", "edges", "content"])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, ids array<int>, edges array<int>, content string")


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """(path, ids, content) per row of (path, ids): the text behind the ids.

    Null lists give the empty text; control ids add nothing.  Ids outside the vocabulary fail.
    """

    def run(batches):
        m = Pieces(model)
        for batch in slices(batches):
            out = m.decoder.decode([i or [] for i in batch.column("ids").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("ids"), pa.array(out, pa.string())], ["path", "ids", "content"])

    return tokens.select("path", "ids").mapInArrow(run, f"path {key_type(tokens)}, ids array<int>, content string")
