"""SentencePiece ids with the original byte span of every piece.

A text is normalised as the model says: at each place the longest prefix found
in the compiled character map is replaced, and every byte written remembers the
source byte it came from.  Pieces follow each other over the normalised bytes,
so their ends look up that record and give spans of the original text.

Ids come from the sentencepiece library, given whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of

SPACE = "▁"
#: Texts are encoded together until their characters pass this.
TOGETHER = 1 << 20


class CharacterMap:
    """Longest-prefix replacement by a compiled double-array trie of UTF-8 bytes.

    Layout: a little-endian length, that many bytes of 32-bit trie units, then
    the replacements, each ended by a zero byte.  A unit holds a label in its
    low byte, bit 8 for "a value follows", and the offset to its children.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 0x200 else 0)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched from ``at`` and what replaces them."""
        node, best = self._offset(self.units[0]), None
        for end in range(at, len(raw)):
            node ^= raw[end]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != raw[end]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                start = self.units[node] & 0x7FFFFFFF
                best = end + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return best


class Normaliser:
    """Normalised bytes of a text, and for each the source byte it stems from."""

    def __init__(self, charmap: CharacterMap | None = None, dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.charmap, self.dummy_prefix, self.squeeze, self.escape = charmap, dummy_prefix, squeeze, escape

    def _mapped(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        if self.charmap is None:
            return np.frombuffer(raw, np.uint8), np.arange(len(raw))
        out, src, at = bytearray(), [], 0
        while at < len(raw):
            hit = self.charmap.longest(raw, at)
            if hit:
                n, new = hit
            else:
                n = next(k for k in (1, 2, 3, 4) if at + k >= len(raw) or raw[at + k] & 0xC0 != 0x80)
                new = raw[at : at + n]
            out += new
            src += [at] * len(new) if hit else range(at, at + n)
            at += n
        return np.frombuffer(bytes(out), np.uint8), np.array(src, np.int64)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source place of each byte and at last of the end)."""
        raw = text.encode("utf-8", "surrogatepass")
        out, src = self._mapped(raw)
        if self.squeeze and len(out):
            space = out == 0x20
            stay = ~space
            stay[1:] |= space[1:] & ~space[:-1]
            solid = np.flatnonzero(~space)
            stay[: solid[0] if len(solid) else len(out)] = False
            stay[(solid[-1] + 1) if len(solid) else 0 :] = False
            out, src = out[stay], src[stay]
        if not len(out):
            return b"", np.array([len(raw)], np.int64)
        if self.dummy_prefix:
            out, src = np.concatenate(([np.uint8(0x20)], out)), np.concatenate(([src[0]], src))
        if self.escape:
            space = out == 0x20
            wide = np.where(space, 3, 1)
            first = np.cumsum(wide) - wide
            big = np.repeat(out, wide)
            for k, b in enumerate(SPACE.encode()):
                big[first[space] + k] = b
            # a byte after a widened space belongs to that space's end
            out, src = big, np.repeat(src, wide)
        return out.tobytes(), np.concatenate((src, [len(raw)]))


class Encoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        self.normalise = Normaliser(CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces)
        pieces = [p.piece for p in spec.pieces]
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.encode() for p in spec.pieces]
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.unknown = self.lib.unk_id()
        self._names = [str(i) for i in range(len(pieces))]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, num_threads=1)

    def joined(self, ids: list[int]) -> str:
        """The decimal ids joined by commas."""
        return ",".join(map(self._names.__getitem__, ids))

    def _with_unknown(self, norm: bytes, ids: list[int]) -> np.ndarray:
        """Normalised bytes of each piece where some are unknown: such a run, which the library leaves whole, reaches to where the next piece is found."""
        out, at = [], 0
        for i, piece in enumerate(ids):
            if piece != self.unknown:
                out.append(int(self.sizes[piece]))
            elif i + 1 == len(ids):
                out.append(len(norm) - at)
            else:
                out.append(max(norm.find(self.raw[ids[i + 1]], at + 1) - at, 1))
            at += out[-1]
        return np.array(out, np.int64)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(pieces, 2) byte spans of the original text."""
        norm, src = self.normalise(text)
        sizes = self.sizes[ids] if len(ids) else np.zeros(0, np.int64)
        if self.unknown in ids:
            sizes = self._with_unknown(norm, ids)
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(norm):
            raise ValueError("the pieces do not cover the normalised text")
        return np.stack((src[ends - sizes], src[ends]), axis=1) if len(ends) else np.zeros((0, 2), np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(path)
        for batch in batches:
            texts, rows = [t or "" for t in texts_of(batch)], []
            for part in _groups(texts):
                for text, ids in zip(part, enc.encode_all(part), strict=True):
                    spans = enc.spans(text, ids)
                    decoded = enc.lib.decode(ids).encode("utf-8", "surrogatepass")
                    rows.append((len(ids), _sha(enc.joined(ids).encode()), _sha(decoded), int((spans[:, 1] - spans[:, 0]).sum()), _sha(spans.astype("<i8").tobytes())))
            columns = map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(5))
            yield {"doc_id": batch.column("doc_id")} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes", "spans_sha256"), columns, strict=True))

    return run


def piece_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_span_bytes, spans_sha256) for each row.

    A null text counts as empty, an empty one has no ids; null ids stay null
    and rows that repeat an id are encoded by themselves.
    ``n_span_bytes`` is what the spans of all pieces cover; in a model that
    normalises nothing away it is the size of the text.  ``spans_sha256`` is of
    the spans, begins and ends as 64-bit little-endian integers.  Other columns
    are ignored.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(plain, _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long, spans_sha256 string")


def encode_spans(docs: DataFrame, path: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with ``into``: an array of (id, begin, end), the end exclusive, over the text's UTF-8 bytes.

    Raises ValueError if ``docs`` has a column of that name already.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into}; choose another name")

    @F.pandas_udf("array<struct<id: int, begin: long, end: long>>")
    def pieces(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        out = []
        for part in _groups([t if isinstance(t, str) else "" for t in texts]):
            for t, ids in zip(part, enc.encode_all(part), strict=True):
                out.append([{"id": i, "begin": b, "end": e} for i, (b, e) in zip(ids, enc.spans(t, ids).tolist(), strict=True)])
        return pd.Series(out)

    return docs.withColumn(into, pieces(F.col(text)))
