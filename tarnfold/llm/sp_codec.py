"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by the longest prefix in the model's compiled character map, noting for every normalised
byte the source byte that it ends at; pieces are then projected to source bytes. White space starts a segment
(no piece of the vocabulary holds white space after another character, which is checked), so a segment's
pieces do not depend on its neighbours: each worker keeps the pieces of segments that it has met.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, mapped, ship, texts

#: Bytes of each of the two halves of a worker's cache of segments, counted with what Python adds to them, and of a
#: segment that it keeps beyond its text.
CACHED, LONGEST = 72 << 20, 4096
SPACE = "▁".encode()
_SEGMENT = re.compile(rb" +[^ ]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """The compiled map: a double array over source bytes whose leaves point at NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.to = [], b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.to = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source prefix at this place, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = offset(units[0])
        for i in range(at, len(text)):
            b = text[i]
            node ^= b
            if node >= len(units) or units[node] & 0x800000FF != b:
                break
            has_leaf = units[node] >> 8 & 1
            node ^= offset(units[node])
            if has_leaf:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.to[start : self.to.index(b"\0", start)])
        return found

    def apply(self, text: bytes) -> tuple[bytes, list[tuple[int, int]]]:
        """Replaced text, and for each of its bytes the source range of the rule or character that gave it."""
        out, origin, i = bytearray(), [], 0
        while i < len(text):
            rule = self.longest(text, i)
            if rule is None:
                b = text[i]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                rule = (n, text[i : i + n])
            n, new = rule
            out += new
            same = new == text[i : i + n]
            origin += [(i + k, i + k + 1) if same else (i, i + n) for k in range(len(new))]
            i += n
        return bytes(out), origin


@dataclass
class Encoding:
    """ids as decimal text; n of them; ends of their source spans (starts are the ends before); the decoded text."""

    ids: str
    n: int
    ends: np.ndarray
    decoded: bytes


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only models that write white space before words, escaped, are supported")
        inner = [p.piece for p in proto.pieces if "▁" in p.piece.lstrip("▁")]
        if sum(p.type == 6 for p in proto.pieces) != 256:
            raise ValueError("only models with byte pieces are supported; others lose the source of characters they don't know")
        if inner or any(p.type == 4 for p in proto.pieces):
            raise ValueError("a piece reaches over white space; segments can't be encoded alone")
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", True, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" if p.type == 3 else p.piece.encode().replace(SPACE, b" ") for p in proto.pieces]
        self.digits, self.blank = [str(i) for i in range(len(proto.pieces))], [self.plain.piece_to_id("▁")]
        self.known: dict[bytes, tuple[str, bytes, bytes, int]] = {}
        self.old: dict[bytes, tuple[str, bytes, bytes, int]] = {}  # those before; what is met again moves on
        self.size = 0

    def forget(self) -> None:
        """Start a new half where one is full; a very long segment goes at once."""
        if self.size > CACHED:
            self.old, self.known, self.size = self.known, {}, 0
            for key in [k for k in self.old if len(k) > LONGEST]:
                del self.old[key]

    def meet(self, keys: list[bytes]) -> None:
        """Put ids, decoded bytes, bytes by piece and count of the segments " " + key into known; white space as blanks."""
        known, digits, surface = self.known, self.digits, self.surface
        new = []
        for key in dict.fromkeys(keys):
            if key in known:
                continue
            had = self.old.get(key)
            if had is None:
                new.append(key)
            else:
                known[key] = had
                self.size += 400 + len(key) + len(had[0]) + len(had[1]) + len(had[2])
        for key, ids in zip(new, self.plain.encode([k.decode("utf-8", "replace") for k in new], num_threads=1), strict=True):
            ids = ids or self.blank
            parts = [surface[i] for i in ids]
            known[key] = made = (",".join([digits[i] for i in ids]), b"".join(parts), bytes(map(len, parts)), len(ids))
            self.size += (400 + len(key) + len(made[0]) + len(made[1]) + len(made[2])) if len(key) <= LONGEST else CACHED + 1

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """Blanks for white space, with the dummy prefix; and each byte's source end (None: one to one after the prefix)."""
        if not self.map.units and not self.squeeze and SPACE not in text:
            return (b" " if self.dummy else b"") + text, None
        new, origin = self.map.apply(text)
        out, ends, i = bytearray(), [], 0
        if self.squeeze:
            while new[i : i + 1] == b" ":
                i += 1
        if self.dummy and i < len(new):
            out += b" "
            ends.append(origin[i][0])
        stop = len(new)
        if self.squeeze:
            while stop > i and new[stop - 1 : stop] == b" ":
                stop -= 1
        while i < stop:
            if new[i : i + 3] == SPACE:
                out += b" "
                ends.append(origin[i + 2][1])
                i += 3
                continue
            if not (self.squeeze and new[i : i + 1] == b" " and out[-1:] == b" "):
                out += new[i : i + 1]
                ends.append(origin[i][1])
            elif ends:
                ends[-1] = origin[i][1]
            i += 1
        return bytes(out), np.array(ends, np.int64)

    def encode(self, text: bytes) -> Encoding:
        if not text:
            return Encoding("", 0, np.zeros(0, np.int64), b"")
        norm, ends = self.normalised(text)
        if not norm:
            return Encoding("", 0, np.zeros(0, np.int64), b"")
        if norm[:1] == b" " and b"  " not in norm and norm[-1:] != b" ":
            keys = norm[1:].split(b" ")
        elif norm[:1] == b" ":
            keys = [s[1:] for s in _SEGMENT.findall(norm)]
        else:
            raise ValueError("models without a dummy prefix are not supported")
        found = list(map(self.known.get, keys))
        if None in found:
            self.meet(keys)
            found = list(map(self.known.__getitem__, keys))
        at = np.cumsum(np.frombuffer(b"".join([x[2] for x in found]), np.uint8), dtype=np.int64)
        # a blank of the dummy prefix stands for no source byte
        at = at - 1 if ends is None else ends[at - 1]
        self.forget()
        return Encoding(",".join([x[0] for x in found]), sum([x[3] for x in found]), at, self.joined([x[1] for x in found]))

    @staticmethod
    def joined(parts: list[bytes]) -> bytes:
        """Decoded text: the pieces' bytes without the dummy prefix; what isn't UTF-8 becomes U+FFFD."""
        out = b"".join(parts)
        out = out[1:] if out[:1] == b" " else out
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.joined([self.surface[i] for i in ids])


def codec(path: str) -> Codec:
    """One a worker process, kept between tasks."""
    return kept("codec", path, lambda: Codec(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts and ends (source bytes of each piece, in UTF-8) of each row of docs (doc_id, text).

    Null and empty texts have empty arrays; repeated rows are encoded once each; other columns are ignored. A
    byte piece covers its own byte; the pieces of a text cover all of it, but for white space that the model drops.
    """
    path = path or default_path()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            got = [c.encode(x.as_py() or b"") for x in batch.column(1).cast(pa.large_binary())]
            ids = [np.array(g.ids.split(",") if g.ids else [], np.int32) for g in got]
            starts = [np.concatenate([[0], g.ends[:-1]])[: g.n].astype(np.int32) for g in got]
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, [g.ends.astype(np.int32) for g in got])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "ids", "starts", "ends"])

    return mapped(texts(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>", "codec")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of encoded (doc_id, ids); null ids are an empty text."""
    path = path or default_path()
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []).decode() for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string", "codec")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode each text, and keep digests: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, covered_bytes.

    The ids and spans are those of encode(), folded where they are made so that they need not leave the worker:
    spans_sha256 is over the pieces' source ends (eight bytes each, little-endian; a start is the end before), covered_bytes the last
    of them. Null and empty texts have no pieces, and digests of nothing; repeated rows are encoded once each; a text may be
    of any length; an empty table gives an empty result; other columns are ignored.
    """
    path = path or default_path()
    ship(docs.sparkSession)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            got = []
            for x in batch.column(1).cast(pa.large_binary()):
                e = c.encode(x.as_py() or b"")
                got.append((e.n, sha(e.ids.encode()), sha(e.decoded), sha(e.ends.astype("<i8").tobytes()), int(e.ends[-1]) if e.n else 0))
            n, ids, decoded, spans, covered = zip(*got, strict=True) if got else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(spans, pa.string()), pa.array(covered, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered_bytes"])

    return mapped(texts(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered_bytes long", "codec")
