"""SentencePiece encoding that keeps every piece's place in the original bytes, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .support import byte_groups, map_batches

GROUP_BYTES = 1 << 20
#: Chunks kept by a worker, and characters of chunks after which it begins anew.
KEPT_CHUNKS, KEPT_CHARS = 400_000, 16 << 20
BLANK = "▁"
# Blanks and line feeds begin a chunk; no piece of a splitting vocabulary reaches over that place.
_CHUNK = re.compile(r"[ \n]+[^ \n]*")


class CharacterMap:
    """The compiled character map of a model: a double-array trie over bytes and a pool of replacements."""

    def __init__(self, blob: bytes) -> None:
        if not blob:
            self.units, self.pool = [], b""
            return
        (n,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
        self.pool = blob[4 + n:]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest prefix of ``raw[at:]`` with a replacement: its bytes and the replacement."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        pos = step(units[0])
        for i in range(at, len(raw)):
            pos ^= raw[i]
            if pos >= len(units) or units[pos] & 0x800000FF != raw[i]:
                break
            unit = units[pos]
            pos ^= step(unit)
            if unit & (1 << 8):
                value = units[pos] & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value:self.pool.index(b"\0", value)])
        return found


def _normalized_with_map(raw: bytes, table: CharacterMap) -> tuple[bytes, np.ndarray]:
    out, places, at = [], [], 0
    while at < len(raw):
        hit = table.longest(raw, at)
        if hit is None:
            n = 1
            while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                n += 1
            out.append(raw[at:at + n])
            places.extend(range(at, at + n))
        else:
            n, new = hit
            out.append(new)
            places.extend([at] * len(new))
        at += n
    return b"".join(out), np.array([*places, len(raw)], np.int64)


def normalize_with_alignment(text: str, table: CharacterMap, dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True) -> tuple[str, np.ndarray]:
    """The normalised text and, for each of its bytes and its end, the original byte it stems from.

    At each place the longest prefix with an entry in the character map is replaced, else one character is
    kept. Then blanks are squeezed if asked, a blank is put in front, and blanks become U+2581.
    """
    raw = text.encode()
    if table.units:
        body, places = _normalized_with_map(raw, table)
    else:
        body, places = raw, np.arange(len(raw) + 1)
    data = np.frombuffer(body, np.uint8)
    if squeeze:
        blank = data == 32
        keep = ~(blank & np.concatenate(([True], blank[:-1])))
        while len(keep) and keep.any() and blank[last := np.flatnonzero(keep)[-1]]:
            keep[last] = False
        data, places = data[keep], np.concatenate((places[:-1][keep], places[-1:]))
    if not len(data):
        return "", places[-1:]
    if dummy_prefix:
        data, places = np.concatenate((np.array([32], np.uint8), data)), np.concatenate((places[:1], places))
    if escape:
        places = np.repeat(places, np.concatenate((np.where(data == 32, 3, 1), [1])))
    normal = data.tobytes().decode()
    return (normal.replace(" ", BLANK) if escape else normal), places


class Encoded:
    """Ids of one text; spans are read from the normaliser's alignment when asked for."""

    def __init__(self, text: str, parts: list[tuple], codec: Codec) -> None:
        self.text, self.parts, self.codec = text, parts, codec
        self._ids, self._decimals, self._sizes = zip(*parts) if parts else ((), (), ())

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(self._ids))

    def joined(self) -> str:
        return ",".join(filter(None, self._decimals))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 original byte of each piece; a blank put in front has an empty span."""
        ends = np.cumsum(np.frombuffer(b"".join(self._sizes), np.uint32), dtype=np.int64)
        _, places = self.codec.normalized(self.text)
        if (int(ends[-1]) if len(ends) else 0) != len(places) - 1:
            raise ValueError("pieces do not cover the normalised text")
        ends = places[ends]
        return np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1])), ends

    def decoded(self) -> str:
        return self.codec.library.decode(self.ids)


class Codec:
    """The library's model with its normaliser's alignment; ids by chunk are kept up to a bound."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        self.table = CharacterMap(spec.precompiled_charsmap)
        self.options = (spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.sizes = [1 if self.library.is_byte(i) else len(x.encode()) for i, x in enumerate(pieces)]
        self.numbers = list(range(len(pieces)))  # shared by all kept entries
        self.unknown = self.library.unk_id()
        self.blank = self.library.piece_to_id(BLANK)
        crosses = any(re.search(f"[^{BLANK}]{BLANK}|\n.", x) for x in pieces)
        # chunks are safe for plain models whose pieces hold blanks in front only
        self.splits = not self.table.units and self.options == (True, False, True) and not crosses and "\n" not in pieces and self.blank != self.unknown and self.library.is_byte(self.library.piece_to_id("<0x0A>"))
        self.known: dict[str, tuple] = {}
        self.held = 0

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        return normalize_with_alignment(text, self.table, *self.options)

    def entry(self, ids: list[int], text: str) -> tuple:
        """Ids, their decimals, and how many bytes of the normalised text each covers."""
        if self.unknown in ids:
            sizes = [len(p.piece.encode()) if p.id == self.unknown else self.sizes[p.id] for p in self.library.encode(text, out_type="immutable_proto").pieces]
        else:
            sizes = [self.sizes[i] for i in ids]
        return ids, ",".join(map(str, ids)), array("I", sizes).tobytes()

    def chunk_entry(self, ids: list[int]) -> tuple:
        """The same for a chunk of a plain model, where ids are shared by all kept entries."""
        own, numbers = self.sizes, self.numbers
        ids = [numbers[i] for i in ids]
        return ids, ",".join(map(str, ids)), array("I", [own[i] for i in ids]).tobytes()

    def learn(self, fresh: list[str]) -> None:
        """A chunk that begins with a blank is encoded without it (the library puts one in front); one that
        begins with a line feed loses the blank that the library puts in front."""
        sent = [x[1:] if x[0] == " " else x for x in fresh]
        for chunk, ids in zip(fresh, self.library.encode(sent, num_threads=1)):
            if chunk == " ":
                ids = [self.blank]
            elif chunk[0] == "\n":
                ids = ids[1:]
            self.known[chunk] = self.chunk_entry(ids)
            self.held += len(chunk)

    def encode(self, texts: list[str]) -> list[Encoded]:
        each = [_CHUNK.findall(" " + x) if self.splits and x and BLANK not in x else None for x in texts]
        found = [list(map(self.known.get, chunks)) if chunks else None for chunks in each]
        fresh = {c for chunks, parts in zip(each, found) if parts and None in parts for c, p in zip(chunks, parts) if p is None}
        if len(self.known) + len(fresh) > KEPT_CHUNKS or self.held > KEPT_CHARS:
            self.known, self.held = {}, 0
            fresh = {c for chunks in each if chunks for c in chunks}
            found = [[None] * len(chunks) if chunks else None for chunks in each]
        self.learn(list(fresh))
        out = []
        for x, chunks, parts in zip(texts, each, found):
            if parts and None in parts:
                parts = [p or self.known[c] for c, p in zip(chunks, parts)]
            out.append(Encoded(x, parts or ([self.entry(self.library.encode(x), x)] if x else []), self))
        return out


_CODECS: dict[str, Codec] = {}
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def whole_result(x: Encoded) -> dict:
    begins, ends = x.spans()
    return {"ids": x.ids, "begins": begins.tolist(), "ends": ends.tolist(), "decoded": x.decoded()}


def digests(x: Encoded) -> dict:
    """Numbers and hashes derived from the ids, spans and the decoded text."""
    ids, (begins, ends) = x.ids, x.spans()
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(x.joined().encode()).hexdigest(), "decoded_sha256": hashlib.sha256(x.codec.library.decode(ids).encode()).hexdigest(), "covered_bytes": int((ends - begins).sum())}


WHOLE = {"ids": "array<int>", "begins": "array<bigint>", "ends": "array<bigint>", "decoded": "string"}
DIGESTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "covered_bytes": "bigint"}


def encode_documents(docs: DataFrame, model: str, result: Callable[[Encoded], dict] = whole_result, columns: dict[str, str] = WHOLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts as the library does, without begin or end ids, and decode the ids again.

    ``result`` turns each encoded text into the output columns: by default the ids, the original byte span
    of every piece and the decoded text; ``digests`` gives hashes of these instead, so that they need not
    leave the worker. Texts are handled by groups of about GROUP_BYTES, very long ones alone. Null texts are empty and have no ids; null and repeated ids pass through; an empty
    table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _CODECS:
            _CODECS[model] = Codec(model)
        own = _CODECS[model]
        for batch in batches:
            for a, b in byte_groups(batch, "text", GROUP_BYTES):
                rows = [result(x) for x in own.encode([x or "" for x in batch.column("text").slice(a, b - a).to_pylist()])]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *[pa.array([r[c] for r in rows], _KINDS[k]) for c, k in columns.items()]], ["doc_id", *columns])

    schema = "doc_id long, " + ", ".join(f"{c} {k}" for c, k in columns.items())
    return map_batches(docs.selectExpr(f"cast({doc_id} as long) as doc_id", f"{text} as text"), run, schema)
