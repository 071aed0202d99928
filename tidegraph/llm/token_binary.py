"""Token-id shards compressed by pair replacement (a grammar), with random-access decoding."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import byte_groups, map_batches, materialize, partitions_for, total_bytes

MAGIC = b"TGRP0002"
HEAD = struct.Struct("<8sIIQQII")
GROUP_BYTES = 2 << 20
SEGMENT_TOKENS = 2_000_000
PARTITION_BYTES = 32 << 20
#: Words kept by a worker, and bytes of words after which it begins anew.
KEPT_WORDS, KEPT_BYTES = 900_000, 24 << 20
MARK = "\x01"
#: Marks that may end a word and that no contraction begins with.
TAIL = ".,;:!?|"
#: Pieces of up to eight bytes are found by these bytes as a number, in a table of this many slots (a power of two).
SLOTS = 20
#: Words that the library encodes in one call where it marks their ends itself.
ENDED = 2_000
#: Ends a document between encoder and grammar; no id is as large.
END = 0xFFFFFFFF
RULES_A_ROUND, LEAST_COUNT = 8192, 8
#: Up to as many plain ids, symbols are 16 bits wide and rules take the rest; beyond, 32 bits.
NARROW = 61_440


def gather(starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pool's slices number ``at``, one after another."""
    n = sizes[at]
    ends = np.cumsum(n)
    if not len(ends):
        return pool[:0]
    where = np.repeat(starts[at] - (ends - n), n)
    where += np.arange(len(where), dtype=where.dtype)
    return pool[where]


def symbol_kinds(first: int) -> tuple[type, type]:
    """The integers that hold a symbol and a pair of them, for ``first`` plain ids."""
    return (np.uint16, np.uint32) if first <= NARROW else (np.uint32, np.uint64)


def _slots(pairs: np.ndarray) -> np.ndarray:
    """20 bits of a product hash of pairs."""
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(2654435761)) >> np.uint32(12)
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def compress(seq: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Replace frequent pairs by new symbols from ``first`` on, in rounds over the whole sequence.

    The largest integer ends documents; no pair holds it, so documents begin at symbols. In a round all
    pairs are counted, up to RULES_A_ROUND of the most frequent get symbols (of those that share a slot the
    most frequent one; the others wait for the next round), and overlapping occurrences are taken from the
    left. It ends when no pair stands LEAST_COUNT times, below which a rule takes more room than it saves,
    or when the symbols run out. Returns the symbols, the sides of the rules, and the rules of each round.
    """
    kind, wide = symbol_kinds(first)
    end, bits = np.iinfo(kind).max, wide(8 * np.dtype(kind).itemsize)
    seq = seq.astype(kind)
    left, right, sizes = [], [], []
    symbol = first
    while len(seq) > 1 and symbol < end:
        usable = (seq[:-1] != end) & (seq[1:] != end)
        codes = (seq[:-1].astype(wide) << bits) | seq[1:]
        ordered = np.sort(codes[usable])
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(1, np.int64)
        counts = np.diff(edges)
        often = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(often):
            break
        room = min(RULES_A_ROUND, end - symbol)
        if len(often) > room:
            often = often[np.argpartition(counts[often], len(often) - room)[-room:]]
        often = often[np.argsort(counts[often], kind="stable")]
        pairs = ordered[edges[often]]
        own = _slots(pairs)
        table = np.full(1 << 20, np.iinfo(wide).max, wide)
        table[own] = pairs  # a later one is more frequent
        pairs = pairs[table[own] == pairs][::-1]
        names = np.zeros(1 << 20, kind)
        names[_slots(pairs)] = np.arange(symbol, symbol + len(pairs))
        slots = _slots(codes)
        hits = np.flatnonzero((table[slots] == codes) & usable)
        runs = np.concatenate(([True], np.diff(hits) != 1))
        begun = np.flatnonzero(runs)[np.cumsum(runs) - 1]
        taken = hits[(np.arange(len(hits)) - begun) % 2 == 0]
        seq[taken] = names[slots[taken]]
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        seq = seq[keep]
        left.append((pairs >> bits).astype(kind))
        right.append(pairs.astype(kind))
        sizes.append(len(pairs))
        symbol += len(pairs)
    none = np.zeros(0, kind)
    return seq, np.concatenate([none, *left]), np.concatenate([none, *right]), sizes


class Grammar:
    """Expansions of all symbols: the plain ids and, round by round, the rules."""

    def __init__(self, first: int, left: np.ndarray, right: np.ndarray, sizes: list[int]) -> None:
        self.starts = np.arange(first, dtype=np.int64)
        self.sizes = np.ones(first, np.int64)
        self.pool = np.arange(first, dtype=left.dtype)
        at = 0
        for n in sizes:
            both = np.column_stack((left[at:at + n], right[at:at + n])).ravel().astype(np.int64)
            grown = gather(self.starts, self.sizes, self.pool, both)
            size = self.sizes[both].reshape(-1, 2).sum(1)
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(size) - size))
            self.sizes = np.concatenate((self.sizes, size))
            self.pool = np.concatenate((self.pool, grown))
            at += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return gather(self.starts, self.sizes, self.pool, symbols.astype(np.int64))


def write_segment(doc_ids: list[int | None], tokens: np.ndarray, first: int, end_id: int) -> bytes:
    """One segment in the file format: head, rules a round, null flags, ids, symbol offsets of the documents,
    rules, expansion lengths, symbols, checksum.

    ``tokens`` ends every document with END, which stands for ``end_id``.
    """
    symbols, left, right, sizes = compress(tokens, first)
    ends = np.flatnonzero(symbols == np.iinfo(symbols.dtype).max)
    symbols[ends] = end_id
    lengths = Grammar(first, left, right, sizes).sizes[first:].astype("<u4")
    ids = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, len(doc_ids), first, len(tokens), len(symbols), len(left), len(sizes))
    body = b"".join([head, np.array(sizes, "<u4").tobytes(), nulls.tobytes(), ids.tobytes(), (ends + 1).astype("<u8").tobytes(), left.tobytes(), right.tobytes(), lengths.tobytes(), symbols.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A segment read back; documents, or any stretch of ids, can be decoded alone."""

    def __init__(self, stored: bytes) -> None:
        if zlib.crc32(memoryview(stored)[:-4]) != struct.unpack("<I", stored[-4:])[0] or stored[:8] != MAGIC:
            raise ValueError("damaged token segment")
        _, docs, first, self.n_tokens, n_symbols, rules, rounds = HEAD.unpack_from(stored)
        at = HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(stored, kind, n, at)
            at += out.nbytes
            return out

        kind = np.dtype(symbol_kinds(first)[0]).newbyteorder("<").str
        sizes = take(rounds, "<u4").tolist()
        nulls, ids = take(docs, "u1"), take(docs, "<i8")
        self.doc_ids = [None if x else int(y) for x, y in zip(nulls, ids)]
        self.symbol_ends = take(docs, "<u8").astype(np.int64)
        left, right = take(rules, kind), take(rules, kind)
        lengths = np.concatenate((np.ones(first, np.int64), take(rules, "<u4")))
        self.symbols = take(n_symbols, kind)
        #: Ids up to and with each symbol, from the stored expansion lengths.
        self.offsets = np.cumsum(lengths[self.symbols])
        self.token_ends = self.offsets[self.symbol_ends - 1]
        if (int(self.offsets[-1]) if n_symbols else 0) != self.n_tokens:
            raise ValueError("expansion lengths do not give the number of ids")
        self.grammar = Grammar(first, left, right, sizes)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, its end id included."""
        return self.grammar.expand(self.symbols[self.symbol_ends[i - 1] if i else 0:self.symbol_ends[i]])

    def stretch(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` - 1 of the segment; only the symbols that hold them are expanded."""
        begin, end = max(0, begin), min(end, self.n_tokens)
        if begin >= end:
            return self.symbols[:0]
        a = int(np.searchsorted(self.offsets, begin, side="right"))
        b = int(np.searchsorted(self.offsets, end - 1, side="right"))
        before = int(self.offsets[a - 1]) if a else 0
        return self.grammar.expand(self.symbols[a:b + 1])[begin - before:end - before]

    def tokens(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)


def byte_level_alphabet() -> dict[int, int]:
    """Byte-level tokenizers write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: b for b in same} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LEVEL = {b: x for b, x in byte_level_alphabet().items() if b != 32}
_NONE = (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _settled(text: str) -> bool:
    """Whether lowering and composing leave the text as it is."""
    return text.isascii() and text == text.lower() or text == text.lower() and "\u03c2" not in text and unicodedata.is_normalized("NFC", text)


def _edges(*apart: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a piece begins, and whether one ends, between bytes of two kinds (8 * the former + the latter):
    at blanks (0), and between the kinds that are ``apart``."""
    begins, ends = np.zeros((8, 8), bool), np.zeros((8, 8), bool)
    begins[0, 1:] = ends[1:, 0] = True
    for x, y in apart:
        begins[x, y] = ends[x, y] = True
    return begins.ravel(), ends.ravel()


#: Blanks, other bytes, ASCII letters, digits, and marks other than the apostrophe, which may begin a contraction.
_BLANK, _OTHER, _LETTER, _DIGIT, _PUNCT = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[32, *range(9, 14)]] = _BLANK
for _kind, _bytes in ((_LETTER, range(65, 91)), (_LETTER, range(97, 123)), (_DIGIT, range(48, 58)), (_PUNCT, b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')):
    _KINDS[list(_bytes)] = _kind
_BY_BLANKS = _edges()
_BY_KINDS = _edges((_LETTER, _DIGIT), (_DIGIT, _LETTER), (_LETTER, _PUNCT), (_PUNCT, _LETTER), (_DIGIT, _PUNCT), (_PUNCT, _DIGIT), (_DIGIT, _DIGIT))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Places(dict):
    """Numbers of pieces in the order in which they are first asked for."""

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        return n


def _joined(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each], np.int64)


class WordEncoder:
    """Ids by white-space separated word, for tokenizers that always part words there and keep no white space.

    The library encodes many new words in one string, each followed by a mark that words do not hold, and the
    ids are cut at the marks; words of letters need none where the model ends words with ids of their own. Where
    the pre-tokenizer parts ASCII letters, digits and marks, they are parted here, and the pieces take the words'
    place. Words are kept between batches up to a bound in number and in bytes. ASCII letters are lowered first, as the tokenizer would do, unless the text may hold
    the spelling of a special token. Files with other steps than those known here raise ValueError.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.library.to_str())
        self.check(spec)
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.mark = self.whole([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the mark between words must be one token")
        letters_apart = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        known = [x for x in self.flat(spec["pre_tokenizer"]) if x["type"] == "Split"]
        self.letters = None
        if len(known) == 1 and known[0]["pattern"].get("Regex", "").endswith(letters_apart):
            alone = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.letters = Tokenizer.from_str(json.dumps(alone))
        replaced = [(x["pattern"], x["content"]) for x in self.flat(spec["normalizer"]) if x["type"] == "Replace"]
        contractions = "'s|'t|'re|'ve|'m|'ll|'d|"
        parts = self.letters is not None and known[0]["pattern"]["Regex"] in (letters_apart, contractions + letters_apart) and all(x == ({"Regex": r"\s+"}, " ") for x in replaced)
        self.edges = _BY_KINDS if parts else _BY_BLANKS
        suffix, words = spec["model"].get("end_of_word_suffix"), self.library.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(words.values()) + 1, bool)
        self.final[[i for x, i in words.items() if suffix and x.endswith(suffix)]] = True
        self.specials = [x["content"].lower().encode() for x in spec["added_tokens"]]
        self.begin()

    def check(self, spec: dict) -> None:
        """Refuse tokenizers whose ids of a text are not those of its words."""
        steps = [x for k in ("normalizer", "pre_tokenizer") for x in self.flat(spec[k])]
        kinds = {x["type"] for x in steps}
        removed = [x for x in steps if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and r"[^\s" in x["pattern"].get("Regex", "")]
        plain = all(not x.get("add_prefix_space") for x in steps if x["type"] == "ByteLevel")
        inner = any(any(y.isspace() for y in x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        if not kinds <= {"NFC", "Replace", "Lowercase", "Split", "ByteLevel"} or not removed or not plain or inner:
            raise ValueError("this tokenizer may join or keep white space between words")

    def flat(self, step: dict | None) -> list[dict]:
        inner = [x for k in ("normalizers", "pretokenizers") for x in (step or {}).get(k, [])]
        return [y for x in inner for y in self.flat(x)] if inner else [step] if step else []

    def begin(self) -> None:
        self.known = Places({None: 0})
        self.keys, self.at = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        self.pool, self.starts, self.sizes = np.array([END], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.held = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def marked(self, library, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without the mark, from one call of the library, and how many each has."""
        ids = np.array(library.encode_batch_fast([f" {MARK} ".join([*words, ""]) if library is self.library else self.bytes_as_letters(f" {MARK} ".join([*words, ""]))], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.mark[0])
        if len(ends) != len(words):
            raise ValueError("words and marks do not part")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def ended(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``marked`` for words of letters, without marks where each word's last id ends a word."""
        pools, sizes = [], []
        for i in range(0, len(words), ENDED):
            part = words[i:i + ENDED]
            ids = np.array(self.letters.encode_batch_fast([self.bytes_as_letters(" ".join(part))], add_special_tokens=False)[0].ids, np.uint32)
            n = np.diff(np.flatnonzero(self.final[ids]), prepend=-1)
            if len(n) != len(part) or n.sum() != len(ids):
                ids, n = self.marked(self.letters, part)
            pools.append(ids)
            sizes.append(n)
        return np.concatenate(pools), np.concatenate(sizes)

    def bytes_as_letters(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(_BYTE_LEVEL)

    def fresh_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and how many each has.

        Where the pre-tokenizer parts letters from marks, a word of letters that the normaliser leaves alone,
        then marks, has the ids of both, and the letters need no step before the model. All others take
        every step.
        """
        stems = [w.rstrip(TAIL) for w in words]
        plain = [self.letters is not None and x.isalpha() for x in stems]
        low = _settled(" ".join([x for x, p in zip(stems, plain) if p and x.isascii()]))
        plain = [p and (low and x.isascii() or _settled(x)) for x, p in zip(stems, plain)]
        own = {x: i for i, x in enumerate(dict.fromkeys(x for x, p in zip(stems, plain) if p))}
        tails = [w[len(x):] for w, x in zip(words, stems)]
        ends = {x: i + len(own) for i, x in enumerate(dict.fromkeys(t for t, p in zip(tails, plain) if p))}
        odd = {w: i + len(own) + len(ends) for i, w in enumerate(w for w, p in zip(words, plain) if not p and MARK in w)}
        rest = {w: i + len(own) + len(ends) + len(odd) for i, w in enumerate(w for w, p in zip(words, plain) if not p and MARK not in w)}
        pools, sizes = [], []
        for ids, n in (self.ended(list(own)) if own else _NONE, _joined(self.whole(list(ends))), _joined(self.whole(list(odd))), self.marked(self.library, list(rest)) if rest else _NONE):
            pools.append(ids)
            sizes.append(n)
        pool, size = np.concatenate(pools), np.concatenate(sizes)
        nothing = len(size)  # a piece without ids
        size = np.append(size, 0)
        at = np.fromiter((i for w, x, t, p in zip(words, stems, tails, plain) for i in ((own[x], ends[t]) if p else (odd[w] if w in odd else rest[w], nothing))), np.int64, 2 * len(words))
        return gather(np.cumsum(size) - size, size, pool, at), size[at].reshape(-1, 2).sum(1)

    def learn(self, fresh: list[bytes]) -> None:
        pools, sizes = [self.pool], [self.sizes]
        for i in range(0, len(fresh), 20_000):
            part = fresh[i:i + 20_000]
            ids, n = self.fresh_ids(b"\n".join(part).decode().split("\n"))
            self.held += sum(map(len, part))
            pools.append(ids)
            sizes.append(n)
        self.pool, self.sizes = np.concatenate(pools), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def places(self, raw: bytes, edges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the pool of the pieces of ``raw``, and where they begin; pieces not seen before are learned."""
        data = np.frombuffer(raw + bytes(8), np.uint8)
        kinds = np.zeros(len(raw) + 2, np.uint8)
        kinds[1:-1] = _KINDS[data[:len(raw)]]
        between = kinds[:-1] * 8 + kinds[1:]
        begins, ends = (np.flatnonzero(x[between]) for x in edges)
        sizes = ends - begins
        # of up to eight bytes without a zero: the bytes as a number
        keys = np.lib.stride_tricks.as_strided(data, (len(raw) + 1, 8), (1, 1))[begins].view(np.uint64).ravel() & _FIRST_BYTES[np.minimum(sizes, 8)]
        short = sizes <= (0 if b"\0" in raw else 8)
        slots = (keys * _ODD) >> np.uint64(64 - SLOTS)
        out = np.where(short & (self.keys[slots] == keys), self.at[slots], -1).astype(np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            before = len(self.known)
            out[missing] = np.fromiter(map(self.known.__getitem__, [raw[a:b] for a, b in zip(begins[missing].tolist(), ends[missing].tolist())]), np.int64, len(missing))
            if len(self.known) > before:
                self.learn(list(islice(reversed(self.known), len(self.known) - before))[::-1])
            own = missing[short[missing]]
            own = own[self.keys[slots[own]] == 0]
            self.keys[slots[own]] = keys[own]
            own = own[self.keys[slots[own]] == keys[own]]
            self.at[slots[own]] = out[own]
        return out, begins

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """Ids of the texts, END after each."""
        if len(self.known) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.begin()
        raws = [(x or "").encode() for x in texts]
        lows = [x.lower() for x in raws] if self.lowers else raws
        joined, edges = b"\n".join(lows), self.edges
        if any(y in joined for y in self.specials):
            lows = [x if any(y in low for y in self.specials) else low for x, low in zip(raws, lows)]
            joined, edges = b"\n".join(lows), _BY_BLANKS
        at, begins = self.places(joined, edges)
        ends = np.searchsorted(begins, np.cumsum([len(x) + 1 for x in lows]))
        return gather(self.starts, self.sizes, self.pool, np.insert(at, ends, 0))


_ENCODERS: dict[str, WordEncoder] = {}


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Encode all texts in ascending id order and store them as segments in the shared scratch folder.

    Documents are range partitioned by id (null first) and sorted; each partition becomes segments of about
    two million ids, each with a grammar of its own. Null texts are empty and keep only the end id; repeated
    ids stay together. Returns the stored table: part, segment, start (ids before it in its part), n_docs,
    n_tokens, content.
    """
    slim = docs.selectExpr(f"cast({doc_id} as long) as doc_id", f"{text} as text")
    parts = partitions_for(total_bytes(slim, "text"), partition_bytes)
    ordered = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        own, part = _ENCODERS[tokenizer], TaskContext.get().partitionId()
        ids, tokens, held, start, number = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, tokens, held, start, number
            content = write_segment(ids, np.concatenate(tokens), own.vocabulary, end_id)
            out = pa.record_batch([pa.array([x], k) for x, k in ((part, pa.int32()), (number, pa.int32()), (start, pa.int64()), (len(ids), pa.int64()), (held, pa.int64()), (content, pa.binary()))], ["part", "segment", "start", "n_docs", "n_tokens", "content"])
            ids, tokens, start, held, number = [], [], start + held, 0, number + 1
            return out

        for batch in batches:
            for a, b in byte_groups(batch, "text", GROUP_BYTES):
                tokens.append(own.encode(batch.column("text").slice(a, b - a).to_pylist()))
                ids += batch.column("doc_id").slice(a, b - a).to_pylist()
                held += len(tokens[-1])
                if held >= SEGMENT_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return materialize(map_batches(ordered, run, "part int, segment int, start long, n_docs long, n_tokens long, content binary"), "token-segments")


def read_shards(stored: DataFrame) -> DataFrame:
    """Decode stored segments: doc_id, part, start (within its part), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, content in zip(*(batch.column(x) for x in ("part", "start", "content"))):
                seg = Segment(content.as_py())
                ids = memoryview(seg.tokens().astype("<u4")).cast("B")
                ends = seg.token_ends
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                sums = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.record_batch([pa.array(seg.doc_ids, pa.int64()), pa.array([part.as_py()] * n, pa.int32()), pa.array(begins + start.as_py(), pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    return map_batches(stored.select("part", "start", "content"), run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")


def token_index(stored: DataFrame) -> DataFrame:
    """One row a document from the stored segments: doc_id, start over the whole corpus, n_tokens, ids_crc32.

    Starts are sums at two levels: within a part they are stored; the parts' offsets come from one running
    sum over a row for each part. An empty table gives an empty result.
    """
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = materialize(sums.select("part", (F.sum("n").over(run) - F.col("n")).alias("before")), "token-parts")
    return read_shards(stored).join(parts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
