"""Token counts of whole texts: Arrow batches in, lengths only out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .support import byte_groups, map_batches

GROUP_BYTES = 2 << 20
#: Chunks kept by a worker, and characters of chunks after which it begins anew.
KEPT_CHUNKS, KEPT_CHARS = 600_000, 24 << 20

# A blank or line feed after a character that is no white space begins a new pre-token, whatever stands left of it.
_AMBIGUOUS = re.compile(r"\s[ \n]")
_PLAIN = re.compile(r"[ \n][^ \n]*|[^ \n]+")
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def safe_chunks(text: str) -> list[str]:
    """Split a text where byte-level pre-tokenisation always splits it; joined, the chunks are the text.

    Texts with runs of white space are split before a run only, since a run's last blank belongs to the
    word that follows and its other characters form one pre-token.
    """
    return _SAFE.split(text) if _AMBIGUOUS.search(text) else _PLAIN.findall(text)


class ChunkCounter:
    """Numbers of tokens by chunk, kept between batches of a worker up to a bound and then begun anew."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.held = 0
        if path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in self.library.encode(texts, num_threads=1)]
            self.chunks = lambda text: [text]
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.lengths = lambda texts: [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            self.chunks = safe_chunks

    def count(self, texts: list[str]) -> list[int]:
        each = [self.chunks(x) for x in texts]
        found = [list(map(self.known.get, chunks)) for chunks in each]
        fresh = list({c for chunks, n in zip(each, found) if None in n for c, k in zip(chunks, n) if k is None})
        if len(self.known) + len(fresh) > KEPT_CHUNKS or self.held > KEPT_CHARS:
            self.known, self.held = {}, 0
        for i in range(0, len(fresh), 20_000):
            part = fresh[i:i + 20_000]
            self.known.update(zip(part, self.lengths(part)))
            self.held += sum(map(len, part))
        return [sum(n) if None not in n else sum(self.known[c] if k is None else k for c, k in zip(chunks, n)) for chunks, n in zip(each, found)]


_COUNTERS: dict[str, ChunkCounter] = {}


def counter(path: str) -> ChunkCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = ChunkCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text, as the tokenizer's library counts them without added special tokens.

    Texts are grouped by bytes, not rows; long ones are split at safe boundaries, and the library encodes
    each distinct chunk once. A text without blanks or line feeds is one chunk, whatever its length. The safe boundaries are those of byte-level pre-tokenisation; files ending in
    .model are encoded whole. Null texts count as empty (0 bytes, 0 tokens); null and repeated ids pass
    through; an empty table gives an empty one; other columns are ignored.
    Returns doc_id, n_bytes, n_tokens, over_limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for a, b in byte_groups(batch, "text", GROUP_BYTES):
                texts = [x or "" for x in batch.column("text").slice(a, b - a).to_pylist()]
                n = own.count(texts)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.selectExpr(f"cast({doc_id} as long) as doc_id", f"{text} as text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
