"""Byte-level BPE encoding of a corpus with a public vocabulary file.

A text is split by the vocabulary's pattern; each piece starts as single bytes in a doubly linked list, a heap
holds the merge rank of every neighbouring pair, the lowest rank is merged first and entries made stale by an
earlier merge are skipped. Pieces recur, so each task keeps a bounded memo of piece -> ids.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.session import spread, table

#: The place of the vocabulary files and the pattern that belongs to them.
VOCAB_DIR = os.environ.get("TALKMILL_TOKENIZERS", "/opt/tokenizers")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces remembered by a task before the memo starts anew; bounds memory, never changes ids.
MEMO_PIECES = 200_000
#: Longer pieces aren't remembered.
MEMO_BYTES = 64


class BytePairEncoder:
    """Encoder over a rank file (base64 token and rank a line)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
        self.strings = {rank: tok for tok, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return [ranks[piece]]
        # The symbol that starts at byte i ends before end[i]; before[i] is the start of its left neighbour. 0 marks a symbol that was merged away.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # stale: one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; a null or empty text has none. Strings of special tokens are ordinary text."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= MEMO_BYTES:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def encoder(name: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> BytePairEncoder:
    return BytePairEncoder(f"{vocab_dir}/{name}.tiktoken")


def handed_out(spark: SparkSession, name: str, vocab_dir: str) -> Callable[[], BytePairEncoder]:
    """What makes the encoder in a task: the driver, which alone needs the folder, hands the vocabulary file out once a session."""
    sc, path = spark.sparkContext, os.path.join(vocab_dir, f"{name}.tiktoken")
    given = getattr(sc, "_talkmill_files", set())
    if path not in given:
        sc.addFile(path)
        sc._talkmill_files = given | {path}
    file = os.path.basename(path)
    return lambda: BytePairEncoder(SparkFiles.get(file))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """One row (``id_col``, ``ids``) for each row of ``df``, in one pass without a shuffle.

    Null and empty texts get the empty list, blank ones their tokens; repeated rows are encoded each; null ids
    stay null; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def fn(enc: BytePairEncoder, keys: list, texts: list) -> list:
        ids = [enc.encode(t) for t in texts]
        offsets = [0]
        for x in ids:
            offsets.append(offsets[-1] + len(x))
        flat = pa.array([v for x in ids for v in x], pa.int32())
        return [keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]

    return map_rows(df.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, ids array<int>", fn, handed_out(df.sparkSession, name, vocab_dir))


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", name: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``, the length that :func:`encode_texts` would give; texts don't leave the scan."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def fn(enc: BytePairEncoder, texts: list, *rest: list) -> list:
        return [*rest, [len(enc.encode(t)) for t in texts]]

    return map_rows(df.select(text_col, *keep), f"{kinds}, n_tokens long", fn, handed_out(df.sparkSession, name, vocab_dir))


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
