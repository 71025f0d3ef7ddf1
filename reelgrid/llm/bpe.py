"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Texts are split into pre-tokens by array operations (pretokens.py); each distinct
pre-token is merged once in a worker and then looked up.  Token offsets follow from the
lengths of the tokens, so every encoding can be decoded and located in its text.

The vocabulary is a file of ranks (base64 of the token's bytes, its id), given by folder and
name.  It is sent along with the job for workers that don't have it at that place.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm.pretokens import boundaries

TOKENIZERS = "/opt/tokenizers"
#: Distinct pre-tokens a worker keeps; beyond that it starts anew.
CACHE = 500_000
#: Characters that are encoded together; a longer text is encoded alone, whole.
BLOCK = 1 << 21


class ByteBpe:
    """A byte-level BPE vocabulary: the pair of the lowest rank is merged first."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.lengths = np.zeros(max(self.tokens) + 1, np.int32)
        for i, b in self.tokens.items():
            self.lengths[i] = len(b)
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token; takes n log n steps, so long runs do no harm."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            _, i, j = heapq.heappop(queue)
            if not alive[i] or end[i] >= n or end[end[i]] != j or not alive[end[i]]:
                continue
            k = end[i]
            alive[k] = False
            end[i] = j
            if j < n:
                before[j] = i
                if (r := ranks.get(piece[i : end[j]])) is not None:
                    heapq.heappush(queue, (r, i, end[j]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:j])) is not None:
                heapq.heappush(queue, (r, b, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _known(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        kept = self.kept
        kept[b""] = ()  # separators
        found = list(map(kept.get, pieces))
        if None in found:
            if len(kept) > CACHE:
                kept.clear()
            for i, x in enumerate(found):
                if x is None:
                    p = pieces[i]
                    if (x := kept.get(p)) is None:
                        kept[p] = x = self.merge(p)
                    found[i] = x
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets at which each text's ids begin (one more than texts)."""
        data, offsets, first = boundaries(texts)
        edges = offsets.tolist()
        edges.append(len(data))
        pieces = list(map(data.__getitem__, map(slice, edges, edges[1:])))
        for k in first.tolist():
            pieces[k] = b""
        found = self._known(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.fromiter(chain.from_iterable(found), np.int32, before[-1])
        return ids, np.concatenate([before[first], before[-1:]])

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        return np.diff(self.encode(texts)[1])

    def spans(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each token of one text ends."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; tokens of a cut character become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """A worker's vocabulary, loaded once."""
    return ByteBpe(path)


#: Forms of vocabulary files.
SUFFIXES = (".tiktoken", ".model", ".json")


def ship(spark: SparkSession, folder: str, tokenizer: str) -> str:
    """The path of a tokenizer's file, which is sent along for workers that don't have it there."""
    path = next((p for p in (f"{folder}/{tokenizer}{x}" for x in SUFFIXES) if Path(p).exists()), None)
    if path is None:
        raise FileNotFoundError(f"no file of {tokenizer} in {folder}")
    spark.sparkContext.addFile(path)
    return path


def arrived(path: str) -> str:
    """Where a worker finds a file that was sent along: at its path, else in the job's files."""
    return path if Path(path).exists() else SparkFiles.get(Path(path).name)


def blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[list[str]]:
    """Whole texts in blocks of about size characters; null becomes the empty text."""
    block, held = [], 0
    for t in texts:
        t = t or ""
        if block and held + len(t) > size:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


def encode(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, offsets: bool = False) -> DataFrame:
    """doc_id and ids of each row of docs, with ends (byte offsets of tokens) if asked for.

    One row for each row of docs, repeated ones too.  Null and empty texts have no ids (an
    empty list).  Strings that look like special tokens are ordinary text.  Other columns
    aren't read.
    """
    path = ship(docs.sparkSession, folder, tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(arrived(path))
        for b in batches:
            done = 0
            for block in blocks(b.column("text").to_pylist()):
                ids, at = bpe.encode(block)
                at = pa.array(at.astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(ids))
                cols = [b.column("doc_id").slice(done, len(block)), lists]
                if offsets:
                    total = np.concatenate([[0], np.cumsum(bpe.lengths[ids])])
                    at = np.asarray(at)
                    local = total[1:] - np.repeat(total[at[:-1]], np.diff(at))
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(local.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "ends"][: len(cols)])
                done += len(block)

    schema = f"doc_id {kind}, ids array<int>" + ", ends array<int>" * offsets
    return docs.select("doc_id", "text").mapInArrow(run, schema)
