"""Byte-level BPE over a tree of text halves.

A text longer than a leaf is cut in half; the halves are encoded on their own and joined. A join re-encodes only a window
around the cut. The window grows on either side until it ends at a *settled* place: a letter or digit followed by a space
or line feed. No alternative of the split pattern runs from a non-space into white space, so a match ends there whatever
stands further left or right, and the pattern has no look-behind: tokens outside the window are final.
"""

from __future__ import annotations

import base64
import hashlib
import re

import public_tokenizers
from pyspark.sql import DataFrame

from lanework.llm import _base

SETTLED = re.compile(r"[^\W_][ \n]")
LEAF_CHARS = 4096
FIRST_WINDOW = 32


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBpe:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        ranks = read_ranks(path)
        self.leaf_chars = max(1, leaf_chars)
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.widths = [len(x) for x in self.pieces]

    def encode(self, text: str) -> list[int]:
        return self._range(text, 0, len(text))

    def _range(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._range(text, lo, mid), self._range(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        if SETTLED.match(text, mid - 1, mid + 1):
            return left + right
        start, end = self._settled_before(text, lo, mid), self._settled_after(text, mid, hi)
        keep = self._drop_bytes(reversed(left), len(text[start:mid].encode()))
        skip = self._drop_bytes(right, len(text[mid:end].encode()))
        middle = self._range(text, start, end) if end - start < hi - lo else self.leaf(text[start:end])
        return left[: len(left) - keep] + middle + right[skip:]

    @staticmethod
    def _settled_before(text: str, lo: int, mid: int) -> int:
        width = FIRST_WINDOW
        while True:
            at = max(lo, mid - width)
            last = None
            for last in SETTLED.finditer(text, at, mid):
                pass
            if last is not None:
                return last.start() + 1
            if at == lo:
                return lo
            width *= 2

    @staticmethod
    def _settled_after(text: str, mid: int, hi: int) -> int:
        width = FIRST_WINDOW
        while True:
            to = min(hi, mid + width)
            if found := SETTLED.search(text, mid, to):
                return found.start() + 1
            if to == hi:
                return hi
            width *= 2

    def _drop_bytes(self, ids, n: int) -> int:
        """How many of the ids cover exactly n bytes."""
        count = 0
        for i in ids:
            if n <= 0:
                break
            n -= self.widths[i]
            count += 1
        if n:
            raise ValueError("a settled place is not a token boundary")
        return count

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation is associative: halves decode on their own."""
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.pieces.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row; a null text counts as empty and gives no ids.

    Rows keep their number: equal rows and null ids give equal output rows; an empty table gives an empty result. Other
    columns, of whatever name, are not read.
    """

    def make():
        bpe = TreeBpe(ranks_path, pattern, leaf_chars)

        def one(batch):
            ids = [bpe.encode(x or "") for x in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

        return one

    return _base.map_batches(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), make, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """As encode_documents, but ids and bytes are hashed where they are made: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def make():
        bpe = TreeBpe(ranks_path, pattern, leaf_chars)
        names = [str(i) for i in range(len(bpe.pieces))]

        def one(batch):
            counts, hashes, decoded = [], [], []
            for x in batch.column(1).to_pylist():
                ids = bpe.encode(x or "")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": hashes, "decoded_sha256": decoded}

        return one

    return _base.map_batches(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
