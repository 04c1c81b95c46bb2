"""Operator 10, byte-level BPE encoding and decoding in linear time with an Aho-Corasick automaton."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.pieces import Bounded, Splitter, chunks
from panelkiln.llm.shared import small_batches, table


class ByteBpe:
    """Encodes as merging by ranks would: the whole piece if it is a token, else the lowest-ranked adjacent pair first, leftmost at ties.

    A row of tokens is the result of merging exactly if each adjacent pair of them is: merging the bytes of
    the two alone gives the two again. So the encoder walks from left to right, tries the longest token that the automaton
    finds, steps back to shorter ones where the pair can't stand, and never visits an end position again that has failed:
    linear in the text for a given vocabulary. Whether a pair can stand is memoised, as are the ids of short chunks.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 600_000):
        self.ranks, self.split = ranks, Splitter(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.above = max(self.bytes_of, default=0) + 1
        self.halves: dict[int, tuple[int, int]] = {}  # of the last merge that makes a token
        self.auto = ahocorasick.Automaton()
        for token, rank in ranks.items():
            # Tokens that merging can't reach count only where they are a whole piece.
            if len(token) > 1:
                parts = self._merged(token, 2)
                if len(parts) != 2 or self._merged(token) != [rank]:
                    continue
                self.halves[rank] = (parts[0], parts[1])
            self.auto.add_word(token.decode("latin-1"), (rank, len(token)))
        self.auto.make_automaton()
        self.stands = Bounded(self._stands, cache)
        self.pieces = Bounded(self._ids, cache)
        self.cache = Bounded(self._chunk, cache // 4)

    def _merged(self, piece: bytes, until: int = 1) -> list[int]:
        """Merging by ranks, for the few bytes of a token, until so many parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            found = [(self.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def _stands(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of two tokens gives these two again.

        Undoes the merges of both from the last to the first, as seen from the seam. At each moment the tokens that touch there must not
        have had a merge of their own that came before the one just undone: a lower rank, or the same rank when the undone one is to the right.
        """
        x, y = pair
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        before = self.above
        while True:
            across = ranks.get(bytes_of[x] + bytes_of[y])
            if across is not None and across < before:
                return False
            split_x, split_y = halves.get(x), halves.get(y)
            if split_x and (not split_y or x > y):
                before, x = x, split_x[1]
            elif split_y:
                before, y = y + 1, split_y[0]
            else:
                return True

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._walk(piece) if piece else []

    def _walk(self, piece: bytes) -> list[int]:
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]  # the tokens that start here, shortest first
        stands = self.stands
        for last, found in self.auto.iter(piece.decode("latin-1")):
            starts[last + 1 - found[1]].append(found)
        out: list[int] = []
        left: list[int] = []  # how many choices each token of out has yet
        dead = bytearray(len(piece) + 1)
        at, choice = 0, len(starts[0])
        while at < len(piece):
            found, last = starts[at], out[-1] if out else None
            while choice:
                choice -= 1
                rank, size = found[choice]
                if not dead[at + size] and (last is None or stands[last, rank]):
                    out.append(rank)
                    left.append(choice)
                    at += size
                    choice = len(starts[at]) if at < len(piece) else 0
                    break
            else:
                # No token leads on from here after any row of tokens: those that end here are ruled out.
                dead[at] = 1
                at -= len(self.bytes_of[out.pop()])
                choice = left.pop()
        return out

    def _ids(self, piece: str) -> bytes:
        return np.array(self.piece(piece.encode("utf-8", "replace")), "<u4").tobytes()

    def _chunk(self, part: str) -> bytes:
        """The ids of a part with the space before it."""
        return self._all(" " + part)

    def _all(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[x] for x in self.split(text)])

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        first, rest = chunks(text)
        cache = self.cache
        return self._all(first) + b"".join([cache[x] for x in rest])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
    return ByteBpe(ranks, pattern)


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids where asked for.

    Null text counts as empty and has no ids. Texts are taken whole, however long; repeated rows give repeated results.
    Each row is independent of all others, so nothing shuffles. `vocabulary` is a rank file that every worker can open.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary, pattern)
        for b in batches:
            rows = []
            for text in b["text"]:
                ids = bpe.encode(text)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").astype("int64")) if with_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + with_ids])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, schema)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
