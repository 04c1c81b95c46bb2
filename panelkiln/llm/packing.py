"""Operator 8, packing token sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from panelkiln.llm.pieces import chunks
from panelkiln.llm.shared import cut, small_batches, table

#: Chunks whose ids a worker remembers; it starts anew beyond.
REMEMBERED = 800_000
#: Rows of one length are ranked in so many parts each, so that a hot length doesn't meet in one task.
SALTS = 64


class Ids:
    """Ids of whole texts by the tokenizers library, each distinct part of text encoded once while remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        #: Whether a token starts with a space, which the vocabulary writes as U+0120.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts, each with the space before it. Those without spaces inside go together: as one text, parted again at the tokens that start with a space."""
        plain = [x for x in parts if x and " " not in x and not x[0].isspace() and not x[-1].isspace()]
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = self._encode(" " + " ".join(some))
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):
                plain = plain[:i]
                break
            data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            self.known.update(zip(some, [data[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)], strict=True))
        for x in set(parts).difference(plain):
            self.known[x] = self._encode(" " + x).tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 64):
            split = [chunks(x) for x in texts[i : i + 64]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known = self.known
            new: set[str] = set()
            for _, rest in split:
                new.update(filterfalse(known.__contains__, rest))
            if new:
                self._learn(list(new))
            for first, rest in split:
                yield (self._encode(first).tobytes() if first else b"") + b"".join(map(known.__getitem__, rest))


@lru_cache(2)
def load(path: str) -> Ids:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Ids(path)


def cut_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` ids: doc_id, start, length, ids_crc32, doc_tokens (and ids). Full pieces first, then what is left."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = load(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            doc_ids = b["doc_id"].astype("Int64").array
            for k, ids in enumerate(encode(b["text"].tolist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, size):
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_ids[k], at, len(part) // 4, zlib.crc32(part), n, *[part] * with_ids))
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack, how many such packs) that hold all of the histogram.

    Longest lengths are placed first. Each goes to the packs that are shortest so far, if it fits there, a whole count of packs of
    one pattern at once; where none has room, new packs open. At most a few patterns arise for each length, whatever the counts.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, free: int) -> None:
        (room.setdefault(free, []) if free else done).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        grown: list[tuple[tuple[int, ...], int, int]] = []
        while todo:
            free = max(room, default=0)
            if free < length:
                per = size // length  # new packs take as many of this length as fit; one pack takes what is over
                if todo // per:
                    put((length,) * per, todo // per, size - per * length)
                if todo % per:
                    put((length,) * (todo % per), 1, size - (todo % per) * length)
                break
            pattern, count = room[free].pop()
            if not room[free]:
                del room[free]
            taken = min(todo, count)
            if taken < count:
                put(pattern, count - taken, free)
            grown.append(((*pattern, length), taken, free - length))
            todo -= taken
        for pattern, count, free in grown:
            put(pattern, count, free)
    return done + [x for packs in room.values() for x in packs]


SLOTS = T.StructType([T.StructField(x, T.LongType()) for x in ("_length", "_from", "_to", "_first", "_offset")])


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each place in each pattern: its length, the ranks among pieces of that length that it takes, its first sequence and its offset there."""
    used: dict[int, int] = {}
    out, first = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            out.append((length, at, at + count, first, offset))
            used[length] = at + count
            offset += length
        first += count
    return out


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, start and length.

    The histogram of lengths has `size` rows at most, whatever the input; it alone goes to the driver, and the places come
    back as a table whose rows depend on `size`, not on the input. A piece's rank among those of its length comes from
    parts of a length (salts by hash of the document) that are ranked apart and put end to end by their counts.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    counts = cut(salted.groupBy(F.col("length").alias("_len"), F.col("_salt").alias("_part")).agg(F.count(F.lit(1)).alias("_n")))
    patterns = shortest_pack_first({r[0]: r[1] for r in counts.groupBy("_len").agg(F.sum("_n")).collect()}, size)
    before = counts.select("_len", "_part", (F.sum("_n").over(Window.partitionBy("_len").orderBy("_part")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(order) - 1).join(
        F.broadcast(before), (F.col("length") == F.col("_len")) & (F.col("_salt") == F.col("_part"))
    )  # at most size * SALTS rows
    places = spark.createDataFrame(slots_of(patterns), SLOTS)
    rank = F.col("_row") + F.col("_before")
    placed = ranked.withColumn("_rank", rank).join(
        F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    )
    return placed.select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone. Texts are encoded whole; what exceeds `size` is cut into full sequences and one
    rest, and the rests are packed. Ties (equal lengths) are placed by salt, then doc_id; repeated rows each have
    pieces of their own. An empty table gives no rows. Strings of special tokens in a text are ordinary text.
    """
    return pack(cut(cut_documents(docs, tokenizer, size, with_ids=with_ids)), size)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
