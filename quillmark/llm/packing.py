"""Best-two-fit packing of token sequences.

Lengths are integers up to the capacity, so the packing is decided on their
histogram, which has at most ``capacity`` entries whatever the input: a bin is
filled greedily with the longest piece that fits; then its smallest piece is
replaced by the two unpacked pieces that fill the expanded gap more tightly, if
there are such.  A bin's pattern is repeated while its lengths last, so the plan is
a short list of (pattern, repetitions).  Every piece has a rank among the pieces
of its length; the plan turns length and rank into a sequence and an offset.
Ranks come from prefix counts over (length, bucket), never from one task per length.

Texts are tokenised once, whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.shared import lean, materialize, parts_for

CAPACITY = 1024
END_ID = 2
#: Buckets from here on hold pieces without a position.
_LAST = 1 << 48
#: Rows that four buckets hold on average; pieces of a length are ranked bucket by bucket.
_BUCKET_ROWS = 1_000_000


#: Fixed value: how byte-level tokenizers of this family split a text before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as long as this goes the slower way; shorter texts are not searched for it.
_LONG_SPACE = 100_000
_SPACES = re.compile(rf"\s{{{_LONG_SPACE}}}")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others
    as the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes.

    A byte-level tokenizer whose merged tokens are numbered in the order of the merges is
    one list of ranks, with which tiktoken gives the same ids in less time; others, and
    texts with enormous runs of white space, go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or made.get("normalizer") or model["type"] != "BPE":
            return None
        vocab, letters = model["vocab"], _byte_letters()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or any(c not in letters for token in vocab for c in token):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        """Through the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as ``whole`` gives them."""
        if self.fast is None:
            return [self.whole(t) for t in texts]
        slow = lambda t: len(t) >= _LONG_SPACE and _SPACES.search(t) is not None
        return [self.whole(t) if slow(t) else self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]


@lru_cache(maxsize=2)
def text_tokenizer(path: str) -> TextTokenizer:
    """One for each worker process."""
    return TextTokenizer(path)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True, text_col: str = "text",
    position: Column | None = None,
) -> DataFrame:
    """``doc_id, position, piece, start, length, ids_crc32`` and, with ``keep_ids``, ``ids``."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = text_tokenizer(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids_of = tokenizer.encode([t or "" for t in part.column(2).to_pylist()])
                rows = []
                for doc_id, place, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ids_of, strict=True):
                    ids += end
                    for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, place, k, start, length, zlib.crc32(own), own))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=False)]
                names = ["doc_id", "position", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[6]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, position long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    place = (F.lit(None) if position is None else position).cast("long")
    return docs.select(F.col("doc_id").cast("long"), place.alias("position"), F.col(text_col)).mapInArrow(lean(tokenise), schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used, for ``counts`` pieces per length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while True:
        used = np.zeros(capacity + 1, np.int64)
        pattern, gap = [], capacity
        while gap:
            fits = np.flatnonzero(left[: gap + 1] > used[: gap + 1])
            if not fits.size:
                break
            longest = int(fits[-1])
            pattern.append(longest)
            used[longest] += 1
            gap -= longest
        if not pattern:
            return plan
        smallest = pattern[-1]
        if gap and len(pattern) > 1 and (pair := _best_pair(left - used, smallest, gap + smallest)):
            pattern = pattern[:-1] + list(pair)
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        plan.append((pattern, times))


def _best_pair(left: np.ndarray, over: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (over, room], the longer first."""
    have = np.flatnonzero(left[: room + 1] > 0)
    best, low, high = None, 0, len(have) - 1
    while low <= high:
        a, b = int(have[low]), int(have[high])
        if a + b > room or (low == high and left[a] < 2):
            high -= 1
            continue
        if a + b > over:
            best, over = (b, a), a + b
        low += 1
    return best


class Layout:
    """Where the r-th piece of a length goes, by the plan."""

    #: Length and rank make one sortable number; there are fewer pieces of a length than this.
    _SPAN = 1 << 48

    def __init__(self, plan: list[tuple[list[int], int]]) -> None:
        runs, slots, first = [], [], 0
        taken: dict[int, int] = {}
        for pattern, times in plan:
            at = np.cumsum([0, *pattern[:-1]]).tolist()
            for length in dict.fromkeys(pattern):
                own = [o for o, n in zip(at, pattern, strict=True) if n == length]
                runs.append((length * self._SPAN + taken.get(length, 0), first, len(slots), len(own)))
                slots += own
                taken[length] = taken.get(length, 0) + times * len(own)
            first += times
        self.sequences = first
        self.slots = np.array(slots, np.int64)
        self.starts, self.firsts, self.at, self.per = np.array(sorted(runs), np.int64).reshape(-1, 4).T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset; among pieces of one length, a higher rank never comes in an earlier sequence."""
        at = length * self._SPAN + rank
        run = np.searchsorted(self.starts, at, "right") - 1
        turn, slot = np.divmod(at - self.starts[run], self.per[run])
        return self.firsts[run] + turn, self.slots[self.at[run] + slot]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``doc_id, piece, ..., length`` rows.

    Pieces of one length are ranked by their ``position``, those without one last and
    by a hash; so pieces that come early in training share sequences, and a sequence's
    place in training is that of its pieces.  Rows equal in all are interchangeable.  The plan and its input have at most ``capacity``
    lengths, so the driver and the broadcast hold a fixed size.  An empty table
    gives an empty table.
    """
    pieces = materialize(pieces, "pieces")
    spark = pieces.sparkSession
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = spark.sparkContext.broadcast(Layout(best_two_fit(sizes, capacity)))
    buckets = 4 * parts_for(sum(sizes.values()), _BUCKET_ROWS, spark)
    # Buckets follow the order of the positions; a bucket covers so many positions at most.
    bucket = F.coalesce(F.shiftright("position", 16), _LAST + F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    bucketed = pieces.withColumn("__bucket", bucket)
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")).select(
        F.col("length").alias("__length"), F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__bucket").orderBy("position", "doc_id", "piece")
    ranked = bucketed.withColumn("__inside", F.row_number().over(inside) - 1).join(
        before, (F.col("length") == F.col("__length")) & (F.col("__bucket") == F.col("__b")))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = layout.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    columns = [F.col(c) for c in pieces.columns]
    return ranked.select(*columns, placed("length", F.col("__before") + F.col("__inside")).alias("__at")).select(
        *columns, "__at.sequence_id", "__at.offset")


def file_order() -> Column:
    """Place of a row in a table of Parquet files, in the order in which Spark wrote it.

    Only for a DataFrame that reads the files: a sorted table keeps its order this way,
    although its readers take the files in any.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    return F.shiftleft(F.coalesce(part.try_cast("long"), F.lit(0)), 36) + F.col("_metadata.row_index")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True, text_col: str = "text",
    position: Column | None = None,
) -> DataFrame:
    """Tokenise, end each document with ``END_ID``, cut the longer ones and pack all pieces.

    A null text is the empty one: its document is the end id alone.  Documents of
    up to ``capacity`` ids stay whole; of longer ones only the first piece may be
    shorter than ``capacity``.  Repeated rows are packed once each.  An empty table
    gives an empty table.  Columns other than doc_id and the text, whatever their
    names, are ignored; ``position`` may compute a training position from them.
    """
    return pack(tokenized_pieces(docs, tokenizer_path, capacity, keep_ids, text_col, position), capacity)
