"""Sequence packing: non-negative least squares over length combinations.

Every document is cut into pieces of one whole window and a remainder. Only the
histogram of piece lengths (one count for each length up to the window, so at most 2048
numbers) reaches the driver. There shallow combinations that fill a window are
enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded down, and what is left is packed greedily, longest first,
still on counts. The plan goes back as a table of rank ranges, and a piece
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import cut, given_back, slim

WINDOW = 2048
END_ID = 1
#: Lengths, by number of pieces, of which combinations of three are enumerated; others come in pairs or go to the
#: greedy rest, so this bounds the size of the fit and changes the fill only.
TRIPLE_LENGTHS = 96
#: Bytes of distinct words whose ids a worker keeps, and the longest word it keeps.
CACHE, WORD = 8 << 20, 64

#: Characters for which the plain pattern below cuts exactly as the tokenizer's own.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_ODD = re.compile(f"[^\t\n\x0b\x0c\r -~{_LETTER}¡¿–—‘’“”…]")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


class Encoder:
    """Ids of a public byte-level BPE: words are looked up, unusual texts go to the tokenizer whole."""

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.word = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, word: str) -> bytes:
        ids = np.array(self.word(word), "<u4").tobytes()
        if len(word) <= WORD:
            if self.held > CACHE:
                self.seen.clear()
                self.held = 0
            self.seen[word] = ids
            self.held += 160 + len(word) + len(ids)  # two objects and an entry
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, make = self.seen.get, self._ids
        return b"".join([get(w) or make(w) for w in _WORDS.findall(text)])


def pieces(docs: DataFrame, json_path: str, rank_path: str, pattern: str, window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): whole windows and one remainder for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            encoder = encoder or Encoder(json_path, rank_path, pattern)
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    own = ids[4 * start : 4 * (start + window)]
                    out.append((doc, start, len(own) // 4, zlib.crc32(own), n, *([own] if with_ids else [])))
            columns = list(zip(*out, strict=True)) or [()] * (5 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.binary()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return slim(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(given_back(run), schema)


def combinations(counts: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Combinations of at most three present lengths that fill the window exactly."""
    present = np.flatnonzero(counts)
    have = set(present.tolist())
    pairs = [(window - n, n) for n in present.tolist() if n <= window // 2 and window - n in have]
    common = present[np.argsort(-counts[present], kind="stable")][:TRIPLE_LENGTHS].tolist()
    triples = {tuple(sorted((a, b, window - a - b), reverse=True)) for a in common for b in common if window - a - b in have}
    return pairs + sorted(triples, reverse=True)


def fit_counts(counts: np.ndarray, shapes: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by projected gradients with momentum."""
    if not shapes:
        return np.zeros(0)
    rows = np.concatenate([np.array(s) for s in shapes])
    cols = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    forward = lambda x: np.bincount(rows, x[cols], len(counts))
    back = lambda r: np.bincount(cols, r[rows], len(shapes))
    v = np.ones(len(shapes))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up a histogram of lengths: fitted combinations, then the greedy rest."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(shape: tuple[int, ...], times: int) -> None:
        uses = Counter(shape)
        times = min([times, *(int(left[n]) // m for n, m in uses.items())])
        if times > 0:
            for n, m in uses.items():
                left[n] -= m * times
            out.append((shape, times))

    take((window,), int(left[window]))
    shapes = combinations(left, window)
    fitted = fit_counts(left.astype(float), shapes)
    for i in np.argsort(-fitted, kind="stable"):
        take(shapes[i], int(fitted[i] + 1e-9))
    while left.any():
        rest, space, shape = left.copy(), window, []
        while space and (fits := np.flatnonzero(rest[: space + 1])).size:
            n = int(fits[-1])
            shape.append(n)
            rest[n] -= 1
            space -= n
        take(tuple(shape), int(left.max()))
    return out


def slots(shapes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, uses in each sequence, offset of the first use)."""
    used: Counter = Counter()
    out, sequence = [], 0
    for shape, times in shapes:
        offset = 0
        for n, m in sorted(Counter(shape).items(), reverse=True):
            out.append((n, used[n], used[n] + m * times, sequence, m, offset))
            used[n] += m * times
            offset += m * n
        sequence += times
    return out


def pack(cuts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, start, length, ...).

    Pieces of one sequence lie side by side from offset 0 and fill at most the
    window. Every row of `cuts` comes back once, repeated rows too; an empty
    table gives an empty one. Ranks are counted within salted shares of each
    length, so one very common length is spread over all tasks.
    """
    spark = cuts.sparkSession
    histogram = np.zeros(window + 1, np.int64)
    for r in cuts.groupBy("length").count().collect():  # at most `window` rows
        histogram[r["length"]] = r["count"]
    table = spark.createDataFrame(slots(plan(histogram, window)) or [], "length long, lo long, hi long, first long, uses long, at long")
    share = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cuts.withColumn("_share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(share)))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_share").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "_share").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_own", F.row_number().over(order) - 1).join(offsets, ["length", "_share"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    # the plan has a few rows for each length, whatever the corpus: its size is bounded by the window
    placed = ranked.join(F.broadcast(table), "length").where("_rank >= lo and _rank < hi")
    turn = F.col("_rank") - F.col("lo")
    return placed.withColumns({"sequence_id": F.col("first") + F.floor(turn / F.col("uses")), "offset": F.col("at") + turn % F.col("uses") * F.col("length")}).select(*cuts.columns, "sequence_id", "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packs docs (doc_id, text) with the 50,257-id byte-level BPE into windows of 2048 ids.

    A null or empty text is the single end id. Repeated rows are packed as often
    as they come and a null id is kept; other columns are not read, whatever their
    names. Texts of any length are cut into whole windows and a rest; an empty table gives an empty one.
    """
    import public_tokenizers as public

    cuts = cut(pieces(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN))
    return pack(cuts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
