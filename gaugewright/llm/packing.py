"""Best-fit packing of token sequences, with large-item matching.

Texts become token ids in one pass that returns a row for each piece (no longer than the capacity).
The packing itself works on the histogram of piece lengths, which has as many entries as the capacity
has tokens, whatever the number of pieces: lengths above a third of the capacity are paired, two in a
sequence at most, longest with the longest that still fits; shorter ones go, in descending order, to
the smallest gap that holds them. The outcome is a list of segments, each giving consecutive ranks of
one length to consecutive sequences. A piece finds its place from its length and its rank there, so no
step needs all pieces of a length together.

Cases: a null text counts as empty and is one piece, of the separator alone; a null identifier stays
null; repeated rows are packed each on their own; further columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.stores import held
from gaugewright.session import materialize

#: Words that a worker remembers the ids of. Others are worked out again each time.
WORDS = 200_000
MARK = "\U0010ffff|next|"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBpe:
    """Ids of the tokenizers library for a byte-level BPE file; special tokens in a text are ordinary text.

    Words between single spaces are remembered. Where white space stands together, the text is encoded whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.mark = max(model["model"]["vocab"].values()) + 1
        self.library = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={MARK: self.mark})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode_ordinary(text)).tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.library.encode(MARK.join(w if w[0] == "\n" else " " + w for w in words), allowed_special={MARK}), dtype="<u4")
        ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        first, *words = text.replace("\n", " \n").split(" ")
        if not words:
            return self.whole(text)
        found = list(map(self.known.get, words))
        if None in found:
            fresh = list({w for w, ids in zip(words, found, strict=True) if ids is None})
            if MARK[0] in text or any(not w or w[-1].isspace() or (w[1:2] if w[0] == "\n" else w[0]).isspace() for w in fresh):
                return self.whole(text)
            now = dict(zip(fresh, self.learn(fresh), strict=True))
            if len(self.known) < WORDS:
                self.known |= {w: i for w, i in now.items() if len(w) < 48}
            found = [now[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        if not first or first[-1].isspace():
            return self.whole(text)
        return b"".join([self.whole(first), *found])


def encoder(path: str) -> ByteBpe:
    """The worker's encoder; the file lies at the same path on every machine."""
    return held(f"packing {path}", lambda: ByteBpe(path))


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: identifier, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    end = array("I", [separator]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = own.encode(text or "") + end
                    stop = (len(raw) // 4) % capacity or capacity
                    start = piece = 0
                    while start < len(raw) // 4:
                        part = raw[4 * start : 4 * stop]
                        rows.append((doc, piece, start, stop - start, zlib.crc32(part), part))
                        start, stop, piece = stop, stop + capacity, piece + 1
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                if with_ids:
                    arrays.append(pa.array([memoryview(p).cast("I").tolist() for p in columns[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, ranks, first sequence, offset) that place all pieces.

    ``counts``: pieces by length, each length from 1 to ``capacity``. The number of segments is bounded by the
    capacity, not by the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    if left and not (1 <= min(left) and max(left) <= capacity):
        raise ValueError("a length is outside 1..capacity")
    used = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    order: list[int] = []  # gaps, ascending
    opened = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    def place(length: int, many: int, first: int, offset: int) -> None:
        segments.append((length, used[length], many, first, offset))
        used[length] += many
        left[length] -= many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            many = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
            first, opened = opened, opened + many
            place(n, many, first, 0)
            if partner is not None:
                place(partner, many, first, n)
            leave(capacity - n - (partner or 0), first, many)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                many = -(-left[n] // (capacity // n))
                leave(capacity, opened, many)
                opened += many
                continue
            gap = order[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // n
            full = min(many, left[n] // each)
            for k in range(each if full else 0):
                place(n, full, first, capacity - gap + k * n)
            leave(gap - each * n, first, full)
            rest = left[n] if full < many and left[n] < each else 0
            for k in range(rest):
                place(n, 1, first + full, capacity - gap + k * n)
            if rest:
                leave(gap - rest * n, first + full, 1)
            leave(gap, first + full + bool(rest), many - full - bool(rest))
    return segments


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    parts = max(16, -(-pieces.count() >> 21))
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)))
    groups = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(place) - 1).join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    segments = np.array(sorted(plan_packing(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(segments)
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            arrays = [batch.column(c) for c in columns] + [pa.array(plan[at, 3] + rank - plan[at, 1]), pa.array(plan[at, 4])]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole texts; a row for each piece with its place."""
    pieces = materialize(cut(docs, tokenizer_path, capacity, separator, id_col=id_col, text_col=text_col, with_ids=with_ids), "packing-pieces")
    return place_pieces(pieces, capacity)
