"""SentencePiece encoding and decoding with a table of each prefix's last token.

For a merge-type (BPE) model, every prefix of a chunk has one last token. It is found from left to
right: an automaton lists the vocabulary's pieces that end at a position, longest first; the first
whose left neighbour (the last token of the prefix before it) is compatible is the one. Two tokens are
compatible if the model's merges, run over their joined characters alone, give the same two tokens.
Ids are then read off backwards. Time is linear in the text, however long a chunk is.

No piece of such a model has a space after another character or a line feed, so texts fall into chunks
at those places and chunks are remembered. Pieces of equal score (runs of spaces) have no order among
themselves, only places; a chunk that begins with two spaces or more is merged step by step.

Cases: a null text is encoded as an empty one, which gives only the begin and end ids; a null
identifier stays null; rows repeated are repeated in the result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.stores import held
from gaugewright.session import bound_batches

SPACE = "▁"
#: Chunks and pairs that a worker remembers. More are worked out again each time.
CHUNKS, PAIRS = 600_000, 400_000


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with the same BPE model."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        kind = model.SentencePiece
        if trained.model_type != trained.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("the codec needs a BPE model without normalisation, with a space before the text")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.piece: list[str] = []
        self.out: list[bytes] = []
        self.byte = [0] * 256
        for i, p in enumerate(model.pieces):
            self.piece.append(p.piece)
            self.out.append(b"")
            if p.type in (kind.NORMAL, kind.USER_DEFINED):
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.out[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value] = i
                self.out[i] = bytes([value])
            elif p.type == kind.UNKNOWN:
                self.out[i] = trained.unk_surface.encode()
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) or any(c not in self.id for c in p) for p in self.id):
            raise ValueError("the codec needs pieces without line feeds and inner spaces, and each character as a piece")
        self.begin, self.end = (array("I", [i]).tobytes() for i in (trained.bos_id, trained.eos_id))
        self.matches = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merge(p) == [i]:  # others can't come out of merges
                self.matches.add_word(p, (i, len(p)))
        self.matches.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, chunk: str) -> list[int]:
        """Ids by the model's merges, one at a time: best score first, then leftmost."""
        n, score = len(chunk), self.score
        symbols: list[str] = list(chunk)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (both := symbols[i] + symbols[j]) in score:
                heapq.heappush(queue, (-score[both], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not symbols[i] or not symbols[j] or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        ids: list[int] = []
        for s in symbols:
            if s:
                ids += [self.id[s]] if s in self.id else [self.byte[b] for b in s.encode()]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(self.piece[left] + self.piece[right]) == [left, right]
        return known

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, as little-endian 32-bit integers."""
        if chunk.startswith(SPACE * 2):
            return array("I", self.merge(chunk)).tobytes()
        last, size = [-1] * len(chunk), [0] * len(chunk)
        compatible = self.compatible
        for end, (token, length) in self.matches.iter(chunk):
            if not size[end]:
                left = last[end - length] if end >= length else -1
                if left < 0 or compatible(left, token):
                    last[end], size[end] = token, length
        ids: list[int] = []
        at = len(chunk) - 1
        while at >= 0:
            if size[at]:
                ids.append(last[at])
                at -= size[at]
            else:  # a character that no piece has
                ids += [self.byte[b] for b in reversed(chunk[at].encode())]
                at -= 1
        ids.reverse()
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, begin and end ids included, as little-endian 32-bit integers."""
        if not text:
            return self.begin + self.end
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            parts, known, make = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", SPACE + text.replace(" ", SPACE)), self.chunks, str
        else:
            parts, known, make = text.replace("\n", " \n").split(" "), self.words, self._chunk
        found = list(map(known.get, parts))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    part = parts[k]
                    ids = found[k] = known.get(part) or self.encode_chunk(make(part))
                    if len(known) < CHUNKS and len(part) < 64:
                        known[part] = ids
        return b"".join([self.begin, *found, self.end])

    @staticmethod
    def _chunk(word: str) -> str:
        return word if word[:1] == "\n" else SPACE + word

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids, without the space put before it."""
        joined = b"".join(map(self.out.__getitem__, memoryview(ids).cast("I").tolist()))
        return joined[1:] if joined[:1] == b" " else joined


def codec(model_path: str) -> PieceCodec:
    """The worker's codec for a model; the file lies at the same path on every machine."""
    return held(f"codec {model_path}", lambda: PieceCodec(model_path))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and ``ids`` (array of int) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in small_batches(batches):
            ids = [memoryview(own.encode(t or "")).cast("I").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Identifier and ``text`` of each array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in small_batches(batches):
            texts = [own.decode(array("I", i or []).tobytes()).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    bound_batches(encoded.sparkSession)
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: identifier, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in small_batches(batches):
            encoded = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in encoded], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in encoded], pa.string()),
                    pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in encoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
