"""Language identification with interpolated Kneser-Ney character models.

One model of order 5 per language, over the characters of lower-cased words with their boundaries.
N-grams of all languages and orders stand in sorted arrays of 64-bit hashes; beside each hash lie, per
language, its discounted probability and its weight as a context. A word's log probabilities are worked
out once per worker and looked up by the word's hash after that. A text's cross-entropy per character
under each language decides; the best one is compared with what most held-back training texts of that language
have, and texts far above that are rejected. What share of the held-back texts the limits themselves reject
is measured and kept with the model. ``score`` is the best language's share of the texts' probabilities, all languages being as likely
beforehand, on the evidence of ``EVIDENCE`` characters at most: without that bound, all but the shortest texts would score 1.

Training takes a bounded sample: about ``per_language`` documents of each language, chosen by a hash of
the identifier; counting and scoring cover whole texts. The model is bounded by the sample, and its
size is checked before it is broadcast.

Cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected; ties go to the
language that sorts first; with no training rows every text is ``und``; a null identifier is never held
out and never trained on; rows repeated are judged alike, and learned from as often as they stand there; a language column with more
than ``LANGUAGES`` values is refused; further columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.hashing import MULTIPLY, STEP, SpanHasher, U, mixed
from gaugewright.llm.stores import held
from gaugewright.session import bound_batches, materialize, temporary

ORDER = 5
#: Rows of each language that are learned from, about.
PER_LANGUAGE = 1500
#: Largest model that is broadcast, in bytes.
MODEL_BYTES = 256 << 20
#: Words whose scores a worker keeps.
WORDS = 500_000
#: Share of held-back texts whose cross-entropy is at most the one that limits start from: a few noisy rows don't move it.
QUANTILE = 0.95
#: Held-back texts that a quantile takes at least.
LEAST_BACK = 20
#: Nats that a text of any length may have beyond its limit: about what a key of 16 letters costs more than words do.
MARGIN = 40.0
#: Characters that the score counts at most.
EVIDENCE = 40.0
#: Distinct values of the language column at most; a model holds a column for each.
LANGUAGES = 2000
#: Characters scanned at once.
SEGMENT = 1 << 20
EDGE, END = 1, 2  # stand before and after each word; no letters have these codes


class Scanner:
    """Finds words (runs of letters) in texts and hashes them without a Python step per word."""

    def __init__(self) -> None:
        self.letter = np.zeros(0x110000, dtype=bool)
        for start in range(0, 0x110000, 0x1000):
            self.letter[start : start + 0x1000] = [chr(c).isalpha() for c in range(start, start + 0x1000)]
        self.hasher = SpanHasher()

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words among character codes."""
        inside = np.zeros(len(codes) + 2, dtype=np.int8)
        inside[1:-1] = self.letter[codes]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return starts, ends, self.hasher.hashes(codes, starts, ends)

    def words(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Segments of the texts: character codes, and of each word its text's number, start, end and hash."""
        parts: list[np.ndarray] = []
        owners: list[int] = []
        held = 0
        space = np.array([32], dtype=np.uint32)

        def close() -> tuple:
            codes = np.concatenate(parts)
            at = np.cumsum([0, *map(len, parts)])
            starts, ends, hashes = self.spans(codes)
            return codes, np.array(owners)[np.searchsorted(at, starts, side="right") - 1], starts, ends, hashes

        for n, text in enumerate(texts):
            codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            while len(codes):
                stop = len(codes)
                if stop > SEGMENT:  # a long text goes on after its last word break in the segment, or the first behind it
                    breaks = np.flatnonzero(~self.letter[codes[:SEGMENT]])
                    rest = np.flatnonzero(~self.letter[codes[SEGMENT:]]) if not len(breaks) else breaks
                    stop = int(breaks[-1]) + 1 if len(breaks) else SEGMENT + int(rest[0]) + 1 if len(rest) else len(codes)
                parts += [codes[:stop], space]
                owners += [n, n]
                held += stop + 1
                codes = codes[stop:]
                if held >= SEGMENT:
                    yield close()
                    parts, owners, held = [], [], 0
        if parts:
            yield close()


def gram_hashes(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the ``order`` characters that end at each of ``at``."""
    h = np.full(len(at), order, dtype=U) * MULTIPLY
    for back in range(order - 1, -1, -1):
        h = mixed(h ^ (codes[at - back].astype(U) * STEP))
    return h


def padded(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another, each with ORDER - 1 edges before and an end after it; the places to predict; the word of each place."""
    lengths = ends - starts
    width = lengths + ORDER
    first = np.cumsum(width) - width
    flat = np.full(int(width.sum()), EDGE, dtype=np.uint32)
    word = np.repeat(np.arange(len(lengths)), lengths)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[first[word] + ORDER - 1 + inner] = codes[starts[word] + inner]
    flat[first + width - 1] = END
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    place = np.arange(int((lengths + 1).sum())) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1) + first[owner] + ORDER - 1
    return flat, place, owner


@dataclass
class Model:
    languages: list[str]
    #: By order 1..ORDER: sorted n-gram hashes, and (n-grams, languages) discounted probabilities and weights as contexts.
    grams: list[np.ndarray]
    direct: list[np.ndarray]
    weight: list[np.ndarray]
    #: Of the empty context.
    start: np.ndarray
    uniform: float
    #: Of each language, the cross-entropy per character beyond which a text is rejected, but for MARGIN.
    limits: np.ndarray | None = None
    #: Share of held-back texts of 40 letters or more that those limits reject; None if there are none.
    false_rejections: float | None = None

    def size(self) -> int:
        return sum(a.nbytes for group in (self.grams, self.direct, self.weight) for a in group)

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural-log probability of each word, its end included, under each language."""
        flat, place, owner = padded(codes, starts, ends)
        p = np.full((len(place), len(self.languages)), self.uniform)
        context = np.broadcast_to(self.start, p.shape)
        for order in range(1, ORDER + 1):
            at = np.searchsorted(self.grams[order - 1], h := gram_hashes(flat, place, order))
            at[at == len(self.grams[order - 1])] = 0
            hit = self.grams[order - 1][at] == h
            p = np.where(hit[:, None], self.direct[order - 1][at], 0.0) + context * p
            if order < ORDER:
                h = gram_hashes(flat, place - 1, order)
                at = np.searchsorted(self.grams[order - 1], h)
                at[at == len(self.grams[order - 1])] = 0
                context = np.where((self.grams[order - 1][at] == h)[:, None], self.weight[order - 1][at], 1.0)
        out = np.zeros((len(starts), len(self.languages)))
        bounds = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(bounds):
            out = np.add.reduceat(np.log(p), bounds, axis=0)
        return out


def language_part(words: list[str], counts: list[int]) -> dict:
    """What one language adds to a model: by order, n-gram hashes with discounted probabilities, and contexts with their weights."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths)
    flat, at, owner = padded(codes, ends - lengths, ends)
    weight = np.array(counts, dtype=np.float64)[owner]
    part: dict = {"letters": np.unique(codes), "grams": {}, "contexts": {}}
    for order in range(ORDER, 0, -1):
        h, where, inverse = np.unique(gram_hashes(flat, at, order), return_index=True, return_inverse=True)
        number, at = np.bincount(inverse, weights=weight), at[where]
        weight = np.ones(len(at))  # lower orders count how many distinct longer n-grams they end
        once, twice = (number == 1).sum(), (number == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        names, inverse = np.unique(gram_hashes(flat, at - 1, order - 1), return_inverse=True)
        total = np.bincount(inverse, weights=number)
        part["grams"][order] = h, (np.maximum(number - discount, 0) / total[inverse]).astype(np.float32)
        part["contexts"][order - 1] = names, (discount * np.bincount(inverse) / total).astype(np.float32)
    return part


def assemble(parts: dict[str, dict]) -> Model:
    """A model of all languages, from the parts of each."""
    languages = sorted(parts)
    if not languages:
        return Model([], [], [], [], np.ones(0), 1.0)
    letters = len(np.unique(np.concatenate([p["letters"] for p in parts.values()])))
    grams, direct, weight = [], [], []
    for order in range(1, ORDER + 1):
        found = [(k, *parts[name]["grams"][order]) for k, name in enumerate(languages)]
        contexts = [(k, *parts[name]["contexts"][order]) for k, name in enumerate(languages)] if order < ORDER else []
        every = np.unique(np.concatenate([h for _, h, _ in found + contexts]))
        d, w = np.zeros((len(every), len(languages)), dtype=np.float32), np.ones((len(every), len(languages)), dtype=np.float32)
        for target, entries in ((d, found), (w, contexts)):
            for k, h, value in entries:
                target[np.searchsorted(every, h), k] = value
        grams.append(every)
        direct.append(d)
        weight.append(w)
    start = np.array([parts[name]["contexts"][0][1][0] for name in languages])
    return Model(languages, grams, direct, weight, start, 1.0 / (letters + 2))


def train_model(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, word, count) rows, words lower-cased and made of letters."""
    by: dict[str, list[tuple[str, int]]] = {}
    for language, word, n in counts:
        by.setdefault(language, []).append((word, n))
    return assemble({k: language_part([w for w, _ in rows], [n for _, n in rows]) for k, rows in by.items()})


def scanner() -> Scanner:
    return held("language words", Scanner)


class Scorer:
    """Scores texts with a model; remembers words."""

    def __init__(self, model: Model):
        self.model, self.scan = model, Scanner()
        self.known = np.zeros(0, dtype=U)
        self.scores = np.zeros((0, len(model.languages)), dtype=np.float32)

    def _words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log probabilities of distinct words, given in order of their hashes."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        hit = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)
        out = np.empty((len(hashes), len(self.model.languages)), dtype=np.float32)
        out[hit] = self.scores[at[hit]]
        for some in np.array_split(np.flatnonzero(~hit), max(1, (~hit).sum() // 20_000)):
            out[some] = self.model.word_scores(codes, starts[some], ends[some])
        if len(self.known) < WORDS and not hit.all():
            place = np.searchsorted(self.known, hashes[~hit])
            self.known, self.scores = np.insert(self.known, place, hashes[~hit]), np.insert(self.scores, place, out[~hit], axis=0)
        return out

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: log probability under each language, and characters scored (letters and word ends)."""
        n = len(self.model.languages)
        sums, chars = np.zeros((len(texts), n)), np.zeros(len(texts))
        for codes, owner, starts, ends, hashes in self.scan.words(texts):
            if not len(starts):
                continue
            names, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            values = self._words(codes, starts[where], ends[where], names)[inverse]
            for k in range(n):
                sums[:, k] += np.bincount(owner, weights=values[:, k], minlength=len(texts))
            chars += np.bincount(owner, weights=ends - starts + 1, minlength=len(texts))
        return sums, chars

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Of each text: language, score from 0 to 1, cross-entropy per character, whether it is rejected."""
        if not self.model.languages:
            return [("und", 0.0, None, True)] * len(texts)
        limits = self.model.limits
        sums, chars = self.totals(texts)
        out: list[tuple[str, float, float | None, bool]] = []
        for row, n in zip(sums, chars, strict=True):
            if not n:
                out.append(("und", 0.0, None, True))
                continue
            entropy = -row / n
            best = int(np.argmin(entropy))
            score = 1.0 / float(np.exp((entropy[best] - entropy) * min(n, EVIDENCE)).sum())
            out.append((self.model.languages[best], min(1.0, max(0.0, score)), float(entropy[best]), limits is not None and bool(entropy[best] > limits[best] + MARGIN / n)))
        return out


def fold(id_col: str):
    """0 to 4, from the CRC-32 of the identifier as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, slack: float = 2.0) -> Model:
    """Learn from rows with a language whose fold isn't 0.

    A tenth of all rows is held back from the counts of a first model; the model that is returned, with the limits of the first, also counts those
    that the sample has. A text is rejected above ``slack`` times the
    QUANTILE of the cross-entropies of those held back of 40 letters or more, by language.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 0))
    sizes = rows.groupBy("_lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"the language column has more than {LANGUAGES} values")
    if not sizes:
        return Model([], [], [], [], np.ones(0), 1.0)
    rates = docs.sparkSession.createDataFrame([(r["_lang"], min(1 << 20, (per_language << 20) // r["count"] + 1)) for r in sizes], "_lang string, _rate long")
    spread = F.xxhash64(F.lit(7), "_id")
    rows = rows.withColumn("_back", F.pmod(F.shiftright(spread, 20), F.lit(10)) == 0)
    sample = rows.join(F.broadcast(rates), "_lang").where(F.pmod(spread, F.lit(1 << 20)) < F.col("_rate"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str, bool], int] = {}

        def out() -> pa.RecordBatch:
            columns = zip(*(([*k, n]) for k, n in counts.items()), strict=True) if counts else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], ["lang", "word", "back", "n"])

        for batch in batches:
            for language, text, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for codes, _, starts, ends, _ in scanner().words([text]):
                    whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                        key = (language, whole[a:b], back)
                        counts[key] = counts.get(key, 0) + 1
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        yield out()

    words = sample.select("_lang", "_text", "_back").mapInArrow(tally, "lang string, word string, back boolean, n long")
    found = words.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("back"), 0).otherwise(F.col("n"))).alias("first"))

    def learn(key: tuple, group: pa.Table) -> pa.Table:
        names, n, first = (group.column(c).to_pylist() for c in ("word", "n", "first"))
        some = [k for k, c in enumerate(first) if c]
        parts = [language_part(names, n), language_part([names[k] for k in some], [first[k] for k in some]) if some else None]
        return pa.table({"lang": [key[0].as_py()], "part": pa.array([pickle.dumps(parts[0])], pa.binary()), "first": pa.array([pickle.dumps(parts[1])], pa.binary())})

    parts = found.groupBy("lang").applyInArrow(learn, "lang string, part binary, first binary").collect()  # a language's words are bounded by its sample
    model = assemble({r["lang"]: pickle.loads(r["part"]) for r in parts})
    first = assemble({r["lang"]: part for r in parts if (part := pickle.loads(r["first"]))})
    if not model.languages:
        return model
    back = rows.where("_back").select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"))
    with temporary():
        chars = F.length(F.regexp_replace("text", r"\P{L}", ""))
        scored = materialize(apply(back.where(chars >= 40), first).select("lang_pred", "entropy"), "language-held-back")
        model.limits = limits(scored, slack, model)
        model.false_rejections = false_rejections(scored, model)
    return model


def false_rejections(scored: DataFrame, model: Model) -> float | None:
    """The share of held-back texts whose cross-entropy is above their language's limit; the margin for short texts isn't counted, so it is no less than the true one."""
    limits = scored.sparkSession.createDataFrame(list(zip(model.languages, map(float, model.limits), strict=True)), "lang_pred string, limit double")
    found = scored.join(F.broadcast(limits), "lang_pred").agg(F.avg((F.col("entropy") > F.col("limit")).cast("double"))).first()
    return found[0]


def limits(scored: DataFrame, slack: float, model: Model) -> np.ndarray:
    """Of each language of ``model``, from what a model that hasn't seen them says of held-back rows. A language with few held-back rows gets the limit of all rows together; with few in all, the worst row counts, or at most a model that knows nothing but the letters."""
    scored = scored.groupBy("lang_pred").agg(F.count("entropy").alias("n"), F.max("entropy").alias("worst"), F.percentile_approx("entropy", [k / 100 for k in range(1, 101)], 10_000).alias("at"))
    found = {r["lang_pred"]: r for r in scored.collect()}  # as many rows as languages
    if (total := sum(r["n"] for r in found.values())) >= LEAST_BACK:
        values, weights = [x for r in found.values() for x in r["at"]], [r["n"] for r in found.values() for _ in r["at"]]
        order = np.argsort(values)
        share = np.cumsum(np.array(weights)[order]) / (100 * total)
        pooled = values[order[np.searchsorted(share, QUANTILE - 1e-9)]]
    else:
        pooled = min([-np.log(model.uniform), *([max(r["worst"] for r in found.values())] if total else [])])
    return slack * np.array([found[k]["at"][round(100 * QUANTILE) - 1] if k in found and found[k]["n"] >= LEAST_BACK else pooled for k in model.languages])


def scoring(spark, model: Model):
    """A function for executors: from a column of texts to lists of judgements, a list for every 1024 texts. The model is broadcast."""
    if model.size() > MODEL_BYTES:
        raise ValueError(f"the model has {model.size()} bytes; at most {MODEL_BYTES} are broadcast")
    bound_batches(spark)
    shared, name = spark.sparkContext.broadcast(model), f"language model {uuid.uuid4().hex}"

    def run(texts: pa.Array) -> Iterator[list[tuple[str, float, float | None, bool]]]:
        own = held(name, lambda: Scorer(shared.value))
        for at in range(0, len(texts), 1024):
            yield own.judge(texts.slice(at, 1024).to_pylist())

    return run


def apply(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, ``lang_pred``, ``score``, ``entropy`` (per character, in nats) and ``rejected`` of each whole text."""
    judged = scoring(docs.sparkSession, model)
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for part in judged(batch.column(1)) for row in part]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def identify(docs: DataFrame, **columns: str) -> DataFrame:
    """Train on ``docs`` and predict all of them: identifier, ``held_out``, ``lang_pred``, ``score``, ``entropy``, ``rejected``."""
    model = train(docs, **columns)
    out = apply(docs, model, **{k: v for k, v in columns.items() if k in ("id_col", "text_col")})
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs``, all columns, without the rows whose text is rejected; with nothing to learn from, only those without a letter go."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    judged = scoring(docs.sparkSession, model)

    @F.arrow_udf("boolean")
    def rejected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([r for part in judged(texts) for _, _, _, r in part], pa.bool_())

    return docs.where(~rejected(F.col(text_col).cast("string")))  # only the texts go to Python, and a mark for each comes back
