"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set are the distinct hashes of its runs of five words. The signature gives each element one
rank per position, taken from a random permutation of the element's own, so ranks of an element are
correlated and estimates vary less than with independent hashes; a document stops as soon as no later
rank can lower a position (large sets need one or two steps per element).

Documents with the same set are one class. Classes that agree on a band of the signature are candidates:

1. In each of a few rounds, every bucket has some pivots (the members with the smallest hashes of set and
   round). A member of another component is held against the pivots that it meets in most bands, so there are no more
   such pairs than a small multiple of the classes. Links that are confirmed join components.
2. In buckets that still hold several components, members of all but the most frequent one are held against all
   members of other components, in blocks of bounded size (in rows and in elements of their sets); each pair once, in the first band on which it agrees.
   A block confirms its candidates itself, from the full sets of the rows that have any, and gives only as many links as join them.

So no bucket is expanded into all pairs, and what lies in one component already needs no more checks,
yet no two members of a bucket stay apart without a check. A candidate must have an estimated similarity
above ``ESTIMATE`` and set sizes that allow the threshold; then both whole texts decide. With 32 bands of 4, a pair of similarity
0.75 has no band in common with probability 5e-6.

Cases: texts that are null, empty or without words have empty sets and no links; with fewer than five
words, the sequence is one element; a null identifier takes no part and is kept (its component is null);
rows with words that share an identifier are one node, so that different texts of one identifier link all that
either is similar to; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.components import connected_components, local_forest
from gaugewright.llm.hashing import MULTIPLY, SpanHasher, U, mixed
from gaugewright.llm.prefilter import build_filter, passing, without
from gaugewright.llm.stores import held
from gaugewright.session import bound_batches, materialize, parallelism, temporary

BANDS, ROWS = 32, 4
POSITIONS = BANDS * ROWS
WORDS_EACH = 5
#: Positions that must agree for a pair to be verified: nearly five standard deviations below a similarity of 0.75.
ESTIMATE = 72
#: Members in a block of a bucket, and elements of their sets, on average at most.
BLOCK, ELEMENTS = 128, 1 << 20
#: Rounds, pivots of a bucket in each, and pivots that a member is held against in each.
ROUNDS, PIVOTS, TRIES = 2, 4, 3
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text, its set: sorted distinct 64-bit hashes."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, size, parts = at, 0, []
        while stop < len(texts) and (size < 1 << 20 or stop == at):
            parts.append((texts[stop] or "").encode("utf-8", "surrogatepass").lower())
            size += len(parts[-1]) + 1
            stop += 1
        out += _sets(parts)
        at = stop
    return out


def _sets(parts: list[bytes]) -> list[np.ndarray]:
    codes = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = held("near_dedup", SpanHasher).hashes(codes, starts, ends)
    first = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
    runs = words[: max(0, len(words) - WORDS_EACH + 1)].copy()
    for k in range(1, WORDS_EACH):
        runs = mixed(runs * MULTIPLY + words[k : len(runs) + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS_EACH:
            out.append(np.unique(runs[a : b - WORDS_EACH + 1]))
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = mixed(h * MULTIPLY + words[k : k + 1])
            out.append(mixed(h + U(b - a)))
        else:
            out.append(words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: (sets, POSITIONS) values, of which those of empty sets mean nothing."""
    m = POSITIONS
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
    flat = out.reshape(-1)
    order: np.ndarray | None = None  # each element's permutation, as far as it is drawn
    for step in range(m):
        if not len(element):
            break
        drawn = mixed(element + U((step + 1) * int(MULTIPLY) & 0xFFFFFFFFFFFFFFFF))
        pick = (U(step) + (((drawn & U(0xFFFFFFFF)) * U(m - step)) >> U(32))).astype(np.int64)
        if order is None:
            position = pick
        else:
            every = np.arange(len(element))
            position = order[every, pick].astype(np.int64)
            order[every, pick] = order[every, step]
        np.minimum.at(flat, owner * m + position, (U(step) << U(32)) | (drawn >> U(32)))
        open_sets = out.max(axis=1) >= (U(step + 1) << U(32))
        going = open_sets[owner]
        if order is None:
            owner, element, pick = owner[going], element[going], pick[going]
            order = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), pick] = 0
        elif not going.all():
            owner, element, order = owner[going], element[going], order[going]
    return out


def set_digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sets = shingle_sets(batch.column(1).to_pylist())
            short = (mixed(signatures(sets)) >> U(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) for s in sets], pa.binary()),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                ],
                ["id", "n", "digest", "signature"],
            )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: ``id``, size of its set ``n``, ``digest`` of the set and ``signature`` (16 bits a position)."""
    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_features, "id long, n long, digest binary, signature binary")


def _band(signature: Column, band: Column) -> Column:
    return F.substring(signature, (band * (2 * ROWS) + 1).cast("int"), F.lit(2 * ROWS))


def banded(classes: DataFrame) -> DataFrame:
    """A row for each class and band, with the band's key."""
    bands = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    return classes.select("digest", "signature", bands.alias("band")).select("digest", "band", _band(F.col("signature"), F.col("band")).alias("key"))


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures and set sizes allow the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, POSITIONS) for c in ("sa", "sb"))
        n, k = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        good = ((x == y).sum(axis=1) >= ESTIMATE) & (100 * np.minimum(n, k) >= 75 * np.maximum(n, k))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    left = classes.select(F.col("digest").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("digest").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_promising, "a binary, b binary")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            s, t = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
            both = len(np.intersect1d(s, t, assume_unique=True))
            good.append(100 * both >= 75 * (len(s) + len(t) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def _shingle_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            sets = shingle_sets(whole.column(0).slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "set"])


def sets_of(needed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``digest``, ``id`` and full ``set`` of the classes ``needed`` (written; ``digest``, ``id``), from the whole texts.

    An identifier may have several texts, so the digest decides; copies of a row leave one set each before the shuffle.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = passing(chosen, build_filter(needed, "id"), "id").select("text").mapInArrow(_shingle_bytes, "digest binary, set binary")
    return found.groupBy("digest").agg(F.any_value("set").alias("set")).join(needed, "digest").select("digest", "id", "set")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between identifiers: those of ``pairs`` (a written table of digests) whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    needed = materialize(ends.join(classes.select("digest", "id"), "digest"), "near-needed")
    sets = materialize(sets_of(needed, docs, id_col, text_col), "near-sets")
    left = sets.select(F.col("digest").alias("a"), F.col("id").alias("ia"), F.col("set").alias("sa"))
    right = sets.select(F.col("digest").alias("b"), F.col("id").alias("ib"), F.col("set").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "sa", "sb")
    return joined.mapInArrow(_confirm, "a long, b long").where("a != b")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of rows in order of band, key, i and j."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        marks = list(zip(*(table.column(c).to_pylist() for c in ("band", "key", "i", "j")), strict=True))
        cuts = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1])]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(start, end - start)
        held = table.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _candidates(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Left and right rows of different components that look similar and agree on this band first."""
    left = block.column("left").to_numpy().astype(bool)
    component, n = block.column("component").to_numpy(), block.column("n").to_numpy()
    sign = np.frombuffer(b"".join(block.column("signature").to_pylist()), dtype="<u2").reshape(-1, POSITIONS)
    p, q = np.flatnonzero(left), np.flatnonzero(~left)
    a, b = np.repeat(p, len(q)), np.tile(q, len(p))
    good = (component[a] != component[b]) & (100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b]))
    a, b = a[good], b[good]
    same = sign[a] == sign[b]
    first = same.reshape(len(a), BANDS, ROWS).all(axis=2).argmax(axis=1) == int(block.column("band")[0].as_py())
    good = first & (same.sum(axis=1) >= ESTIMATE)
    return a[good], b[good]


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block that have a candidate in it."""
    for block in _blocks(batches):
        a, b = _candidates(block)
        if len(a):
            rows = block.select(["band", "key", "i", "j", "left", "digest"]).take(pa.array(np.union1d(a, b)))
            yield from rows.combine_chunks().to_batches()


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common elements of pairs of sets; many pairs at once by products of incidence matrices over portions of the elements."""
    if len(a) < 200:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for start in range(0, len(names), 8192):
        low, high = np.searchsorted(place, [start, start + 8192])
        held = np.zeros((len(sets), 8192), dtype=np.float32)
        held[owner[low:high], place[low:high] - start] = 1
        common += held @ held.T
    return common[a, b].astype(np.int64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, links of confirmed candidates: as many as join its rows, not all pairs."""
    for block in _blocks(batches):
        a, b = _candidates(block)
        if not len(a):
            continue
        ids = block.column("id").to_numpy()
        sets = [np.frombuffer(x, dtype=U) for x in block.column("set").to_pylist()]
        n, both = np.array([len(x) for x in sets]), intersections(sets, a, b)
        good = 100 * both >= 75 * (n[a] + n[b] - both)
        pairs = pa.RecordBatch.from_arrays([pa.array(ids[a[good]]), pa.array(ids[b[good]])], ["a", "b"])
        yield from local_forest(iter([pairs]))


def labelled(classes: DataFrame, component: DataFrame | None) -> DataFrame:
    """The classes with their components so far; one that has no link is its own."""
    if component is None:
        return classes.withColumn("component", F.col("id"))
    joined = classes.join(component.withColumnRenamed("node", "id"), "id", "left")
    return materialize(joined.select("digest", "id", "n", "signature", F.coalesce("component", "id").alias("component")), "near-labelled")


def pivot_pairs(members: DataFrame, classes: DataFrame, turn: int) -> DataFrame | None:
    """Pairs of members and pivots of other components; none if no bucket holds two components.

    ``members`` (written): ``band``, ``key``, ``digest``; ``classes`` are labelled.
    """
    bucket = materialize(members.join(classes.select("digest", "component"), "digest").select("band", "key", "digest", "component"), "near-members")
    first = [F.min(F.struct(F.xxhash64("digest", F.lit(turn * PIVOTS + k)).alias("h"), "digest", "component")).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = bucket.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *first).where("low < high")
    chosen = materialize(chosen.select("band", "key", F.array(*[F.struct(F.col(f"p{k}.digest").alias("digest"), F.col(f"p{k}.component").alias("component")) for k in range(PIVOTS)]).alias("pivots")), "near-pivots")
    if chosen.isEmpty():
        return None
    other = F.transform(F.filter("pivots", lambda p: p["component"] != F.col("component")), lambda p: p["digest"])
    met = bucket.join(chosen, ["band", "key"]).select("digest", F.explode(F.array_distinct(other)).alias("pivot")).groupBy("digest", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    best = met.groupBy("digest").agg(F.slice(F.sort_array(F.collect_list(F.struct("bands", "pivot")), asc=False), 1, TRIES).alias("best"))  # at most BANDS * PIVOTS entries
    pairs = best.select("digest", F.explode("best.pivot").alias("pivot"))
    return pairs.select(F.least("digest", "pivot").alias("a"), F.greatest("digest", "pivot").alias("b")).distinct()


def cross_links(members: DataFrame, labelled: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between components that share a bucket, confirmed in blocks. ``members`` (written): ``band``, ``key``, ``digest``."""
    bucket = members.join(labelled.select("digest", "n", "component"), "digest")
    bucket = materialize(bucket.select("band", "key", "digest", "n", "component"), "near-members")
    by_component = bucket.groupBy("band", "key", "component").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / ELEMENTS).alias("c"))
    mixed_up = by_component.groupBy("band", "key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("parts"))
    mixed_up = mixed_up.where("parts > 1").select("band", "key", F.col("top.component").alias("most"), F.ceil("all").cast("int").alias("nj"), F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("top.c"))).cast("int").alias("ni"))
    open_rows = bucket.join(materialize(mixed_up, "near-mixed"), ["band", "key"])
    salt = F.xxhash64("digest")
    right = open_rows.select("band", "key", "digest", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(salt, F.col("nj")).cast("int").alias("j"), F.lit(False).alias("left"))
    left = open_rows.where("component != most").select("band", "key", "digest", F.pmod(salt, F.col("ni")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("left"))
    placed = left.unionByName(right)
    parts = parallelism(members.sparkSession)
    block = ["band", "key", "i", "j"]

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*block, "left", "id", "digest", "component", "n", "signature", *more).repartition(parts, *block).sortWithinPartitions(*block)

    kinds = "band int, key binary, i int, j int, left boolean, digest binary"
    open_rows = materialize(dealt(placed.join(labelled, "digest")).mapInArrow(_open_rows, kinds), "near-open")
    needed = materialize(open_rows.select("digest").distinct().join(labelled.select("digest", "id"), "digest"), "near-needed")
    sets = sets_of(needed, docs, id_col, text_col).select("digest", "set")
    return dealt(open_rows.join(labelled, "digest").join(sets, "digest"), "set").mapInArrow(_linked, "a long, b long").distinct()


def same_identifier_links(usable: DataFrame, named: DataFrame) -> DataFrame | None:
    """Links of identifiers that stand in several classes to the first identifier of each; none if there are no such identifiers."""
    several = usable.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low < high").select("id")
    several = materialize(several, "near-several")
    if several.isEmpty():
        return None
    rows = usable.join(several, "id").select("id", "digest").distinct()
    return rows.join(named, "digest").select(F.col("id").alias("a"), F.col("class").alias("b")).where("a != b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    with temporary() as tables:
        every, of_class = _grouped(docs, id_col, text_col)
        tables.keep(every, of_class)
    usable = every.where("n > 0 AND id IS NOT NULL")
    linked = usable.select("id", "n", "digest").join(of_class, "digest").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = every.where("n = 0 OR id IS NULL").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the features of every row, and the component of each class (``digest``, ``component``)."""
    every = materialize(features(docs, id_col, text_col), "near-features")
    usable = every.where("n > 0 AND id IS NOT NULL")
    # A class is named by the digest of its set; its first identifier is its node. Two classes may have the same one.
    named = materialize(usable.groupBy("digest").agg(F.min("id").alias("class")), "near-classes")
    firsts = named.select(F.col("class").alias("id"), "digest")
    classes = materialize(usable.join(firsts, ["id", "digest"]).select("digest", "id", "n", "signature").dropDuplicates(["digest"]), "near-firsts")

    bands = banded(classes)
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "key")
    members = materialize(bands.join(shared, ["band", "key"]), "near-buckets")
    tested: DataFrame | None = None
    links = same_identifier_links(usable, named)
    component = None if links is None else materialize(connected_components(links), "near-components")
    mixed = True
    for turn in range(ROUNDS):
        met = pivot_pairs(members, labelled(classes, component), turn)
        if met is None:
            mixed = False
            break
        met = met if tested is None else met.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(promising(met, classes), "near-pairs")
        found = materialize(confirmed(pairs, classes, docs, id_col, text_col), "near-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        component = materialize(connected_components(links), "near-components")
    if mixed:
        found = materialize(cross_links(members, labelled(classes, component), docs, id_col, text_col), "near-links")
        component = materialize(connected_components(links.unionByName(found)), "near-components")
    of_class = named.withColumn("component", F.col("class"))
    if component is not None:
        of_class = named.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    return every, materialize(of_class.select("digest", "component"), "near-named")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one node of each group, the one with the smallest identifier; texts without words stay."""
    with temporary() as tables:
        dropped = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col).where(~F.col("kept")).select("doc_id"), "near-dropped")
        tables.keep(dropped)
    return without(docs, dropped, id_col, where=F.col(text_col).rlike("[^ \\t-\\r]"))
