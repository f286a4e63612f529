"""Exact deduplication through a log-structured merge index, with DataFrame operations only.

Memtables are slices of at most ``MEMTABLE`` rows, in the order in which tasks scan them; each flushes a run, sorted
by digest, without a shuffle. Compaction merges runs and keeps the smallest identifier and the row count of
each digest. The entries that more than one row has are cut by digest prefix into sorted runs of bounded size, each
with a filter of its own. Lookups are a second scan: a row asks the filter of its digest's run, and only
hits (and few others) go on. Their texts are compared byte by byte: within a digest, the smallest and the largest text must be the same
one, which tasks find for their own rows before anything is shuffled, so copies of a hot text don't meet. Digests whose texts
differ are grouped again, by text.

Cases:

* a null text counts as empty; the empty text is a text like any other
* a null identifier never stays before one that isn't null; if all of a group are null, ``keep_id``
  is null and all of them are kept
* rows repeated with identifier and text all count in ``group_size`` and share one decision
* further columns, of whatever name, are not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.prefilter import build_filter, passing, without
from gaugewright.session import materialize, temporary

#: Rows of a memtable at most, and entries of a run of the index, on average at most.
MEMTABLE, RUN = 1 << 20, 1 << 20
#: Most runs of the index with a filter of their own; beyond, they grow.
RUNS = 1 << 12


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(rows: DataFrame, memtables: int | None = None) -> DataFrame:
    """The runs of level 0: ``rows`` (``_ident``, ``_digest``) with ``_run``, each run in order of digest.

    A memtable takes a task's rows as they come, or, where the number of ``memtables`` is given, those of a hash of the identifier.
    """
    if memtables is None:
        run = F.shiftright(F.monotonically_increasing_id(), MEMTABLE.bit_length() - 1)  # task, then slice
    else:
        run = F.pmod(F.xxhash64("_ident"), F.lit(memtables))
    return rows.withColumn("_run", run.cast("long")).sortWithinPartitions("_run", "_digest")


def compact(runs: DataFrame, fan_in: int | None = None) -> DataFrame:
    """Runs merged, ``fan_in`` into one or all of them: of a digest the smallest identifier stays, and rows are added up."""
    n = F.sum("_n") if "_n" in runs.columns else F.count(F.lit(1))
    keys = ["_digest"] if fan_in is None else [F.floor(F.col("_run") / fan_in).cast("long").alias("_run"), "_digest"]
    return runs.groupBy(*keys).agg(F.min("_ident").alias("_ident"), n.alias("_n"))


def digest_index(runs: DataFrame, memtables: int | None = None, fan_in: int | None = None) -> DataFrame:
    """``_digest``, ``_ident`` and ``_n`` of all ``runs``; tier by tier, where the number of memtables and ``fan_in`` are given."""
    level, left = 0, memtables or 1
    while fan_in and left > fan_in:
        left, level = -(-left // fan_in), level + 1
        runs = materialize(compact(runs, fan_in).sortWithinPartitions("_run", "_digest"), f"lsm-level{level}")
    return compact(runs)


def run_of(parts: int):
    """A digest's run among ``parts`` (a power of two): the first bits of its first two bytes."""
    shift = 16 - (parts.bit_length() - 1)
    return lambda digest: F.shiftright(F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int"), shift)


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    memtables: int | None = None,
    fan_in: int | None = None,
    digest=sha256_digest,
) -> DataFrame:
    """One row for each row of ``docs``: its identifier, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep``: whether the row with the smallest or the largest identifier stays. The index keeps the
    smallest identifier; for the largest, it holds their complements.
    """
    ident = F.col(id_col).cast("long") if keep == "smallest" else F.bitwise_not(F.col(id_col).cast("long"))
    back = (lambda c: c) if keep == "smallest" else F.bitwise_not
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    scan = docs.select(ident.alias("_ident"), text.alias("_text")).withColumn("_digest", digest(F.col("_text")))
    with temporary() as tables:
        runs = materialize(flush(scan.select("_ident", "_digest"), memtables), "lsm-level0")
        merged = digest_index(runs, memtables, fan_in).where("_n > 1")
        parts = min(RUNS, 1 << max(0, (-(-runs.count() // RUN) - 1).bit_length()))
        shared = materialize(merged.withColumn("_run", run_of(parts)(F.col("_digest"))).repartition(parts, "_run").sortWithinPartitions("_run", "_digest"), "lsm-index")
        filters = build_filter(shared, "_digest", parts=parts, part=run_of(parts))

        hits = passing(scan, filters, "_digest")
        checked = hits.groupBy("_digest").agg(F.min("_text").alias("low"), F.max("_text").alias("high")).select("_digest", (F.col("low") != F.col("high")).alias("_mixed"))
        index = materialize(shared.join(checked, "_digest").select("_digest", "_mixed", F.col("_ident").alias("_keep"), "_n"), "lsm-verified")
        clashes = materialize(index.where("_mixed").select("_digest"), "lsm-clashes")
        if not (none := clashes.isEmpty()):
            texts = materialize(passing(scan, build_filter(clashes, "_digest"), "_digest").join(clashes, "_digest"), "lsm-texts")
            groups = materialize(texts.groupBy("_digest", "_text").agg(F.min("_ident").alias("_keep"), F.count(F.lit(1)).alias("_n")), "lsm-groups")
            tables.keep(texts, groups)
        tables.keep(runs, shared, index)

    names = ["_ident", "_digest", "_keep", "_n"]
    marked = filters.marked(runs.select("_ident", "_digest"), "_digest")
    alone = marked.where("NOT _gw_held").select("_ident", "_digest", F.col("_ident").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    found = marked.where("_gw_held").select("_ident", "_digest").join(index, "_digest", "left").where("_mixed IS NULL OR NOT _mixed")
    found = found.select("_ident", "_digest", F.when(F.col("_n").isNull(), F.col("_ident")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_n", F.lit(1).cast("long")).alias("_n"))
    out = alone.unionByName(found)
    if not none:
        out = out.unionByName(texts.join(groups, ["_digest", "_text"]).select(*names))
    return out.select(
        back(F.col("_ident")).alias("doc_id"),
        back(F.col("_keep")).alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_ident").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **how) -> DataFrame:
    """``docs`` without the rows of which another row with the same text stays. Other texts of an identifier that goes stay."""
    with temporary() as tables:
        found = exact_duplicates(docs, id_col=id_col, text_col=text_col, keep=keep, **how)
        dropped = materialize(found.where(~F.col("kept")).select("doc_id", "text_sha256"), "lsm-dropped")
        tables.keep(dropped)
    return without(docs, dropped, id_col, further={"text_sha256": F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
