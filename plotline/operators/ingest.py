"""Import: reject, dedup key, merge with enrichment, outcomes, community backfill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotline import schema
from plotline.functions import address as A
from plotline.functions.text import blank
from plotline.functions.values import is_empty
from plotline.operators import filters as P
from plotline.operators.stats import join_back
from plotline.session import stage

# Precedence of a row: its source's rank, then its place inside the source.
ORDER = ("source_rank", "ingest_seq")


def split_rejects(df: DataFrame, address: str = "address") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rejected rows carry ``reject_reason``."""
    marked = df.withColumn("reject_reason", P.reject_reason(address))
    ok = F.col("reject_reason").isNull()
    return marked.where(ok).drop("reject_reason"), marked.where(~ok)


def with_dedup_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_key", A.dedup_key("transaction_date", "address", "total_price"))


def _fillable(df: DataFrame) -> dict[str, str]:
    return {n: r for n, r in schema.FILLABLE.items() if n in df.columns}


def _one_pass(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows to group in one pass, and the grouping columns: a row without a key is a group of its own.

    Parting the rows by their key instead would read the sources and compute the keys again for each part and its filter.
    """
    return df.withColumn("__lone", F.when(F.col("dedup_key").isNull(), F.monotonically_increasing_id())), ["dedup_key", "__lone"]


def merge_duplicates(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per dedup key: the first row by precedence, its empty fields filled from later ones.

    Each fillable field takes its first non-empty value in order, so the answer does not depend
    on arrival or partitioning.  One aggregate, combined before the shuffle, so a key with very
    many copies reaches its reducer as one partial row per task.  Rows without a key stay as they are.
    """
    ord_ = F.struct(*order)
    fields = _fillable(df)
    rest = [c for c in df.columns if c != "dedup_key"]
    rows, keys = _one_pass(df)
    aggs = [F.min_by(F.struct(*rest), ord_).alias("__row")]
    # The smallest pair of place and value: one buffer a field, half the work of a value picked by its place.
    aggs += [F.min(F.when(~is_empty(n, r), F.struct(*order, F.col(n).alias("__value")))).alias(f"__{n}") for n, r in fields.items()]
    picked = {n: F.coalesce(f"__{n}.__value", f"__row.{n}") if n in fields else F.col(f"__row.{n}") for n in rest}
    return rows.groupBy(*keys).agg(*aggs).select(
        *[F.col(n) if n == "dedup_key" else picked[n].alias(n) for n in df.columns]
    )


def first_by_key(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """First row of each dedup key, as it is."""
    rest = [c for c in df.columns if c != "dedup_key"]
    rows, keys = _one_pass(df)
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select("dedup_key", "__row.*").select(*df.columns)


def outcomes(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Every row with ``outcome``: inserted, enriched, duplicated or discarded (and the reason).

    A later copy is *enriched* when it is the one that fills a field left empty before it.  The rows are written once and
    read three times, so that sources and keys are computed once.
    """
    ord_ = F.struct(*order)
    fields = _fillable(df)
    accepted, rejected = split_rejects(stage(df, "keyed"))
    filler = lambda n, r: F.min(F.when(~is_empty(n, r), ord_))
    per_key = (
        accepted.where(F.col("dedup_key").isNotNull()).groupBy("dedup_key")
        .agg(F.min(ord_).alias("__first"), *[filler(n, r).alias(f"__f{i}") for i, (n, r) in enumerate(fields.items())])
        .select(
            "dedup_key", "__first",
            F.array_distinct(F.array_compact(F.array(*[f"__f{i}" for i in range(len(fields))]))).alias("__fillers"),
        )
    )
    joined = join_back(accepted, per_key, ["dedup_key"])
    outcome = (
        F.when(F.col("dedup_key").isNull() | (ord_ == F.col("__first")), "inserted")
        .when(F.array_contains("__fillers", ord_), "enriched")
        .otherwise("duplicated")
    )
    done = joined.withColumns({"outcome": outcome, "reject_reason": F.lit(None).cast("string")})
    return done.drop("__first", "__fillers").unionByName(
        rejected.withColumn("outcome", F.lit("discarded")), allowMissingColumns=True
    )


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome", F.coalesce("reject_reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("rows")
    )


def probe_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows with ``is_known``: does the stored table hold their key already?"""
    keys = existing.where(F.col("dedup_key").isNotNull()).select("dedup_key").distinct()
    known = keys.withColumn("__known", F.lit(True))
    return (
        incoming.join(known, "dedup_key", "left")
        .withColumn("is_known", F.coalesce("__known", F.lit(False))).drop("__known")
    )


# --- community backfill ---------------------------------------------------
def base_key(address: Column) -> Column:
    """Normalised address without city and floor."""
    return A.strip_floor(A.strip_city_for_key(A.compact_form(address)))


def vote_communities(rows: DataFrame, address: str = "address", community: str = "community") -> DataFrame:
    """Majority building project per base address; ties go to the smallest name."""
    named = rows.where(~blank(community) & A.after_hash(address).contains("號")).select(
        base_key(A.after_hash(address)).alias("base_address"), F.col(community).alias("community")
    )
    counts = named.where("base_address <> ''").groupBy("base_address", "community").agg(
        F.count("*").alias("votes")
    )
    # Most votes first, then the smallest name: min_by over (-votes, name).
    best = F.min_by(F.struct("community", "votes"), F.struct((-F.col("votes")).alias("v"), "community"))
    return counts.groupBy("base_address").agg(best.alias("__b")).select("base_address", "__b.*")


def backfill_community(tx: DataFrame, votes: DataFrame) -> DataFrame:
    """Fill blank building projects from the vote of the row's base address; others stay."""
    v = votes.select(F.col("base_address").alias("__base"), F.col("community").alias("__voted"))
    blank_name = blank("community_name")
    need = tx.where(blank_name).withColumn("__key", base_key(F.coalesce("address", F.lit(""))))
    filled = (
        need.join(v, F.col("__key") == F.col("__base"), "left")
        .withColumn("community_name", F.coalesce("__voted", "community_name"))
        .select(*tx.columns)
    )
    return tx.where(~blank_name).unionByName(filled)


# --- whole import ---------------------------------------------------------
def import_rows(
    sources: Sequence[DataFrame], existing: DataFrame | None = None, api_rows: DataFrame | None = None
) -> DataFrame:
    """Canonical sources in order of precedence to one merged table.

    Stored rows come first, then each source in the given order.  ``api_rows`` (columns
    ``address``, ``community``) feed the community backfill.
    """
    ranked = [] if existing is None else [existing.withColumn("source_rank", F.lit(0))]
    ranked += [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources, start=1)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    accepted, _ = split_rejects(rows)
    keyed = with_dedup_key(accepted) if "dedup_key" not in accepted.columns else accepted
    merged = merge_duplicates(keyed)
    return merged if api_rows is None else backfill_community(merged, vote_communities(api_rows))
