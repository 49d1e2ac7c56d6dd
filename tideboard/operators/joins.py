"""Lookups, enrichment, anti and fallback joins, and the cache lookup.

Dimensions built from the rules are a few hundred rows at most and are broadcast. Tables that come
from the caller get no hint: their size decides, and AQE splits hot keys of a shuffled join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideboard.functions import text as T
from tideboard.functions import url as U
from tideboard.operators.windows import dedup_first
from tideboard.rules import aliases as A
from tideboard.rules import lexicons as L
from tideboard.rules import places as PL
from tideboard.session import cut_lineage

SMALL_LEXICON = 50_000  # terms, a few MB

# --- dimensions ----------------------------------------------------------------------------

def location_alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PL.alias_rows(), "spelling string, kind string, canonical string, words array<string>")


def experience_alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(A.EXPERIENCE_ROWS, "spelling string, level string")


def employment_alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(A.EMPLOYMENT_ROWS, "spelling string, employment string")


def skills_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.SKILLS, "term string, shown string")


def _join_alias(df: DataFrame, on: str, own: DataFrame, given: DataFrame | None) -> DataFrame:
    dim = F.broadcast(own) if given is None else given
    keyed = df.withColumn("_spelling", F.lower(F.trim(F.col(on))))
    return keyed.join(dim.withColumnRenamed("spelling", "_spelling"), "_spelling", "left").drop("_spelling")


def join_boards(df: DataFrame, url: str = "url", boards: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Adds the first known board whose domain is part of the URL, and the settings of the
    platform behind it. The list is short and fixed, so it becomes part of the projection
    instead of a nested-loop join."""
    platform = U.platform_of(F.col(url))
    return df.withColumns(
        {
            "board": U.board_of(F.col(url), boards),
            "platform": platform["platform"],
            "page_type": platform["page_type"],
            "pagination_type": platform["pagination_type"],
        }
    )


def join_location_alias(df: DataFrame, on: str = "location", dim: DataFrame | None = None) -> DataFrame:
    """Adds kind, canonical and words of a place spelling."""
    return _join_alias(df, on, location_alias_dim(df.sparkSession), dim)


def join_level_alias(df: DataFrame, on: str = "experience_level", dim: DataFrame | None = None) -> DataFrame:
    """Adds the level code of an experience spelling."""
    return _join_alias(df, on, experience_alias_dim(df.sparkSession), dim)


def join_employment_alias(df: DataFrame, on: str = "employment_text", dim: DataFrame | None = None) -> DataFrame:
    """Adds the employment type of a spelling."""
    return _join_alias(df, on, employment_alias_dim(df.sparkSession), dim)


# --- enrichment ----------------------------------------------------------------------------

def enrich_details(postings: DataFrame, details: DataFrame, key: str = "url") -> DataFrame:
    """Fills empty fields of postings from their detail pages (one row per key). A detail
    description over 100 characters replaces the listed one; skills are replaced below three."""
    fill = ["salary_range", "employment_type", "posted_date", "experience_level", "industry", "company_size"]
    fill_lists = ["benefits", "requirements"]
    used = [c for c in [*fill, *fill_lists, "description", "skills"] if c in details.columns and c in postings.columns]
    side = details.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in used]
    )
    # Rows without a key have no detail. They stay out of the join, where NULL keys would all meet
    # in one task.
    with_key = postings.filter(F.col(key).isNotNull())
    with_key = with_key.join(side, with_key[key] == side["_key"], "left").drop("_key")
    joined = with_key.unionByName(postings.filter(F.col(key).isNull()), allowMissingColumns=True)

    def merged(c: str) -> Column:
        old, new = F.col(c), F.col(f"_{c}")
        if c == "description":
            return F.when(F.length(new) > 100, new).otherwise(old)
        if c == "skills":
            few = F.coalesce(F.size(old), F.lit(0)) < 3
            return F.when(few & (F.size(new) > 0), new).otherwise(old)
        if c in fill_lists:
            empty = F.coalesce(F.size(old), F.lit(0)) == 0
            return F.when(empty & (F.size(new) > 0), new).otherwise(old)
        return F.coalesce(F.nullif(old, F.lit("")), F.nullif(new, F.lit("")))

    return joined.withColumns({c: merged(c) for c in used}).drop(*[f"_{c}" for c in used])


def match_lexicon(
    df: DataFrame, id_col: str, text: str, lexicon: DataFrame, longest: int | None = None
) -> DataFrame:
    """One row per text that names lexicon terms: id and the sorted distinct display forms. ``lexicon`` has term (lower
    case, words parted by one space) and shown; ``longest`` is the number of words of its longest term, counted here if it
    is not given.

    The lexicon is a trie of one level: the first words, each with the lengths of the terms that begin with it. Only
    where a word of a text is one of these, runs of those lengths are made, and a run that is a term is a hit. Both steps
    are equality joins; a row carries no more than the words of the longest term.

    The words of all texts are many times what the optimizer takes the stored texts for, so the choice of a side is not
    left to it: a lexicon of up to ``SMALL_LEXICON`` terms is sent to all tasks, with a larger one both sides are dealt
    out. The texts are never gathered in one place."""
    counted = lexicon.agg(F.count(F.lit(1)).alias("terms"), F.max(F.size(F.split("term", " "))).alias("longest")).first()
    longest = longest or counted["longest"] or 1
    few = counted["terms"] <= SMALL_LEXICON

    def met(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
        return texts.join(F.broadcast(terms) if few else terms.hint("merge"), key)

    # A full stop or slash at the edge of a word belongs to the sentence.
    spaced = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_+#./]+", " ")
    words = F.split(F.trim(F.regexp_replace(spaced, r"(^| )[./]+|[./]+(?= |$)", "$1")), " +")
    held = df.select(id_col, words.alias("_words"))
    at = T.explode_once(held, [id_col, "_words"], F.col("_words"), "_i", "_head")
    runs = at.select(id_col, "_head", F.slice("_words", (F.col("_i") + 1).cast("int"), longest).alias("_run"))
    parts = F.split("term", " ")
    heads = lexicon.groupBy(F.get(parts, 0).alias("_head")).agg(F.collect_set(F.size(parts)).alias("_lengths"))
    begun = met(runs, heads, "_head")
    grams = F.transform("_lengths", lambda n: F.when(F.size("_run") >= n, F.array_join(F.slice("_run", F.lit(1), n), " ")))
    found = begun.select(id_col, F.explode(grams).alias("term")).filter(F.col("term").isNotNull())
    hits = met(found, lexicon.select("term", "shown"), "term")
    return hits.groupBy(id_col).agg(F.array_sort(F.collect_set("shown")).alias("terms"))


def anti_seen(df: DataFrame, seen: DataFrame, key: str = "posting_key") -> DataFrame:
    """Rows whose key was not seen before. The seen keys are made distinct first."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def with_fallback(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All primary rows, and the secondary rows of keys that the primary does not have."""
    missing = secondary.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.unionByName(missing, allowMissingColumns=True)


def latest_details(details: DataFrame, key: str, order: Sequence) -> DataFrame:
    """One detail row per key, as ``enrich_details`` expects."""
    return dedup_first(details.filter(F.col(key).isNotNull()), [key], order)


# --- cache lookup --------------------------------------------------------------------------

def _following(points: DataFrame, ttl: int, chunks: int | None) -> DataFrame:
    """For each point (_key, _us): ``_to``, the key's first point after the one's expiry. Points
    and expiries are laid out in one order and cut into ranges of equal size; a range that has no
    later point takes the first one of the ranges after it."""
    both = points.select("_key", F.col("_us").alias("_at"), F.lit(0).alias("_asks"), "_us").unionByName(
        points.select("_key", (F.col("_us") + ttl).alias("_at"), F.lit(1).alias("_asks"), "_us")
    )
    by = ["_key", "_at", "_asks"]
    ranged = both.repartitionByRange(chunks, *by) if chunks else both.repartitionByRange(*by)
    # The range bounds come from a sample, so the chunk of a row is fixed by writing it down.
    labelled = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()), "cache-chunks")
    point = F.when(F.col("_asks") == 0, F.col("_us"))
    later = Window.partitionBy("_key", "_chunk").orderBy(F.desc("_at"), F.desc("_asks"))
    later = later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("_key").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        labelled.groupBy("_key", "_chunk")
        .agg(F.min(point).alias("_first"))
        .select("_key", "_chunk", F.min("_first").over(after).alias("_beyond"))
    )
    asked = labelled.withColumn("_here", F.min(point).over(later)).filter(F.col("_asks") == 1)
    return (
        asked.join(firsts, ["_key", "_chunk"])
        .select("_key", "_us", F.coalesce("_here", "_beyond").alias("_to"))
        .filter(F.col("_to").isNotNull())
    )


def _stored_points(points: DataFrame, ttl: int, chunks: int | None) -> DataFrame:
    """The points at which a key's value is stored: its first point, the first one after that
    one's expiry, and so on. Each round doubles the known part of every key's sequence, so the
    number of rounds is the logarithm of its length. Joins are on single points: a hot key's
    points spread over all tasks."""
    jump = cut_lineage(_following(points, ttl, chunks), "cache-jumps")
    found = points.groupBy("_key").agg(F.min("_us").alias("_us"))
    while jump.take(1):
        new = found.join(jump, ["_key", "_us"]).select("_key", F.col("_to").alias("_us"))
        found = cut_lineage(found.unionByName(new), "cache-stored")
        further = jump.select("_key", F.col("_us").alias("_to"), F.col("_to").alias("_further"))
        jump = jump.join(further, ["_key", "_to"]).select("_key", "_us", F.col("_further").alias("_to"))
        jump = cut_lineage(jump, "cache-jumps")
    return found


def _long_lookup(base: DataFrame, ttl: int, chunks: int | None) -> DataFrame:
    """Outcome of the requests of long keys. A value lives for one TTL, so in time cells of that
    length a key stores at most once per cell, and a request can only use what was stored in its
    own cell or the one before."""
    cell = F.floor(F.col("_us") / ttl).cast("bigint")
    points = base.filter(~F.col("_empty")).groupBy("_key", "_us").agg(F.min("_tie").alias("_first"))
    stored = _stored_points(points.select("_key", "_us"), ttl, chunks)
    stored = stored.join(points, ["_key", "_us"]).select(
        "_key", cell.alias("_cell"), F.col("_us").alias("_s"), F.col("_first").alias("_s_tie")
    )
    earlier = stored.select("_key", (F.col("_cell") + 1).alias("_cell"), F.col("_s").alias("_p"))
    own = (F.col("_s") < F.col("_us")) | ((F.col("_s") == F.col("_us")) & (F.col("_s_tie") < F.col("_tie")))
    used = F.when(own, F.col("_s")).otherwise(F.col("_p"))
    hit = F.coalesce(F.col("_us") - used <= ttl, F.lit(False))
    return (
        base.withColumn("_cell", cell)
        .join(stored, ["_key", "_cell"], "left")
        .join(earlier, ["_key", "_cell"], "left")
        .select("_key", "_tie", "_us", hit.alias("is_hit"), F.when(hit, used).otherwise(F.col("_us")).alias("_stored"))
    )


def _fold(ttl: int):
    """Outcome of a short list of requests, folded in time order inside the JVM."""
    outcome = "struct<_tie: bigint, _us: bigint, is_hit: boolean, _stored: bigint>"

    def step(state: Column, r: Column) -> Column:
        hit = F.coalesce(r["_us"] - state["good"] <= ttl, F.lit(False))
        stored = F.when(hit, state["good"]).otherwise(r["_us"])
        row = F.struct(r["_tie"].alias("_tie"), r["_us"].alias("_us"), hit.alias("is_hit"), stored.alias("_stored"))
        # An empty result is stored but no later request can use it.
        good = F.when(hit, state["good"]).when(~r["_empty"], r["_us"])
        return F.struct(good.alias("good"), F.array_append(state["rows"], row).alias("rows"))

    start = F.struct(F.lit(None).cast("bigint").alias("good"), F.array().cast(f"array<{outcome}>").alias("rows"))
    return lambda requests: F.aggregate(F.array_sort(requests), start, step, lambda state: state["rows"])


def ttl_lookup(
    requests: DataFrame,
    key: str,
    ttl_seconds: int = 3600,
    ts: str = "ts",
    tie: str = "event_id",
    empty: str | None = None,
    fold_limit: int = 1000,
    chunks: int | None = None,
) -> DataFrame:
    """Cache outcome of each request: is_hit and stored_at (when the value it got was stored).
    A value is good until it is older than the TTL, counted from when it was stored, not from its
    last use. An empty result is stored but read as a miss. ``tie`` is a bigint that is unique
    within a key and orders requests of one instant.

    The requests of a key depend on each other in time order. Keys with up to ``fold_limit``
    requests are folded in one pass. For longer keys the instants at which a value is stored are
    found first, in a logarithmic number of joins; then every request meets those of its time."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(ts).cast("timestamp_ntz"))
    ttl = ttl_seconds * 1_000_000
    base = requests.select(
        F.col(key).alias("_key"),
        micros.alias("_us"),
        F.col(tie).cast("bigint").alias("_tie"),
        (F.col(empty) if empty else F.lit(False)).alias("_empty"),
    )
    # At most one row per fold_limit requests, so this side is small against the requests.
    long_keys = base.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > fold_limit).select("_key")
    has_long = bool(long_keys.take(1))
    short = base.join(long_keys, "_key", "left_anti") if has_long else base
    rows = (
        short.groupBy("_key")
        .agg(F.collect_list(F.struct("_us", "_tie", "_empty")).alias("_requests"))
        .transform(T.explode_once, ["_key"], _fold(ttl)(F.col("_requests")), "_i", "r")
        .select("_key", "r.*")
    )
    if has_long:
        rows = rows.unionByName(_long_lookup(base.join(long_keys, "_key", "left_semi"), ttl, chunks))
    return rows.select(
        F.col("_key").alias(key),
        F.col("_tie").alias(tie),
        F.timestamp_add("MICROSECOND", F.col("_us"), epoch).alias(ts),
        "is_hit",
        F.timestamp_add("MICROSECOND", F.col("_stored"), epoch).alias("stored_at"),
    )
