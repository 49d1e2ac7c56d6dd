"""First-wins, caps, page cuts and streaks.

No operator here sends a whole group through one task. Ranks keep a bound, so Spark limits every
group before the shuffle; running values are built per block and carried over block sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideboard.session import cut_lineage

# Ranks below this bound are limited before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
_LIMITED_RANK = 1000
_PARTS = (4096, 64)
_BLOCK = 10_000


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group. A larger ``n`` is cut in steps: within many parts of the
    group, then within fewer parts of what is left. Every step keeps the group's first ``n`` rows
    for sure, and the last one meets at most 64 times ``n`` rows."""
    out = rank or "_rank"
    if n >= _LIMITED_RANK:
        hashed = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
        df = df.withColumn("_hash", F.pmod(F.xxhash64(*hashed), F.lit(_PARTS[0])))
        for parts in _PARTS:
            part = df.withColumn("_part", F.col("_hash") % parts)
            within = Window.partitionBy(*keys, "_part").orderBy(*order)
            df = part.withColumn("_at", F.row_number().over(within)).filter(F.col("_at") <= n).drop("_at", "_part")
        df = df.drop("_hash")
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(out) <= n)
    return ranked if rank else ranked.drop(out)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row of each key in the given order. NULL keys are equal to each other. The partial
    limit leaves one row per key and task before the shuffle, so hot keys stay small."""
    return first_n(df, keys, order, 1)


def dedup_titles(df: DataFrame, order: Sequence) -> DataFrame:
    """First posting per title and company, both without regard to case."""
    keyed = df.withColumns({"_title": F.lower("title"), "_company": F.lower("company")})
    return dedup_first(keyed, ["_title", "_company"], order).drop("_title", "_company")


def dedup_text_start(df: DataFrame, text: str, order: Sequence, chars: int | None = None) -> DataFrame:
    """First row per text without regard to case, or per its first ``chars`` characters."""
    start = F.col(text) if chars is None else F.left(F.col(text), F.lit(chars))
    keyed = df.withColumn("_start", F.lower(start))
    return dedup_first(keyed, ["_start"], order).drop("_start")


def running_total(df: DataFrame, position: str, value: str, out: str, block: int = _BLOCK, levels: int = 2) -> DataFrame:
    """Sum of ``value`` over all rows at smaller positions. Positions are integers, one row each.

    Sums are taken in levels: of positions within blocks, of blocks within blocks of blocks, and so on. No window holds
    more than ``block`` rows but the last one, which has a row for each ``block ** levels`` positions."""
    return _running_total(df, F.col(position).cast("bigint"), value, out, block, levels)


def _running_total(df: DataFrame, place: Column, value: str, out: str, block: int, levels: int) -> DataFrame:
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_place", place)
    if levels == 0:
        return placed.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0))).drop("_place")
    placed = placed.withColumn("_block", F.expr(f"(_place - pmod(_place, {block})) div {block}"))
    offset = f"_offset{levels}"
    sums = placed.groupBy(F.col("_block").alias("_inner")).agg(F.sum(value).alias("_sum"))
    offsets = _running_total(sums, F.col("_inner"), "_sum", offset, block, levels - 1)
    offsets = offsets.select(F.col("_inner").alias("_block"), offset)
    within = Window.partitionBy("_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, "_block")
        .withColumn(out, F.col(offset) + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_place", "_block", offset)
    )


def cap_per_url(
    df: DataFrame,
    url_order: str,
    order: Sequence,
    n: int,
    total: int | None = None,
    dedup_before_cap: bool = False,
) -> DataFrame:
    """First ``n`` rows of each URL, and at most ``total`` rows over all URLs in input order.
    Duplicates by title and company are dropped after the caps, or before them on request."""
    if dedup_before_cap:
        df = dedup_titles(df, [url_order, *order])
    kept = first_n(df, [url_order], order, n, rank="_rank")
    if total is not None:
        counts = kept.groupBy(url_order).agg(F.count("*").alias("_n"))
        before = running_total(counts, url_order, "_n", "_before").filter(F.col("_before") < total)
        kept = kept.join(before.select(url_order, "_before"), url_order).filter(
            F.col("_rank") <= total - F.col("_before")
        )
        kept = kept.drop("_before")
    kept = kept.drop("_rank")
    return kept if dedup_before_cap else dedup_titles(kept, [url_order, *order])


# --- pages ---------------------------------------------------------------------------------

def _on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL: NULL meets NULL."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, match, how).drop(*(f"_right_{k}" for k in keys))


def page_flags(
    df: DataFrame, order: Sequence, fits: Column | None = None, query="query_id", page="page_no", key="posting_key"
) -> DataFrame:
    """One row per result page: n_rows, n_new (rows that fit and whose key no earlier page has),
    n_leading (distinct keys among the first five rows) and all_seen (all of those were seen).

    The rows are read once: what their fields are made of may be dear, so place, key and fit are written down, and
    counts and leading rows come from that narrow table."""
    fit = F.lit(True) if fits is None else fits
    placed = cut_lineage(df.select(query, page, key, *order, fit.alias("_fits")), "page-keys")
    # Per page and key first: hot pages and keys shrink before any join.
    page_keys = placed.groupBy(query, page, key).agg(F.count("*").alias("_n"), F.max("_fits").alias("_fits"))
    leading = (
        first_n(placed.drop("_fits"), [query, page], order, 5).groupBy(query, page, key).agg(F.lit(True).alias("_leads"))
    )
    first_page = page_keys.groupBy(query, key).agg(F.min(page).alias("_first"))
    return (
        _on(_on(page_keys, first_page, [query, key]), leading, [query, page, key], "left")
        .groupBy(query, page)
        .agg(
            F.sum("_n").alias("n_rows"),
            F.count_if(F.col("_fits") & (F.col("_first") == F.col(page))).alias("n_new"),
            F.count_if(F.col("_leads")).alias("n_leading"),
            F.coalesce(F.bool_and(F.when(F.col("_leads"), F.col("_first") < F.col(page))), F.lit(False)).alias(
                "all_seen"
            ),
        )
    )


def duplicate_pages(df: DataFrame, order: Sequence, query="query_id", page="page_no", key="posting_key") -> DataFrame:
    """Result pages whose first five postings were all on earlier pages."""
    return page_flags(df, order, None, query, page, key).filter("all_seen").select(query, page, "n_leading")


def cut_pages(
    df: DataFrame,
    order: Sequence,
    fits: Column | None = None,
    page_marks: DataFrame | None = None,
    query="query_id",
    page="page_no",
    key="posting_key",
    stop_at_gaps: bool = True,
) -> DataFrame:
    """Rows on the pages before the first one that ends a search: a page with only seen postings,
    with at most two postings after page 1, or without a new fitting one; a page marked as the end
    in ``page_marks`` (query, page, is_end); or, with ``stop_at_gaps``, a page that is missing."""
    flags = cut_lineage(page_flags(df, order, fits, query, page, key), "page-flags")
    stops = flags.filter(
        F.col("all_seen") | ((F.col("n_leading") <= 2) & (F.col(page) > 1)) | (F.col("n_new") == 0)
    ).select(query, page)
    if stop_at_gaps:
        stops = stops.unionByName(missing_pages(flags, query, page))
    if page_marks is not None:
        stops = stops.unionByName(page_marks.filter("is_end").select(query, page))
    return before_stop(df, stops, query, page)


def missing_pages(pages: DataFrame, query="query_id", page="page_no") -> DataFrame:
    """Page numbers that follow a given page but are not given themselves."""
    following = pages.select(query, (F.col(page) + 1).alias(page))
    given = pages.select(F.col(query).alias("_query"), F.col(page).alias("_page"))
    return following.join(given, F.col(query).eqNullSafe(F.col("_query")) & (F.col(page) == F.col("_page")), "left_anti")


def before_stop(df: DataFrame, stops: DataFrame, query="query_id", page="page_no") -> DataFrame:
    """Rows on pages before the first stop of their search; all rows of a search without one."""
    first_stop = stops.groupBy(query).agg(F.min(page).alias("_stop"))
    return _on(df, first_stop, [query], "left").filter(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")


# --- streaks -------------------------------------------------------------------------------

def failure_streak(
    events: DataFrame,
    source: str,
    order: Sequence[str],
    ok: str = "ok",
    threshold: int = 3,
    chunks: int | None = None,
) -> DataFrame:
    """Consecutive failures per source up to each event; a success resets to 0. Adds streak and
    healthy. Events are cut into ranges of (source, order) of equal size, so that neither a hot
    source nor a hot hour meets in one task; each range hands on one row, from which the streak
    open at the start of the next one follows. Events without a source are one source."""
    streaks = _chunked_streak(events, source, order, ok, chunks)
    return streaks.withColumn("healthy", F.col("streak") < threshold)


def _running_failures(events: DataFrame, keys: Sequence[str], order: Sequence[str], ok: str) -> DataFrame:
    """Adds the failures so far, and that number at the last success."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("_fails", F.sum(F.when(F.col(ok), 0).otherwise(1)).over(running)).withColumn(
        "_at_success", F.max(F.when(F.col(ok), F.col("_fails"))).over(running)
    )


def _streak(running: DataFrame, carry: Column) -> DataFrame:
    """Failures since the last success; without one, those carried in count too."""
    streak = F.coalesce(F.col("_fails") - F.col("_at_success"), F.col("_fails") + carry)
    return running.withColumn("streak", streak).drop("_fails", "_at_success")


def _chunked_streak(events: DataFrame, source: str, order: Sequence[str], ok: str, chunks: int | None) -> DataFrame:
    by = [source, *order]
    ranged = events.repartitionByRange(chunks, *by) if chunks else events.repartitionByRange(*by)
    # The range bounds come from a sample, so the chunk of a row is fixed by writing it down.
    labelled = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()), "event-chunks")
    local = _running_failures(labelled, [source, "_chunk"], order, ok)
    sums = local.groupBy(source, "_chunk").agg(F.max("_fails").alias("_total"), F.max("_at_success").alias("_reset"))
    before = Window.partitionBy(source).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sums.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        # Failures of the source, over all chunks, when the last success of this chunk came.
        .withColumn("_reset_at", F.col("_before") + F.col("_reset"))
        .select(
            source,
            "_chunk",
            (F.col("_before") - F.coalesce(F.max("_reset_at").over(before), F.lit(0))).alias("_carry"),
        )
    )
    return _streak(_on(local, carried, [source, "_chunk"]), F.col("_carry")).drop("_chunk", "_carry")
