"""Operators over ordered pages, runs and alerts."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrays import dedupe_urls
from ..functions.text import normalize_purpose
from ..session import at_once, work_dir
from .dedup import keep_first

PAGES_PER_BLOCK = 1024
#: Blocks of one key's time line that a task puts in order.
CHUNK = 1024


def running(
    df: DataFrame, by: list[str], order: str, sums=(), maxima=(), marks: dict[str, tuple[str, str]] | None = None,
    previous=(), block: int = PAGES_PER_BLOCK,
) -> DataFrame:
    """Running sums and maxima up to each row, as ``<name>_upto``, for an integer order column.

    ``marks`` names columns to add with the running sum of a counter at the latest row with a
    flag, as {name: (flag, counter)}; ``previous`` names columns whose value on the row numbered
    one lower is added as ``prev_<name>``.

    Done in two levels, so that no task ever holds one run's whole log: rows are accumulated
    inside blocks of the order column, the block totals (a thousandth of the rows) are carried
    forward, and the two are put together.
    """
    marks = marks or {}
    keys = [*by, "_block"]
    within = W.partitionBy(*keys).orderBy(order)
    upto = within.rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    row = F.struct(order, *previous)

    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumns({
        **{f"_i_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums},
        **{f"_i_{c}": F.max(c).over(upto) for c in maxima},
        "_prev": F.lag(row).over(within),
    })
    at_flag = {m: F.max(F.when(F.col(flag), F.col(f"_i_{n}"))).over(upto) for m, (flag, n) in marks.items()}
    rows = rows.withColumns({f"_i_{m}": c for m, c in at_flag.items()})
    totals = rows.groupBy(*keys).agg(
        F.max_by(row, order).alias("_c_prev"),
        *[F.sum(c).alias(f"_c_{c}") for c in sums],
        *[F.max(c).alias(f"_c_{c}") for c in maxima],
        *[F.max(f"_i_{m}").alias(f"_c_{m}") for m in marks],
    )
    carried = totals.withColumns({
        "_c_prev": F.lag("_c_prev").over(W.partitionBy(*by).orderBy("_block")),
        **{f"_c_{c}": F.coalesce(F.sum(f"_c_{c}").over(before), F.lit(0)) for c in sums},
        **{f"_c_{c}": F.max(f"_c_{c}").over(before) for c in maxima},
    })
    # A mark is relative to its block until the counter's sum before the block is added.
    carried = carried.withColumns({f"_c_{m}": F.col(f"_c_{m}") + F.col(f"_c_{n}") for m, (_, n) in marks.items()})
    carried = carried.withColumns({f"_c_{m}": F.max(f"_c_{m}").over(before) for m in marks})
    prev = F.coalesce("_prev", "_c_prev")
    adjacent = prev[order] == F.col(order) - 1
    return rows.join(carried, keys).select(
        *df.columns,
        *[(F.col(f"_i_{c}") + F.col(f"_c_{c}")).alias(f"{c}_upto") for c in sums],
        *[F.greatest(f"_i_{c}", f"_c_{c}").alias(f"{c}_upto") for c in maxima],
        *[F.coalesce(F.col(f"_i_{m}") + F.col(f"_c_{n}"), F.col(f"_c_{m}")).alias(m) for m, (_, n) in marks.items()],
        *[F.when(adjacent, prev[c]).alias(f"prev_{c}") for c in previous],
    )


def _rate(invalid: Column, seen: Column) -> Column:
    return F.coalesce(F.try_divide(invalid.cast("double"), F.nullif(seen, F.lit(0))), F.lit(0.0))


def cumulative_invalid_rate(pages: DataFrame, by: list[str], limit: float = 0.25) -> DataFrame:
    """Share of invalid cards so far at each page, flagged where it passes the limit."""
    so_far = running(pages.select(*by, "page", "raw_cards", "invalid_cards"), by, "page", ["raw_cards", "invalid_cards"])
    rate = _rate(F.col("invalid_cards_upto"), F.col("raw_cards_upto"))
    return so_far.withColumn("rate", rate).withColumn("over_limit", F.col("rate") > limit)


def page_ids(cards: DataFrame, by: list[str], key: str = "external_id") -> DataFrame:
    """Per page: cards, distinct ids, ids no earlier page had, ids the page before had too.

    Sets of ids are compared by counting, so none is ever gathered in one place. The window runs
    over one id's distinct pages in one run.
    """
    named = F.col("_id").isNotNull() & (F.col("_id") != "")
    rows = cards.groupBy(*by, "page", F.col(key).alias("_id")).agg(F.count("*").alias("_cards"))
    earlier = F.lag("page").over(W.partitionBy(*by, "_id").orderBy("page"))
    marked = rows.withColumn("_earlier", earlier)
    return marked.groupBy(*by, "page").agg(
        F.sum("_cards").alias("cards"),
        F.count_if(named).alias("ids"),
        F.count_if(named & F.col("_earlier").isNull()).alias("novel"),
        F.count_if(named & (F.col("_earlier") == F.col("page") - 1)).alias("shared"),
    )


def _repeats() -> Column:
    """Whether a page has exactly the ids of the one before, given ``ids``, ``shared`` and ``prev_ids``."""
    return (F.col("page") > 1) & (F.col("ids") == F.col("shared")) & F.col("prev_ids").eqNullSafe(F.col("shared"))


def repeated_page(cards: DataFrame, by: list[str], key: str = "external_id") -> DataFrame:
    """Pages with exactly the ids of the page before."""
    pages = running(page_ids(cards, by, key).filter("ids > 0"), by, "page", previous=["ids"])
    return pages.select(*by, "page", "ids", _repeats().alias("repeated"))


def _stale_streak() -> Column:
    """How many pages running, up to this one, brought no new id."""
    return F.col("n_pages_upto") - F.coalesce("fresh_at", F.lit(0))


FRESH = {"fresh_at": ("is_fresh", "n_pages")}


def novel_ids(cards: DataFrame, by: list[str], key: str = "external_id") -> DataFrame:
    """Ids of each page, those no earlier page had, and how many pages running had none."""
    pages = page_ids(cards, by, key).filter("ids > 0")
    pages = pages.withColumns({"n_pages": F.lit(1), "is_fresh": F.col("novel") > 0})
    upto = running(pages, by, "page", ["novel", "n_pages"], marks=FRESH)
    return upto.select(
        *by, "page", "ids", "novel", F.col("novel_upto").alias("ids_upto"), _stale_streak().alias("stale_streak")
    )


def crawl_stop_reason(
    pages: DataFrame,
    cards: DataFrame,
    by: list[str],
    max_invalid_rate: float = 0.25,
    delta_stale_pages: int = 3,
    limit: int = 0,
    max_pages: int = 0,
) -> DataFrame:
    """Why each crawl stopped and whether it counts as complete.

    ``pages`` holds run keys, mode, page (1, 2, …), url, next_url, http_status, parse_failed,
    raw_cards, invalid_cards and reported_total. Each page's own reason to stop depends on the
    pages before it only, so all are worked out at once and the lowest page with one is taken.
    """
    if max_pages > 0:
        pages = pages.filter(F.col("page") <= max_pages)
    count = lambda c: F.coalesce(c, F.lit(0))
    first_visit = pages.groupBy(*by, "url").agg(F.min("page").alias("_first_visit"))
    log = (
        pages.join(page_ids(cards, by), [*by, "page"], "left")
        .withColumns({
            "raw_cards": F.coalesce(F.nullif("raw_cards", F.lit(0)), "cards", F.lit(0)),
            "ids": count("ids"), "novel": count("novel"), "shared": count("shared"),
            "n_pages": (count("ids") > 0).cast("int"), "is_fresh": count("novel") > 0,
        })
        .join(first_visit, [*by, "url"], "left")
    )
    log = running(
        log, by, "page", ["raw_cards", "invalid_cards", "novel", "n_pages"], marks=FRESH, previous=["next_url", "ids"]
    )
    log = log.withColumn("stale_streak", _stale_streak()).withColumn(
        "rate", _rate(F.col("invalid_cards_upto"), F.col("raw_cards_upto"))
    )

    full, later = F.col("mode") == "full", F.col("page") > 1
    visited = F.col("_first_visit") < F.col("page")
    code = F.col("http_status")
    no_ids = F.col("ids") == 0
    patience = F.when(full, 1).otherwise(max(1, delta_stale_pages))
    # The reasons by name, in the order in which a page is tested.
    reason = (
        F.when(visited & F.col("prev_next_url").isNotNull(), "repeated_next_url")
        .when(visited, "repeated_listing_url")
        .when((code == 404) & later, "http_404")
        .when(code >= 400, F.concat(F.lit("http_"), code))
        .when(F.col("parse_failed"), "parse_error")
        .when(F.col("rate") > max_invalid_rate, "invalid_card_rate")
        .when(no_ids & (F.col("reported_total") > 0), "reported_total_without_cards")
        .when(no_ids, "no_cards")
        .when(_repeats(), "repeated_page")
        .when(later & (F.col("novel") == 0) & (F.col("stale_streak") >= patience), "no_new_external_ids")
        .when(F.lit(limit > 0) & (F.col("novel") > 0) & (F.col("novel_upto") >= limit), "limit")
    )
    clean = F.col("_reason").isin("no_cards", "limit") | ((F.col("_reason") == "http_404") & later) | (
        F.col("_reason").isin("repeated_page", "no_new_external_ids") & ~full
    )
    stops = log.withColumn("_reason", reason).withColumn("_clean", clean)
    fetched = ~F.col("_reason").isin("repeated_next_url", "repeated_listing_url") & ~F.col("_reason").startswith("http_")
    at = F.when(F.col("_reason").isNotNull(), F.col("page"))
    per_run = stops.groupBy(*by).agg(
        F.min(at).alias("stop_page"),
        F.min_by("_reason", at).alias("stopped_reason"),
        F.min_by("_clean", at).alias("completed"),
        F.min_by(F.col("page") - 1 + fetched.cast("int"), at).alias("pages_fetched"),
        F.max("page").alias("_pages"),
    )
    ran_out = F.col("stop_page").isNull()
    return per_run.select(
        *by,
        "stop_page",
        F.when(ran_out, F.lit("max_pages" if max_pages > 0 else None)).otherwise(F.col("stopped_reason")).alias("stopped_reason"),
        F.when(ran_out, F.lit(max_pages <= 0)).otherwise(F.col("completed")).alias("completed"),
        F.coalesce("pages_fetched", "_pages").cast("bigint").alias("pages_fetched"),
    )


def last_full_count(runs: DataFrame, lookback: int | None = None) -> DataFrame:
    """For each run the listings of the latest earlier successful full run of equal scope.

    ``runs`` has run_id, source_key, mode, status, scope_json, finished_at, listings_seen, one row
    a crawl; a count in its ``summary`` JSON, if it has one, goes before the column. With ``lookback``
    only so many latest successful full runs of the source are looked at.
    """
    kept = runs.columns
    if "summary" in kept:
        told = F.nullif(F.get_json_object("summary", "$.listings_seen").try_cast("bigint"), F.lit(0))
        runs = runs.withColumn("_seen", F.coalesce(told, "listings_seen"))
    else:
        runs = runs.withColumn("_seen", F.col("listings_seen"))
    good = F.coalesce((F.col("mode") == "full") & (F.col("status") == "success"), F.lit(False))
    when = [F.col("finished_at").asc_nulls_first(), F.col("run_id").asc()]
    before = W.partitionBy("source_key").orderBy(*when).rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy("source_key", "scope_json").orderBy(*when).rowsBetween(W.unboundedPreceding, -1)
    counted = runs.withColumn("_good", good).withColumn("_n", F.coalesce(F.sum(F.col("_good").cast("int")).over(before), F.lit(0)))
    last = F.last(F.when(F.col("_good"), F.struct("_seen", "_n")), ignorenulls=True).over(same)
    return (
        counted.withColumn("_last", last)
        .withColumn("previous_count", F.col("_last._seen") if lookback is None else F.when(
            F.col("_n") - F.col("_last._n") <= lookback, F.col("_last._seen")))
        .select(*kept, "previous_count")
    )


def price_history(events: DataFrame, entity: DataFrame | None = None, by_purpose: bool = False) -> DataFrame:
    """Prices of CREATED and PRICE_CHANGED events; order by listing, time and sequence to read."""
    price = F.get_json_object("new_value", "$.price")
    rows = events.filter(F.col("event_type").isin("CREATED", "PRICE_CHANGED")).withColumn("price", price.try_cast("decimal(12,2)"))
    if entity is not None:
        rows = rows.join(entity.select("listing_id").distinct(), "listing_id", "left_semi")
    extra = [F.get_json_object("new_value", "$.purpose").alias("purpose")] if by_purpose else []
    return rows.filter("price IS NOT NULL").select("listing_id", *extra, "detected_at", "seq", "price")


def price_changes(sightings: DataFrame, entity: list[str], run: str, order: list[str]) -> DataFrame:
    """A row wherever an entity's price in a purpose differs from its previous sighting.

    A run counts once for each (entity, purpose), with its first card; what the window then sorts
    is bounded by the number of runs, however many cards a busy entity has.
    """
    cards = sightings.withColumn("purpose", normalize_purpose("purpose"))
    once = keep_first(cards.select(*entity, "purpose", run, *order, "price"), [*entity, "purpose", run], order)
    w = W.partitionBy(*entity, "purpose").orderBy(run)
    moved = once.withColumn("old_price", F.lag("price").over(w)).withColumn("_n", F.row_number().over(w))
    return moved.filter((F.col("_n") > 1) & ~F.col("price").eqNullSafe(F.col("old_price"))).select(
        *entity, "purpose", run, "old_price", F.col("price").alias("new_price")
    )


def positions(df: DataFrame, keys: list[str], arr: Column, name: str = "url") -> DataFrame:
    """The distinct addresses of an array as rows with their place, counted from 1; tracking is dropped."""
    return df.select(*keys, F.posexplode(dedupe_urls(arr)).alias("_p", name)).select(
        *keys, (F.col("_p") + 1).alias("position"), name
    )


def _chain(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For each time the index of the first time at least the cooldown later."""
    return np.searchsorted(times, times + cooldown, side="left")


def _exits(key_cols: list[str], cooldown: int, width: int):
    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        nxt = np.append(_chain(times, cooldown), len(times))
        last = np.arange(len(times) + 1)
        for i in range(len(times) - 1, -1, -1):
            last[i] = i if nxt[i] == len(times) else last[nxt[i]]
        # An alert can come first only up to one cooldown into the block.
        reach = np.searchsorted(times, pdf["_block"].iloc[0] * width + cooldown, side="left") + 1
        exits = times[last[: min(reach, len(times))]]
        ends = np.append(np.flatnonzero(np.diff(exits)), len(exits) - 1)
        head = {c: pdf[c].iloc[0] for c in [*key_cols, "_block"]}
        return pd.DataFrame({**head, "_upto": times[ends], "_exit": exits[ends]})

    return summarise


def _next_blocks(summaries: DataFrame, key: list[str]) -> DataFrame:
    """Every block of a key with the first exit of the next block that the key has, found inside chunks
    of blocks first and then over the chunks, so that no task orders all blocks of a key."""
    chunk = [*key, "_chunk"]
    blocks = summaries.groupBy(*key, "_block").agg(F.min_by("_exit", "_upto").alias("_first"))
    blocks = blocks.withColumn("_chunk", F.floor(F.col("_block") / CHUNK))
    in_chunk = W.partitionBy(*chunk).orderBy("_block")
    step = lambda w: F.lead(F.struct(F.col("_block").alias("to"), F.col("_first").alias("exit"))).over(w)
    heads = blocks.groupBy(*chunk).agg(F.min_by(F.struct(F.col("_block").alias("to"), F.col("_first").alias("exit")), "_block").alias("_head"))
    heads = heads.withColumn("_later", F.lead("_head").over(W.partitionBy(*key).orderBy("_chunk"))).select(*chunk, "_later")
    return blocks.withColumn("_near", step(in_chunk)).join(heads, chunk).select(*key, "_block", F.coalesce("_near", "_later").alias("_next"))


def _entries(summaries: DataFrame, key: list[str], cooldown: int) -> DataFrame:
    """``_last`` per block that a chain enters: the alert kept before it, NULL for a key's first block.

    A chain leaves a block with one of its exits, and from there enters a later block and leaves that
    with an exit again. These steps are doubled by joins, so the exits that a key's chain passes are
    found in as many rounds as the number of its blocks has binary digits.
    """
    exits = summaries.select(*key, "_block", "_exit").distinct()
    ready = F.col("_exit") + cooldown
    ahead = summaries.select(*key, (F.col("_block") - 1).alias("_block"), "_upto", F.col("_exit").alias("_to_exit"))
    direct = exits.join(ahead, [*key, "_block"]).filter(F.col("_upto") >= ready).groupBy(*key, "_block", "_exit").agg(F.min_by("_to_exit", "_upto").alias("_to_exit"))
    after = _next_blocks(summaries, key)
    # With nothing late enough in the block right after, the chain goes on in the first one beyond it.
    thirds = after.select(*key, F.col("_block").alias("_near"), F.col("_next").alias("_third"))
    beyond = after.withColumn("_near", F.col("_next.to")).join(thirds, [*key, "_near"], "left")
    far = F.when(F.col("_near") > F.col("_block") + 1, F.col("_next")).otherwise(F.col("_third"))
    steps = exits.join(beyond.select(*key, "_block", far.alias("_far")), [*key, "_block"]).join(direct, [*key, "_block", "_exit"], "left")
    hit = F.col("_to_exit").isNotNull()
    steps = steps.select(
        *key, "_exit", F.when(hit, F.col("_block") + 1).otherwise(F.col("_far.to")).alias("_to"), F.coalesce("_to_exit", "_far.exit").alias("_to_exit")
    ).filter("_to IS NOT NULL")
    opens = summaries.groupBy(*key).agg(F.min(F.struct("_block", "_upto", "_exit")).alias("_s"))
    opens = opens.select(*key, "_s._block", "_s._exit")
    steps, opens = at_once(*[lambda d=d, n=n: _worked(d, n) for d, n in ((steps, "cooldown-steps"), (opens, "cooldown-opens"))])
    passed, jumps = opens.select(*key, "_exit"), steps.select(*key, "_exit", "_to_exit")
    while not jumps.isEmpty():
        moved = passed.join(jumps, [*key, "_exit"]).select(*key, F.col("_to_exit").alias("_exit"))
        second = jumps.select(*key, F.col("_exit").alias("_to_exit"), F.col("_to_exit").alias("_beyond"))
        twice = jumps.join(second, [*key, "_to_exit"]).select(*key, "_exit", F.col("_beyond").alias("_to_exit"))
        further = passed.union(moved)
        passed, jumps = at_once(*[lambda d=d, n=n: _worked(d, n) for d, n in ((further, "cooldown-passed"), (twice, "cooldown-jumps"))])
    first = opens.select(*key, "_block", F.lit(None).cast("bigint").alias("_last"))
    return first.union(steps.join(passed, [*key, "_exit"]).select(*key, F.col("_to").alias("_block"), F.col("_exit").alias("_last")))


def _worked(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared work folder, for rounds that build on each other."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _emitted(key_cols: list[str], cooldown: int):
    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        last = pdf["_last"].iloc[0]
        nxt = _chain(times, cooldown)
        i = 0 if pd.isna(last) else int(np.searchsorted(times, int(last) + cooldown, side="left"))
        picked = []
        while i < len(times):
            picked.append(times[i])
            i = nxt[i]
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in key_cols}, "_t": picked})

    return emit


def cooldown_suppress(
    alerts: DataFrame, key: list[str], ts: str, minutes: int, tiebreak: str, blocks_of: int = 32
) -> DataFrame:
    """Per key the first alert, then each that comes the cooldown or more after the last kept one.

    Keeping is greedy, so each choice hangs on the one before. To spread a key with very many
    alerts over tasks, its time line is cut into blocks of a few cooldowns: every block is first
    summed up by where a chain that enters it would leave it, from these short summaries pointer
    doubling finds the state each block starts from, and then all blocks choose at once. Works while
    it is called, as the rounds build on each other; NULL keys and times are never kept.
    """
    if minutes <= 0:
        return alerts
    cooldown = minutes * 60_000_000
    width = cooldown * blocks_of
    timed = alerts.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    timed = timed.filter(reduce(and_, [F.col(c).isNotNull() for c in [*key, "_t"]]))
    first = timed.groupBy(*key, "_t").agg(F.min(tiebreak).alias(tiebreak))
    times = first.select(*key, "_t", F.floor(F.col("_t") / F.lit(width)).alias("_block"))
    types = dict(alerts.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in key)
    summaries = times.groupBy(*key, "_block").applyInPandas(
        _exits(key, cooldown, width), f"{keys}, _block bigint, _upto bigint, _exit bigint"
    )
    entries = _entries(_worked(summaries, "cooldown-exits"), key, cooldown)
    kept = times.join(entries, [*key, "_block"]).groupBy(*key, "_block").applyInPandas(
        _emitted(key, cooldown), f"{keys}, _t bigint"
    )
    winners = first.join(kept, [*key, "_t"], "left_semi")
    return timed.join(winners, [*key, "_t", tiebreak], "left_semi").select(*alerts.columns)
