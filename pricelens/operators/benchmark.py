"""Price benchmarks of all variants at once: window with expansion, tier, robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numbers import gap, months_before, percentile_won

from .dealsets import occurrence_set, pricing_set, signal_set

EXPAND_LIMIT, LEAST_FILL = 12, 7
#: The notes of a signal.
NO_LINE, WEAKENED, UNMEASURED = "굿딜라인 미확립", "신선도 약화", "수집 기록 없음(신선도는 현재 시각 기준)"


def aged(deals: DataFrame, now: Column) -> DataFrame:
    """The pricing sample up to now, with age: the least width in months that holds a deal, null beyond EXPAND_LIMIT."""
    seen = pricing_set(deals).filter(F.col("first_seen") <= now)
    return seen.withColumn("age", F.coalesce(*(F.when(F.col("first_seen") >= months_before(now, m), m) for m in range(1, EXPAND_LIMIT + 1))))


def chosen_width(held: Column, period: Column, k: Column) -> Column:
    """The window's width, from held, the number of deals for each width: the first from the period on that has max(7, K + 2), or else all there is."""
    fill = F.greatest(k + 2, F.lit(LEAST_FILL))
    least = F.filter(F.sequence(period, F.lit(EXPAND_LIMIT)), lambda m: (F.element_at(held, m) >= fill) | (F.element_at(held, m) == F.element_at(held, EXPAND_LIMIT)))
    return F.when(period >= EXPAND_LIMIT, period).otherwise(F.get(least, F.lit(0)))


def counts_by_width() -> Column:
    return F.array(*(F.count_if(F.col("age") <= m) for m in range(1, EXPAND_LIMIT + 1)))


def effective(deals: DataFrame, params: DataFrame, now: Column) -> DataFrame:
    """variant_id, effective_months of every variant of params; the period itself where no deal is held.

    Deals are counted by the first month width that holds them: one aggregate
    in place of a scan for each width.
    """
    counts = aged(deals, now).groupBy("variant_id").agg(counts_by_width().alias("held"))
    df = params.select("variant_id", "period_months", "k_display").join(counts, "variant_id", "left")
    return df.select("variant_id", F.coalesce(chosen_width(F.col("held"), F.col("period_months"), F.col("k_display")), F.col("period_months")).alias("effective_months"))


def windowed(deals: DataFrame, params: DataFrame, now: Column) -> DataFrame:
    """The pricing sample in each variant's window, with its width effective_months.

    A window of fewer deals than max(7, K + 2) grows a month at a time, up to
    12, to the first width that is enough or else the first that holds as many
    as the widest.
    """
    sample = pricing_set(deals).filter(F.col("first_seen") <= now).join(effective(deals, params, now), "variant_id")
    return sample.filter(F.col("first_seen") >= months_before(now, F.col("effective_months")))


def outlier_listing(deals: DataFrame, params: DataFrame, now: Column) -> DataFrame:
    """variant_id, deal_event_id, price_first, outlier_flag of the flagged deals in each variant's effective window, excluded and unclassified ones too."""
    df = deals.filter((F.col("outlier_flag") != "NONE") & (F.col("first_seen") <= now)).join(effective(deals, params, now), "variant_id")
    return df.filter(F.col("first_seen") >= months_before(now, F.col("effective_months"))).select("variant_id", "deal_event_id", "price_first", "outlier_flag")


def sparse_cases(deals: DataFrame, params: DataFrame, now: Column) -> DataFrame:
    """variant_id, deal_event_id, price_first, first_seen: the cases that a SPARSE variant shows in place of statistics, fewer than K each."""
    sample = windowed(deals, params, now)
    sparse = sample.groupBy("variant_id").agg(F.count("*").alias("n")).join(params.select("variant_id", "k_display"), "variant_id").filter("n < k_display").select("variant_id")
    return sample.join(sparse, "variant_id", "left_semi").select("variant_id", "deal_event_id", "price_first", "first_seen")


def benchmark(deals: DataFrame, params: DataFrame, now: Column) -> DataFrame:
    """One row per variant of params: tier, n, m, median, P25 and lowest of cross-verified deals, latest deal, gaps, and the lowest case of a SPARSE sample.

    Statistics are null unless the sample is SUFFICIENT; ties go to the least deal id.
    """
    cross = F.when(F.col("n_sites") >= 2, F.col("price_first"))
    age = -F.unix_micros(F.col("first_seen").cast("timestamp"))
    got = windowed(deals, params, now).groupBy("variant_id", "effective_months").agg(
        F.count("*").alias("n"), F.count(cross).alias("m"), percentile_won(F.col("price_first"), 0.5).alias("median"), percentile_won(cross, 0.25).alias("p25"),
        F.min(cross).alias("low"), F.min("price_first").alias("least"), F.min(F.struct(age.alias("age"), "deal_event_id", "price_first")).alias("latest"),
    )
    df = params.join(got, "variant_id", "left")
    n = F.coalesce("n", F.lit(0))
    tier = F.when(n == 0, "NONE").when(n >= F.col("k_display"), "SUFFICIENT").otherwise("SPARSE")
    full = lambda c: F.when(tier == "SUFFICIENT", F.col(c))
    df = df.select(
        "variant_id", tier.alias("tier"), n.cast("long").alias("n"), F.coalesce("m", F.lit(0)).cast("long").alias("m"), full("median").alias("benchmark_price"), full("p25").alias("good_deal_line"), full("low").alias("period_lowest"),
        F.when(F.col("effective_months") > F.col("period_months"), F.col("effective_months")).cast("int").alias("expanded_to_months"), F.col("latest.price_first").alias("latest_price"), "current_price",
        F.when(tier == "SPARSE", F.col("least")).alias("lowest_case"),
    )
    won, pct = gap(F.col("current_price"), F.col("benchmark_price"))
    low_won, low_pct = gap(F.col("current_price"), F.col("period_lowest"))
    return df.withColumn("gap_won", won).withColumn("gap_pct", pct).withColumn("gap_lowest_won", low_won).withColumn("gap_lowest_pct", low_pct)


def signal(deals: DataFrame, view: DataFrame, last_poll: Column, fresh_hours: int = 48, qualify_days: int = 7) -> DataFrame:
    """variant_id, color, established, best_price, weakened: the traffic light of each row of a benchmark view."""
    staleness = F.unix_micros(last_poll.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    hour = 3_600_000_000
    live = signal_set(deals).withColumn("stale", staleness).filter(F.col("stale") <= qualify_days * 24 * hour)
    best = live.groupBy("variant_id").agg(F.min(F.struct("price_last", "deal_event_id", "stale")).alias("best"))
    df = view.join(best, "variant_id", "left")
    price, sufficient = F.col("best.price_last"), F.col("tier") == "SUFFICIENT"
    color = F.when(~sufficient, "GRAY").when(price.isNull(), "RED").when(price <= F.col("good_deal_line"), "GREEN").when(price <= F.col("benchmark_price"), "YELLOW").otherwise("RED")
    return df.select("variant_id", color.alias("color"), F.col("good_deal_line").isNotNull().alias("established"), F.when(sufficient, price).alias("best_price"), F.coalesce(sufficient & (F.col("best.stale") > fresh_hours * hour), F.lit(False)).alias("weakened"))


def signal_notes(signals: DataFrame, excluded: DataFrame, measured: Column) -> DataFrame:
    """variant_id, color, notes of signal rows: what weakens a signal, in this order; excluded holds (variant_id, n) deals that keywords took out."""
    df = signals.join(excluded, "variant_id", "left")
    notes = F.array(
        F.when((F.col("color") != "GRAY") & ~F.col("established"), NO_LINE), F.when(F.col("weakened"), WEAKENED),
        F.when(F.col("n") > 0, F.concat(F.lit("제외 키워드로 "), F.col("n").cast("string"), F.lit("건 제외"))), F.when(~measured, UNMEASURED),
    )
    return df.select("variant_id", "color", F.array_compact(notes).alias("notes"))


def observation_clock(polls: DataFrame, now: Column) -> DataFrame:
    """at, measured: the least of the sites' last successes (site, last_ok), or now, not measured, where no site has any."""
    return polls.agg(F.min("last_ok").alias("m")).select(F.coalesce("m", now).alias("at"), F.col("m").isNotNull().alias("measured"))


def cadence(deals: DataFrame, now: Column, period_months: int = 6, k: int = 5) -> DataFrame:
    """variant_id, event_count, guard_met, interval_median_days, elapsed_days, observed_months of the occurrence set.

    The window starts at the later of now less the period and the variant's
    first deal of any kind; gaps are whole days. A variant's deals are sorted
    in one task of the window function.
    """
    from pyspark.sql import Window

    observed = deals.groupBy("variant_id").agg(F.min("first_seen").alias("observed_from"))
    seen = occurrence_set(deals).join(observed, "variant_id").filter((F.col("first_seen") >= F.col("observed_from")) & (F.col("first_seen") <= now))
    inside = F.col("first_seen") >= months_before(now, period_months)
    order = Window.partitionBy("variant_id", "inside").orderBy("first_seen")
    days = F.timestamp_diff("DAY", F.lag("first_seen").over(order), F.col("first_seen"))
    seen = seen.withColumn("inside", inside).withColumn("gap", F.when(F.col("inside"), days))
    df = seen.groupBy("variant_id").agg(F.count_if("inside").alias("event_count"), percentile_won(F.col("gap"), 0.5).alias("median"), F.max("first_seen").alias("last"), F.first("observed_from").alias("since"))
    guard = F.col("event_count") >= k
    return df.select("variant_id", "event_count", guard.alias("guard_met"), F.when(guard & (F.col("event_count") >= 2), F.col("median")).alias("interval_median_days"), F.timestamp_diff("DAY", F.col("last"), now).alias("elapsed_days"), F.timestamp_diff("MONTH", F.greatest(F.col("since"), months_before(now, period_months)), now).alias("observed_months"))
