"""Corpus analytics: periodic groups, timing classes, asymmetry, banner changes, rarity, per-source statistics.

All group state is reduced by aggregates that combine before the shuffle, or by windows over one group's rows; nothing
is gathered on the driver. Sample ids are the ten smallest, so results do not depend on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("client_ip", "server_ip", "server_port")
CLEAN_STATES = ("S3_STARTTLS_OK", "S4_TLS_READY", "S4_ENCRYPTED", "S3_TLS_HS")
ABSENT_STATES = ("S1_BANNER_SEEN", "S_NO_STARTTLS", "S1_GREETING")


def first_ids(rows: DataFrame, keys, kinds: dict[str, Column], ident: str = "id", n: int = 10) -> DataFrame:
    """(keys, one array a kind) of the n smallest ids of each kind's rows.

    Only the first n rows of each group and kind pass the shuffle: the plan limits groups before it, however large.
    """
    kind = F.coalesce(*[F.when(c, name) for name, c in kinds.items()])
    x = rows.select(*keys, F.col(ident).alias("__id"), kind.alias("__kind")).where("__kind is not null")
    x = x.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__kind").orderBy("__id"))).where(F.col("__r") <= n)
    return x.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("__kind") == k, F.col("__id")))).alias(k) for k in kinds])


def with_gaps(sessions: DataFrame, keys, ts: str = "first_seen", tie: str = "id", span: float = 86_400.0) -> DataFrame:
    """sessions with `gap`: seconds since the group's row before.

    A group is cut into spans of time, so that one with a large share of all rows is the work of many tasks: rows look
    back within their span, and the first of a span at the end of the group's span before, from one row a span.
    """
    cut = F.floor(F.col(ts) / F.lit(span))
    ends = sessions.groupBy(*keys, cut.alias("__span")).agg(F.max(ts).alias("__end"))
    ends = ends.select(*keys, "__span", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__span")).alias("__before"))
    order = Window.partitionBy(*keys, "__span").orderBy(ts, tie)
    rows = sessions.withColumn("__span", cut).withColumn("__last", F.lag(ts).over(order))
    return rows.join(ends, [*keys, "__span"], "left").withColumn("gap", F.col(ts) - F.coalesce("__last", "__before")).select(*[sessions[c] for c in sessions.columns], "gap")


def beacon_groups(sessions: DataFrame, max_cov: float = 0.30, least: int = 5, keys=GROUP) -> DataFrame:
    """Groups whose gaps vary little: population deviation over mean below max_cov, mean above 0, `least` rows or more."""
    g = with_gaps(sessions, keys).groupBy(*keys).agg(
        F.count("*").alias("n_sessions"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("dev"), F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen"), F.min("id").alias("primary_id")
    )
    return g.where((F.col("n_sessions") >= least) & (F.col("mean_gap") > 0)).withColumn("cov", F.col("dev") / F.col("mean_gap")).where(F.col("cov") < max_cov).drop("dev")


def temporal_groups(sessions: DataFrame, keys=(*GROUP, "protocol"), least: int = 5, max_cv: float = 0.15, persistence: float = 300.0) -> DataFrame:
    """Timing metrics, score and class of each group.

    Null and NaN times are dropped. Only gaps above 0 enter the statistics (sample deviation; 0 with a single gap),
    while n_events counts all rows. Jitter is the coefficient of variation in percent, so its bound (15) and that of the
    coefficient (0.15) are one condition, max_cv, worth both their points. Points: 20 for enough events, 20 for a mean
    gap, 30 and 20 for regular timing, 10 for lasting `persistence` seconds; 70 is a beacon candidate, 40 suspicious.
    """
    rows = sessions.where(F.col("first_seen").isNotNull() & ~F.isnan(F.col("first_seen").cast("double")))
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    g = with_gaps(rows, keys).groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.count(gap).alias("n_gaps"), F.avg(gap).alias("mean_gap"), F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("dev"),
        (F.max("first_seen") - F.min("first_seen")).alias("duration"), F.min("id").alias("primary_id"),
    )
    g = g.withColumn("cv", F.when(F.col("mean_gap") > 0, F.col("dev") / F.col("mean_gap")))
    regular = F.col("cv") < max_cv
    points = F.lit(20) + F.when(F.col("mean_gap") > 0, 20).otherwise(0) + F.when(F.coalesce(regular, F.lit(False)), 30 + 20).otherwise(0) + F.when(F.col("duration") >= persistence, 10).otherwise(0)
    score = F.when(F.col("n_events") < least, 0).otherwise(points)
    kind = F.when(F.col("n_events") < least, "INSUFFICIENT_DATA").when(score >= 70, "BEACON_CANDIDATE").when(score >= 40, "SUSPICIOUS_TIMING").otherwise("NORMAL")
    note = F.when((F.col("mean_gap") >= 50) & (F.col("mean_gap") <= 70) & regular, "regular polling looks alike")
    return g.withColumn("score", score).withColumn("class", kind).withColumn("jitter_pct", F.col("cv") * 100).withColumn("note", note)


def temporal_summary(groups: DataFrame) -> DataFrame:
    is_ = lambda k: F.count_if(F.col("class") == k)
    return groups.agg(F.count("*").alias("n_groups"), is_("BEACON_CANDIDATE").alias("beacons"), is_("SUSPICIOUS_TIMING").alias("suspicious"), is_("NORMAL").alias("normal"), is_("INSUFFICIENT_DATA").alias("insufficient"))


def capability_asymmetry(sessions: DataFrame, keys=("server_ip", "server_port"), clean: Column | None = None, absent: Column | None = None) -> DataFrame:
    """Servers that offer an upgrade in some sessions and not in others."""
    clean = F.col("starttls_state").isin(*CLEAN_STATES) if clean is None else clean
    absent = F.col("starttls_state").isin(*ABSENT_STATES) if absent is None else absent
    g = sessions.groupBy(*keys).agg(F.count_if(clean).alias("n_clean"), F.count_if(absent).alias("n_absent"), F.min(F.when(absent, F.col("id"))).alias("primary_id"))
    ids = first_ids(sessions, keys, {"clean_ids": clean, "absent_ids": absent})
    return g.where("n_clean > 0 and n_absent > 0").join(ids, list(keys))


def banner_mutations(sessions: DataFrame, distance: int = 8, keys=("server_ip", "server_port"), banner: str = "server_banner") -> DataFrame:
    """Pairs of banners of one endpoint that lie `distance` edits apart or more, with the first session of each.

    Distinct banners are paired, not sessions: an endpoint has few of them however many sessions it has.
    """
    firsts = sessions.where(F.coalesce(F.col(banner), F.lit("")) != "").groupBy(*keys, banner).agg(F.min(F.struct("first_seen", "id")).alias("f"))
    a = firsts.select(*keys, F.col(banner).alias("banner_a"), F.col("f").alias("fa"))
    b = firsts.select(*keys, F.col(banner).alias("banner_b"), F.col("f").alias("fb"))
    pairs = a.join(b, list(keys)).where(F.col("fa") < F.col("fb"))
    return pairs.withColumn("distance", F.levenshtein("banner_a", "banner_b")).where(F.col("distance") >= distance).select(*keys, "banner_a", "banner_b", "distance", F.col("fa.id").alias("id_a"), F.col("fb.id").alias("id_b"))


def rare_values(sessions: DataFrame, value: str = "ja3", most: int = 2, corpus: int = 10) -> DataFrame:
    """Values seen at most `most` times in a corpus of `corpus` rows or more, with their share in percent."""
    known = sessions.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    total = sessions.agg(F.count("*").alias("n_total"))  # one row
    g = known.groupBy(value).agg(F.count("*").alias("n"), F.min("id").alias("primary_id"))
    return g.where(F.col("n") <= most).join(F.broadcast(total), F.lit(True)).where(F.col("n_total") >= corpus).withColumn("rarity_pct", F.col("n") * 100.0 / F.col("n_total"))


def source_stats(sessions: DataFrame) -> DataFrame:
    """Per client: sessions, and distinct server names (1 where there are none)."""
    return sessions.groupBy("client_ip").agg(F.count("*").alias("n_sessions"), F.greatest(F.lit(1), F.count_distinct(F.nullif("sni", F.lit("")))).cast("long").alias("n_sni"))


def enriched(sessions: DataFrame, groups: DataFrame, sources: DataFrame, temporal: DataFrame) -> DataFrame:
    """sessions with what the corpus says of them; False, 1, 1 and INSUFFICIENT_DATA where it says nothing."""
    b = groups.select(*GROUP, F.lit(True).alias("is_beacon"))
    t = temporal.select(*GROUP, "protocol", F.col("class").alias("timing"))
    out = sessions.join(b, list(GROUP), "left").join(sources, "client_ip", "left").join(t, [*GROUP, "protocol"], "left")
    return out.withColumns({"is_beacon": F.coalesce("is_beacon", F.lit(False)), "n_sessions": F.coalesce("n_sessions", F.lit(1)), "n_sni": F.coalesce("n_sni", F.lit(1)), "timing": F.coalesce("timing", F.lit("INSUFFICIENT_DATA"))})


def finding(rule: str, severity: str, rows: DataFrame, ident: str, title: Column, evidence: Column) -> DataFrame:
    """Findings with ids that any run makes alike."""
    return rows.select(F.sha2(F.concat_ws("|", F.lit(rule), F.col(ident).cast("string"), title), 256).alias("finding_id"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(ident).cast("string").alias("session_id"), title.alias("title"), evidence.alias("evidence"))


def corpus_findings(sessions: DataFrame, max_cov: float = 0.30) -> DataFrame:
    """All corpus detectors in one schema."""
    where = F.concat_ws(" ", "client_ip", "server_ip", F.col("server_port").cast("string"))
    server = F.concat_ws(":", "server_ip", F.col("server_port").cast("string"))
    as_json = lambda *c: F.to_json(F.struct(*c))
    beacons = finding("CB1_BEACONING_PERIODIC_SESSIONS", "HIGH", beacon_groups(sessions, max_cov), "primary_id", where, as_json("n_sessions", "mean_gap", "cov"))
    strips = finding("D1_CORPUS_CAPABILITY_STRIP", "CRITICAL", capability_asymmetry(sessions), "primary_id", server, as_json("n_clean", "n_absent", "clean_ids", "absent_ids"))
    rare = finding("CB4_JA3_SINGLETON_FINGERPRINT", "MEDIUM", rare_values(sessions), "primary_id", F.col("ja3"), as_json("n", "rarity_pct"))
    timing = finding("TEMPORAL_BEACON_CANDIDATE", "MEDIUM", temporal_groups(sessions).where("class = 'BEACON_CANDIDATE'"), "primary_id", where, as_json("n_events", "mean_gap", "cv", "score"))
    found = [beacons, strips, rare, timing]
    if "server_banner" in sessions.columns:
        found.append(finding("D8_BANNER_MUTATION", "HIGH", banner_mutations(sessions), "id_b", server, as_json("banner_a", "banner_b", "distance")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
