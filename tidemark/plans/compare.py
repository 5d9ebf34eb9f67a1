"""Captures side by side: providers, workload profiles and a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.operators.quantiles import Stat, exact_quantiles

# Cipher suites shown by name.
CIPHER_NAMES = {
    4865: "TLS_AES_128_GCM_SHA256",
    4866: "TLS_AES_256_GCM_SHA384",
    4867: "TLS_CHACHA20_POLY1305_SHA256",
}


def provider_table(ops: DataFrame, conns: DataFrame) -> DataFrame:
    """Per (tier, provider): srtt, TTFB p50, think time and single-stream MB/s.

    Both inputs carry ``provider`` and ``tier`` tags.
    """
    key = ["tier", "provider"]
    net = exact_quantiles(conns, key, {"srtt": F.when(F.col("srtt_us") > 0, F.col("srtt_us") / 1e3)}, [Stat("srtt_ms", "srtt", "mid")])
    req = exact_quantiles(
        ops,
        key,
        {
            "ttfb": F.when((F.col("ttfb_ns") > 0) & ~F.col("partial"), F.col("ttfb_ns") / 1e6),
            "tput": F.when((F.col("download_ns") > 0) & (F.col("content_length") > 0), F.col("content_length") / F.col("download_ns") * 1e3),
        },
        [Stat("ttfb_p50_ms", "ttfb", "upper"), Stat("mb_per_s", "tput", "mid")],
    )
    return (
        req.join(net, key, "full")
        .select(
            *key,
            F.coalesce("srtt_ms", F.lit(0.0)).alias("srtt_ms"),
            F.coalesce("ttfb_p50_ms", F.lit(0.0)).alias("ttfb_p50_ms"),
            "mb_per_s",
        )
        .withColumn("think_ms", F.col("ttfb_p50_ms") - F.col("srtt_ms"))
    )


def provider_pivot(table: DataFrame, providers: list[str]) -> DataFrame:
    """One row per tier, one think-time and throughput column per provider."""
    return table.groupBy("tier").pivot("provider", providers).agg(
        F.max("think_ms").alias("think_ms"), F.max("mb_per_s").alias("mb_per_s")
    )


def _tally(conns: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return (
        conns.select(key, value.alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(key, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(name))
    )


def profile_verdict(conns: DataFrame, key: str = "profile", cfg: Config = DEFAULT) -> DataFrame:
    """Per workload profile: path medians, loss spread, TLS tallies and a verdict."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    out_heavy = C.send_heavy(cfg)
    med = exact_quantiles(
        conns,
        [key],
        {
            "min": pos("min_rtt_us") / 1e3, "jit": pos("rttvar_us") / 1e3, "srtt": pos("srtt_us") / 1e3,
            "infl": pos("srtt_us") / pos("min_rtt_us"),
        },
        [Stat(f"m_{v}", v, "mid") for v in ("min", "jit", "srtt", "infl")],
    )
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    tot = conns.groupBy(key).agg(
        F.count(F.lit(1)).alias("conns"),
        s("retransmits").alias("retransmits"),
        F.count_if(F.col("retransmits") > 0).alias("lossy_conns"),
        s("rcv_ooopack").alias("out_of_order"),
        s("bytes_retrans").alias("bytes_retrans"),
        s("bytes_sent").alias("_sent"),
        s(F.when(out_heavy, F.col("dsack_dups"))).alias("dsack"),
        F.count_if(out_heavy & F.coalesce("app_limited", F.lit(False))).alias("app_limited"),
        F.coalesce(F.max("reordering"), F.lit(0)).alias("max_reordering"),
    )
    cipher = F.when(F.col("tls_cipher").isNotNull() & (F.col("tls_cipher") != 0),
                    F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("tls_cipher")), 4, "0")))
    for code, name in CIPHER_NAMES.items():
        cipher = F.when(F.col("tls_cipher") == code, name).otherwise(cipher)
    out = (
        tot.join(med, key, "left")
        .join(_tally(conns, key, F.col("tls_version"), "tls_versions"), key, "left")
        .join(_tally(conns, key, cipher, "tls_ciphers"), key, "left")
    )
    infl = F.coalesce("m_infl", F.lit(1.0))
    spread = F.col("lossy_conns") * 5 > F.col("conns")
    return out.select(
        key, "conns",
        *[F.coalesce(f"m_{v}", F.lit(0.0)).alias(n) for v, n in (("min", "min_rtt_ms"), ("jit", "jitter_ms"), ("srtt", "srtt_ms"))],
        infl.alias("inflation"), "retransmits", "lossy_conns", "out_of_order", "bytes_retrans",
        F.when((F.col("bytes_retrans") > 0) & (F.col("_sent") > 0), F.col("bytes_retrans") * 100.0 / F.col("_sent")).alias("retrans_pct"),
        "dsack", "app_limited", "max_reordering", "tls_versions", "tls_ciphers",
        F.when((infl >= 2.0) & ~spread, "bufferbloat").when(infl >= 2.0, "congestion+loss").otherwise("stable").alias("verdict"),
    )


STATUS_MIX = ["http_errors", "s3_throttle", "s3_server_errors", "s3_client_errors"]
OWN_POPULATION = [
    "ttfb_new_p95", "ttfb_new_p99", "ttfb_reused_p95", "ttfb_reused_p99", "dns_cold", "tcp_connect", "ttfb_new", "ttfb_reused",
]
KIND_ORDER = ["new_issue", "regressed", "unjudgeable", "improved", "resolved", "unchanged"]


def populations(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """(finding_id, s3_op, population) of a run: what each watched check could have judged."""
    tot = ops.agg(
        F.count("http_status").alias("answered"), F.count_if(~F.col("partial")).alias("nonpartial"), F.count_if(C.timeable()).alias("good")
    )
    per_row = rows.where(F.col("finding_id").isin(OWN_POPULATION) | (F.col("finding_id") == "s3_ttfb")).select(
        "finding_id", F.coalesce("s3_op", F.lit("")).alias("s3_op"), F.col("judged").alias("population")
    )
    fixed = tot.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("finding_id"), F.lit("").alias("s3_op"), F.col("answered").alias("population")) for i in STATUS_MIX],
                F.struct(F.lit("reuse_rate").alias("finding_id"), F.lit("").alias("s3_op"), F.col("nonpartial").alias("population")),
                F.struct(F.lit("*").alias("finding_id"), F.lit("").alias("s3_op"), F.col("good").alias("population")),
            )
        ).alias("x")
    ).select("x.*")
    return per_row.unionByName(fixed)


def diff(current: DataFrame, baseline: DataFrame, current_pop: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Full outer join of two runs on (finding, operation), classified and ranked.

    Both inputs are report rows; ``current_pop`` comes from ``populations``.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        cmp = F.coalesce("ratio_to_rtt", "value_num")
        mix = F.col("finding_id").isin(STATUS_MIX)
        return df.where(F.col("finding_id") != "run").select(
            F.col("finding_id").alias(f"{p}_id"),
            F.coalesce("s3_op", F.lit("")).alias(f"{p}_op"),
            F.col("severity").alias(f"{p}_sev"),
            F.col("unit").alias(f"{p}_unit"),
            F.col("metric").alias(f"{p}_metric"),
            F.col("judged").alias(f"{p}_n"),
            F.col("ratio_to_rtt").isNotNull().alias(f"{p}_rel"),
            cmp.alias(f"{p}_v"),
            F.when(mix, cmp / F.when(F.col("judged") > 0, F.col("judged"))).otherwise(cmp).alias(f"{p}_g"),
        )

    c, b = side(current, "c"), side(baseline, "b").where(F.col("b_sev") != "unjudged")
    pop = current_pop
    general = pop.where(F.col("finding_id") == "*").select("population")
    own = pop.where(F.col("finding_id") != "*").select(
        F.col("finding_id").alias("p_id"), F.col("s3_op").alias("p_op"), "population"
    )
    j = (
        c.join(b, (F.col("c_id") == F.col("b_id")) & (F.col("c_op") == F.col("b_op")), "full")
        .join(own, (F.col("b_id") == F.col("p_id")) & (F.col("b_op") == F.col("p_op")), "left")
        .withColumn("_general", general.scalar())
    )
    listed = F.col("b_id").isin([*STATUS_MIX, "reuse_rate", *OWN_POPULATION, "s3_ttfb"])
    seen_now = F.when(listed, F.coalesce("population", F.lit(0))).otherwise(F.col("_general"))
    cg, bg = F.col("c_g"), F.col("b_g")
    mix = F.col("c_id").isin(STATUS_MIX)
    least = (
        F.when(mix, 1.0 / F.greatest(F.col("c_n"), F.lit(1)))
        .when(F.col("c_rel"), 0.5)
        .when(F.col("c_unit") == "count", 1.0)
        .when(F.col("c_unit") == "ratio", cfg.rtx_rate_max)
        .when(F.col("c_unit") == "ms", cfg.diff_ms_noise_floor)
        .otherwise(0.0)
    )
    worse, better = bg * cfg.regress_factor, bg * cfg.improve_factor
    higher = (F.col("c_unit") == "bytes_per_s") | (F.col("c_metric") == "reuse_rate")
    change = (
        F.when(bg.isNull(), "unchanged")
        .when(cg.isNull(), "unjudgeable")
        .when(higher & (cg < better), "regressed")
        .when(higher & (cg > worse), "improved")
        .when(higher, "unchanged")
        .when((cg > worse) & (cg - bg >= least), "regressed")
        .when((cg < better) & (bg - cg >= least), "improved")
        .otherwise("unchanged")
    )
    both = F.col("c_id").isNotNull() & F.col("b_id").isNotNull()
    kind = (
        F.when(both & (F.col("c_sev") == "unjudged"), F.when(F.col("b_sev") == "warn", "unjudgeable").otherwise("unchanged"))
        .when(both, change)
        .when(F.col("c_id").isNotNull() & (F.col("c_sev") == "warn"), "new_issue")
        .when(F.col("b_id").isNotNull() & F.col("c_id").isNull() & (F.col("b_sev") == "warn"),
              F.when(seen_now >= F.col("b_n"), "resolved").otherwise("unjudgeable"))
    )
    dark = F.col("c_id").isNull() | (F.col("c_sev") == "unjudged") | (both & bg.isNotNull() & cg.isNull())
    rank = F.lit(len(KIND_ORDER))
    for i, k in enumerate(KIND_ORDER):
        rank = F.when(F.col("kind") == k, i).otherwise(rank)
    return (
        j.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            F.coalesce("c_id", "b_id").alias("finding_id"),
            F.coalesce("c_op", "b_op").alias("s3_op"),
            "kind",
            F.col("b_v").alias("baseline"),
            F.when(~dark, F.col("c_v")).alias("current"),
            F.when(both & (F.col("c_sev") != "unjudged"), F.col("c_sev"))
            .when(F.col("b_id").isNull(), F.col("c_sev"))
            .otherwise(F.col("b_sev"))
            .alias("severity"),
            F.coalesce("c_unit", "b_unit").alias("unit"),
        )
        .withColumn("kind_rank", rank)
    )


VERDICT_RANK = {"HEALTHY": 0, "CHECKS PASSED": 0, "NO BASELINE": 1, "NO OPERATIONS": 1, "NO RESPONSES": 1, "MIXED PATHS": 1, "ATTENTION": 2}


def _verdict_rank(c: Column) -> Column:
    out = F.lit(2)
    for v, r in VERDICT_RANK.items():
        out = F.when(c == v, r).otherwise(out)
    return out


def regression_gate(deltas: DataFrame, current: DataFrame, baseline: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: does the current run fail against the baseline, plain and strict.

    ``current`` and ``baseline`` are the one-row results of ``health.run_verdict``.
    """
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    k = F.col("kind")
    hard = k.isin("new_issue", "unjudgeable")
    lo, hi = F.least("c.operations", "b.operations"), F.greatest("c.operations", "b.operations")
    return (
        deltas.agg(
            any_(hard | ((k == "regressed") & (F.col("severity") != "advisory"))).alias("plain"),
            any_(hard | (k == "regressed")).alias("strict"),
            F.count(F.lit(1)).alias("deltas"),
        )
        .withColumn("c", current.select(F.struct("*")).scalar())
        .withColumn("b", baseline.select(F.struct("*")).scalar())
        .withColumn("worse", _verdict_rank(F.col("c.verdict")) > _verdict_rank(F.col("b.verdict")))
        .select(
            "deltas",
            F.col("b.verdict").alias("baseline_verdict"),
            F.col("c.verdict").alias("current_verdict"),
            (F.col("plain") | F.col("worse")).alias("regressed"),
            (F.col("strict") | F.col("worse")).alias("regressed_strict"),
            ((lo > 0) & (hi >= lo * cfg.dissimilar_ops_factor)).alias("dissimilar"),
        )
    )


def vanished(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline warnings that no current row covers."""
    key = lambda df: df.where(F.col("finding_id") != "run").select(
        "finding_id", F.coalesce("s3_op", F.lit("")).alias("s3_op"), "severity", "judged"
    )
    return key(baseline).where(F.col("severity") == "warn").join(
        key(current).select("finding_id", "s3_op"), ["finding_id", "s3_op"], "left_anti"
    )
