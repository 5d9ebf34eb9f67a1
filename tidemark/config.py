"""Every threshold of the judgments in one frozen place; override with ``replace``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # round-trip floors
    max_plausible_rtt_us: int = 30_000_000
    mixed_srtt_ratio: float = 5.0
    far_path_ms: float = 10.0
    same_region_ms: float = 2.0
    # health rows
    tcp_connect_rtt_mult: float = 3.0
    ttfb_rtt_mult: float = 4.0
    tail_rtt_mult: float = 8.0
    p99_rtt_mult: float = 12.0
    min_tail_sample: int = 20
    min_p99_sample: int = 100
    min_judge_sample: int = 3
    rtx_rate_max: float = 0.001
    mss_bytes: int = 1460
    min_directional_bytes: int = 65_536
    min_reuse_sample: int = 5
    reuse_ratio_min: float = 0.8
    max_evidence: int = 5
    # time series
    min_ts_intervals: int = 6
    ts_idle_frac: float = 0.05
    ts_held_fraction: float = 0.8
    ts_ramp_margin: float = 1.2
    ts_bloat_hi: float = 2.0
    ts_bloat_lo: float = 1.2
    agg_bucket_ns: int = 1_000_000_000
    agg_min_cover: float = 0.25
    # scorecard
    sc_min_ops: int = 50
    sc_min_errors: int = 5
    sc_err_rate_floor: float = 0.01
    sc_tail_ratio: float = 10.0
    # diff
    regress_factor: float = 1.25
    improve_factor: float = 0.75
    diff_ms_noise_floor: float = 5.0
    dissimilar_ops_factor: int = 5
    # advisories
    adv_min_ops: int = 50
    churn_single_shot: float = 0.5
    churn_wasted_ms: float = 500.0
    churn_untimed_max: float = 0.2
    fleet_min_pids: int = 20
    fleet_single_shot: float = 0.8
    fleet_min_fresh: int = 100
    serial_overlap_ceil: float = 0.05
    serial_busy_floor_ns: int = 10_000_000_000
    serial_busy_window_frac: float = 0.2
    max_dropped_frac: float = 0.2
    refetch_repeats: int = 3
    refetch_wasted_bytes: int = 100 << 20
    refetch_redundant: int = 1000
    pair_window_ns: int = 1_000_000_000
    min_pairs: int = 20
    pair_ratio_floor: float = 0.2
    max_untimed_frac: float = 0.2
    min_tiny_gets: int = 1000
    tiny_median_ceil: int = 256 << 10
    overhead_floor_ns: int = 10_000_000_000
    size_coverage_floor: float = 0.8
    throttle_rate_floor: float = 0.01
    throttle_min: int = 5
    recovery_window_ns: int = 30_000_000_000
    path_min_conns: int = 5
    rtt_report_floor_us: int = 50_000
    # cache study
    structure_floor: float = 0.10
    ranged_frac_max: float = 0.05
    cooccurrence_window: int = 32
    # geography
    triage_min_ms: float = 10.0
    triage_min_ratio: float = 1.3
    cluster_min_ms: float = 5.0
    cluster_frac: float = 0.25


DEFAULT = Config()
