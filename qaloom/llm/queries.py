"""The queries of the ten problems and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qaloom.llm import abuse, capping, chunking, grouping, mixing, overlap, packing, pair_defects, scan_noise, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": scan_noise.p1_found,
    "p1_repaired": scan_noise.p1_repaired,
    "p2_found": capping.p2_found,
    "p2_share_capped": capping.p2_share_capped,
    "p3_found": truncation.p3_found,
    "p3_by_source": truncation.p3_by_source,
    "p4_found": pair_defects.p4_found,
    "p4_by_defect": pair_defects.p4_by_defect,
    "p5_found": grouping.p5_found,
    "p5_splits": grouping.p5_splits,
    "p5_split_totals": grouping.p5_split_totals,
    "p6_found": chunking.p6_found,
    "p6_pieces": chunking.p6_pieces,
    "p7_found": overlap.p7_found,
    "p7_by_split_source": overlap.p7_by_split_source,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p9_mixture": mixing.p9_mixture,
    "p9_shares": mixing.p9_shares,
    "p10_found": abuse.p10_found,
    "p10_scores": abuse.p10_scores,
    "p10_rates": abuse.p10_rates,
}

ORACLE_SQL: dict[str, str] = {
    "p2_found": capping.P2_FOUND_SQL,
    "p2_share_capped": capping.P2_SHARE_CAPPED_SQL,
    "p6_found": chunking.P6_FOUND_SQL,
    "p7_found": overlap.P7_FOUND_SQL,
    "p7_by_split_source": overlap.P7_BY_SPLIT_SOURCE_SQL,
}
