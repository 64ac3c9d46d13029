"""Confidence formulas of scene records (PRJ-2..8, PRJ-15, PRJ-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def proposal(region: Column, texts: Column) -> Column:
    return F.least(F.lit(0.92), F.lit(0.38) + F.least(F.lit(0.30), region * F.lit(6.0)) + F.least(F.lit(0.16), texts * F.lit(0.06)))


def evidence(length: Column, start_near: Column, end_near: Column, arrow: Column) -> Column:
    one = lambda flag, weight: F.when(flag, F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(F.lit(0.95), F.lit(0.34) + F.least(F.lit(0.32), length / F.lit(160.0)) + one(start_near, 0.1) + one(end_near, 0.1) + one(arrow, 0.08))


def evidence_kind(start: Column, end: Column) -> Column:
    return F.when(start | end, "arrow").otherwise("orthogonal_connector")


def attachment(port: Column, gap: Column) -> Column:
    return F.greatest(F.lit(0.25), port * (F.lit(1.0) - F.least(F.lit(1.0), gap / F.lit(32.0))))


def candidate(of_evidence: Column, start: Column, end: Column) -> Column:
    return F.least(F.lit(0.97), F.lit(0.64) * of_evidence + F.lit(0.18) * start + F.lit(0.18) * end)


def owner_penalty(owner_kind: Column) -> Column:
    return F.when(owner_kind == "node", F.lit(0.0)).otherwise(F.lit(2.5))


def owner_bonus(owner: Column, nearby_nodes: Column, nearby_containers: Column) -> Column:
    """Taken off for owners that the evidence lists as near; a near node counts more."""
    return F.when(F.array_contains(nearby_nodes, owner), F.lit(4.0)).when(F.array_contains(nearby_containers, owner), F.lit(1.5)).otherwise(F.lit(0.0))


def side_penalty(orientation: Column, side: Column) -> Column:
    across = ((orientation == "horizontal") & side.isin("left", "right")) | ((orientation == "vertical") & side.isin("top", "bottom"))
    return F.when(~orientation.isin("horizontal", "vertical"), F.lit(2.0)).when(across, F.lit(0.0)).otherwise(F.lit(8.0))


def failure_reason(n_start: Column, n_end: Column) -> Column:
    """Why an evidence could not be attached."""
    return (
        F.when((n_start == 0) & (n_end == 0), "no_compatible_ports_near_either_endpoint").when(n_start == 0, "start_endpoint_unattached").when(n_end == 0, "end_endpoint_unattached")
        .otherwise("same_owner_attachment_only")
    )


def node(source: Column) -> Column:
    """Confidence of a node by where its box came from."""
    return F.when(source == "contour", F.lit(0.82)).when(source == "text_anchor", F.lit(0.58)).when(source == "single_text", F.lit(0.62)).otherwise(F.lit(0.34))


def container(nodes: Column) -> Column:
    return F.least(F.lit(0.76), F.lit(0.5) + F.lit(0.08) * nodes)
