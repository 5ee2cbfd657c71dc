"""Objects of a scan: component statistics, evidence split, relation reasons, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def component_statistics(labelled: DataFrame, core: Column, uncertain: Column, weak_min: int, min_extent: float, claim_min: int, distance_over: Column | None = None) -> DataFrame:
    """One row per (frame, label): bounds, evidence counts, witness, admission and relation.

    ``claim_min`` has no default: evidence below it never makes a claim. The witness is the first point that
    reaches the least x. A single point's evidence counts as any other's. One shuffle with map-side partial aggregates.
    """
    far = F.when(distance_over, F.col("x")) if distance_over is not None else F.col("x")
    g = labelled.groupBy("frame", "label").agg(
        F.count("*").alias("size"), F.min("point_id").alias("first_point"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y", "z") for f in (F.min, F.max)],
        F.count_if(core).alias("core"), F.count_if(uncertain).alias("uncertain"),
        F.min(F.struct("x", "point_id")).alias("w"), F.min(far).alias("distance"),
    )
    extent = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in ("x", "y", "z")])
    admission = F.when(F.col("size") < weak_min, "below_weak_min").when(extent < min_extent, "below_min_extent").otherwise("admitted")
    relation = F.when(F.col("core") >= claim_min, "intersecting").when(F.col("uncertain") >= claim_min, "unresolved").otherwise("adjacent")
    return g.withColumns({"height": F.col("max_z") - F.col("min_z"), "witness": F.col("w.point_id"), "admission": admission, "relation": relation}).drop("w")


#: Relations and the reasons given for them.
INTERSECTING, UNRESOLVED, ADJACENT, UNKNOWN = "intersecting", "unresolved", "adjacent", "unknown"


def relation_reason(relation: Column, certified: Column, structural: Column, unmeasured: Column, boundary: Column) -> Column:
    """Why an object has its relation; the first that holds. Counts are of the object's own evidence."""
    return (
        F.when(relation == UNKNOWN, "geometry_unavailable")
        .when((relation == INTERSECTING) & (certified > 0), "inside_heuristic_path_and_ground_interval")
        .when(relation == INTERSECTING, "certified_interior_shared_with_structure")
        .when(relation == UNRESOLVED, "envelope_boundary_uncertainty")
        .when(structural > 0, "structure_crossing_envelope")
        .when(unmeasured > 0, "unmeasured_corridor")
        .when(boundary > 0, "envelope_boundary_uncertainty")
        .otherwise("outside_envelope_evidence")
    )


def is_hazard(relation: Column) -> Column:
    return relation.isin(INTERSECTING, UNRESOLVED)


def is_doubt(relation: Column, boundary: Column, structure_distance: Column, claim_min: int, isolation: float) -> Column:
    """Edge evidence on something that doesn't stand next to structure; no structure within reach is null and counts as isolated."""
    return ~is_hazard(relation) & (boundary >= claim_min) & (structure_distance.isNull() | (structure_distance > isolation))


def frame_status(objects: DataFrame, keys: tuple[str, ...], claim_min: int, isolation: float, valid: Column) -> DataFrame:
    """One status per scan from its objects' flags: obstacle, unresolved_obstacle, candidate, no_obstacle_observed or unknown."""
    hazard = is_hazard(F.col("relation"))
    doubt = is_doubt(F.col("relation"), F.col("boundary"), F.col("structure_distance"), claim_min, isolation)
    confirmed = hazard & F.col("confirmed")
    g = objects.groupBy(*keys).agg(
        F.count_if(hazard).alias("hazards"), F.count_if(doubt).alias("doubts"), F.count_if(~hazard & (F.col("unmeasured") > 0)).alias("range_unknown"),
        F.bool_or(confirmed & F.col("certain")).alias("any_certain"), F.bool_or(confirmed).alias("any_confirmed"), F.bool_and(valid).alias("valid"),
    )
    status = (
        F.when(F.col("any_certain"), "obstacle").when(F.col("any_confirmed"), "unresolved_obstacle").when((F.col("hazards") > 0) | (F.col("doubts") > 0), "candidate")
        .when(F.col("valid"), "no_obstacle_observed").otherwise("unknown")
    )
    return g.withColumn("status", status).drop("any_certain", "any_confirmed", "valid")
