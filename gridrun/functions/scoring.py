"""Column expressions of the field-visit scoring model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridrun.constants import AVG_STRUCTURE_M2, CONFIDENCE_THRESHOLD, ROAD_ACCESS_M, SCORE_WEIGHTS


def rnd(x: Column | str, n: int) -> Column:
    """Half-up rounding that ignores noise below the sixth decimal."""
    return F.round(F.round(x, 6), n)


def clip(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def pct(part: Column, whole: Column) -> Column:
    """100 * part / max(whole, 1)."""
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1)).cast("double")


def access_label(road_pct: Column, is_builtup: Column) -> Column:
    return (F.when(~is_builtup, "n/a").when(road_pct <= 0, "isolated")
            .when(road_pct < 70, "partial").otherwise("connected"))


def score_parts(mean_conf: Column, road_pct: Column, area_m2: Column, water_pct: Column,
                frag: Column, is_builtup: Column) -> dict[str, Column]:
    """The five priority components, each 0..100 with two decimals."""
    risk = clip((F.lit(1.0) - mean_conf) * 100.0)
    iso = F.when(is_builtup, F.when(road_pct <= 0, 100.0).otherwise(clip(F.lit(100.0) - road_pct))).otherwise(clip(risk * 0.6))
    parts = {
        "confidence_risk": risk,
        "isolation_risk": iso,
        "cluster_size": clip(F.sqrt(F.greatest(area_m2, F.lit(1.0))) * 4.0),
        "water_proximity": clip(water_pct),
        "fragmentation_context": clip(F.least(frag * 10.0, F.lit(100.0))),
    }
    return {k: rnd(v, 2) for k, v in parts.items()}


def weighted_total() -> Column:
    return clip(reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in SCORE_WEIGHTS.items()]))


def reason_text() -> Column:
    """Reasons in fixed order, with a default per item type."""
    iso = F.col("isolation_risk") >= 70
    parts = F.concat_ws(
        ", ",
        F.when(iso & (F.col("access") != "n/a"), "poor road access").when(iso, "low-confidence region")
        .when(F.col("access") == "isolated", "isolated from road network"),
        F.when(F.col("confidence_risk") >= 50, "low model confidence"),
        F.when(F.col("cluster_size") >= 40, "large settlement footprint"),
        F.when(F.col("water_proximity") >= 30, "near water body (setback review)"),
        F.when(F.col("fragmentation_context") >= 40, "dispersed settlement context"))
    default = F.when(F.col("item_type") == "uncertain_zone", "model uncertainty requires field confirmation").otherwise(
        "routine verification recommended")
    return F.concat(F.col("label"), F.lit(": "), F.coalesce(F.when(parts != "", parts), default))


def structure_estimate(area_m2: Column) -> Column:
    return F.when(area_m2 <= 0, 0).otherwise(F.greatest(F.lit(1), F.bround(area_m2 / AVG_STRUCTURE_M2).cast("long"))).cast("long")


def priority_line() -> Column:
    """One sentence per queue item."""
    low = F.lower(F.col("label"))
    whole = F.round(F.col("settlement_area_m2")).cast("long").cast("string")
    action = (
        F.when(F.col("item_type") != "settlement_cluster",
               F.concat(F.lit("Confirm classification in "), low, F.lit(" (model uncertain)")))
        .when(F.col("access") == "isolated",
              F.concat(F.lit("Verify isolated "), low, F.lit(f" (no road within {ROAD_ACCESS_M:.0f} m)")))
        .when(F.col("mean_confidence") < CONFIDENCE_THRESHOLD, F.concat(F.lit("Inspect low-confidence "), low))
        .otherwise(F.concat(F.lit("Field-verify "), low, F.lit(" ("), whole, F.lit(" m²)"))))
    return F.concat(F.lit("Priority #"), F.col("rank").cast("string"), F.lit(": "), action)


NO_PRIORITY = "Priority #1: No high-risk zones detected — proceed with spot-check of low-confidence pixels"


def accessibility_score() -> Column:
    """0..100 from access, connectivity and fragmentation."""
    return clip(F.lit(100.0) * (
        F.lit(0.40) * (F.col("builtup_road_access_pct") / 100.0)
        + F.lit(0.30) * (F.col("road_largest_component_pct") / 100.0)
        + F.lit(0.30) * (F.lit(1.0) - F.least(F.col("settlement_fragmentation_index") / 10.0, F.lit(1.0)))))


def recommendations() -> Column:
    """Advice lines from unrounded spatial measures, with a default line."""
    whole = lambda c: F.round(F.round(c, 6)).cast("long").cast("string")
    has_bu = F.col("bu_px") > 0
    rules = F.array_compact(F.array(
        F.when((F.col("road_components") > 5) & (F.col("largest_pct") < 60), F.concat(
            F.lit("Road network is fragmented ("), F.col("road_components").cast("string"),
            F.lit(" segments; largest covers "), whole("largest_pct"),
            F.lit("% of road pixels). Prioritize connectivity gaps for survey."))),
        F.when((F.col("road_pct") < 70) & has_bu, F.concat(
            F.lit("Only "), whole("road_pct"),
            F.lit("% of built-up area is within ~50 m of mapped roads. Field verification recommended for remote settlements."))),
        F.when((F.col("water_pct") > 15) & has_bu, F.concat(
            whole("water_pct"),
            F.lit("% of built-up area is within ~30 m of water bodies. Review setback compliance and flood exposure."))),
        F.when((F.col("clusters") > 0) & (F.col("frag") > 8), F.concat(
            F.lit("Settlement appears dispersed ("), F.col("clusters").cast("string"),
            F.lit(" built-up clusters). Consider cluster-based property mapping workflow.")))))
    default = F.array(F.lit("Infrastructure layout appears coherent. Proceed with automated mapping; "
                            "spot-check low-confidence zones flagged in explainability report."))
    return F.when(F.size(rules) == 0, default).otherwise(rules)
