"""Label vocabularies, biome regrouping and trend classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published category names.
DESERT = ["Deserts & Xeric Shrublands"]
TROPICAL = [
    "Tropical & Subtropical Coniferous Forests",
    "Tropical & Subtropical Moist Broadleaf Forests",
    "Tropical & Subtropical Dry Broadleaf Forests",
]
TEMPERATE = [
    "Mediterranean Forests, Woodlands & Scrub",
    "Temperate Conifer Forests",
    "Temperate Broadleaf & Mixed Forests",
]
BOREAL = ["Boreal Forests/Taiga"]
GRASSLAND = [
    "Tropical & Subtropical Grasslands, Savannas & Shrublands",
    "Temperate Grasslands, Savannas & Shrublands",
    "Montane Grasslands & Shrublands",
    "Flooded Grasslands & Savannas",
]
NOT_AVAILABLE = "N/A"
ROCK_ICE = "Rock & Ice"
KEPT_STATUS = ["Designated", "Established", "Inscribed"]
DROPPED_DESIGNATIONS = ["Marine Protected Area", "UNESCO-MAB Biosphere Reserve"]
MISFILED_MARINE_IDS = [
    "555655917", "555656005", "555656013", "555665477", "555656021",
    "555665485", "555556142", "187", "555703455", "555563456", "15894",
]
UNCATEGORISED_IUCN = ["Not Reported", "Not Assigned", "Not Applicable"]
BIOME_ORDER = [
    "Mangroves", "Rock & Ice", "Tundra", "Desert", "Grassland & shrubland",
    "Boreal-Forests", "Temperate-Forests", "Tropical-Forests",
]
CLASS_ORDER = [
    "Significantly Decrease", "Not significantly Decrease",
    "Significantly Increase", "Not significantly Increase",
]
# End of fixed values.

_GROUPED = [(TROPICAL, "Tropical-Forests"),
            (TEMPERATE, "Temperate-Forests"), (BOREAL, "Boreal-Forests")]


def regroup_biome(raw: Column, variant: str = "global") -> Column:
    """Raw ecoregion label to reporting group.

    ``global`` folds a missing label into rock and ice and keeps "Mangroves";
    ``site`` keeps a missing label missing and shortens two names.
    """
    out = F.when(raw.isin(DESERT), "Desert")
    for members, group in _GROUPED:
        out = out.when(raw.isin(members), group)
    if variant == "global":
        out = out.when(raw.isin(GRASSLAND), "Grassland & shrubland")
        out = out.when((raw == NOT_AVAILABLE) | raw.isNull(), ROCK_ICE)
    elif variant == "site":
        out = out.when(raw.isin(GRASSLAND), "Grassland-Shrubland")
        out = out.when(raw == "Mangroves", "Mangrove").when(raw == NOT_AVAILABLE, ROCK_ICE)
    else:
        raise ValueError(f"unknown biome variant {variant!r}")
    return out.otherwise(raw)


def trend_class(slope: Column, p: Column, variant: str = "global",
                alpha: float = 0.05) -> Column:
    """Sign of the slope crossed with its significance.

    NaN is made NULL first: Spark orders NaN above every number, so it would
    otherwise pass ``p >= alpha``.
    """
    weak = {"global": "Not significantly", "site": "Not Significant"}[variant]
    slope, p = F.nanvl(slope, F.lit(None)), F.nanvl(p, F.lit(None))
    return (F.when((slope > 0) & (p < alpha), "Significantly Increase")
            .when((slope > 0) & (p >= alpha), f"{weak} Increase")
            .when(slope == 0, "Stable")
            .when((slope < 0) & (p < alpha), "Significantly Decrease")
            .when((slope < 0) & (p >= alpha), f"{weak} Decrease")
            .otherwise("unknown"))


def position_in(col: Column, order: list[str]) -> Column:
    """Sort key of an ordered category: 1-based, NULL when not listed."""
    return F.nullif(F.array_position(F.lit(order), col), F.lit(0))


def share(predicate: Column) -> Column:
    """Aggregate: percentage of rows where the predicate holds (NULL counts as no)."""
    return F.avg(F.when(predicate, 1.0).otherwise(0.0)) * 100
