"""Column roles of profile tables, and the three table forms: wide, packed and long.

Roles are read from column names on the driver, without touching data. Wide tables have one column per
feature; packed ones an array ``features``; long ones a row per feature with ``f`` (its position) and ``v``.
Statistics per feature run on the long form, where the plan does not grow with the features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Naming conventions of the profile tables.
COMPARTMENTS = ("Cells", "Cytoplasm", "Nuclei")
CATEGORIES = ("AreaShape", "Correlation", "Granularity", "Intensity", "Location", "Neighbors", "RadialDistribution", "Texture")
BLOCKED = (
    "Location_Center_X",
    "Location_Center_Y",
    "Location_Center_Z",
    "ObjectNumber",
    "Number_Object_Number",
    "AreaShape_BoundingBoxMaximum_X",
    "AreaShape_BoundingBoxMaximum_Y",
    "AreaShape_BoundingBoxMinimum_X",
    "AreaShape_BoundingBoxMinimum_Y",
    "Parent_",
    "Children_",
)
KEY_NAMES = {
    "gene": (("Metadata_Symbol", "Metadata_Gene", "gene", "Gene", "gene_symbol", "Metadata_JCP2022"), ("gene", "symbol")),
    "plate": (("Metadata_Plate", "Metadata_plate", "plate", "Plate", "plate_id"), ("plate",)),
    "well": (("Metadata_Well", "Metadata_well", "well", "Well", "well_position"), ("well",)),
    "source": (("Metadata_Source", "Metadata_source", "source", "Source"), ("source",)),
    "batch": (("Metadata_Batch", "Metadata_batch", "batch", "Batch"), ("batch",)),
}
COUNT_NAMES = (
    "Metadata_Count_Cells",
    "Metadata_Cells_Number_Object_Number",
    "Metadata_Nuclei_Number_Object_Number",
    "Metadata_Count_Nuclei",
    "Metadata_CellCount",
    "Metadata_Number_of_Cells",
    "Metadata_Object_Count",
)


def blocked(name: str) -> bool:
    """Whether a feature is known to be unusable."""
    return any(b in name for b in BLOCKED)


def blocked_column(col):
    """B3 over a table of feature names."""
    return F.coalesce(col.rlike("|".join(BLOCKED)), F.lit(False))


def feature_columns(columns, compartments=COMPARTMENTS, drop_blocked: bool = True) -> list[str]:
    """B1: feature columns, sorted."""
    heads = tuple(f"{c}_" for c in compartments)
    return sorted(c for c in columns if c.startswith(heads) and not (drop_blocked and blocked(c)))


def cell_feature_columns(columns, compartments=COMPARTMENTS, categories=None, drop_blocked: bool = True) -> list[str]:
    """B2: feature columns in table order, of the given categories only if any are given."""
    heads = tuple(f"{c}_" for c in compartments)
    return [c for c in columns if c.startswith(heads) and not (drop_blocked and blocked(c)) and (not categories or any(k in c for k in categories))]


def metadata_columns(columns) -> list[str]:
    """Metadata columns."""
    return [c for c in columns if c.startswith("Metadata_")]


def find_key(columns, role: str) -> str:
    """The column that plays a role, by known names first and then by what a name contains."""
    names, parts = KEY_NAMES[role]
    for c in names:
        if c in columns:
            return c
    for c in columns:
        if any(p in c.lower() for p in parts):
            return c
    raise KeyError(f"no {role} column among {list(columns)}")


def find_count(columns) -> str | None:
    """B10's cell-count column, or None."""
    for c in COUNT_NAMES:
        if c in columns:
            return c
    for c in columns:
        low = c.lower()
        if low.startswith("metadata_") and any(x in low for x in ("count", "number")) and any(x in low for x in ("cell", "nuclei", "object")):
            return c
    return None


def category(name):
    """First of the known categories that a feature name contains, else ``other``."""
    out = F.lit("other")
    for c in reversed(CATEGORIES):
        out = F.when(name.contains(c), c).otherwise(out)
    return out


def compartment(name):
    """What stands before the first underscore."""
    return F.substring_index(name, "_", 1)


@dataclass(frozen=True)
class ProfileSchema:
    keys: tuple[str, ...]
    metadata: tuple[str, ...]
    features: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame, keys=(), compartments=COMPARTMENTS) -> ProfileSchema:
        return ProfileSchema(tuple(keys), tuple(metadata_columns(df.columns)), tuple(feature_columns(df.columns, compartments)))


def nan_to_null(df: DataFrame, columns) -> DataFrame:
    """Missing values are nulls from here on."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def pack(df: DataFrame, features, keep) -> DataFrame:
    """Wide to packed."""
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in features]).alias("features"))


def unpack(df: DataFrame, features) -> DataFrame:
    """Packed to wide."""
    return df.select(*[c for c in df.columns if c != "features"], *[F.col("features")[i].alias(c) for i, c in enumerate(features)])


def to_long(packed: DataFrame, keep) -> DataFrame:
    """Packed to long: ``keep``, ``f``, ``v``."""
    return packed.select(*keep, F.posexplode("features").alias("f", "v"))


def from_long(long: DataFrame, keep) -> DataFrame:
    """Long to packed; features missing from the long form are left out, so it must be complete."""
    cells = F.array_sort(F.collect_list(F.struct("f", "v")))
    return long.groupBy(*keep).agg(F.transform(cells, lambda x: x["v"]).alias("features"))


def stats_array(stats: DataFrame, *names: str) -> DataFrame:
    """One row holding per-feature statistics as arrays in feature order, to be joined back to packed rows.

    Its size is the number of features, which is bounded by the table's width.
    """
    cells = F.array_sort(F.collect_list(F.struct("f", *names)))
    return stats.agg(cells.alias("c")).select(*[F.col(f"c.{n}").alias(n) for n in names])
