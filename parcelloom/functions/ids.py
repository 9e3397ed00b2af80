"""Geographic identifiers: levels, lengths, parents, crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels from large to small, and the length of an identifier of each.
LEVELS = ("state", "county", "tract", "group", "vtd", "block")
ID_LENGTH = {"state": 2, "county": 5, "tract": 11, "group": 12, "vtd": 11, "block": 15}
#: Levels whose units are prefixes of a level's identifiers.
ABOVE = {"state": (), "county": ("state",), "tract": ("state", "county"), "group": ("state", "county", "tract"), "vtd": ("state", "county")}

# Postal code, FIPS code and name of each state and district.
STATES = {
    "AL": ("01", "Alabama"), "AK": ("02", "Alaska"), "AZ": ("04", "Arizona"), "AR": ("05", "Arkansas"), "CA": ("06", "California"),
    "CO": ("08", "Colorado"), "CT": ("09", "Connecticut"), "DE": ("10", "Delaware"), "DC": ("11", "District of Columbia"), "FL": ("12", "Florida"),
    "GA": ("13", "Georgia"), "HI": ("15", "Hawaii"), "ID": ("16", "Idaho"), "IL": ("17", "Illinois"), "IN": ("18", "Indiana"),
    "IA": ("19", "Iowa"), "KS": ("20", "Kansas"), "KY": ("21", "Kentucky"), "LA": ("22", "Louisiana"), "ME": ("23", "Maine"),
    "MD": ("24", "Maryland"), "MA": ("25", "Massachusetts"), "MI": ("26", "Michigan"), "MN": ("27", "Minnesota"), "MS": ("28", "Mississippi"),
    "MO": ("29", "Missouri"), "MT": ("30", "Montana"), "NE": ("31", "Nebraska"), "NV": ("32", "Nevada"), "NH": ("33", "New Hampshire"),
    "NJ": ("34", "New Jersey"), "NM": ("35", "New Mexico"), "NY": ("36", "New York"), "NC": ("37", "North Carolina"), "ND": ("38", "North Dakota"),
    "OH": ("39", "Ohio"), "OK": ("40", "Oklahoma"), "OR": ("41", "Oregon"), "PA": ("42", "Pennsylvania"), "RI": ("44", "Rhode Island"),
    "SC": ("45", "South Carolina"), "SD": ("46", "South Dakota"), "TN": ("47", "Tennessee"), "TX": ("48", "Texas"), "UT": ("49", "Utah"),
    "VT": ("50", "Vermont"), "VA": ("51", "Virginia"), "WA": ("53", "Washington"), "WV": ("54", "West Virginia"), "WI": ("55", "Wisconsin"),
    "WY": ("56", "Wyoming"), "PR": ("72", "Puerto Rico"),
}


def level(name: str) -> str:
    """A level by its name, in any case."""
    if (found := name.strip().lower()) not in LEVELS:
        raise ValueError(f"unknown level {name!r}")
    return found


def checked(geo_id: Column, of: str) -> Column:
    """``geo_id``, or an error where its length is not that of the level."""
    n = ID_LENGTH[level(of)]
    return F.when(F.length(geo_id) == n, geo_id).otherwise(F.raise_error(F.concat(F.lit(f"not a {of} id: "), F.coalesce(geo_id, F.lit("null")))))


def parent(geo_id: Column, of: str) -> Column:
    """The prefix that names the enclosing unit of a larger level."""
    return F.substring(geo_id, 1, ID_LENGTH[level(of)])


def padded(value: Column, of: str = "block") -> Column:
    """An identifier from a number or a string that lost its leading zeros."""
    return F.lpad(value.cast("string"), ID_LENGTH[level(of)], "0")


def crosswalk(assignments: DataFrame, block: str = "BLOCKID", district: str = "DISTRICT") -> DataFrame:
    """``geo_id, parent_vtd`` from a block assignment table: the block's county and the district; rows with nulls go."""
    rows = assignments.where(F.col(block).isNotNull() & F.col(district).isNotNull())
    return rows.select(F.col(block).alias("geo_id"), F.concat(F.substring(block, 1, 5), F.col(district)).alias("parent_vtd"))


def state_lookup(postal: Column) -> tuple[Column, Column]:
    """FIPS code and name of a postal code in any case; null where unknown."""
    table = F.create_map(*(F.lit(x) for k, (fips, name) in STATES.items() for x in (k, f"{fips}|{name}")))
    found = F.try_element_at(table, F.upper(postal))
    return F.split_part(found, F.lit("|"), F.lit(1)), F.split_part(found, F.lit("|"), F.lit(2))


def normalised(df: DataFrame) -> DataFrame:
    """Identifiers as read from text: blanks are null, ``geo_id`` is as long as its longest, parents as their levels."""
    width = df.agg(F.max(F.length(F.trim("geo_id")))).first()[0] or 0

    def clean(name: str, n: int) -> Column:
        value = F.trim(F.col(name).cast("string"))
        return F.when(value != "", F.lpad(value, n, "0")).alias(name)

    longest = {}
    if "parent_vtd" in df.columns:
        longest["parent_vtd"] = df.agg(F.max(F.length(F.trim("parent_vtd")))).first()[0] or 0
    lengths = {f"parent_{x}": ID_LENGTH[x] for x in LEVELS[:4]} | longest
    return df.select(*(clean(c, width) if c == "geo_id" else clean(c, lengths[c]) if c in lengths else F.col(c) for c in df.columns))
