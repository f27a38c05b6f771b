"""Small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# State, main region, north or south, east or west.
STATE_REGIONS = """
AL south south east
AK west north west
AZ west south west
AR south south west
CA west south west
CO west north west
CT northeast north east
DE south south east
FL south south east
GA south south east
HI west south west
ID west north west
IL midwest north east
IN midwest north east
IA midwest north west
KS midwest north west
KY south south east
LA south south west
ME northeast north east
MD south north east
MA northeast north east
MI midwest north east
MN midwest north west
MS south south east
MO midwest north west
MT west north west
NE midwest north west
NV west north west
NH northeast north east
NJ northeast north east
NM west south west
NY northeast north east
NC south south east
ND midwest north west
OH midwest north east
OK south south west
OR west north west
PA northeast north east
RI northeast north east
SC south south east
SD midwest north west
TN south south east
TX south south west
UT west north west
VT northeast north east
VA south south east
WA west north west
WV south north east
WI midwest north east
WY west north west
"""

STATE_COLUMNS = ("group_state", "main_region", "north_south", "east_west")


def state_rows() -> list[tuple[str, ...]]:
    return [tuple(line.split()) for line in STATE_REGIONS.split("\n") if line]


def state_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(state_rows(), ", ".join(f"{c} string" for c in STATE_COLUMNS))
