"""Settings, as one immutable value that every operator takes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Columns:
    """Names in the header of a raw report file (fixed values of the format)."""

    mmsi: str = "MMSI"
    timestamp: str = "# Timestamp"
    lat: str = "Latitude"
    lon: str = "Longitude"
    sog: str = "SOG"
    draught: str = "Draught"
    ship_type: str = "Ship type"
    name: str = "Name"
    dest: str = "Destination"
    mobile_type: str = "Type of mobile"


@dataclass(frozen=True)
class Config:
    columns: Columns = Columns()
    mobile_types: tuple[str, ...] = ("Class A",)
    mmsi_min: int = 200_000_000
    mmsi_max: int = 999_999_999
    mmsi_invalid: tuple[int, ...] = (0, 111_111_111, 123_456_789, 222_222_222, 999_999_999)
    shards: int = 64
    # A, going dark
    gap_hours: float = 4.0
    gap_dist_nm: float = 1.0
    moving_kn: float = 0.1
    # B, loitering pairs
    loiter_kn: float = 1.0
    loiter_hours: float = 2.0
    loiter_dist_m: float = 500.0
    draught_step_m: float = 0.05
    pair_bucket_hours: int = 24
    # C, draught change
    draught_min_m: float = 0.5
    draught_change: float = 0.05
    draught_hours: float = 2.0
    # D, identity cloning
    clone_kn: float = 60.0
    simultaneous_nm: float = 0.5
    # risk score
    gap_divisor: float = 2.0
    distance_divisor: float = 10.0
    draught_weight: float = 15.0
    top: int = 5
    #: "exact" rounds the binary value, ties to even; "decimal" rounds as Spark does
    rounding: str = "exact"


DEFAULT = Config()
