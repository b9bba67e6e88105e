"""Schemas of pings and results."""

from pyspark.sql import types as T

PING = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("sog", T.DoubleType()),
        T.StructField("draught", T.DoubleType()),
        T.StructField("ship_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("dest", T.StringType()),
    ]
)
A = ["mmsi", "gap_hours", "dist_nm", "implied_kn", "lat_before", "lon_before", "ts_before", "lat_after", "lon_after", "ts_after"]
B = ["mmsi_1", "mmsi_2", "dist_m", "overlap_h", "lat", "lon", "ts_start", "ts_end", "confidence", "draught_delta_1", "draught_delta_2"]
C = ["mmsi", "gap_hours", "draught_before", "draught_after", "change_pct", "ts_before", "ts_after", "lat", "lon"]
D = ["mmsi", "event_type", "speed_kn", "dist_nm", "dt_seconds", "reported_sog", "lat1", "lon1", "ts1", "lat2", "lon2", "ts2", "gps_error"]
CANDIDATE = ["mmsi", "ts_start", "ts_end", "avg_lat", "avg_lon", "duration_h", "draught_start", "draught_end"]
RISK = ["mmsi", "dfsi", "max_gap_hours", "total_impossible_nm", "count_C"]
