"""Bidirectional flow keys over decoded packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake import fixed_values as fv

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = (1 << i for i in range(8))


def drop_infra_ports(packets: DataFrame, ports: list[int] = fv.INFRA_PORTS) -> DataFrame:
    """Leave out the system's own services, on either side."""
    return packets.filter(~F.col("src_port").isin(ports) & ~F.col("dst_port").isin(ports))


def flow_keys(packets: DataFrame) -> DataFrame:
    """TCP and UDP packets with ``flow_key`` (equal for both directions) and ``from_lo``.

    The smaller (ip, port) endpoint is the "lo" side; ``from_lo`` tells which side sent the packet.  One equality on
    ``flow_key`` replaces a forward-or-reverse lookup, so every later step shares one shuffle.
    """
    from_lo = F.expr("src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)")
    src, dst = "concat(src_ip, ':', src_port)", "concat(dst_ip, ':', dst_port)"
    key = f"CASE WHEN from_lo THEN concat_ws('-', {src}, {dst}, proto) ELSE concat_ws('-', {dst}, {src}, proto) END"
    return packets.filter(F.col("proto").isin(6, 17)).withColumn("from_lo", from_lo).withColumn("flow_key", F.expr(key))


def hot_keys(keyed: DataFrame, hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` packets, or None when there are none.

    Runs one job: a partial aggregation over the key column.
    """
    counts = keyed.groupBy("flow_key").count().filter(F.col("count") > hot_rows).select("flow_key")
    return counts if counts.take(1) else None
