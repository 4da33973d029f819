"""Hand-made packets for the small golden cases."""

from itertools import count

FLAGS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}
SCHEMA = ("pkt_id long, ts_us long, src_ip string, src_port long, dst_ip string, dst_port long, proto int, ip_len long, "
          "frame_len long, ttl long, ip_ihl int, tcp_flags int, tcp_window int, tcp_seq long, tcp_dataofs int, "
          "payload_len long, dns_qr int, dns_id long, dns_qdcount int, dns_qtype int, dns_ancount int, dns_ttl int")


class Capture:
    """Builds rows of the packet table."""

    def __init__(self):
        self.rows, self.ids = [], count(1)

    def tcp(self, t, flags, src=("10.0.0.1", 1000), dst=("10.0.0.2", 80), payload=0, window=8192, seq=None,
            dns=(None, 0, 0, 0, 0, 0)):
        n = next(self.ids)
        self.rows.append((n, round(t * 1e6), *src, *dst, 6, 40 + payload, 54 + payload, 64, 5,
                          sum(FLAGS[f] for f in flags), window, n if seq is None else seq, 5, payload, *dns))
        return self

    def udp(self, t, src=("10.0.0.1", 5353), dst=("10.0.0.2", 53), payload=0,
            dns=(None, 0, 0, 0, 0, 0)):
        n = next(self.ids)
        self.rows.append((n, round(t * 1e6), *src, *dst, 17, 28 + payload, 42 + payload, 64, 5, 0, 0, 0, 0, payload, *dns))
        return self

    def frame(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA)
