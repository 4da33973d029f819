"""Network tables derived from the raw driver tables.

The raw data holds no packets or flows, so each table here is one SELECT over ``events`` or ``orders`` (or over
another derived table).  The same text runs in Spark SQL and in DuckDB, so a query and its oracle start from the
same rows.  Every text is a projection: it adds no shuffle and grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = {"packets": "events", "raw_flows": "orders", "predictions": "events", "logits": "events",
              "ip_rules": None, "app_flows": "events", "alerts": "events", "auth_logs": "events"}

# derived tables that another derived table reads
NEEDS = {"logits": ["predictions"], "app_flows": ["packets"]}

TABLE_SQL = {}

TABLE_SQL["packets"] = """
with e as (select event_id, cast(floor(event_id/8) as bigint) c, event_id % 8 p from events),
f as (select event_id, c, p, case when c % 37 < 3 then c - c % 37 else c end as k, c % 37 < 3 as slow, c % 31 = 9 as grace from e),
t as (select event_id as pkt_id, c, p, k, slow, grace,
 1704067200000000 + k*1500000 + p*100000 + (event_id*7919) % 90000
  + case when slow then (c - k)*72000000 + p*9000000 else 0 end
  + case when grace and not slow and p >= 4 then 6000000 else 0 end
  + case when not slow and c % 11 = 0 and p >= 4 then 20000000 else 0 end
  + case when not slow and c % 13 = 0 and p >= 6 then 130000000 else 0 end as ts_us,
 concat('10.', cast(k % 3 as varchar(9)), '.0.', cast(k % 200 + 1 as varchar(9))) as cli,
 concat('192.168.', cast(k % 5 as varchar(9)), '.', cast(k % 50 + 1 as varchar(9))) as srv,
 40000 + k % 20000 as cport,
 case k % 7 when 0 then 443 when 1 then 80 when 2 then 53 when 3 then 22 when 4 then 8080 when 5 then 6379 else 50001 end as sport_,
 case when k % 7 = 2 then 17 when k % 19 = 18 then 1 else 6 end as proto,
 case when p in (1,3,7) then 1 else 0 end as rev
 from f),
u as (select *, proto = 17 or (proto = 6 and k % 21 = 6 and p in (3, 4, 5, 7)) as dns from t)
select pkt_id, ts_us, case when rev=1 then srv else cli end src_ip, case when rev=1 then sport_ else cport end src_port,
 case when rev=1 then cli else srv end dst_ip, case when rev=1 then cport else sport_ end dst_port, proto,
 40 + (pkt_id*131) % 1600 ip_len, 54 + (pkt_id*131) % 1600 frame_len, case when rev=1 then 128 - c % 3 else 64 - c % 5 end ttl, 5 ip_ihl,
 case when proto<>6 then 0 when p=0 and c % 23 <> 5 then 2 when p=1 then 18
  when slow then case when p in (2,4) then 24 else 16 end
  when grace and p=3 then 17 when grace then 16
  when c % 17 = 0 and p=5 then 20 when p=6 then 17 when p=7 and c % 4 <> 1 then 17 when p in (2,4) then 24 else 16 end tcp_flags,
 case when proto=6 then 1024 + (pkt_id*37) % 60000 else 0 end tcp_window,
 case when c % 5 = 0 and p=4 then 1000+2 else 1000+p end tcp_seq, 5 tcp_dataofs,
 case when c % 5 = 0 and p in (2,4) then 100 else (pkt_id*131) % 1600 end payload_len,
 case when dns then rev end dns_qr, case when dns then pkt_id % 65536 else 0 end dns_id,
 case when dns and c % 8 <> 7 then 1 else 0 end dns_qdcount, case when dns then case c % 3 when 0 then 1 when 1 then 28 else 15 end else 0 end dns_qtype,
 case when dns and rev=1 and pkt_id % 9 <> 4 then 1 else 0 end dns_ancount, case when dns and rev=1 then 60*(pkt_id % 5) else 0 end dns_ttl
from u
"""

TABLE_SQL["raw_flows"] = """
select o_orderkey as row_id,
 case o_orderkey % 4 when 0 then 'unsw' when 1 then 'bot' when 2 then 'ton' else 'cic' end as dataset,
 concat('10.', cast(o_custkey % 4 as varchar(9)), '.', cast(o_custkey % 200 as varchar(9)), '.', cast(o_orderkey % 250 + 1 as varchar(9))) as ipv4_src_addr,
 case when o_orderkey % 97 = 0 then null else cast((o_orderkey * 7919) % 65536 as varchar(9)) end as l4_src_port,
 case when o_orderkey % 89 = 0 then 'bad' else cast(case o_orderkey % 5 when 0 then 443 when 1 then 80 when 2 then 53 when 3 then 8080 else 50000 + o_orderkey % 9000 end as varchar(9)) end as l4_dst_port,
 case when o_orderkey % 6 = 0 then 17 else 6 end as protocol,
 case when o_orderkey % 101 = 0 then cast('Infinity' as double) when o_orderkey % 103 = 0 then cast('-Infinity' as double) when o_orderkey % 107 = 0 then cast('NaN' as double) when o_orderkey % 109 = 0 then null else cast(floor(o_totalprice) as double) end as in_bytes,
 cast((o_orderkey * 31) % 5000 as double) as out_bytes,
 cast((o_orderkey * 17) % 300 as double) as in_pkts,
 cast((o_orderkey * 13) % 200 as double) as out_pkts,
 cast((o_orderkey * 1237) % 120000 as double) as flow_duration_milliseconds,
 case when o_orderkey % 9 = 0 then 1 else 0 end as label,
 case when o_orderkey % 9 <> 0 then 'Benign' else case (o_orderkey / 9) % 8 when 0 then 'DoS' when 1 then 'ddos' when 2 then 'Recon' when 3 then ' Exploits ' when 4 then 'xss' when 5 then 'Backdoor' when 6 then 'Worms' else 'scanning' end end as attack,
 case cast(floor(o_orderkey/3) as bigint) % 14 when 0 then 'DDoS' when 1 then 'PortScan' when 2 then 'Bot' when 3 then 'DoS Hulk' when 4 then 'DDOS attack-HOIC' when 5 then 'SSH-Bruteforce' when 6 then 'FTP-Patator' when 7 then 'Web Attack  XSS' when 8 then 'SQL Injection' when 9 then 'Infiltration' when 10 then 'DDoS attacks-LOIC-HTTP' else ' BENIGN ' end as cic_label
from orders
"""

TABLE_SQL["predictions"] = """
select event_id as row_id, cast(ts as timestamp) as ts, concat('set', cast(event_id % 4 as varchar(3))) as dataset, event_type as attack_name,
 case when value > 60 then 1 else 0 end as y_true,
 cast(least(999, greatest(1, 250 + case when value > 60 then 400 else 0 end + (event_id*7919) % 700 - 350)) as bigint) as p_milli,
 case when least(999, greatest(1, 250 + case when value > 60 then 400 else 0 end + (event_id*7919) % 700 - 350)) > 400 then 1 else 0 end as y_pred,
 case when value > 200 then 2 when value > 60 then 1 else 0 end as c_true,
 cast((event_id * 31 + case when value > 60 then 1 else 0 end) % 3 as int) as c_pred
from events
"""

TABLE_SQL["logits"] = """
select row_id, dataset, y_true, c_true, cast(1000 - p_milli as double)/250 as l0, cast(p_milli as double)/250 as l1,
 cast((row_id * 37) % 100 as double)/50 as m0, cast((row_id * 53) % 100 as double)/50 as m1, cast((row_id * 71) % 100 as double)/50 as m2,
 cast((row_id * 89) % 100 as double)/50 as m3, cast((row_id * 97) % 100 as double)/50 as m4
from predictions
"""

TABLE_SQL["ip_rules"] = """
select * from (values
 (1,'10.0.0.0/24','blacklist',true,cast(null as timestamp)),
 (2,'10.0.0.16/28','whitelist',true,cast(null as timestamp)),
 (3,'10.1.0.0/16','whitelist',true,cast('2023-12-31 00:00:00' as timestamp)),
 (4,'10.1.0.7/32','blacklist',true,cast('2025-01-01 00:00:00' as timestamp)),
 (5,'10.2.0.0/25','whitelist',true,cast(null as timestamp)),
 (6,'10.2.0.0/16','blacklist',false,cast(null as timestamp)),
 (7,'192.168.3.0/24','blacklist',true,cast(null as timestamp))) as t(id,cidr,list_type,is_active,expires_at)
"""

TABLE_SQL["app_flows"] = """
select distinct_c as flow_no, src_ip, src_port, dst_ip, dst_port, proto, app_name, is_guessed, ts_us from (
 select cast(floor(pkt_id/8) as bigint) as distinct_c, src_ip, src_port, dst_ip, dst_port, proto, ts_us,
  case cast(floor(pkt_id/8) as bigint) % 6 when 0 then 'TLS.Google' when 1 then 'HTTP' when 2 then 'DNS.Apple' when 3 then 'Unknown' when 4 then 'QUIC' else 'NoSuchApp.X' end as app_name,
  cast(floor(pkt_id/8) as bigint) % 4 = 3 as is_guessed
 from packets where pkt_id % 8 in (1, 4)) q
"""

TABLE_SQL["alerts"] = """
select event_id as id, ts, concat('10.', cast(event_id % 4 as varchar(3)), '.0.', cast(user_id % 200 + 1 as varchar(3)), '->192.168.', cast(event_id % 5 as varchar(3)), '.', cast(user_id % 50 + 1 as varchar(3))) as source,
 case when event_id % 50 = 0 then false when event_id % 50 = 1 then true else value > 60 end as is_attack,
 cast(case when event_id % 50 = 0 then 0 when event_id % 50 = 1 then 1000 else least(999, greatest(1, 250 + case when value > 60 then 400 else 0 end + (event_id*7919) % 700 - 350)) end as bigint) as conf_milli,
 case when event_id % 50 = 0 then 'Whitelisted' when event_id % 50 = 1 then 'Blacklisted' when value > 60 then concat('atk_', event_type) else 'Benign' end as attack_type,
 cast(case when event_id % 50 = 0 then 5 when event_id % 50 = 1 then 1 else null end as int) as rule_id,
 case event_id % 3 when 0 then concat('{"Dst Port": ', cast(443 + event_id % 5 as varchar(9)), ', "IN_BYTES": ', cast(event_id % 1500 as varchar(9)), '}')
  when 1 then concat('{"dst_port": ', cast(8000 + event_id % 90 as varchar(9)), '}') else '{"L4_DST_PORT": 53}' end as features_json
from events
"""

TABLE_SQL["auth_logs"] = """
select event_id as id, concat('user', cast(user_id as varchar(9))) as username, concat('10.9.0.', cast(user_id % 250 as varchar(3))) as ip_address,
 case event_type when 'error' then 'BAŞARISIZ GİRİŞ - Yanlış Şifre/Kullanıcı' when 'signup' then 'Yeni Kullanıcı Kaydı' else 'Başarılı Giriş' end as action, ts
from events where event_type in ('error','signup','view')
"""


def cte(*names: str) -> str:
    """``WITH`` clause that defines the named derived tables, dependencies first."""
    order: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in order:
                order.append(part)
    return "WITH " + ",\n".join(f"{n} AS ({TABLE_SQL[n]})" for n in order) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` over the parquet files in ``sf_dir``."""
    clause = cte(name)
    raw = RAW_TABLES[name]
    if raw:
        clause = clause.replace("WITH ", f"WITH {raw} AS (SELECT * FROM parquet.`{sf_dir}/{raw}.parquet`),\n", 1)
    return spark.sql(clause + f"SELECT * FROM {name}")
