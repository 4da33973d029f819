"""Names and codes that must equal the published feature formats for results to agree.

Lists of column names, lookup tables and limits only; no logic lives here.
"""

# NetFlow-v3 column groups, in file order.
TIMESTAMP_COLUMNS = ["FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS"]
IDENTITY_COLUMNS = ["IPV4_SRC_ADDR", "L4_SRC_PORT", "IPV4_DST_ADDR", "L4_DST_PORT"]
PROTOCOL_COLUMNS = ["PROTOCOL", "L7_PROTO"]
VOLUME_COLUMNS = ["IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS"]
FLAG_COLUMNS = ["TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS"]
TIMING_COLUMNS = ["FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT"]
TTL_COLUMNS = ["MIN_TTL", "MAX_TTL"]
LENGTH_COLUMNS = ["LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN"]
RATE_COLUMNS = ["SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES",
                "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT"]
RETRANSMIT_COLUMNS = ["RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS",
                      "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS"]
SIZE_COLUMNS = ["NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES",
                "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES"]
WINDOW_COLUMNS = ["TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT"]
ICMP_COLUMNS = ["ICMP_TYPE", "ICMP_IPV4_TYPE"]
DNS_COLUMNS = ["DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER"]
FTP_COLUMNS = ["FTP_COMMAND_RET_CODE"]
IAT_COLUMNS = ["SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV",
               "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV"]
PORT_BUCKET_COLUMNS = ["SRC_PORT_WELL_KNOWN", "SRC_PORT_REGISTERED", "SRC_PORT_EPHEMERAL",
                       "DST_PORT_WELL_KNOWN", "DST_PORT_REGISTERED", "DST_PORT_EPHEMERAL"]
LABEL_COLUMNS = ["Label", "Attack"]

NFV3_MODEL_COLUMNS = (PROTOCOL_COLUMNS + VOLUME_COLUMNS + FLAG_COLUMNS + TIMING_COLUMNS + TTL_COLUMNS
                      + LENGTH_COLUMNS + RATE_COLUMNS + RETRANSMIT_COLUMNS + SIZE_COLUMNS + WINDOW_COLUMNS
                      + ICMP_COLUMNS + DNS_COLUMNS + FTP_COLUMNS + IAT_COLUMNS)
NFV3_RAW_COLUMNS = TIMESTAMP_COLUMNS + IDENTITY_COLUMNS + NFV3_MODEL_COLUMNS
NFV3_FILE_COLUMNS = NFV3_RAW_COLUMNS + LABEL_COLUMNS
NFV3_INPUT_COLUMNS = NFV3_MODEL_COLUMNS + PORT_BUCKET_COLUMNS
NFV3_DROP_COLUMNS = IDENTITY_COLUMNS + TIMESTAMP_COLUMNS

# Heavy-tailed columns that get log1p(|x|).
LOG_COLUMNS = [
    "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "TOTAL_BYTES", "TOTAL_PKTS", "FLOW_DURATION_MILLISECONDS",
    "DURATION_IN", "DURATION_OUT", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "RETRANSMITTED_IN_BYTES",
    "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS", "SRC_TO_DST_AVG_THROUGHPUT",
    "DST_TO_SRC_AVG_THROUGHPUT", "DNS_TTL_ANSWER", "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG",
    "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG",
    "DST_TO_SRC_IAT_STDDEV",
]

# forward/backward feature pairs exchanged by the direction swap.
SWAP_PAIRS = [
    ("IN_BYTES", "OUT_BYTES"),
    ("IN_PKTS", "OUT_PKTS"),
    ("SRC_TO_DST_IAT_MIN", "DST_TO_SRC_IAT_MIN"),
    ("SRC_TO_DST_IAT_MAX", "DST_TO_SRC_IAT_MAX"),
    ("SRC_TO_DST_IAT_AVG", "DST_TO_SRC_IAT_AVG"),
    ("SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_STDDEV"),
    ("SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES"),
    ("SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT"),
    ("CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS"),
    ("TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT"),
    ("DURATION_IN", "DURATION_OUT"),
    ("RETRANSMITTED_IN_BYTES", "RETRANSMITTED_OUT_BYTES"),
    ("RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_PKTS"),
]

# Inclusive port ranges of the three buckets.
PORT_BUCKETS = {"WELL_KNOWN": (0, 1023), "REGISTERED": (1024, 49151), "EPHEMERAL": (49152, 65535)}

# Flow timeouts in seconds.
ACTIVE_TIMEOUT_S = 120
INACTIVE_TIMEOUT_S = 15
FIN_GRACE_S = 5
CIC_TIMEOUT_S = 120
CIC_IDLE_GAP_S = 5

# Capture ports of the system's own services.
INFRA_PORTS = [6379, 5432, 8000]

# Dataset short names and their raw files.
DATASETS = {
    "unsw": "NF-UNSW-NB15-v3.csv",
    "bot": "NF-BoT-IoT-v3.csv",
    "ton": "NF-ToN-IoT-v3.csv",
    "cic": "NF-CICIDS2018-v3.csv",
}

# Port -> application id.
PORT_APP_ID = {
    20: 1, 21: 1, 22: 92, 23: 23, 25: 3, 53: 5, 67: 6, 68: 6, 69: 73, 80: 7, 8080: 7, 110: 4, 119: 137, 123: 9,
    137: 11, 138: 11, 139: 11, 143: 9, 161: 10, 162: 10, 179: 65, 194: 12, 389: 84, 443: 91, 8443: 91, 465: 3,
    514: 113, 520: 14, 554: 13, 587: 3, 631: 86, 636: 84, 993: 9, 995: 4, 1080: 90, 1194: 110, 1433: 18, 1521: 117,
    1812: 36, 1813: 36, 1883: 222, 1900: 138, 2049: 70, 3306: 19, 3389: 88, 3478: 41, 4789: 224, 5060: 100,
    5061: 100, 5222: 16, 5223: 16, 5353: 8, 5355: 30, 5432: 17, 5900: 87, 6379: 224, 27017: 226,
}

# IP protocol number -> application id when no port is known.
PROTO_APP_ID = {1: 81, 2: 82, 17: 67}

# Application name -> application id.
APP_NAME_ID = {
    "Unknown": 0, "FTP_CONTROL": 1, "FTP_DATA": 86, "FTP": 1, "MAIL_POP": 2, "POP3": 2, "POPS": 4, "MAIL_SMTP": 3,
    "SMTP": 3, "SMTPS": 3, "MAIL_IMAP": 4, "IMAP": 4, "IMAPS": 4, "DNS": 5, "MDNS": 8, "LLMNR": 30, "IPP": 6,
    "HTTP": 7, "HTTP_Connect": 7, "HTTP_Proxy": 7, "NTP": 9, "NetBIOS": 10, "NFS": 11, "RTSP": 13, "SSDP": 138,
    "BGP": 65, "SNMP": 10, "TFTP": 73, "DHCP": 6, "Syslog": 113, "DHCPV6": 103, "OpenVPN": 110, "WireGuard": 248,
    "GRE": 187, "ICMP": 81, "IGMP": 82, "ICMPV6": 102, "PPTP": 92, "Telnet": 23, "STUN": 41, "TLS": 91, "SSL": 91,
    "SSH": 92, "IRC": 12, "RDP": 88, "VNC": 87, "SIP": 100, "Skype": 125, "SkypeCall": 125, "SOCKS": 90, "Tor": 163,
    "BitTorrent": 37, "QUIC": 188, "Kerberos": 132, "LDAP": 84, "MsSQL-TDS": 18, "MySQL": 19, "Postgres": 17,
    "Oracle": 117, "MongoDB": 226, "Redis": 224, "MQTT": 222, "AMQP": 225, "AJP": 142, "RX": 184, "Modbus": 73,
    "SOMEIP": 235, "DCE_RPC": 121, "RPC": 121, "MS_RPCH": 122, "Apple": 140, "AppleiCloud": 89, "AppleiTunes": 140,
    "ApplePush": 89, "AppleStore": 140, "Google": 126, "GoogleServices": 126, "GoogleHangoutDuo": 226, "GMail": 121,
    "YouTube": 124, "GoogleMaps": 26, "GoogleDocs": 217, "Facebook": 119, "FacebookMessenger": 132,
    "Instagram": 211, "WhatsApp": 142, "WhatsAppCall": 142, "WhatsAppFiles": 142, "Telegram": 185, "Snapchat": 200,
    "Twitter": 120, "TwitchTV": 195, "Twitch": 195, "Spotify": 156, "Microsoft": 212, "Microsoft365": 217,
    "MicrosoftAzure": 212, "MS_OneDrive": 213, "AmazonAWS": 178, "AmazonVideo": 209, "Netflix": 133, "GitHub": 220,
    "Crashlytics": 134, "Cloudflare": 244, "Dropbox": 121,
}

# CIC short column name -> scorer input name, in scorer input order.
CIC_SCORER_NAMES = {
    "Dst Port": "Destination Port",
    "Tot Fwd Pkts": "Total Fwd Packets",
    "Tot Bwd Pkts": "Total Backward Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets",
    "TotLen Bwd Pkts": "Total Length of Bwd Packets",
    "Fwd Pkt Len Max": "Fwd Packet Length Max",
    "Fwd Pkt Len Min": "Fwd Packet Length Min",
    "Fwd Pkt Len Mean": "Fwd Packet Length Mean",
    "Fwd Pkt Len Std": "Fwd Packet Length Std",
    "Bwd Pkt Len Max": "Bwd Packet Length Max",
    "Bwd Pkt Len Min": "Bwd Packet Length Min",
    "Bwd Pkt Len Mean": "Bwd Packet Length Mean",
    "Bwd Pkt Len Std": "Bwd Packet Length Std",
    "Flow Byts/s": "Flow Bytes/s",
    "Flow Pkts/s": "Flow Packets/s",
    "Fwd IAT Tot": "Fwd IAT Total",
    "Bwd IAT Tot": "Bwd IAT Total",
    "Fwd Pkts/s": "Fwd Packets/s",
    "Bwd Pkts/s": "Bwd Packets/s",
    "Pkt Len Min": "Min Packet Length",
    "Pkt Len Max": "Max Packet Length",
    "Pkt Len Mean": "Packet Length Mean",
    "Pkt Len Std": "Packet Length Std",
    "Pkt Len Var": "Packet Length Variance",
    "FIN Flag Cnt": "FIN Flag Count",
    "SYN Flag Cnt": "SYN Flag Count",
    "RST Flag Cnt": "RST Flag Count",
    "PSH Flag Cnt": "PSH Flag Count",
    "ACK Flag Cnt": "ACK Flag Count",
    "URG Flag Cnt": "URG Flag Count",
    "ECE Flag Cnt": "ECE Flag Count",
    "Pkt Size Avg": "Average Packet Size",
    "Fwd Seg Size Avg": "Avg Fwd Segment Size",
    "Bwd Seg Size Avg": "Avg Bwd Segment Size",
    "Fwd Byts/b Avg": "Fwd Avg Bytes/Bulk",
    "Fwd Pkts/b Avg": "Fwd Avg Packets/Bulk",
    "Fwd Blk Rate Avg": "Fwd Avg Bulk Rate",
    "Bwd Byts/b Avg": "Bwd Avg Bytes/Bulk",
    "Bwd Pkts/b Avg": "Bwd Avg Packets/Bulk",
    "Bwd Blk Rate Avg": "Bwd Avg Bulk Rate",
    "Subflow Fwd Pkts": "Subflow Fwd Packets",
    "Subflow Fwd Byts": "Subflow Fwd Bytes",
    "Subflow Bwd Pkts": "Subflow Bwd Packets",
    "Subflow Bwd Byts": "Subflow Bwd Bytes",
    "Init Fwd Win Byts": "Init_Win_bytes_forward",
    "Init Bwd Win Byts": "Init_Win_bytes_backward",
    "Fwd Act Data Pkts": "act_data_pkt_fwd",
    "Fwd Seg Size Min": "min_seg_size_forward",
}

# The further 2018 -> 2017 column names; names equal in both years are left out.  Header blanks are
# trimmed before use, so none are written here.
CIC_2018_ONLY_NAMES = {
    "Fwd Header Len": "Fwd Header Length",
    "Bwd Header Len": "Bwd Header Length",
    "Dst IP": "Destination IP",
    "Src IP": "Source IP",
    "Src Port": "Source Port",
}

# CIC columns dropped before learning.
CIC_DROP_COLUMNS = ["Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol",
                    "Timestamp", "SimillarHTTP"]

# CIC label text -> class, and class names.
CIC_EXACT_LABELS = {
    "BENIGN": 0,
    "DDoS": 1,
    "PortScan": 2,
    "Web Attack  Brute Force": 3,
    "Web Attack  XSS": 3,
    "Web Attack  Sql Injection": 3,
    "Bot": 4,
}
CIC_LABEL_RULES = [
    (["BENIGN"], 0),
    (["LOIC", "HOIC"], -1),
    (["DOS", "DDOS"], 1),
    (["PORT", "SSH", "FTP"], 2),
    (["WEB", "XSS", "SQL"], 3),
    (["BOT"], 4),
]
CLASS_NAMES = ["Benign", "DDoS", "PortScan", "WebAttack", "Botnet"]

# Attack group -> spellings found in the datasets.
ATTACK_GROUPS = {
    "DoS": ["DoS", "dos"],
    "DDoS": ["DDoS", "ddos"],
    "Reconnaissance": ["Reconnaissance", "Recon", "scanning", "Scan"],
    "Backdoor": ["Backdoor", "backdoor"],
    "Exploit": ["Exploits", "Exploit", "exploit"],
    "Botnet": ["Botnet", "botnet", "Bot"],
    "Theft": ["Theft", "theft"],
    "Injection": ["Injection", "injection", "XSS", "xss"],
    "MITM": ["MITM", "mitm"],
    "Ransomware": ["Ransomware", "ransomware"],
    "Password": ["Password", "password"],
}
