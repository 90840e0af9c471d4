"""Small validated lookups: label names, feature lists, day roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Raw label -> normalized label.
LABEL_MAPPING = {
    "Benign": "benign",
    "Bot": "bot",
    "Brute Force -Web": "brute_force_web",
    "Brute Force -XSS": "brute_force_xss",
    "DDOS attack-HOIC": "ddos_attack_hoic",
    "DDOS attack-LOIC-UDP": "ddos_attack_loic_udp",
    "DDoS attacks-LOIC-HTTP": "ddos_attacks_loic_http",
    "DoS attacks-GoldenEye": "dos_attacks_goldeneye",
    "DoS attacks-Hulk": "dos_attacks_hulk",
    "DoS attacks-SlowHTTPTest": "dos_attacks_slowhttptest",
    "DoS attacks-Slowloris": "dos_attacks_slowloris",
    "FTP-BruteForce": "ftp_bruteforce",
    "Infilteration": "infiltration",
    "SQL Injection": "sql_injection",
    "SSH-Bruteforce": "ssh_bruteforce",
}

# The full numeric feature list of the raw records, and the reduced list.
FULL_FEATURES = (
    "Dst Port", "Protocol", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts",
    "TotLen Bwd Pkts", "Flow Byts/s", "Flow Pkts/s", "Fwd Pkt Len Max", "Fwd Pkt Len Min",
    "Fwd Pkt Len Mean", "Fwd Pkt Len Std", "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean",
    "Bwd Pkt Len Std", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Tot",
    "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Tot", "Bwd IAT Mean",
    "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags",
    "Bwd URG Flags", "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s", "Pkt Len Min",
    "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var", "FIN Flag Cnt", "SYN Flag Cnt",
    "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "URG Flag Cnt", "CWE Flag Count", "ECE Flag Cnt",
    "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg", "Fwd Byts/b Avg",
    "Fwd Pkts/b Avg", "Fwd Blk Rate Avg", "Bwd Byts/b Avg", "Bwd Pkts/b Avg", "Bwd Blk Rate Avg",
    "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts", "Init Fwd Win Byts",
    "Init Bwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min", "Active Mean", "Active Std",
    "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)
REDUCED_FEATURES = (
    "Flow Duration", "Flow Byts/s", "Flow Pkts/s", "Tot Fwd Pkts", "Tot Bwd Pkts", "Pkt Len Mean",
    "Flow IAT Mean", "SYN Flag Cnt", "ACK Flag Cnt",
)
FEATURE_SETS = {"full": FULL_FEATURES, "reduced": REDUCED_FEATURES}

# Capture day -> role in the temporal split.
DAY_ROLES = {
    "2018-02-14": "train_pool",
    "2018-02-15": "train_pool",
    "2018-02-16": "train_pool",
    "2018-02-20": "train_pool",
    "2018-02-21": "train_pool",
    "2018-02-22": "train_pool",
    "2018-02-28": "train_pool",
    "2018-02-23": "test_rare_web",
    "2018-03-01": "test_seen_temporal",
    "2018-03-02": "test_unseen_family",
}


def clean_mapping(pairs: dict[str, str]) -> dict[str, str]:
    """Strip both sides and drop empty entries; an empty result is an error."""
    out = {}
    for raw, name in pairs.items():
        raw, name = str(raw or "").strip(), str(name or "").strip()
        if raw and name:
            out[raw] = name
    if not out:
        raise ValueError("label mapping holds no usable pair")
    return out


def feature_list(names) -> list[str]:
    """Strip names and drop empty ones; an empty result is an error."""
    out = [str(n).strip() for n in names if str(n or "").strip()]
    if not out:
        raise ValueError("feature list holds no name")
    return out


def small_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows of a driver-side lookup as an inline table. Its size is known to the planner, which broadcasts it by itself."""
    cells = {f"c{i}_{j}": cell for i, row in enumerate(rows) for j, cell in enumerate(row)}
    marks = ", ".join("(" + ", ".join(f":c{i}_{j}" for j in range(len(names))) + ")" for i in range(len(rows)))
    return spark.sql(f"SELECT * FROM VALUES {marks} AS t({', '.join(names)})", args=cells)


def label_mapping(spark: SparkSession, pairs: dict[str, str] = LABEL_MAPPING) -> DataFrame:
    return small_table(spark, list(clean_mapping(pairs).items()), ["raw_label", "normalized_label"])


def day_roles(spark: SparkSession, roles: dict[str, str] = DAY_ROLES) -> DataFrame:
    return small_table(spark, list(roles.items()), ["day", "role"]).selectExpr("cast(day as date) as day", "role")
