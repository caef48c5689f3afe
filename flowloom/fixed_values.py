"""Names, tables, thresholds and patterns that results depend on.

Everything in this module is data, not logic.  The values are fixed by the
labelled-flow data set, the flow-feature contract and the detection policy; a
different value would give different results.
"""

from __future__ import annotations

import re

# --- fixed values: traffic classes, in class-id order ----------------------
CLASSES = (
    "BENIGN",
    "Bot",
    "BruteForce",
    "DDoS",
    "DoS",
    "Heartbleed",
    "Infiltration",
    "PortScan",
    "WebAttack",
)

# --- fixed values: raw label -> traffic class -------------------------------
LABEL_CLASSES = {
    "BENIGN": "BENIGN",
    "Bot": "Bot",
    "DDoS": "DDoS",
    "PortScan": "PortScan",
    "Infiltration": "Infiltration",
    "Heartbleed": "Heartbleed",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "FTP-Patator": "BruteForce",
    "SSH-Patator": "BruteForce",
    "Web Attack - Brute Force": "WebAttack",
    "Web Attack - XSS": "WebAttack",
    "Web Attack - Sql Injection": "WebAttack",
}

# --- fixed values: label clean-up patterns, applied in this order -----------
LABEL_CLEANUP = (
    ("[–—�­ï¿½]+", " - "),
    (r"\s*-\s*", "-"),
    (r"^Web Attack-", "Web Attack - "),
    (r"\s+", " "),
)

# --- fixed values: IP protocol numbers and TCP flag bits --------------------
ICMP, IGMP, TCP, UDP = 1, 2, 6, 17
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32

# --- fixed values: time limits of a flow, in microseconds -------------------
IDLE_TIMEOUT_US = 120_000_000
HALF_OPEN_TIMEOUT_US = 5_000_000
BURST_GAP_US = 1_000_000

# --- fixed values: the forty flow features, in model order ------------------
FLOW_FEATURES = (
    "Destination Port", "Flow Duration", "Total Fwd Packets",
    "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Min", "Bwd Packet Length Std", "Flow Bytes/s",
    "Flow Packets/s", "Flow IAT Std", "Flow IAT Min", "Fwd IAT Total",
    "Fwd IAT Std", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Std",
    "Bwd IAT Min", "Fwd Header Length", "Bwd Header Length", "Bwd Packets/s",
    "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "FIN Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
    "Down/Up Ratio", "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "act_data_pkt_fwd", "min_seg_size_forward", "Active Mean", "Idle Mean",
    "Idle Std",
)

# --- fixed values: columns of a labelled-flow file after the equal copies are
# --- dropped, in file order --------------------------------------------------
LABELLED_FEATURES = (
    "Destination Port", "Flow Duration", "Total Fwd Packets",
    "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean",
    "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total",
    "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max",
    "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags",
    "Bwd URG Flags", "Fwd Header Length", "Bwd Header Length",
    "Fwd Packets/s", "Bwd Packets/s", "Min Packet Length",
    "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance", "FIN Flag Count", "SYN Flag Count",
    "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
    "CWE Flag Count", "ECE Flag Count", "Down/Up Ratio",
    "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Bytes", "Subflow Bwd Bytes", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean",
    "Idle Std", "Idle Max", "Idle Min",
)
TARGET = "Label"
PROVENANCE = ("_source_file", "_capture_day", "_source_row")
EXPECTED_FILES = 8
EXPECTED_COLUMNS = 79

# --- fixed values: columns that may be copies of another one (copy -> original)
COPY_COLUMNS = {
    "Fwd Header Length.1": "Fwd Header Length",
    "Subflow Fwd Packets": "Total Fwd Packets",
    "Subflow Fwd Bytes": "Total Length of Fwd Packets",
    "Subflow Bwd Packets": "Total Backward Packets",
    "Subflow Bwd Bytes": "Total Length of Bwd Packets",
}

# --- fixed values: which columns of a labelled file cannot be negative ------
NONNEGATIVE_WORDS = (
    "Duration", "Packets", "Packet", "Bytes", "Length", "IAT", "Header",
    "Active", "Idle", "Bulk", "Segment", "Subflow",
)
NONNEGATIVE_EXTRA = (
    "Flow Bytes/s", "Flow Packets/s", "Down/Up Ratio", "act_data_pkt_fwd",
)
NEGATIVE_ALLOWED = ("Init_Win_bytes_forward", "Init_Win_bytes_backward")
FLAG_COLUMNS = (
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
)

# --- fixed values: columns never log-transformed or clipped -----------------
NEVER_LOGGED = (
    "Destination Port", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags",
    "Bwd URG Flags", "FIN Flag Count", "SYN Flag Count", "RST Flag Count",
    "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWE Flag Count",
    "ECE Flag Count", "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "min_seg_size_forward",
)

# --- fixed values: columns whose negatives count as missing when scoring ----
SCORING_NONNEGATIVE = (
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min",
    "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min",
    "Bwd Packet Length Mean", "Bwd Packet Length Std", "Flow Bytes/s",
    "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s",
    "Bwd Packets/s", "Max Packet Length", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance", "Average Packet Size",
    "Avg Fwd Segment Size", "Avg Bwd Segment Size", "Subflow Fwd Bytes",
    "Subflow Bwd Bytes", "Active Mean", "Active Std", "Active Max",
    "Idle Mean", "Idle Std", "Idle Max",
)
PORT_COLUMNS = ("Source Port", "Destination Port")

# --- fixed values: fitting ---------------------------------------------------
SEED = 42
TRAIN_SHARE = 0.80
CORRELATION_LIMIT = 0.98
SELECTED_FEATURES = 40
CLIP_QUANTILES = (0.001, 0.999)
SKEW_LIMIT = 1.0
CONTINUOUS_DISTINCT = 20
SCALE_QUANTILES = (0.25, 0.75)
MI_NEIGHBOURS = 3
DEGRADED_SHARE = 0.20
PREPROCESSING_VERSION = 3
# Sizes of the learners.
FOREST_TREES, FOREST_DEPTH = 160, 20
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE, BOOST_SUBSAMPLE, BOOST_COLUMNS = 220, 8, 0.1, 0.8, 0.8
MLP_LAYERS, MLP_ITERATIONS, MLP_PATIENCE = (96, 48, 24), 100, 8

RARE_CLASS_ROWS = 100
KNOWN_CLASSES = (0, 1, 2, 3, 4, 5)
UNSEEN_CLASSES = (6, 7, 8)
CONFIDENCE_BINS = 30

# --- fixed values: traffic filter and detection rules -----------------------
BYPASS_PORTS = (67, 68, 137, 138, 161, 162, 1900, 5353, 5355)
SCAN_IGNORED_PORTS = (80, 443, 53, 3001, 8000, 5173, 137, 138, 1900, 5353, 5355)
LOGIN_PORTS = (22, 23, 21, 3389, 5900, 445, 139, 25, 110, 143)
ATTACK_THRESHOLD = 0.80
SCAN_WINDOW_US = 1_500_000
SCAN_MIN_PORTS = 5
SCAN_COOLDOWN_US = 5_000_000
FLOOD_MIN_PACKETS = 10
FLOOD_DDOS_PACKETS = 100
BRUTE_MIN_PACKETS = 50
RULE_CONFIDENCE = 0.90
RULE_BENIGN_WEIGHT = 0.08
RULE_OTHER_WEIGHT = 0.01

# --- fixed values: threat level ----------------------------------------------
THREAT_WINDOW_S = 60
ELEVATED_ATTACKS = 1
CRITICAL_ATTACKS = 6

# --- fixed values: report lines ------------------------------------------------
LEVEL_ADVICE = (
    ("CRITICAL", "Threat level is CRITICAL. Initiate immediate incident response."),
    ("CRITICAL", "Consider isolating affected network segments and blocking top attacker IPs."),
    ("ELEVATED", "Threat level is ELEVATED. Increase monitoring of suspicious traffic."),
)
TYPE_ADVICE = (
    ("DDoS", "DDoS attacks detected. Ensure rate limiting and DDoS mitigation are active."),
    ("BruteForce", "Brute-force attacks detected. Enforce strong password policies and account lockout."),
    ("PortScan", "Port scanning detected. Review firewall rules and close unused ports."),
    ("Bot", "Botnet activity detected. Quarantine affected hosts and investigate C2 communication."),
    ("Infiltration", "Infiltration attempts detected. Conduct a full forensic audit of affected systems."),
    ("WebAttack", "Web attacks detected. Deploy WAF rules and audit web application logs."),
    ("DoS", "Denial-of-service attacks detected. Verify service availability and load balancing."),
    ("Heartbleed", "Heartbleed exploit attempts detected. Patch OpenSSL on all servers immediately."),
)
CALM_ADVICE = "No critical threats detected. Maintain regular monitoring and keep systems patched."
CLOSING_ADVICE = "Regularly update intrusion detection model signatures and review alert configurations."

# --- fixed values: alerting ----------------------------------------------------
CHAT_COOLDOWN_S = 30
MAIL_COOLDOWN_S = 300


def snake(name: str) -> str:
    """Physical column name of a data-set feature name (``Flow Bytes/s`` -> ``flow_bytes_per_s``)."""
    text = name.replace("/s", "_per_s").replace("/", "_")
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


FEATURE_COLUMNS = tuple(snake(n) for n in FLOW_FEATURES)
LABELLED_COLUMNS = tuple(snake(n) for n in LABELLED_FEATURES)
DISPLAY_NAMES = {snake(n): n for n in LABELLED_FEATURES + tuple(COPY_COLUMNS)}


def nonnegative_columns(names) -> list[str]:
    """Names among *names* (display form) for which a negative value is invalid."""
    return [
        n for n in names
        if n not in NEGATIVE_ALLOWED
        and (n in FLAG_COLUMNS or n in NONNEGATIVE_EXTRA or any(w in n for w in NONNEGATIVE_WORDS))
    ]
