"""Column lists, markers and class maps of the flow pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields of a raw connection log, in order.
RAW_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents"]
LABEL_FIELDS = ["label", "detailed-label"]
DROPPED_FIELDS = ["service", "local_orig", "local_resp", "tunnel_parents"]
FEATURES = [f for f in RAW_FIELDS if f not in DROPPED_FIELDS]
CATEGORICAL = ["uid", "id.orig_h", "id.resp_h", "proto", "conn_state", "history"]
NUMERIC = [f for f in FEATURES if f not in CATEGORICAL]
RENAMED = {"det_label": "detailed-label"}
# Fields that one header cell may hold together, in audits.
MERGED_HEADERS = [["tunnel_parents", "label", "detailed-label"], ["tunnel_parents", "label", "det_label"]]
# What stands for a missing value, after trimming, in any case; and an empty set.
MISSING_MARKERS = ["", "-", "nan", "null", "none"]
EMPTY_MARKER = "(empty)"
# Labels, trimmed and in lower case, that mean benign traffic.
BENIGN_TOKENS = ["benign", "normal", "normal traffic", "benigntraffic", "benign_traffic"]
TARGETS = {"benign": 0, "malicious": 1}
SPLITS = {"train": 0, "validation": 1, "test": 2, "unused": -1}
# Names under which a label column is looked for, in this order.
LABEL_CANDIDATES = ["label", "Label", "LABEL", "attack", "Attack", "attack_type", "Attack_Type", "Attack Type", "type", "Type", "category", "Category", "traffic_type", "Traffic_Type", "Traffic Type"]
# The class of each exact detailed label.
PAPER_CLASSES = {"DDoS": "DDoS", "Okiru": "Mirai", "Kenjiro": "Mirai", "Hakai": "Mirai", "Hajime": "Mirai", "Muhstik": "Mirai", "Attack": "Web-based", "PartOfAHorizontalPortScan": "Recon", "C&C": "Recon"}
WINDOW_ROWS = 15
UNKNOWN_CODE, MISSING_CODE = -1, -2


def all_strings(names: list[str]) -> T.StructType:
    """A schema that keeps every cell's text as it stands."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
