"""Fixed values of the protocol, the flow-table format and the label vocabulary."""

# Application function codes and their names.
FC_NAMES = {
    0x00: "CONFIRM",
    0x01: "READ",
    0x02: "WRITE",
    0x03: "SELECT",
    0x04: "OPERATE",
    0x05: "DIRECT_OPERATE",
    0x06: "DIRECT_OPERATE_NR",
    0x07: "FREEZE",
    0x08: "FREEZE_NR",
    0x09: "FREEZE_CLEAR",
    0x0A: "FREEZE_CLEAR_NR",
    0x0B: "FREEZE_AT_TIME",
    0x0C: "FREEZE_AT_TIME_NR",
    0x0D: "COLD_RESTART",
    0x0E: "WARM_RESTART",
    0x0F: "INIT_DATA",
    0x10: "INIT_APPLICATION",
    0x11: "START_APPLICATION",
    0x12: "STOP_APP",
    0x13: "SAVE_CONFIG",
    0x14: "INIT_APPLICATION",
    0x15: "DISABLE_UNSOLICITED",
    0x16: "ENABLE_UNSOLICITED",
    0x17: "ASSIGN_CLASS",
    0x18: "DELAY_MEAS",
    0x19: "RECORD_CURRENT_TIME",
    0x81: "RESPONSE",
    0x82: "UNSOLICITED_RESPONSE",
    0x83: "AUTHENTICATION_RESPONSE",
}

# Function codes that count as command injection.
ATTACK_CLASSES = {
    0x0D: "COLD_RESTART",
    0x0E: "WARM_RESTART",
    0x0F: "INIT_DATA",
    0x12: "STOP_APP",
    0x14: "INIT_APPLICATION",
    0x15: "DISABLE_UNSOLICITED",
}

# Control byte of a link status request, server port.
LINK_STATUS_CTRL = 0xC9
DNP3_PORT = 20000

# IDS signature ids per function code (to the server, port 20000).
SIGNATURES = {
    0x0D: (9100001, "DNP3 COMMAND_INJECTION cold_restart"),
    0x0E: (9100002, "DNP3 COMMAND_INJECTION warm_restart"),
    0x0F: (9100003, "DNP3 COMMAND_INJECTION initialize_data"),
    0x12: (9100004, "DNP3 COMMAND_INJECTION stop_appl"),
    0x15: (9100005, "DNP3 COMMAND_INJECTION disable_unsolicited"),
    0x14: (9100006, "DNP3 COMMAND_INJECTION initialize_application"),
}
SIG_RAPID_CONNECTIONS = 9100020
SIG_CLASS0_READ = 9100021
SIG_NONSTANDARD_PORT = 9100030
SIG_REQUEST_FLOOD = 9100040

# Per-flow payload features, in the order of the model input.
PAYLOAD_FEATURES = [
    "total_frames", "fwd_frames", "bwd_frames", "response_ratio",
    "attack_fc_count", "attack_fc_ratio", "link_status_count", "link_status_ratio",
    "unique_fcs", "most_common_req_fc", "fc_read", "fc_cold_restart",
    "fc_warm_restart", "fc_init_data", "fc_stop_app", "fc_init_app",
    "fc_disable_unsol", "fc_response", "fc_unsol_response",
    "mean_udata_len", "max_udata_len", "min_udata_len",
]

# Function codes counted in their own payload feature.
FC_FEATURES = {
    "fc_read": 0x01,
    "fc_cold_restart": 0x0D,
    "fc_warm_restart": 0x0E,
    "fc_init_data": 0x0F,
    "fc_stop_app": 0x12,
    "fc_init_app": 0x14,
    "fc_disable_unsol": 0x15,
    "fc_response": 0x81,
    "fc_unsol_response": 0x82,
}

# Extractor column name -> model column name.
FLOW_RENAME = {
    "src_port": "Src Port",
    "dst_port": "Dst Port",
    "protocol": "Protocol",
    "timestamp": "Timestamp",
    "flow_duration": "Flow Duration",
    "flow_byts_s": "Flow Byts/s",
    "flow_pkts_s": "Flow Pkts/s",
    "fwd_pkts_s": "Fwd Pkts/s",
    "bwd_pkts_s": "Bwd Pkts/s",
    "tot_fwd_pkts": "Tot Fwd Pkts",
    "tot_bwd_pkts": "Tot Bwd Pkts",
    "totlen_fwd_pkts": "TotLen Fwd Pkts",
    "totlen_bwd_pkts": "TotLen Bwd Pkts",
    "fwd_pkt_len_max": "Fwd Pkt Len Max",
    "fwd_pkt_len_min": "Fwd Pkt Len Min",
    "fwd_pkt_len_mean": "Fwd Pkt Len Mean",
    "fwd_pkt_len_std": "Fwd Pkt Len Std",
    "bwd_pkt_len_max": "Bwd Pkt Len Max",
    "bwd_pkt_len_min": "Bwd Pkt Len Min",
    "bwd_pkt_len_mean": "Bwd Pkt Len Mean",
    "bwd_pkt_len_std": "Bwd Pkt Len Std",
    "pkt_len_max": "Pkt Len Max",
    "pkt_len_min": "Pkt Len Min",
    "pkt_len_mean": "Pkt Len Mean",
    "pkt_len_std": "Pkt Len Std",
    "pkt_len_var": "Pkt Len Var",
    "fwd_header_len": "Fwd Header Len",
    "bwd_header_len": "Bwd Header Len",
    "fwd_seg_size_min": "Fwd Seg Size Min",
    "fwd_act_data_pkts": "Fwd Act Data Pkts",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "flow_iat_std": "Flow IAT Std",
    "fwd_iat_tot": "Fwd IAT Tot",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "bwd_iat_tot": "Bwd IAT Tot",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "fin_flag_cnt": "FIN Flag Cnt",
    "syn_flag_cnt": "SYN Flag Cnt",
    "rst_flag_cnt": "RST Flag Cnt",
    "psh_flag_cnt": "PSH Flag Cnt",
    "ack_flag_cnt": "ACK Flag Cnt",
    "urg_flag_cnt": "URG Flag Cnt",
    "ece_flag_cnt": "ECE Flag Cnt",
    "cwr_flag_count": "CWE Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "pkt_size_avg": "Pkt Size Avg",
    "init_fwd_win_byts": "Init Fwd Win Byts",
    "init_bwd_win_byts": "Init Bwd Win Byts",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "fwd_byts_b_avg": "Fwd Byts/b Avg",
    "fwd_pkts_b_avg": "Fwd Pkts/b Avg",
    "bwd_byts_b_avg": "Bwd Byts/b Avg",
    "bwd_pkts_b_avg": "Bwd Pkts/b Avg",
    "fwd_blk_rate_avg": "Fwd Blk Rate Avg",
    "bwd_blk_rate_avg": "Bwd Blk Rate Avg",
    "fwd_seg_size_avg": "Fwd Seg Size Avg",
    "bwd_seg_size_avg": "Bwd Seg Size Avg",
    "subflow_fwd_pkts": "Subflow Fwd Pkts",
    "subflow_bwd_pkts": "Subflow Bwd Pkts",
    "subflow_fwd_byts": "Subflow Fwd Byts",
    "subflow_bwd_byts": "Subflow Bwd Byts",
}

# Identifier and time columns a model never sees.
IDENTIFIER_COLUMNS = [
    "Unnamed: 0.1", "Unnamed: 0", "Flow ID", "Src IP", "Dst IP", "Timestamp",
]

BENIGN = "NORMAL"
COLLAPSED_CLASS = "DNP3_COMMAND_INJECTION"

# Classes told apart by function code only, merged by collapse_labels.
COLLAPSE_MAP = {
    "COLD_RESTART": COLLAPSED_CLASS,
    "WARM_RESTART": COLLAPSED_CLASS,
    "INIT_DATA": COLLAPSED_CLASS,
    "STOP_APP": COLLAPSED_CLASS,
    "DISABLE_UNSOLICITED": COLLAPSED_CLASS,
}

# Classes the payload path detects.
PAYLOAD_CLASSES = [
    "COLD_RESTART", "WARM_RESTART", "INIT_DATA", "STOP_APP",
    "DISABLE_UNSOLICITED", "DNP3_COMMAND_INJECTION",
    "DNP3_INFO", "DNP3_ENUMERATE", "DNP3_RECON",
]

# Data-quality limits of a labelled dataset.
MIN_FLOWS_REBUILD = 30
MIN_FLOWS_WANTED = 100

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128
