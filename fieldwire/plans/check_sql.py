"""Check SQL: the registered queries once more, in ANSI SQL over the same tables.

It works from the columns that generate the traffic, not from payload bytes, and uses
plain windows, joins and recursion where the library uses carried cells and folds.
"""

from __future__ import annotations

from ..constants import ATTACK_CLASSES, COLLAPSE_MAP, FC_FEATURES, FC_NAMES, FLOW_RENAME, PAYLOAD_CLASSES
from .traffic import CLASSES

HOUR = 3_600_000_000
DAY = 24 * HOUR

CLASS_CASE = "CASE event_id % 8 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"

PK = f"""
ev AS (SELECT *, epoch_us(ts) AS ts_us FROM events),
pk0 AS (
  SELECT event_id, event_id AS pkt_no, ts_us, user_id, event_type, value,
    event_id % 5 <> 0 AS fwd,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client,
    40000 + user_id % 20000 AS cport,
    CASE WHEN user_id % 10 = 9 THEN 502 ELSE 20000 END AS sport,
    54 + CAST(floor(value) AS BIGINT) AS ip_len,
    CASE WHEN event_id % 10 = 1 THEN 2 WHEN event_id % 50 = 0 THEN 17
         WHEN event_id % 97 = 0 THEN 20 ELSE 24 END AS flags,
    1000 + event_id % 64000 AS win,
    CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 129
         WHEN 'signup' THEN 13 + event_id % 3 END AS fc0,
    CASE WHEN event_type = 'error' THEN 201 ELSE 196 END AS ctrl,
    CASE WHEN event_type = 'error' THEN 0 ELSE 3 + event_id % 40 END AS udata,
    {CLASS_CASE} AS label
  FROM ev),
pk AS (
  SELECT *, CASE WHEN fwd THEN client ELSE '192.168.10.20' END AS src_ip,
    CASE WHEN fwd THEN cport ELSE sport END AS src_port,
    CASE WHEN fwd THEN '192.168.10.20' ELSE client END AS dst_ip,
    CASE WHEN fwd THEN sport ELSE cport END AS dst_port,
    10 + (udata // 16) * 18 + CASE WHEN udata % 16 > 0 THEN udata % 16 + 2 ELSE 0 END AS wire,
    CASE WHEN event_id % 10 = 1 THEN 0
         ELSE 1 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END
                - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END END AS n_frames
  FROM pk0),
pl AS (
  SELECT *, CASE WHEN event_id % 10 = 1 THEN 0 ELSE
      CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END
      + wire * (1 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)
      - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END END AS pay
  FROM pk),
fr AS (
  SELECT pl.*, f.frame_no, CASE WHEN udata >= 3 THEN fc0 END AS fc,
    event_id % 81 + f.frame_no AS dst, user_id % 65536 AS src,
    CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END + f.frame_no * wire AS pos
  FROM pl JOIN (SELECT 0 AS frame_no UNION ALL SELECT 1) f ON f.frame_no < n_frames),
vd AS (SELECT * FROM pk WHERE event_type IN ('signup', 'view')),
cf AS (
  SELECT event_id, 's' || user_id AS session, 0 AS part, ts_us AS at_us,
    CASE event_type WHEN 'view' THEN 'READ' ELSE 'WRITE' END AS type, event_id % 5 AS point_id,
    CASE WHEN event_type = 'purchase' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value,
    event_id AS seq
  FROM pk WHERE event_type IN ('view', 'purchase') AND event_id % 15 <> 4
  UNION ALL
  SELECT event_id, 's' || user_id, 1, ts_us + event_id % 50 * 1000,
    CASE event_type WHEN 'view' THEN 'READ_RESPONSE' ELSE 'WRITE_RESPONSE' END,
    event_id % 5 + CASE WHEN event_id % 12 = 0 THEN 1 ELSE 0 END,
    CAST(CAST(floor(value) AS BIGINT) + CASE WHEN event_id % 8 = 0 THEN 100 ELSE 0 END AS VARCHAR),
    event_id
  FROM pk WHERE event_type IN ('view', 'purchase') AND event_id % 9 <> 0),
rr AS (
  SELECT q.*, r.type AS resp_type, r.point_id AS resp_point, r.value AS resp_value,
    r.at_us - q.at_us AS latency_us
  FROM cf q LEFT JOIN cf r ON r.part = 1 AND r.session = q.session AND r.seq = q.seq
    AND r.at_us BETWEEN q.at_us AND q.at_us + 40000
  WHERE q.part = 0)
"""


def sql(body: str, ctes: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{PK}{', ' + ctes if ctes else ''} {body}"


def chain(source: str, key: str, gap: int, name: str = "picks") -> str:
    """CTEs for alert-then-silence: ``source`` has (key, ts_us); ``name`` gets the firings."""
    return f"""
{name}_c AS (SELECT DISTINCT {key}, ts_us FROM {source}),
{name}_n AS (SELECT {key}, ts_us, min(ts_us) OVER (PARTITION BY {key} ORDER BY ts_us
    RANGE BETWEEN {gap} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {name}_c),
{name} AS (
  SELECT {key}, min(ts_us) AS ts_us FROM {name}_c GROUP BY {key}
  UNION ALL
  SELECT {', '.join('n.' + k.strip() for k in key.split(','))}, n.nxt
  FROM {name} p JOIN {name}_n n USING ({key}, ts_us) WHERE n.nxt IS NOT NULL)"""


def _payload(forward: str) -> str:
    counts = ", ".join(f"count(*) FILTER (fc = {v}) AS {k}" for k, v in FC_FEATURES.items())
    attack = "(" + ", ".join(map(str, ATTACK_CLASSES)) + ")"
    return sql(f"""
SELECT client AS a_ip, count(*) AS total_frames, count(*) FILTER ({forward}) AS fwd_frames,
  count(*) FILTER (NOT ({forward})) AS bwd_frames,
  round(count(*) FILTER (NOT ({forward})) / count(*), 6) AS response_ratio,
  count(*) FILTER (fc IN {attack}) AS attack_fc_count,
  round(count(*) FILTER (fc IN {attack}) / count(*), 6) AS attack_fc_ratio,
  count(*) FILTER (ctrl = 201) AS link_status_count,
  round(count(*) FILTER (ctrl = 201) / count(*), 6) AS link_status_ratio,
  count(DISTINCT fc) AS unique_fcs, CAST(coalesce(max(common), -1) AS BIGINT) AS most_common_req_fc,
  {counts},
  round(coalesce(avg(udata) FILTER (udata > 0), 0), 6) AS mean_udata_len,
  CAST(coalesce(max(udata) FILTER (udata > 0), 0) AS BIGINT) AS max_udata_len,
  CAST(coalesce(min(udata) FILTER (udata > 0), 0) AS BIGINT) AS min_udata_len
FROM ff LEFT JOIN common USING (user_id) GROUP BY client""", """
ff AS (SELECT *, first_value(fwd) OVER (PARTITION BY user_id ORDER BY pkt_no, frame_no) AS fdir FROM fr),
per_fc AS (SELECT user_id, fc, count(*) AS n, min(pkt_no * 2 + frame_no) AS first FROM fr
           WHERE fc IS NOT NULL GROUP BY user_id, fc),
common AS (SELECT user_id, fc AS common FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id ORDER BY n DESC, first) AS r FROM per_fc) WHERE r = 1)""")


IDLE, ACTIVE, SUB, BULK = 4 * HOUR, HOUR, HOUR // 2, 3 * HOUR

SESSIONS = f"""
s0 AS (SELECT *, lag(ts_us) OVER w AS pts, lag(flags) OVER w AS pfl FROM pl
       WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, pkt_no)),
s1 AS (SELECT *, CASE WHEN pts IS NULL OR pfl IN (17, 20) OR ts_us - pts > {IDLE}
                      THEN 1 ELSE 0 END AS nw FROM s0),
s2 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts_us, pkt_no) AS sid FROM s1)"""

FLOWS = SESSIONS + f""",
s3 AS (SELECT *, fwd = first_value(fwd) OVER ws AS isf,
    first_value(pkt_no) OVER ws AS first_pkt_no,
    CASE WHEN nw = 0 THEN ts_us - pts END AS iat,
    ts_us - lag(ts_us) OVER (PARTITION BY user_id, sid, fwd ORDER BY ts_us, pkt_no) AS diat,
    sum(CASE WHEN nw = 1 OR ts_us - pts > {ACTIVE} THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts_us, pkt_no) AS span
  FROM s2 WINDOW ws AS (PARTITION BY user_id, sid ORDER BY ts_us, pkt_no)),
spans AS (SELECT user_id, sid, span, max(ts_us) - min(ts_us) AS act FROM s3 GROUP BY user_id, sid, span),
acts AS (SELECT user_id, sid, max(act) AS a_max, min(act) AS a_min, avg(act) AS a_mean,
           stddev_pop(act) AS a_std FROM spans GROUP BY user_id, sid),
d0 AS (SELECT *, lag(ts_us) OVER w AS dts, lag(isf) OVER w AS dfw FROM s3 WHERE pay > 0
       WINDOW w AS (PARTITION BY user_id, sid ORDER BY ts_us, pkt_no)),
d1 AS (SELECT *, sum(CASE WHEN dts IS NULL OR dfw <> isf OR ts_us - dts > {BULK} THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id, sid ORDER BY ts_us, pkt_no) AS run FROM d0),
runs AS (SELECT user_id, sid, run, isf, count(*) AS n, sum(pay) AS b, max(ts_us) - min(ts_us) AS dur
         FROM d1 GROUP BY user_id, sid, run, isf HAVING count(*) >= 2),
bulks AS (SELECT user_id, sid,
    sum(b) FILTER (isf) / count(*) FILTER (isf) AS fb, sum(n) FILTER (isf) / count(*) FILTER (isf) AS fp,
    sum(b) FILTER (isf) / nullif(sum(dur) FILTER (isf) / 1e6, 0) AS frt,
    sum(b) FILTER (NOT isf) / count(*) FILTER (NOT isf) AS bb,
    sum(n) FILTER (NOT isf) / count(*) FILTER (NOT isf) AS bp,
    sum(b) FILTER (NOT isf) / nullif(sum(dur) FILTER (NOT isf) / 1e6, 0) AS brt
  FROM runs GROUP BY user_id, sid),
fl AS (SELECT user_id, sid, min(first_pkt_no) AS first_pkt_no,
    first(src_ip ORDER BY ts_us, pkt_no) AS src_ip, first(dst_ip ORDER BY ts_us, pkt_no) AS dst_ip,
    first(src_port ORDER BY ts_us, pkt_no) AS src_port, first(dst_port ORDER BY ts_us, pkt_no) AS dst_port,
    min(ts_us) AS t0, max(ts_us) - min(ts_us) AS dur,
    count(*) FILTER (isf) AS nf, count(*) FILTER (NOT isf) AS nb,
    coalesce(sum(ip_len) FILTER (isf), 0) AS lf, coalesce(sum(ip_len) FILTER (NOT isf), 0) AS lb,
    count(*) FILTER (iat > {SUB}) + 1 AS subs,
    max(ip_len) FILTER (isf) AS lf_max, min(ip_len) FILTER (isf) AS lf_min,
    avg(ip_len) FILTER (isf) AS lf_mean, stddev_pop(ip_len) FILTER (isf) AS lf_std,
    max(ip_len) FILTER (NOT isf) AS lb_max, min(ip_len) FILTER (NOT isf) AS lb_min,
    avg(ip_len) FILTER (NOT isf) AS lb_mean, stddev_pop(ip_len) FILTER (NOT isf) AS lb_std,
    max(ip_len) AS l_max, min(ip_len) AS l_min, avg(ip_len) AS l_mean, stddev_pop(ip_len) AS l_std,
    var_pop(ip_len) AS l_var, count(*) FILTER (isf AND pay > 0) AS act_data,
    max(iat) AS i_max, min(iat) AS i_min, avg(iat) AS i_mean, stddev_pop(iat) AS i_std,
    sum(diat) FILTER (isf) AS fi_tot, max(diat) FILTER (isf) AS fi_max, min(diat) FILTER (isf) AS fi_min,
    avg(diat) FILTER (isf) AS fi_mean, stddev_pop(diat) FILTER (isf) AS fi_std,
    sum(diat) FILTER (NOT isf) AS bi_tot, max(diat) FILTER (NOT isf) AS bi_max,
    min(diat) FILTER (NOT isf) AS bi_min, avg(diat) FILTER (NOT isf) AS bi_mean,
    stddev_pop(diat) FILTER (NOT isf) AS bi_std,
    count(*) FILTER (isf AND flags & 8 <> 0) AS fpsh, count(*) FILTER (NOT isf AND flags & 8 <> 0) AS bpsh,
    count(*) FILTER (flags & 1 <> 0) AS fin, count(*) FILTER (flags & 2 <> 0) AS syn,
    count(*) FILTER (flags & 4 <> 0) AS rst, count(*) FILTER (flags & 8 <> 0) AS psh,
    count(*) FILTER (flags & 16 <> 0) AS ack,
    first(win ORDER BY ts_us, pkt_no) FILTER (isf) AS fwin,
    first(win ORDER BY ts_us, pkt_no) FILTER (NOT isf) AS bwin,
    max(iat) FILTER (iat > {ACTIVE}) AS id_max, min(iat) FILTER (iat > {ACTIVE}) AS id_min,
    avg(iat) FILTER (iat > {ACTIVE}) AS id_mean, stddev_pop(iat) FILTER (iat > {ACTIVE}) AS id_std
  FROM s3 GROUP BY user_id, sid),
al AS (SELECT * FROM fl JOIN acts USING (user_id, sid) LEFT JOIN bulks USING (user_id, sid))"""

_LONG = {
    "src_port": "src_port", "dst_port": "dst_port", "protocol": "6", "timestamp": "t0",
    "tot_fwd_pkts": "nf", "tot_bwd_pkts": "nb", "totlen_fwd_pkts": "lf", "totlen_bwd_pkts": "lb",
    "fwd_pkt_len_max": "lf_max", "fwd_pkt_len_min": "lf_min", "bwd_pkt_len_max": "lb_max",
    "bwd_pkt_len_min": "lb_min", "pkt_len_max": "l_max", "pkt_len_min": "l_min",
    "fwd_header_len": "40 * nf", "bwd_header_len": "40 * nb",
    "fwd_seg_size_min": "CASE WHEN nf > 0 THEN 40 END", "fwd_act_data_pkts": "act_data",
    "fwd_psh_flags": "fpsh", "bwd_psh_flags": "bpsh", "fwd_urg_flags": "0", "bwd_urg_flags": "0",
    "fin_flag_cnt": "fin", "syn_flag_cnt": "syn", "rst_flag_cnt": "rst", "psh_flag_cnt": "psh",
    "ack_flag_cnt": "ack", "urg_flag_cnt": "0", "ece_flag_cnt": "0", "cwr_flag_count": "0",
    "init_fwd_win_byts": "fwin", "init_bwd_win_byts": "bwin",
}
_SECONDS = {
    "flow_duration": "dur", "flow_iat_mean": "i_mean", "flow_iat_max": "i_max",
    "flow_iat_min": "i_min", "flow_iat_std": "i_std",
    **{f"{d}_iat_{s}": f"{d[0]}i_{s}" for d in ("fwd", "bwd") for s in ("tot", "max", "min", "mean", "std")},
    **{f"active_{s}": f"a_{s}" for s in ("max", "min", "mean", "std")},
    **{f"idle_{s}": f"id_{s}" for s in ("max", "min", "mean", "std")},
}
_DOUBLE = {
    "flow_byts_s": "(lf + lb) / nullif(dur / 1e6, 0)", "flow_pkts_s": "(nf + nb) / nullif(dur / 1e6, 0)",
    "fwd_pkts_s": "nf / nullif(dur / 1e6, 0)", "bwd_pkts_s": "nb / nullif(dur / 1e6, 0)",
    "fwd_pkt_len_mean": "lf_mean", "fwd_pkt_len_std": "lf_std", "bwd_pkt_len_mean": "lb_mean",
    "bwd_pkt_len_std": "lb_std", "pkt_len_mean": "l_mean", "pkt_len_std": "l_std", "pkt_len_var": "l_var",
    "down_up_ratio": "nb / nullif(nf, 0)", "pkt_size_avg": "(lf + lb) / (nf + nb)",
    "fwd_byts_b_avg": "fb", "fwd_pkts_b_avg": "fp", "bwd_byts_b_avg": "bb", "bwd_pkts_b_avg": "bp",
    "fwd_blk_rate_avg": "frt", "bwd_blk_rate_avg": "brt", "fwd_seg_size_avg": "lf_mean",
    "bwd_seg_size_avg": "lb_mean", "subflow_fwd_pkts": "nf / subs", "subflow_bwd_pkts": "nb / subs",
    "subflow_fwd_byts": "lf / subs", "subflow_bwd_byts": "lb / subs",
}


def _flow_columns() -> str:
    out = []
    for c in FLOW_RENAME:
        if c in _LONG:
            out.append(f'CAST(coalesce({_LONG[c]}, 0) AS BIGINT) AS "{c}"')
        elif c in _SECONDS:
            out.append(f'round(CAST(coalesce({_SECONDS[c]}, 0) AS DOUBLE) / 1e6, 3) AS "{c}"')
        else:
            digits = 6 if c == "pkt_len_var" else 3
            out.append(f'round(CAST(coalesce({_DOUBLE[c]}, 0) AS DOUBLE), {digits}) AS "{c}"')
    return ", ".join(out)


RECORDS = f"""
sr AS (SELECT *, flags IN (17, 20) AS ends,
    coalesce(sum(CASE WHEN flags IN (17, 20) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
      ORDER BY ts_us, pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends_before
  FROM pk WHERE sport = 20000 AND (n_frames > 0 OR flags IN (17, 20))),
hf AS (SELECT *, lag(ts_us) OVER w AS pts, lag(ends_before) OVER w AS peb FROM sr WHERE n_frames > 0
  WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, pkt_no)),
h2 AS (SELECT *, sum(CASE WHEN pts IS NULL OR ts_us - pts > {IDLE} OR peb <> ends_before THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts_us, pkt_no) AS rec FROM hf),
rc AS (SELECT client AS a_ip, user_id, rec, min(ts_us) AS start_us, max(ts_us) AS end_us,
    CAST(sum(n_frames) AS BIGINT) AS total_frames,
    CAST(coalesce(sum(n_frames) FILTER (fwd), 0) AS BIGINT) AS fwd_frames,
    CAST(coalesce(sum(n_frames) FILTER (event_type = 'signup'), 0) AS BIGINT) AS attack_fc_count,
    count(DISTINCT fc0) FILTER (udata >= 3) AS unique_fcs, max(ends_before) AS eb
  FROM h2 GROUP BY client, user_id, rec)"""

RECORD_COLS = "a_ip, start_us, end_us, total_frames, fwd_frames, attack_fc_count, unique_fcs"

COVER = """
al AS (SELECT src_ip, src_port, dst_ip, dst_port, ts_us, 9100000 + event_id % 7 AS sig_id,
         'sig ' || (event_id % 7) AS sig_name FROM pk WHERE event_type = 'error'),
own AS (SELECT v.event_id, max_by({'i': a.sig_id, 'n': a.sig_name}, (a.ts_us, a.sig_id)) AS s
  FROM vd v JOIN al a USING (src_ip, src_port, dst_ip, dst_port)
  WHERE a.ts_us BETWEEN v.ts_us - 43200000000 AND v.ts_us GROUP BY v.event_id),
oth AS (SELECT v.event_id, max_by({'i': a.sig_id, 'n': a.sig_name}, (a.ts_us, a.sig_id)) AS s
  FROM vd v JOIN al a ON a.src_ip = v.dst_ip AND a.src_port = v.dst_port AND a.dst_ip = v.src_ip
    AND a.dst_port = v.src_port
  WHERE a.ts_us BETWEEN v.ts_us - 43200000000 AND v.ts_us GROUP BY v.event_id),
cv AS (SELECT v.event_id, v.ts_us, v.label, coalesce(own.s, oth.s) AS s FROM vd v
  LEFT JOIN own USING (event_id) LEFT JOIN oth USING (event_id))"""

COVER_COLS = """event_id, label, CASE WHEN label = 'NORMAL' THEN 'ok' WHEN s IS NOT NULL THEN 'SUPPRESS'
  ELSE 'ALERT-AI' END AS kind, CASE WHEN label <> 'NORMAL' THEN s.i END AS sig_id,
  CASE WHEN label <> 'NORMAL' THEN s.n END AS sig_name"""

INJECTION = "cand AS (SELECT * FROM fr WHERE event_type = 'signup')," + chain(
    "cand", "src_ip, fc", 6 * HOUR)
INJECTION_ROWS = """SELECT src_ip, CAST(fc AS BIGINT) AS fc, ts_us, min(pkt_no) AS pkt_no,
  CAST(min_by(frame_no, pkt_no * 2 + frame_no) AS BIGINT) AS frame_no{more}
  FROM cand JOIN picks USING (src_ip, fc, ts_us) GROUP BY src_ip, fc, ts_us"""

BURST = f"""
pr AS (SELECT src_ip, ts_us, pkt_no, frame_no FROM fr WHERE ctrl = 201),
cnt AS (SELECT a.src_ip, a.ts_us, a.pkt_no, a.frame_no, count(*) AS probes FROM pr a JOIN pr b
  ON b.src_ip = a.src_ip AND b.ts_us BETWEEN a.ts_us - {6 * HOUR} AND a.ts_us
  AND b.pkt_no * 2 + b.frame_no <= a.pkt_no * 2 + a.frame_no
  GROUP BY ALL),
dense AS (SELECT * FROM cnt WHERE probes >= 4),""" + chain("dense", "src_ip", 6 * HOUR)
BURST_ROWS = """SELECT src_ip, ts_us, min(pkt_no) AS pkt_no,
  CAST(min_by(frame_no, pkt_no * 2 + frame_no) AS BIGINT) AS frame_no{more}
  FROM dense JOIN picks USING (src_ip, ts_us) GROUP BY src_ip, ts_us"""

HOLES = """h AS (SELECT l_orderkey, l_returnflag,
  CASE WHEN l_orderkey % 7 IN (0, 1) THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 11 IN (0, 1) THEN NULL ELSE l_tax END AS l_tax FROM lineitem)"""

WIDE = """w AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE AS constant,
  l_extendedprice * 2 + l_quantity AS near_copy, l_returnflag AS y FROM lineitem)"""
WIDE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant", "near_copy"]

MI = WIDE + ", " + ", ".join(
    f"e{i} AS (SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM w)"
    for i, c in enumerate(WIDE_COLS)
) + ", bins AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, y, len(list_filter(q, lambda x: {c} > x)) AS b FROM w, e{i}"
    for i, c in enumerate(WIDE_COLS)
) + """),
jn AS (SELECT feature, position, y, b, count(*) AS n FROM bins GROUP BY ALL),
jt AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb,
  sum(n) OVER (PARTITION BY feature, y) AS ny FROM jn),
mi AS (SELECT feature, position, sum(n / t * ln(n * t / (nb * ny))) AS score FROM jt
  GROUP BY feature, position)"""


def _kept(condition: str, ctes: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS pos" for i, c in enumerate(WIDE_COLS))
    return (f"WITH {ctes}, f AS ({rows}) SELECT (SELECT count(*) FROM w) AS n, feature, "
            f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS BIGINT) AS kept FROM f")


MULTI = f"""m AS (SELECT {CLASS_CASE} AS t, CASE (event_id + CASE WHEN event_id % 3 = 0
  THEN CAST(floor(value) AS BIGINT) % 4 ELSE 0 END) % 8 """ + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + """ END AS p FROM events)"""
TRUTH = "m AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p FROM labels)"
SCORES = """lb AS (SELECT DISTINCT t AS label FROM m UNION SELECT DISTINCT p FROM m{extra}),
sc AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label) AS sup,
  count(*) FILTER (p = label) AS pr FROM lb LEFT JOIN m ON t = label OR p = label GROUP BY label),
pc AS (SELECT label, sup, coalesce(tp / nullif(pr, 0), 0) AS precision,
  coalesce(tp / nullif(sup, 0), 0) AS recall, coalesce(2 * tp / nullif(pr + sup, 0), 0) AS f1, tp FROM sc)"""
METRICS = """SELECT round(sum(tp) / sum(sup), 4) AS accuracy,
  round(coalesce(max(precision) FILTER (label = '1'), 0), 4) AS precision,
  round(coalesce(max(recall) FILTER (label = '1'), 0), 4) AS recall,
  round(coalesce(max(f1) FILTER (label = '1'), 0), 4) AS f1, 'binary' AS average FROM pc
UNION ALL SELECT round(sum(tp) / sum(sup), 4), round(avg(precision), 4), round(avg(recall), 4),
  round(avg(f1), 4), 'macro' FROM pc
UNION ALL SELECT round(sum(tp) / sum(sup), 4), round(sum(precision * sup) / sum(sup), 4),
  round(sum(recall * sup) / sum(sup), 4), round(sum(f1 * sup) / sum(sup), 4), 'weighted' FROM pc"""

ALL_CLASSES = sorted({*CLASSES, "NEVER_SEEN"})
CODES = {c: i for i, c in enumerate(sorted(set(CLASSES)))}
NEAR = """nn AS (SELECT t.vec_id, n.vec_id AS neighbour, n.label,
    list_distance(t.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS distance
  FROM embeddings t JOIN embeddings n ON t.vec_id % 5 = 0 AND n.vec_id % 5 <> 0),
nr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM nn)"""
FC_TABLE = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in FC_NAMES.items()) + ") nm(code, name)"
ATTACK_TABLE = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in ATTACK_CLASSES.items()) + ") ak(code, cls)"
PAYLOAD_IN = "(" + ", ".join(f"'{c}'" for c in PAYLOAD_CLASSES) + ")"
COLLAPSE = "CASE WHEN Label IN (" + ", ".join(f"'{c}'" for c in COLLAPSE_MAP) + \
    ") THEN 'DNP3_COMMAND_INJECTION' ELSE Label END"
CL = f"WITH c AS (SELECT *, {CLASS_CASE} AS Label FROM events) "
SUMS = "round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 4) AS tax, count(*) AS n"
OPENED = """
op AS (SELECT s.*, (SELECT max(p.ts_us) FROM picks p WHERE p.src_ip = s.src_ip AND p.ts_us <= s.ts_us)
  AS window_open FROM cand s),
wp AS (SELECT *, row_number() OVER (PARTITION BY src_ip, window_open ORDER BY ts_us, {order}) AS window_pos
  FROM op)"""

KNOWN = """k AS (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  l_returnflag AS Label, l_discount::DOUBLE + CASE WHEN l_returnflag = 'A' THEN 3 ELSE 0 END AS f_a,
  l_tax::DOUBLE + CASE WHEN l_returnflag = 'N' THEN 3 ELSE 0 END AS f_n, l_quantity::DOUBLE / 50 AS f_quantity,
  l_extendedprice::DOUBLE / 100000 AS f_price FROM lineitem)"""
KNOWN_COLS = ["f_a", "f_n", "f_quantity", "f_price"]
RIGHT = f"WITH {KNOWN} SELECT l_orderkey, l_linenumber, Label AS predicted_label, CAST(1 AS BIGINT) AS sure FROM k"
SUMMARY = """SELECT label AS class, count(*) AS count, round(100 * count(*) / (SELECT count(*) FROM vd), 6) AS pct
  FROM vd GROUP BY label UNION ALL SELECT 'TOTAL', count(*), 100.0::DOUBLE FROM vd UNION ALL SELECT 'ATTACKS',
  count(*) FILTER (label <> 'NORMAL'), round(100 * count(*) FILTER (label <> 'NORMAL') / count(*), 6) FROM vd"""

REST = """WITH k AS (SELECT *, l_linenumber <> 1 AS may FROM lineitem), cut AS (
  SELECT CAST(floor(least(1.0::DOUBLE, 2000::DOUBLE / count(*) FILTER (may)) * 4294967296) AS BIGINT) AS c FROM k),
rest AS (SELECT count(*) FILTER (NOT (may AND CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) < c)) AS n
  FROM k, cut) """

SQL = {
    "payload_features": _payload("fwd = fdir"),
    "payload_features_port": _payload("dst_port = 20000"),
    "parse_frames": sql("""SELECT event_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(pos AS BIGINT) AS pos,
      CAST(ctrl AS BIGINT) AS ctrl, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst,
      CAST(fc AS BIGINT) AS fc, CAST(udata AS BIGINT) AS user_data_len, CAST(wire AS BIGINT) AS wire_size
      FROM fr"""),
    "wire_size": """SELECT event_id % 256 AS user_data_len, CAST(max((event_id % 256) // 16 * 18 +
      CASE WHEN event_id % 16 > 0 THEN event_id % 256 % 16 + 2 ELSE 0 END) AS BIGINT) AS wire_size,
      count(*) AS n FROM events GROUP BY 1""",
    "frame_crc": sql("""SELECT event_id, CAST(frame_no AS BIGINT) AS frame_no,
      CAST(event_id % 17 <> 0 AS BIGINT) AS crc_ok FROM fr"""),
    "control_frames": sql("""SELECT event_id, CAST(part AS BIGINT) AS part, session, type,
      CAST(point_id AS BIGINT) AS point_id, value, seq FROM cf"""),
    "control_frames_bad": sql("""SELECT event_id, CAST(0 AS BIGINT) AS part, '{"type": ' AS line FROM pk
      WHERE event_type IN ('view', 'purchase') AND event_id % 15 = 4"""),
    "poll_class": sql("""SELECT CASE WHEN fc = 1 AND udata >= 5 THEN CASE WHEN event_id % 3 = 0
      THEN 'DEVICE_ATTRIBUTES' ELSE 'CLASS_' || (event_id % 4) END ELSE '-' END AS poll_class,
      count(*) AS frames FROM fr GROUP BY 1"""),
    "fc_names": f"""WITH e AS (SELECT CASE WHEN event_id % 161 <> 160 THEN event_id % 161 END AS fc FROM events)
      SELECT CASE WHEN fc IS NULL THEN 'LINK_ONLY' ELSE coalesce(name, printf('FC_0x%02X', fc)) END AS fc_name,
      coalesce(cls, '-') AS attack_class, CAST(cls IS NOT NULL AS BIGINT) AS is_attack,
      CAST(fc IS NULL AS BIGINT) AS link_status, count(*) AS n
      FROM e LEFT JOIN {FC_TABLE} ON nm.code = fc LEFT JOIN {ATTACK_TABLE} ON ak.code = fc
      GROUP BY 1, 2, 3, 4""",
    "starts_frame": sql("""SELECT event_id, CAST(pay AS BIGINT) AS payload_len FROM pl
      WHERE event_id % 10 <> 1 AND event_id % 11 <> 0"""),
    "flow_key": sql("""SELECT client AS a_ip, CAST(cport AS BIGINT) AS a_port, '192.168.10.20' AS b_ip,
      CAST(sport AS BIGINT) AS b_port, count(*) FILTER (fwd) AS ab, count(*) FILTER (NOT fwd) AS ba
      FROM pk GROUP BY client, cport, sport"""),
    "sessionize": sql("""SELECT event_id, first_value(pkt_no) OVER (PARTITION BY user_id, sid
      ORDER BY ts_us, pkt_no) AS first_event, CAST(nw AS BIGINT) AS new_flow FROM s2""", SESSIONS),
    "flow_features": sql(f"SELECT first_pkt_no, src_ip, dst_ip, {_flow_columns()} FROM al", FLOWS),
    "inter_arrival": sql("""SELECT event_id,
      ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, pkt_no) AS flow_iat_us,
      ts_us - lag(ts_us) OVER (PARTITION BY user_id, fwd ORDER BY ts_us, pkt_no) AS dir_iat_us FROM pk"""),
    "verdict_summary": sql("""SELECT label AS class, count(*) AS count,
      round(100 * count(*) / (SELECT count(*) FROM vd), 6) AS pct FROM vd GROUP BY label
      UNION ALL SELECT 'TOTAL', count(*), 100.0::DOUBLE FROM vd
      UNION ALL SELECT 'ATTACKS', count(*) FILTER (label <> 'NORMAL'),
      round(100 * count(*) FILTER (label <> 'NORMAL') / count(*), 6) FROM vd"""),
    "class_share": sql("""SELECT label AS class, count(*) AS count,
      round(100 * count(*) / (SELECT count(*) FROM vd), 6) AS pct FROM vd GROUP BY label"""),
    "class_counts": CL + "SELECT Label, count(*) AS rows FROM c GROUP BY Label",
    "dataset_health": CL + """, n AS (SELECT Label AS label, count(*) AS rows FROM c GROUP BY Label)
      SELECT label, rows, CASE WHEN rows < 30 THEN 'rebuild' WHEN rows < 100 THEN 'few' ELSE 'ok' END AS state,
      CAST((SELECT coalesce(sum(rows) FILTER (label = 'NORMAL'), 0) >= sum(rows) FILTER (label <> 'NORMAL')
      FROM n) AS BIGINT) AS normal_covers_attacks FROM n""",
    "forward_payloads": sql("""SELECT src_ip, pkt_no, row_number() OVER (PARTITION BY src_ip, src_port
      ORDER BY ts_us, pkt_no) AS chunk_no, CAST(pay AS BIGINT) AS bytes FROM pl
      WHERE dst_port = 20000 AND pay > 0"""),
    "replay_totals": sql("""SELECT count(DISTINCT (src_ip, src_port, dst_ip)) AS flows, count(*) AS segments,
      CAST(sum(pay) AS BIGINT) AS bytes FROM pl WHERE dst_port = 20000 AND pay > 0"""),
    "service_port": sql("""SELECT CAST(dst_port AS BIGINT) AS service_port FROM pl WHERE pay > 0
      GROUP BY dst_port ORDER BY count(*) DESC, min(pkt_no) LIMIT 1"""),
    "talker_profile": sql("""SELECT src_ip, dst_ip, count(*) AS packets, CAST(sum(ip_len) AS BIGINT) AS bytes,
      round(coalesce(count(*) / nullif((max(ts_us) - min(ts_us)) / 1e6, 0), 0), 6) AS pkts_per_s,
      count(DISTINCT dst_port) AS dst_ports, count(DISTINCT src_port) AS src_ports
      FROM pk GROUP BY src_ip, dst_ip"""),
    "observe_packets": sql("""SELECT pkt_no, src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip,
      CAST(dst_port AS BIGINT) AS dst_port, CAST(pay AS BIGINT) AS payload_len FROM pl
      WHERE sport = 502 ORDER BY pkt_no LIMIT 25"""),
    "point_last_value": sql("""SELECT CAST(point_id AS BIGINT) AS point_id,
      max_by(value, (at_us, seq)) AS value, max(at_us) AS written_us FROM cf WHERE type = 'WRITE'
      GROUP BY point_id"""),
    "payload_sessions": sql(f"SELECT {RECORD_COLS} FROM rc", RECORDS),
    "suppress_covered": sql(f"SELECT {COVER_COLS} FROM cv", COVER),
    "alert_lines": sql("""SELECT src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip,
      CAST(dst_port AS BIGINT) AS dst_port, 9100000 + event_id % 7 AS sig_id,
      'sig ' || (event_id % 7) AS sig_name, ts_us FROM pk
      WHERE event_type = 'error' AND event_id % 6 NOT IN (0, 1)"""),
    "label_by_window": sql("""SELECT event_id, coalesce((SELECT min_by(r.label, (-r.a, r.label)) FROM ru r
      WHERE e.ts_us BETWEEN r.a AND r.b), 'NORMAL') AS label FROM ev e""",
      f"""ru AS (SELECT 'RUN_' || (event_id % 3) AS label, ts_us AS a,
      ts_us + (1 + event_id % 9) * {HOUR} AS b FROM ev WHERE event_id % 200 = 7)"""),
    "request_response": sql("""SELECT event_id, type, resp_type, CAST(resp_point AS BIGINT) AS resp_point,
      resp_value, latency_us FROM rr"""),
    "echo_mismatch": sql("""SELECT event_id, value, resp_value FROM rr WHERE resp_type IS NOT NULL
      AND (point_id <> resp_point OR (type = 'WRITE' AND value <> resp_value))"""),
    "unanswered_requests": sql("SELECT event_id, session, type FROM rr WHERE resp_type IS NULL"),
    "unauthorised_writers": sql("""SELECT session, event_id FROM cf WHERE type = 'WRITE' AND session NOT IN
      (SELECT 's' || user_id FROM events WHERE user_id % 3 <> 0)"""),
    "restarted_sequences": sql("""SELECT event_id, session, seq, prev_seq FROM (SELECT event_id, session,
      seq % 50 AS seq, lag(seq % 50) OVER (PARTITION BY session ORDER BY at_us, seq % 50) AS prev_seq
      FROM cf WHERE part = 0) WHERE seq IN (1, 7) AND prev_seq >= seq"""),
    "register_range": """WITH x AS (SELECT event_id, 10 + event_id % 12 AS address,
      CAST(floor(value * 2 - 20) AS BIGINT) AS value FROM events WHERE event_type = 'purchase')
      SELECT event_id, address, value, 50 + (address - 10) * 5 AS hi FROM x WHERE address < 20
      AND (value < 0 OR value > 50 + (address - 10) * 5)""",
    "knn_neighbours": f"""WITH {NEAR} SELECT vec_id, neighbour, rank, round(distance, 6) AS distance FROM nr
      WHERE rank <= 5""",
    "knn_vote": f"""WITH {NEAR}, v AS (SELECT vec_id, label, count(*) AS n FROM nr WHERE rank <= 5
      GROUP BY vec_id, label) SELECT vec_id, CAST(min_by(label, (-n, label)) AS BIGINT) AS prediction
      FROM v GROUP BY vec_id""",
    "command_injection": sql(INJECTION_ROWS.format(more=""", CASE fc WHEN 13 THEN 'COLD_RESTART'
      WHEN 14 THEN 'WARM_RESTART' WHEN 15 THEN 'INIT_DATA' END AS attack_class"""), INJECTION, True),
    "scan_burst": sql(BURST_ROWS.format(more=", min_by(probes, pkt_no * 2 + frame_no) AS probes"), BURST, True),
    "block_intervals": sql("""SELECT ip, min(ts_us) AS block_us, max(ts_us) + 108000000000 AS unblock_us,
      count(*) AS blocks, min_by(label, ts_us) AS reason FROM bn GROUP BY ip, g""",
      "cand AS (SELECT * FROM vd WHERE label <> 'NORMAL')," + chain("cand", "src_ip", 6 * HOUR) + f""",
      bl AS (SELECT src_ip AS ip, ts_us, min_by(label, event_id) AS label FROM cand
        JOIN picks USING (src_ip, ts_us) GROUP BY src_ip, ts_us),
      bg AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY ip ORDER BY ts_us) <= {30 * HOUR}
        THEN 0 ELSE 1 END AS f FROM bl),
      bn AS (SELECT *, sum(f) OVER (PARTITION BY ip ORDER BY ts_us) AS g FROM bg)""", True),
    "signature_alerts": sql("""SELECT event_id, CAST(frame_no AS BIGINT) AS frame_no, 9100001 + fc - 13 AS sid,
      'DNP3 COMMAND_INJECTION ' || CASE fc WHEN 13 THEN 'cold_restart' WHEN 14 THEN 'warm_restart'
      ELSE 'initialize_data' END AS msg, 'drop' AS action FROM fr
      WHERE event_type = 'signup' AND dst_port = 20000"""),
    "rapid_connections": sql("""SELECT src_ip, ts_us, pkt_no, window_open, CAST(9100020 AS BIGINT) AS sid
      FROM wp WHERE window_pos = 2""",
      "cand AS (SELECT * FROM pk WHERE dst_port = 20000 AND flags = 2),"
      + chain("cand", "src_ip", 48 * HOUR) + "," + OPENED.format(order="pkt_no"), True),
    "read_policy": sql("""SELECT event_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(9100021 AS BIGINT) AS sid
      FROM fr WHERE fc = 1 AND dst_port = 20000"""),
    "class0_reads": sql("""SELECT event_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(9100021 AS BIGINT) AS sid
      FROM fr WHERE fc = 1 AND dst_port = 20000 AND udata >= 5 AND event_id % 3 <> 0 AND event_id % 4 = 0"""),
    "nonstandard_port": sql("""SELECT event_id, CAST(dst_port AS BIGINT) AS dst_port,
      CAST(9100030 AS BIGINT) AS sid FROM pk WHERE dst_port <> 20000 AND n_frames > 0"""),
    "request_flood": sql("""SELECT src_ip, ts_us, pkt_no, CAST(frame_no AS BIGINT) AS frame_no, window_open,
      window_pos FROM wp WHERE window_pos % 3 = 0""",
      "cand AS (SELECT * FROM fr WHERE dst_port = 20000)," + chain("cand", "src_ip", 48 * HOUR) + ","
      + OPENED.format(order="pkt_no, frame_no"), True),
    "recent_verdicts": sql("SELECT event_id, ts_us, label FROM vd ORDER BY ts_us DESC, event_id DESC LIMIT 500"),
    "running_counters": sql("""SELECT event_id, CASE label WHEN 'NORMAL' THEN 'ok' ELSE 'ALERT-AI' END AS kind,
      count(*) OVER w AS flows_scored, CAST(sum(CASE WHEN label <> 'NORMAL' THEN 1 ELSE 0 END) OVER w AS BIGINT)
      AS alerts FROM vd WINDOW w AS (ORDER BY ts_us, event_id)"""),
    "running_counters_by_source": sql("""SELECT event_id, src_ip, count(*) OVER w AS flows_scored,
      CAST(sum(CASE WHEN label <> 'NORMAL' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS alerts
      FROM vd WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, event_id)"""),
    "replayed_frames": sql("""SELECT event_id, CAST(EXISTS (SELECT 1 FROM q b WHERE b.type = a.type
      AND b.point_id = a.point_id AND b.value IS NOT DISTINCT FROM a.value AND b.session <> a.session
      AND (b.at_us, b.session, b.seq) < (a.at_us, a.session, a.seq)) AS BIGINT) AS repeated,
      CAST(coalesce(seq - ps >= 1000, false) AS BIGINT) AS jumped,
      CAST(coalesce(seq <= ps, false) AS BIGINT) AS backward FROM q a""",
      """q AS (SELECT *, lag(seq) OVER (PARTITION BY session ORDER BY at_us, seq) AS ps FROM cf
      WHERE part = 0)"""),
    "replay_bursts": sql(f"""SELECT first_pkt_no, src_ip, dur AS flow_duration, nf AS tot_fwd_pkts FROM al
      WHERE dur <= {2 * HOUR} AND nf > 1 AND coalesce(i_mean, 0) < {HOUR}
      AND nf / nullif(dur / 1e6, 0) >= 1e-4""", FLOWS),
    "response_delay": sql("""SELECT session, round(a.m, 6) AS mean_us, round(b.m, 6) AS base_us, a.n AS replies
      FROM a JOIN b USING (session) WHERE a.m - b.m >= 2000""",
      f"""a AS (SELECT session, avg(latency_us) AS m, count(*) AS n FROM rr WHERE latency_us IS NOT NULL
        AND at_us >= 1704067200000000 + {15 * DAY} GROUP BY session),
      b AS (SELECT session, avg(latency_us) AS m FROM rr WHERE latency_us IS NOT NULL
        AND at_us < 1704067200000000 + {15 * DAY} GROUP BY session)"""),
    "address_sweep": sql(f"""SELECT src_ip, ts_us // {DAY} * {DAY} AS window_us, count(DISTINCT dst) AS addresses,
      count(*) AS probes FROM fr WHERE ctrl = 201 GROUP BY src_ip, ts_us // {DAY}
      HAVING count(DISTINCT dst) >= 3"""),
    "connection_flood": sql(f"""SELECT src_ip, CAST(dst_port AS BIGINT) AS dst_port,
      ts_us // {DAY} * {DAY} AS window_us, count(*) FILTER (flags = 2) AS connects,
      count(*) FILTER (flags <> 2 AND pay > 0) AS requests FROM pl
      GROUP BY src_ip, dst_port, ts_us // {DAY} HAVING count(*) >= 3"""),
    "rename_columns": """SELECT l_orderkey AS "Src Port", round(sum(l_quantity), 6) AS "Flow Byts/s",
      round(sum(l_tax), 6) AS "CWE Flag Count", CAST(max(l_linenumber) AS BIGINT) AS other
      FROM lineitem GROUP BY l_orderkey""",
    "identifiers_dropped": """SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber,
      round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice,
      round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem
      GROUP BY l_linenumber""",
    "aligned_columns": """SELECT side, round(sum(l_quantity), 2) AS l_quantity,
      round(sum(l_discount), 2) AS l_discount, CAST(sum(l_linenumber) AS DOUBLE) AS l_linenumber
      FROM lineitem, (VALUES ('train'), ('test')) s(side) GROUP BY side""",
    "zero_filled": """SELECT l_returnflag, round(sum(l_tax), 4) AS l_tax, 0.0::DOUBLE AS idle_max,
      0.0::DOUBLE AS bulk, CAST(2 AS BIGINT) AS missing FROM lineitem GROUP BY l_returnflag""",
    "nonfinite_to_null": f"""WITH {HOLES} SELECT l_returnflag, count(l_quantity) AS quantities,
      count(l_tax) AS taxes, count(*) AS n FROM h GROUP BY l_returnflag""",
    "impute_train_median": f"""WITH {HOLES}, md AS (SELECT median(l_quantity) AS q, median(l_tax) AS x FROM h
      WHERE l_orderkey % 5 <> 0), f AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS side,
      coalesce(l_quantity, q) AS l_quantity, coalesce(l_tax, x) AS l_tax FROM h, md)
      SELECT side, {SUMS} FROM f GROUP BY side""",
    "impute_own_median": f"""WITH {HOLES}, md AS (SELECT median(l_quantity) AS q, median(l_tax) AS x FROM h),
      f AS (SELECT l_returnflag, coalesce(l_quantity, q) AS l_quantity, coalesce(l_tax, x) AS l_tax FROM h, md)
      SELECT l_returnflag, {SUMS} FROM f GROUP BY l_returnflag""",
    "impute_zero": f"WITH {HOLES} SELECT l_returnflag, {SUMS} FROM h GROUP BY l_returnflag",
    "lenient_matrix": """SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN value ELSE 0.0 END AS x,
      0.0::DOUBLE AS absent FROM events""",
    "json_numbers": """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k,
      0.0::DOUBLE AS none FROM events""",
    "to_float32": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price32 FROM lineitem""",
    "port_filter": sql("""SELECT event_id, src_ip FROM pk WHERE event_id % 9 <> 0 AND sport = 20000"""),
    "collapse_labels": CL + f"SELECT {COLLAPSE} AS Label, count(*) AS rows FROM c GROUP BY 1",
    "behavioral_only": CL + f"SELECT event_id, Label FROM c WHERE Label NOT IN {PAYLOAD_IN}",
    "payload_classes": CL + f"SELECT event_id, Label FROM c WHERE Label IN {PAYLOAD_IN} OR Label = 'NORMAL'",
    "payload_classes_excluded": CL + f"""SELECT DISTINCT Label FROM c WHERE Label NOT IN {PAYLOAD_IN}
      AND Label <> 'NORMAL'""",
    "binary_label": CL + "SELECT CAST(Label <> 'NORMAL' AS BIGINT) AS attack, count(*) AS n FROM c GROUP BY 1",
    "encode_labels": CL + ", k AS (SELECT event_id, Label, CASE Label " + " ".join(
        f"WHEN '{c}' THEN {i}" for c, i in CODES.items()) + """ END + CASE WHEN event_id % 100 = 3 THEN 90
      ELSE 0 END AS code FROM c) SELECT event_id, CAST(code AS BIGINT) AS label_code,
      CASE WHEN code < 90 THEN Label ELSE '<unk:' || code || '>' END AS decoded FROM k""",
    "label_set": CL + "SELECT DISTINCT Label FROM c",
    "null_labels": CL + """SELECT CASE WHEN event_id % 10 <> 0 THEN Label ELSE '(none)' END AS Label,
      count(*) AS rows FROM c GROUP BY 1""",
    "routable_addresses": """SELECT event_id, CAST(CASE event_id % 8 WHEN 2 THEN user_id <= 55 WHEN 3 THEN true
      WHEN 7 THEN true ELSE false END AS BIGINT) AS routable FROM events""",
    "verdict_kinds": sql("""SELECT event_id, CASE WHEN label = 'NORMAL' THEN 'ok' WHEN event_id % 3 = 0
      THEN 'SUPPRESS' ELSE 'ALERT-AI' END AS kind,
      CASE WHEN label = 'NORMAL' THEN 'ok' ELSE 'ALERT' END AS plain_kind FROM vd"""),
    "pick_classes": CL + "SELECT event_id, Label FROM c WHERE Label IN ('REPLAY', 'MITM_DOS')",
    "seeded_shuffle": """SELECT event_id, row_number() OVER (ORDER BY md5('42|' || event_id), event_id) AS position
      FROM events""",
    "quantiles_with_infinities": """WITH r AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL WHEN l_discount = 0
      THEN 'inf'::DOUBLE ELSE l_quantity::DOUBLE / l_discount::DOUBLE END AS rate,
      CASE WHEN l_linenumber >= 6 THEN l_quantity::DOUBLE END AS v FROM lineitem),
      o AS (SELECT 'rate' AS f, rate AS v FROM r WHERE rate IS NOT NULL UNION ALL SELECT 'minus', -rate FROM r
      WHERE rate IS NOT NULL UNION ALL SELECT 'some', v FROM r WHERE v IS NOT NULL),
      n AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY f) AS n FROM o),
      p AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.9, 1.0]) AS p, unnest(range(5)) AS i),
      lo AS (SELECT f, i, p * (n - 1) AS r, v, n FROM n JOIN p ON k = CAST(floor(p * (n - 1)) AS BIGINT))
      SELECT lo.f AS feature, lo.i, round(CASE WHEN lo.v = hi.v OR r = floor(r) THEN lo.v
      ELSE lo.v + (hi.v - lo.v) * (r - floor(r)) END, 6) AS q
      FROM lo JOIN n hi ON hi.f = lo.f AND hi.k = least(CAST(floor(r) AS BIGINT) + 1, lo.n - 1)""",
    "correlation_with_nulls": "WITH w AS (SELECT " + ", ".join(
        f"CASE WHEN l_orderkey % {i + 2} <> 0 THEN {('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')[i % 4]}"
        f"::DOUBLE + {i // 4} * l_linenumber END AS c{i}" for i in range(20)) + " FROM lineitem) " + " UNION ALL ".join(
        f"SELECT 'c{i}' AS left, 'c{j}' AS right, round(coalesce(abs(corr(c{i}, c{j})), -1), 6) AS r FROM w"
        for i in range(20) for j in range(i + 1, 20)),
    "split_exact": """SELECT event_id, CAST(row_number() OVER (ORDER BY md5('42|' || event_id), event_id)
      <= floor((SELECT count(*) FROM events) * (1 - 0.2::DOUBLE)) AS BIGINT) AS is_train FROM events""",
    "split_hash": """SELECT event_id, CAST(substr(md5('42|' || event_id), 1, 8) < 'cccccccc' AS BIGINT)
      AS is_train FROM events""",
    "validation_split": """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey)
      <= floor((SELECT count(*) FROM orders) * (1 - 0.15::DOUBLE)) AS BIGINT) AS is_train FROM orders""",
    "union_datasets": """SELECT 'line' AS source, count(*) AS n, count(l_tax) AS taxes,
      CAST(0 AS BIGINT) AS prices FROM lineitem UNION ALL
      SELECT 'order', count(*), 0, count(o_totalprice) FROM orders""",
    "label_differences": CL + """, a AS (SELECT DISTINCT Label FROM c WHERE event_id % 8 < 6),
      b AS (SELECT DISTINCT Label FROM c WHERE event_id % 8 >= 4)
      SELECT Label, 'left' AS "where" FROM a WHERE Label NOT IN (FROM b)
      UNION ALL SELECT Label, 'right' FROM b WHERE Label NOT IN (FROM a)
      UNION ALL SELECT Label, 'both' FROM a WHERE Label IN (FROM b)""",
    "zero_variance": _kept("feature <> 'constant'", WIDE),
    "correlation_pairs": f"WITH {WIDE} " + " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", " + (
            "CASE WHEN count(*) > 0 THEN -1.0::DOUBLE END" if "constant" in (a, b)
            else f"round(abs(corr({a}, {b})), 6)") + " AS r FROM w"
        for i, a in enumerate(WIDE_COLS) for b in WIDE_COLS[i + 1:]),
    "correlated_columns": _kept("feature <> 'near_copy'", WIDE),
    "mutual_information": f"WITH {MI} SELECT feature, round(score, 6) AS score FROM mi",
    "top_features": f"""WITH {MI} (SELECT feature, 'top_k' AS part, round(score, 6) AS score FROM mi
      ORDER BY mi.score DESC, position LIMIT 3) UNION ALL (SELECT feature, 'report', round(score, 4) FROM mi
      ORDER BY mi.score DESC, position LIMIT 5)""",
    "select_corr": _kept("feature IN (SELECT feature FROM mi WHERE feature <> 'near_copy' "
                         "ORDER BY score DESC, position LIMIT 3)", MI),
    "scaler": f"WITH {WIDE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 "
        f"ELSE stddev_pop({c}) END, 4) AS scale FROM w" for c in WIDE_COLS),
    "standard_scale": f"WITH {WIDE}, st AS (SELECT " + ", ".join(
        f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s{i}"
        for i, c in enumerate(WIDE_COLS)) + " FROM w) SELECT y AS Label, " + ", ".join(
        f"round(avg(({c} - m{i}) / s{i}), 6) AS {c}" for i, c in enumerate(WIDE_COLS)) + " FROM w, st GROUP BY y",
    "metrics_binary": f"WITH {TRUTH}, {SCORES.format(extra='')} {METRICS}",
    "metrics_multiclass": f"WITH {MULTI}, {SCORES.format(extra='')} {METRICS}",
    "roc_auc": """WITH r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_extendedprice)
      + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS k FROM lineitem)
      SELECT round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2)
      / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 4) AS roc_auc FROM r""",
    "classification_report": "WITH " + MULTI + ", " + SCORES.format(extra=" UNION SELECT 'NEVER_SEEN'") + """
      SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      sup AS support FROM pc
      UNION ALL SELECT 'accuracy', round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6),
      round(sum(tp) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM pc
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
      CAST(sum(sup) AS BIGINT) FROM pc
      UNION ALL SELECT 'weighted avg', round(sum(precision * sup) / sum(sup), 6),
      round(sum(recall * sup) / sum(sup), 6), round(sum(f1 * sup) / sum(sup), 6), CAST(sum(sup) AS BIGINT)
      FROM pc""",
    "worst_classes": f"WITH {MULTI}, {SCORES.format(extra='')} SELECT label, round(f1, 6) AS f1 FROM pc",
    "confusion_matrix": f"WITH {MULTI} SELECT l AS y_true, " + ", ".join(
        f"count(*) FILTER (p = '{c}') AS \"{c}\"" for c in ALL_CLASSES)
    + " FROM (VALUES " + ", ".join(f"('{c}')" for c in ALL_CLASSES) + ") x(l) LEFT JOIN m ON t = l GROUP BY l",
    "threshold_predict": """SELECT CAST(l_discount * 10 >= 0.5 AS BIGINT) AS predicted, count(*) AS n
      FROM lineitem GROUP BY 1""",
    "rank_models": """WITH r AS (SELECT lang AS model, round(avg(CAST(n_chars > 1000 AS DOUBLE)), 4) AS f1
      FROM documents GROUP BY lang) (SELECT model, f1, 'best' AS part FROM r ORDER BY f1 DESC, model LIMIT 1)
      UNION ALL SELECT model, f1, 'all' FROM r""",
    "live_command_injection": sql(INJECTION_ROWS.format(more=""), INJECTION, True),
    "live_scan_burst": sql(BURST_ROWS.format(more=""), BURST, True),
    "live_blocks": sql(f"""SELECT src_ip, ts_us, min_by(label, event_id) AS label, ts_us + {8 * HOUR} AS unblock_us FROM cand
      JOIN picks USING (src_ip, ts_us) GROUP BY src_ip, ts_us""",
      "cand AS (SELECT * FROM vd WHERE label <> 'NORMAL')," + chain("cand", "src_ip", 6 * HOUR), True),
    "live_payload_sessions": sql(f"SELECT {RECORD_COLS} FROM rc", RECORDS),
    "live_suppress": sql(f"SELECT {COVER_COLS} FROM cv", COVER),
    "late_command_injection": sql(INJECTION_ROWS.format(more=""), INJECTION, True),
    "late_payload_sessions": sql(f"SELECT {RECORD_COLS} FROM rc", RECORDS),
    "late_suppress": sql(f"SELECT {COVER_COLS} FROM cv", COVER),
    "live_payload_verdicts": sql("""SELECT a_ip, start_us, end_us, total_frames, CASE WHEN attack_fc_count > 0 THEN 'COLD_RESTART'
      ELSE 'NORMAL' END AS label, CASE WHEN attack_fc_count > 0 THEN 'ALERT-PAYLOAD-ML' ELSE 'ok' END AS kind FROM rc""", RECORDS),
    "live_scored_flows": sql(SUMMARY.replace("vd", "judged"), FLOWS + """, judged AS (SELECT CASE WHEN rst + fin > 0 THEN 'ATTACK'
      ELSE 'NORMAL' END AS label FROM al)"""),
    "stream_alerts": sql("""SELECT 9100000 + event_id % 7 AS sig_id, 'sig ' || (event_id % 7) AS sig_name, count(*) AS n,
      min(ts_us) AS first_us, count(DISTINCT src_ip) AS sources FROM pk WHERE event_type = 'error' GROUP BY ALL"""),
    "live_log": sql(
        f"""SELECT v.ts_us, k.kind, v.src_ip, k.label, k.sig_id, k.sig_name FROM (SELECT {COVER_COLS} FROM cv) k JOIN vd v USING (event_id)
      UNION ALL SELECT ts_us, 'ALERT-PAYLOAD', src_ip, CASE fc {' '.join(f"WHEN {c} THEN '{n}'" for c, n in ATTACK_CLASSES.items())} END, NULL, NULL FROM inj
      UNION ALL SELECT ts_us, 'ALERT-PAYLOAD', src_ip, 'DNP3_RECON', NULL, NULL FROM bur
      UNION ALL SELECT end_us, 'ALERT-PAYLOAD-ML', a_ip, 'COLD_RESTART', NULL, NULL FROM rc WHERE attack_fc_count > 0""",
        COVER + ", " + RECORDS + ", " + INJECTION.replace("event_type = 'signup'", "event_type = 'signup' AND sport = 20000")
        + ", inj AS (" + INJECTION_ROWS.format(more="") + "), "
        + BURST.replace("ctrl = 201", "ctrl = 201 AND sport = 20000").replace("picks", "bpicks") + ", bur AS ("
        + BURST_ROWS.format(more="").replace("picks", "bpicks") + ")", True),
    "live_unified": sql(
        "SELECT src_ip, fc, ts_us, pkt_no, frame_no, 'COMMAND_INJECTION' AS kind FROM inj UNION ALL "
        "SELECT src_ip, CAST(NULL AS BIGINT), ts_us, pkt_no, frame_no, 'DNP3_RECON' FROM bur",
        INJECTION + ", inj AS (" + INJECTION_ROWS.format(more="") + "), "
        + BURST.replace("picks", "bpicks") + ", bur AS ("
        + BURST_ROWS.format(more="").replace("picks", "bpicks") + ")", True),
    **{f"model_{m}": RIGHT for m in ("logistic", "tree", "forest", "mlp")},
    **dict.fromkeys(("model_boost", "model_svm"), RIGHT.replace("Label AS predicted_label", "CASE Label WHEN 'A' THEN 'ATTACK' ELSE 'NORMAL' END AS predicted_label")),
    "importance": "SELECT unnest(['f_a', 'f_n']) AS feature",
    "compare_models": REST + """SELECT unnest(['Logistic Regression', 'Decision Tree', 'Random Forest', 'Boosted Trees',
      'SVM (RBF)', 'MLP', 'KNN (k=5)']) AS model, (SELECT n FROM rest) AS rows, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1""",
    "sweep_features": REST + """SELECT (SELECT n FROM rest) AS rows, unnest(['all', 'variance', 'smart-30', 'smart-40', 'smart-50', 'importance-30',
      'importance-40', 'top-30', 'top-40']) AS mode, CAST(unnest([45, 44, 30, 40, 44, 30, 40, 30, 40]) AS BIGINT) AS features,
      1.0::DOUBLE AS accuracy""",
    "scored_flows": sql(SUMMARY.replace("vd", "judged"), FLOWS + """, judged AS (SELECT CASE WHEN rst + fin > 0 THEN 'ATTACK'
      ELSE 'NORMAL' END AS label FROM al)"""),
    "model_bundle": f"WITH {KNOWN} " + " UNION ALL ".join(
        f"SELECT 'feature' AS part, CAST({i} AS BIGINT) AS position, '{c}' AS name, round(avg({c}), 4) AS mean, "
        f"round(stddev_pop({c}), 4) AS scale FROM k" for i, c in enumerate(KNOWN_COLS)) + """ UNION ALL
      SELECT 'label', row_number() OVER (ORDER BY Label) - 1, Label, NULL, NULL FROM (SELECT DISTINCT Label FROM k)""",
    "bundle_scores": f"WITH {KNOWN}, m AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in KNOWN_COLS) + ") FROM k) SELECT Label, ".replace(") FROM", " FROM") + ", ".join(
        f"round(avg(({c} - m_{c}) / s_{c}), 6) AS {c}" for c in KNOWN_COLS) + " FROM k, m GROUP BY Label",
    "payload_model": "WITH pf AS (" + _payload("fwd = fdir") + """), n AS (SELECT CASE WHEN attack_fc_count > 0
      THEN 'COLD_RESTART' ELSE 'NORMAL' END AS label, count(*) AS support FROM pf WHERE substr(md5(a_ip), 1, 1) < '8' GROUP BY 1)
      SELECT label, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, support FROM n UNION ALL
      SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), 1.0, 1.0, 1.0, CAST((SELECT sum(support) FROM n) AS BIGINT)""",
    "saved_model": f"WITH {KNOWN} SELECT Label, Label AS predicted_label, count(*) AS n FROM k GROUP BY Label",
    "flow_csv": sql("""SELECT 'say "' || event_type || '", twice' AS Label, count(*) AS n, round(sum(value), 2) AS duration,
      CAST(sum(54 + floor(value)) AS DOUBLE) AS length FROM events GROUP BY 1"""),
    "flow_csv_stream": sql("SELECT src_ip AS Label, count(*) AS n, round(sum(value), 2) AS duration FROM pk GROUP BY 1"),
    "labelled_tables": """SELECT 'say "' || event_type || '", twice' AS Label, count(*) AS n, count(*) AS lengths FROM events
      GROUP BY 1 UNION ALL SELECT 'other', count(*), CAST(0 AS BIGINT) FROM events""",
    "labelled_dir": sql("""SELECT 'REPLAY' AS Label, count(*) AS n, count(*) AS lengths, round(sum(value), 2) AS duration FROM pk
      UNION ALL SELECT 'STOP_APP', count(*), 0, round(sum(value), 2) FROM pk
      UNION ALL SELECT 'NORMAL', count(*), count(*), round(sum(value), 2) FROM pk WHERE value > 0"""),
    "results_table": CL + "SELECT Label, count(*) AS rows FROM c GROUP BY Label",
    "hex_payloads": """SELECT event_id || '-' || event_type AS text, CAST(length(event_id || '-' || event_type) AS BIGINT) AS size
      FROM events WHERE event_id % 10 <> 0""",
    "feature_list": CL + "SELECT row_number() OVER (ORDER BY Label) - 1 AS position, Label AS name FROM (SELECT DISTINCT Label FROM c)",
    "capture_files": sql("""SELECT ts_us, src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip, CAST(dst_port AS BIGINT) AS dst_port,
      CAST(flags AS BIGINT) AS tcp_flags, CAST(win AS BIGINT) AS win, CAST(40 AS BIGINT) AS hdr_len,
      CAST(pkt_no % 7 AS BIGINT) AS payload_len, repeat('AB', CAST(pkt_no % 7 AS INTEGER)) AS payload FROM pk
      WHERE NOT (pkt_no % 23 = 0 AND pkt_no % 6 IN (1, 2, 5))"""),
    "capture_records": sql("""SELECT CAST(CASE pkt_no % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 12 WHEN 4 THEN 101 ELSE 113 END AS BIGINT)
      AS link, count(*) AS records, CAST(0 AS BIGINT) AS cut_bytes FROM pk GROUP BY 1"""),
    "packet_records": sql("""SELECT pkt_no, src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip, CAST(dst_port AS BIGINT) AS dst_port,
      CAST(flags AS BIGINT) AS tcp_flags, CAST(win AS BIGINT) AS win, CAST(40 AS BIGINT) AS hdr_len,
      CAST(pkt_no % 7 AS BIGINT) AS payload_len, repeat('AB', CAST(pkt_no % 7 AS INTEGER)) AS payload FROM pk
      WHERE NOT (pkt_no % 23 = 0 AND pkt_no % 6 IN (1, 2, 5))"""),
}
