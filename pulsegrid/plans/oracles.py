"""The same results in plain SQL over the supplied tables.

Shared parts are named common table expressions; `sql` puts the ones a query uses
in front of it.
"""

import math
import re

SIGNALS = ["click", "error", "purchase", "signup", "view"]
LABELS = ["label_6h", "label_12h", "label_24h"]
STATS = ["mean", "stddev", "min", "max", "last", "slope"]
IDS = "user_id, window_start_time, window_end_time"
TREE = [f"{s}_{t}" for s in SIGNALS for t in ("mean", "min", "max", "last")]
LAST = [f"{s}_last" for s in SIGNALS]


def r(expr: str, name: str | None = None) -> str:
    """Six decimals, no negative zero."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


def rr(names: list[str]) -> str:
    return ", ".join(r(n) for n in names)


def _stat(signal: str, stat: str) -> str:
    only = f"FILTER (WHERE event_type = '{signal}')"
    body = {
        "mean": f"avg(value) {only}",
        "stddev": f"stddev_samp(value) {only}",
        "min": f"min(value) {only}",
        "max": f"max(value) {only}",
        "last": f"arg_max(value, (ts, event_id)) {only}",
        "slope": f"nullif(regr_slope(value, floor(epoch(ts))) {only}, 'nan'::DOUBLE)",
    }[stat]
    return f"{body} AS {signal}_{stat}"


FEATURE_SQL = ",\n  ".join(_stat(s, t) for s in SIGNALS for t in STATS)
HOURS = (6, 12, 24)
SEED, DRAWS = 42, 1000
# 32-bit bounds of the Poisson(1) distribution
POISSON = ", ".join(str(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32)) for k in range(12))

CTES = {
    "member": """
 SELECT e.*, unnest([pane, pane - INTERVAL 30 MINUTE]) AS window_start_time
 FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS pane FROM events) e""",
    "w": f"""
 SELECT user_id, window_start_time, window_start_time + INTERVAL 1 HOUR AS window_end_time,
  {FEATURE_SQL},
  count(*) AS n_events
 FROM member GROUP BY user_id, window_start_time""",
    "cohort": """
 SELECT user_id,
  max(CASE WHEN event_type = 'error' AND value >= 100 THEN 1 ELSE 0 END) AS sepsis_label,
  min(CASE WHEN event_type = 'error' AND value >= 100 THEN ts END) AS sepsis_onset_time
 FROM events GROUP BY user_id""",
    "labelled": "\n SELECT w.*, " + ", ".join(
        f"CASE WHEN sepsis_label = 1 AND sepsis_onset_time > window_end_time AND sepsis_onset_time"
        f" <= window_end_time + INTERVAL {h} HOUR THEN 1 ELSE 0 END AS label_{h}h" for h in HOURS
    ) + "\n FROM w LEFT JOIN cohort USING (user_id)",
    "folds": """
 SELECT user_id, sepsis_label, CAST((row_number() OVER (PARTITION BY sepsis_label
   ORDER BY md5(CAST(user_id AS VARCHAR) || ':42'), user_id) - 1) % 5 AS INTEGER) AS fold
 FROM cohort""",
    "scored": """
 SELECT user_id, window_start_time, window_end_time, label_6h, label_12h, label_24h, n_events,
  floor(least(coalesce(error_max, view_max, 0.0), 200.0) * (100.0::DOUBLE / 200.0::DOUBLE)) / 100.0::DOUBLE AS m1_label_6h,
  floor(least(coalesce(click_max, purchase_max, 0.0), 100.0) * (100.0::DOUBLE / 100.0::DOUBLE)) / 100.0::DOUBLE AS m1_label_12h,
  floor(least(coalesce(signup_last, error_min, 0.0), 200.0) * (100.0::DOUBLE / 200.0::DOUBLE)) / 100.0::DOUBLE AS m1_label_24h,
  ((hour(window_end_time) * 7 + user_id) % 20) / 20.0::DOUBLE AS m2_label_6h,
  ((n_events * 3 + minute(window_end_time) + user_id) % 10) / 10.0::DOUBLE AS m2_label_12h,
  least(n_events, 4) / 4.0::DOUBLE AS m2_label_24h
 FROM labelled""",
    "pred": """
 SELECT user_id, window_start_time, window_end_time, n_events, m1_label_6h AS score_6h,
  m1_label_12h AS score_12h, m2_label_24h AS score_24h,
  CASE WHEN m1_label_6h >= 0.30::DOUBLE THEN 1 ELSE 0 END AS alert FROM scored""",
    "long": "\n " + "\n UNION ALL ".join(
        f"SELECT user_id, '{m}' AS model, '{l}' AS label, {l} AS y, {m}_{l} AS score FROM scored"
        for m in ("m1", "m2") for l in LABELS
    ),
    "counts": """
 SELECT model, label, score, sum(y) AS pos, sum(1 - y) AS neg FROM long GROUP BY ALL""",
    "curve": """
 SELECT *, sum(pos) OVER win AS tp, sum(neg) OVER win AS fp,
  sum(pos) OVER (PARTITION BY model, label) AS n_pos,
  sum(neg) OVER (PARTITION BY model, label) AS n_neg
 FROM counts WINDOW win AS (PARTITION BY model, label ORDER BY score DESC)""",
    # replicas of whole entities: Poisson(1) weights out of MD5 words
    "entityweights": f"""
 SELECT user_id, rep, len(list_filter([{POISSON}], lambda bound: bound <= word)) AS weight FROM (
  SELECT user_id, rep, CAST('0x' || substr(md5('{SEED}:' || (rep // 4) || ':' || user_id), CAST(1 + 8 * (rep % 4) AS INTEGER), 8)
   AS BIGINT) AS word
  FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range({DRAWS})) AS rep))""",
    "entitycounts": """
 SELECT user_id, model, label, score, sum(y) AS pos, sum(1 - y) AS neg FROM long GROUP BY ALL""",
    "replicacounts": """
 SELECT model, label, rep, score, sum(weight * pos) AS pos, sum(weight * neg) AS neg
 FROM entitycounts JOIN entityweights USING (user_id) WHERE weight > 0 GROUP BY ALL""",
    "replicacurve": """
 SELECT *, sum(pos) OVER win AS tp, sum(neg) OVER win AS fp
 FROM replicacounts WINDOW win AS (PARTITION BY model, label, rep ORDER BY score DESC)""",
    "replicametrics": """
 SELECT model, label, rep, 1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)) AS auroc,
  sum(CASE WHEN tp + fp > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / sum(pos) AS average_precision
 FROM replicacurve GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0""",
    "fcounts": """
 SELECT model, label, fold, score, sum(y) AS pos, sum(1 - y) AS neg
 FROM long JOIN folds USING (user_id) GROUP BY ALL""",
    "fcurve": """
 SELECT *, sum(pos) OVER win AS tp, sum(neg) OVER win AS fp,
  sum(pos) OVER (PARTITION BY model, label, fold) AS n_pos,
  sum(neg) OVER (PARTITION BY model, label, fold) AS n_neg
 FROM fcounts WINDOW win AS (PARTITION BY model, label, fold ORDER BY score DESC)""",
    "leads": """
 SELECT user_id, min(window_end_time) AS first_alarm, max(sepsis_onset_time) AS onset,
  (epoch_us(max(sepsis_onset_time)) - epoch_us(min(window_end_time))) / 3600000000.0::DOUBLE AS lead_hours
 FROM scored JOIN cohort USING (user_id)
 WHERE sepsis_label = 1 AND m1_label_6h >= 0.3::DOUBLE AND window_end_time <= sepsis_onset_time
 GROUP BY user_id""",
    "stays": """
 SELECT event_id AS stay_id, user_id, ts AS intime,
  ts + to_hours(6 + CAST(floor(value) AS BIGINT) % 48) AS outtime
 FROM events WHERE event_type = 'signup'""",
    "infusions": """
 SELECT user_id, ts AS starttime, ts + to_minutes(CAST(floor(value * 3) AS BIGINT)) AS endtime
 FROM events WHERE event_type = 'error'""",
    "spans": "\n SELECT user_id, min(ts) AS intime, max(ts) AS outtime FROM events GROUP BY user_id",
    "grid": """
 SELECT user_id, unnest(generate_series(
   CASE WHEN date_trunc('hour', intime) = intime THEN intime
        ELSE date_trunc('hour', intime) + INTERVAL 1 HOUR END,
   date_trunc('hour', outtime), INTERVAL 1 HOUR)) AS hour FROM spans WHERE outtime > intime""",
    "kev": "\n SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events",
    "roled": """
 SELECT *, CASE event_type
   WHEN 'view' THEN ['spo2', 'map', 'fio2'][k % 3 + 1]
   WHEN 'purchase' THEN ['pao2', 'platelets', 'bilirubin', 'creatinine'][k % 4 + 1]
   WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'coma_total' ELSE 'coma_part' END END AS role
 FROM kev""",
    "chart": """
 SELECT user_id, event_id, ts, role, part, CAST(CASE role
   WHEN 'spo2' THEN 75 + CAST(floor(value) AS BIGINT) % 25
   WHEN 'map' THEN 40 + CAST(floor(value) AS BIGINT) % 60
   WHEN 'fio2' THEN 21 + CAST(floor(value) AS BIGINT) % 90
   WHEN 'pao2' THEN 40 + floor(value)
   WHEN 'platelets' THEN value * 2
   WHEN 'bilirubin' THEN value / 10
   WHEN 'creatinine' THEN value / 20
   WHEN 'coma_total' THEN 3 + CAST(floor(value) AS BIGINT) % 13
   WHEN 'coma_part' THEN 1 + (CAST(floor(value) AS BIGINT) + part) % 5 END AS DOUBLE) AS value
 FROM (SELECT *, unnest(CASE WHEN role <> 'coma_part' THEN [0] WHEN k % 4 = 1 THEN [1, 2, 3]
   ELSE [1, 2] END) AS part FROM roled WHERE role IS NOT NULL)""",
    "parts": """
 SELECT user_id, ts, sum(value) AS value FROM chart WHERE role = 'coma_part'
 GROUP BY user_id, ts HAVING count(DISTINCT part) = 3""",
    "points": """
 SELECT user_id, ts, event_id, role, value FROM chart WHERE role <> 'coma_part'
 UNION ALL SELECT user_id, ts, 0, 'coma_sum', value FROM parts""",
    "known": "\n SELECT g.user_id, g.hour, " + ", ".join(
        f"p_{x}.value AS {x}" for x in
        ("spo2", "map", "fio2", "coma_total", "coma_sum", "pao2", "platelets", "bilirubin", "creatinine")
    ) + " FROM grid g " + " ".join(
        f"ASOF LEFT JOIN (SELECT user_id, ts, value FROM points WHERE role = '{x}') p_{x}"
        f" ON g.user_id = p_{x}.user_id AND g.hour >= p_{x}.ts" for x in
        ("spo2", "map", "fio2", "coma_total", "coma_sum", "pao2", "platelets", "bilirubin", "creatinine")
    ),
    "flags": """
 SELECT DISTINCT g.user_id, g.hour FROM grid g JOIN infusions i
  ON g.user_id = i.user_id AND g.hour BETWEEN i.starttime AND i.endtime
 UNION SELECT user_id, date_trunc('hour', ts) FROM events WHERE event_type = 'signup'""",
    "ratios": """
 SELECT k.*, f.user_id IS NOT NULL AS pressor,
  CASE WHEN pao2 IS NOT NULL AND fio2 > 0 AND fio2 <= 100 THEN pao2 / (fio2 / 100.0::DOUBLE)
   ELSE CASE WHEN spo2 IS NULL THEN NULL WHEN spo2 >= 97 THEN 400 WHEN spo2 >= 95 THEN 300
    WHEN spo2 >= 90 THEN 200 WHEN spo2 >= 80 THEN 100 ELSE 50 END END AS pf,
  coalesce(coma_total, coma_sum) AS coma
 FROM known k LEFT JOIN flags f ON k.user_id = f.user_id AND k.hour = f.hour""",
    "scores": """
 SELECT user_id, hour,
  CAST(CASE WHEN pf IS NULL THEN NULL WHEN pf > 400 THEN 0 WHEN pf > 300 THEN 1 WHEN pf > 200 THEN 2
    WHEN pf > 100 THEN 3 ELSE 4 END AS DOUBLE) AS s_resp,
  CAST(CASE WHEN platelets IS NULL THEN NULL WHEN platelets > 150 THEN 0 WHEN platelets > 100 THEN 1
    WHEN platelets > 50 THEN 2 WHEN platelets > 20 THEN 3 ELSE 4 END AS DOUBLE) AS s_coag,
  CAST(CASE WHEN bilirubin IS NULL THEN NULL WHEN bilirubin < 1.2::DOUBLE THEN 0 WHEN bilirubin < 2 THEN 1
    WHEN bilirubin < 6 THEN 2 WHEN bilirubin < 12 THEN 3 ELSE 4 END AS DOUBLE) AS s_liver,
  CAST(CASE WHEN pressor THEN 2 WHEN map IS NULL THEN NULL WHEN map >= 70 THEN 0 ELSE 1 END AS DOUBLE) AS s_cardio,
  CAST(CASE WHEN coma IS NULL THEN NULL WHEN coma >= 15 THEN 0 WHEN coma >= 13 THEN 1
    WHEN coma >= 10 THEN 2 WHEN coma >= 6 THEN 3 ELSE 4 END AS DOUBLE) AS s_cns,
  CAST(CASE WHEN creatinine IS NULL THEN NULL WHEN creatinine < 1.2::DOUBLE THEN 0 WHEN creatinine < 2 THEN 1
    WHEN creatinine < 3.5::DOUBLE THEN 2 WHEN creatinine < 5 THEN 3 ELSE 4 END AS DOUBLE) AS s_renal
 FROM ratios""",
    "series": """
 SELECT user_id, hour,
  CAST(coalesce(s_resp, 0) + coalesce(s_coag, 0) + coalesce(s_liver, 0) + coalesce(s_cardio, 0)
   + coalesce(s_cns, 0) + coalesce(s_renal, 0) AS DOUBLE) AS sofa,
  CAST((s_resp IS NOT NULL)::INT + (s_coag IS NOT NULL)::INT + (s_liver IS NOT NULL)::INT
   + (s_cardio IS NOT NULL)::INT + (s_cns IS NOT NULL)::INT + (s_renal IS NOT NULL)::INT AS INTEGER) AS n_components,
  s_resp, s_coag, s_liver, s_cardio, s_cns, s_renal FROM scores""",
    "pairs": """
 SELECT a.user_id, min(CASE WHEN a.ts <= b.ts THEN a.ts ELSE b.ts END) AS pair_time
 FROM (SELECT * FROM events WHERE event_type = 'click') a
 JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id
  AND ((a.ts <= b.ts AND b.ts <= a.ts + INTERVAL 24 HOUR)
    OR (b.ts < a.ts AND a.ts <= b.ts + INTERVAL 72 HOUR))
 GROUP BY a.user_id""",
    "base": """
 SELECT s.user_id, coalesce(
   arg_min(sofa, hour) FILTER (WHERE hour >= greatest(intime, pair_time - INTERVAL 48 HOUR)),
   arg_max(sofa, hour)) AS baseline
 FROM series s JOIN pairs USING (user_id) JOIN spans USING (user_id) GROUP BY s.user_id""",
    "rise": """
 SELECT s.user_id, min(hour) AS onset_time
 FROM series s JOIN pairs USING (user_id) JOIN base USING (user_id)
 WHERE hour BETWEEN pair_time - INTERVAL 48 HOUR AND pair_time + INTERVAL 24 HOUR
  AND sofa - baseline >= 2 GROUP BY s.user_id""",
    "entities": """
 SELECT u.user_id, intime, outtime,
  CASE WHEN s.user_id IS NULL THEN 'no_sofa_data' WHEN p.user_id IS NULL THEN 'no_soi'
   WHEN onset_time IS NOT NULL THEN 'sepsis' ELSE 'criteria_not_met' END AS excl_reason,
  CAST(onset_time IS NOT NULL AS INTEGER) AS sepsis_label, onset_time AS sepsis_onset_time
 FROM spans u LEFT JOIN (SELECT DISTINCT user_id FROM series) s USING (user_id)
  LEFT JOIN pairs p USING (user_id) LEFT JOIN rise USING (user_id)""",
    "chunks": """
 SELECT event_id, ts, event_type, user_id, value, CAST(least((row_number() OVER (ORDER BY ts, event_id) - 1)
   // greatest(count(*) OVER () // 50, 1), 49) AS INTEGER) AS chunk FROM events""",
    "filled": f"\n SELECT {IDS}, label_6h, label_12h, label_24h, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER win AS {c}, CAST({c} IS NOT NULL AS INTEGER) AS {c[:-5]}_fresh"
        for c in LAST
    ) + " FROM labelled WINDOW win AS (PARTITION BY user_id ORDER BY window_start_time"
        " ROWS UNBOUNDED PRECEDING)",
    "lastlong": "\n " + "\n UNION ALL ".join(
        f"SELECT fold, '{c}' AS feature, {c} AS value FROM w JOIN folds USING (user_id)" for c in LAST
    ),
    "lofo": "\n " + "\n UNION ALL ".join(
        f"SELECT feature, {k} AS fold, quantile_cont(value, 0.5) AS median, count(value) AS n,"
        f" avg(value) AS mean, stddev_samp(value) AS sd FROM lastlong WHERE fold <> {k} GROUP BY feature"
        for k in range(5)
    ),
    "latency": "\n SELECT *, CAST(floor(value * 10) AS BIGINT) AS latency_ms FROM member",
    "wlat": """
 SELECT user_id, window_start_time, window_start_time + INTERVAL 1 HOUR AS window_end_time,
  avg(latency_ms) AS avg_latency_ms, min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms,
  count(*) AS n_events FROM latency GROUP BY user_id, window_start_time""",
    "nulls": "\n " + "\n UNION ALL ".join(
        f"SELECT '{s}_{t}' AS feature, '{s}' AS signal, '{t}' AS stat, count(*) - count({s}_{t}) AS null_count,"
        f" round((count(*) - count({s}_{t})) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM w"
        for s in SIGNALS for t in STATS
    ),
    "temporal": """
 SELECT user_id, window_start_time, window_end_time,
  row_number() OVER win - 1 AS window_idx,
  (row_number() OVER win - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1)::DOUBLE AS window_idx_norm,
  (epoch_us(window_start_time) - epoch_us(min(window_start_time) OVER (PARTITION BY user_id)))
   / 3600000000.0::DOUBLE AS hours_in_icu
 FROM w WINDOW win AS (PARTITION BY user_id ORDER BY window_start_time)""",
    "twolabels": """
 SELECT user_id, window_start_time, window_end_time, sepsis_onset_time,
  CASE WHEN sepsis_onset_time > window_end_time AND sepsis_onset_time
    <= window_end_time + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS label_a,
  CASE WHEN sepsis_onset_time > window_end_time + INTERVAL 1 HOUR AND sepsis_onset_time
    <= window_end_time + INTERVAL 7 HOUR THEN 1 ELSE 0 END AS label_b,
  (epoch_us(sepsis_onset_time) - epoch_us(window_end_time)) / 1000000.0::DOUBLE AS gap
 FROM w LEFT JOIN cohort USING (user_id)""",
    "categorised": """
 SELECT *, CASE WHEN gap IS NULL THEN 'D' WHEN gap = 0 OR gap = 21600 THEN 'A'
  WHEN abs(gap) < 60 OR abs(gap - 21600) < 60 THEN 'B' ELSE 'E' END AS category FROM twolabels""",
    "rich_a": "\n SELECT DISTINCT doc_id AS user_id FROM documents",
    "rich_b": "\n SELECT DISTINCT doc_id AS user_id FROM labels",
    "sizes": "\n SELECT user_id, count(*) AS n FROM w GROUP BY user_id",
    "closed": "\n SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events",
}


def _needed(text: str, found: list[str]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            if name not in found:
                found.append(name)


def sql(body: str) -> str:
    """Prefix the query with the common table expressions it needs."""
    found: list[str] = []
    _needed(body, found)
    order = [n for n in CTES if n in found]
    order.sort(key=found.index)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {head}\n{body}" if head else body


def hist(source: str, col: str, bins: str, out: str = "n") -> str:
    """Equal-width bins over a column of a table expression."""
    return f"""
 SELECT i AS bin, {r('lo + i * wd', 'bin_lo')}, {r('lo + (i + 1) * wd', 'bin_hi')},
  (SELECT count(*) FROM {source} v WHERE least(CAST(floor((v.{col} - lo) / wd) AS INTEGER), bins - 1) = i) AS {out}
 FROM (SELECT *, (hi - lo) / bins AS wd, unnest(generate_series(0, bins - 1))::INTEGER AS i FROM (
  SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi, CAST({bins} AS INTEGER) AS bins FROM {source}))"""


SCORE_SUM = "\n ".join(
    f"CAST(sum(CASE WHEN {s} >= 0.30::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS alerts_{s},"
    f" {r(f'100.0::DOUBLE * sum(CASE WHEN {s} >= 0.30::DOUBLE THEN 1 ELSE 0 END) / count(*)', f'alert_pct_{s}')},"
    f" {r(f'avg({s})', f'mean_{s}')}," for s in ("score_6h", "score_12h", "score_24h")
)
AUROC = "sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / (max(n_pos) * max(n_neg))"
AP = "sum(pos * (tp / (tp + fp)::DOUBLE)) / max(n_pos)"


def sens(spec: float) -> str:
    return (f"coalesce(max(CASE WHEN fp <= (1.0::DOUBLE - {spec}::DOUBLE + 1e-12) * n_neg THEN tp END)"
            " / max(n_pos)::DOUBLE, 0)")


THRESHOLD = "min(CASE WHEN fp <= (1.0::DOUBLE - 0.9::DOUBLE + 1e-12) * n_neg THEN score END)"
METRICS = f"""CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_neg) AS BIGINT) AS n_neg,
 {r(AUROC, 'auroc')}, {r(AP, 'average_precision')}, {r(sens(0.9), 'sens_at_90')},
 {r(sens(0.95), 'sens_at_95')}, {r(THRESHOLD, 'threshold')}"""
W_ALL = f"{IDS}, " + rr([f"{s}_{t}" for s in SIGNALS for t in STATS]) + ", n_events"
ENTITY_RISK = f"""SELECT user_id, {r('max(score_6h)', 'max_score_6h')}, {r('max(score_12h)', 'max_score_12h')},
 {r('max(score_24h)', 'max_score_24h')}, count(score_6h) AS n_windows, CAST(sum(alert) AS BIGINT) AS n_alerts,
 min(CASE WHEN alert = 1 THEN window_end_time END) AS first_alert FROM pred GROUP BY user_id"""
ANY = "coalesce(" + ", ".join(f"{s}_{t}" for s in SIGNALS for t in STATS) + ")"
PRED = f"{IDS}, n_events, {rr(['score_6h', 'score_12h', 'score_24h'])}, alert"
BAND = {
    "spo2_ratio": "CASE WHEN v >= 97 THEN 400 WHEN v >= 95 THEN 300 WHEN v >= 90 THEN 200 WHEN v >= 80 THEN 100 ELSE 50 END",
    "resp": "CASE WHEN v * 5 > 400 THEN 0 WHEN v * 5 > 300 THEN 1 WHEN v * 5 > 200 THEN 2 WHEN v * 5 > 100 THEN 3 ELSE 4 END",
    "platelets": "CASE WHEN v > 150 THEN 0 WHEN v > 100 THEN 1 WHEN v > 50 THEN 2 WHEN v > 20 THEN 3 ELSE 4 END",
    "bilirubin": "CASE WHEN v / 10 < 1.2::DOUBLE THEN 0 WHEN v / 10 < 2 THEN 1 WHEN v / 10 < 6 THEN 2 WHEN v / 10 < 12 THEN 3 ELSE 4 END",
    "creatinine": "CASE WHEN v / 20 < 1.2::DOUBLE THEN 0 WHEN v / 20 < 2 THEN 1 WHEN v / 20 < 3.5::DOUBLE THEN 2 WHEN v / 20 < 5 THEN 3 ELSE 4 END",
    "coma": "CASE WHEN v / 5 >= 15 THEN 0 WHEN v / 5 >= 13 THEN 1 WHEN v / 5 >= 10 THEN 2 WHEN v / 5 >= 6 THEN 3 ELSE 4 END",
    "pressure": "CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' THEN NULL WHEN v >= 70 THEN 0 ELSE 1 END",
    "fraction": "CASE WHEN v > 0 AND v <= 100 THEN v / 100 END",
}
BAND["ratio"] = f"CASE WHEN v > 0 AND v <= 100 THEN 80 / (v / 100) ELSE {BAND['spo2_ratio']} END"

BODIES = {
    "sliding_features": f"SELECT {W_ALL} FROM w",
    "stream_features": f"SELECT {W_ALL} FROM w, closed WHERE window_end_time <= mark",
    "stream_replay": f"SELECT {W_ALL} FROM w, closed WHERE window_end_time <= mark",
    "horizon_label": f"SELECT {IDS}, label_6h AS label FROM labelled",
    "stream_labelled": f"SELECT {IDS}, label_6h AS label FROM labelled, closed WHERE window_end_time <= mark",
    "horizon_labels": f"SELECT {IDS}, {', '.join(LABELS)} FROM labelled",
    "window_latency": f"SELECT {IDS}, {r('avg_latency_ms')}, min_latency_ms, max_latency_ms, n_events FROM wlat",
    "stream_multi_sink": f"""SELECT {IDS}, n_events, {r('avg_latency_ms')}, max_latency_ms,
 n_events AS throughput_per_window FROM wlat, closed WHERE window_end_time <= mark""",
    "temporal_features": f"SELECT {IDS}, window_idx, {rr(['window_idx_norm', 'hours_in_icu'])} FROM temporal",
    "stream_positions": f"""SELECT t.user_id, t.window_start_time, t.window_end_time, n_events, window_idx,
 {r('hours_in_icu')} FROM temporal t JOIN w USING (user_id, window_start_time), closed WHERE t.window_end_time <= mark""",
    "forward_fill": f"SELECT {IDS}, {rr(LAST)} FROM filled",
    "stream_forward_fill": f"SELECT {IDS}, {rr(LAST)} FROM filled, closed WHERE window_end_time <= mark",
    "fill_and_impute": f"SELECT {IDS}, " + ", ".join(
        r(f"coalesce({c}, (SELECT median FROM lofo l WHERE l.feature = '{c}' AND l.fold = f.fold), 0)", c)
        for c in LAST) + " FROM filled JOIN folds f USING (user_id)",
    "sequence_features": f"SELECT {IDS}, {', '.join(LABELS)}, " + ", ".join(
        r(f"coalesce({c}, (SELECT median FROM lofo l WHERE l.feature = '{c}' AND l.fold = f.fold), 0)", c)
        + f", {c[:-5]}_fresh" for c in LAST) + " FROM filled JOIN folds f USING (user_id)",
    "tree_features": f"SELECT {IDS}, {', '.join(LABELS)}, {rr(TREE)} FROM labelled",
    "drop_suffix": f"SELECT {IDS}, {rr(TREE)}, n_events FROM w",
    "last_n": f"""SELECT {IDS}, n_events FROM w
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_start_time DESC) <= 50""",
    "lagged": f"SELECT {IDS}, n_events, " + ", ".join(
        f"lag(n_events, {i}) OVER win AS n_events_lag{i}" for i in (1, 2, 3))
        + " FROM w WINDOW win AS (PARTITION BY user_id ORDER BY window_start_time)",
    "freshness": f"SELECT {IDS}, {', '.join(c[:-5] + '_fresh' for c in LAST)} FROM filled",
    "sequence_table": f"""SELECT user_id, CAST(least(total, 300) AS INTEGER) AS seq_len,
 CAST(step AS INTEGER) AS step, window_start_time, {rr(LAST)}, {', '.join(LABELS)}
 FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total,
  row_number() OVER (PARTITION BY user_id ORDER BY window_start_time) - 1
   - greatest(count(*) OVER (PARTITION BY user_id) - 300, 0) AS step FROM labelled) WHERE step >= 0""",
    "pad_sequences": f"""SELECT user_id, CAST(least(count(*), 300) AS INTEGER) AS seq_len, 320 AS padded_len,
 CAST(least(count(*), 300) AS INTEGER) AS n_real,
 {r("arg_max([click_last], window_start_time)[1]", "last_click")}, CAST(0.0 AS DOUBLE) AS first_click,
 false AS first_real FROM labelled GROUP BY user_id""",
    # cleaning
    "map_codes": f"""SELECT event_id, signal_name, source_tag, {r('value')} FROM events JOIN (VALUES
 ('click', 'heart_rate', 'monitor'), ('view', 'map', 'monitor'), ('error', 'lactate', 'lab'),
 ('purchase', 'wbc', 'lab')) d(event_type, signal_name, source_tag) USING (event_type)""",
    "keep_codes": f"SELECT event_id, event_type, {r('value')} FROM events WHERE event_type IN ('click', 'error')",
    "keep_ids": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM cohort WHERE sepsis_label = 1)",
    "drop_incomplete": f"""SELECT {IDS}, {rr(['click_mean', 'view_mean'])} FROM w
 WHERE click_mean IS NOT NULL AND view_mean IS NOT NULL""",
    "incomplete_counts": """SELECT count(*) AS n_rows,
 count(*) FILTER (WHERE click_mean IS NULL OR view_mean IS NULL) AS n_dropped,
 count(*) - count(click_mean) AS null_click_mean, count(*) - count(view_mean) AS null_view_mean FROM w""",
    "convert_units": f"""SELECT event_id,
 {r("CASE WHEN event_type IN ('error', 'view') THEN (value - 32) * 5 / 9 ELSE value END", 'value')} FROM events""",
    "apply_bounds": f"""SELECT event_id, event_type, {r('value')} FROM events WHERE CASE event_type
 WHEN 'click' THEN value BETWEEN 5 AND 100 WHEN 'view' THEN value BETWEEN 1 AND 50
 WHEN 'error' THEN value BETWEEN 0.5 AND 200 ELSE true END""",
    "bounds_report": f"""SELECT event_type, {rr(['lo', 'hi'])}, count(*) AS n_dropped FROM events
 JOIN (VALUES ('click', 5.0, 100.0), ('view', 1.0, 50.0), ('error', 0.5, 200.0)) d(event_type, lo, hi)
 USING (event_type) WHERE value < lo OR value > hi GROUP BY ALL""",
    "coverage": """SELECT signal_name, source_tag, count(*) AS n_rows FROM events JOIN (VALUES
 ('click', 'heart_rate', 'monitor'), ('view', 'map', 'monitor'), ('error', 'lactate', 'lab'),
 ('purchase', 'wbc', 'lab')) d(event_type, signal_name, source_tag) USING (event_type) GROUP BY ALL""",
    "match_any": """SELECT doc_id, coalesce(regexp_matches(lower(text), 'license|copyright|password|e-mail'),
 false) AS matched FROM documents""",
    "allow_or_null": """SELECT o_orderkey, o_orderpriority FROM orders
 WHERE o_orderpriority IS NULL OR upper(trim(o_orderpriority)) IN ('1-URGENT', '2-HIGH')""",
    "parse_times": """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS t FROM events""",
    "fallback_time": """SELECT event_id, CASE WHEN event_type <> 'view' THEN ts
 ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS t FROM events""",
    "band_scores": "SELECT event_id, " + ", ".join(r(x, n) for n, x in BAND.items())
        + " FROM (SELECT *, value AS v FROM events)",
    "row_sum": f"SELECT {IDS}, " + r(" + ".join(f"coalesce({s}_mean, 0)" for s in SIGNALS), "total") + ", CAST("
        + " + ".join(f"({s}_mean IS NOT NULL)::INT" for s in SIGNALS) + " AS INTEGER) AS n_parts, "
        + r("(" + " + ".join(f"coalesce({s}_mean, 0)" for s in SIGNALS) + ") / nullif("
            + " + ".join(f"({s}_mean IS NOT NULL)::INT" for s in SIGNALS) + ", 0)", "mean") + " FROM w",
    "json_roundtrip": f"""SELECT user_id AS icustay_id, date_trunc('second', ts) AS charttime,
 event_type AS signal_name, {r('value', 'valuenum')}, 'events' AS source_table,
 epoch_us(ts) // 1000 AS producer_timestamp_ms, CAST(floor(value * 10) AS BIGINT) AS latency_ms FROM events""",
    # split
    "split_ordered": "SELECT event_id, ts, chunk FROM chunks",
    "split_manifest": """SELECT chunk, count(*) AS row_count, min(ts) AS min_time, max(ts) AS max_time
 FROM chunks GROUP BY chunk""",
    "manifest_totals": """SELECT count(*) AS total_rows, count(DISTINCT chunk) AS n_files,
 (SELECT string_agg(event_type, ',' ORDER BY event_type) FROM (SELECT DISTINCT event_type FROM events)) AS signals,
 min(ts) AS min_time, max(ts) AS max_time FROM chunks""",
    "split_roundtrip": """SELECT event_type AS signal_name, count(*) AS n, date_trunc('second', min(ts)) AS first,
 date_trunc('second', max(ts)) AS last, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
 FROM events GROUP BY event_type""",
    # joins in time
    "first_stay": """SELECT stay_id, user_id, intime, outtime FROM stays
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY intime, stay_id) = 1""",
    "first_stay_join": """SELECT event_id, user_id, stay_id FROM events JOIN (SELECT stay_id, user_id FROM stays
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY intime, stay_id) = 1) USING (user_id)
 WHERE event_type = 'purchase'""",
    "pair_events": "SELECT user_id, pair_time FROM pairs",
    "assign_interval": """SELECT event_id, user_id, ts, stay_id, covered FROM (
 SELECT event_id, p.user_id, ts, stay_id, abs(epoch_us(intime) - epoch_us(ts)) AS gap,
  ts BETWEEN intime - INTERVAL 6 HOUR AND outtime + INTERVAL 6 HOUR AS covered
 FROM (SELECT * FROM events WHERE event_type = 'purchase') p JOIN stays s ON p.user_id = s.user_id)
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY covered DESC, gap, stay_id) = 1""",
    "hourly_spine": "SELECT user_id, hour FROM grid",
    "covered_flag": """SELECT g.user_id, g.hour, EXISTS (SELECT 1 FROM infusions i WHERE i.user_id = g.user_id
 AND g.hour BETWEEN i.starttime AND i.endtime) AS covered FROM grid g""",
    "bucket_flag": """SELECT g.user_id, g.hour, p.user_id IS NOT NULL AS marked FROM grid g LEFT JOIN (
 SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'signup') p
 ON g.user_id = p.user_id AND g.hour = p.hour""",
    "hourly_last": f"""SELECT user_id, date_trunc('hour', ts) AS hour, {r('arg_max(value, (ts, event_id))', 'value')}
 FROM events WHERE event_type = 'click' GROUP BY 1, 2""",
    "asof_fill": f"""SELECT g.user_id, g.hour, {r('p.value', 'purchase_known')}, {r('v.value', 'view_known')} FROM grid g
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON g.user_id = p.user_id AND g.hour >= p.ts
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON g.user_id = v.user_id AND g.hour >= v.ts""",
    "sum_parts": f"SELECT user_id, ts, {r('value')} FROM parts",
    "hourly_score_table": f"""SELECT user_id, hour, {r('sofa')}, n_components,
 {rr(['s_resp', 's_coag', 's_liver', 's_cardio', 's_cns', 's_renal'])} FROM series""",
    "baseline_value": f"SELECT user_id, {r('baseline')} FROM base",
    "first_rise": "SELECT user_id, onset_time FROM rise",
    "label_entities": """SELECT user_id, intime, outtime, excl_reason, sepsis_label, sepsis_onset_time FROM entities""",
    "cohort_funnel": f"""SELECT excl_reason, count(*) AS n_rows,
 {r('count(*) / (SELECT count(*) FROM entities)', 'share')} FROM entities GROUP BY excl_reason""",
    "gate": f"""SELECT count(*) AS n_total, CAST(sum(sepsis_label) AS BIGINT) AS n_positive,
 {r('avg(sepsis_label)', 'prevalence')}, avg(sepsis_label) BETWEEN 0.05 AND 0.40 AS passed FROM entities""",
    # folds
    "stratified_folds": "SELECT user_id, sepsis_label, fold FROM folds",
    "fold_table": f"""SELECT fold, CAST(sum(e) AS BIGINT) AS n_entities, CAST(sum(p) AS BIGINT) AS n_positive,
 CAST(sum(e) - sum(p) AS BIGINT) AS n_negative, CAST(sum(n) AS BIGINT) AS n_windows,
 CAST(sum(l) AS BIGINT) AS n_positive_windows, {r('100.0::DOUBLE * sum(l) / sum(n)', 'prevalence_pct')},
 CAST(grouping(fold) AS INTEGER) AS is_total FROM (
 SELECT fold, 1 AS e, sepsis_label AS p, 0 AS n, 0 AS l FROM folds
 UNION ALL SELECT fold, 0, 0, 1, label_6h FROM labelled JOIN folds USING (user_id)) GROUP BY ROLLUP (fold)""",
    "class_weight": " UNION ALL ".join(
        f"SELECT '{l}' AS label, count(*) FILTER (WHERE {l} = 1) AS n_pos, count(*) FILTER (WHERE {l} = 0) AS n_neg,"
        + r(f"count(*) FILTER (WHERE {l} = 0) / greatest(count(*) FILTER (WHERE {l} = 1), 1)", "weight")
        + " FROM labelled" for l in LABELS),
    "lofo_median": f"SELECT feature, fold, {r('coalesce(median, 0)', 'median')} FROM lofo",
    "lofo_moments": f"SELECT feature, fold, n, {rr(['mean', 'sd'])} FROM lofo",
    "standardised": f"SELECT {IDS}, " + ", ".join(
        r(f"({c} - (SELECT mean FROM lofo l WHERE l.feature = '{c}' AND l.fold = f.fold)) / greatest("
          f"(SELECT sd FROM lofo l WHERE l.feature = '{c}' AND l.fold = f.fold), 1e-6)", c) for c in LAST)
        + " FROM w JOIN folds f USING (user_id)",
    "leakage_check": """SELECT count(*) AS n_checked, count(*) FILTER (WHERE abs(l.median - a.again) > 1e-9) AS n_leaks
 FROM lofo l JOIN (SELECT feature, j AS fold, median(value) AS again
  FROM lastlong, (SELECT unnest(generate_series(0, 4)) AS j) WHERE fold <> j GROUP BY feature, j) a
 ON l.feature = a.feature AND l.fold = a.fold""",
    # keys
    "dedupe": "SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events",
    "common_keys": "SELECT user_id FROM rich_a INTERSECT SELECT user_id FROM rich_b",
    "key_diff": """SELECT user_id, 'only_a' AS side FROM (SELECT user_id FROM rich_a EXCEPT SELECT user_id FROM rich_b)
 UNION ALL SELECT user_id, 'only_b' FROM (SELECT user_id FROM rich_b EXCEPT SELECT user_id FROM rich_a)""",
    "overlap_funnel": """SELECT CAST((SELECT count(*) FROM rich_a) AS BIGINT) AS n_a,
 CAST((SELECT count(*) FROM rich_b) AS BIGINT) AS n_b,
 CAST((SELECT count(*) FROM rich_a JOIN rich_b USING (user_id)) AS BIGINT) AS n_both""",
    "reconcile": f"""SELECT {IDS}, label_a, label_b, sepsis_onset_time, {r('gap', 'gap_seconds')}, category
 FROM categorised WHERE label_a <> label_b""",
    "reconcile_counts": """SELECT count(*) AS n_matched, count(*) FILTER (WHERE label_a <> label_b) AS n_differ,
 count(*) FILTER (WHERE label_a = 0 AND label_b = 1) AS n_a0_b1,
 count(*) FILTER (WHERE label_a = 1 AND label_b = 0) AS n_a1_b0 FROM twolabels""",
    "gap_category": """SELECT category, minute(window_end_time) IN (0, 30) AS on_half_hour, count(*) AS n
 FROM categorised GROUP BY ALL""",
    "sample_per_group": """SELECT event_id, event_type, ts FROM events
 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 5""",
    "union_events": f"""SELECT event_id, ts, {r('value')}, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS src
 FROM events ORDER BY ts, event_id""",
    # quality
    "group_share": f"""SELECT label_6h, count(*) AS n_rows, {r('count(*) / (SELECT count(*) FROM labelled)', 'share')}
 FROM labelled GROUP BY label_6h""",
    "size_stats": f"""SELECT count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, {r('avg(n)', 'mean_size')},
 {r('quantile_cont(n, 0.5)', 'median_size')} FROM sizes""",
    "histogram": hist("sizes", "n", "least(10, count(DISTINCT n))"),
    "describe": f"""SELECT count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')},
 {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('quantile_cont(value, 0.25)', 'p25')},
 {r('quantile_cont(value, 0.5)', 'p50')}, {r('quantile_cont(value, 0.75)', 'p75')} FROM events""",
    "latency_percentiles": f"""SELECT {r('avg(avg_latency_ms)', 'mean')}, {r('min(avg_latency_ms)', 'min')},
 {r('max(avg_latency_ms)', 'max')}, {r('quantile_cont(avg_latency_ms, 0.5)', 'p50')},
 {r('quantile_cont(avg_latency_ms, 0.95)', 'p95')}, {r('quantile_cont(avg_latency_ms, 0.99)', 'p99')} FROM wlat""",
    "null_rates": f"SELECT feature, signal, stat, null_count, {r('null_pct')} FROM nulls",
    "null_by_stat": f"""SELECT stat, {r('avg(null_pct)', 'mean_null_pct')}, {r('min(null_pct)', 'min_null_pct')},
 {r('max(null_pct)', 'max_null_pct')} FROM nulls GROUP BY stat""",
    "null_delta": f"""SELECT signal, {r('m', 'mean_pct')}, {r('l', 'last_pct')}, {r('l - m', 'delta')},
 CASE WHEN l - m > 0.1 THEN 'fill would help' WHEN l - m < -0.1 THEN 'fill active' ELSE '' END AS marker
 FROM (SELECT signal, max(null_pct) FILTER (WHERE stat = 'mean') AS m, max(null_pct) FILTER (WHERE stat = 'last') AS l
 FROM nulls GROUP BY signal)""",
    "range_check": f"SELECT signal, {r('fresh_pct')}, fresh_pct BETWEEN lo AND hi AS in_range FROM (" + " UNION ALL ".join(
        f"SELECT '{s}' AS signal, 100.0::DOUBLE * count({s}_last) / count(*) AS fresh_pct, {lo} AS lo, {hi} AS hi FROM w"
        for s, lo, hi in [("click", 5, 25), ("view", 85, 95), ("error", 0, 21), ("purchase", 0, 100), ("signup", 0, 100)]) + ")",
    "covered_rows": f"""SELECT count(*) AS n_rows, count(coalesce({', '.join(s + '_slope' for s in SIGNALS)})) AS n_covered,
 {r(f"100.0::DOUBLE * count(coalesce({', '.join(s + '_slope' for s in SIGNALS)})) / count(*)", 'covered_pct')} FROM w""",
    "late_report": """SELECT count(*) AS n_windows, count(*) FILTER (WHERE window_end_time > mark) AS n_open,
 count(*) FILTER (WHERE window_end_time <= mark) AS n_emitted FROM w, closed""",
    "arrival_losses": """SELECT row_number() OVER (ORDER BY band) - 1 AS run, count(*) AS n_rows,
 count(*) FILTER (WHERE ts <= mark) AS n_late,
 CAST(sum(count(*) FILTER (WHERE ts > mark OR mark IS NULL)) OVER () AS BIGINT) AS n_kept
 FROM (SELECT *, CAST(floor(log2(value + 1)) AS INT) AS band FROM events) JOIN (
 SELECT band, date_trunc('milliseconds', max(peak) OVER (ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  - INTERVAL 1 HOUR AS mark
 FROM (SELECT CAST(floor(log2(value + 1)) AS INT) AS band, max(ts) AS peak FROM events GROUP BY 1)) USING (band)
 GROUP BY band""",
    # reports
    "entity_risk": ENTITY_RISK,
    "top_entities": ENTITY_RISK + " ORDER BY max(score_12h) DESC, user_id LIMIT 15",
    "alert_rate": f"""SELECT hour_bin, {r('avg(CASE WHEN score_12h >= 0.30::DOUBLE THEN 1 ELSE 0 END)', 'alert_rate')},
 count(score_12h) AS n_windows FROM (SELECT *, CAST(least(floor((row_number() OVER (PARTITION BY user_id
 ORDER BY window_start_time) - 1) * 0.5), 48) AS INTEGER) AS hour_bin FROM pred) GROUP BY hour_bin""",
    "top_alerts": f"SELECT {PRED} FROM (SELECT * FROM pred WHERE alert = 1 ORDER BY score_6h DESC, window_end_time, user_id LIMIT 10)",
    "top_trajectory": f"""SELECT {PRED} FROM pred WHERE user_id = (SELECT user_id FROM pred GROUP BY user_id
 ORDER BY max(score_12h) DESC, user_id LIMIT 1)""",
    "run_summary": f"""SELECT count(DISTINCT user_id) AS n_entities, count(*) AS n_windows, {SCORE_SUM}
 CAST(sum(n_events) AS BIGINT) AS n_events FROM pred""",
    "label_prevalence": " UNION ALL ".join(
        f"SELECT '{l}' AS label, count(*) FILTER (WHERE {l} = 1) AS n_pos, count(*) FILTER (WHERE {l} = 0) AS n_neg,"
        + r(f"100.0::DOUBLE * avg({l})", "positive_pct") + " FROM labelled" for l in LABELS),
    "score_histogram": hist("pred", "score_6h", "50"),
    "score_drift": f"""SELECT i AS bin, {r('lo + i * wd', 'bin_lo')}, {r('lo + (i + 1) * wd', 'bin_hi')}, n_a, n_b,
 {r('n_a / (total * ((lo + (i + 1) * wd) - (lo + i * wd)))', 'density_a')},
 {r('n_b / (total * ((lo + (i + 1) * wd) - (lo + i * wd)))', 'density_b')} FROM (
 SELECT *, (SELECT count(*) FROM scored v WHERE least(CAST(floor((m1_label_6h - lo) / wd) AS INTEGER), 49) = i) AS n_a,
  (SELECT count(*) FROM scored v WHERE least(CAST(floor((m2_label_6h - lo) / wd) AS INTEGER), 49) = i) AS n_b
 FROM (SELECT *, (hi - lo) / 50 AS wd, unnest(generate_series(0, 49))::INTEGER AS i FROM (
  SELECT least(min(m1_label_6h), min(m2_label_6h)) AS lo, greatest(max(m1_label_6h), max(m2_label_6h)) AS hi,
   count(*) AS total FROM scored)))""",
    "throughput": f"""SELECT count(*) AS n_events, {r('span', 'wall_clock_s')}, {r('count(*) / span', 'events_per_s')}
 FROM events, (SELECT (max(epoch_us(ts) // 1000 + CAST(floor(value * 10) AS BIGINT)) - min(epoch_us(ts) // 1000)) / 1000.0::DOUBLE AS span
 FROM events) GROUP BY span""",
    "windows_report": "SELECT item, " + r("value") + """ FROM (
 SELECT 'label=' || label_6h AS item, count(*)::DOUBLE AS value FROM labelled GROUP BY label_6h
 UNION ALL SELECT 'n_groups', count(*) FROM sizes UNION ALL SELECT 'min_size', min(n) FROM sizes
 UNION ALL SELECT 'max_size', max(n) FROM sizes UNION ALL SELECT 'mean_size', avg(n) FROM sizes
 UNION ALL SELECT 'median_size', quantile_cont(n, 0.5) FROM sizes
 UNION ALL SELECT 'n_rows', count(*) FROM w UNION ALL SELECT 'n_covered', count(""" + ANY + """) FROM w
 UNION ALL SELECT 'covered_pct', 100.0::DOUBLE * count(""" + ANY + """) / count(*) FROM w)""",
    # metrics
    "ensemble": f"SELECT {IDS}, {', '.join(LABELS)}, " + rr([f"{m}_{l}" for m in ("m1", "m2") for l in LABELS]) + ", "
        + ", ".join(r(f"(m1_{l} + m2_{l}) / 2", f"ens_{l}") for l in LABELS) + " FROM scored",
    "roc_points": f"""SELECT model, label, {r('score', 'threshold')}, {r('fp / n_neg', 'fpr')},
 {r('tp / n_pos', 'tpr')} FROM curve""",
    "pr_points": f"""SELECT model, label, {r('score', 'threshold')}, {r('tp / (tp + fp)', 'precision')},
 {r('tp / n_pos', 'recall')} FROM curve""",
    "auroc": f"SELECT model, label, {r(AUROC, 'auroc')} FROM curve GROUP BY model, label",
    "average_precision": f"SELECT model, label, {r(AP, 'average_precision')} FROM curve GROUP BY model, label",
    "sens_at_spec": f"""SELECT model, label, {r(sens(0.9), 'sens_at_90')}, {r(sens(0.95), 'sens_at_95')}
 FROM curve GROUP BY model, label""",
    "threshold_at_spec": f"SELECT model, label, {r(THRESHOLD, 'threshold')} FROM curve GROUP BY model, label",
    "cluster_bootstrap": f"""SELECT model, label, count(*) AS n_replicas, """ + ", ".join(
        f"{r(f'avg({m})', f'{m}_mean')}, {r(f'quantile_cont({m}, 0.025)', f'{m}_lo')}, {r(f'quantile_cont({m}, 0.975)', f'{m}_hi')}"
        for m in ("auroc", "average_precision")) + " FROM replicametrics GROUP BY model, label",
    "metric_table": f"SELECT model, label, {METRICS} FROM curve GROUP BY model, label HAVING max(n_pos) > 0",
    "fold_metrics": f"SELECT model, label, fold, {METRICS} FROM fcurve GROUP BY model, label, fold HAVING max(n_pos) > 0",
    "ap_lift": f"""SELECT model, label, {r('prev', 'prevalence')}, {r('ap / prev', 'lift')} FROM (SELECT model, label,
 {AP} AS ap, max(n_pos) / (max(n_pos) + max(n_neg))::DOUBLE AS prev FROM curve GROUP BY model, label)""",
    "lead_times": f"SELECT user_id, first_alarm, onset, {r('lead_hours')} FROM leads",
    "lead_summary": f"""SELECT count(*) AS n_detected, {r('avg(lead_hours)', 'mean_hours')},
 {r('avg((lead_hours > 4)::INT)', 'share_over_4h')}, {r('avg((lead_hours > 8)::INT)', 'share_over_8h')},
 {r('quantile_cont(lead_hours, 0.5)', 'median_hours')}, {r('quantile_cont(lead_hours, 0.8)', 'p80_hours')},
 CAST((SELECT sum(sepsis_label) FROM cohort) AS BIGINT) AS n_positive FROM leads""",
    "ecdf": f"""SELECT user_id, {r('lead_hours')},
 {r('row_number() OVER (ORDER BY lead_hours, user_id) / count(*) OVER ()', 'cdf')} FROM leads""",
    "value_ecdf": f"""SELECT event_id, {r('value')},
 {r('row_number() OVER (ORDER BY value, event_id) / count(*) OVER ()', 'cdf')} FROM events""",
}

# Every CTE name is also looked for in comments and aliases, so names are distinct
# words that occur only as table names.
ORACLES = {name: sql(body) for name, body in BODIES.items()}
