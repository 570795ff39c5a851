"""SQL text of the stages: common table expressions the query twins are put together from."""

from __future__ import annotations

from roadfuse.functions.geo import distance_sql
from roadfuse.plans.stages import AS_OF, EARLIER_RUN, REPAIRED_US
from roadfuse.sources.adapter import sql_ctes


def _us(at) -> int:
    return int(at.timestamp()) * 1_000_000


AS_OF_US, EARLIER_US = _us(AS_OF), _us(EARLIER_RUN)

RATIO = "CASE WHEN accel_std > 0 THEN coalesce(magnitude / accel_std, 0) ELSE 0 END"
SEVERITY = (
    "CASE WHEN magnitude > 0 THEN least(greatest(2 * magnitude / greatest(coalesce(speed_mps, 0), 5), 0), 1)"
    " ELSE cast(0 AS double) END"
)


def sigmoid(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"


def logit(p: str) -> str:
    q = f"least(greatest({p}, cast(1e-6 AS double)), 1 - cast(1e-6 AS double))"
    return f"ln({q} / (1 - {q}))"


def _density(mu: int) -> str:
    return (
        f"exp(-0.5 * (((r - {mu}) * (r - {mu}) * 0.5 + (g - {mu}) * (g - {mu}) * 0.5) / 0.25))"
        " * (cast(1 AS double) / 3 / (2 * pi() * 0.5))"
    )


SCORED = f"""
dens AS (
  SELECT *, {_density(1)} AS d0, {_density(3)} AS d1, {_density(6)} AS d2
  FROM (SELECT *, {RATIO} AS r, coalesce(gbar_in_max, 0) AS g FROM observation)),
post AS (SELECT *, d0 + d1 + d2 AS total FROM dens),
scored AS (
  SELECT client_id,
    CASE WHEN total <= 0 THEN 'not' WHEN d0 >= d1 AND d0 >= d2 THEN 'not' WHEN d1 >= d2 THEN 'crack' ELSE 'pothole' END AS sensor_class,
    CASE WHEN total <= 0 THEN cast(0 AS double) ELSE d2 / total END AS sensor_p_pothole,
    {SEVERITY} AS sensor_severity, total <= 0 AS sensor_is_outlier
  FROM post)"""

PAIRED = f"""
candidate AS (
  SELECT f.client_id AS frame_client_id, o.client_id AS event_client_id, f.ts_us - o.ts_us AS d_us,
         {distance_sql('f.lat', 'f.lon', 'o.lat', 'o.lon')} AS delta_m
  FROM frame f JOIN observation o
    ON f.device_id = o.device_id AND abs(f.ts_us - o.ts_us) < 3000000),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY frame_client_id ORDER BY abs(d_us), delta_m, event_client_id) AS rn
  FROM candidate WHERE delta_m <= 25),
paired AS (
  SELECT frame_client_id, event_client_id, delta_m,
         CASE WHEN d_us < 0 THEN -((500 - d_us) // 1000) ELSE (d_us + 500) // 1000 END AS delta_ms
  FROM ranked WHERE rn = 1)"""

COLD = f"""
cold AS (
  SELECT p.*, {sigmoid(f"(0.5 * {logit(sigmoid('(ratio - 3)'))} + 0.5 * {logit('visual')})")} AS fused_confidence, severity
  FROM (SELECT p.*, {RATIO} AS ratio, f.device_probability AS visual, {SEVERITY} AS severity
        FROM paired p JOIN observation o ON o.client_id = p.event_client_id
        JOIN frame f ON f.client_id = p.frame_client_id) p)"""

PRIMARY = f"""
prim AS (
  SELECT p.*, {sigmoid(f"(0.5 * {logit('sensor')} + 0.5 * {logit('visual')})")} AS fused_confidence
  FROM (SELECT p.*, s.sensor_p_pothole AS sensor, f.device_probability AS visual, s.sensor_severity AS severity
        FROM paired p JOIN scored s ON s.client_id = p.event_client_id
        JOIN frame f ON f.client_id = p.frame_client_id) p)"""

SITES = f"""
site_cluster AS (
  SELECT 'clu_' || lpad(cast(site AS varchar), 3, '0') AS cluster_id, 'pothole' AS asset_type,
    (4360000 + site * 1000) / cast(100000 AS double) AS lat, (-7940000 + site * 1000) / cast(100000 AS double) AS lon,
    (site % 10) / cast(10 AS double) AS severity, (site % 7) / cast(7 AS double) AS confidence,
    site % 9 + 1 AS observation_count, site % 4 + 1 AS distinct_devices, {AS_OF_US} AS last_seen_us, 'crowd' AS source,
    CASE WHEN site % 3 = 0 THEN {REPAIRED_US} END AS repaired_us
  FROM (SELECT DISTINCT user_id % 61 AS site FROM events))"""

MEMBERS = f"""
member AS (
  SELECT o.client_id, o.device_id, o.lat, o.lon, o.ts_us, coalesce(s.sensor_severity, 0) AS severity,
         greatest(coalesce(s.sensor_p_pothole, 0), coalesce(m.max_fused, 0)) AS confidence
  FROM observation o
  LEFT JOIN scored s ON s.client_id = o.client_id
  LEFT JOIN (SELECT event_client_id, max(fused_confidence) AS max_fused FROM prim GROUP BY 1) m
    ON m.event_client_id = o.client_id
  WHERE o.received_us > {AS_OF_US} - 30 * 86400000000
    AND ((s.sensor_class = 'pothole' AND NOT s.sensor_is_outlier) OR coalesce(m.max_fused, 0) >= 0.5)
    AND NOT EXISTS (SELECT 1 FROM site_cluster c WHERE c.repaired_us IS NOT NULL AND c.repaired_us >= o.ts_us
                    AND {distance_sql('c.lat', 'c.lon', 'o.lat', 'o.lon')} <= 25))"""

DBSCAN = """
member_scale AS (SELECT 25 / greatest(cos(radians(avg(lat))), 1e-6) AS eps FROM member),
spot AS (
  SELECT x, y, count(*) AS w, min(client_id) AS rep FROM (
    SELECT client_id, radians(lon) * cast(6378137 AS double) AS x,
           ln(tan(pi() / 4 + radians(lat) / 2)) * cast(6378137 AS double) AS y FROM member)
  GROUP BY x, y),
near AS (
  SELECT a.rep AS a, b.rep AS b, b.w, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
  FROM spot a JOIN spot b ON b.x BETWEEN a.x - 40 AND a.x + 40 AND b.y BETWEEN a.y - 40 AND a.y + 40, member_scale
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= eps * eps),
core AS (SELECT a AS rep FROM near GROUP BY a HAVING sum(w) >= 3),
core_edge AS (SELECT n.a, n.b FROM near n JOIN core p ON p.rep = n.a JOIN core q ON q.rep = n.b),
reach(a, b) AS (
  SELECT rep, rep FROM core UNION SELECT r.a, e.b FROM reach r JOIN core_edge e ON e.a = r.b),
core_lead AS (SELECT b AS rep, min(a) AS lead FROM reach GROUP BY b),
border AS (
  SELECT n.a AS rep, arg_min(l.lead, (n.d2, l.lead)) AS lead
  FROM near n JOIN core_lead l ON l.rep = n.b WHERE n.a NOT IN (SELECT rep FROM core) GROUP BY n.a),
spot_lead AS (SELECT * FROM core_lead UNION ALL SELECT * FROM border),
lead_label AS (SELECT lead, min(rep) AS label FROM spot_lead GROUP BY lead),
labelled AS (
  SELECT m.*, k.label FROM member m
  JOIN spot s ON s.x = radians(m.lon) * cast(6378137 AS double)
             AND s.y = ln(tan(pi() / 4 + radians(m.lat) / 2)) * cast(6378137 AS double)
  JOIN spot_lead l ON l.rep = s.rep JOIN lead_label k ON k.lead = l.lead)"""

AGGREGATED = """
fresh AS (
  SELECT label, sum(lat * w) / sum(w) AS lat, sum(lon * w) / sum(w) AS lon, quantile_cont(severity, 0.5) AS severity,
         avg(confidence) AS confidence, count(*) AS observation_count, count(DISTINCT device_id) AS distinct_devices,
         max(ts_us) AS last_seen_us
  FROM (SELECT *, greatest(confidence, 0.001) AS w FROM labelled) GROUP BY label)"""

SITE_LINKS = """
site_link AS (
  SELECT 'clu_' || lpad(cast(cast(floor(round((lon + 79.4) * 100)) AS bigint) AS varchar), 3, '0') AS cluster_id,
         client_id AS member_id, 'observation' AS kind, confidence AS fused_confidence FROM observation)"""

TO_PAIRS = (PAIRED,)
TO_COLD = (PAIRED, COLD)
TO_PRIMARY = (SCORED, PAIRED, PRIMARY)
TO_MEMBERS = (*TO_PRIMARY, SITES, MEMBERS)
TO_LABELS = (*TO_MEMBERS, DBSCAN)
TO_FRESH = (*TO_LABELS, AGGREGATED)


def twin(select: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {sql_ctes()}" + "".join(f", {c.strip()}" for c in ctes) + f"\n{select.strip()}"
