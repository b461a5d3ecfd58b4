"""The same queries as plain SQL over the same tables, for checking results with another engine."""

from __future__ import annotations

from riskloom.functions import phrases as P
from riskloom.functions.economics import Economics
from riskloom.operators.policies import GRID
from riskloom.sources.schema import (ACCUMULATING, ACTIONS, CATEGORY_RISK, CHANNELS, FEATURES,
                                     NETWORK_FEATURES, SCHEMES, TX_TYPES)

ECON = Economics()
ORACLES: dict[str, str] = {}


def dbl(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ------------------------------------------------------------------ views
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def build(body: str, *need: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in need:
        visit(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {head}\n{body}" if head else body


def oracle(name: str, body: str, *need: str) -> None:
    ORACLES[name] = build(body, *need)


def cut(expr: str, digits: int = 6) -> str:
    """Half up with the same hair as on the other side."""
    scale = dbl(float(10 ** digits))
    return f"floor(({expr}) * {scale} + {dbl(0.5 + 1e-6)}) / {scale}"


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"{cut(expr, digits)} AS {alias}"


def rs(names, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


cte("places", [], """SELECT n_nationkey AS city_id, n_name AS city, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat,
 CAST(n_nationkey * 13 - 150 AS DOUBLE) AS lon, CASE WHEN n_regionkey < 3 THEN 'KZ' ELSE 'XX' END AS country FROM nation""")
cte("tx", ["places"], """SELECT e1.*, p.city, p.country, p.lat, p.lon,
 CASE WHEN is_fraud = 0 THEN '' WHEN k % 3 = 0 THEN 'stolen_card' WHEN k % 3 = 1 THEN 'social_eng' ELSE 'fraud_ring' END AS fraud_type
FROM (SELECT event_id AS tx_id, ts, epoch_us(ts) AS us, user_id AS client_id, round(value * 1000, 0) AS amount,
 event_type AS merchant_category,
 CASE event_type WHEN 'purchase' THEN 'mobile_app' WHEN 'signup' THEN 'atm' WHEN 'click' THEN 'ecom' ELSE 'pos' END AS channel,
 CASE event_type WHEN 'purchase' THEN 'transfer' WHEN 'signup' THEN 'withdrawal' ELSE 'purchase' END AS tx_type,
 concat('D', k) AS device_id, concat('I', k % 20) AS ip, CAST((user_id + k) % 25 AS INT) AS city_id,
 CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS is_vpn, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS remote_access,
 CASE WHEN k % 13 = 0 THEN CAST(k AS DOUBLE) / 4 ELSE CAST(0 AS DOUBLE) END AS call_minutes_before,
 CAST(20 + k AS DOUBLE) AS session_duration_s,
 CASE WHEN event_type = 'purchase' THEN concat('R', k % 10) ELSE '' END AS recipient_id,
 CASE WHEN (user_id * 7 + k * 13 + event_id) % 50 = 0 THEN 1 ELSE 0 END AS is_fraud, k
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e0) e1
JOIN places p USING (city_id)""")
cte("profiles", ["places"], """SELECT c.client_id, 18 + c.client_id % 60 AS age, p.city AS home_city,
 CAST(12000 + (c.client_id % 20) * 3000 AS DOUBLE) AS avg_ticket, 20 + (c.client_id * 17) % 2900 AS tenure_days,
 p.lat AS home_lat, p.lon AS home_lon
FROM (SELECT DISTINCT user_id AS client_id FROM events) c JOIN places p ON p.city_id = c.client_id % 25""")
cte("scored", ["tx"], """SELECT t.*,
 CASE WHEN is_fraud = 1 THEN CAST(30 + tx_id % 65 AS DOUBLE) / 100
  ELSE CAST(tx_id % 40 AS DOUBLE) * CAST(tx_id % 40 AS DOUBLE) / 4000 END AS p_fraud,
 CASE WHEN k % 3 = 0 THEN CAST(0.92 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) END AS p_stolen_card,
 CASE WHEN k % 3 = 1 THEN CAST(0.92 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) END AS p_social_eng,
 CASE WHEN k % 3 = 2 THEN CAST(0.92 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) END AS p_fraud_ring FROM tx t""")
cte("ord", [], """SELECT o_orderkey AS tx_id, o_orderdate AS ts, epoch_us(o_orderdate) AS us, o_custkey AS client_id,
 o_totalprice AS amount, CASE o_orderstatus WHEN 'F' THEN 'transfer' WHEN 'P' THEN 'withdrawal' ELSE 'purchase' END AS tx_type,
 concat('D', (o_orderkey * 7) % 60) AS device_id, concat('I', o_custkey % 37) AS ip,
 CASE WHEN o_orderstatus = 'F' THEN concat('R', (o_orderkey * 11) % 90) ELSE '' END AS recipient_id
FROM orders JOIN customer ON o_custkey = c_custkey""")
cte("summary", ["tx", "profiles"], f"""SELECT t.client_id, any_value(p.age) AS age, any_value(p.home_city) AS home_city, count(*) AS tx_count,
 {cut('(any_value(p.avg_ticket) * 3 + sum(amount)) / (3 + count(*))', 2)} AS avg_amount, {cut('max(amount)', 2)} AS max_amount,
 any_value(p.tenure_days) AS tenure_days,
 {cut('CAST(count(*) FILTER (hour(ts) < 6) AS DOUBLE) / count(*)', 3)} AS night_share
FROM tx t JOIN profiles p USING (client_id) GROUP BY t.client_id""")

# ------------------------------------------------------------------ sources
oracle("src_transactions", """SELECT event_id AS tx_id, epoch_us(date_trunc('second', ts)) AS us, value AS amount
FROM events WHERE event_id % 17 <> 0""")
oracle("src_profiles", """SELECT c.client_id, CAST(coalesce(p.age, 35) AS DOUBLE) AS age, coalesce(p.home_city, 'Алматы') AS home_city,
 coalesce(p.avg_ticket, CAST(12000 AS DOUBLE)) AS avg_ticket, CAST(coalesce(p.tenure_days, 365) AS DOUBLE) AS tenure_days
FROM (SELECT client_id FROM tx UNION SELECT client_id FROM ord) c LEFT JOIN profiles p USING (client_id)""", "tx", "ord", "profiles")
oracle("geo_lookup", """SELECT tx_id, CASE WHEN city_id % 5 = 0 THEN 'NOWHERE' ELSE city END AS city,
 CASE WHEN city_id % 5 = 0 THEN CAST(48.0196 AS DOUBLE) ELSE lat END AS lat,
 CASE WHEN city_id % 5 = 0 THEN CAST(66.9237 AS DOUBLE) ELSE lon END AS lon,
 CASE WHEN city_id % 5 = 0 THEN 'KZ' ELSE country END AS country FROM tx""", "tx")
oracle("norm_fields", """SELECT tx_id, us, CASE WHEN k % 5 IN (0, 1, 2) THEN '' ELSE recipient_id END AS recipient_id,
 CASE WHEN k % 4 = 0 THEN 'pos' ELSE channel END AS channel,
 CASE WHEN k % 6 IN (0, 1) THEN CAST(0 AS DOUBLE) ELSE CAST(k AS DOUBLE) END AS call_minutes_before,
 CASE WHEN k % 9 = 0 THEN 'KZ' ELSE country END AS country, amount FROM tx""", "tx")
oracle("event_order", "SELECT tx_id, us, row_number() OVER (ORDER BY us, tx_id) - 1 AS row_index FROM ord", "ord")
cte("crc", ["tx"], """WITH RECURSIVE s(c, i, v) AS (
 SELECT x, 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT CAST(client_id AS VARCHAR) AS x FROM tx)
 UNION ALL SELECT c, i + 1,
  CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(c, i // 8 + 1, 1)) AS BIGINT)) ELSE v END) % 2 = 1
   THEN xor((CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(c, i // 8 + 1, 1)) AS BIGINT)) ELSE v END) >> 1, CAST(3988292384 AS BIGINT))
   ELSE (CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(c, i // 8 + 1, 1)) AS BIGINT)) ELSE v END) >> 1 END
 FROM s WHERE i < 8 * length(c))
SELECT CAST(c AS BIGINT) AS client_id, xor(v, CAST(4294967295 AS BIGINT)) AS crc FROM s WHERE i = 8 * length(c)""")
cte("usage", ["tx"], """SELECT client_id, kind, value, uses, row_number() OVER (PARTITION BY client_id, kind ORDER BY uses DESC, f) AS use_rank
FROM (SELECT client_id, 'device' AS kind, device_id AS value, count(*) AS uses, min(us) AS f FROM tx GROUP BY ALL
 UNION ALL SELECT client_id, 'city', city, count(*), min(us) FROM tx GROUP BY ALL)""")
cte("req", ["tx"], """SELECT tx_id, CASE WHEN tx_id % 97 = 0 THEN client_id + 1000000 ELSE client_id END AS client_id, tx_type,
 CASE WHEN tx_id % 2 = 0 THEN '' ELSE city END AS city, CASE WHEN tx_id % 3 = 0 THEN '' ELSE device_id END AS device_id,
 CASE WHEN tx_id % 5 = 0 THEN '' ELSE ip END AS ip, CASE WHEN tx_id % 7 = 0 THEN '' ELSE recipient_id END AS recipient_id FROM tx""")
oracle("resolve_defaults", """SELECT r.tx_id, r.client_id, CASE WHEN r.city = '' THEN p.home_city ELSE r.city END AS city,
 CASE WHEN r.device_id = '' THEN u.value ELSE r.device_id END AS device_id,
 CASE WHEN r.ip = '' THEN concat('10.', c.crc % 250, '.0.1') ELSE r.ip END AS ip,
 CASE WHEN r.tx_type = 'transfer' AND r.recipient_id = '' THEN 'R00000' ELSE r.recipient_id END AS recipient_id
FROM req r JOIN profiles p USING (client_id) JOIN crc c USING (client_id)
JOIN usage u ON u.client_id = r.client_id AND u.kind = 'device' AND u.use_rank = 1""", "req", "profiles", "crc", "usage")
oracle("rejected_requests", "SELECT tx_id, client_id FROM req WHERE client_id >= 1000000", "req")

# ------------------------------------------------------------------ features
RISK = "CASE merchant_category " + " ".join(f"WHEN '{k}' THEN {dbl(v)}" for k, v in CATEGORY_RISK.items()) + f" ELSE {dbl(0.3)} END"
CHAN = "CASE channel " + " ".join(f"WHEN '{c}' THEN {dbl(float(i))}" for i, c in enumerate(CHANNELS)) + f" ELSE {dbl(0.0)} END"
TYPE = "CASE tx_type " + " ".join(f"WHEN '{c}' THEN {dbl(float(i))}" for i, c in enumerate(TX_TYPES)) + f" ELSE {dbl(0.0)} END"


def hav(a, b, c, d):
    s1, s2 = f"sin((radians({c}) - radians({a})) / 2)", f"sin(radians({d} - {b}) / 2)"
    h = f"{s1} * {s1} + cos(radians({a})) * cos(radians({c})) * {s2} * {s2}"
    return f"12742 * asin(least(CAST(1 AS DOUBLE), sqrt({h})))"


def flag(cond):
    return f"CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


DAY, HOUR = 86_400_000_000, 3_600_000_000
cte("hist", ["tx", "profiles"], f"""SELECT t.*, p.age, p.avg_ticket, p.tenure_days, p.home_lat, p.home_lon,
 count(*) OVER w AS n, coalesce(sum(amount) OVER w, 0) AS s, coalesce(sum(amount * amount) OVER w, 0) AS ss,
 coalesce(max(amount) OVER w, 0) AS mx, coalesce(sum(CASE WHEN hour(ts) < 6 THEN 1 ELSE 0 END) OVER w, 0) AS ng,
 lag(us) OVER o AS pus, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon,
 count(*) OVER (PARTITION BY t.client_id ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) - 1 AS c1,
 count(*) OVER (PARTITION BY t.client_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) - 1 AS c24,
 sum(amount) OVER (PARTITION BY t.client_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS a24,
 count(*) OVER (PARTITION BY t.client_id, device_id ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nd,
 min(us) OVER (PARTITION BY t.client_id, device_id ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fd,
 count(*) OVER (PARTITION BY t.client_id, city ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nc,
 count(*) OVER (PARTITION BY t.client_id, merchant_category ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ncat,
 count(*) OVER (PARTITION BY t.client_id, recipient_id ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nr
FROM tx t JOIN profiles p USING (client_id)
WINDOW o AS (PARTITION BY t.client_id ORDER BY us, tx_id), w AS (PARTITION BY t.client_id ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
cte("hist2", ["hist"], f"""SELECT *, CASE WHEN n < 2 THEN mean * CAST(0.8 AS DOUBLE)
  ELSE greatest(sqrt(greatest(ss / n - (s / n) * (s / n), 0)), mean * CAST(0.15 AS DOUBLE)) END AS sd,
 coalesce({hav('plat', 'plon', 'lat', 'lon')}, 0) AS kmp,
 least(coalesce(CAST(us - pus AS DOUBLE) / {HOUR}, 720), 720) AS gap
FROM (SELECT *, (avg_ticket * 3 + s) / (3 + n) AS mean FROM hist)""")
cte("fclient", ["hist2"], f"""SELECT tx_id, ln(1 + amount) AS log_amount, amount / greatest(mean, 1) AS amount_to_avg,
 (amount - mean) / greatest(sd, 1) AS amount_z, CASE WHEN mx > 0 THEN amount / greatest(mx, 1) ELSE CAST(1 AS DOUBLE) END AS amount_to_max,
 {flag('n >= 3 AND amount > mx')} AS is_amount_record, {flag('amount >= 10000 AND amount % 10000 < 1e-6')} AS is_round_amount,
 CAST(hour(ts) AS DOUBLE) AS hour, {flag('hour(ts) < 6')} AS is_night, {flag('isodow(ts) >= 6')} AS is_weekend,
 gap AS hours_since_prev, CAST(c1 AS DOUBLE) AS tx_count_1h, CAST(c24 AS DOUBLE) AS tx_count_24h,
 a24 / greatest(mean, 1) AS amount_24h_to_avg,
 {flag('nd = 0')} AS is_new_device, CASE WHEN n > 0 THEN CAST(nd AS DOUBLE) / n ELSE CAST(0 AS DOUBLE) END AS device_tx_share,
 CASE WHEN nd > 0 THEN CAST(us - fd AS DOUBLE) / {DAY} ELSE CAST(0 AS DOUBLE) END AS device_age_days,
 {flag('nc = 0')} AS is_new_city, CASE WHEN n > 0 THEN CAST(nc AS DOUBLE) / n ELSE CAST(0 AS DOUBLE) END AS city_tx_share,
 {flag("country <> 'KZ'")} AS is_foreign, {hav('home_lat', 'home_lon', 'lat', 'lon')} AS distance_from_home_km,
 kmp AS distance_from_prev_km, least(kmp / greatest(gap, CAST(1 AS DOUBLE) / 60), 100000) AS travel_speed_kmh,
 CAST(is_vpn AS DOUBLE) AS is_vpn, {flag("recipient_id <> '' AND nr = 0")} AS is_new_recipient,
 CAST(remote_access AS DOUBLE) AS remote_access, call_minutes_before, {flag('call_minutes_before >= 5')} AS has_long_call,
 session_duration_s, {RISK} AS category_risk, {flag('ncat = 0')} AS is_new_category, {CHAN} AS channel_code,
 {TYPE} AS tx_type_code, {flag("tx_type = 'transfer'")} AS is_transfer, CAST(age AS DOUBLE) AS client_age,
 CAST(tenure_days AS DOUBLE) AS client_tenure_days, CAST(n AS DOUBLE) AS history_len,
 CASE WHEN n > 0 THEN CAST(ng AS DOUBLE) / n ELSE CAST(0 AS DOUBLE) END AS night_share,
 {flag('nd > 0 AND nc > 0 AND is_vpn = 0')} AS own_context FROM hist2""")
CLIENT_KEYS = {
    "f_amount": ["log_amount", "amount_to_avg", "amount_z", "amount_to_max", "is_amount_record", "is_round_amount"],
    "f_time": ["hour", "is_night", "is_weekend"],
    "f_velocity": ["hours_since_prev", "tx_count_1h", "tx_count_24h", "amount_24h_to_avg"],
    "f_device": ["is_new_device", "device_tx_share", "device_age_days"],
    "f_geo": ["is_new_city", "city_tx_share", "is_foreign", "distance_from_home_km", "distance_from_prev_km", "travel_speed_kmh"],
    "f_session": ["is_vpn", "remote_access", "call_minutes_before", "has_long_call", "session_duration_s"],
    "f_category": ["category_risk", "is_new_category", "channel_code", "tx_type_code", "is_transfer"],
    "f_client": ["client_age", "client_tenure_days", "history_len", "night_share", "own_context"],
}
for _k, _cols in CLIENT_KEYS.items():
    oracle(_k, f"SELECT tx_id, {rs(_cols)} FROM fclient", "fclient")


def network(name: str, src: str, past: str | None = None, more: str = "") -> None:
    """Counters by looking back at every earlier sighting of the same entity in ``past``."""
    def seen(col):
        return (f"FROM {src} t JOIN {past or src} p ON p.{col} = t.{col} AND t.{col} <> '' "
                f"AND (p.us < t.us OR (p.us = t.us AND p.tx_id < t.tx_id)) {more} GROUP BY t.tx_id")

    d24 = f"FILTER (p.us >= t.us - {DAY})"
    d7 = f"FILTER (p.us >= t.us - {7 * DAY})"
    cte(name, [src] + ([past] if past else []), f"""SELECT t.tx_id, greatest(coalesce(d.c, 0), 1) + CAST(0 AS DOUBLE) AS clients_per_device,
 greatest(coalesce(i.c, 0), 1) + CAST(0 AS DOUBLE) AS clients_per_ip,
 CASE WHEN t.recipient_id = '' THEN 0 ELSE greatest(coalesce(q.c, 0), 1) END + CAST(0 AS DOUBLE) AS clients_per_recipient,
 coalesce(q.c24, 0) + CAST(0 AS DOUBLE) AS recipient_clients_24h, coalesce(q.c7, 0) + CAST(0 AS DOUBLE) AS recipient_clients_7d,
 coalesce(q.n24, 0) + CAST(0 AS DOUBLE) AS recipient_inbound_24h, ln(1 + coalesce(q.a24, 0)) AS recipient_amount_24h,
 coalesce(CAST(t.us - q.f AS DOUBLE) / {DAY}, 0) AS recipient_age_days,
 {flag("t.recipient_id <> '' AND q.f IS NULL")} AS recipient_is_new_to_bank,
 greatest(coalesce(d.c24, 0), 1) + CAST(0 AS DOUBLE) AS device_clients_24h,
 greatest(coalesce(i.c24, 0), 1) + CAST(0 AS DOUBLE) AS ip_clients_24h
FROM {src} t
LEFT JOIN (SELECT t.tx_id, count(DISTINCT p.client_id) AS c, count(DISTINCT p.client_id) {d24} AS c24 {seen('device_id')}) d USING (tx_id)
LEFT JOIN (SELECT t.tx_id, count(DISTINCT p.client_id) AS c, count(DISTINCT p.client_id) {d24} AS c24 {seen('ip')}) i USING (tx_id)
LEFT JOIN (SELECT t.tx_id, count(DISTINCT p.client_id) AS c, count(DISTINCT p.client_id) {d24} AS c24,
 count(DISTINCT p.client_id) {d7} AS c7, count(*) {d24} AS n24, sum(p.amount) {d24} AS a24, min(p.us) AS f {seen('recipient_id')}) q USING (tx_id)""")


network("fnet", "tx")
network("fnet_ord", "ord")
NET_WINDOW = ["recipient_clients_24h", "recipient_clients_7d", "recipient_inbound_24h", "recipient_amount_24h",
              "device_clients_24h", "ip_clients_24h"]
oracle("f_net_total", f"SELECT tx_id, {rs(['clients_per_device', 'clients_per_ip', 'clients_per_recipient'])} FROM fnet", "fnet")
oracle("f_recipient", f"SELECT tx_id, {rs(['is_new_recipient', 'recipient_age_days', 'recipient_is_new_to_bank'])} FROM fnet JOIN fclient USING (tx_id)", "fnet", "fclient")
oracle("f_net_window", f"SELECT tx_id, {rs(NET_WINDOW)} FROM fnet", "fnet")
oracle("f_net_window_ties", f"""SELECT tx_id, {r('c', 'tx_count_24h')}, {rs(['clients_per_device', *NET_WINDOW])} FROM fnet_ord JOIN
 (SELECT t.tx_id, CAST(count(p.tx_id) AS DOUBLE) AS c FROM ord t LEFT JOIN ord p ON p.client_id = t.client_id
  AND (p.us < t.us OR (p.us = t.us AND p.tx_id < t.tx_id)) AND p.us >= t.us - {DAY} GROUP BY t.tx_id) USING (tx_id)""", "fnet_ord", "ord")

# A link exists from the position of its first use. Two nodes are in one component before position s if
# a path of links all used before s joins them: the smallest possible "latest link" of a path (closed by
# repeated squaring) is before s.
cte("seq", ["tx"], "SELECT tx_id, client_id, device_id, ip, recipient_id, row_number() OVER (ORDER BY us, tx_id) AS s FROM tx")
cte("link", ["seq"], """SELECT concat('c:', client_id) AS a, b, min(s) AS w FROM (
 SELECT client_id, concat('d:', device_id) AS b, s FROM seq UNION ALL SELECT client_id, concat('i:', ip), s FROM seq
 UNION ALL SELECT client_id, concat('r:', recipient_id), s FROM seq WHERE recipient_id <> '') GROUP BY ALL""")
cte("d0", ["link"], """SELECT a, b, w FROM link UNION ALL SELECT b, a, w FROM link
 UNION ALL SELECT DISTINCT x, x, 0 FROM (SELECT a AS x FROM link UNION SELECT b FROM link)""")
for _i in range(1, 10):
    cte(f"d{_i}", [f"d{_i - 1}"], f"SELECT x.a, y.b, min(greatest(x.w, y.w)) AS w FROM d{_i - 1} x JOIN d{_i - 1} y ON x.b = y.a GROUP BY x.a, y.b")
cte("fcomp", ["d9", "seq"], """SELECT q.tx_id, CAST(count(DISTINCT d.b) FILTER (d.b LIKE 'c:%') AS DOUBLE) AS component_clients,
 CAST(count(*) AS DOUBLE) AS component_size
FROM seq q JOIN d9 d ON d.a = concat('c:', q.client_id) AND d.w < q.s GROUP BY q.tx_id""")
oracle("graph_component", "SELECT tx_id, component_clients, component_size FROM fcomp", "fcomp")
cte("matrix", ["fclient", "fnet", "fcomp"], "SELECT * FROM fclient JOIN fnet USING (tx_id) JOIN fcomp USING (tx_id)")
oracle("feature_matrix", f"SELECT tx_id, {rs(FEATURES)} FROM matrix", "matrix")

# ------------------------------------------------------------------ summaries and graph
oracle("client_summary", f"""SELECT client_id, {r('age', 'age', 3)}, home_city, tx_count, avg_amount, max_amount,
 {r('tenure_days', 'tenure_days', 3)}, night_share FROM summary""", "summary")
oracle("client_usage", "SELECT client_id, kind, value, uses, use_rank FROM usage", "usage")
oracle("entity_first_seen", """SELECT 'device' AS kind, device_id AS entity, min(us) AS first_us FROM tx GROUP BY ALL
 UNION ALL SELECT 'ip', ip, min(us) FROM tx GROUP BY ALL
 UNION ALL SELECT 'recipient', recipient_id, min(us) FROM tx WHERE recipient_id <> '' GROUP BY ALL""", "tx")
cte("pairs", ["tx"], """SELECT kind, key, client_id, count(*) AS transactions, sum(amount) AS amount, sum(is_fraud) AS fraud FROM (
 SELECT 'device' AS kind, device_id AS key, * FROM tx UNION ALL SELECT 'ip', ip, * FROM tx) GROUP BY ALL""")
cte("hubs_all", ["pairs"], """SELECT *, row_number() OVER (PARTITION BY kind ORDER BY clients DESC, key) AS rk FROM (
 SELECT kind, key, count(*) AS clients, CAST(sum(transactions) AS BIGINT) AS transactions, sum(amount) AS amount,
 CAST(sum(fraud) AS DOUBLE) / greatest(sum(transactions), 1) AS fraud_share FROM pairs GROUP BY kind, key) WHERE clients >= 2""")
cte("hubs", ["hubs_all"], "SELECT * FROM hubs_all WHERE rk <= 40")
cte("shown", ["hubs_all"], "SELECT * FROM hubs_all WHERE clients >= 3 AND rk <= 6")
cte("shown_pairs", ["shown", "pairs"], """SELECT p.*, CAST(p.fraud AS DOUBLE) / greatest(p.transactions, 1) AS fraud_share,
 row_number() OVER (PARTITION BY client_id ORDER BY CASE p.kind WHEN 'device' THEN 0 ELSE 1 END, s.clients DESC, p.key) AS first_rank
FROM pairs p JOIN shown s ON s.kind = p.kind AND s.key = p.key""")
oracle("graph_hubs", f"SELECT kind, key, clients, transactions, {rs(['amount', 'fraud_share'])} FROM hubs", "hubs")
oracle("graph_members", f"""SELECT p.kind, p.key, p.client_id, p.transactions, {r('p.amount', 'amount')},
 {r('CAST(p.fraud AS DOUBLE) / greatest(p.transactions, 1)', 'fraud_share')} FROM pairs p JOIN hubs h ON h.kind = p.kind AND h.key = p.key""", "pairs", "hubs")
oracle("graph_nodes", f"""SELECT concat(kind, ':', key) AS id, kind AS type, key AS label, clients, transactions, {rs(['amount', 'fraud_share'])} FROM shown
UNION ALL SELECT concat('client:', client_id), 'client', CAST(client_id AS VARCHAR), NULL, transactions, {cut('amount')}, {cut('fraud_share')}
FROM shown_pairs WHERE first_rank = 1""", "shown", "shown_pairs")
oracle("graph_edges", f"SELECT concat(kind, ':', key) AS source, concat('client:', client_id) AS target, transactions AS weight, {r('amount', 'amount')} FROM shown_pairs", "shown_pairs")


# ------------------------------------------------------------------ cost model
def loss(e=ECON):
    return (f"(amount * CASE tx_type WHEN 'transfer' THEN {dbl(e.lgd_transfer)} WHEN 'withdrawal' THEN {dbl(e.lgd_withdrawal)} "
            f"ELSE {dbl(e.lgd_purchase)} END + {dbl(e.case_handling_cost)})")


def clv_amount(e=ECON):
    return f"least(greatest({dbl(e.clv_default)}, amount * 4), {dbl(e.clv_cap)})"


def clv_client(e=ECON):
    return (f"CASE WHEN avg_amount > 0 AND tx_count > 0 THEN least(greatest(avg_amount * tx_count * {dbl(e.merchant_margin)} * 36, "
            f"{dbl(25000.0)}), {dbl(e.clv_cap)}) ELSE {clv_amount(e)} END")


def stop(a, e=ECON, probs=None):
    pr = probs or {s: f"p_{s}" for s in SCHEMES}
    t = e.effectiveness[a]
    return (f"((" + " + ".join(f"{pr[s]} * {dbl(t[s])}" for s in SCHEMES) + ") / (" + " + ".join(pr[s] for s in SCHEMES) + "))")


def honest(a, e=ECON, clv=None):
    m = f"amount * {dbl(e.merchant_margin)}"
    return {"allow": dbl(0.0),
            "step_up": f"({dbl(e.step_up_op_cost)} + {m} * {dbl(e.step_up_abandon_rate)} + {dbl(e.step_up_annoyance)} + amount * {dbl(e.step_up_friction_rate)})",
            "hold": f"({dbl(e.hold_op_cost)} + {m} * {dbl(e.hold_abandon_rate)} + {dbl(e.hold_annoyance)} + amount * {dbl(e.hold_friction_rate)})",
            "block": f"({m} + ({clv or clv_client(e)}) * {dbl(e.block_churn_rate)})"}[a]


def op(a, e=ECON):
    return {"step_up": e.step_up_op_cost, "hold": e.hold_op_cost}.get(a, 0.0)


def exp_cost(a, e=ECON, clv=None, p="p_fraud", probs=None):
    if a == "allow":
        return cut(f"{p} * {loss(e)}", 2)
    fixed = dbl(op(a, e))
    return cut(f"{p} * (1 - {stop(a, e, probs)}) * {loss(e)} + {fixed} + (1 - {p}) * ({honest(a, e, clv)} - {fixed})", 2)


def costs(e=ECON, clv=None, p="p_fraud", probs=None, prefix="cost_"):
    return ", ".join(f"{exp_cost(a, e, clv, p, probs)} AS {prefix}{a}" for a in ACTIONS)


def best(prefix="cost_"):
    low = "least(" + ", ".join(f"{prefix}{a}" for a in ACTIONS) + ")"
    return "CASE " + " ".join(f"WHEN {prefix}{a} = {low} THEN '{a}'" for a in ACTIONS) + " END"


def real(a, e=ECON, clv=None):
    eff = "CASE CASE WHEN fraud_type = '' THEN 'stolen_card' ELSE fraud_type END " + " ".join(
        f"WHEN '{s}' THEN {dbl(e.effectiveness[a][s])}" for s in SCHEMES) + f" ELSE {dbl(0.0)} END"
    return f"CASE WHEN is_fraud = 1 THEN (1 - {eff}) * {loss(e)} + {dbl(op(a, e))} ELSE {honest(a, e, clv)} END"


cte("val", ["scored", "summary"], "SELECT s.*, m.avg_amount, m.tx_count FROM scored s LEFT JOIN summary m USING (client_id)")
cte("priced", ["val"], f"SELECT *, {costs()} FROM val")
cte("dec", ["priced"], f"SELECT *, {best()} AS action FROM priced")
cte("dec_fb", ["scored"], f"SELECT *, {best()} AS action FROM (SELECT *, {costs(clv=clv_amount())} FROM scored)")
OVR = ECON.override({"hold_op_cost": 400.0, "lgd_transfer": 0.7})
cte("dec_ovr", ["scored"], f"SELECT *, {best()} AS action FROM (SELECT *, {costs(OVR, clv_amount(OVR))} FROM scored)")


def decision(src):
    vals = ", ".join(f"({i}, '{a}', cost_{a})" for i, a in enumerate(ACTIONS))
    return f"""SELECT tx_id, first_value(a) OVER w AS action, c AS chosen_cost, nth_value(a, 2) OVER w AS runner_up,
 {cut('nth_value(c, 2) OVER w - c', 2)} AS margin_to_next, {cut('cost_allow - c', 2)} AS saving_vs_allow
FROM {src} CROSS JOIN LATERAL (VALUES {vals}) v(i, a, c)
WINDOW w AS (PARTITION BY tx_id ORDER BY c, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY c, i) = 1"""


oracle("scored_table", f"SELECT tx_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {r('p_fraud', 'p_fraud')}, action, least(cost_allow, cost_step_up, cost_hold, cost_block) AS chosen_cost FROM dec", "dec")
oracle("cost_lgd", f"SELECT tx_id, {r(loss(), 'loss')} FROM scored", "scored")
oracle("cost_clv", f"SELECT tx_id, {r(clv_client(), 'clv')}, {r(clv_amount(), 'clv_fallback')} FROM val", "val")
oracle("cost_effectiveness", "SELECT tx_id, " + ", ".join(r(
    f"CASE WHEN tx_id % 3 = 0 THEN ({' + '.join(dbl(ECON.effectiveness[a][s]) for s in SCHEMES)}) / 3 ELSE {stop(a)} END", f"eff_{a}") for a in ACTIONS) + " FROM scored", "scored")
oracle("expected_costs", f"SELECT tx_id, {', '.join('cost_' + a for a in ACTIONS)} FROM priced", "priced")
oracle("decide", decision("priced"), "priced")
oracle("decide_fallback", decision("dec_fb"), "dec_fb")
oracle("decide_override", decision("dec_ovr"), "dec_ovr")
oracle("realised_cost", "SELECT tx_id, " + ", ".join(r(real(a), f"real_{a}", 4) for a in ACTIONS) + " FROM val", "val")
GRID_VALUES = ", ".join(f"({dbl(t)})" for t in GRID)


def grid_sql(src):
    return (f"SELECT t AS threshold, sum(CASE WHEN p_fraud >= t THEN {real('block')} ELSE {real('allow')} END) AS total_cost "
            f"FROM {src} CROSS JOIN (VALUES {GRID_VALUES}) g(t) GROUP BY t")


oracle("threshold_grid", f"SELECT threshold, {r('total_cost', 'total_cost', 2)} FROM ({grid_sql('val')})", "val")
cte("split_dec", ["dec"], """SELECT *, CASE WHEN i < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train'
 WHEN i < floor(n * (CAST(0.6 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY us, tx_id) - 1 AS i, count(*) OVER () AS n FROM dec)""")
cte("test", ["split_dec"], "SELECT * FROM split_dec WHERE split = 'test'")
cte("valid", ["split_dec"], "SELECT * FROM split_dec WHERE split = 'valid'")
cte("grid_test", ["test"], grid_sql("test"))
cte("grid_valid", ["valid"], grid_sql("valid"))
OURS = "CASE action " + " ".join(f"WHEN '{a}' THEN {real(a)}" for a in ACTIONS) + " END"
cte("compare", ["grid_test", "grid_valid"], f"""SELECT 'ours' AS policy, CAST(NULL AS DOUBLE) AS threshold, sum({OURS}) AS cost FROM test
UNION ALL SELECT 'no_system', NULL, sum({real('allow')}) FROM test
UNION ALL SELECT 'threshold_0.50', threshold, total_cost FROM grid_test WHERE threshold = CAST(0.5 AS DOUBLE)
UNION ALL SELECT 'threshold_best', g.threshold, g.total_cost FROM grid_test g
 JOIN (SELECT threshold FROM grid_valid ORDER BY total_cost, threshold LIMIT 1) b USING (threshold)""")
oracle("policy_compare", f"SELECT policy, {rs(['threshold', 'cost'], 2)} FROM compare", "compare")
oracle("policy_savings", f"""SELECT {r("min(cost) FILTER (policy = 'ours')", 'cost_ours', 2)},
 {r("min(cost) FILTER (policy LIKE 'threshold%') - min(cost) FILTER (policy = 'ours')", 'saving_vs_threshold', 2)},
 {r("min(cost) FILTER (policy = 'no_system') - min(cost) FILTER (policy = 'ours')", 'saving_vs_nothing', 2)} FROM compare""", "compare")
COUNTS = ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in ACTIONS)
oracle("policy_summary", f"""SELECT count(*) AS transactions, {COUNTS},
 {r("avg(CASE WHEN action <> 'allow' THEN 1.0 ELSE 0.0 END) FILTER (is_fraud = 0)", 'friction_rate_honest')},
 {r("avg(CASE WHEN action <> 'allow' THEN 1.0 ELSE 0.0 END) FILTER (is_fraud = 1)", 'detection_rate')} FROM test""", "test")
oracle("policy_per_type", f"""SELECT fraud_type, count(*) AS count, {r("avg(CASE WHEN action <> 'allow' THEN 1.0 ELSE 0.0 END)", 'detected_share')},
 {COUNTS}, {r('avg(p_fraud)', 'mean_p')} FROM test WHERE is_fraud = 1 GROUP BY fraud_type""", "test")
KIND = ("CASE WHEN p_fraud_ring = greatest(p_fraud_ring, p_social_eng, p_stolen_card) THEN 'fraud_ring' "
        "WHEN p_social_eng = greatest(p_fraud_ring, p_social_eng, p_stolen_card) THEN 'social_eng' ELSE 'stolen_card' END")
ASSUMED = {s: f"(CASE kind WHEN '{s}' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END)" for s in SCHEMES}
oracle("what_if", f"""SELECT tx_type, kind, p, {COUNTS}, {', '.join(r(f'avg(cost_{a})', f'cost_{a}', 4) for a in ACTIONS)}
FROM (SELECT *, {best()} AS action FROM (SELECT *, {costs(clv=clv_amount(), p='p', probs=ASSUMED)} FROM
 (SELECT tx_type, amount, {KIND} AS kind FROM scored) CROSS JOIN (SELECT CAST(i AS DOUBLE) * 2 / 100 AS p FROM range(51) t(i)))) GROUP BY ALL""", "scored")
oracle("decision_map", f"""SELECT tx_type, kind, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {r('amount', 'amount', 2)}, {r('p', 'p', 4)}, {best()} AS action
FROM (SELECT *, {costs(clv=clv_amount(), p='p', probs=ASSUMED)} FROM (SELECT tx_type, kind, i, j, exp(a + (b - a) * i / 25) AS amount, CAST(j AS DOUBLE) / 40 AS p
 FROM (SELECT tx_type, ln(lo) AS a, ln(greatest(hi, lo * 2)) AS b FROM (SELECT tx_type, min(amount) FILTER (amount > 0) AS lo, max(amount) AS hi FROM scored GROUP BY tx_type))
 CROSS JOIN (VALUES ('stolen_card'), ('social_eng'), ('fraud_ring')) s(kind) CROSS JOIN range(26) x(i) CROSS JOIN range(41) y(j)))""", "scored")


def sensitivity():
    from riskloom.operators.policies import variants

    parts = []
    for name, e in variants().items():
        parts.append(f"""SELECT '{name}' AS parameter, avg(CASE WHEN base <> ideal THEN 1.0 ELSE 0.0 END) AS ch,
 sum(CASE base {' '.join(f"WHEN '{a}' THEN cost_{a}" for a in ACTIONS)} END) AS ours, sum(least({', '.join('cost_' + a for a in ACTIONS)})) AS bst
FROM (SELECT *, {best()} AS ideal FROM (SELECT base, {costs(e, clv_amount(e))} FROM based))""")
    return "SELECT parameter, " + r("ch", "changed_share") + ", " + r("(ours - bst) / bst", "regret_share") + ", " + r("ours - bst", "regret_absolute", 2) + " FROM (" + " UNION ALL ".join(parts) + ")"


cte("based", ["scored"], f"SELECT *, {best()} AS base FROM (SELECT *, {costs(clv=clv_amount())} FROM scored)")
oracle("cost_sensitivity", sensitivity(), "based")

# ------------------------------------------------------------------ metrics
SPLIT = """CASE WHEN i < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN i < floor(n * (CAST(0.6 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'valid' ELSE 'test' END"""
oracle("time_split", f"SELECT tx_id, i AS row_index, {SPLIT} AS split FROM (SELECT tx_id, row_number() OVER (ORDER BY us, tx_id) - 1 AS i, count(*) OVER () AS n FROM ord)", "ord")


def curve(src, key="0"):
    return f"""SELECT k, s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY k) AS p, sum(neg) OVER (PARTITION BY k) AS q
FROM (SELECT {key} AS k, p_fraud AS s, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM {src} GROUP BY 1, 2)
WINDOW w AS (PARTITION BY k ORDER BY s DESC)"""


AUC = "CAST(sum(neg * (tp - pos + CAST(pos AS DOUBLE) / 2)) AS DOUBLE) / any_value(CAST(p AS DOUBLE) * q)"
AP = "sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / any_value(p)"
RECALL = "coalesce(max(tp) FILTER (CAST(tp AS DOUBLE) / (tp + fp) >= {t}) / CAST(any_value(p) AS DOUBLE), 0)"
cte("curve", ["scored"], curve("scored"))
oracle("roc_auc", f"SELECT {r(AUC, 'roc_auc')} FROM curve", "curve")
oracle("average_precision", f"SELECT {r(AP, 'average_precision')} FROM curve", "curve")
oracle("brier", f"SELECT {r('avg((p_fraud - is_fraud) * (p_fraud - is_fraud))', 'brier')} FROM scored", "scored")
oracle("recall_at_precision", " UNION ALL ".join(
    f"""SELECT {dbl(t)} AS target, {r(RECALL.format(t=dbl(t)), 'recall')},
 {r(f"coalesce(arg_min(s, (-tp, s)) FILTER (CAST(tp AS DOUBLE) / (tp + fp) >= {dbl(t)}), 1)", 'threshold')} FROM curve""" for t in (0.90, 0.75, 0.50, 0.25)), "curve")
cte("edges", ["scored"], """SELECT DISTINCT e FROM (SELECT CAST(0 AS DOUBLE) AS e UNION ALL
 SELECT round(unnest(quantile_cont(p_fraud, [""" + ", ".join(str(0.9 + (0.1 / 9) * i) for i in range(9)) + """, 1.0])), 6) FROM scored)""")
oracle("reliability_curve", f"""SELECT {rs(['p_lo', 'p_hi'])}, count(*) AS count, {r('avg(p_fraud)', 'predicted')}, {r('avg(is_fraud)', 'actual')}
FROM (SELECT e AS p_lo, lead(e) OVER (ORDER BY e) AS p_hi, max(e) OVER () AS top FROM edges) b
JOIN scored ON p_fraud >= p_lo AND (p_fraud < p_hi OR p_hi = top) WHERE p_hi IS NOT NULL GROUP BY p_lo, p_hi HAVING count(*) >= 20""", "edges", "scored")
oracle("recall_at_budget", f"""SELECT fraud_type, {r('avg(CASE WHEN i <= greatest(1, round_even(n * CAST(0.02 AS DOUBLE), 0)) THEN 1.0 ELSE 0.0 END)', 'recall')}, count(*) AS n
FROM (SELECT *, row_number() OVER (ORDER BY p_fraud DESC, tx_id) AS i, count(*) OVER () AS n FROM scored) WHERE is_fraud = 1 GROUP BY fraud_type""", "scored")
FOLD_ENDS = """CAST(floor(n * (CAST(0.4 AS DOUBLE) + CAST(0.125 AS DOUBLE) * k)) AS BIGINT) AS train_end,
 CAST(floor(n * (CAST(0.4 AS DOUBLE) + CAST(0.125 AS DOUBLE) * k + CAST(0.1 AS DOUBLE))) AS BIGINT) AS valid_end,
 CAST(floor(n * least(CAST(0.4 AS DOUBLE) + CAST(0.125 AS DOUBLE) * k + CAST(0.1 AS DOUBLE) + CAST(0.125 AS DOUBLE), 1)) AS BIGINT) AS test_end"""
cte("folds", ["scored"], f"SELECT CAST(k + 1 AS INT) AS fold, {FOLD_ENDS} FROM (SELECT count(*) AS n FROM scored) CROSS JOIN range(4) t(k)")
oracle("walkforward_folds", "SELECT fold, train_end, valid_end, test_end FROM folds", "folds")
cte("tested", ["scored", "folds"], """SELECT s.*, f.fold FROM (SELECT *, row_number() OVER (ORDER BY us, tx_id) - 1 AS i FROM scored) s
 JOIN folds f ON i >= valid_end AND i < test_end""")
cte("fold_curve", ["tested"], curve("tested", "fold"))
cte("fold_metrics", ["tested", "fold_curve"], f"""SELECT t.*, m.pr_auc, m.roc_auc, m.recall_at_precision90 FROM
 (SELECT fold, count(*) AS rows_test, CAST(sum(is_fraud) AS BIGINT) AS fraud_in_test FROM tested GROUP BY fold) t JOIN
 (SELECT k AS fold, {AP} AS pr_auc, {AUC} AS roc_auc, {RECALL.format(t=dbl(0.9))} AS recall_at_precision90 FROM fold_curve GROUP BY k) m USING (fold)""")
oracle("walkforward_metrics", f"SELECT fold, rows_test, fraud_in_test, {rs(['pr_auc', 'roc_auc', 'recall_at_precision90'])} FROM fold_metrics", "fold_metrics")
oracle("walkforward_schemes", f"""SELECT fold, fraud_type, count(*) AS n, {r('avg(CASE WHEN p_fraud > 0.5 THEN 1.0 ELSE 0.0 END)', 'share_above_half')}
FROM tested WHERE is_fraud = 1 GROUP BY ALL HAVING count(*) >= 5""", "tested")
oracle("metric_spread", " UNION ALL ".join(f"""SELECT '{m}' AS metric, {r(f'median({m})', 'median')}, {r(f'min({m})', 'min')}, {r(f'max({m})', 'max')}, count(*) AS n
 FROM fold_metrics""" for m in ("pr_auc", "roc_auc", "recall_at_precision90")), "fold_metrics")
oracle("dominant_kind", f"SELECT tx_id, {KIND} AS dominant_kind FROM scored", "scored")
oracle("type_accuracy", f"""SELECT coalesce(fraud_type, 'all') AS fraud_type, count(*) AS n,
 {r(f"avg(CASE WHEN CASE WHEN tx_id % 9 = 0 THEN 'fraud_ring' ELSE {KIND} END = fraud_type THEN 1.0 ELSE 0.0 END)", 'accuracy')}
FROM scored WHERE is_fraud = 1 GROUP BY ROLLUP (fraud_type)""", "scored")
oracle("noisy_or", f"""SELECT tx_id, {r('p_fraud', 'p_fraud')}, {r('a', 'p_anomaly')}, {r('1 - (1 - p_fraud) * (1 - a)', 'p_fused')}
FROM (SELECT *, least(CAST(k AS DOUBLE) / 200, CAST(0.2 AS DOUBLE)) AS a FROM scored)""", "scored")

# ------------------------------------------------------------------ drift
cte("sides", ["tx"], """SELECT tx_id, CASE WHEN i >= st THEN 'current' WHEN i >= st - (n - st) THEN 'reference' END AS side FROM
 (SELECT *, floor(n * (CAST(0.6 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS st FROM (SELECT tx_id, row_number() OVER (ORDER BY us, tx_id) - 1 AS i, count(*) OVER () AS n FROM tx))""")
# features are numbered here and named at the end
cte("sided", ["matrix", "sides"], f"SELECT side, {rs(FEATURES, 4)} FROM matrix JOIN sides USING (tx_id) WHERE side IS NOT NULL")
cte("long", ["sided"], " UNION ALL ".join(f"SELECT CASE side WHEN 'reference' THEN 1 ELSE 0 END AS ref, {i} AS fno, {f} AS value FROM sided" for i, f in enumerate(FEATURES, 1)))
cte("psi_edges", ["long"], """SELECT fno, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS u,
 count(*) AS n FROM long WHERE ref = 1 GROUP BY fno""")
cte("psi_bins", ["long", "psi_edges"], """SELECT fno, len(list_filter(u[2:len(u) - 1], lambda x: x <= value)) AS bin, len(u) AS ne,
 CAST(count(*) FILTER (ref = 1) AS DOUBLE) AS e, CAST(count(*) FILTER (ref = 0) AS DOUBLE) AS a
 FROM long JOIN psi_edges USING (fno) GROUP BY ALL""")
cte("psi_values", ["psi_bins"], """SELECT fno, sum(CASE WHEN ne < 3 THEN 0 ELSE (am - em) * ln(am / em) END) AS psi FROM
 (SELECT fno, ne, greatest(e / sum(e) OVER (PARTITION BY fno), CAST(0.0001 AS DOUBLE)) AS em,
  greatest(a / sum(a) OVER (PARTITION BY fno), CAST(0.0001 AS DOUBLE)) AS am FROM psi_bins) GROUP BY fno""")
cte("psi_rows", ["psi_values"], f"""SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS verdict,
 feature IN ({', '.join(repr(f) for f in ACCUMULATING)}) AS accumulating FROM (SELECT [{', '.join(repr(f) for f in FEATURES)}][fno] AS feature, psi FROM psi_values)""")
oracle("psi", f"SELECT feature, {r('psi', 'psi', 4)}, verdict, accumulating FROM psi_rows", "psi_rows")
cte("weekly", ["scored"], """SELECT CAST(CAST(ts AS DATE) + CAST(7 - isodow(ts) AS INT) AS VARCHAR) AS period, count(*) AS count, avg(p_fraud) AS predicted, avg(is_fraud) AS actual
 FROM scored GROUP BY 1 HAVING count(*) >= 200""")
oracle("calibration_weekly", f"SELECT period, count, {rs(['predicted', 'actual'])}, {r('predicted - actual', 'gap')} FROM weekly", "weekly")
cte("gate", ["psi_rows", "weekly"], """SELECT (SELECT count(*) FROM psi_rows WHERE verdict = 'significant' AND NOT accumulating) AS ns,
 (SELECT coalesce(string_agg(feature, ', ' ORDER BY psi DESC, feature), '') FROM (SELECT * FROM psi_rows WHERE verdict = 'significant' AND NOT accumulating ORDER BY psi DESC, feature LIMIT 5)) AS sh,
 (SELECT coalesce(max(abs(predicted - actual)), 0) FROM weekly) AS wg""")
oracle("drift_gate", f"""SELECT ns = 0 AND wg <= 0.006 AS ok, CASE WHEN ns = 0 AND wg <= 0.006 THEN 'ok' ELSE 'retrain' END AS verdict,
 CAST(ns AS INT) AS n_shifted, sh AS shifted, wg > 0.006 AS calibration_broken, {r('wg', 'worst_gap')}, CAST(0.006 AS DOUBLE) AS gap_threshold FROM gate""", "gate")

# ------------------------------------------------------------------ dashboard
oracle("stats_totals", f"""SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(min(ts)) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(min(ts), '%f'), '0') END AS period_from,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(max(ts)) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(max(ts), '%f'), '0') END AS period_to,
 count(*) AS transactions, {r('sum(amount)', 'turnover')},
 count(*) FILTER (is_fraud = 1) AS fraud_count, {r('sum(amount) FILTER (is_fraud = 1)', 'fraud_amount')},
 count(*) FILTER (is_fraud = 1 AND action <> 'allow') AS caught_count, {r("coalesce(sum(amount) FILTER (is_fraud = 1 AND action <> 'allow'), 0)", 'caught_amount')},
 count(*) FILTER (is_fraud = 1 AND action = 'allow') AS missed_count, {r("coalesce(sum(amount) FILTER (is_fraud = 1 AND action = 'allow'), 0)", 'missed_amount')},
 count(*) FILTER (is_fraud = 0 AND action <> 'allow') AS friction_count, {r('avg(is_fraud)', 'fraud_rate')},
 {r("CAST(count(*) FILTER (is_fraud = 0 AND action <> 'allow') AS DOUBLE) / count(*) FILTER (is_fraud = 0)", 'friction_rate')},
 {r("CAST(count(*) FILTER (is_fraud = 1 AND action <> 'allow') AS DOUBLE) / count(*) FILTER (is_fraud = 1)", 'detection_rate')} FROM dec""", "dec")
oracle("stats_daily", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS fraud, {r('sum(amount)', 'amount')},
 count(*) FILTER (action = 'block') AS blocked FROM dec GROUP BY 1""", "dec")
oracle("stats_actions", "SELECT a AS action, count(d.tx_id) AS count FROM (VALUES ('allow'), ('step_up'), ('hold'), ('block')) v(a) LEFT JOIN dec d ON d.action = a GROUP BY a", "dec")
oracle("feed", f"""SELECT tx_id, us, client_id, {r('amount', 'amount')}, city, country, merchant_category, channel, tx_type, {r('p_fraud', 'p_fraud')}, action, is_fraud, fraud_type,
 {KIND} AS dominant_kind FROM dec WHERE action = 'hold' ORDER BY us DESC, tx_id DESC LIMIT 40""", "dec")
oracle("client_history", f"""SELECT client_id, CAST(recent_rank AS INT) AS recent_rank, tx_id, us, {r('amount', 'amount')}, city, merchant_category, {r('p_fraud', 'p_fraud')}, action, is_fraud
FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY us DESC, tx_id DESC) AS recent_rank FROM dec) WHERE recent_rank <= 30""", "dec")
oracle("city_map", f"""SELECT city, any_value(lat) AS lat, any_value(lon) AS lon, any_value(country) AS country, any_value(country) <> 'KZ' AS "foreign",
 count(*) AS transactions, {r('sum(amount)', 'amount')}, CAST(sum(is_fraud) AS BIGINT) AS fraud, {r('coalesce(sum(amount) FILTER (is_fraud = 1), 0)', 'fraud_amount')},
 count(*) FILTER (action = 'block') AS blocked, {r('avg(is_fraud)', 'fraud_rate')} FROM dec GROUP BY city""", "dec")
cte("holds", ["dec"], "SELECT *, greatest(cost_allow - cost_hold, 0) AS saving FROM dec WHERE action = 'hold'")
cte("period", ["dec"], "SELECT greatest((max(us) - min(us)) // 86400000000, 1) AS days, count(*) AS feed_rows FROM dec")
oracle("capacity_savings", f"SELECT tx_id, {r('saving', 'saving', 2)} FROM holds", "holds")
cte("hourly", ["holds"], "SELECT hour(ts) AS h, count(*) AS c FROM holds GROUP BY 1")
oracle("capacity_load", f"""SELECT n AS holds, days, CAST(round_even(n * f, 0) AS BIGINT) AS monthly_calls, {cut('n * f / 30 / 80', 2)} AS monthly_operators, {cut('sv * f', 2)} AS monthly_saving,
 {cut('CAST(n AS DOUBLE) / days', 1)} AS calls_per_day, CAST(ph AS INT) AS peak_hour, {cut('CAST(pc AS DOUBLE) / days', 1)} AS peak_calls_per_hour, CAST(80 AS DOUBLE) AS calls_per_operator_shift,
 {cut('CAST(n AS DOUBLE) / days / 80', 2)} AS operators_needed_average, {cut('CAST(pc AS DOUBLE) / days / 10', 2)} AS operators_needed_peak,
 {cut('sv', 2)} AS total_expected_saving, {cut('sv / n', 2)} AS saving_per_call
FROM (SELECT count(*) AS n, sum(saving) AS sv FROM holds) CROSS JOIN (SELECT *, CAST(100000 AS DOUBLE) / feed_rows AS f FROM period)
CROSS JOIN (SELECT h AS ph, c AS pc FROM hourly ORDER BY c DESC, h LIMIT 1)""", "holds", "period", "hourly")
oracle("capacity_by_hour", f"SELECT CAST(h AS INT) AS hour, {cut('CAST(c AS DOUBLE) / days', 2)} AS calls FROM hourly CROSS JOIN period", "hourly", "period")
cte("cap_curve", ["holds", "period"], f"""SELECT i / CAST(10 AS DOUBLE) AS share_of_calls, calls, coalesce(got, 0) / total AS share_of_value, {cut('CAST(calls AS DOUBLE) / days / 80', 2)} AS operators
FROM (SELECT i, CAST(round_even(i / CAST(10 AS DOUBLE) * (SELECT count(*) FROM holds), 0) AS BIGINT) AS calls FROM range(11) t(i))
LEFT JOIN (SELECT row_number() OVER w AS rn, sum(saving) OVER w AS got FROM holds WINDOW w AS (ORDER BY saving DESC, tx_id)) ON rn = calls
CROSS JOIN (SELECT sum(saving) AS total FROM holds) CROSS JOIN period""")
oracle("capacity_curve", f"SELECT {r('share_of_calls', 'share_of_calls')}, calls, {rs(['share_of_value', 'operators'])} FROM cap_curve", "cap_curve")
oracle("capacity_selected", f"SELECT {r('share_of_calls', 'share_of_calls')}, calls, {rs(['share_of_value', 'operators'])} FROM cap_curve ORDER BY abs(operators - 1), share_of_calls LIMIT 1", "cap_curve")

# ------------------------------------------------------------------ explanation
EXPLAINED = [f for f in FEATURES if f not in NETWORK_FEATURES and not f.startswith("clients_per")]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


for _name, _features in (("contrib", EXPLAINED), ("contrib_all", FEATURES)):
    cte(_name, ["tx"], f"""SELECT tx_id, j, feature, ((tx_id * (j + 3) + k * 7) % 41 - 20) / CAST(100 AS DOUBLE) AS c
FROM tx CROSS JOIN (VALUES {', '.join(f"({j}, '{f}')" for j, f in enumerate(_features))}) v(j, feature)""")
oracle("top_reasons", f"""SELECT tx_id, CAST(rk - 1 AS INT) AS rank, feature, {r('c', 'contribution', 4)} FROM
 (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY c DESC, j) AS rk FROM contrib) WHERE rk <= 3 AND c > 0""", "contrib")


def reasons_cte(name: str, src: str, risk: int, safe: int) -> None:
    cte(name, [src], f"""SELECT tx_id, CAST(row_number() OVER (PARTITION BY tx_id ORDER BY abs(c) DESC, j) - 1 AS INT) AS reason_no, feature, c,
 CASE WHEN c > 0 THEN 'risk' ELSE 'safe' END AS direction
 FROM (SELECT *, row_number() OVER (PARTITION BY tx_id, c > 0 ORDER BY abs(c) DESC, j) AS rk FROM {src} WHERE abs(c) >= 0.0001)
 WHERE rk <= CASE WHEN c > 0 THEN {risk} ELSE {safe} END""")


reasons_cte("why", "contrib", 4, 2)
reasons_cte("why_feed", "contrib", 3, 1)
oracle("reasons", f"SELECT tx_id, reason_no, feature, {r('c', 'contribution', 4)}, direction FROM why", "why")


def shown_sql(f: str, lang: str) -> str:
    if f not in P.SHOWN:
        return "''"
    source, fmt = P.SHOWN[f]
    if source == "city":
        return "t.city"
    col = {"category": "t.merchant_category", "channel": "t.channel", "tx_type": "t.tx_type"}.get(source)
    if col:
        return f"CASE {col} " + " ".join(f"WHEN '{c}' THEN {q(n)}" for c, n in P.CODE_NAMES[lang][source].items()) + f" ELSE {col} END"
    num = {"amount": "t.amount", "hours": f"f.{f} * 24", "minutes": f"f.{f} * 60", "expm1": f"exp(f.{f}) - 1", "feature": f"f.{f}"}[source]
    return f"format('{{:{fmt}}}', {num})"


def text_sql(lang: str, features: list[str]) -> str:
    return "CASE w.direction || ':' || w.feature " + " ".join(
        f"WHEN '{d}:{f}' THEN replace({q(t)}, '{{v}}', {shown_sql(f, lang)})"
        for d, table in P.PHRASES[lang].items() for f, t in table.items() if f in features) + \
        f" ELSE replace(CASE w.direction WHEN 'risk' THEN {q(P.GENERIC['risk'][lang])} ELSE {q(P.GENERIC['safe'][lang])} END, '{{f}}', w.feature) END"


oracle("reason_text", f"SELECT w.tx_id, w.reason_no, w.feature, {text_sql('en', EXPLAINED)} AS text FROM why_feed w JOIN tx t USING (tx_id) JOIN fclient f USING (tx_id)", "why_feed", "tx", "fclient")
reasons_cte("why_all", "contrib_all", 4, 2)
oracle("reason_text_languages", "SELECT w.tx_id, w.reason_no, w.feature, w.direction, " + ", ".join(f"{text_sql(x, FEATURES)} AS text_{x}" for x in P.LANGUAGES)
       + " FROM why_all w JOIN tx t USING (tx_id) JOIN matrix f USING (tx_id)", "why_all", "tx", "matrix")
SPACED = "replace(format('{:,.0f}', amount), ',', ' ')"


def message_sql(lang: str) -> str:
    parts = []
    for (a, k), t in sorted(P.CLIENT_MESSAGES.items(), key=lambda x: x[0][1] == "default"):
        cond = f"action = '{a}'" + ("" if k == "default" else f" AND {KIND} = '{k}'")
        parts.append(f"WHEN {cond} THEN replace({q(t[lang])}, '{{amount}}', {SPACED})")
    return "CASE " + " ".join(parts) + f" ELSE '' END AS message_{lang}"


def script_sql(lang: str) -> str:
    parts = [f"WHEN {KIND} = '{k}' THEN {q(t[lang])}" for k, t in P.OPERATOR_SCRIPTS.items()]
    return f"CASE WHEN action NOT IN ('hold', 'block') THEN '' {' '.join(parts)} END AS script_{lang}"


oracle("client_message", f"SELECT tx_id, {', '.join(message_sql(x) for x in P.LANGUAGES)} FROM dec_fb", "dec_fb")
oracle("operator_script", f"SELECT tx_id, {', '.join(script_sql(x) for x in P.LANGUAGES)} FROM dec_fb", "dec_fb")

SEV = "list_position(['allow', 'step_up', 'hold', 'block'], {})"
cte("strict", ["dec_fb", "hist", "profiles", "usage"], """SELECT d.tx_id, d.amount, d.tx_type, d.is_vpn, d.remote_access, d.call_minutes_before, d.device_id, d.city,
 d.p_fraud, d.p_stolen_card, d.p_social_eng, d.p_fraud_ring, d.action AS action_from, h.nd, p.home_city, u.value AS usual
FROM dec_fb d JOIN hist h USING (tx_id) JOIN profiles p ON p.client_id = d.client_id
JOIN usage u ON u.client_id = d.client_id AND u.kind = 'device' AND u.use_rank = 1 WHERE d.action <> 'allow'""")
FLIPS = [("is_vpn", "'1'", "'0'", "is_vpn <> 0", 0.3), ("remote_access", "'1'", "'0'", "remote_access <> 0", 0.2),
         ("call_minutes_before", "CAST(call_minutes_before AS VARCHAR)", "'0'", "call_minutes_before > 0", 0.5),
         ("device_id", "device_id", "usual", "nd = 0", 0.4), ("city", "city", "home_city", "home_city <> city", 0.6)]
cte("flip", ["strict"], f"""SELECT *, {best()} AS action_to FROM (SELECT *, {costs(clv=clv_amount(), p='p_to')} FROM (""" + " UNION ALL ".join(
    f"SELECT *, {i} AS no, '{f}' AS field, {was} AS was, {to} AS becomes, p_fraud * {dbl(x)} AS p_to FROM strict WHERE {cond}"
    for i, (f, was, to, cond, x) in enumerate(FLIPS)) + "))")
cte("flip_soft", ["flip"], f"SELECT * FROM flip WHERE {SEV.format('action_to')} < {SEV.format('action_from')}")
oracle("counterfactual_flips", f"SELECT tx_id, field, was, becomes, action_from, action_to, {r('p_fraud', 'p_from')}, {r('p_to', 'p_to')} FROM flip_soft", "flip_soft")


def at_amount(src: str) -> str:
    """Rows of ``src`` with the action chosen at their amount."""
    return f"SELECT *, {best()} AS action_to FROM (SELECT *, {costs(clv=clv_amount())} FROM ({src}))"


SOFT = f"{SEV.format('action_to')} < {SEV.format('action_from')}"
cte("half", ["strict"], f"""SELECT tx_id, arg_min(amount, i) AS lo FROM ({at_amount('SELECT * REPLACE (amount / pow(CAST(2 AS DOUBLE), i) AS amount) FROM strict CROSS JOIN range(1, 21) t(i)')})
 WHERE amount >= 100 AND {SOFT} GROUP BY tx_id""")
cte("bisect", ["half", "strict"], f"""WITH RECURSIVE b(tx_id, step, llo, lhi, best) AS (
 SELECT tx_id, 0, ln(lo), ln(amount), lo FROM half JOIN strict USING (tx_id)
 UNION ALL SELECT tx_id, step + 1, CASE WHEN {SOFT} THEN ln(amount) ELSE llo END, CASE WHEN {SOFT} THEN lhi ELSE ln(amount) END, CASE WHEN {SOFT} THEN amount ELSE best END
 FROM ({at_amount('SELECT s.* REPLACE (exp((llo + lhi) / 2) AS amount), step, llo, lhi, best FROM b JOIN strict s USING (tx_id) WHERE step < 12')}))
SELECT tx_id, best FROM b WHERE step = 12""")
cte("amount_soft", ["bisect", "strict"], f"""SELECT tx_id, amount AS becomes, action_from, action_to, p_fraud FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY try) AS rk
 FROM ({at_amount('SELECT s.* REPLACE (CASE try WHEN 0 THEN greatest(100, floor(best / 100) * 100) ELSE best END AS amount), try FROM bisect JOIN strict s USING (tx_id) CROSS JOIN (VALUES (0), (1)) t(try)')})
 WHERE try = 1 OR {SOFT}) WHERE rk = 1""")
oracle("counterfactual_amount", f"SELECT tx_id, {r('becomes', 'becomes', 2)}, action_from, action_to FROM amount_soft", "amount_soft")


def change_sql(lang: str) -> str:
    return "CASE field " + " ".join(
        f"WHEN '{f}' THEN " + (f"replace({q(t[lang])}, '{{v}}', replace(format('{{:,.0f}}', round({cut('becomes', 2)}, 0)), ',', ' '))" if f == "amount" else q(t[lang]))
        for f, t in P.CHANGE_TEXTS.items()) + " END"


cte("changes", ["flip_soft", "amount_soft"], f"""SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY {SEV.format('action_to')}, p_to, no) AS rank FROM (
 SELECT tx_id, no, field, CAST(NULL AS DOUBLE) AS becomes, action_from, action_to, p_to FROM flip_soft
 UNION ALL SELECT tx_id, 5, 'amount', becomes, action_from, action_to, p_fraud FROM amount_soft)""")
oracle("counterfactual_rank", f"""SELECT tx_id, CAST(rank AS INT) AS rank, field, action_from, action_to, {change_sql('en')} AS text, NULL AS note FROM changes WHERE rank <= 3
UNION ALL SELECT tx_id, NULL, NULL, action, NULL, NULL, CASE action WHEN 'allow' THEN 'already_softest' ELSE 'nothing_helps' END FROM dec_fb
 WHERE tx_id NOT IN (SELECT tx_id FROM changes)""", "changes", "dec_fb")
oracle("counterfactual_languages", "SELECT tx_id, CAST(rank AS INT) AS rank, " + ", ".join(f"{change_sql(x)} AS text_{x}, NULL AS note_{x}" for x in P.LANGUAGES)
       + " FROM changes WHERE rank <= 3 UNION ALL SELECT tx_id, NULL, " + ", ".join(
           f"NULL, CASE action WHEN 'allow' THEN {q(P.CHANGE_NOTES['already_softest'][x])} ELSE {q(P.CHANGE_NOTES['nothing_helps'][x])} END" for x in P.LANGUAGES)
       + " FROM dec_fb WHERE tx_id NOT IN (SELECT tx_id FROM changes)", "changes", "dec_fb")
oracle("report_document", f"""SELECT fraud_type, count(*) AS count, {r("avg(CASE WHEN action <> 'allow' THEN 1.0 ELSE 0.0 END)", 'detected_share')},
 {COUNTS}, {r('avg(p_fraud)', 'mean_p')} FROM test WHERE is_fraud = 1 GROUP BY fraud_type""", "test")
oracle("observed_history", f"""SELECT tx_id, {rs(['history_len', 'tx_count_24h', 'device_tx_share', 'clients_per_device', 'recipient_clients_24h'])}
 FROM fclient JOIN fnet USING (tx_id) WHERE tx_id % 5 = 0""", "fclient", "fnet")

# ------------------------------------------------------------------ replay and wording of the gate
def isotonic(name: str, src: str, x: str) -> None:
    """The monotone fit of is_fraud on the distinct values of ``x``: the slope of the lower convex hull of the cumulative diagram,
    as the largest of the least mean of any run of values that holds the value."""
    cte(f"{name}_at", [src], f"""SELECT i, x, sum(y) OVER (ORDER BY i) AS cy, sum(w) OVER (ORDER BY i) AS cw FROM (
 SELECT row_number() OVER (ORDER BY {x}) AS i, {x} AS x, CAST(sum(is_fraud) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w FROM {src} GROUP BY {x})""")
    cte(f"{name}_low", [f"{name}_at"], f"""SELECT j, i, min(slope) OVER (PARTITION BY j ORDER BY i DESC) AS low FROM (
 SELECT j.i AS j, k.i AS i, (k.cy - coalesce(h.cy, 0)) / (k.cw - coalesce(h.cw, 0)) AS slope
 FROM {name}_at j LEFT JOIN {name}_at h ON h.i = j.i - 1 JOIN {name}_at k ON k.i >= j.i)""")
    cte(name, [f"{name}_low", f"{name}_at"], f"SELECT x, max(low) AS p FROM {name}_low JOIN {name}_at USING (i) GROUP BY x")


def mapped(src: str, fit: str, x: str, out: str, high: float = 1.0) -> str:
    """Rows of ``src`` with the fit at ``x``: between its values in a straight line, beyond them as at the last one."""
    return f"""SELECT s.*, least(greatest(CASE WHEN a.x IS NULL THEN b.p WHEN b.x IS NULL OR a.x = b.x THEN a.p
 ELSE a.p + (b.p - a.p) * (s.{x} - a.x) / (b.x - a.x) END, 0), {dbl(high)}) AS {out}
FROM {src} s ASOF LEFT JOIN {fit} a ON s.{x} >= a.x ASOF LEFT JOIN {fit} b ON s.{x} <= b.x"""


cte("chain", ["scored"], """SELECT tx_id, is_fraud, CASE WHEN us % 3 = 0 THEN p_fraud * p_fraud ELSE p_fraud * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE) END AS p_raw,
 CAST(k * 7 % 50 + is_fraud * 10 AS DOUBLE) / 64 AS anomaly_score, row_number() OVER (ORDER BY us, tx_id) - 1 AS i, count(*) OVER () AS n FROM scored""")
cte("chain_valid", ["chain"], "SELECT * FROM chain WHERE i >= floor(n * CAST(0.6 AS DOUBLE)) AND i < floor(n * CAST(0.75 AS DOUBLE)) AND tx_id % 5 <> 0")
cte("chain_test", ["chain"], "SELECT * FROM chain WHERE i >= floor(n * CAST(0.75 AS DOUBLE))")
isotonic("iso_raw", "chain_valid", "p_raw")
isotonic("iso_anomaly", "chain_valid", "anomaly_score")
for _part in ("valid", "test"):
    cte(f"chain_{_part}1", [f"chain_{_part}", "iso_raw"], mapped(f"chain_{_part}", "iso_raw", "p_raw", "p_supervised"))
    cte(f"chain_{_part}2", [f"chain_{_part}1", "iso_anomaly"], mapped(f"chain_{_part}1", "iso_anomaly", "anomaly_score", "p_anomaly", 0.2))
    cte(f"chain_{_part}3", [f"chain_{_part}2"], f"SELECT *, 1 - (1 - p_supervised) * (1 - p_anomaly) AS fused FROM chain_{_part}2")
isotonic("iso_fused", "chain_valid3", "fused")
cte("chain_out", ["chain_test3", "iso_fused"], mapped("chain_test3", "iso_fused", "fused", "p_fraud"))
oracle("calibration_chain", f"SELECT tx_id, {rs(['p_supervised', 'p_anomaly', 'p_fraud'])} FROM chain_out", "chain_out")


# A step sees the history of all clients and the late steps of its own client. Components: those of the history, joined by the client's own late steps.
cte("cutoff", ["tx"], f"SELECT max(us) - {2 * DAY} AS c FROM tx")
cte("later", ["tx", "cutoff"], "SELECT tx.* FROM tx, cutoff WHERE us >= c")
cte("marked", ["tx", "cutoff"], "SELECT tx.*, us >= c AS late FROM tx, cutoff")
network("fnet_replay", "later", "marked", "AND (NOT p.late OR p.client_id = t.client_id)")
cte("old_link", ["marked"], """SELECT DISTINCT concat('c:', client_id) AS a, b FROM (
 SELECT client_id, concat('d:', device_id) AS b FROM marked WHERE NOT late UNION ALL SELECT client_id, concat('i:', ip) FROM marked WHERE NOT late
 UNION ALL SELECT client_id, concat('r:', recipient_id) FROM marked WHERE NOT late AND recipient_id <> '')""")
cte("o0", ["old_link"], """SELECT a, b FROM old_link UNION SELECT b, a FROM old_link
 UNION SELECT x, x FROM (SELECT a AS x FROM old_link UNION SELECT b FROM old_link)""")
for _i in range(1, 6):
    cte(f"o{_i}", [f"o{_i - 1}"], f"SELECT DISTINCT x.a, y.b FROM o{_i - 1} x JOIN o{_i - 1} y ON x.b = y.a")
cte("old_comp", ["o5"], "SELECT a AS node, min(b) AS label, count(*) AS n, count(*) FILTER (b LIKE 'c:%') AS c FROM o5 GROUP BY a")
cte("late_nodes", ["later"], """SELECT t.tx_id, concat('c:', t.client_id) AS node FROM later t
 UNION SELECT t.tx_id, unnest([concat('d:', p.device_id), concat('i:', p.ip), CASE WHEN p.recipient_id <> '' THEN concat('r:', p.recipient_id) END])
 FROM later t JOIN later p ON p.client_id = t.client_id AND (p.us < t.us OR (p.us = t.us AND p.tx_id < t.tx_id))""")
cte("fcomp_replay", ["late_nodes", "old_comp"], """SELECT tx_id, CAST(sum(c) AS DOUBLE) AS component_clients, CAST(sum(n) AS DOUBLE) AS component_size FROM (
 SELECT DISTINCT l.tx_id, coalesce(label, l.node) AS label, coalesce(c, CASE WHEN l.node LIKE 'c:%' THEN 1 ELSE 0 END) AS c, coalesce(n, 1) AS n
 FROM late_nodes l LEFT JOIN old_comp o ON o.node = l.node WHERE l.node IS NOT NULL) GROUP BY tx_id""")
cte("replayed", ["scored", "fnet_replay", "fcomp_replay", "fclient"], f"""SELECT * REPLACE (least(p_fraud / 2 + tx_count_24h / 40 + recipient_clients_24h / 200 + clients_per_device / 1000
 + component_clients / 10000, {dbl(0.99)}) AS p_fraud) FROM scored JOIN fnet_replay USING (tx_id) JOIN fcomp_replay USING (tx_id)
 JOIN (SELECT tx_id, tx_count_24h, amount_to_avg, history_len FROM fclient) USING (tx_id)""")
cte("late_dec", ["replayed"], f"SELECT *, {best()} AS action FROM (SELECT *, {costs(clv=clv_amount())} FROM replayed)")
PEAKS = ["tx_count_24h", "amount_to_avg", "history_len", *NETWORK_FEATURES]
oracle("replay_sequence", f"""SELECT client_id AS scenario_id, count(*) AS steps, arg_max(action, (us, tx_id)) AS final_action, {r('max(p_fraud)', 'max_p_fraud')},
 {r('sum(amount)', 'total_amount')}, {', '.join(r(f'max({f})', f'max_{f}') for f in PEAKS)} FROM late_dec GROUP BY client_id""", "late_dec")


def gate_text() -> str:
    from riskloom.operators.drift import GATE_TEXT

    shown = {"data_shift": ("ns > 0", "sh"), "calibration": ("wg > 0.006", "format('{:.4f}', wg)")}
    return " UNION ALL ".join(
        f"SELECT '{k}' AS kind, " + ", ".join(f"replace({q(t)}, '{{v}}', {shown[k][1]}) AS {lang}" for lang, t in texts.items())
        + f" FROM gate WHERE {shown[k][0]}" for k, texts in GATE_TEXT.items())


oracle("gate_reasons", gate_text(), "gate")
